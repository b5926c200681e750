"""Walks against exact transition probabilities."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import walks


def weighted(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows] + [(b, a, float(w)) for a, b, w in rows], "src long, dst long, weight double")


#: 0 - 1 with weight 100; from 1 on to 2 (1), 3 (9) and 4 (30); 0 - 3, so that 3 is near 0; 2, 3, 4 lead to 5.
GRAPH = [(0, 1, 100), (1, 2, 1), (1, 3, 9), (1, 4, 30), (0, 3, 1e-9), (2, 5, 1), (3, 5, 1), (4, 5, 1)]


def second_steps(spark, n=4000, **options):
    """Where walks 0 -> 1 go next, as shares."""
    g = weighted(spark, GRAPH)
    start = spark.createDataFrame([(0,)], "node_id long")
    rows = walks.random_walks(g, start, n, 3, **options).where("step > 0").groupBy("walk_id").agg(F.max(F.when(F.col("step") == 1, F.col("node_id"))).alias("a"), F.max(F.when(F.col("step") == 2, F.col("node_id"))).alias("b")).collect()
    seen = collections.Counter(r.b for r in rows if r.a == 1)
    total = sum(seen.values())
    return {k: v / total for k, v in seen.items()}, total


@pytest.mark.parametrize(
    "options, law",
    [
        ({"weighted": True}, {0: 100 / 140, 2: 1 / 140, 3: 9 / 140, 4: 30 / 140}),
        ({"weighted": True, "backtrack": False}, {2: 1 / 40, 3: 9 / 40, 4: 30 / 40}),
        ({"weighted": True, "p": 4.0, "q": 0.5}, {0: 25 / 96, 2: 2 / 96, 3: 9 / 96, 4: 60 / 96}),
        ({"weighted": False, "p": 100.0, "q": 20.0}, {0: 0.01 / 1.11, 2: 0.05 / 1.11, 3: 1 / 1.11, 4: 0.05 / 1.11}),
        ({"weighted": None}, {0: 100 / 140, 2: 1 / 140, 3: 9 / 140, 4: 30 / 140}),
    ],
)
def test_second_steps_have_the_exact_law(spark, options, law):
    got, n = second_steps(spark, **options)
    assert set(got) <= set(law)
    for node, share in law.items():
        assert abs(got.get(node, 0) - share) < 4.5 * (share * (1 - share) / n) ** 0.5 + 1e-3


def test_nonbacktracking_passes_make_up_for_dead_ends(spark):
    path = weighted(spark, [(k, k + 1, 1) for k in range(4)] + [(4, 0, 1), (0, 9, 1)])
    nodes = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 9)], "node_id long")
    got = walks.nonbacktracking_walks(path, nodes, 2, 6)
    rows = got.collect()
    assert len(rows) > 2 * 6 * 6 and len({r.walk_id for r in rows}) % 6 == 0
    by = collections.defaultdict(dict)
    for r in rows:
        by[r.walk_id][r.step] = r.node_id
    for w in by.values():
        assert all(w[k] != w[k + 2] for k in range(len(w) - 2))
    alone = walks.random_walks(path, spark.createDataFrame([(77,)], "node_id long"), 1, 3).collect()
    assert [(r.step, r.node_id) for r in alone] == [(0, 77)]


def test_even_walks_over_hubs_and_one_way_arcs_follow_their_law(spark, monkeypatch):
    """Lists of 3 neighbours at most, so that a hub has many, and those lists begin and end anywhere."""
    monkeypatch.setattr(walks, "LIST", 3)
    monkeypatch.setattr(walks, "PASS", 20)
    arcs = [(0, k) for k in range(1, 24)] + [(k, 0) for k in range(1, 24)] + [(k, k % 23 + 1) for k in range(1, 24)]
    nexts = collections.defaultdict(list)
    for a, b in sorted(arcs):
        nexts[a].append(b)
    g = spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, weight double").repartition(5)
    lists, degree = walks.neighbour_lists(g)
    got = collections.defaultdict(dict)
    for r in lists.collect():
        assert r.off // 3 == (r.off + len(r.dsts) - 1) // 3 == r.slot
        got[r.src] |= dict(enumerate(r.dsts, r.off))
    assert {a: [x[1] for x in sorted(b.items())] for a, b in got.items()} == nexts
    assert {r.node: r.d for r in degree.collect()} == {a: len(b) for a, b in nexts.items()}
    u = lambda *key: int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) / 2**32
    for backtrack in (True, False):
        seen = {(r.walk_id, r.step): r.node_id for r in walks.random_walks(g, None, 2, 5, backtrack=backtrack).collect()}
        want = {}
        for way in range(2):
            for start in nexts:
                want[f"{way}|{start}", 0] = at = start
                before = None
                for step in range(1, 5):
                    choices = [x for x in nexts[at] if backtrack or step == 1 or x != before]
                    before, at = at, choices[int(u("walk", way, start, step) * len(choices))]
                    want[f"{way}|{start}", step] = at
        assert seen == want
    rows = walks.random_walks(g, None, 3, 4, p=4.0, q=0.5).groupBy("step").count().collect()
    assert {r["step"]: r["count"] for r in rows} == {k: 72 for k in range(4)}


def test_a_step_joins_lists_not_arcs(spark):
    g = spark.range(400).select((F.col("id") % 20).alias("src"), F.floor(F.col("id") / 20).alias("dst")).where("src <> dst").withColumn("weight", F.lit(1.0))
    lists, _ = walks.neighbour_lists(g)
    assert lists.count() < 60 and lists.agg(F.sum(F.size("dsts"))).first()[0] == 380
