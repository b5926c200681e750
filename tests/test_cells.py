"""Passes over graphs as cells of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import blockmodel, cells


def graph(spark, n=60, apart=1, seed=3):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n - 2, (4 * n, 2)) if a < b} | {(0, k) for k in range(1, n - 2)}
    rows = [(a * apart, b * apart) for a, b in pairs]
    return spark.createDataFrame(rows + [(b, a) for a, b in rows], "src long, dst long"), spark.createDataFrame([(k * apart,) for k in range(n)], "node_id long")


@pytest.mark.parametrize("apart", [1, 1000])
def test_sums_over_cells_are_those_over_arcs(spark, monkeypatch, apart):
    monkeypatch.setattr(cells, "SLICE", 40)
    monkeypatch.setattr(cells, "PASS", 100)
    edges, nodes = graph(spark, apart=apart)
    g = cells.cell_graph(edges, nodes)
    assert g.slices.count() > 9 and g.arcs.agg(F.sum(F.size("i"))).first()[0] == edges.count()
    value = lambda c: (F.col(c) * 7 % 13).cast("double")
    packs = cells.packed(cells.node_rows(g).withColumn("x", F.array(value("node_id"), F.lit(1.0))), "x", 2)
    width = g.width

    def spread(blk, at, v):
        out = np.zeros((2, width))
        out[:, np.frombuffer(at, np.int64)] = np.frombuffer(v).reshape(2, -1)
        return blk, out.tobytes()

    vectors = cells.each_block(g.blocks.join(packs, "blk"), spread, ["blk", "at", "v"], "blk long, v binary")
    back = lambda blk, at, s: (blk, np.ascontiguousarray(np.frombuffer(s).reshape(2, width)[:, np.frombuffer(at, np.int64)]).tobytes())
    got = cells.unpacked(g, cells.each_block(g.blocks.join(cells.summed(g, vectors, 2), "blk"), back, ["blk", "at", "sums"], "blk long, v binary"), 2)
    want = {r["src"]: [r["a"], r["b"]] for r in edges.groupBy("src").agg(F.sum(value("dst")).alias("a"), F.count(F.lit(1)).cast("double").alias("b")).collect()}
    assert {r.node_id: list(r.x) for r in got.collect() if r.x[1]} == want


def test_affinities_tried_together_are_as_if_tried_alone(spark, monkeypatch):
    monkeypatch.setattr(cells, "SLICE", 40)
    edges, nodes = graph(spark)
    several = [np.array([[9.0, 2.0], [2.0, 9.0]]), np.array([[3.0, 8.0], [8.0, 5.0]])]
    together = blockmodel.mean_fields(cells.cell_graph(edges, nodes), 2, [0.4, 0.6], several, 3)[1]
    assert together == pytest.approx([blockmodel.mean_field(edges, nodes, 2, [0.4, 0.6], c, 3)[1] for c in several], rel=1e-12)
    calls, real = [], blockmodel.mean_fields
    monkeypatch.setattr(blockmodel, "mean_fields", lambda *a: calls.append(len(a[3])) or real(*a))
    by = {}
    for ahead in (3, 1):
        monkeypatch.setattr(blockmodel, "AHEAD", ahead)
        calls.clear()
        cab, energies = blockmodel.walk_learn(edges, nodes, 2, [0.4, 0.6], several[0], steps=3, size=2.0, sweeps=2)
        by[ahead] = [*cab.ravel(), *energies], len(calls)
    assert by[3][0] == pytest.approx(by[1][0], rel=1e-12) and by[3][1] == 1 < by[1][1]


@pytest.mark.parametrize("dc", [0, 2])
def test_messages_in_cells_are_the_messages_in_rows(spark, monkeypatch, dc):
    """Two steps of learning, in many cells and several parts, with a node that hears nothing and arcs given twice."""
    monkeypatch.setattr(cells, "SLICE", 40)
    monkeypatch.setattr(cells, "PASS", 400)
    edges, nodes = graph(spark, n=40)
    eta, cab = [0.4, 0.6], np.array([[9.0, 2.0], [2.0, 5.0]]) / (100 if dc else 1)
    groups, energy = blockmodel.bp_learn(edges.union(edges.limit(30)), nodes, 2, eta, cab, em_steps=2, sweeps=2, dc=dc)
    monkeypatch.setattr(blockmodel.pair_bp, "learned", None)
    same = spark.createDataFrame([(k, 0) for k in range(40)], "node_id long, membership long")
    by_row, want = blockmodel.bp_learn(edges, nodes, 2, eta, cab, em_steps=2, sweeps=2, dc=dc, start="planted", members=same, strength=0.0)
    assert energy == pytest.approx(want, rel=1e-9)
    one, two = ({r.node_id: list(r.psi) for r in x.collect()} for x in (groups, by_row))
    assert set(one) == set(two) == set(range(40)) and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
