"""Benchmark graphs with power-law degrees and community sizes, in stages: laws, degrees, sizes, places, wiring, repair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.functions.scalars import power_law_least, uniform
from nodeloom.operators.structure import cut_lineage, degrees, mates, ranked


@dataclass(frozen=True)
class Parameters:
    """n nodes; mixing: the share of a node's edges that leave its communities. Without a range of community sizes it is
    from max(least degree, 3) to the largest degree. overlapping nodes have memberships communities each. bound:
    "sup" and "inf" let no node's mixing be above or below the rate by rounding. clustering: raise the average
    clustering coefficient inside communities towards it."""

    n: int
    mean_degree: float
    max_degree: int
    mixing: float
    degree_exponent: float = 2.0
    size_exponent: float = 1.0
    min_community: int | None = 10
    max_community: int | None = 100
    seed: str = "lfr"
    overlapping: int = 0
    memberships: int = 2
    bound: str | None = None
    clustering: float = 0.0

    def __post_init__(self) -> None:
        if min(self.n, self.mean_degree, self.max_degree, self.min_community or 1, self.max_community or 1) <= 0 or not 0 <= self.mixing <= 1:
            raise ValueError("sizes and degrees are positive, the mixing rate is from 0 to 1")
        if self.max_degree >= self.n or (self.min_community and self.max_community and self.min_community > self.max_community):
            raise ValueError("the ranges of degrees or community sizes are empty")
        if not 0 <= self.overlapping <= self.n or self.memberships < 1 or self.bound not in (None, "sup", "inf"):
            raise ValueError("overlapping nodes are at most all, with one community or more; bound is sup or inf")

    def sizes(self) -> tuple[int, int]:
        if self.min_community and self.max_community:
            return self.min_community, min(self.max_community, self.n)
        least = min(a for a, _ in degree_cutoffs(self))
        low = self.min_community or max(least, 3)
        return low, min(max(low, self.max_community or self.max_degree), self.n)


def discrete_mean(least: int, most: int, exponent: float) -> float:
    """Mean of the law h ** -exponent on the integers least..most."""
    h = np.arange(least, most + 1, dtype=float)
    return float((h ** (1 - exponent)).sum() / (h**-exponent).sum())


def degree_cutoffs(p: Parameters) -> list[tuple[int, float]]:
    """Least degrees with their shares: the two integers around the cut-off, mixed so that the discrete mean is p.mean_degree."""
    low = max(1, int(power_law_least(p.mean_degree, p.max_degree, p.degree_exponent)))
    while low > 1 and discrete_mean(low, p.max_degree, p.degree_exponent) > p.mean_degree:
        low -= 1
    while low < p.max_degree - 1 and discrete_mean(low + 1, p.max_degree, p.degree_exponent) < p.mean_degree:
        low += 1
    a, b = (discrete_mean(x, p.max_degree, p.degree_exponent) for x in (low, low + 1))
    share = min(1.0, max(0.0, (b - p.mean_degree) / (b - a)))
    return [(x, s) for x, s in ((low, share), (low + 1, 1 - share)) if s > 0]


def power_law_cdf(spark: SparkSession, least: int, most: int, exponent: float) -> DataFrame:
    """(value, cdf) of the discrete power law on least..most; a table of a parameter's size."""
    x = spark.range(least, most + 1).select(F.col("id").alias("value"), F.pow(F.col("id").cast("double"), F.lit(-exponent)).alias("w"))
    running = F.sum("w").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("value", (running / F.sum("w").over(Window.partitionBy())).alias("cdf"))


def _draw(table: DataFrame, law: DataFrame, u: str) -> DataFrame:
    """The least value whose cdf reaches u. The law goes along as one array."""
    packed = law.agg(F.array_sort(F.collect_list(F.struct("value", "cdf"))).alias("law"))
    x = table.crossJoin(F.broadcast(packed))
    return x.withColumn("drawn", F.element_at(F.col("law.value"), F.least(F.size(F.filter("law", lambda s: s["cdf"] < F.col(u))) + 1, F.size("law")))).drop("law")


def even_degrees(table: DataFrame) -> DataFrame:
    """table(node_id, degree) with one less at the largest degree (of its last node) where the sum is odd."""
    top = table.agg(F.max_by("node_id", F.struct("degree", "node_id")).alias("top"), (F.sum("degree") % 2).alias("odd"))
    return table.crossJoin(F.broadcast(top)).withColumn("degree", F.col("degree") - F.when(F.col("node_id") == F.col("top"), F.col("odd")).otherwise(0)).drop("top", "odd")


def degree_sequence(spark: SparkSession, p: Parameters) -> DataFrame:
    """(node_id, degree, internal): degrees ascend with node_id, by the inverse law at (node_id + a hash uniform) / n, so
    that their mean is the law's; their sum is even. internal is (1 - mixing) * degree, rounded by a draw of its own,
    or as `bound` says."""
    law = None
    for least, share in degree_cutoffs(p):
        one = power_law_cdf(spark, least, p.max_degree, p.degree_exponent).withColumn("cdf", F.col("cdf") * share)
        pmf = one.withColumn("pmf", F.col("cdf") - F.coalesce(F.lag("cdf").over(Window.orderBy("value")), F.lit(0.0))).select("value", "pmf")
        law = pmf if law is None else law.union(pmf)
    running = F.sum("pmf").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    law = law.groupBy("value").agg(F.sum("pmf").alias("pmf")).select("value", running.alias("cdf"))
    x = spark.range(p.n).select(F.col("id").alias("node_id"), ((F.col("id") + uniform(p.seed, "k", F.col("id"))) / p.n).alias("u"))
    x = even_degrees(_draw(x, law, "u").select("node_id", F.col("drawn").alias("degree")))
    want = F.col("degree") * (1 - p.mixing)
    internal = {"sup": F.ceil(want), "inf": F.floor(want), None: F.floor(want + uniform(p.seed, "in", F.col("node_id")))}[p.bound]
    return x.select("node_id", "degree", F.least(internal, F.col("degree")).cast("long").alias("internal"))


def community_sizes(spark: SparkSession, p: Parameters) -> DataFrame:
    """(community, size, first): sizes drawn until all memberships have a place; what is left over by then is shared out,
    one place each, over the communities that have room. first counts the places before, largest communities first."""
    low, high = p.sizes()
    places = p.n + p.overlapping * (p.memberships - 1)
    law = power_law_cdf(spark, low, high, p.size_exponent)
    mean = law.agg(F.sum(1 - F.col("cdf"))).first()[0] + low
    x = spark.range(int(places / mean * 1.5) + 50 if places > 20 * high else places // low + 1)
    x = _draw(x.select(F.col("id").alias("community"), uniform(p.seed, "s", F.col("id")).alias("u")), law, "u").select("community", F.col("drawn").alias("size"))
    x = ranked(x, ["community"], "c").drop("c")  # in ranges
    before = F.coalesce(F.sum("size").over(Window.orderBy("community").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = cut_lineage(x.withColumn("before", before).where(F.col("before") + F.col("size") <= places).select("community", "size"))
    have = x.agg(F.count(F.lit(1)), F.sum("size"), F.max("community")).first()
    rest = places - (have[1] or 0)
    if rest >= low or not have[0]:
        x, rest = x.union(spark.createDataFrame([((have[2] if have[2] is not None else -1) + 1, rest)], "community long, size long")), 0
    room = F.row_number().over(Window.orderBy((F.col("size") >= high), "size", "community")) - 1
    count = max(1, have[0] or 1)
    x = x.withColumn("size", F.col("size") + F.floor(F.lit(rest) / count) + (room < rest % count).cast("long"))
    order = Window.orderBy(F.desc("size"), "community").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(x.withColumn("first", F.coalesce(F.sum("size").over(order), F.lit(0))))


def place_nodes(nodes: DataFrame, sizes: DataFrame, p: Parameters, swaps: int = 6) -> DataFrame:
    """(node_id, membership, internal): each membership in a place of a community that is larger than its internal degree.

    Members by falling internal degree meet places by falling size, which fits if anything does; what does not fit
    becomes external. Then members trade places at random, `swaps` times each, where both fit: pairs are neighbours in
    hash order. A node's internal degree is split evenly over its communities.
    """
    split = F.floor(F.col("internal") / F.col("m")) + (F.col("part") < F.col("internal") % F.col("m")).cast("long")
    many = F.lit(1)
    if p.overlapping:
        nodes = ranked(nodes.withColumn("u", uniform(p.seed, "many", F.col("node_id"))), ["u", "node_id"], "turn")
        many = F.when(F.col("turn") < p.overlapping, p.memberships).otherwise(1)
    parts = nodes.withColumn("m", many).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    parts = parts.select("node_id", "part", split.alias("internal"), (-split).alias("order"))
    parts = ranked(parts, ["order", "node_id", "part"], "place").drop("order")
    slots = sizes.select("community", "size", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("place"))
    now = parts.join(slots, "place").select("node_id", "part", F.least("internal", F.col("size") - 1).alias("internal"), "community", "size")
    now = cut_lineage(now)
    twice = F.count(F.lit(1)).over(Window.partitionBy("node_id", "community")) > 1
    for r in range(swaps + (20 if p.overlapping else 0)):
        if r >= swaps:  # a node that is in one community twice trades on
            now = cut_lineage(now.withColumn("clash", twice))
            if now.where("clash").isEmpty():
                break
        else:
            now = now.withColumn("clash", F.lit(True))
        mixed = ranked(now.withColumn("u", uniform(p.seed, "swap", F.lit(r), F.col("node_id"), F.col("part"))), ["u", "node_id", "part"], "turn").drop("u")
        pair = F.floor(F.col("turn") / 2)
        mixed = cut_lineage(mixed.withColumn("pair", pair))
        other = mixed.select("pair", F.col("turn").alias("t2"), F.col("node_id").alias("n2"), F.col("internal").alias("k2"), F.col("community").alias("c2"), F.col("size").alias("s2"), F.col("clash").alias("clash2"))
        both = mixed.join(other, (mixed["pair"] == other["pair"]) & (F.col("turn") != F.col("t2")), "left").drop(other["pair"])
        fits = F.coalesce((F.col("internal") < F.col("s2")) & (F.col("k2") < F.col("size")) & (F.col("clash") | F.col("clash2")), F.lit(False))
        now = cut_lineage(both.select("node_id", "part", "internal", F.when(fits, F.col("c2")).otherwise(F.col("community")).alias("community"), F.when(fits, F.col("s2")).otherwise(F.col("size")).alias("size")))
    once = now.groupBy("node_id", F.col("community").alias("membership")).agg(F.sum("internal").alias("internal"), F.first("size").alias("size"))
    return once.select("node_id", "membership", F.least("internal", F.col("size") - 1).alias("internal"))


def even_communities(members: DataFrame) -> DataFrame:
    """members(node_id, membership, internal) with one stub less at the largest of each community whose sum is odd."""
    odd = members.groupBy("membership").agg((F.sum("internal") % 2).alias("odd"), F.max_by("node_id", F.struct("internal", "node_id")).alias("top"))
    return members.join(odd, "membership").withColumn("internal", F.col("internal") - F.when(F.col("node_id") == F.col("top"), F.col("odd")).otherwise(0)).drop("odd", "top")


def simple_graph(degree: np.ndarray, rng: np.random.Generator, clustering: float = 0.0, turns: int = 10) -> list[tuple[int, int]]:
    """Edges of a random simple graph with these degrees, as far as they can be had: the node with most free stubs joins
    those with most left, then edges trade ends at random, which keeps degrees; trades that lose triangles are
    refused while the clustering is under what is asked."""
    left, near = degree.astype(int).copy(), [set() for _ in degree]
    while left.max(initial=0) > 0:
        a = int(left.argmax())
        free = [b for b in np.argsort(-left, kind="stable").tolist() if b != a and left[b] > 0 and b not in near[a]][: int(left[a])]
        for b in free:
            near[a].add(b)
            near[b].add(a)
            left[b] -= 1
        left[a] = 0
    edges = [(a, b) for a in range(len(near)) for b in near[a] if a < b]

    def coefficient() -> float:
        each = [sum(len(near[b] & near[a]) for b in near[a]) / (len(near[a]) * (len(near[a]) - 1)) for a in range(len(near)) if len(near[a]) > 1]
        return sum(each) / len(each) if each else 1.0

    for turn in range(turns if len(edges) > 1 else 0):
        want = clustering > 0 and coefficient() < clustering
        for e, f in rng.integers(0, len(edges), (len(edges), 2)).tolist():
            (a, b), (c, d) = edges[e], edges[f]
            if len({a, b, c, d}) < 4 or c in near[a] or d in near[b]:
                continue
            if want and len(near[a] & near[c]) + len(near[b] & near[d]) < len(near[a] & near[b]) + len(near[c] & near[d]):
                continue
            for x, y in ((a, b), (c, d)):
                near[x].discard(y)
                near[y].discard(x)
            for x, y in ((a, c), (b, d)):
                near[x].add(y)
                near[y].add(x)
            edges[e], edges[f] = (a, c), (b, d)
    return edges


def wire_communities(members: DataFrame, p: Parameters) -> DataFrame:
    """(src, dst), once each, inside communities: one task wires a community, which has at most max_community members."""
    seed = int.from_bytes(p.seed.encode()[:6], "little")

    def wire(group: pa.Table) -> pa.Table:
        ids, degree, community = group.column("node_id").to_numpy(), group.column("internal").to_numpy(), group.column("membership")[0].as_py()
        order = np.argsort(ids)
        ids, degree = ids[order], degree[order]
        found = [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in simple_graph(degree, np.random.default_rng([seed, int(community)]), p.clustering)]
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return members.groupBy("membership").applyInArrow(wire, "src long, dst long").distinct()


def wire_outside(stubs: DataFrame, members: DataFrame, p: Parameters, rounds: int = 40, patience: int = 10) -> DataFrame:
    """(src, dst), once each, between nodes that share no community: stubs(node_id, external) are paired in hash order.

    Pairs that are loops, repeats, or of one community come apart. In the next round they are paired anew; from the
    third on each takes the place of one edge in hash order, which gives its ends to theirs: a, b and c - d become
    a - c and b - d. It ends when no stub is left, or after `patience` rounds that place none.
    """
    spark = stubs.sparkSession
    free = cut_lineage(stubs.where("external > 0").select("node_id", F.explode(F.sequence(F.lit(1), F.col("external").cast("int"))).alias("slot")))
    edges = spark.createDataFrame([], "src long, dst long")
    left, idle = free.count(), 0

    def allowed(pairs: DataFrame, have: DataFrame) -> DataFrame:
        """pairs(src, dst, ...) that are no loops, not of one community, and not there yet."""
        near = pairs.select("src", "dst").join(members.select(F.col("node_id").alias("src"), "membership"), "src").join(members.select(F.col("node_id").alias("dst"), "membership"), ["dst", "membership"])
        fine = pairs.where("src < dst").join(near.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
        return fine.join(have, ["src", "dst"], "left_anti")

    for r in range(rounds):
        if left < 2 or idle >= patience:
            break
        order = ranked(free.withColumn("u", uniform(p.seed, "out", F.lit(r), F.col("node_id"), F.col("slot"))), ["u", "node_id", "slot"], "at").drop("u")
        order = cut_lineage(order.withColumn("pair", F.floor(F.col("at") / 2)))
        pairs = order.groupBy("pair").agg(F.collect_list(F.struct("node_id", "slot")).alias("s")).where("size(s) = 2")
        pairs = pairs.select("pair", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
        ends = lambda x, y: (F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
        if r < 2:
            tried = pairs.select("pair", *ends(F.col("a.node_id"), F.col("b.node_id")))
            good = cut_lineage(allowed(tried, edges).dropDuplicates(["src", "dst"]))
            gone = edges.limit(0)
            fresh = good.select("src", "dst")
        else:
            picked = ranked(edges.withColumn("u", uniform(p.seed, "edge", F.lit(r), F.col("src"), F.col("dst"))), ["u", "src", "dst"], "pair").drop("u")
            tried = pairs.join(picked.withColumnsRenamed({"src": "c", "dst": "d"}), "pair")
            both = tried.select("pair", F.lit(0).alias("side"), *ends(F.col("a.node_id"), F.col("c"))).union(tried.select("pair", F.lit(1).alias("side"), *ends(F.col("b.node_id"), F.col("d"))))
            fine = cut_lineage(allowed(both, edges))
            first = fine.groupBy("src", "dst").agg(F.min("pair").alias("pair"))  # of two pairs that want one edge, one
            good = cut_lineage(first.groupBy("pair").agg(F.collect_list(F.struct("src", "dst")).alias("new")).where("size(new) = 2"))
            gone = tried.join(good.select("pair"), "pair", "left_semi").select(F.col("c").alias("src"), F.col("d").alias("dst"))
            fresh = good.select(F.explode("new").alias("e")).select("e.src", "e.dst")
        edges = cut_lineage(edges.join(gone, ["src", "dst"], "left_anti").union(fresh))
        free = cut_lineage(order.join(good.select("pair"), "pair", "left_anti").select("node_id", "slot"))
        before, left = left, free.count()
        idle = idle + 1 if left == before else 0
    return edges


def mixing_needs(once: DataFrame, members: DataFrame, nodes: DataFrame, p: Parameters) -> DataFrame:
    """(node_id, need): how many links to other communities a node must lose (bound `sup`: its mixing is at most p.mixing) or take
    (`inf`: at least). Its last link a node keeps, and it has no more than one to each other node."""
    both = once.union(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    inner = mates(both, members).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("inner"))
    x = nodes.select("node_id").join(degrees(both).select("node_id", "degree"), "node_id").join(inner, "node_id", "left").na.fill(0, ["inner"])
    share = max(1e-12, 1 - p.mixing)
    if p.bound == "sup":
        allowed = F.greatest(F.floor(F.col("inner") / share + 1e-9), F.lit(1))
        need = F.col("degree") - allowed
    else:
        wanted = F.least(F.ceil(F.col("inner") / share - 1e-9), F.lit(p.n - 1))
        need = wanted - F.col("degree")
    return x.select("node_id", need.cast("long").alias("need")).where("need > 0")


def repair_mixing(once: DataFrame, members: DataFrame, nodes: DataFrame, p: Parameters, rounds: int = 60, patience: int = 5) -> tuple[DataFrame, int]:
    """(edges once each, exceptions): p.bound made to hold for every node, by links between communities that go or come.

    sup: in a round each node with too many asks for as many of its links as must go, in one order of all links. A link goes
    if both ends ask for it, or one does and the other needs all gone too few to mind; the first link of the order
    between two that must lose is always granted, so rounds end. inf: places that nodes must take are paired with each
    other in hash order; from the third round on they ask nodes drawn from all. exceptions counts the nodes for which the bound
    does not hold at the end (none of their links may go, or no partner was found).
    """
    if p.bound is None:
        return once, 0
    once = cut_lineage(once)
    if p.bound == "sup":
        while True:
            need = cut_lineage(mixing_needs(once, members, nodes, p))
            outer = mates(once, members, same=False)
            keyed = outer.withColumn("h", F.xxhash64(F.lit(p.seed), "src", "dst"))
            ends = keyed.select("src", "dst", "h", F.col("src").alias("node_id")).union(keyed.select("src", "dst", "h", F.col("dst").alias("node_id")))
            asked = ends.join(need, "node_id")
            asked = asked.withColumn("k", F.row_number().over(Window.partitionBy("node_id").orderBy("h", "src", "dst"))).where("k <= need")
            votes = asked.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("votes"))
            must = need.select("node_id").withColumn("must", F.lit(1))
            votes = votes.join(must.withColumnsRenamed({"node_id": "src", "must": "ma"}), "src", "left").join(must.withColumnsRenamed({"node_id": "dst", "must": "mb"}), "dst", "left")
            gone = cut_lineage(votes.where("votes = 2 OR ma IS NULL OR mb IS NULL").select("src", "dst"))
            if gone.isEmpty():
                break
            once = cut_lineage(once.join(gone, ["src", "dst"], "left_anti"))
        share = max(1e-12, 1 - p.mixing)
        both = once.union(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        inner = mates(both, members).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("inner"))
        left = degrees(both).select("node_id", "degree").join(inner, "node_id", "left").na.fill(0, ["inner"]).where(F.col("inner") < F.col("degree") * share - 1e-9)
        return once, left.count()
    idle, last = 0, None
    for r in range(rounds):
        need = cut_lineage(mixing_needs(once, members, nodes, p))
        total = need.agg(F.sum("need")).first()[0] or 0
        if not total:
            return once, 0
        idle = idle + 1 if last is not None and total >= last else 0
        if idle >= patience:
            break
        last = total
        slots = need.select("node_id", F.explode(F.sequence(F.lit(1), F.col("need").cast("int"))).alias("slot")).withColumn("u", uniform(p.seed, "inf", F.lit(r), F.col("node_id"), F.col("slot")))
        if r < 2:
            order = cut_lineage(ranked(slots, ["u", "node_id", "slot"], "at"))
            a, b = order.where("at % 2 = 0").select("node_id", (F.col("at") / 2).cast("long").alias("pair")), order.where("at % 2 = 1").select(F.col("node_id").alias("other"), ((F.col("at") - 1) / 2).cast("long").alias("pair"))
            pairs = a.join(b, "pair")
        else:
            places = ranked(nodes.select(F.col("node_id").alias("other")), ["other"], "at")
            pairs = slots.withColumn("at", F.floor(F.col("u") * p.n)).join(places, "at")
        pairs = pairs.where("node_id <> other").select(F.least("node_id", "other").alias("src"), F.greatest("node_id", "other").alias("dst")).distinct()
        fresh = mates(pairs, members, same=False).join(once, ["src", "dst"], "left_anti")
        once = cut_lineage(once.union(fresh.select("src", "dst")))
    return once, mixing_needs(once, members, nodes, p).count()


def generate(spark: SparkSession, p: Parameters, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(edges, members): edges in both directions; members(node_id, membership), a row per membership.

    Degrees, mixing and community sizes are those asked for, but for what no simple graph can have: an internal degree
    that no community is large enough for becomes external, and stubs that find no partner in `rounds` are left out. With
    p.bound, links between communities go or come until the mixing of each node keeps to it (see `repair_mixing`).
    """
    nodes = cut_lineage(degree_sequence(spark, p))
    placed = cut_lineage(even_communities(place_nodes(nodes, community_sizes(spark, p), p)))
    inside = cut_lineage(wire_communities(placed, p))
    members = placed.select("node_id", "membership")
    ends = inside.select(F.col("src").alias("node_id")).union(inside.select(F.col("dst").alias("node_id"))).groupBy("node_id").agg(F.count(F.lit(1)).alias("inner"))
    stubs = nodes.join(ends, "node_id", "left").select("node_id", (F.col("degree") - F.coalesce("inner", F.lit(0))).alias("external"))
    if p.mixing == 0 or p.bound == "sup":
        planned = placed.groupBy("node_id").agg(F.sum("internal").alias("internal"))
        stubs = nodes.join(planned, "node_id").select("node_id", F.greatest(F.col("degree") - F.col("internal"), F.lit(0)).alias("external"))
    outside = wire_outside(cut_lineage(stubs), members, p, rounds)
    once, _ = repair_mixing(inside.union(outside), members, nodes, p)
    return once.union(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), members


def statistics(edges: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a benchmark's report: degrees, community sizes, mixing per node, p_in and p_out."""
    from nodeloom.operators import scores
    from nodeloom.operators.structure import degrees

    mixing = scores.mixing(edges, members)
    sizes = members.groupBy("membership").agg(F.count(F.lit(1)).alias("size"))
    return {"degree": scores.log_histogram(degrees(edges), "degree"), "size": scores.integer_histogram(sizes, "size"), "mixing": scores.linear_histogram(mixing, "mixing"), "density": scores.inner_outer_density(edges, members)}
