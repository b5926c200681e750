"""Graph structure over edges(src, dst[, weight]) and nodes(node_id): cleaning, degrees, components, linear algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.storage import forgotten, swept
from nodeloom.storage import written as cut_lineage


def swapped(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each, with weight 1."""
    both = edges.select("src", "dst").union(swapped(edges.select("src", "dst")))
    return both.distinct().withColumn("weight", F.lit(1.0))


def clean(edges: DataFrame) -> DataFrame:
    """Without self-loops and zero weights, weight 1."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    return edges.where((F.col("src") != F.col("dst")) & (weight != 0)).select("src", "dst").distinct().withColumn("weight", F.lit(1.0))


def undirected_once(edges: DataFrame) -> DataFrame:
    """One row per undirected edge; duplicates in either orientation go."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """degree (neighbours) and strength (weights) per node; with nodes, isolated ones have 0."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum(weight.cast("double")).alias("strength"))
    if nodes is None:
        return out
    return nodes.select("node_id").join(out, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def ranked(values: DataFrame, order: list[str], name: str) -> DataFrame:
    """values with name, 0, 1, ... in the order of the columns, ties apart: ranks inside range partitions, shifted by
    the counts of the ranges before. The one global window runs over a row per range."""
    ranges = cut_lineage(values.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_range", "_rank", "_before")


def running(table: DataFrame, key: str, order: list[str], sums: dict[str, Column], before_too: bool = False) -> DataFrame:
    """table with running sums: name -> the sum of a column over the key's rows up to this one, in the order of the columns;
    with before_too also name_before, that of the rows before.

    Rows lie in ranges of (key, order), so a key of any size is spread over many tasks; sums inside a range are shifted by what
    the key has in the ranges before. Only keys that reach over a range's end are carried, one for a range at most.
    """
    names = list(sums)
    ranges = cut_lineage(table.withColumns({f"_v_{c}": v for c, v in sums.items()}).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    parts = ranges.groupBy(key, "_range").agg(*[F.sum(f"_v_{c}").alias(f"_v_{c}") for c in names])
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), *[F.sum(f"_v_{c}").over(before).alias(f"_s_{c}") for c in names])
    shifts = cut_lineage(shifts.where(F.col(f"_s_{names[0]}").isNotNull()))
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = {c: F.sum(f"_v_{c}").over(inside) for c in names}
    if before_too:
        inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        found |= {f"{c}_before": F.coalesce(F.sum(f"_v_{c}").over(inside), F.lit(0)) for c in names}
    out = ranges.select(*table.columns, "_range", *[v.alias(c) for c, v in found.items()])
    out = out.join(F.broadcast(shifts), (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_at")), "left")
    shift = lambda c: F.coalesce(f"_s_{c.removesuffix('_before') if c not in names else c}", F.lit(0))
    return out.select(*table.columns, *[(F.col(c) + shift(c)).alias(c) for c in found])


def contiguous(table: DataFrame, column: str, name: str) -> DataFrame:
    """Labels 0..K-1 in sorted order of the column's distinct values, null first."""
    labels = ranked(table.select(column).distinct(), [column], name).select(F.col(column).alias("_label"), name)
    return table.join(labels, F.col(column).eqNullSafe(F.col("_label"))).drop("_label")


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node_id, component), the least node id reachable over the undirected edges (a, b).

    Alternating large-star and small-star rounds, logarithmic in the diameter; each is two map-side combined minima and
    two equi-joins against tables, so that the skew join can split a hub, which is never gathered. Nodes without edges,
    and null ends, are not returned.
    """
    now = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        inner = now.select(F.col("v").alias("u")).distinct().join(now.select("u"), "u", "left_semi")
        if now.groupBy("u").count().where("count > 1").select("u").union(inner).isEmpty():
            break
    roots = now.select(F.col("v").alias("node_id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node_id"), F.col("v").alias("component")).union(roots)


def colouring(edges: DataFrame, seed: str = "colour") -> DataFrame:
    """(node_id, colour): no two neighbours have one colour; colours count from 0, at most one more than the largest degree.

    In a round every node that precedes its uncoloured neighbours, by degree and hash, takes the least colour that none
    of its neighbours has. Only edges between uncoloured nodes go on to the next round. A hub gathers its neighbours'
    distinct colours, of which there are few, never its neighbours.
    """
    ends = cut_lineage(symmetrize(edges).where("src <> dst").select("src", "dst"))
    rank = degrees(ends).select("node_id", F.struct(-F.col("degree"), F.xxhash64(F.lit(seed), "node_id"), F.col("node_id")).alias("rank"))
    rank = cut_lineage(rank)
    left = ends.join(rank.select(F.col("node_id").alias("src"), F.col("rank").alias("a")), "src").join(rank.select(F.col("node_id").alias("dst"), F.col("rank").alias("b")), "dst")
    left = cut_lineage(left.select("src", "dst", (F.col("b") < F.col("a")).alias("later")))
    open_, done = rank.select("node_id"), None
    while True:
        first = cut_lineage(open_.join(left.where("later").select(F.col("src").alias("node_id")), "node_id", "left_anti"))
        if done is None:
            got = first.select("node_id", F.lit(0).alias("colour"))
        else:
            near = ends.join(first.withColumnRenamed("node_id", "src"), "src").join(done.withColumnRenamed("node_id", "dst"), "dst")
            used = near.groupBy(F.col("src").alias("node_id")).agg(F.collect_set("colour").alias("used"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
            got = first.join(used, "node_id", "left").select("node_id", F.coalesce(free, F.lit(0)).alias("colour"))
        done = cut_lineage(got if done is None else done.union(got))
        open_ = cut_lineage(open_.join(first, "node_id", "left_anti"))
        if open_.isEmpty():
            return done
        left = cut_lineage(left.join(first.withColumnRenamed("node_id", "src"), "src", "left_anti").join(first.withColumnRenamed("node_id", "dst"), "dst", "left_anti"))


def largest_component(edges: DataFrame) -> DataFrame:
    """(node_id, new_id) of the largest component, ties to the least label; new_id counts from 0 in node order."""
    of = components(edges)
    size = of.groupBy("component").count()
    top = size.agg(F.max_by("component", F.struct(F.col("count"), -F.col("component"))).alias("component"))
    kept = of.join(F.broadcast(top), "component").select("node_id")
    return ranked(kept, ["node_id"], "new_id")


def scatter(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """A result on part of the nodes, back on all of them: null elsewhere."""
    return nodes.select("node_id").join(values, "node_id", "left")


def row_normalize(edges: DataFrame, mode: str = "prob") -> DataFrame:
    """Weights over their row's sum (prob) or Euclidean norm (norm), floored at 1e-32."""
    weight = F.col("weight").cast("double")
    total = {"prob": F.sum(weight), "norm": F.sqrt(F.sum(weight * weight))}[mode]
    rows = edges.groupBy("src").agg(F.greatest(total, F.lit(1e-32)).alias("total"))
    return edges.join(rows, "src").select("src", "dst", (weight / F.col("total")).alias("weight"))


def transition_cdf(edges: DataFrame) -> DataFrame:
    """Each row's running transition probability in dst order; the last is 1 exactly."""
    ends = edges.groupBy(F.col("src").alias("_src")).agg(F.max("dst").alias("_end"))
    rows = running(row_normalize(edges), "src", ["dst"], {"cdf": F.col("weight")})
    rows = rows.join(ends, F.col("src") == F.col("_src"))
    return rows.select("src", "dst", F.when(F.col("dst") == F.col("_end"), 1.0).otherwise(F.col("cdf")).alias("cdf"))


def matvec(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """A b of edges and vector(node_id, value), in long form."""
    return edges.join(vector.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def matmul(a: DataFrame, b: DataFrame, side: int = 2_000) -> DataFrame:
    """A B, sparse. A node that meets more than side * side pairs of an entry of A and one of B has its column of A and its row of
    B dealt into slices of about `side` entries: each pair of slices meets in a task of its own, and what has the
    same ends is summed there before it is exchanged. Both are counted first: small ones can't have such a node."""
    left, right = a.withColumnRenamed("dst", "mid"), b.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("weight").alias("w2"))
    product = lambda met: met.groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("weight") * F.col("w2")).alias("weight"))
    if a.count() * b.count() <= side * side:
        return product(left.join(right, "mid"))
    n = lambda x, c: x.groupBy("mid").agg(F.count(F.lit(1)).alias(c))
    heavy = n(left, "n1").join(n(right, "n2"), "mid").where(F.col("n1") * F.col("n2") > side * side)
    heavy = heavy.select("mid", F.ceil(F.col("n1") / side).alias("rows"), F.ceil(F.col("n2") / side).alias("cols"))

    def dealt(x: DataFrame, end: str, own: str, other: str) -> DataFrame:
        x = x.join(heavy, "mid", "left").withColumn(f"_{own}", F.coalesce(F.pmod(F.xxhash64(end), own), F.lit(0)))
        return x.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))).drop("rows", "cols")

    return product(dealt(left, "src", "rows", "cols").join(dealt(right, "to", "cols", "rows"), ["mid", "_rows", "_cols"]))


def power_sum(edges: DataFrame, terms: int) -> DataFrame:
    """A + A^2 + ... + A^terms, sparse."""
    edges = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    power, out = edges, None
    for k in range(terms):
        power = power if k == 0 else cut_lineage(matmul(power, edges))
        out = power if out is None else out.union(power)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def walk_pmi(edges: DataFrame, window: int) -> DataFrame:
    """log((1/T) sum_t P^t[i,j] / pi_j), the matrix that skip-gram on walks factorises; pi is degree over volume."""
    walks = power_sum(row_normalize(edges), window)
    volume = edges.agg(F.sum("weight").alias("volume"))
    pi = degrees(edges).crossJoin(F.broadcast(volume)).select(F.col("node_id").alias("dst"), (F.col("strength") / F.col("volume")).alias("pi"))
    return walks.join(pi, "dst").select("src", "dst", F.ln(F.greatest(F.col("weight") / window / F.col("pi"), F.lit(1e-12))).alias("pmi"))


def modularity_vector(edges: DataFrame, rounds: int, seed: Column) -> DataFrame:
    """The leading vector of A/2m - dd'/(2m)^2 by power iteration; dd' is never formed, it is two sums."""
    deg = cut_lineage(degrees(edges).select("node_id", F.col("strength").alias("d")))
    two_m = deg.agg(F.sum("d")).first()[0]
    vector = deg.select("node_id", seed.alias("value"))
    for _ in range(rounds):
        dot = vector.join(deg, "node_id").agg(F.sum(F.col("d") * F.col("value"))).first()[0]
        raw = matvec(edges, vector).join(deg, "node_id").select("node_id", (F.col("value") / two_m - F.col("d") * dot / two_m**2).alias("value"))
        raw = cut_lineage(raw)
        norm = raw.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 1.0
        vector = raw.select("node_id", (F.col("value") / norm).alias("value"))
    return vector


def block_matrix(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edge weight between every two blocks that are joined: U'AU in long form."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    a = members.select(F.col("node_id").alias("src"), F.col("membership").alias("block_a"))
    b = members.select(F.col("node_id").alias("dst"), F.col("membership").alias("block_b"))
    return edges.join(a, "src").join(b, "dst").groupBy("block_a", "block_b").agg(F.sum(weight).alias("weight"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node_id, triangles, degree, clustering): each triangle is found once, from its lowest-degree corner.

    Edges point from the lower (degree, id) to the higher, which bounds the pairs made at a hub.
    """
    deg = degrees(edges).select("node_id", "degree")
    once = undirected_once(edges)
    d = once.join(deg.select(F.col("node_id").alias("src"), F.col("degree").alias("da")), "src").join(deg.select(F.col("node_id").alias("dst"), F.col("degree").alias("db")), "dst")
    up = F.struct("da", "src") < F.struct("db", "dst")
    arcs = cut_lineage(d.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    two = arcs.join(arcs.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = two.join(once, (F.col("b") == F.col("src")) & (F.col("c") == F.col("dst"))).select("a", "b", "c")
    each = closed.select(F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return deg.join(each, "node_id", "left").select("node_id", F.coalesce("triangles", F.lit(0)).alias("triangles"), "degree", F.when(F.col("degree") > 1, F.coalesce("triangles", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"))


def common_neighbors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each pair (a, b): how many neighbours they share.

    The neighbours of the end that has fewer are looked up at the other end by (end, neighbour), so a hub's neighbours are
    listed only for pairs of hubs, and no task gets all that a hub has.
    """
    ends = edges.select("src", F.col("dst").alias("n"))
    deg = ends.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    x = pairs.select("a", "b").distinct().join(deg.select(F.col("src").alias("a"), F.col("k").alias("ka")), "a").join(deg.select(F.col("src").alias("b"), F.col("k").alias("kb")), "b")
    turn = F.col("ka") <= F.col("kb")
    x = x.select("a", "b", F.when(turn, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("far"))
    met = x.join(ends, "src").join(ends.withColumnRenamed("src", "far"), ["far", "n"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"))


def mates(edges: DataFrame, members: DataFrame, same: bool = True) -> DataFrame:
    """Edges whose ends share a community (semi-join), or share none (anti-join); members may overlap."""
    a = members.select(F.col("node_id").alias("src"), "membership")
    b = members.select(F.col("node_id").alias("dst"), "membership")
    shared = edges.select("src", "dst").join(a, "src").join(b, ["dst", "membership"]).select("src", "dst").distinct()
    return edges.select("src", "dst").join(shared, ["src", "dst"], "left_semi" if same else "left_anti")


def loosest_neighbor(edges: DataFrame) -> DataFrame:
    """(node_id, neighbor, common): the neighbour that shares the fewest neighbours with a node, ties to the least."""
    shared = common_neighbors(edges, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    best = shared.groupBy(F.col("a").alias("node_id")).agg(F.min(F.struct("common", "b")).alias("m"))
    return best.select("node_id", F.col("m.b").alias("neighbor"), F.col("m.common").alias("common"))


def community_overlap(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(node_id, membership, n): how many of a node's neighbours are in each community; members may overlap."""
    at = members.select(F.col("node_id").alias("dst"), "membership")
    return edges.select("src", "dst").distinct().join(at, "dst").groupBy(F.col("src").alias("node_id"), "membership").agg(F.count(F.lit(1)).alias("n"))


def same_entries(a: DataFrame, b: DataFrame) -> bool:
    """Whether two matrices (src, dst, weight) are equal: entries of 0 are as good as none."""
    one, two = (x.select("src", "dst", F.col("weight").cast("double").alias("w")).where("w <> 0") for x in (a, b))
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def is_symmetric(edges: DataFrame) -> bool:
    """Whether a matrix equals its transpose: entries of 0 are as good as none. Of each pair of ends and each weight, entries one
    way are counted against those the other way, which a task does before it exchanges what is left over."""
    x = edges.select("src", "dst", F.col("weight").cast("double").alias("w")).where("w <> 0").where(~F.col("src").eqNullSafe(F.col("dst")))
    forth = F.coalesce(F.col("src") < F.col("dst"), F.col("src").isNull())  # null before all
    x = x.select(F.when(forth, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(forth, F.col("dst")).otherwise(F.col("src")).alias("b"), "w", F.when(forth, 1).otherwise(-1).alias("way"))
    with swept(edges.sparkSession):
        return x.groupBy("a", "b", "w").agg(F.sum("way").alias("n")).where("n <> 0").isEmpty()


def prefix_blocks(n_by_block: DataFrame, block: str = "membership", size: str = "n") -> DataFrame:
    """(block, first, last): blocks filled one after the other, in order; a row per block."""
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")
    return n_by_block.select(block, first.alias("first"), (first + F.col(size) - 1).cast("long").alias("last"))
