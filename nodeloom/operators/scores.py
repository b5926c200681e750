"""Scores of a partition: against another (NMI, element-centric similarity), and on a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.operators.structure import block_matrix, degrees


def confusion(labels: DataFrame, truth: str = "y_true", found: str = "y_pred") -> DataFrame:
    """n per pair of labels; rows without a found label don't count."""
    return labels.where(F.col(found).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(found).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def partition_scores(labels: DataFrame, truth: str = "y_true", found: str = "y_pred", by: tuple[str, ...] = ()) -> DataFrame:
    """nmi (arithmetic mean) and esim (element-centric similarity, corrected for chance), per group of `by`.

    All from the confusion counts: its marginals, and for chance the product of the two size tables. What is paired
    there are distinct labels, never rows. Both trivial: null, as 0/0.
    """
    rows = labels.where(F.col(found).isNotNull() & F.col(truth).isNotNull()).withColumn("g", F.struct(*by) if by else F.lit(0))
    n = rows.groupBy("g", F.col(truth).alias("t"), F.col(found).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = n.groupBy("g", "t").agg(F.sum("n").alias("a"))
    b = n.groupBy("g", "p").agg(F.sum("n").alias("b"))
    total = n.groupBy("g").agg(F.sum("n").alias("all"))
    cells = n.join(a, ["g", "t"]).join(b, ["g", "p"]).join(total, "g")
    size = F.greatest("a", "b")
    seen = cells.groupBy("g").agg(F.sum(F.col("n") * F.col("n") / size / F.col("all")).alias("s"), F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"))
    entropy = lambda t, c: t.join(total, "g").groupBy("g").agg((-F.sum(F.col(c) / F.col("all") * F.ln(F.col(c) / F.col("all")))).alias(f"h{c}"))
    sizes = a.groupBy("g", "a").count().withColumnRenamed("count", "ka").join(b.groupBy("g", "b").count().withColumnRenamed("count", "kb"), "g").join(total, "g")
    chance = sizes.groupBy("g").agg(F.sum(F.col("ka") * F.col("kb") * F.pow(F.col("a") * F.col("b") / F.col("all"), F.lit(2.0)) / size / F.col("all")).alias("r"))
    out = seen.join(entropy(a, "a"), "g").join(entropy(b, "b"), "g").join(chance, "g")
    mean = (F.col("ha") + F.col("hb")) / 2
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], F.when(mean > 0, F.col("mi") / mean).otherwise(1.0).alias("nmi"), F.when(F.col("r") < 1, (F.col("s") - F.col("r")) / (1 - F.col("r"))).alias("esim"))


def mixing(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per node: degree, edges inside its community, and the share that leaves it."""
    a = members.select(F.col("node_id").alias("src"), F.col("membership").alias("ma"))
    b = members.select(F.col("node_id").alias("dst"), F.col("membership").alias("mb"))
    out = edges.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum((F.col("ma") == F.col("mb")).cast("long")).alias("internal"))
    return out.withColumn("mixing", 1 - F.col("internal") / F.col("degree"))


def inner_outer_density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Means over communities of the densities inside and towards the rest: p_in, p_out."""
    links = block_matrix(edges.select("src", "dst"), members).groupBy("block_a").agg(F.sum(F.when(F.col("block_a") == F.col("block_b"), F.col("weight")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("block_a") != F.col("block_b"), F.col("weight")).otherwise(0)).alias("outside"))
    sizes = members.groupBy(F.col("membership").alias("block_a")).agg(F.count(F.lit(1)).alias("n"))
    total = members.agg(F.count(F.lit(1)).alias("all"))
    x = sizes.join(links, "block_a", "left").na.fill(0.0).crossJoin(F.broadcast(total))
    return x.agg(F.avg(F.when(F.col("n") > 1, F.col("inside") / (F.col("n") * (F.col("n") - 1)))).alias("p_in"), F.avg(F.when(F.col("all") > F.col("n"), F.col("outside") / (F.col("n") * (F.col("all") - F.col("n"))))).alias("p_out"))


def conductance(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per community: cut / min(volume, rest); an empty or full side gives 1."""
    b = block_matrix(edges, members)
    x = b.groupBy(F.col("block_a").alias("membership")).agg(F.sum("weight").alias("volume"), F.sum(F.when(F.col("block_a") != F.col("block_b"), F.col("weight")).otherwise(0.0)).alias("cut"))
    x = x.crossJoin(F.broadcast(b.agg(F.sum("weight").alias("total"))))
    side = F.least(F.col("volume"), F.col("total") - F.col("volume"))
    return x.select("membership", F.when(side > 0, F.col("cut") / side).otherwise(1.0).alias("conductance"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    b = block_matrix(edges, members)
    total = b.agg(F.sum("weight").alias("total"))
    x = b.groupBy("block_a").agg(F.sum("weight").alias("volume"), F.sum(F.when(F.col("block_a") == F.col("block_b"), F.col("weight")).otherwise(0.0)).alias("inside")).crossJoin(F.broadcast(total))
    return x.agg(F.sum(F.col("inside") / F.col("total") - F.pow(F.col("volume") / F.col("total"), F.lit(2.0))).alias("modularity"))


def map_equation(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Two-level code length (bits) of a random walk on an undirected graph under a partition."""
    b = block_matrix(edges, members)
    total = b.agg(F.sum("weight").alias("w"))
    plogp = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    blocks = b.groupBy("block_a").agg(F.sum("weight").alias("volume"), F.sum(F.when(F.col("block_a") != F.col("block_b"), F.col("weight")).otherwise(0.0)).alias("out")).crossJoin(F.broadcast(total))
    q, p = F.col("out") / F.col("w"), F.col("volume") / F.col("w")
    modules = blocks.agg(F.sum(q).alias("q"), F.sum(plogp(q)).alias("ql"), F.sum(plogp(q + p)).alias("qp"))
    nodes = degrees(edges).crossJoin(F.broadcast(total)).agg(F.sum(plogp(F.col("strength") / F.col("w"))).alias("n"))
    return modules.crossJoin(nodes).select((plogp(F.col("q")) - 2 * F.col("ql") - F.col("n") + F.col("qp")).alias("codelength"))


def block_entropy(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Degree-corrected block-model entropy, -1/2 sum e_rs ln(e_rs / (e_r e_s)), less sums over degrees."""
    b = block_matrix(edges, members)
    e = b.groupBy("block_a").agg(F.sum("weight").alias("e"))
    x = b.join(e, "block_a").join(e.select(F.col("block_a").alias("block_b"), F.col("e").alias("e2")), "block_b")
    return x.agg((-0.5 * F.sum(F.col("weight") * F.ln(F.col("weight") / (F.col("e") * F.col("e2"))))).alias("entropy"))


def integer_histogram(table: DataFrame, column: str) -> DataFrame:
    """Relative frequency of each value; the total is over the few distinct values."""
    x = table.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def linear_histogram(table: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts and shares in `bins` equal bins between min - 1e-6 and max + 1e-6."""
    ends = table.agg((F.min(column) - 1e-6).alias("low"), (F.max(column) + 1e-6).alias("high"))
    x = table.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col(column) - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)))
    x = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def log_histogram(table: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Mean value and density in `bins` bins that are equal on a log scale; values of 0 or less are left out."""
    some = table.where(F.col(column) > 0)
    ends = some.agg(F.ln(F.min(column)).alias("low"), F.ln(F.max(column) + 1).alias("high"), F.count(F.lit(1)).alias("all"))
    x = some.crossJoin(F.broadcast(ends)).withColumn("width", (F.col("high") - F.col("low")) / bins)
    x = x.withColumn("bin", F.least(F.floor((F.ln(F.col(column)) - F.col("low")) / F.col("width")), F.lit(bins - 1)))
    x = x.groupBy("bin").agg(F.avg(column).alias("mean_value"), F.count(F.lit(1)).alias("n"), F.first("low").alias("low"), F.first("width").alias("width"), F.first("all").alias("all"))
    left, right = F.exp(F.col("low") + F.col("bin") * F.col("width")), F.exp(F.col("low") + (F.col("bin") + 1) * F.col("width"))
    return x.select("bin", "mean_value", (F.col("n") / F.col("all") / (right - left)).alias("density"))


def moments(table: DataFrame, column: str) -> DataFrame:
    """(mean, variance) of a column, variances under 1e-7 as 0."""
    return table.agg(F.avg(column).alias("mean"), _clamped(F.var_pop(column)).alias("variance"))


def law_moments(law: DataFrame, value: str = "value", share: str = "share") -> DataFrame:
    """(mean, variance) of a discrete law (value, share), variances under 1e-7 as 0."""
    v, p = F.col(value).cast("double"), F.col(share)
    x = law.agg(F.sum(p * v).alias("mean"), F.sum(p * v * v).alias("square"))
    return x.select("mean", _clamped(F.col("square") - F.col("mean") * F.col("mean")).alias("variance"))


def _clamped(x):
    return F.when(x < 1e-7, 0.0).otherwise(x)


def cumulative(law: DataFrame, value: str = "value", share: str = "share") -> DataFrame:
    """(value, cdf): running sums of a discrete law, a table of a parameter's size."""
    return law.select(value, F.sum(share).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("cdf"))


def distribution(cdf: DataFrame, value: str = "value", column: str = "cdf") -> DataFrame:
    """(value, share): the law of a running sum."""
    return cdf.select(value, (F.col(column) - F.coalesce(F.lag(column).over(Window.orderBy(value)), F.lit(0.0))).alias("share"))


def group_labels(table: DataFrame) -> DataFrame:
    """label variants in long form: (node_id, variant, group_id) of columns named by key~value pairs."""
    names = [c for c in table.columns if c != "node_id"]
    return table.unpivot(["node_id"], names, "variant", "group_id")


#: Scores of a partition by name: functions of a table of labels, as partition_scores.
SCORES = {"nmi": lambda labels, **o: partition_scores(labels, **o).drop("esim"), "esim": lambda labels, **o: partition_scores(labels, **o).drop("nmi")}
