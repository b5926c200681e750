"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm._shared import written

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Per source: source_size, target. sizes has one row per source: s (null allowed), source_size.

    Weights repeat over the sources in code-point order, null last. A target stops at ceiling times its source's
    size; the excess is reshared by weight until none is above. That fixed point is found directly: with sources in
    ascending order of ceiling / weight, those before the first whose fair share fits are at their ceiling. The
    windows here run over one row per source.
    """
    order = Window.orderBy(F.col("s").isNull(), F.col("s"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.lit(ceiling) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("s").isNull(), F.col("s"))
    everything = Window.partitionBy()
    x = x.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    x = x.withColumn("capped_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("open_weight", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("open_weight"))
    x = x.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    x = x.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("w"), F.col("cap")))
    return x.select("s", "source_size", target.alias("target"))


def copies_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, taken.

    Each document of a source is expected target / source_size times. Documents of a source are ordered by size,
    then id; the prefix sums of the expected copies, shifted by one offset in [0, 1) that is drawn from the seed
    and the source's name, emit a copy per integer boundary crossed. Ordering by size makes neighbours alike, so
    the words taken stay within about one long document of the target.

    The prefix sum is two-level: rows are range-partitioned by (source, size, id), ranked inside each range, and
    shifted by the count of the source's rows in the ranges before; a source with a third of all rows is spread
    over many ranges. The only global window runs over one row per (range, source).

    Defined cases: null text has size 0; null source is a source of its own, ordered last; a source without words
    has target 0 and takes nothing; repeated rows are ranked one after the other; an empty table gives an empty
    result; other columns are ignored. Reruns agree.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(doc_id).alias("i"), F.col(source).alias("s"), size.alias("size"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = base.repartitionByRange(n, "s", "size", "i").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    parts = ranged.groupBy("range", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("range", "s", "words", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    sizes = parts.groupBy("s").agg(F.sum("words").alias("source_size"))
    goal = source_targets(sizes, weights, share, ceiling)
    plan = parts.alias("p").join(goal.alias("g"), F.expr("p.s <=> g.s")).select("range", F.col("p.s").alias("ps"), "before", "source_size", "target")

    rank = F.row_number().over(Window.partitionBy("range", "s").orderBy("size", "i"))
    rows = ranged.withColumn("rank", rank).withColumnRenamed("range", "r")
    rows = rows.join(plan, F.expr("r = range AND s <=> ps"))
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("s", F.lit("\0")))), 1, 8), 16, 10).cast("double") / 2**32
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("before") + F.col("rank")
    copies = F.floor(rate * at + offset) - F.floor(rate * (at - 1) + offset)
    return rows.select(F.col("i").alias("doc_id"), F.col("s").alias("source"), "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
