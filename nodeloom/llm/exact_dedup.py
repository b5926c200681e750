"""Exact dedup: 128-bit content hash groups, smallest id kept, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm._shared import written

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def hash128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the normalised text. Groups are counted from (id, hash) alone with a
    map-side combine, so a group of a third of all rows is one partial row per task. Texts travel only for the
    byte comparison: each row of a group of two or more meets the text of its group's smallest id in a join on the
    hash. What is joined by hash is a table on both sides, which the skew join can split. Rows whose bytes differ from it (hash collisions) are grouped again by
    (hash, text), so a collision never drops a row.

    Defined cases: null text equals empty text; an empty table gives an empty result; a repeated row counts in
    group_size and both rows carry the same decision; a null doc_id is never preferred over another id (it is
    kept only when all ids of its group are null, with keep_id null); other columns are ignored.
    """
    norm = normalised(F.col(text))
    base = docs.select(F.col(doc_id).alias("i"), norm.alias("x")).withColumn("h", content_hash(F.col("x")))
    digests = written(base.select("i", "h", F.sha2("x", 256).alias("s")), "digests")
    groups = written(digests.groupBy("h").agg(F.min("i").alias("k"), F.count(F.lit(1)).alias("n")), "groups")
    single = digests.join(groups.where("n = 1"), "h").select("i", F.col("i").alias("k"), "n", "s")

    many = written(base.join(groups.where("n > 1").select("h", "k"), "h").select("i", "h", "x", "k"), "copies")
    first = written(many.where("i <=> k").groupBy("h").agg(F.min("x").alias("y")), "first")
    told = many.join(first, "h").select("i", "h", F.when(F.col("x") != F.col("y"), F.col("x")).alias("other"), F.sha2("x", 256).alias("s"))
    told = written(told, "compared")  # other: the text of a row that only shares the hash
    exact = told.groupBy("h", "other").agg(F.min("i").alias("k"), F.count(F.lit(1)).alias("n"))
    exact = written(exact.withColumnRenamed("h", "h2").withColumnRenamed("other", "other2"), "exact")
    multiple = told.join(exact, F.expr("h = h2 AND other <=> other2")).select("i", "k", "n", "s")

    out = single.union(multiple)
    return out.select(F.col("i").alias("doc_id"), F.col("k").alias("keep_id"), F.col("n").alias("group_size"), F.expr("i <=> k").alias("kept"), F.col("s").alias("text_sha256"))
