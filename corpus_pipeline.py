"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

All stages decide by row: a null text is an empty text, rows with a null or a repeated doc_id are never joined with
each other by that id, other columns are carried along, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import _shared, bpe, exact_dedup, language_id, mixing, ngram_join

#: Rows of a table of decisions (numbers of rows, 16 bytes each) up to which it is broadcast; larger ones are joined by exchange.
BROADCAST_ROWS = 1_000_000

#: A document whose letter n-grams are this little like any language is not text.
LEAST_SCORE = 0.2


def _numbered(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as one struct, so that no name of theirs meets one of ours), text, doc_id; number, of each row,
    and order: by doc_id (null first), then md5 of the text, then the number.

    Rows of files, which stages get, are numbered as they are read: task and place in it, the same in every job over the
    same files. What does not come from files is made a table first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = _shared.written(docs, "rows")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "doc_id", F.monotonically_increasing_id().alias("number"))
    return rows.withColumn("order", F.struct("doc_id", F.md5("text").alias("text"), "number"))


def _decided(rows: DataFrame) -> DataFrame:
    """Decisions by row number, as a table; marked for broadcast if they are few, so that texts stay where they lie."""
    rows = _shared.written(rows, "decided")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no known language, go; the others stay as they are.

    Each row is told by its own text, whatever its doc_id: rows with a null or a repeated one stay or go like others.
    A text goes through the task once: the row beside it has the other columns.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    others = [c for c in docs.columns if c.lower() != "text"]
    told = language_id.identify(docs.select(F.struct(*others).alias("row"), "text"), model, doc_id="row", keep_text=True)
    kept = told.where(f"lang_pred <> 'und' AND score >= {LEAST_SCORE}")
    return kept.select(*[F.col("doc_id").getField(c).alias(c) if c in others else F.col("text").alias(c) for c in docs.columns])


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays, that with the smallest doc_id.

    A null doc_id counts as larger than any other. Rows with different texts are never in one set, also if they share
    a doc_id or have none; of rows with equal texts and equal doc_ids the first as they lie stays. What decides are
    ids, digests and row numbers: texts stay where they are.
    """
    rows = _numbered(docs)
    groups = exact_dedup.exact_dedup(rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number").alias("doc_id"), "text"))
    kept = groups.where("kept").select(F.col("doc_id.number").alias("number"))
    return rows.join(_decided(kept), "number", "left_semi").select("row.*")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that with the smallest doc_id.

    A null doc_id counts as larger than any other. Components are those of rows: rows that share a doc_id or have none
    are told apart, and linked by their texts only; of several with the smallest doc_id, that with the least md5 of its text stays.
    """
    rows = _numbered(docs)
    found = ngram_join.ngram_components(rows.select("number", "text"), doc_id="number").select(F.col("doc_id").alias("number"), "component_id")
    order = rows.select("number", F.struct(F.col("doc_id").isNull().alias("none"), "order").alias("o"))
    kept = found.join(order, "number").groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.order.number").alias("number"))
    return rows.join(_decided(kept), "number", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    The mix decides by row: rows with a null doc_id are ranked before the others of their source and size, and rows
    that share a doc_id are ranked one after the other.
    """
    rows = _numbered(docs)
    taken = mixing.copies_of(rows.select("order", "text", "row.source"), doc_id="order").where("copies > 0").select(F.col("doc_id.number").alias("number"), "copies")
    mixed = rows.join(_decided(taken), "number")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, repeats and rows with a null or shared doc_id included."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact), ("ngram_join", drop_near), ("source_mixing", mix_sources), ("bpe", tokenise)]

#: No SQL states the language model's or the tokenizer's results; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
