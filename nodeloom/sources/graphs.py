"""Graphs as DataFrames: from the analytics tables, from files, and synthetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.structure import swapped, symmetrize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that one order holds together, both directions, weight 1. An order has few lines, so pairs stay few; each is
    made distinct once, with its lesser part first, and turned round afterwards."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = lines.alias("a"), lines.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") < F.col("b.l_partkey")))
    once = met.select(F.col("a.l_partkey").alias("u"), F.col("b.l_partkey").alias("v")).distinct()
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return once.select(F.explode(both).alias("e")).select("e.src", "e.dst").withColumn("weight", F.lit(1.0))


def part_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand: membership 0..K-1 in brand order."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_brand")
    from nodeloom.operators.structure import contiguous

    return contiguous(part, "p_brand", "membership").select("node_id", "membership")


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customer nation to supplier nation, weighted by order lines, without loops."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("long").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").cast("long").alias("dst"))
    return lines.join(orders, "o").join(customers, "c").join(suppliers, "s").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")).where("src <> dst")


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation x supplier nation, weighted by order lines, symmetric, without loops."""
    pairs = trade_graph(spark, sf_dir)
    return pairs.union(swapped(pairs).select("src", "dst", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def nation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("membership"))


def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").cast("long").alias("membership"), F.col("embedding").cast("array<double>").alias("emb"))


def event_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in time order, as walks over event types."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("walk_id"), F.col("ts"), F.col("event_id"), F.col("event_type").alias("node_id"))


# ---------------------------------------------------------------- files


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", offset: int = 0, header: bool = False, comment: str = "#") -> DataFrame:
    """src, dst of the first two columns, less offset (1 for files that count from 1)."""
    x = spark.read.csv(path, sep=sep, header=header, comment=comment)
    a, b = x.columns[:2]
    return x.select((F.trim(F.col(f"`{a}`")).cast("long") - offset).alias("src"), (F.trim(F.col(f"`{b}`")).cast("long") - offset).alias("dst"))


def read_communities(spark: SparkSession, path: str, sep: str = "\t", offset: int = 1) -> DataFrame:
    x = spark.read.csv(path, sep=sep)
    return x.select((F.col("_c0").cast("long") - offset).alias("node_id"), (F.col("_c1").cast("long") - offset).alias("membership"))


def densify(edges: DataFrame, nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Arbitrary ids to 0..n-1 in sorted order, on the node table and both ends of the edges."""
    from nodeloom.operators.structure import contiguous

    ids = contiguous(nodes, key, "node_id")
    a = ids.select(F.col(key).alias("src"), F.col("node_id").alias("a"))
    b = ids.select(F.col(key).alias("dst"), F.col("node_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")), ids


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(node_id, value), undirected edges, once each) of GML files with id/value and source/target keys.

    A file is split at its node and edge records by the text reader's separator, so records spread over tasks.
    """
    nodes = spark.read.option("lineSep", "]").text(path)
    number = lambda k: F.regexp_extract("value", rf"\b{k}\s+\"?(-?\d+)", 1).cast("long")
    at_node = nodes.where(F.col("value").rlike(r"node\s*\["))
    at_edge = nodes.where(F.col("value").rlike(r"edge\s*\["))
    value = F.when(F.col("value").rlike(r"\bvalue\s"), number("value"))
    ends = at_edge.select(number("source").alias("s"), number("target").alias("t"))
    edges = ends.select(F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst")).distinct()
    return at_node.select(number("id").alias("node_id"), value.alias("value")), edges


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes(node_id, value), edges(src, dst) as one GML text in the folder path: a graph of records in order."""
    lines = nodes.select(F.lit(1).alias("o"), F.format_string("  node [ id %d value %d ]", "node_id", F.coalesce("value", F.lit(0))).alias("value"))
    lines = lines.union(edges.select(F.lit(2).alias("o"), F.format_string("  edge [ source %d target %d ]", "src", "dst").alias("value")))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "graph ["), (3, "]")], "o int, value string")
    lines.union(ends).orderBy("o").select("value").write.mode("overwrite").text(path)


def read_affinity(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, value) of a matrix file: numbers split by commas or blanks, one row a line, other lines skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[\s\d.eE+,-]+$") & F.col("value").rlike(r"\d")).withColumn("n", F.monotonically_increasing_id())
    return lines.select("n", F.posexplode(F.split(F.trim("value"), r"[,\s]+")).alias("b", "v")).select("n", "b", F.col("v").try_cast("double").alias("value"))


LOADERS = {"part": part_graph, "nation": nation_graph}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A registered network, symmetric and binarised."""
    if name not in LOADERS:
        raise KeyError(f"no network {name}; there are {sorted(LOADERS)}")
    return symmetrize(LOADERS[name](spark, sf_dir))
