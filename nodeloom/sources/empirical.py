"""Networks with known groups from files: one recipe per data set, one loader, and the conditions that results meet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.structure import components, contiguous, is_symmetric, largest_component, ranked, symmetrize
from nodeloom.storage import written


@dataclass(frozen=True)
class Recipe:
    """How a data set's two files are read. names: columns of files without a header; ids: the node file's id column, or
    None where a line's number is the node; offset: what ids count from; rank: ids are arbitrary, and ranked."""

    edge_names: tuple[str, ...] = ()
    node_names: tuple[str, ...] = ()
    ends: tuple[str, str] = ("source", "target")
    label: str = "value"
    ids: str | None = "index"
    sep: str = ","
    comment: str | None = None
    offset: int = 0
    rank: bool = False
    last: bool = field(default=False)  # the label is the last column, whatever their number


RECIPES = {
    "airport": Recipe(ends=("src", "trg"), label="region", ids=None),
    "polblog": Recipe(node_names=("class",), label="class", ids=None, offset=1),
    "football": Recipe(edge_names=("source", "target"), node_names=("index", "label", "value", "_pos"), comment="#"),
    "polbooks": Recipe(edge_names=("source", "target"), node_names=("index", "label", "value", "_pos"), comment="#"),
    "highschool": Recipe(edge_names=("source", "target", "time"), node_names=("index", "id", "class", "gender", "_pos"), label="class", comment="#"),
    "cora": Recipe(edge_names=("src", "trg"), node_names=("node_id",), ends=("src", "trg"), ids="node_id", sep="\t", rank=True, last=True),
    "karate": Recipe(edge_names=("source", "target"), node_names=("index",), comment="#", last=True),
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one text file with their numbers from 0, whatever tasks read it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return ranked(written(lines, "lines"), ["block", "at"], "n").select("n", "value")


def _columns(spark: SparkSession, path: str, names: tuple[str, ...], r: Recipe) -> DataFrame:
    """n (the line's number among those with data), and the named columns as trimmed text; _last is the last column."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    if r.comment:
        lines = lines.where(~F.ltrim("value").startswith(r.comment))
    cells = F.split("value", r.sep)
    if not names:
        first = lines.orderBy("n").first()
        names = tuple(x.strip().strip('"') for x in (first["value"] if first else "").split(r.sep))
        lines = lines.where(F.col("n") > (first["n"] if first else 0))
    out = ranked(lines, ["n"], "line").withColumn("cells", F.transform(cells, lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))))
    return out.select(F.col("line").alias("n"), *[F.try_element_at("cells", F.lit(k + 1)).alias(c) for k, c in enumerate(names)], F.try_element_at("cells", F.lit(-1)).alias("_last"))


def load_network(spark: SparkSession, name: str, edge_path: str, node_path: str) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst, weight), members(node_id, membership)) of a data set's files: symmetric, weight 1, the largest
    component alone, nodes and labels numbered from 0 in their order; checked.

    Repeated contacts are one edge; lines without two ids are skipped.
    """
    if name not in RECIPES:
        raise KeyError(f"no network {name}; there are {sorted(RECIPES)}")
    r = RECIPES[name]
    nodes = _columns(spark, node_path, r.node_names, r)
    key = F.col("n") if r.ids is None else F.col(r.ids).try_cast("long")
    nodes = nodes.select(key.alias("id"), F.col("_last" if r.last else r.label).alias("label")).where("id IS NOT NULL")
    a, b = (F.col(c).try_cast("long") - r.offset for c in r.ends)
    edges = _columns(spark, edge_path, r.edge_names, r).select(a.alias("src"), b.alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    known = nodes.select("id")
    edges = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = written(symmetrize(edges.where("src <> dst")), "edges")
    new = written(largest_component(edges), "component")
    edges = edges.join(new.select(F.col("node_id").alias("src"), F.col("new_id").alias("a")), "src").join(new.select(F.col("node_id").alias("dst"), F.col("new_id").alias("b")), "dst")
    edges = written(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")), "edges")
    labels = contiguous(nodes.join(new, F.col("id") == F.col("node_id")).select(F.col("new_id").alias("node_id"), "label"), "label", "membership")
    members = written(labels.select("node_id", "membership"), "members")
    check_network(edges, members)
    return edges, members


def check_network(edges: DataFrame, members: DataFrame) -> None:
    """ValueError unless the network is one symmetric component and each node has one label."""
    nodes = edges.select(F.col("src").alias("node_id")).distinct()
    if not is_symmetric(edges):
        raise ValueError("the network is not symmetric")
    if components(edges).select("component").distinct().count() > 1:
        raise ValueError("the network has more than one component")
    n, labelled = nodes.count(), nodes.join(members, "node_id").count()
    if n != labelled or n != members.count():
        raise ValueError(f"{n} nodes have {members.count()} labels")
