"""Text files of graphs, groups, parameters and reports, by Spark's own writers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DENSE = 20_000  # nodes of a dense matrix file


def write_blocks(groups: DataFrame, energy: float, path: str) -> None:
    """node_id,block,energy with a header, of groups(node_id, group_id)."""
    groups.select("node_id", F.col("group_id").alias("block"), F.lit(energy).alias("energy")).write.mode("overwrite").csv(path, header=True)


def write_edge_list(edges: DataFrame, path: str, sep: str = " ", offset: int = 0) -> None:
    """Each undirected edge once, as two ids."""
    edges.where("src < dst").select(F.col("src") + offset, F.col("dst") + offset).write.mode("overwrite").csv(path, sep=sep)


def write_dense(edges: DataFrame, n: int, path: str) -> None:
    """n lines of n zeros and ones, in node order. For small graphs: a line is one cell."""
    if n > MAX_DENSE:
        raise ValueError(f"a dense file of more than {MAX_DENSE} nodes")
    rows = edges.groupBy("src").agg(F.collect_set("dst").alias("to"))
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: F.when(F.array_contains(F.coalesce("to", F.array().cast("array<bigint>")), k), "1").otherwise("0")), " ")
    edges.sparkSession.range(n).join(rows, F.col("id") == F.col("src"), "left").orderBy("id").select(line.alias("value")).write.mode("overwrite").text(path)


def marginal_report(groups: DataFrame) -> DataFrame:
    """(node_id, psi, group_id, top): marginals with the largest and its group."""
    return groups.select("node_id", "psi", "group_id", F.array_max("psi").alias("top"))


def write_affinity(spark: SparkSession, pa: list[float], cab: np.ndarray, path: str) -> None:
    """Group shares and affinities, four digits each, as read_parameters reads them."""
    lines = ["#Vector_na:", " ".join(f"{v:.4f}" for v in pa), "#Matrix_cab:", *[" ".join(f"{v:.4f}" for v in row) for row in np.asarray(cab)]]
    spark.createDataFrame(list(enumerate(lines)), "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str, q: int) -> tuple[list[float], np.ndarray]:
    """(pa, cab) of a parameter file of q groups: sections that begin with #Vector_na: or pa_begin, and #Matrix_cab: or
    cab_begin, up to the next section or pa_end, cab_end; numbers apart by blanks or commas. pa may leave out the last
    share, cab may be the upper triangle. The file is of the parameters' size."""
    text = spark.read.text(path, wholetext=True).where(F.length(F.trim("value")) > 0).first()
    found: dict[str, list[float]] = {"pa": [], "cab": []}
    section = None
    for word in (text["value"] if text else "").replace(",", " ").split():
        if word in ("#Vector_na:", "pa_begin"):
            section = "pa"
        elif word in ("#Matrix_cab:", "cab_begin"):
            section = "cab"
        elif word in ("pa_end", "cab_end") or word.startswith("#"):
            section = None
        elif section:
            found[section].append(float(word))
    pa, flat = found["pa"], found["cab"]
    if len(pa) == q - 1:
        pa = [*pa, 1 - sum(pa)]
    cab = np.zeros((q, q))
    if len(flat) == q * q:
        cab = np.array(flat).reshape(q, q)
    elif len(flat) == q * (q + 1) // 2:
        cab[np.triu_indices(q)] = flat
        cab = np.maximum(cab, cab.T)
    if len(pa) != q or not (len(flat) in (q * q, q * (q + 1) // 2)):
        raise ValueError(f"the file has {len(found['pa'])} shares and {len(flat)} affinities for {q} groups")
    return pa, cab


def append_summary(spark: SparkSession, row: dict, path: str) -> None:
    """One more row of a run's parameters and results."""
    spark.createDataFrame([row]).select(*row).coalesce(1).write.mode("append").csv(path, header=True)


def write_benchmark(edges: DataFrame, members: DataFrame, path: str) -> None:
    """network.dat (both directions) and community.dat (a node and all of its communities), tab-separated, counted from 1."""
    edges.select(F.col("src") + 1, F.col("dst") + 1).orderBy("src", "dst").write.mode("overwrite").csv(f"{path}/network.dat", sep="\t")
    of = members.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("membership")), lambda m: (m + 1).cast("string")), " ").alias("m"))
    of.orderBy("node_id").select(F.col("node_id") + 1, "m").write.mode("overwrite").csv(f"{path}/community.dat", sep="\t")


def write_statistics(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as tab-separated text with a header."""
    for name, t in tables.items():
        t.orderBy(t.columns[0]).coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", sep="\t", header=True)
