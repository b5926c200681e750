"""What steps leave on disk."""

import subprocess
import time

import pytest
from pyspark.sql import functions as F

from nodeloom import storage
from nodeloom.operators import structure
from nodeloom.sources import graphs


def shuffles(spark):
    """Bytes of shuffle files in the executor's folders."""
    tops = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    found = subprocess.run(["find", *tops, "-name", "shuffle_*.data", "-printf", "%s\n"], capture_output=True, text=True).stdout.split()
    return sum(map(int, found))


def test_a_written_table_leaves_no_shuffle_files_and_can_be_forgotten(spark):
    before = shuffles(spark)
    x = spark.range(200_000).select(F.xxhash64("id").alias("x")).repartition(4, "x")
    got = storage.written(x)
    for _ in range(50):
        if shuffles(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffles(spark) <= before and got.count() == 200_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    storage.forgotten(got, None, x)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        got.agg(F.max("x")).collect()
    assert x.count() == 200_000


def test_symmetry_takes_one_exchange_and_counts_odd_entries(spark):
    make = lambda rows: spark.createDataFrame(rows, "src long, dst long, weight double")
    for rows, same in (
        ([], True), ([(1, 1, 5.0)], True), ([(1, 2, 1.0), (2, 1, 1.0)], True), ([(1, 2, 1.0)], False), ([(1, 2, 0.0)], True),
        ([(1, 2, 1.0), (2, 1, 2.0)], False), ([(1, 2, 1.0), (1, 2, 1.0), (2, 1, 1.0)], False), ([(1, 2, 1.0), (2, 1, 1.0), (1, 2, 0.0)], True),
        ([(None, 2, 1.0)], False), ([(None, 2, 1.0), (2, None, 1.0)], True), ([(None, None, 1.0)], True), ([(1, 2, None)], True),
        ([(1, 2, float("nan")), (2, 1, float("nan"))], True),
    ):
        assert structure.is_symmetric(make(rows)) is same, rows
        assert structure.same_entries(make(rows), structure.swapped(make(rows))) is same, rows


def test_pairs_of_parts_are_made_distinct_one_way(spark, tmp_path):
    lines = [(1, 1), (1, 2), (1, 2), (1, 3), (2, 2), (2, 1), (3, 7), (4, None), (4, 9), (None, 8), (None, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    g = graphs.part_graph(spark, str(tmp_path))
    assert sorted(tuple(r) for r in g.collect()) == [(1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 2, 1.0)]
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate"), "pairs are turned round after they are made distinct"
