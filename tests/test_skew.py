"""Operators on tables where one key holds most rows: against plain forms, and how their rows are spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import structure
from nodeloom.plans import results


def test_quantiles_by_ranks_match_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=900).round(1).tolist(), "b": rng.normal(size=90).tolist(), "c": [2.0], "d": [1.0, 4.0], "e": [7.0] * 50}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None), (None, 1.0)]
    t = spark.createDataFrame(rows, "name string, score double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.name: r.quantiles for r in results.quantiles(t, ["name"], "score", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, shares).tolist(), abs=1e-12)
    box = {r.name: r for r in results.box_summary(t, ["name"]).collect()}
    for g, vs in groups.items():
        q1, q2, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
        inside = [v for v in vs if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        assert [box[g].q1, box[g].median, box[g].q3, box[g].low, box[g].high] == pytest.approx([q1, q2, q3, min(inside), max(inside)])
    assert results.quantiles(t.limit(0), ["name"], "score", [0.5]).count() == 0


def test_a_group_with_most_rows_lies_in_many_ranges(spark):
    t = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"), (F.col("id") * 7919 % 40_009).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        ranges = t.repartitionByRange("k", "v").withColumn("at", F.spark_partition_id()).where("k = 99").groupBy("at").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) >= 3 and max(r["count"] for r in ranges) < 20_000
    got = {r.k: r.quantiles[0] for r in results.quantiles(t, ["k"], "v", [0.5]).collect()}
    plain = {r.k: r.m for r in t.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert got == plain


def star_and_ring(spark, n):
    ids = spark.range(1, n + 1)
    star = ids.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    ring = ids.select(F.col("id").alias("src"), (F.col("id") % n + 1).alias("dst"))
    return structure.symmetrize(star.union(ring)).cache()


def test_product_in_slices_equals_the_plain_one(spark):
    g = star_and_ring(spark, 60).withColumn("weight", F.col("src") + 2.0 * F.col("dst"))
    m = np.zeros((61, 61))
    for r in g.collect():
        m[r.src, r.dst] = r.weight
    for side in (4, 7, 2_000):
        got = np.zeros((61, 61))
        for r in structure.matmul(g, g, side).collect():
            got[r.src, r.dst] += r.weight
        assert np.allclose(got, m @ m)
    assert structure.matmul(g.limit(0), g).count() == 0


def test_common_neighbours_of_a_star_of_100000(spark):
    n = 100_000
    g = star_and_ring(spark, n)
    got = structure.common_neighbors(g, structure.undirected_once(g).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    by = {(r.hub, r.common): r["count"] for r in got.groupBy((F.col("a") == 0).alias("hub"), "common").count().collect()}
    assert by == {(True, 2): n, (False, 1): n}  # a leaf and the hub share the leaf's two neighbours on the ring; two leaves the hub
    g.unpersist()
