import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.functions import scalars
from nodeloom.operators import blockmodel, lfr, scores, spectral, structure, walks
from nodeloom.plans import results
from nodeloom.sources import graphs


def edges_of(spark, pairs):
    both = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    return spark.createDataFrame(both, "src long, dst long, weight double")


CLIQUES = [(a, b) for o in (0, 5) for a in range(o, o + 5) for b in range(a + 1, o + 5)] + [(4, 5)]


def test_components_and_largest(spark):
    g = edges_of(spark, [(0, 1), (1, 2), (5, 6), (6, 7), (7, 8)])
    got = {r.node_id: r.component for r in structure.components(g).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 7: 5, 8: 5}
    assert {r.node_id: r.new_id for r in structure.largest_component(g).collect()} == {5: 0, 6: 1, 7: 2, 8: 3}


def test_components_of_a_long_path(spark):
    got = structure.components(edges_of(spark, [(k, k + 1) for k in range(60)])).collect()
    assert {r.component for r in got} == {0} and len(got) == 61


def test_triangles_of_k4_and_star(spark):
    k4 = structure.triangles(edges_of(spark, [(a, b) for a in range(4) for b in range(a + 1, 4)])).collect()
    assert all(r.triangles == 3 and r.clustering == 1.0 for r in k4)
    star = structure.triangles(edges_of(spark, [(0, k) for k in range(1, 6)])).collect()
    assert all(r.triangles == 0 and r.clustering == 0.0 for r in star)


def test_transition_rows_sum_to_one(spark):
    g = edges_of(spark, CLIQUES)
    assert all(abs(r.s - 1) < 1e-12 for r in structure.row_normalize(g).groupBy("src").agg(F.sum("weight").alias("s")).collect())
    assert all(r.c == 1.0 for r in structure.transition_cdf(g).groupBy("src").agg(F.max("cdf").alias("c")).collect())


def test_scores_of_equal_and_relabelled_partitions(spark):
    x = spark.createDataFrame([(k, k % 3, (k % 3 + 1) % 3) for k in range(30)], "i long, y_true long, y_pred long")
    r = scores.partition_scores(x).first()
    assert abs(r.nmi - 1) < 1e-9 and abs(r.esim - 1) < 1e-9


def test_modularity_of_two_cliques(spark):
    g = edges_of(spark, CLIQUES)
    m = spark.createDataFrame([(k, k // 5) for k in range(10)], "node_id long, membership long")
    assert scores.modularity(g, m).first()[0] == pytest.approx(2 * (20 / 42 - 0.25))
    assert {round(r.conductance, 6) for r in scores.conductance(g, m).collect()} == {round(1 / 21, 6)}
    assert scores.map_equation(g, m).first()[0] < math.log2(10)


def test_walks_follow_edges(spark):
    g = edges_of(spark, CLIQUES)
    ok = {(a, b) for a, b in CLIQUES} | {(b, a) for a, b in CLIQUES}
    nodes = g.select(F.col("src").alias("node_id")).distinct()
    for options in ({}, {"weighted": True}, {"p": 4.0, "q": 0.5}, {"backtrack": False}):
        rows = walks.random_walks(g, nodes, 2, 6, **options).collect()
        by = {}
        for r in rows:
            by.setdefault(r.walk_id, {})[r.step] = r.node_id
        for w in by.values():
            steps = [w[k] for k in sorted(w)]
            assert all(x in ok for x in zip(steps, steps[1:]))
            if options == {"backtrack": False}:
                assert all(a != c for a, c in zip(steps, steps[2:]))


def test_bp_finds_planted_groups(spark):
    g, members = blockmodel.planted_partition(spark.range(200).withColumnRenamed("id", "node_id"), 2, 10.0, 0.1, 200)
    nodes = members.select("node_id")
    groups, energy = blockmodel.bp_learn(g, nodes, 2, [0.5, 0.5], np.array([[19.0, 1.0], [1.0, 19.0]]), em_steps=1, sweeps=10)
    x = groups.join(members, "node_id")
    assert scores.partition_scores(x, "membership", "group_id").first().esim > 0.5
    assert energy == energy


def test_mean_field_finds_planted_groups(spark):
    g, members = blockmodel.planted_partition(spark.range(200).withColumnRenamed("id", "node_id"), 2, 10.0, 0.1, 200)
    nodes = members.select("node_id").union(spark.createDataFrame([(200,)], "node_id long"))
    cab = np.array([[19.0, 1.0], [1.0, 19.0]])
    groups, energy = blockmodel.mean_field(g, nodes, 2, [0.5, 0.5], cab)
    assert groups.count() == 201
    assert scores.partition_scores(groups.join(members, "node_id"), "membership", "group_id").first().esim > 0.5
    flat = blockmodel.mean_field(g, nodes, 2, [0.5, 0.5], np.full((2, 2), 10.0))[1]
    assert energy < flat


def test_field_is_that_of_its_own_marginals(spark):
    logs = spark.createDataFrame([(0, [0.3, -0.2, 0.1]), (1, [2.0, 0.0, -1.0]), (2, [0.0, 0.0, 0.0])], "node_id long, logs array<double>")
    c = np.array([[3.0, 1.0, 0.5], [1.0, 4.0, 0.2], [0.5, 0.2, 2.0]])
    h = np.array(blockmodel.settled_field(logs, [0.2, 0.3, 0.5], c, 4, [1.0, 1.0, 1.0]))
    rows = [np.exp(np.array(r.logs) - h / 4) for r in logs.collect()] + [np.array([0.2, 0.3, 0.5]) * np.exp(-h / 4)]
    assert np.allclose(sum(r / r.sum() for r in rows) @ c, h, atol=1e-5)


def test_eigenvalues_of_a_complete_graph(spark):
    values, vectors = spectral.eigenpairs(edges_of(spark, [(a, b) for a in range(8) for b in range(a + 1, 8)]), 1)
    assert values[0] == pytest.approx(7.0, abs=1e-6) and vectors.count() == 8


def test_planted_partition_and_lfr(spark):
    edges, members = blockmodel.planted_partition(spark.range(400).withColumnRenamed("id", "node_id"), 4, 12.0, 0.2, 400)
    assert edges.where("src = dst").count() == 0
    assert scores.modularity(edges.withColumn("weight", F.lit(1.0)), members).first()[0] > 0.3
    edges, members = lfr.generate(spark, lfr.Parameters(n=200, mean_degree=8, max_degree=30, mixing=0.2, max_community=60), rounds=2)
    assert edges.exceptAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).isEmpty()
    assert members.count() == 200
    with pytest.raises(ValueError):
        lfr.Parameters(n=10, mean_degree=3, max_degree=20, mixing=0.2)


def test_pairing_round_trip(spark):
    x = spark.range(50).selectExpr("id as a", "id * 3 % 17 as b")
    z = x.withColumn("z", scalars.pairing(F.col("a"), F.col("b")))
    a, b = scalars.unpairing(F.col("z"))
    assert z.where((a != F.col("a")) | (b != F.col("b"))).isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "network.dat").write_text("1\t2\n2\t3\n")
    assert sorted(map(tuple, graphs.read_edge_list(spark, str(tmp_path / "network.dat"), offset=1).collect())) == [(0, 1), (1, 2)]
    nodes = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "node_id long, value long")
    graphs.write_gml(nodes, spark.createDataFrame([(0, 1), (1, 2), (1, 0)], "src long, dst long"), str(tmp_path / "gml"))
    got_nodes, got_edges = graphs.read_gml(spark, str(tmp_path / "gml"))
    assert sorted(map(tuple, got_nodes.collect())) == [(0, 1), (1, 1), (2, 0)]
    assert sorted(map(tuple, got_edges.collect())) == [(0, 1), (1, 2)]


def test_results_layer(spark):
    x = spark.createDataFrame([("a/score_n~5_model_name~x.csv", 1.0), ("a/score_n~6.csv", None)], "filename string, score double")
    got = {r.n: r.name for r in results.decoded(x, ["n", "name"]).collect()}
    assert got == {"5": "x", "6": None}
    assert results.filtered(results.decoded(x, ["n", "name"]), {"name": ["y"]}).count() == 1


def test_silhouette_finds_eight_groups(spark, tmp_path):
    from nodeloom.operators import clustering
    from nodeloom.plans import queries

    rows = [(8 * k + g, g, [float(d == g) + 0.01 * ((k * 7 + d * 3 + g) % 5) for d in range(8)]) for k in range(3) for g in range(8)]
    rows += [(90, 0, None), (91, 0, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.silhouette_best_k(spark, str(tmp_path)).first().k == 8
    few = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "node_id long, emb array<double>")
    assert {r.k for r in clustering.silhouette_by_k(few, restarts=2).collect()} <= {2, 3, 4}
    assert clustering.silhouette_by_k(few.limit(2)).count() == 0


def test_planted_degrees_vary_as_the_law(spark):
    n = 2000
    edges, _ = blockmodel.planted_partition(spark.range(n).withColumnRenamed("id", "node_id"), 4, 10.0, 0.3, n)
    degrees = [r["count"] for r in edges.groupBy("src").count().collect()]
    degrees += [0] * (n - len(degrees))
    mean = sum(degrees) / n
    variance = sum((d - mean) ** 2 for d in degrees) / n
    assert edges.where("src = dst").count() == 0 and edges.distinct().count() == edges.count() and edges.agg({"dst": "max"}).first()[0] < n
    assert abs(mean - 10) < 0.4 and 8.7 < variance < 11.3
    assert 8 <= sum(d <= 3 for d in degrees) <= 40
