"""Files there and back, benchmark graphs' degrees, and small helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.functions import scalars
from nodeloom.operators import blockmodel, clustering, lfr, scores, structure
from nodeloom.plans import results
from nodeloom.sources import empirical, graphs, writers

TRIANGLES = [(0, 1), (1, 2), (0, 2), (2, 3)]


def both(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, weight double")


def text(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_loaders(spark, tmp_path):
    (tmp_path / "e").write_text("# source, target\n0, 1\n1, 2\n0,1\n2, 0\n4, 5\n")
    (tmp_path / "n").write_text("# index, label, value, _pos\n" + "".join(f"{k}, t{k}, {k % 2}, x\n" for k in range(6)))
    edges, members = empirical.load_network(spark, "football", str(tmp_path / "e"), str(tmp_path / "n"))
    assert edges.count() == 6 and sorted(map(tuple, members.collect())) == [(0, 0), (1, 1), (2, 0)]
    (tmp_path / "e2").write_text("70\t10\n10\t31\n31\t99999\n")
    (tmp_path / "n2").write_text("31\t0\t1\tNeural\n10\t0\t0\tRules\n70\t1\t1\tNeural\n")
    edges, members = empirical.load_network(spark, "cora", str(tmp_path / "e2"), str(tmp_path / "n2"))
    assert edges.count() == 4 and sorted(map(tuple, members.collect())) == [(0, 1), (1, 0), (2, 0)]
    (tmp_path / "e3").write_text("src,trg\n0,1\n1,2\n")
    (tmp_path / "n3").write_text("code,region\na,EU\nb,US\nc,EU\n")
    assert sorted(map(tuple, empirical.load_network(spark, "airport", str(tmp_path / "e3"), str(tmp_path / "n3"))[1].collect())) == [(0, 0), (1, 1), (2, 0)]
    with pytest.raises(KeyError):
        empirical.load_network(spark, "none", "", "")
    with pytest.raises(ValueError):
        empirical.check_network(both(spark, [(0, 1), (2, 3)]), spark.createDataFrame([(k, 0) for k in range(4)], "node_id long, membership long"))
    with pytest.raises(ValueError):
        empirical.check_network(both(spark, [(0, 1)]), spark.createDataFrame([(0, 0)], "node_id long, membership long"))


def test_writers(spark, tmp_path):
    g = both(spark, TRIANGLES)
    groups = spark.createDataFrame([(0, [0.9, 0.1], 0), (1, [0.2, 0.8], 1)], "node_id long, psi array<double>, group_id long")
    writers.write_blocks(groups, -1.5, str(tmp_path / "b"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "b"), header=True, inferSchema=True).collect())) == [(0, 0, -1.5), (1, 1, -1.5)]
    assert [r.top for r in writers.marginal_report(groups).orderBy("node_id").collect()] == [0.9, 0.8]
    writers.write_edge_list(g, str(tmp_path / "l"))
    assert sorted(map(tuple, graphs.read_edge_list(spark, str(tmp_path / "l"), sep=" ").collect())) == sorted(TRIANGLES)
    writers.write_dense(g, 4, str(tmp_path / "d"))
    assert sorted(text(spark, tmp_path / "d")) == sorted(["0 1 1 0", "1 0 1 0", "1 1 0 1", "0 0 1 0"])
    cab = np.array([[3.0, 0.25], [0.25, 2.5]])
    writers.write_affinity(spark, [0.5, 0.5], cab, str(tmp_path / "c"))
    pa, back = writers.read_parameters(spark, str(tmp_path / "c"), 2)
    assert pa == [0.5, 0.5] and (back == cab).all()
    (tmp_path / "c2").write_text("pa_begin\n0.3\npa_end\ncab_begin\n1,2 3\ncab_end\n")
    pa, back = writers.read_parameters(spark, str(tmp_path / "c2"), 2)
    assert pa == [0.3, 0.7] and back.tolist() == [[1, 2], [2, 3]]
    with pytest.raises(ValueError):
        writers.read_parameters(spark, str(tmp_path / "c2"), 3)
    for k in range(2):
        writers.append_summary(spark, {"N": 4, "run": k, "energy": -0.5}, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (2, 1), (3, 1)], "node_id long, membership long")
    writers.write_benchmark(g, members, str(tmp_path / "w"))
    assert sorted(map(tuple, graphs.read_edge_list(spark, str(tmp_path / "w/network.dat"), offset=1).where("src < dst").collect())) == sorted(TRIANGLES)
    assert sorted(text(spark, tmp_path / "w/community.dat")) == ["1\t1", "2\t1", "3\t1 2", "4\t2"]
    writers.write_statistics(lfr.statistics(g, members.where("node_id < 2 OR membership = 1")), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r/size"), sep="\t", header=True).count() == 1


@pytest.mark.parametrize("more", [{}, {"mixing": 0.5, "max_community": None, "min_community": None}, {"overlapping": 40, "mixing": 0.1, "min_community": 30}])
def test_benchmark_graphs_have_the_degrees_and_mixing_asked_for(spark, more):
    p = lfr.Parameters(**({"n": 600, "mean_degree": 10, "max_degree": 40, "mixing": 0.3, "min_community": 20, "max_community": 60} | more))
    edges, members = lfr.generate(spark, p)
    assert edges.where("src = dst").isEmpty() and edges.distinct().count() == edges.count()
    assert abs(edges.count() / 600 / 10 - 1) < 0.02
    inside = structure.mates(edges, members).count()
    assert abs(1 - inside / edges.count() - p.mixing) < 0.02
    low, high = p.sizes()
    sizes = [r["count"] for r in members.groupBy("membership").count().collect()]
    assert min(sizes) >= low - 1 and max(sizes) <= high + 1 and sum(sizes) == 600 + p.overlapping * (p.memberships - 1)
    wanted = {r.node_id: r.degree for r in lfr.degree_sequence(spark, p).collect()}
    got = {r["src"]: r["count"] for r in edges.groupBy("src").count().collect()}
    assert sum(abs(wanted[k] - got.get(k, 0)) for k in wanted) <= 0.01 * sum(wanted.values())
    assert sum(wanted.values()) % 2 == 0


def test_clustering_is_raised_and_degrees_kept():
    rng = np.random.default_rng(0)
    degree = np.full(40, 6)

    def coefficient(edges):
        near = [set() for _ in degree]
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        assert [len(x) for x in near] == degree.tolist()
        return np.mean([sum(len(near[b] & near[a]) for b in near[a]) / 30 for a in range(40)])

    assert coefficient(lfr.simple_graph(degree, rng, clustering=0.6)) > coefficient(lfr.simple_graph(degree, rng)) + 0.15


def test_small_helpers(spark):
    x = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "node_id long, emb array<double>")
    assert [r.emb for r in clustering.fill_missing(x, 2).orderBy("node_id").collect()] == [[1.0, 2.0], [0.0, 0.0]]
    assert set(clustering.variants(x.where("node_id = 0"))) == {(a, b) for a in (False, True) for b in (False, True)}
    g = both(spark, TRIANGLES)
    assert {(r.node_id, r.neighbor, r.common) for r in structure.loosest_neighbor(g).collect()} == {(0, 1, 1), (1, 0, 1), (2, 3, 0), (3, 2, 0)}
    assert structure.is_symmetric(g) and not structure.is_symmetric(g.where("src < dst"))
    blocks = structure.prefix_blocks(spark.createDataFrame([(0, 3), (1, 2)], "membership long, n long")).orderBy("membership").collect()
    assert [(r["first"], r["last"]) for r in blocks] == [(0, 2), (3, 4)]
    assert scores.law_moments(spark.createDataFrame([(2, 1.0)], "value int, share double")).first().variance == 0
    row = spark.range(1).select(scalars.half_down(F.lit(2.5)).alias("a"), scalars.half_down(F.lit(2.51)).alias("b"), scalars.parsed_number(F.lit("1e3")).alias("c"), scalars.parsed_number(F.lit("-0.5")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (2, 3, None, -0.5)
    got = results.expand(spark, "net_n~{n}_mu~{mu}.csv", {"n": [1, 2], "mu": [0.5]})
    assert {r.filename for r in got.collect()} == {"net_n~1_mu~0.5.csv", "net_n~2_mu~0.5.csv"}
    assert results.param_space(spark, results.GRIDS["detection"] | results.GRIDS["clustering"]).count() == 9
    assert set(scores.SCORES) == {"nmi", "esim"} and blockmodel.log_likelihood(1.0, 2, 3, dc=2) == -2.0
    wide = spark.createDataFrame([(0, 1, None)], "node_id long, `normalize~True` long, `normalize~False` long")
    assert {(r.variant, r.group_id) for r in scores.group_labels(wide).collect()} == {("normalize~True", 1), ("normalize~False", None)}


def test_results_files_are_read_once(spark, tmp_path):
    (tmp_path / "score_n~5_name~x.csv").write_text("score,score_type\n0.5,nmi\n")
    one = str(tmp_path / "score_n~5_name~x.csv")
    assert [(r.score, r.n, r.name) for r in results.read_results(spark, [one, one], ["n", "name"]).collect()] == [(0.5, "5", "x")]
