"""Registered graph-analytics queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.functions import scalars
from nodeloom.operators import blockmodel, clustering, lfr, scores, skipgram, spectral, structure, walks
from nodeloom.plans import results
from nodeloom.sources import graphs
from nodeloom.sources.graphs import embedding_table, event_walks, nation_graph, nation_members, part_graph, part_members, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GP = "g AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, 1.0::DOUBLE AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"
MP = "m AS (SELECT p_partkey AS node_id, dense_rank() OVER (ORDER BY p_brand) - 1 AS membership FROM part)"
GN = """one AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
g AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM one UNION ALL SELECT dst, src, weight FROM one) x GROUP BY 1, 2)"""
MN = "m AS (SELECT CAST(n_nationkey AS BIGINT) AS node_id, CAST(n_regionkey AS BIGINT) AS membership FROM nation)"
EMB = "emb AS (SELECT vec_id AS node_id, CAST(label AS BIGINT) AS membership, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
LONG = EMB + ", long AS (SELECT node_id, membership, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS pos FROM emb)"
CENT = LONG + ", cl AS (SELECT membership AS c, pos, sum(v) AS v FROM long GROUP BY 1, 2), cent AS (SELECT c, list(v ORDER BY pos) AS ce FROM cl GROUP BY c)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def u_sql(*parts: str) -> str:
    return "(CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


# ---------------------------------------------------------------- embeddings and nearest centroids

SCORES_SQL = """n AS (SELECT t, p, CAST(count(*) AS DOUBLE) AS n FROM labels WHERE p IS NOT NULL GROUP BY 1, 2),
a AS (SELECT t, sum(n) AS a FROM n GROUP BY 1), b AS (SELECT p, sum(n) AS b FROM n GROUP BY 1), al AS (SELECT sum(n) AS al FROM n),
s AS (SELECT sum(n * n / greatest(a, b) / al) AS s, sum(n / al * ln(n * al / (a * b))) AS mi FROM n JOIN a USING (t) JOIN b USING (p), al),
ha AS (SELECT -sum(a / al * ln(a / al)) AS ha FROM a, al), hb AS (SELECT -sum(b / al * ln(b / al)) AS hb FROM b, al),
r AS (SELECT sum(power(a * b / al, 2) / greatest(a, b) / al) AS r FROM a, b, al)
SELECT round(mi / ((ha + hb) / 2), 6) AS nmi, round((s - r) / (1 - r), 6) AS esim FROM s, ha, hb, r"""


def _scored(spark: SparkSession, sf_dir: str, metric: str, normal: bool = False) -> DataFrame:
    x = embedding_table(spark, sf_dir)
    found = clustering.nearest_centroid(clustering.normalize_columns(x) if normal else x, metric=metric)
    got = scores.partition_scores(found, "membership", "found")
    return got.select(F.round("nmi", 6).alias("nmi"), F.round("esim", 6).alias("esim"))


def _nearest_sql(similarity: str, head: str = CENT) -> str:
    return f"WITH {head}, labels AS (SELECT membership AS t, arg_max(c, ({similarity}, -c)) AS p FROM emb, cent GROUP BY node_id, membership), {SCORES_SQL}"


COSINE = "list_dot_product(e, ce) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(ce, ce))"
NORMED = LONG + """, norms AS (SELECT pos, greatest(sqrt(sum(v * v)), 1e-32) AS n FROM long GROUP BY pos),
lz AS (SELECT node_id, membership, long.pos, v / n AS v FROM long JOIN norms USING (pos)),
emb2 AS (SELECT node_id, membership, list(v ORDER BY pos) AS e FROM lz GROUP BY 1, 2),
cl AS (SELECT membership AS c, pos, sum(v) AS v FROM lz GROUP BY 1, 2), cent AS (SELECT c, list(v ORDER BY pos) AS ce FROM cl GROUP BY c)"""


@query(_nearest_sql(COSINE))
def voronoi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "cosine")


@query(_nearest_sql(COSINE, NORMED).replace("FROM emb, cent", "FROM emb2, cent"))
def voronoi_scores_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "cosine", normal=True)


@query(_nearest_sql("list_dot_product(e, ce)"))
def voronoi_dotsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "dotsim")


@query(_nearest_sql("-(list_dot_product(e, e) - 2 * list_dot_product(e, ce) + list_dot_product(ce, ce))"))
def voronoi_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "euclidean")


@query(f"WITH {LONG} SELECT CAST(pos AS BIGINT) AS pos, round(sqrt(sum(v * v)), 6) AS norm FROM long GROUP BY 1")
def column_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.column_norms(embedding_table(spark, sf_dir)).select(F.col("pos").cast("long").alias("pos"), F.round("norm", 6).alias("norm"))


@query(f"""WITH {LONG}, n AS (SELECT pos, sqrt(sum(v * v)) AS norm FROM long GROUP BY pos), t AS (SELECT max(norm) AS top, arg_max(pos, (norm, -pos)) AS lead FROM n),
k AS (SELECT pos FROM n, t WHERE norm >= sqrt(top) AND pos <> lead) SELECT CAST(pos AS BIGINT) AS pos FROM k UNION ALL SELECT CAST(lead AS BIGINT) FROM t WHERE NOT EXISTS (SELECT 1 FROM k)""")
def spectral_dim_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dim_threshold(embedding_table(spark, sf_dir)).select(F.col("pos").cast("long").alias("pos"))


@query(f"WITH {LONG}, n AS (SELECT pos, greatest(sqrt(sum(v * v)), 1e-32) AS n FROM long GROUP BY pos) SELECT node_id, round(sum(v / n), 6) AS total FROM long JOIN n USING (pos) GROUP BY node_id")
def col_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = clustering.normalize_columns(embedding_table(spark, sf_dir))
    return x.select("node_id", F.round(F.aggregate("emb", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(f"WITH {EMB} SELECT node_id, round(list_sum(list_slice(e, 1, 9)), 6) AS total FROM emb")
def slice_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first K - 1 columns, K = 10 labels."""
    x = embedding_table(spark, sf_dir)
    return x.select("node_id", F.round(F.aggregate(F.slice("emb", 1, 9), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(CENT.join(("WITH ", ", labels AS (SELECT membership AS t, arg_max(c, (" + COSINE + ", -c)) AS p FROM emb, cent GROUP BY node_id, membership) SELECT t, p, count(*) AS n FROM labels GROUP BY 1, 2")))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.confusion(clustering.nearest_centroid(embedding_table(spark, sf_dir)), "membership", "found")


@query(None)
def kmeans_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = embedding_table(spark, sf_dir)
    k = x.agg(F.max("membership") + 1).first()[0]
    return scores.partition_scores(clustering.kmeans(x, k).join(x.select("node_id", "membership"), "node_id"), "membership", "group_id")


@query(None)
def silhouette_best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.silhouette_by_k(embedding_table(spark, sf_dir))
    return found.agg(F.coalesce(F.max_by("k", F.struct("silhouette", -F.col("k"))), F.lit(1)).alias("k"), F.max("silhouette").alias("silhouette"))


def _lloyd_sql(rounds: int) -> str:
    out = f"WITH {LONG}, c0 AS (SELECT membership AS c, list(v ORDER BY pos) AS ce FROM (SELECT membership, pos, avg(v) AS v FROM long GROUP BY 1, 2) x GROUP BY 1)"
    for k in range(rounds + 1):
        out += f", l{k} AS (SELECT node_id, arg_min(c, (list_dot_product(e, e) - 2 * list_dot_product(e, ce) + list_dot_product(ce, ce), c)) AS group_id FROM emb, c{k} GROUP BY node_id)"
        out += f", c{k + 1} AS (SELECT c, list(v ORDER BY pos) AS ce FROM (SELECT group_id AS c, pos, avg(v) AS v FROM long JOIN l{k} USING (node_id) GROUP BY 1, 2) x GROUP BY 1)"
    return out + f" SELECT group_id, count(*) AS n FROM l{rounds} GROUP BY 1"


@query(_lloyd_sql(2))
def kmeans_lloyd_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = embedding_table(spark, sf_dir)
    seeds = clustering.centroids(x, "membership", "mean").withColumnRenamed("centroid", "emb")
    return clustering.lloyd(x, seeds, 2).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- graph structure


@query(f"WITH {GP} SELECT count(*) AS n_edges, count(DISTINCT src) AS n_nodes, CAST(sum(CASE WHEN src < dst THEN 1 ELSE 0 END) AS BIGINT) AS n_once FROM g")
def edges_symmetrize_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = structure.symmetrize(structure.undirected_once(part_graph(spark, sf_dir)))
    return x.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_nodes"), F.sum((F.col("src") < F.col("dst")).cast("long")).alias("n_once"))


@query(f"WITH {GP} SELECT src AS node_id, count(*) AS degree, sum(weight) AS strength FROM g GROUP BY 1")
def degree_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.degrees(part_graph(spark, sf_dir))


@query("SELECT dense_rank() OVER (ORDER BY p_brand) - 1 AS membership, count(*) AS n FROM part GROUP BY p_brand")
def contiguous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_members(spark, sf_dir).groupBy("membership").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS component, count(*) + 1 AS n FROM orders GROUP BY 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders: a forest of stars. Orders are numbered after all customers."""
    orders = table(spark, sf_dir, "orders")
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("last"))
    edges = orders.crossJoin(F.broadcast(last)).select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + F.col("last") + 1).alias("dst"))
    return structure.components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT arg_max(o_custkey, (n, -o_custkey)) AS k FROM c), l AS (SELECT max(c_custkey) AS last FROM customer)
SELECT o_orderkey + last + 1 AS node_id, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS new_id FROM orders, t, l WHERE o_custkey = k UNION ALL SELECT k, 0 FROM t""")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("last"))
    edges = orders.crossJoin(F.broadcast(last)).select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + F.col("last") + 1).alias("dst"))
    return structure.largest_component(edges)


@query(f"WITH {GN}, t AS (SELECT sum(weight) AS t FROM g) SELECT src AS node_id, round(sum(weight) / max(t), 8) AS pi FROM g, t GROUP BY 1")
def stationary_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    total = g.agg(F.sum("weight").alias("t"))
    return structure.degrees(g).crossJoin(F.broadcast(total)).select("node_id", F.round(F.col("strength") / F.col("t"), 8).alias("pi"))


@query(f"WITH {GN} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 8) AS weight FROM g")
def row_normalize_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.row_normalize(nation_graph(spark, sf_dir)).withColumn("weight", F.round("weight", 8))


@query(f"WITH {GN} SELECT src, dst, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY src)), 8) AS weight FROM g")
def row_normalize_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.row_normalize(nation_graph(spark, sf_dir), "norm").withColumn("weight", F.round("weight", 8))


@query(f"WITH {GN} SELECT src, dst, CASE WHEN lead(dst) OVER w IS NULL THEN 1.0 ELSE round(sum(weight) OVER w / sum(weight) OVER (PARTITION BY src), 8) END AS cdf FROM g WINDOW w AS (PARTITION BY src ORDER BY dst)")
def transition_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.transition_cdf(nation_graph(spark, sf_dir)).withColumn("cdf", F.round("cdf", 8))


@query(f"WITH {GP}, {MP} SELECT a.membership AS block_a, b.membership AS block_b, sum(weight) AS weight FROM g JOIN m a ON src = a.node_id JOIN m b ON dst = b.node_id GROUP BY 1, 2")
def block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.block_matrix(part_graph(spark, sf_dir), part_members(spark, sf_dir))


@query(f"""WITH {GP}, {MP}, s AS (SELECT membership, count(*) AS n FROM m GROUP BY 1), t AS (SELECT count(*) AS n FROM m),
b AS (SELECT a.membership AS x, b.membership AS y, sum(weight) AS w FROM g JOIN m a ON src = a.node_id JOIN m b ON dst = b.node_id GROUP BY 1, 2)
SELECT p.membership AS block_a, q.membership AS block_b, round(greatest(t.n * coalesce(w, 0) / (p.n * q.n), 1), 6) AS cab FROM t, s p, s q LEFT JOIN b ON b.x = p.membership AND b.y = q.membership""")
def block_affinity_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmodel.affinity_prior(part_graph(spark, sf_dir), part_members(spark, sf_dir)).withColumn("cab", F.round("cab", 6))


@query(f"WITH {GN} SELECT src AS node_id, sum(weight * dst) AS value FROM g GROUP BY 1")
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.matvec(nation_graph(spark, sf_dir), nation_members(spark, sf_dir).select("node_id", F.col("node_id").cast("double").alias("value")))


_POWERS = ", p1 AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM g)" + "".join(f", p{k} AS (SELECT a.src, b.dst, sum(a.weight * b.weight) AS weight FROM p{k - 1} a JOIN p1 b ON a.dst = b.src GROUP BY 1, 2)" for k in (2, 3))
_SUM = ", ps AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) x GROUP BY 1, 2)"


@query(f"WITH {GN}{_POWERS}{_SUM} SELECT src, dst, round(weight, 8) AS weight FROM ps")
def matrix_power_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.power_sum(structure.row_normalize(nation_graph(spark, sf_dir)), 3).withColumn("weight", F.round("weight", 8))


@query(f"WITH {GN}{_POWERS}{_SUM}, t AS (SELECT sum(weight) AS t FROM g), pi AS (SELECT src AS dst, sum(weight) / max(t) AS pi FROM g, t GROUP BY 1) SELECT src, dst, round(ln(greatest(weight / 3 / pi, 1e-12)), 6) AS pmi FROM ps JOIN pi USING (dst)")
def deepwalk_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.walk_pmi(nation_graph(spark, sf_dir), 3).withColumn("pmi", F.round("pmi", 6))


def _power_sql(rounds: int) -> str:
    out = f"WITH {GN}, d AS (SELECT src AS i, sum(weight) AS d FROM g GROUP BY 1), t AS (SELECT sum(d) AS t FROM d), v0 AS (SELECT i, (i % 7) + 1.0 AS v FROM d)"
    for k in range(rounds):
        out += f""", a{k} AS (SELECT src AS i, sum(weight * v) AS v FROM g JOIN v{k} ON dst = i GROUP BY 1), dot{k} AS (SELECT sum(d * v) AS dot FROM d JOIN v{k} USING (i)),
r{k} AS (SELECT i, v / t - d * dot / (t * t) AS v FROM a{k} JOIN d USING (i), t, dot{k}), n{k} AS (SELECT sqrt(sum(v * v)) AS n FROM r{k}), v{k + 1} AS (SELECT i, v / n AS v FROM r{k}, n{k})"""
    return out + f" SELECT i AS node_id, round(v, 6) AS value FROM v{rounds}"


@query(_power_sql(3))
def modularity_power_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = structure.modularity_vector(nation_graph(spark, sf_dir), 3, F.col("node_id") % 7 + 1.0)
    return v.withColumn("value", F.round("value", 6))


_TRI = """o AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g), dg AS (SELECT src AS node_id, count(*) AS degree FROM g GROUP BY 1),
tri AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM o x JOIN o y ON x.b = y.a JOIN o z ON z.a = x.a AND z.b = y.b),
t AS (SELECT node_id, count(*) AS triangles FROM (SELECT i AS node_id FROM tri UNION ALL SELECT j FROM tri UNION ALL SELECT k FROM tri) x GROUP BY 1)"""


@query(f"WITH {GN}, {_TRI} SELECT node_id, coalesce(triangles, 0) AS triangles, degree, round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2.0) ELSE 0 END, 8) AS clustering FROM dg LEFT JOIN t USING (node_id)")
def local_clustering_coeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.triangles(nation_graph(spark, sf_dir)).withColumn("clustering", F.round("clustering", 8))


@query(f"WITH {GN} SELECT a.src AS a, b.src AS b, count(*) AS common FROM g a JOIN g b ON a.dst = b.dst JOIN g e ON e.src = a.src AND e.dst = b.src WHERE a.src < b.src GROUP BY 1, 2")
def common_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    return structure.common_neighbors(g, structure.undirected_once(g).select(F.col("src").alias("a"), F.col("dst").alias("b"))).where("common > 0")


def _mates(same: bool) -> str:
    return f"WITH {GP}, {MP} SELECT src, count(*) AS n FROM g JOIN m a ON src = a.node_id JOIN m b ON dst = b.node_id WHERE a.membership {'=' if same else '<>'} b.membership GROUP BY 1"


@query(_mates(True))
def mate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.mates(part_graph(spark, sf_dir), part_members(spark, sf_dir)).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query(_mates(False))
def non_mate_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.mates(part_graph(spark, sf_dir), part_members(spark, sf_dir), same=False).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- partition on a graph


@query(f"WITH {GP}, {MP} SELECT src AS node_id, count(*) AS degree, CAST(sum(CASE WHEN a.membership = b.membership THEN 1 ELSE 0 END) AS BIGINT) AS internal, round(1 - sum(CASE WHEN a.membership = b.membership THEN 1.0 ELSE 0.0 END) / count(*), 8) AS mixing FROM g JOIN m a ON src = a.node_id JOIN m b ON dst = b.node_id GROUP BY 1")
def mixing_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.mixing(part_graph(spark, sf_dir), part_members(spark, sf_dir)).withColumn("mixing", F.round("mixing", 8))


_BLOCKS = "b AS (SELECT a.membership AS x, b.membership AS y, sum(weight) AS w FROM g JOIN m a ON src = a.node_id JOIN m b ON dst = b.node_id GROUP BY 1, 2), v AS (SELECT x, sum(w) AS vol, sum(CASE WHEN x = y THEN w ELSE 0 END) AS ins FROM b GROUP BY 1), tt AS (SELECT sum(w) AS t FROM b)"


@query(f"WITH {GP}, {MP}, {_BLOCKS}, s AS (SELECT membership AS x, count(*) AS n FROM m GROUP BY 1), al AS (SELECT count(*) AS al FROM m) SELECT round(avg(ins / (n * (n - 1))), 8) AS p_in, round(avg((vol - ins) / (n * (al - n))), 8) AS p_out FROM v JOIN s USING (x), al")
def p_in_p_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scores.inner_outer_density(part_graph(spark, sf_dir), part_members(spark, sf_dir))
    return x.select(F.round("p_in", 8).alias("p_in"), F.round("p_out", 8).alias("p_out"))


@query(f"WITH {GP}, {MP}, {_BLOCKS} SELECT x AS membership, round(CASE WHEN least(vol, t - vol) > 0 THEN (vol - ins) / least(vol, t - vol) ELSE 1 END, 8) AS conductance FROM v, tt")
def conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.conductance(part_graph(spark, sf_dir), part_members(spark, sf_dir)).withColumn("conductance", F.round("conductance", 8))


@query(f"WITH {GN}, {MN}, {_BLOCKS} SELECT round(sum(ins / t - power(vol / t, 2)), 8) AS modularity FROM v, tt")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.modularity(nation_graph(spark, sf_dir), nation_members(spark, sf_dir)).select(F.round("modularity", 8).alias("modularity"))


@query(f"""WITH {GN}, {MN}, {_BLOCKS}, q AS (SELECT (vol - ins) / t AS q, vol / t AS p FROM v, tt), nd AS (SELECT sum(weight) / max(t) AS p FROM g, tt GROUP BY src)
SELECT round((SELECT CASE WHEN sum(q) > 0 THEN sum(q) * log2(sum(q)) ELSE 0 END - 2 * sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) + sum((q + p) * log2(q + p)) FROM q) - (SELECT sum(p * log2(p)) FROM nd), 6) AS codelength""")
def map_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.map_equation(nation_graph(spark, sf_dir), nation_members(spark, sf_dir)).select(F.round("codelength", 6).alias("codelength"))


@query(f"WITH {GP}, {MP}, {_BLOCKS} SELECT round(-0.5 * sum(w * ln(w / (p.vol * q.vol))), 2) AS entropy FROM b JOIN v p ON b.x = p.x JOIN v q ON b.y = q.x")
def sbm_description_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.block_entropy(part_graph(spark, sf_dir), part_members(spark, sf_dir)).select(F.round("entropy", 2).alias("entropy"))


_DEG = f"WITH {GP}, d AS (SELECT src, count(*) AS k FROM g GROUP BY 1)"


@query(_DEG + " SELECT k AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM d GROUP BY 1")
def degree_hist_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.integer_histogram(structure.degrees(part_graph(spark, sf_dir)), "degree").withColumn("share", F.round("share", 8))


@query(_DEG + ", e AS (SELECT min(k) - 1e-6 AS lo, max(k) + 1e-6 AS hi FROM d), x AS (SELECT least(floor((k - lo) / ((hi - lo) / 20)), 19) AS bin FROM d, e) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM x GROUP BY 1")
def degree_hist_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.linear_histogram(structure.degrees(part_graph(spark, sf_dir)), "degree").withColumn("share", F.round("share", 8))


@query(_DEG + ", e AS (SELECT ln(min(k)) AS lo, ln(max(k) + 1) AS hi, count(*) AS al FROM d), x AS (SELECT k, al, lo, (hi - lo) / 10 AS w, least(floor((ln(k) - lo) / ((hi - lo) / 10)), 9) AS bin FROM d, e) SELECT CAST(bin AS BIGINT) AS bin, round(avg(k), 6) AS mean_value, round(count(*) / max(al) / (exp(max(lo) + (bin + 1) * max(w)) - exp(max(lo) + bin * max(w))), 8) AS density FROM x GROUP BY bin")
def degree_hist_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scores.log_histogram(structure.degrees(part_graph(spark, sf_dir)), "degree")
    return x.select("bin", F.round("mean_value", 6).alias("mean_value"), F.round("density", 8).alias("density"))


# ---------------------------------------------------------------- walks


@query("""WITH w AS (SELECT user_id, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
p AS (SELECT a.x AS a, b.x AS b FROM w a JOIN w b ON a.user_id = b.user_id AND b.r BETWEEN a.r + 1 AND a.r + 3), s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)
SELECT a AS center, b AS context, count(*) AS n FROM s GROUP BY 1, 2""")
def walk_context_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = event_walks(spark, sf_dir).withColumn("o", F.struct("ts", "event_id"))
    return walks.context_pairs(x, 3, order="o")


def _walk_sql(steps: int, weighted: bool, graph: str) -> str:
    out = f"WITH {graph}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS d, CASE WHEN lead(dst) OVER (PARTITION BY src ORDER BY dst) IS NULL THEN 1.0 ELSE sum(weight / tot) OVER (PARTITION BY src ORDER BY dst) END AS cdf FROM (SELECT *, sum(weight) OVER (PARTITION BY src) AS tot FROM g) y), s0 AS (SELECT p, src AS start, src AS node FROM (SELECT DISTINCT src FROM g) x, (SELECT unnest(range(2)) AS p) y)"
    for k in range(1, steps):
        u = u_sql("'walk'", "CAST(p AS VARCHAR)", "CAST(start AS VARCHAR)", f"'{k}'")
        if weighted:
            out += f", s{k} AS (SELECT p, start, min(dst) AS node FROM (SELECT *, {u} AS u FROM s{k - 1}) x JOIN r ON r.src = node AND r.cdf >= u GROUP BY 1, 2)"
        else:
            out += f", s{k} AS (SELECT p, start, dst AS node FROM (SELECT *, {u} AS u FROM s{k - 1}) x JOIN r ON r.src = node AND r.k = floor(u * d))"
    return out + " SELECT node_id, step, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT node AS node_id, {k} AS step FROM s{k}" for k in range(steps)) + ") x GROUP BY 1, 2"


def _visits(w: DataFrame) -> DataFrame:
    return w.groupBy("node_id", "step").agg(F.count(F.lit(1)).alias("n"))


def _nodes(g: DataFrame) -> DataFrame:
    return g.select(F.col("src").alias("node_id")).distinct()


@query(_walk_sql(5, False, GP))
def walk_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(walks.random_walks(part_graph(spark, sf_dir), None, 2, 5))


@query(_walk_sql(5, True, GN))
def walk_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    return _visits(walks.random_walks(g, _nodes(g), 2, 5, weighted=True))


def _forward_sql(steps: int) -> str:
    out = f"WITH {GP}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS d FROM g), s0 AS (SELECT p, src AS start, CAST(NULL AS BIGINT) AS bef, src AS node FROM (SELECT DISTINCT src FROM g) x, (SELECT unnest(range(2)) AS p) y)"
    for k in range(1, steps):
        u = u_sql("'walk'", "CAST(p AS VARCHAR)", "CAST(start AS VARCHAR)", f"'{k}'")
        out += f", t{k} AS (SELECT p, start, node, {u} AS u, b.k AS back FROM s{k - 1} LEFT JOIN r b ON b.src = node AND b.dst = bef)"
        out += f", c{k} AS (SELECT t.*, floor(u * (n.d - (back IS NOT NULL)::INT)) AS f FROM t{k} t JOIN r n ON n.src = node AND n.k = 0 WHERE n.d - (back IS NOT NULL)::INT > 0)"
        out += f", s{k} AS (SELECT p, start, node AS bef, r.dst AS node FROM c{k} c JOIN r ON r.src = c.node AND r.k = f + CASE WHEN back IS NOT NULL AND f >= back THEN 1 ELSE 0 END)"
    return out + " SELECT node_id, step, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT node AS node_id, {k} AS step FROM s{k}" for k in range(steps)) + ") x GROUP BY 1, 2"


@query(_forward_sql(5))
def walk_nonbacktracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(walks.random_walks(part_graph(spark, sf_dir), None, 2, 5, backtrack=False))


@query(None)
def walk_node2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(walks.random_walks(part_graph(spark, sf_dir), None, 1, 5, p=4.0, q=0.5))


@query(None)
def deepwalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipgram.DeepWalk(num_walks=10, walk_length=80, window=10).fit(nation_graph(spark, sf_dir)).transform(8)


def _spectrum_sql(matrix: str, k: int, shift: float, out: str) -> str:
    """Leading eigenpairs v<j>(i, v), l<j>(l) of matrix m(i, j, w), by twenty squarings of the deflated, shifted matrix each."""
    s = f"WITH {GN}, dg AS (SELECT src AS i, sum(weight) AS d FROM g GROUP BY 1), m AS ({matrix}), ij AS (SELECT a.i AS i, b.i AS j FROM dg a, dg b), b0 AS (SELECT ij.i, ij.j, coalesce(w, 0) + CASE WHEN ij.i = ij.j THEN {shift} ELSE 0 END AS w FROM ij LEFT JOIN m ON m.i = ij.i AND m.j = ij.j)"
    for e in range(k):
        s += f", q{e}_0 AS MATERIALIZED (SELECT * FROM b{e})"
        for r in range(20):
            s += f", p{e}_{r} AS MATERIALIZED (SELECT a.i, b.j, sum(a.w * b.w) AS w FROM q{e}_{r} a JOIN q{e}_{r} b ON a.j = b.i GROUP BY 1, 2), q{e}_{r + 1} AS MATERIALIZED (SELECT i, j, w / (SELECT sum(w) FROM p{e}_{r} WHERE i = j) AS w FROM p{e}_{r})"
        s += f", c{e} AS (SELECT arg_max(i, w) AS c FROM q{e}_20 WHERE i = j), r{e} AS (SELECT i, w AS v FROM q{e}_20, c{e} WHERE j = c), n{e} AS (SELECT sqrt(sum(v * v)) AS n FROM r{e}), v{e} AS MATERIALIZED (SELECT i, v / n AS v FROM r{e}, n{e})"
        s += f", l{e} AS MATERIALIZED (SELECT sum(a.v * b{e}.w * c.v) AS l FROM v{e} a JOIN b{e} ON a.i = b{e}.i JOIN v{e} c ON c.i = b{e}.j), b{e + 1} AS MATERIALIZED (SELECT b{e}.i, b{e}.j, w - l * x.v * y.v AS w FROM b{e} JOIN v{e} x ON x.i = b{e}.i JOIN v{e} y ON y.i = b{e}.j, l{e})"
    return s + out


_NORMAL = "SELECT src AS i, dst AS j, weight / sqrt(a.d * b.d) AS w FROM g JOIN dg a ON a.i = src JOIN dg b ON b.i = dst"


def _sizes(x: DataFrame, dim: int) -> DataFrame:
    """Absolute components, as the signs of eigenvectors are free."""
    return x.select("node_id", *[F.round(F.abs(F.col("emb")[c]), 4).alias(f"e{c}") for c in range(dim)])


@query(_spectrum_sql(_NORMAL, 3, 1.0, " SELECT CAST(pos AS INT) AS pos, round(l - 1, 6) AS value FROM (SELECT 0 AS pos, l FROM l0 UNION ALL SELECT 1, l FROM l1 UNION ALL SELECT 2, l FROM l2) x"))
def spectral_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three algebraically largest eigenvalues of the normalised adjacency."""
    values, _ = spectral.eigenpairs(spectral.symmetric_normal(nation_graph(spark, sf_dir)), 3, "LR")
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "pos int, value double")


@query(_spectrum_sql(_NORMAL, 3, 1.0, " SELECT v1.i AS node_id, round(abs(v1.v * sqrt(abs(l1.l - 1)) / sqrt(d)), 4) AS e0, round(abs(v2.v * sqrt(abs(l2.l - 1)) / sqrt(d)), 4) AS e1 FROM v1 JOIN v2 USING (i) JOIN dg USING (i), l1, l2"))
def laplacian_eigenmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spectral.LaplacianEigenMap().fit(nation_graph(spark, sf_dir)).transform(2), 2)


@query(_spectrum_sql(_NORMAL, 3, 1.0, "".join(f", f{e} AS (SELECT abs(l - 1) AS s, abs(l - 1) * (1 - power(abs(l - 1), 5)) / (5 * (1 - abs(l - 1))) AS f FROM l{e})" for e in (1, 2)) + " SELECT v1.i AS node_id, round(abs(v1.v * sqrt(abs(f1.f))), 4) AS e0, round(abs(v2.v * sqrt(abs(f2.f))), 4) AS e1 FROM v1 JOIN v2 USING (i), f1, f2"))
def linearized_node2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spectral.LinearizedNode2Vec(5).fit(nation_graph(spark, sf_dir)).transform(2), 2)


_SQUARED = "SELECT a.src AS i, b.dst AS j, sum(a.weight * b.weight) AS w FROM g a JOIN g b ON a.dst = b.src GROUP BY 1, 2"


@query(_spectrum_sql(_SQUARED, 2, 0.0, " SELECT v0.i AS node_id, round(abs(v0.v * l0.l) / 1e6, 4) AS e0, round(abs(v1.v * l1.l) / 1e6, 4) AS e1 FROM v0 JOIN v1 USING (i), l0, l1"))
def adj_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spectral.AdjacencySpectral().fit(nation_graph(spark, sf_dir)).transform(2)
    return _sizes(x.withColumn("emb", F.transform("emb", lambda v: v / 1e6)), 2)


_MODULAR = "SELECT z.i, y.j, sum(z.w * y.w) AS w FROM mm z JOIN mm y ON z.j = y.i GROUP BY 1, 2"
_MODULAR_HEAD = ", t AS (SELECT sum(d) AS t FROM dg), mm AS (SELECT a.i AS i, b.i AS j, coalesce(weight, 0) / t - a.d * b.d / (t * t) AS w FROM dg a CROSS JOIN dg b CROSS JOIN t LEFT JOIN g ON src = a.i AND dst = b.i), m AS ("


@query(_spectrum_sql(_MODULAR, 2, 0.0, " SELECT v0.i AS node_id, round(abs(v0.v * power(l0.l, 0.25)), 4) AS e0, round(abs(v1.v * power(l1.l, 0.25)), 4) AS e1 FROM v0 JOIN v1 USING (i), l0, l1").replace(", m AS (", _MODULAR_HEAD))
def modularity_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spectral.ModularitySpectral().fit(nation_graph(spark, sf_dir)).transform(2), 2)


@query(None)
def nonbacktracking_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.NonBacktrackingSpectral().fit(structure.symmetrize(nation_graph(spark, sf_dir))).transform(2)


@query(None)
def walk_matrix_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.WalkMatrixFactorization(5).fit(nation_graph(spark, sf_dir)).transform(3)


@query(None)
def node2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipgram.Node2Vec(num_walks=10, walk_length=20, window=5, p=2.0, q=0.5, epochs=8).fit(nation_graph(spark, sf_dir)).transform(8)


@query(None)
def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of nations from pairs one step apart."""
    return skipgram.Node2Vec(num_walks=20, walk_length=20, window=1, epochs=8).fit(nation_graph(spark, sf_dir)).transform(8)


@query(None)
def depthfirst_node2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of nations from walks that hardly ever go back."""
    return skipgram.Node2Vec(num_walks=10, walk_length=20, window=5, p=100.0, epochs=8).fit(nation_graph(spark, sf_dir)).transform(8)


# ---------------------------------------------------------------- block models

_ETA, _CAB = [0.5, 0.5], np.array([[1.5, 0.5], [0.5, 1.5]])


def _bp_sql() -> str:
    u = [u_sql("'msg'", "CAST(src AS VARCHAR)", "CAST(dst AS VARCHAR)", f"'{t}'") + " + 1e-3" for t in (0, 1)]
    return f"""WITH {GN}, raw AS (SELECT src, dst, {u[0]} AS a, {u[1]} AS b FROM g), msg AS (SELECT src, dst, a / (a + b) AS x, b / (a + b) AS y FROM raw),
l AS (SELECT dst AS i, sum(ln(1.5 * x + 0.5 * y)) + ln(0.5) AS a, sum(ln(0.5 * x + 1.5 * y)) + ln(0.5) AS b FROM msg GROUP BY 1),
c AS (SELECT m.src, m.dst, m.x, l.a - ln(1.5 * k.x + 0.5 * k.y) AS a, l.b - ln(0.5 * k.x + 1.5 * k.y) AS b FROM msg m JOIN msg k ON m.src = k.dst AND m.dst = k.src JOIN l ON l.i = m.src)
SELECT src, dst, round(0.5 / (1 + exp(b - a)) + 0.5 * x, 6) AS psi FROM c"""


@query(_bp_sql())
def bp_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    x = blockmodel.bp_sweep(blockmodel.initial_messages(g, 2), _ETA, _CAB, 25, [0.0, 0.0])
    return x.select("src", "dst", F.round(F.col("psi")[0], 6).alias("psi"))


@query(None)
def bp_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    groups, energy = blockmodel.bp_learn(g, _nodes(g), 2, _ETA, _CAB, em_steps=2, sweeps=3)
    return groups.select("node_id", "group_id", F.lit(energy).alias("free_energy"))


# ---------------------------------------------------------------- scalar functions, results layer


@query("SELECT o_orderkey, CAST((c_nationkey + o_orderkey) * (c_nationkey + o_orderkey + 1) // 2 + o_orderkey AS BIGINT) AS z FROM orders JOIN customer ON o_custkey = c_custkey")
def cantor_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select("o_orderkey", scalars.pairing(F.col("c_nationkey").cast("long"), F.col("o_orderkey")).alias("z"))


@query("WITH d AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), m AS (SELECT avg(k) AS mean FROM d), h AS (SELECT k, count(*) AS n FROM d GROUP BY 1) SELECT k, n, round(exp(k * ln(mean) - mean - list_sum(list_transform(range(1, k + 1), lambda i: ln(i)))), 8) AS poisson, round(1 - 1 / sqrt(mean), 8) AS limit_mu, round(ln(greatest(n, 1e-12)), 8) AS log_n FROM h, m")
def degree_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer: each degree's count, beside a Poisson law of the same mean, and the detectability limit."""
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    m = d.agg(F.avg("k").alias("mean"))
    x = d.groupBy("k").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(m))
    return x.select("k", "n", F.round(scalars.poisson_pmf(F.col("k"), F.col("mean")), 8).alias("poisson"), F.round(scalars.detectability_limit(F.col("mean")), 8).alias("limit_mu"), F.round(scalars.safe_log(F.col("n").cast("double")), 8).alias("log_n"))


@query(f"SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {u_sql(chr(39) + 'pair' + chr(39), 'CAST(p_partkey AS VARCHAR)')}, p_partkey) AS place FROM part")
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy(scalars.uniform("pair", F.col("p_partkey")), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(order).cast("long").alias("place"))


def _score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as score rows, their parameters in a file name."""
    name = F.concat(F.lit("out/score_n~100_mu~"), F.substring("o_orderpriority", 1, 1), F.lit("_name~"), F.col("o_orderstatus"), F.lit(".csv"))
    return table(spark, sf_dir, "orders").select(name.alias("filename"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000).alias("score"))


_ROWS = "r AS (SELECT substr(o_orderpriority, 1, 1) AS mu, o_orderstatus AS name, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS score FROM orders)"


@query(f"WITH {_ROWS} SELECT name, mu, count(score) AS n, round(avg(score), 6) AS mean_score, round(avg(score) - 1.96 * coalesce(stddev_samp(score) / sqrt(nullif(count(score), 0)), 0), 6) AS low FROM r WHERE mu IN ('1', '2', '3') GROUP BY 1, 2")
def perf_vs_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = results.decoded(_score_rows(spark, sf_dir), ["n", "mu", "name"])
    x = results.mean_and_interval(results.filtered(x, {"mu": ["1", "2", "3"], "absent": ["x"]}), ["name", "mu"])
    return x.select("name", "mu", "n", F.round("mean_score", 6).alias("mean_score"), F.round("low", 6).alias("low"))


@query(f"WITH {_ROWS}, q AS (SELECT name, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3 FROM r GROUP BY 1) SELECT name, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3, round(min(CASE WHEN score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN score END), 6) AS low, round(max(CASE WHEN score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN score END), 6) AS high FROM r JOIN q USING (name) WHERE q1 IS NOT NULL GROUP BY 1")
def boxplot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = results.with_any_score(results.decoded(_score_rows(spark, sf_dir), ["name"]), ["name"])
    x = results.box_summary(x, ["name"])
    return x.select("name", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "low", "high")])


@query(f"WITH {_ROWS} SELECT name, CAST(count(*) AS BIGINT) AS n, 'nmi' AS score_type FROM r GROUP BY 1 UNION ALL SELECT mu, count(*), NULL FROM r GROUP BY 1")
def results_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = results.decoded(_score_rows(spark, sf_dir), ["mu", "name"])
    one = x.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("score_type", F.lit("nmi"))
    return results.concat_results([one, x.groupBy(F.col("mu").alias("name")).agg(F.count(F.lit(1)).alias("n"))])


@query("SELECT region.r_name, s.n_segments * 2 AS n_points FROM region, (SELECT count(DISTINCT c_mktsegment) AS n_segments FROM customer) s")
def param_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of regions x market segments x two flags, counted per region."""
    values = lambda t, c, k: table(spark, sf_dir, t).select(F.col(c).alias(k)).distinct()
    x = results.param_space(spark, {"r_name": values("region", "r_name", "r_name"), "segment": values("customer", "c_mktsegment", "segment"), "flag": [True, False]})
    return x.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_points"))


@query(None)
def planted_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planted partition over the customers, scored for mixing: degrees and inner edges per community."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    edges, members = blockmodel.planted_partition(nodes, 5, 10.0, 0.3, nodes.count())
    x = scores.mixing(edges, members).join(members, "node_id")
    return x.groupBy("membership").agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("degree"), F.avg("mixing").alias("mixing"))


@query(None)
def lfr_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark graph with as many nodes as there are customers, and its mixing."""
    n = table(spark, sf_dir, "customer").count()
    edges, members = lfr.generate(spark, lfr.Parameters(n=n, mean_degree=8, max_degree=min(40, n - 1), mixing=0.3, min_community=10, max_community=50))
    return scores.mixing(edges, members).agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("degree"), F.avg("mixing").alias("mixing"))


from nodeloom.plans import more_queries  # noqa: E402, F401  registers the rest
