"""More registered queries, with their SQL: cleaning, laws, block-model measures, benchmark stages, detectors, results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions import scalars
from nodeloom.operators import blockmodel, clustering, detection, lfr, merging, scores, spectral, structure
from nodeloom.plans import results
from nodeloom.plans.queries import _CAB, _ETA, EMB, GN, GP, LONG, MN, MP, SCORES_SQL, COSINE, _nodes, query, u_sql
from nodeloom.sources import graphs
from nodeloom.sources.graphs import embedding_table, nation_graph, nation_members, part_graph, part_members, table

# ---------------------------------------------------------------- cleaning, embeddings


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 1.0::DOUBLE AS weight FROM lineitem WHERE l_partkey <> l_suppkey AND l_linenumber <> 1")
def edges_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as one set of ids; the first line of an order weighs 0."""
    lines = table(spark, sf_dir, "lineitem")
    return structure.clean(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_linenumber") - 1).alias("weight")))


@query(f"WITH {GP}, o AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT (SELECT count(*) FROM (SELECT src, dst FROM g EXCEPT SELECT dst, src FROM g) x) = 0 AS symmetric, (SELECT count(*) FROM (SELECT src, dst FROM o EXCEPT SELECT dst, src FROM o) x) > 0 AS other_is_not")
def symmetry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    return spark.createDataFrame([(structure.is_symmetric(part_graph(spark, sf_dir)), not structure.is_symmetric(lines))], "symmetric boolean, other_is_not boolean")


@query("WITH c AS (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS id FROM (SELECT DISTINCT o_custkey FROM orders) x) SELECT o_orderkey, CAST(id AS BIGINT) AS id FROM orders JOIN c USING (o_custkey)")
def node_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"), "o_orderkey")
    ids = graphs.densify(edges.select("src", "dst"), orders.select("o_custkey").distinct(), "o_custkey")[1]
    return orders.join(ids, "o_custkey").select("o_orderkey", F.col("node_id").alias("id"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS node_id, n FROM customer LEFT JOIN c ON c_custkey = o_custkey")
def lcc_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result on the customers that have orders, back on all of them."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return structure.scatter(found, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id")))


@query(f"WITH {EMB} SELECT node_id, CASE WHEN membership = 0 THEN 0.0 ELSE round(list_sum(e), 6) END AS total, CAST(len(e) AS INT) AS dim FROM emb")
def fill_missing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = embedding_table(spark, sf_dir).withColumn("emb", F.when(F.col("membership") != 0, F.col("emb")))
    x = clustering.fill_missing(x, 64)
    return x.select("node_id", F.round(F.aggregate("emb", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.size("emb").alias("dim"))


@query("WITH s AS (SELECT count(*) AS n, count(DISTINCT label) AS k, count(CASE WHEN label = 0 THEN 1 END) AS c FROM embeddings) SELECT CAST(d AS INT) AS asked, CAST(greatest(0, least(CASE WHEN d = 0 THEN least(n - 1, k - 1) ELSE d END, c - 2)) AS INT) AS dim FROM s, (SELECT unnest([0, 1, 16, 64, 100000]) AS d) x")
def effective_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the vectors of label 0 as the component."""
    row = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)), F.countDistinct("label"), F.sum((F.col("label") == 0).cast("int"))).first()
    return spark.createDataFrame([(d, spectral.effective_dim(d, row[0], row[1], row[2])) for d in (0, 1, 16, 64, 100_000)], "asked int, dim int")


_KEPT = LONG + ", nk AS (SELECT pos, sqrt(sum(v * v)) AS norm FROM long GROUP BY pos), tk AS (SELECT max(norm) AS top, arg_max(pos, (norm, -pos)) AS lead FROM nk), k0 AS (SELECT pos FROM nk, tk WHERE norm >= sqrt(top) AND pos <> lead), k AS (SELECT pos FROM k0 UNION ALL SELECT lead FROM tk WHERE NOT EXISTS (SELECT 1 FROM k0))"


def _variant_sql(normal: bool) -> str:
    value = "v / greatest(norm, 1e-32)" if normal else "v"
    return f"""{_KEPT}, lz AS (SELECT node_id, membership, long.pos, {value} AS v FROM long JOIN k USING (pos) JOIN nk USING (pos)),
emb2 AS (SELECT node_id, membership, list(v ORDER BY pos) AS e FROM lz GROUP BY 1, 2), cl AS (SELECT membership AS c, pos, sum(v) AS v FROM lz GROUP BY 1, 2), cent AS (SELECT c, list(v ORDER BY pos) AS ce FROM cl GROUP BY c),
labels AS (SELECT membership AS t, arg_max(c, ({COSINE}, -c)) AS p FROM emb2, cent GROUP BY node_id, membership), {SCORES_SQL}"""


_FOUR = " UNION ALL ".join(f"SELECT {str(z).lower()} AS normalize, {str(d).lower()} AS dim_threshold, nmi, esim FROM (WITH {_variant_sql(z)}) x{int(z)}{int(d)}" for z in (False, True) for d in (False, True))


@query(_FOUR)
def voronoi_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four forms of an embedding whose small columns are dropped, which nearest centroids do whatever the flag."""
    x = embedding_table(spark, sf_dir)
    found = clustering.clustered_variants(x, clustering.voronoi, threshold=True, always=True).join(x.select("node_id", "membership"), "node_id")
    got = scores.partition_scores(found, "membership", "group_id", by=("normalize", "dim_threshold"))
    return got.select("normalize", "dim_threshold", F.round("nmi", 6).alias("nmi"), F.round("esim", 6).alias("esim"))


@query(None)
def kmeans_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = embedding_table(spark, sf_dir)
    found = clustering.clustered_variants(x, lambda e: clustering.kmeans(e, 10), threshold=True).join(x.select("node_id", "membership"), "node_id")
    return scores.partition_scores(found, "membership", "group_id", by=("normalize", "dim_threshold"))


# ---------------------------------------------------------------- linear algebra

_TOY = "[(i % 2)::DOUBLE, (i % 3)::DOUBLE, (i % 5)::DOUBLE, 1.0::DOUBLE]"
_RAY = f"""WITH {GN}, nd AS (SELECT DISTINCT src AS i FROM g), e AS (SELECT i, unnest({_TOY}) AS v, generate_subscripts({_TOY}, 1) - 1 AS pos FROM nd),
n AS (SELECT pos, sum(v * v) AS n2 FROM e GROUP BY 1), d AS (SELECT src AS i, sum(weight) AS d FROM g GROUP BY 1),
f AS (SELECT a.pos, sum(weight / sqrt(x.d * y.d) * a.v * b.v) AS f FROM g JOIN e a ON a.i = src JOIN e b ON b.i = dst AND b.pos = a.pos JOIN d x ON x.i = src JOIN d y ON y.i = dst GROUP BY 1)"""


def _toy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("node_id")
    return _nodes(nation_graph(spark, sf_dir)).select("node_id", F.array((i % 2).cast("double"), (i % 3).cast("double"), (i % 5).cast("double"), F.lit(1.0)).alias("emb"))


@query(_RAY + " SELECT CAST(pos AS INT) AS pos, round(coalesce(f, 0) / greatest(n2, 1e-24), 8) AS value FROM n LEFT JOIN f USING (pos)")
def rayleigh_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spectral.rayleigh(spectral.symmetric_normal(nation_graph(spark, sf_dir)), _toy(spark, sf_dir))
    return x.select("pos", F.round("value", 8).alias("value"))


@query(_RAY + ", o AS (SELECT pos, row_number() OVER (ORDER BY coalesce(f, 0) / greatest(n2, 1e-24) DESC, pos) AS r FROM n LEFT JOIN f USING (pos)) SELECT i AS node_id, CAST(r - 1 AS INT) AS place, v FROM e JOIN o USING (pos) WHERE r <= 2")
def rayleigh_shave(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spectral.shave(_toy(spark, sf_dir), 3, spectral.symmetric_normal(nation_graph(spark, sf_dir)))
    return x.select("node_id", F.posexplode("emb").alias("place", "v"))


@query(f"WITH {GN}, t AS (SELECT sum(weight) AS t FROM g), p AS (SELECT src, sum(weight) / max(t) AS p FROM g, t GROUP BY 1), n AS (SELECT count(*) AS n FROM p) SELECT round(avg(abs(p - 1.0 / n) * n), 8) AS change FROM p, n")
def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an even law over the nations to the stationary one."""
    d = structure.degrees(nation_graph(spark, sf_dir))
    total = d.agg(F.sum("strength").alias("t"), F.count(F.lit(1)).alias("n"))
    x = d.crossJoin(F.broadcast(total))
    now, even = x.select("node_id", (F.col("strength") / F.col("t")).alias("value")), x.select("node_id", (1 / F.col("n")).alias("value"))
    return spectral.mean_relative_change(now, even).select(F.round("change", 8).alias("change"))


# ---------------------------------------------------------------- structure, laws

_DEGREES = f"WITH {GP}, d AS (SELECT src, count(*) AS k FROM g GROUP BY 1)"


@query(_DEGREES + " SELECT round(avg(k), 8) AS mean, round(var_pop(k), 6) AS variance, round(avg(k), 8) AS law_mean, round(var_pop(k), 6) AS law_variance FROM d")
def pf_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the degrees, and of their law: the same."""
    d = structure.degrees(part_graph(spark, sf_dir))
    a = scores.moments(d, "degree").select(F.round("mean", 8).alias("mean"), F.round("variance", 6).alias("variance"))
    b = scores.law_moments(scores.integer_histogram(d, "degree")).select(F.round("mean", 8).alias("law_mean"), F.round("variance", 6).alias("law_variance"))
    return a.crossJoin(F.broadcast(b))


@query(_DEGREES + ", h AS (SELECT k, count(*) / (SELECT count(*) FROM d) AS s FROM d GROUP BY 1) SELECT k AS value, round(sum(s) OVER (ORDER BY k), 8) AS cdf, round(s, 8) AS share FROM h")
def cumulative_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degrees' running shares, and the shares taken back from them."""
    cdf = scores.cumulative(scores.integer_histogram(structure.degrees(part_graph(spark, sf_dir)), "degree"))
    return cdf.join(scores.distribution(cdf), "value").select("value", F.round("cdf", 8).alias("cdf"), F.round("share", 8).alias("share"))


@query("WITH t AS (SELECT max(k) AS most FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey) x), v AS (SELECT unnest(range(1, most + 1)) AS value FROM t) SELECT CAST(value AS BIGINT) AS value, round(sum(power(value, -2.0)) OVER (ORDER BY value) / sum(power(value, -2.0)) OVER (), 8) AS cdf FROM v")
def powerlaw_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over 1 to the most orders that a customer has."""
    most = table(spark, sf_dir, "orders").groupBy("o_custkey").count().agg(F.max("count")).first()[0]
    return lfr.power_law_cdf(spark, 1, most, 2.0).select("value", F.round("cdf", 8).alias("cdf"))


@query(f"WITH {GP}, {MP} SELECT src AS node_id, membership, count(*) AS n FROM g JOIN m ON dst = node_id GROUP BY 1, 2")
def neighbor_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.community_overlap(part_graph(spark, sf_dir), part_members(spark, sf_dir))


@query(f"WITH {GN}, c AS (SELECT e.src AS a, e.dst AS b, count(y.src) AS n FROM g e JOIN g x ON x.src = e.src LEFT JOIN g y ON y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2) SELECT a AS node_id, arg_min(b, (n, b)) AS neighbor, min(n) AS common FROM c GROUP BY 1")
def loosest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.loosest_neighbor(nation_graph(spark, sf_dir))


@query("SELECT o_orderkey, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (SELECT o_orderkey, (o_custkey % 7) * 400000000 + o_orderkey AS a, o_orderkey * 9000 % 500000000 AS b FROM orders) x")
def cantor_unpairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with pairing numbers up to 2 ** 62, and back."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") % 7) * 400_000_000 + F.col("o_orderkey")).cast("long").alias("a"), (F.col("o_orderkey") * 9000 % 500_000_000).cast("long").alias("b"))
    a, b = scalars.unpairing(F.col("z"))
    return x.select("o_orderkey", scalars.pairing(F.col("a"), F.col("b")).alias("z")).select("o_orderkey", a.alias("a"), b.alias("b"))


_LF = "list_sum(list_transform(range(1, greatest(({}), 1) + 1), lambda i: ln(i)))"
_LC = lambda n, k: f"({_LF.format(n)} - {_LF.format(k)} - {_LF.format(f'{n} - ({k})')})"


@query(f"""WITH d AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), h AS (SELECT k, count(*) AS n FROM d GROUP BY 1), j AS (SELECT unnest(range(0, 401)) AS j)
SELECT CAST(k AS BIGINT) AS k, round(exp({_LC('400', 'k')} + k * ln(0.05) + (400 - k) * ln(0.95)), 8) AS binomial,
(SELECT round(sum(exp({_LC('400', 'j')} + j * ln(0.05) + (400 - j) * ln(0.95))), 8) FROM j WHERE j <= k) AS cdf, (SELECT round(sum(exp({_LC('400', 'j')} + j * ln(0.05) + (400 - j) * ln(0.95))), 8) FROM j WHERE j >= k) AS tail,
round(exp({_LC('100', 'k')} + {_LC('200', '100 - k')} - {_LC('300', '100')}), 8) AS hypergeometric,
CAST(1000 // (k + 1) + CASE WHEN k < 1000 % (k + 1) THEN 1 ELSE 0 END AS BIGINT) AS last_part, CAST(floor(sqrt(10.0 * n)) AS BIGINT) AS maxk, CAST(ceil(sqrt(10.0 * n)) AS BIGINT) AS maxc,
round(list_sum(list_transform(range(k, k + 50), lambda i: power(i, -1.0))) / list_sum(list_transform(range(k, k + 50), lambda i: power(i, -2.0))), 8) AS mean_of_law FROM h WHERE k <= 100""")
def discrete_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer under binomial and hypergeometric laws, and the helpers of benchmark graphs."""
    h = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <= 100")
    k, n, p = F.col("k"), F.lit(400), F.lit(0.05)
    return h.select(
        "k", F.round(scalars.binomial_pmf(k, n, p), 8).alias("binomial"), F.round(scalars.binomial_cdf(k, n, p), 8).alias("cdf"), F.round(scalars.binomial_tail(k, n, p), 8).alias("tail"),
        F.round(scalars.hypergeometric_pmf(k, F.lit(100), F.lit(200), F.lit(100)), 8).alias("hypergeometric"), scalars.equal_split(F.lit(1000), k + 1, k).cast("long").alias("last_part"),
        scalars.largest_degree(F.col("n")).alias("maxk"), scalars.largest_degree(F.col("n"), True).alias("maxc"), F.round(scalars.integer_average(k, k + 49, 2.0), 8).alias("mean_of_law"),
    )


@query("SELECT p_partkey, CAST(p_size + 0.25 AS DOUBLE) AS plain, CAST(NULL AS DOUBLE) AS exponent, CAST(p_size AS BIGINT) AS half, CAST(p_size + 1 AS BIGINT) AS more, len(list_filter(regexp_split_to_array(p_name || ',,' || p_brand, '[ ,]'), lambda x: x <> '')) AS n_pieces FROM part")
def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return x.select(
        "p_partkey", scalars.parsed_number(F.concat(size, F.lit(".25"))).alias("plain"), scalars.parsed_number(F.concat(size, F.lit("e2"))).alias("exponent"),
        scalars.half_down(F.col("p_size") + 0.5).alias("half"), scalars.half_down(F.col("p_size") + 0.75).alias("more"), F.size(scalars.pieces(F.concat_ws(",,", "p_name", "p_brand"), " ,")).cast("long").alias("n_pieces"),
    )


# ---------------------------------------------------------------- block models


def _stored(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph that is read again and again, made once, and its nodes."""
    g = structure.cut_lineage(g.sortWithinPartitions("src", "dst"), "graph")
    return g, structure.cut_lineage(_nodes(g))


@query(f"""WITH {GP}, {MP}, d AS (SELECT node_id, membership, coalesce(k, 0)::DOUBLE AS d FROM m LEFT JOIN (SELECT src, count(*) AS k FROM g GROUP BY 1) x ON src = node_id), t AS (SELECT max(d) AS top, count(*) AS n FROM d),
s AS (SELECT membership, count(*)::DOUBLE AS s0, sum(d / top) AS s1, sum(d) AS s2 FROM d, t GROUP BY 1), b AS (SELECT a.membership AS x, b.membership AS y, count(*) AS w FROM g JOIN m a ON src = a.node_id JOIN m b ON dst = b.node_id GROUP BY 1, 2)
SELECT x AS block_a, y AS block_b, round(n * w / (p.s0 * q.s0), 6) AS plain, round(n * w / (p.s1 * q.s1), 6) AS dc1, round(n * w / (p.s2 * q.s2), 8) AS dc2 FROM b JOIN s p ON p.membership = x JOIN s q ON q.membership = y, t""")
def sbm_hard_params_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, m = part_graph(spark, sf_dir), part_members(spark, sf_dir)
    out = None
    for dc, name, digits in ((0, "plain", 6), (1, "dc1", 6), (2, "dc2", 8)):
        x = blockmodel.hard_parameters(g, m, dc).select("block_a", "block_b", F.round("cab", digits).alias(name))
        out = x if out is None else out.join(x, ["block_a", "block_b"])
    return out


@query("WITH c AS (SELECT p_size % 3 AS t, p_partkey % 3 AS p, count(*) AS n FROM part GROUP BY 1, 2), z AS (SELECT count(*) AS n FROM part), pm(a, b, c) AS (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) SELECT round(max(s) / max(z.n), 8) AS overlap FROM (SELECT a, b, c, sum(CASE WHEN (t = 0 AND p = a) OR (t = 1 AND p = b) OR (t = 2 AND p = c.c2) THEN n ELSE 0 END) AS s FROM pm, (SELECT t, p, n, 0 AS z0 FROM c) k, (SELECT unnest([0, 1, 2]) AS c2) c WHERE c.c2 = pm.c GROUP BY 1, 2, 3) q, z")
def overlap_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size and by key, modulo 3, at the best naming."""
    part = table(spark, sf_dir, "part")
    groups = part.select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 3).alias("group_id"))
    truth = part.select(F.col("p_partkey").alias("node_id"), (F.col("p_size") % 3).cast("long").alias("membership"))
    return spark.createDataFrame([(round(blockmodel.truth_overlap(groups, truth, 3), 8),)], "overlap double")


def _message_sql() -> str:
    u = [u_sql("'msg'", "CAST(src AS VARCHAR)", "CAST(dst AS VARCHAR)", f"'{t}'") + " + 1e-3" for t in (0, 1)]
    return f"""WITH {GN}, raw AS (SELECT src, dst, {u[0]} AS a, {u[1]} AS b FROM g), msg AS (SELECT src, dst, a / (a + b) AS x, b / (a + b) AS y FROM raw),
l AS (SELECT dst AS i, sum(ln(1.5 * x + 0.5 * y)) + ln(0.5) AS a, sum(ln(0.5 * x + 1.5 * y)) + ln(0.5) AS b FROM msg GROUP BY 1), mg AS (SELECT i, a, b, 1 / (1 + exp(b - a)) AS x, 1 / (1 + exp(a - b)) AS y FROM l)"""


@query(_message_sql() + " SELECT i AS node_id, round(greatest(x, y), 6) AS top, CASE WHEN x >= y THEN 0 ELSE 1 END::BIGINT AS group_id FROM mg")
def bp_marginals_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    m = blockmodel.node_marginals(blockmodel.initial_messages(g, 2), _ETA, _CAB, 25, [0.0, 0.0])
    return blockmodel.argmax_groups(m, _ETA).select("node_id", F.round(F.array_max("psi"), 6).alias("top"), "group_id")


@query(_message_sql() + " SELECT round(sum(x), 6) AS size0, round(sum(y), 6) AS size1, round(avg(x * x + y * y), 6) AS ea, round(avg(greatest(x, y)), 6) AS marginal FROM mg")
def bp_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected group sizes, and the overlaps of marginals."""
    g = nation_graph(spark, sf_dir)
    m = blockmodel.node_marginals(blockmodel.initial_messages(g, 2), _ETA, _CAB, 25, [0.0, 0.0])
    size = blockmodel.expected_sizes(m, 2)[0]
    x = blockmodel.marginal_overlaps(m)
    return x.select(F.lit(round(size[0], 6)).alias("size0"), F.lit(round(size[1], 6)).alias("size1"), F.round("ea", 6).alias("ea"), F.round("marginal", 6).alias("marginal"))


@query(_message_sql() + """, st AS (SELECT sum(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))) / 25 AS s FROM l),
lk AS (SELECT sum(ln(1.5 * m.x * k.x + 0.5 * m.x * k.y + 0.5 * m.y * k.x + 1.5 * m.y * k.y)) / 50 AS s FROM msg m JOIN msg k ON m.src = k.dst AND m.dst = k.src), z AS (SELECT sum(x) AS x, sum(y) AS y FROM mg)
SELECT round(-(st.s - lk.s + (1.5 * z.x * z.x + z.x * z.y + 1.5 * z.y * z.y) / 1250), 6) AS f, round((st.s - lk.s + (1.5 * z.x * z.x + z.x * z.y + 1.5 * z.y * z.y) / 1250) * 25 - (SELECT count(*) / 2 FROM g) * ln(25), 4) AS loglike FROM st, lk, z""")
def bp_free_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    f = blockmodel.free_energy(blockmodel.initial_messages(g, 2), _ETA, _CAB, 25, [0.0, 0.0])
    return spark.createDataFrame([(round(f, 6), round(blockmodel.log_likelihood(f, 25, g.count() / 2), 4))], "f double, loglike double")


@query(f"""WITH {GN}, {MN}, x AS (SELECT CASE WHEN (a.membership < 2) = (b.membership < 2) THEN 1.5 ELSE 0.5 END AS c FROM g JOIN m a ON src = a.node_id JOIN m b ON dst = b.node_id), n AS (SELECT sum(CASE WHEN membership < 2 THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN membership < 2 THEN 0 ELSE 1 END)::DOUBLE AS b FROM m)
SELECT round(-((a + b) * ln(0.5) + 0.5 * (SELECT sum(ln(c)) FROM x) + 0.5 * ((a * a + b * b) * ln(1 - 1.5 / (a + b)) + 2 * a * b * ln(1 - 0.5 / (a + b)))) / (a + b), 6) AS energy FROM n""")
def argmax_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the nations in two groups by region."""
    m = nation_members(spark, sf_dir).select("node_id", (F.col("membership") >= 2).cast("long").alias("group_id"))
    return spark.createDataFrame([(round(blockmodel.argmax_energy(nation_graph(spark, sf_dir), m, _ETA, _CAB), 6),)], "energy double")


@query(None)
def mf_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = structure.symmetrize(nation_graph(spark, sf_dir))
    groups, energy = blockmodel.mean_field(g, _nodes(g), 2, _ETA, np.array([[20.0, 10.0], [10.0, 20.0]]))
    return groups.select("node_id", "group_id", F.lit(energy).alias("free_energy"))


@query(None)
def bp_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of regions by belief propagation, from the sizes and affinities that they have."""
    g, m = structure.symmetrize(nation_graph(spark, sf_dir)), nation_members(spark, sf_dir)
    groups, energy = blockmodel.detect(g, m.withColumn("membership", (F.col("membership") >= 2).cast("long")), runs=1, em_steps=1, sweeps=10)
    return groups.select("node_id", "group_id", F.lit(energy).alias("free_energy"))


@query(None)
def bp_lowest_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of two runs on the parts of one order, each from random affinities of the graph's mean degree."""
    g, nodes = _stored(part_graph(spark, sf_dir))
    groups, energy = blockmodel.lowest_energy(g, nodes, 2, runs=2, em_steps=1, sweeps=3)
    return groups.select("node_id", "group_id", F.lit(energy).alias("free_energy"))


@query(None)
def bp_degree_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bp_lowest_energy, one run, with links in proportion to degrees."""
    g, nodes = _stored(part_graph(spark, sf_dir))
    groups, energy = blockmodel.lowest_energy(g, nodes, 2, runs=1, dc=2, em_steps=1, sweeps=4)
    return groups.select("node_id", "group_id", F.lit(energy).alias("free_energy"))


@query(None)
def bp_walk_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affinities of two groups of parts after three steps of a walk that lowers the mean-field free energy."""
    g, nodes = _stored(part_graph(spark, sf_dir))
    eta, cab = blockmodel.random_affinities(g, nodes, 2)
    cab, energies = blockmodel.walk_learn(g, nodes, 2, eta, cab, steps=3, size=2.0, sweeps=3)
    return spark.createDataFrame([(a, b, float(cab[a][b]), energies[-1]) for a in (0, 1) for b in (0, 1)], "a int, b int, cab double, free_energy double")


@query(None)
def spectral_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmodel.spectral_partition(nation_graph(spark, sf_dir), 5)


@query(None)
def infomap_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow communities of the parts that one order holds together."""
    labels, bits = detection.flow_communities(part_graph(spark, sf_dir))
    return labels.select("node_id", "membership", F.lit(bits).alias("codelength"))


_JUMP = 0.15
_LAW = (
    f"WITH RECURSIVE {GN.split('g AS')[0].rstrip().rstrip(',')}, {MN}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM m), k AS (SELECT src, sum(weight) AS k FROM one GROUP BY 1), "
    f"it(i, v) AS (SELECT 0, (SELECT list(1.0::DOUBLE / 25 ORDER BY node_id) FROM m) UNION ALL SELECT i + 1, (SELECT list(p ORDER BY node_id) FROM (SELECT node_id, {_JUMP} / (SELECT n FROM n) + {1 - _JUMP} * coalesce(sum(it.v[src + 1] * weight / k.k), 0) AS p FROM m LEFT JOIN one ON dst = node_id LEFT JOIN k USING (src) GROUP BY node_id) x) FROM it WHERE i < 200), "
    "p AS (SELECT node_id, v[node_id + 1] AS p, membership FROM m, it WHERE i = 200)"
)


@query(
    _LAW + f", x AS (SELECT a.membership AS m, sum({1 - _JUMP} * a.p * weight / k.k) AS out FROM one JOIN k USING (src) JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst WHERE a.membership <> b.membership GROUP BY 1), "
    f"q AS (SELECT s.m, s.p, coalesce(out, 0) + {_JUMP} * s.p * (1 - c / (SELECT n FROM n)) AS q FROM (SELECT membership AS m, sum(p) AS p, count(*) AS c FROM p GROUP BY 1) s LEFT JOIN x USING (m)) "
    "SELECT round(sum(q) * log2(sum(q)) - 2 * sum(q * log2(q)) - (SELECT sum(p * log2(p)) FROM p) + sum((q + p) * log2(q + p)), 6) AS codelength FROM q"
)
def map_equation_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a step of a walk from customers' nations to suppliers' nations, with recorded jumps, under the regions."""
    flow = detection.flow_graph(graphs.trade_graph(spark, sf_dir), directed=True)
    return detection.code_length(flow, nation_members(spark, sf_dir)).select(F.round("codelength", 6).alias("codelength"))


@query(None)
def flatsbm_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in as many groups as there are brands, merged from single parts."""
    k = table(spark, sf_dir, "part").select("p_brand").distinct().count()
    labels, entropy = merging.flat_blocks(part_graph(spark, sf_dir), k, heated=1, downhill=1, settle=0, shrink=4.0)
    return labels.select("node_id", "membership", F.lit(entropy).alias("entropy"))


# ---------------------------------------------------------------- benchmark graphs


@query("""WITH c AS (SELECT count(*) AS n FROM customer), p AS (SELECT n, 0.5 * n - 1 AS half FROM c), v AS (SELECT n, 6.0 / (2 * 0.2 * 0.25 + (n / 2.0 - 1) / n) AS ins FROM c)
SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(CASE WHEN a = b THEN ins ELSE 0.2 * ins END, 8) AS cab FROM v, (SELECT unnest([0, 1]) AS a) x, (SELECT unnest([0, 1]) AS b) y""")
def sbm_epsc_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    cab = blockmodel.affinities(2, n, 0.2, 6.0)[1]
    return spark.createDataFrame([(a, b, round(float(cab[a][b]), 8)) for a in (0, 1) for b in (0, 1)], "a int, b int, cab double")


@query("""WITH c AS (SELECT count(*) AS n FROM customer), s AS (SELECT n, floor(n * 0.5)::BIGINT AS n0, n - floor(n * 0.5)::BIGINT AS n1 FROM c)
SELECT CAST(a AS BIGINT) AS block_a, CAST(b AS BIGINT) AS block_b, CAST(CASE WHEN a = b THEN 2 * floor(8.0 / n * floor(k * (k - 1) / 2)) ELSE floor(2.0 / n * n0 * n1) END AS BIGINT) AS links
FROM (SELECT a, b, n, n0, n1, CASE WHEN a = 0 THEN n0 ELSE n1 END AS k FROM s, (SELECT unnest([0, 1]) AS a) x, (SELECT unnest([0, 1]) AS b) y) z""")
def sbm_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block model over as many nodes as there are customers, with exact numbers of edges."""
    n = table(spark, sf_dir, "customer").count()
    edges, members = blockmodel.exact_partition(spark, n, [0.5, 0.5], np.array([[8.0, 2.0], [2.0, 8.0]]))
    return structure.block_matrix(edges, members).select("block_a", "block_b", F.col("weight").cast("long").alias("links"))


_LFR = dict(mean_degree=8, max_degree=40, mixing=0.3, min_community=10, max_community=50)


def _parameters(spark: SparkSession, sf_dir: str, **more) -> lfr.Parameters:
    n = table(spark, sf_dir, "customer").count()
    return lfr.Parameters(n=n, **(_LFR | {"max_degree": min(40, n - 1)} | more))


def _degree_sql() -> str:
    cuts = lfr.degree_cutoffs(lfr.Parameters(n=1000, **_LFR))
    laws = " UNION ALL ".join(f"SELECT v AS value, {share!r}::DOUBLE * power(v, -2.0) / sum(power(v, -2.0)) OVER () AS p FROM (SELECT unnest(range({low}, 41)) AS v) x{low}" for low, share in cuts)
    return f"""WITH pmf AS (SELECT value, sum(p) AS p FROM ({laws}) x GROUP BY 1), law AS (SELECT value, sum(p) OVER (ORDER BY value) AS cdf FROM pmf), top AS (SELECT max(value) AS most FROM law), c AS (SELECT count(*) AS n FROM customer),
u AS (SELECT i, (i + {u_sql("'lfr'", "'k'", "CAST(i AS VARCHAR)")}) / n AS u FROM c, (SELECT unnest(range((SELECT n FROM c))) AS i) x),
k AS (SELECT i, coalesce(min(value), max(most)) AS k FROM top, u LEFT JOIN law ON cdf >= u GROUP BY 1), t AS (SELECT arg_max(i, (k, i)) AS top, sum(k) % 2 AS odd FROM k), e AS (SELECT i, k - CASE WHEN i = top THEN odd ELSE 0 END AS k FROM k, t)
SELECT CAST(i AS BIGINT) AS node_id, CAST(k AS BIGINT) AS degree, CAST(least(floor(k * 0.7::DOUBLE + {u_sql("'lfr'", "'in'", "CAST(i AS VARCHAR)")}), k) AS BIGINT) AS internal FROM e"""


@query(_degree_sql())
def lfr_degree_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lfr.degree_sequence(spark, _parameters(spark, sf_dir)).select("node_id", F.col("degree").cast("long").alias("degree"), "internal")


@query("SELECT true AS in_range, count(*)::BIGINT AS places FROM customer")
def lfr_community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all sizes are in the range asked for, and their sum."""
    p = _parameters(spark, sf_dir)
    low, high = p.sizes()
    return lfr.community_sizes(spark, p).agg(F.bool_and(F.col("size").between(low, high)).alias("in_range"), F.sum("size").cast("long").alias("places"))


@query(None)
def lfr_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing of a benchmark graph with overlapping nodes and raised clustering, in a histogram."""
    n = table(spark, sf_dir, "customer").count()
    edges, members = lfr.generate(spark, _parameters(spark, sf_dir, overlapping=n // 20, clustering=0.4))
    return lfr.statistics(edges, members.dropDuplicates(["node_id"]))["mixing"]


# ---------------------------------------------------------------- results

_NAMES = {"1-URGENT": "node2vec", "2-HIGH": "bp", "3-MEDIUM": "levy-word2vec", "4-NOT SPECIFIED": "deepwalk", "5-LOW": "infomap"}


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as score rows of models; direct detectors have no variant and no clustering."""
    x = table(spark, sf_dir, "orders")
    name = F.col("o_orderpriority")
    for k, v in _NAMES.items():
        name = F.when(F.col("o_orderpriority") == k, v).otherwise(name)
    direct = F.col("name").isin("bp", "infomap")
    x = x.select(name.alias("name"), F.when(F.col("o_custkey") % 2 == 0, "esim").otherwise("nmi").alias("score_type"), (F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderkey") % 2 == 0).alias("z"), (F.col("o_orderkey") % 3 == 0).alias("d"), F.when(F.col("o_orderkey") % 5 == 0, "kmeans").otherwise("voronoi").alias("c"))
    none = lambda c: F.when(~direct, F.col(c))
    return x.select("name", "score_type", "score", none("z").alias("normalize"), none("d").alias("dimThreshold"), none("c").alias("clustering"))


_MODEL_ROWS = "r AS (SELECT CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " ELSE o_orderpriority END AS name, o_custkey % 2 = 0 AS esim, o_totalprice / 1000 AS score, o_orderkey % 2 = 0 AS z, o_orderkey % 3 = 0 AS d, o_orderkey % 5 = 0 AS km FROM orders)"


@query(f"WITH {_MODEL_ROWS}, s(name, rank, display) AS (VALUES " + ", ".join(f"('{k}', {n}, '{d}')" for n, (k, d, _) in enumerate(results.STYLES)) + ") SELECT display, CAST(rank AS INT) AS rank, CASE WHEN r.name IN ('bp', 'infomap') THEN 'community-detection' ELSE 'voronoi' END AS clustering, count(*) AS n, round(avg(score), 6) AS mean_score FROM r JOIN s ON r.name = s.name WHERE esim AND (r.name IN ('bp', 'infomap') OR (NOT z AND NOT d AND NOT km)) GROUP BY ALL")
def results_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one figure: one model left out, direct detectors as a clustering of their own, plain variants, in the models' order."""
    x = results.focal(results.direct_as_clustering(results.without_names(_model_rows(spark, sf_dir))), "voronoi")
    return results.in_model_order(x).groupBy("display", "rank", "clustering").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS q, o_totalprice AS mu, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS dim FROM orders")
def results_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("K"), F.col("o_totalprice").cast("string").alias("mu"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("dim"))
    return results.typed(x, ["K", "mu", "dim", "absent"], ["K"], {"K": "q"})
