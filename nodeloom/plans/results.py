"""The results layer: parameter spaces, parameters in file names, score tables and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.structure import running
from nodeloom.storage import written


def param_space(spark: SparkSession, grid: dict[str, list | DataFrame]) -> DataFrame:
    """One row per combination, columns in key order. A grid has lists of values, or tables of one column of that name."""
    one = [vs if isinstance(vs, DataFrame) else spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in grid.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one)


def name_params(name: Column) -> Column:
    """key~value pieces, split by _, of a file name's stem, as a map; pieces without ~ are skipped."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    pieces = F.filter(F.split(stem, "_"), lambda p: F.contains(p, F.lit("~")))
    return F.map_from_entries(F.transform(pieces, lambda p: F.struct(F.split(p, "~")[0].alias("k"), F.split(p, "~")[1].alias("v"))))


def decoded(files: DataFrame, names: list[str], column: str = "filename") -> DataFrame:
    params = name_params(F.col(column))
    return files.select("*", *[F.try_element_at(params, F.lit(n)).alias(n) for n in names])


def concat_results(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def filtered(table: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose value is wanted or missing, for every column that exists."""
    for c, values in wanted.items():
        if c in table.columns:
            table = table.where(F.col(c).isin(values) | F.col(c).isNull())
    return table


def read_results(spark: SparkSession, paths: list[str] | str, params: list[str]) -> DataFrame:
    """Score CSVs with the parameters that their file names hold."""
    paths = sorted(set(paths)) if isinstance(paths, list) else paths  # a file that is named twice is read once
    x = spark.read.csv(paths, header=True, inferSchema=True).withColumn("filename", F.col("_metadata.file_path"))
    return decoded(x, params)


def mean_and_interval(table: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """n, mean, and the 95 % normal interval of the mean."""
    half = 1.96 * F.coalesce(F.try_divide(F.stddev_samp(score), F.sqrt(F.count(score).cast("double"))), F.lit(0.0))
    return table.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean_score"), (F.avg(score) - half).alias("low"), (F.avg(score) + half).alias("high"))


def quantiles(table: DataFrame, by: list[str], score: str, shares: list[float]) -> DataFrame:
    """(by..., quantiles): of each group's values, exactly, between neighbours in proportion; null values are left out, and
    groups with a null in `by`.

    Distinct values with their numbers of rows are counted through ranges of (group, value), so that a group of any size is
    spread over many tasks and no task holds its values; only the rows at the cuts are fetched.
    """
    return _cut(_counted(table, by, score), by, shares)


def _counted(table: DataFrame, by: list[str], score: str) -> DataFrame:
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, score]])
    return written(table.where(there).groupBy(*by, F.col(score).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "values")


def _cut(values: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    rows = running(values.select(F.struct(*by).alias("_by"), "_v", "_n"), "_by", ["_v"], {"_to": F.col("_n")}, before_too=True)
    sizes = values.groupBy(F.struct(*by).alias("_by")).agg(F.sum("_n").alias("_all"))
    rows = rows.join(sizes, "_by")
    at = [F.lit(p) * (F.col("_all") - 1) for p in shares]
    held = lambda k: (F.col("_to_before") <= k) & (k < F.col("_to"))
    ends = [(F.floor(k), F.ceil(k)) for k in at]
    rows = rows.where(reduce(lambda a, b: a | b, [held(e) for pair in ends for e in pair]))
    found = [F.max(F.when(held(e), F.col("_v"))).alias(f"_{side}{i}") for i, pair in enumerate(ends) for side, e in zip("lh", pair)]
    got = rows.groupBy("_by", "_all").agg(*found)
    cut = lambda i: F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise((ends[i][1] - at[i]) * F.col(f"_l{i}") + (at[i] - ends[i][0]) * F.col(f"_h{i}"))
    return got.select(*[F.col("_by")[c].alias(c) for c in by], F.array(*[cut(i) for i in range(len(shares))]).alias("quantiles"))


def box_summary(table: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Quartiles, and whiskers at the furthest values within 1.5 interquartile ranges; see quantiles."""
    values = _counted(table, by, score)
    q = F.col("quantiles")
    x = values.join(_cut(values, by, [0.25, 0.5, 0.75]), by).withColumn("reach", 1.5 * (q[2] - q[0]))
    inside = F.when(F.col("_v").between(q[0] - F.col("reach"), q[2] + F.col("reach")), F.col("_v"))
    return x.groupBy(*by).agg(F.first(q[0]).alias("q1"), F.first(q[1]).alias("median"), F.first(q[2]).alias("q3"), F.min(inside).alias("low"), F.max(inside).alias("high"))


def with_any_score(table: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Rows of groups that have a score at all."""
    good = table.groupBy(*by).agg(F.count(score).alias("k")).where("k > 0").select(*by)
    return table.join(good, by, "left_semi")


def without_names(table: DataFrame, names: tuple[str, ...] = ("levy-word2vec",)) -> DataFrame:
    """Rows of other models; rows without a name stay."""
    return table.where(F.col("name").isNull() | ~F.col("name").isin(*names))


def direct_as_clustering(table: DataFrame, name: str = "community-detection") -> DataFrame:
    """Detectors that need no clustering, as a clustering of that name."""
    return table.withColumn("clustering", F.coalesce("clustering", F.lit(name)))


def focal(table: DataFrame, clustering: str, score_type: str = "esim", direct: str = "community-detection") -> DataFrame:
    """Scores of one kind, of one clustering or direct ones, in the plain variant (or none)."""
    plain = F.col("normalize").isNull() | (~F.col("normalize") & ~F.coalesce("dimThreshold", F.lit(False)))
    return table.where(F.col("clustering").isin(direct, clustering) & (F.col("score_type") == score_type) & plain)


def typed(table: DataFrame, to_double: list[str], to_long: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Columns that hold numbers as such: to_double, then to_long, where every value that is there can be; columns that
    hold other text stay, with missing values as empty text. renamed: new names at the end."""
    for columns, kind in ((to_double, "double"), (to_long, "bigint")):
        columns = [c for c in columns if c in table.columns]
        if not columns:
            continue
        fits = {c: F.col(c).try_cast("double") for c in columns}
        good = {c: v.isNotNull() if kind == "double" else v.isNotNull() & (v == F.floor(v)) for c, v in fits.items()}
        row = table.agg(*[F.coalesce(F.bool_and(F.col(c).isNull() | good[c]), F.lit(True)).alias(c) for c in columns]).first()
        kinds = dict(table.dtypes)
        table = table.withColumns({c: fits[c].cast(kind) if row[c] else F.coalesce(c, F.lit("")) for c in columns if row[c] or kinds[c] == "string"})
    return table.withColumnsRenamed(renamed or {})


#: Models in the order of reports: key, display name, group.
STYLES = (
    ("node2vec", "node2vec", "neural"), ("deepwalk", "DeepWalk", "neural"), ("line", "LINE", "neural"), ("depthfirst-node2vec", "node2vec, depth first", "neural"),
    ("leigenmap", "Laplacian EigenMap", "spectral"), ("adjspec", "Adjacency", "spectral"), ("modspec", "Modularity", "spectral"), ("linearized-node2vec", "Linearized node2vec", "spectral"), ("nonbacktracking", "Non-backtracking", "spectral"),
    ("infomap", "Infomap", "direct"), ("flatsbm", "Flat SBM", "direct"), ("bp", "Belief propagation", "direct"),
)


def styles(spark: SparkSession) -> DataFrame:
    """(name, rank, display, kind): the dimension table of models."""
    return spark.createDataFrame([(k, n, d, g) for n, (k, d, g) in enumerate(STYLES)], "name string, rank int, display string, kind string")


def in_model_order(table: DataFrame) -> DataFrame:
    """Rows of known models, with their display names, in the order of reports."""
    return table.join(F.broadcast(styles(table.sparkSession)), "name").orderBy("rank")


def expand(spark: SparkSession, pattern: str, grid: dict[str, list]) -> DataFrame:
    """(filename, ...): the pattern's {key}s filled in for every combination."""
    space = param_space(spark, grid)
    name = F.lit(pattern)
    for k in grid:
        name = F.replace(name, F.lit("{" + k + "}"), F.col(k).cast("string"))
    return space.withColumn("filename", name)


#: The workload's parameter grids (fixed values).
GRIDS = {
    "embedding": {"model_name": ["node2vec", "deepwalk", "line", "leigenmap", "adjspec", "modspec", "nonbacktracking"], "window_length": [10], "dim": [16, 64, 128]},
    "detection": {"model_name": ["infomap", "flatsbm", "bp"]},
    "clustering": {"metric": ["cosine"], "clustering": ["voronoi", "kmeans", "silhouette"]},
    "planted": {"n": [10_000, 100_000], "q": [2, 50], "cave": [5, 10, 50], "mu": [round(0.1 + 0.05 * k, 2) for k in range(19)], "sample": list(range(30))},
    "lfr": {"n": [10_000], "k": [5, 10, 50], "tau": [3], "tau2": [1], "minc": [50], "mu": [round(0.1 + 0.05 * k, 2) for k in range(19)], "sample": list(range(30))},
}
