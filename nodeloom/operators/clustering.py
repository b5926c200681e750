"""Node clustering on embeddings(node_id, emb): normal forms, nearest centroid, k-means, silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.storage import written

MAX_CENTROID_CELLS = 4_000_000


def long_form(table: DataFrame) -> DataFrame:
    """(node_id, pos, v), for rows with an embedding."""
    return table.where(F.col("emb").isNotNull()).select("node_id", F.posexplode("emb").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def column_norms(table: DataFrame) -> DataFrame:
    return long_form(table).groupBy("pos").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def dim_threshold(table: DataFrame) -> DataFrame:
    """Columns of spectral use: norm at least the root of the largest norm, the leading one dropped; it alone if none is left."""
    norms = column_norms(table)
    top = norms.agg(F.max("norm").alias("top"), F.max_by("pos", F.struct("norm", -F.col("pos"))).alias("lead"))
    kept = norms.crossJoin(F.broadcast(top)).where((F.col("norm") >= F.sqrt("top")) & (F.col("pos") != F.col("lead")))
    alone = top.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("k"))), F.lit(True)).where("k = 0").select(F.col("lead").alias("pos"))
    return kept.select("pos").union(alone)


def normalize_columns(table: DataFrame) -> DataFrame:
    """Every column over its Euclidean norm, floored at 1e-32. Norms (one per column) are broadcast as one array."""
    norms = column_norms(table).agg(F.array_sort(F.collect_list(F.struct("pos", "norm")))["norm"].alias("norms"))
    return table.crossJoin(F.broadcast(norms)).withColumn("emb", F.zip_with(F.col("emb").cast("array<double>"), "norms", lambda v, n: v / F.greatest(n, F.lit(1e-32)))).drop("norms")


def centroids(table: DataFrame, label: str = "membership", how: str = "sum") -> DataFrame:
    """(label, centroid) per community: sums by default, which is what nearest-centroid by cosine needs, or means."""
    x = table.where(F.col("emb").isNotNull() & F.col(label).isNotNull()).select(label, F.posexplode("emb").alias("pos", "v"))
    agg = {"sum": F.sum, "mean": F.avg}[how](F.col("v").cast("double"))
    x = x.groupBy(label, "pos").agg(agg.alias("v"))
    return x.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "v")))["v"].alias("centroid"))


def nearest_centroid(table: DataFrame, label: str = "membership", metric: str = "cosine", how: str = "sum") -> DataFrame:
    """(node_id, label, found): the community whose centroid is most alike, ties to the least label.

    Zero vectors have no cosine: found is null. Centroids are at most MAX_CENTROID_CELLS numbers, checked; nodes
    stream past them in Arrow batches.
    """
    middle = written(centroids(table, label, how), "centroids")
    _check_cells(middle.agg(F.sum(F.size("centroid"))).first()[0])
    rows = middle.orderBy(label).collect()
    names = [r[0] for r in rows]
    c = np.array([r[1] for r in rows], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float)
            if not len(x):
                continue
            if metric == "cosine":
                norm, cn = np.sqrt((x * x).sum(1)), np.sqrt((c * c).sum(1))
                near = (x @ c.T) / np.where(norm > 0, norm, 1)[:, None] / np.where(cn > 0, cn, 1)
                near[:, cn == 0] = -2
                void = norm == 0
            else:
                near = x @ c.T if metric == "dotsim" else -((x[:, None, :] - c[None]) ** 2).sum(2)
                void = np.zeros(len(x), bool)
            best = near.argmax(1).tolist()
            found = pa.array([None if v else names[k] for k, v in zip(best, void.tolist())], batch.column(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["node_id", label, "found"])

    given = table.where(F.col("emb").isNotNull()).select("node_id", F.col(label), F.col("emb").cast("array<double>").alias("emb"))
    kind = given.schema[label].dataType.simpleString()
    if not names:
        return given.select("node_id", label, F.lit(None).cast(kind).alias("found"))
    return given.mapInArrow(run, f"node_id {given.schema['node_id'].dataType.simpleString()}, {label} {kind}, found {kind}")


def keep_columns(table: DataFrame, kept: DataFrame) -> DataFrame:
    """The embedding's columns at the positions kept(pos), in order; a row per column goes along."""
    packed = kept.agg(F.array_sort(F.collect_list("pos")).alias("kept"))
    return table.crossJoin(F.broadcast(packed)).withColumn("emb", F.transform("kept", lambda p: F.col("emb")[p])).drop("kept")


def fill_missing(table: DataFrame, dim: int) -> DataFrame:
    """Nodes without an embedding as zero vectors."""
    return table.withColumn("emb", F.coalesce(F.col("emb").cast("array<double>"), F.array_repeat(F.lit(0.0), dim)))


def variants(table: DataFrame, threshold: bool = False, always: bool = False) -> dict[tuple[bool, bool], DataFrame]:
    """The embedding in its four forms, by (normalize, dim_threshold). threshold: the model has columns to drop; else the
    second flag changes nothing. always: the threshold holds whatever the flag, as nearest centroids do."""
    out = {}
    for dims in (False, True):
        x = keep_columns(table, dim_threshold(table)) if threshold and (dims or always) else table
        out |= {(False, dims): x, (True, dims): normalize_columns(x)}
    return out


def clustered_variants(table: DataFrame, cluster, threshold: bool = False, always: bool = False) -> DataFrame:
    """(node_id, normalize, dim_threshold, group_id): cluster(embedding) -> (node_id, group_id) of the four forms."""
    out = None
    for (normal, dims), x in variants(table, threshold, always).items():
        found = cluster(x).select("node_id", F.lit(normal).alias("normalize"), F.lit(dims).alias("dim_threshold"), F.col("group_id").cast("long").alias("group_id"))
        out = found if out is None else out.union(found)
    return out


def voronoi(table: DataFrame, metric: str = "cosine") -> DataFrame:
    return nearest_centroid(table, metric=metric).select("node_id", F.col("found").alias("group_id"))


def best_silhouette(table: DataFrame, most: int = 20, restarts: int = 10, spectral: bool = False) -> DataFrame:
    """(node_id, group_id) of k-means with the k of the best silhouette; spectral embeddings then keep their first k - 1
    columns. Nodes without an embedding are zero vectors, and get a group too."""
    row = silhouette_by_k(table, most, restarts=restarts).agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).first()
    k = row[0] or 1
    dim = table.where(F.col("emb").isNotNull()).agg(F.max(F.size("emb"))).first()[0] or 1
    x = fill_missing(table, dim)
    x = x.withColumn("emb", F.slice("emb", 1, max(k - 1, 1))) if spectral else x
    return kmeans(x, k) if k > 1 else x.select("node_id", F.lit(0).alias("group_id"))


#: Clusterings of an embedding(node_id, membership, emb) by name.
CLUSTERINGS = {"voronoi": voronoi, "kmeans": lambda x: kmeans(x, x.agg(F.max("membership") + 1).first()[0]), "silhouette": best_silhouette}


def _features(table: DataFrame) -> DataFrame:
    return table.where(F.col("emb").isNotNull()).withColumn("features", array_to_vector(F.col("emb").cast("array<double>")))


def kmeans(table: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(node_id, group_id) by k-means on all rows."""
    x = _features(table)
    return KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select("node_id", F.col("prediction").alias("group_id"))


def lloyd(table: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """k-means from given seed centroids (membership, emb), a fixed number of rounds, ties to the least group."""
    start = seeds.select("membership", "emb")
    _check_cells(start.agg(F.sum(F.size("emb"))).first()[0])
    labels = _assign(table, [(r[0], r[1]) for r in start.orderBy("membership").collect()])
    for _ in range(rounds):
        means = centroids(table.join(labels, "node_id"), "group_id", "mean").orderBy("group_id").collect()
        labels = _assign(table, [(r[0], r[1]) for r in means])
    return labels


def _check_cells(n: int | None) -> None:
    if (n or 0) > MAX_CENTROID_CELLS:
        raise ValueError("the centroids are too many to send to every task")


def _assign(table: DataFrame, groups: list) -> DataFrame:
    names, c = [g for g, _ in groups], np.array([v for _, v in groups], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float)
            if len(x):
                best = np.stack([((x - y) ** 2).sum(1) for y in c]).argmin(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[k] for k in best.tolist()], pa.int64())], names=["node_id", "group_id"])

    given = table.where(F.col("emb").isNotNull()).select("node_id", F.col("emb").cast("array<double>").alias("emb"))
    return given.mapInArrow(run, "node_id long, group_id long")


def silhouette_by_k(table: DataFrame, most: int = 20, seed: int = 0, restarts: int = 10) -> DataFrame:
    """(k, silhouette) by cosine for k = 2..min(most, n - 1), of the k-means of least cost over `restarts` starts.

    Missing and zero embeddings are left out, also of n. A k whose best k-means has one group only has no row; with
    fewer than three embeddings there is none at all. All k and starts go on together: a round reads the table once,
    whatever their number, and gives back sums for each centroid. Their centroids are sent to every task, which is checked.
    """
    spark = table.sparkSession
    v = F.col("emb").cast("array<double>")
    x = table.where(F.exists("emb", lambda e: e != 0)).select(F.xxhash64(F.lit(seed), "node_id").alias("h"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    x = written(x.select("h", F.transform("v", lambda e: e / norm).alias("v")), "units")
    n, dim = x.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    ks = range(2, min(most, n - 1) + 1)
    kind = "k int, silhouette double"
    if not ks:
        return spark.createDataFrame([], kind)
    _check_cells(restarts * sum(ks) * dim)
    starts = _spread_seeds(x, ks[-1], restarts)
    models = {(k, s): starts[s, :k] for k in ks for s in range(restarts)}
    cost, open_ = {}, list(models)
    for _ in range(300):
        found = _tally(x, [models[m] for m in open_])
        moved = []
        for m, (count, spent, sums) in zip(open_, found):
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            now = np.where((count[:, None] > 0) & (size > 0), sums / np.where(size > 0, size, 1), models[m])  # an empty group stays
            if np.linalg.norm(now - models[m], axis=1).max() > 1e-4:
                moved.append(m)
                models[m] = now
            cost[m] = spent
        open_ = moved
        if not open_:
            break
    best = [min((m for m in models if m[0] == k), key=lambda m: (cost[m], m[1])) for k in ks]
    last = [(m, models[m], *t) for m, t in zip(best, _tally(x, [models[m] for m in best])) if (t[0] > 0).sum() > 1]
    worth = _silhouettes(x, [(c, count, sums) for _, c, count, _, sums in last]) if last else []
    return spark.createDataFrame([(m[0], w / n) for (m, *_), w in zip(last, worth)], kind)


def _spread_seeds(x: DataFrame, k: int, restarts: int) -> np.ndarray:
    """restarts x k x dim: each seed is drawn with a chance in proportion to its distance from those before, in one pass
    for all starts; the first k seeds of a start serve every smaller k too."""
    seeds: list[list] = [[] for _ in range(restarts)]
    for at in range(k):
        chosen = np.array(seeds, float) if at else None

        def run(batches: Iterator[pa.RecordBatch], at: int = at, chosen: np.ndarray | None = chosen) -> Iterator[pa.RecordBatch]:
            top: dict[int, tuple] = {}
            for batch in (b for b in batches if b.num_rows):
                u, h = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(0).to_numpy().view(np.uint64)
                for s in range(restarts):
                    weight = np.ones(len(u)) if chosen is None else np.maximum(1 - (u @ chosen[s].T).max(1), 0)
                    z = h + np.uint64(((at * restarts + s + 1) * 0x9E3779B97F4A7C15) % 2**64)  # a mix of bits (fixed constants)
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    draw = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5
                    key = np.where(weight > 1e-12, np.log(draw / 2**53) / np.maximum(weight, 1e-12), -np.inf)
                    i = int(key.argmax())
                    if s not in top or key[i] > top[s][0]:
                        top[s] = (float(key[i]), u[i].tolist())
            if top:
                yield pa.RecordBatch.from_pydict({"s": list(top), "key": [t[0] for t in top.values()], "v": [t[1] for t in top.values()]})

        drawn = x.mapInArrow(run, "s long, key double, v array<double>").groupBy("s").agg(F.max(F.struct("key", "v"))["v"].alias("v"))
        for s, v in drawn.collect():
            seeds[s].append(v)
    return np.array(seeds, float)


def _tally(x: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """Per model (a matrix of centroids): its groups' sizes, the sum of cosine distances, and its groups' sums, in one pass."""
    stack, dim = np.concatenate(models), models[0].shape[1]
    ends = np.cumsum([0] + [len(m) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cost, sums = np.zeros(len(stack), np.int64), np.zeros(len(stack)), np.zeros_like(stack)
        for batch in (b for b in batches if b.num_rows):
            u = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            near = u @ stack.T
            for low, high in zip(ends[:-1], ends[1:]):
                mine = near[:, low:high]
                own = mine.argmax(1)
                one = (own[:, None] == np.arange(high - low)).astype(float)
                count[low:high] += one.sum(0).astype(np.int64)
                cost[low:high] += (one * (1 - mine)).sum(0)
                sums[low:high] += one.T @ u
        at = np.flatnonzero(count)
        if len(at):
            yield pa.RecordBatch.from_pydict({"at": at, "n": count[at], "cost": cost[at], "v": sums[at].tolist()})

    rows = x.mapInArrow(run, "at long, n long, cost double, v array<double>").groupBy("at")
    rows = rows.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("v")[c]) for c in range(dim)]).alias("v")).collect()
    count, cost, sums = np.zeros(len(stack), np.int64), np.zeros(len(stack)), np.zeros_like(stack)
    for at, n, spent, v in rows:
        count[at], cost[at], sums[at] = n, spent, v
    return [(count[a:b], float(cost[a:b].sum()), sums[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _silhouettes(x: DataFrame, models: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[float]:
    """Per (centroids, sizes, sums of unit vectors): the sum of silhouettes by cosine. The mean distance to a group follows
    from its sum, so points never meet each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(len(models)), False
        for batch in (b for b in batches if b.num_rows):
            u, some = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), True
            for at, (middle, count, sums) in enumerate(models):
                own = (u @ middle.T).argmax(1)
                rows = np.arange(len(u))
                far = np.where(count > 0, 1 - u @ sums.T / np.maximum(count, 1), np.inf)
                size = count[own]
                a = far[rows, own] * size / np.maximum(size - 1, 1)
                far[rows, own] = np.inf
                b = far.min(1)
                top = np.maximum(a, b)
                total[at] += np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0).sum()
        if some:
            yield pa.RecordBatch.from_pydict({"at": range(len(models)), "s": total})

    got = {r.at: r.s for r in x.mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    return [got[at] for at in range(len(models))]
