"""Spectral embeddings of graphs, and the eigenpairs under them, as joins and aggregates over the edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.scalars import uniform
from nodeloom.operators.structure import cut_lineage, degrees, walk_pmi


SMALL = 64


def symmetric_normal(edges: DataFrame) -> DataFrame:
    """D^-1/2 A D^-1/2 in long form."""
    d = degrees(edges).select("node_id", "strength")
    x = edges.join(d.select(F.col("node_id").alias("src"), F.col("strength").alias("a")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("strength").alias("b")), "dst")
    return x.select("src", "dst", (F.col("weight") / F.sqrt(F.greatest("a", F.lit(1.0)) * F.greatest("b", F.lit(1.0)))).alias("weight"))


def nonbacktracking_matrix(edges: DataFrame) -> DataFrame:
    """[[0, D - I], [-I, A]] in long form: node i is row 2 i of the upper half and 2 i + 1 of the lower."""
    d = degrees(edges).select("node_id", "strength")
    up, low = F.col("node_id") * 2, F.col("node_id") * 2 + 1
    halves = d.select(up.alias("src"), low.alias("dst"), (F.col("strength") - 1).alias("weight")).union(d.select(low.alias("src"), up.alias("dst"), F.lit(-1.0).alias("weight")))
    return halves.union(edges.select((F.col("src") * 2 + 1).alias("src"), (F.col("dst") * 2 + 1).alias("dst"), F.col("weight").cast("double").alias("weight")))


def _grams(table: DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """x'x, x'y and y'y of columns x, y (arrays of that width): partial sums per task, added up by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width, width))
        for batch in batches:
            x, y = (np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width) for c in (0, 1))
            total += np.stack((x.T @ x, x.T @ y, y.T @ y))
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "v"])

    rows = table.select("x", "y").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(3 * width * width)
    for r in rows:
        out[r["cell"]] = r["v"]
    return tuple(out.reshape(3, width, width))


def _times(table: DataFrame, column: str, by: np.ndarray, name: str) -> DataFrame:
    """node_id, and column (arrays) times the small matrix `by`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, by.shape[0]) @ by
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * by.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], names=["node_id", name])

    return table.select("node_id", column).mapInArrow(run, f"node_id long, {name} array<double>")


def eigenpairs(matrix: DataFrame, k: int, which: str = "LM", symmetric: bool = True, rank_one: tuple[DataFrame, float] | None = None, tolerance: float = 1e-9, cycles: int = 12, steps: int = 6) -> tuple[np.ndarray, DataFrame]:
    """(values, vectors(node_id, emb)): the k eigenpairs of largest magnitude (LM) or largest real part (LR).

    matrix(src, dst, weight) is in long form; rank_one = (d(node_id, value), c) adds c d d', which is never formed.
    Block Krylov: from a block of k + 4 hash-random vectors, `steps` products with the matrix make a basis (an array
    column); the small projected problem on the driver, of a few hundred numbers squared, gives the pairs, and cycles
    start over from these until every residual is under tolerance times the largest value, or what rounding leaves of its
    own value. The basis holds both ends of the spectrum, and `which` picks.

    A product is one join and one aggregate over the edges. Real parts are returned, vectors with norm 1 whose largest
    component (ties: of the least node) is positive; fewer than k if the matrix is smaller. Rows are all nodes with
    an entry.
    """
    matrix = cut_lineage(matrix.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    rows = cut_lineage(matrix.select(F.col("src").alias("node_id")).union(matrix.select(F.col("dst").alias("node_id"))).distinct())
    n = rows.count()
    k = min(k, n)
    block = n if n <= SMALL else k + 4  # a block of all columns is the whole space
    steps = max(1, min(steps, -(-n // block)))
    start = cut_lineage(rows.select("node_id", F.array(*[uniform("eig", F.col("node_id"), F.lit(c)) - 0.5 for c in range(block)]).alias("x")))

    def image(x: DataFrame, width: int) -> DataFrame:
        """(node_id, y): the matrix times column x."""
        y = matrix.join(x.select(F.col("node_id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("node_id"))
        y = y.agg(*[F.sum(F.col("weight") * F.col("x")[c]).alias(f"y{c}") for c in range(width)])
        more = [F.lit(0.0)] * width
        y = x.join(y, "node_id", "left")
        if rank_one:
            d, factor = rank_one
            dots = x.join(d, "node_id").agg(*[F.sum(F.col("value") * F.col("x")[c]) for c in range(width)]).first()
            y = y.join(d, "node_id", "left")
            more = [F.coalesce("value", F.lit(0.0)) * float((dots[c] or 0.0) * factor) for c in range(width)]
        return y.select("node_id", "x", F.array(*[F.coalesce(f"y{c}", F.lit(0.0)) + more[c] for c in range(width)]).alias("y"))

    def orthonormal(x: DataFrame, width: int) -> tuple[DataFrame, int]:
        """Columns that span x's columns, less those that depend on others."""
        for _ in range(2):  # once more for what rounding left
            gram = _grams(x.select("node_id", "x", F.col("x").alias("y")), width)[0]
            scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
            s, u = np.linalg.eigh(gram * np.outer(scale, scale))
            good = s > 1e-11 * s.max()
            x = cut_lineage(_times(x, "x", scale[:, None] * u[:, good] / np.sqrt(s[good]), "x"))
            width = int(good.sum())
        return x, width

    values, kept = np.zeros(0), block
    for _ in range(cycles):
        now, basis = start, start
        for _ in range(steps - 1):
            y = image(now, block)
            norms = y.agg(*[F.sqrt(F.sum(F.col("y")[c] * F.col("y")[c])) for c in range(block)]).first()
            now = cut_lineage(y.select("node_id", F.array(*[F.col("y")[c] / float(norms[c] or 1.0) for c in range(block)]).alias("x")))
            basis = basis.join(now.withColumnRenamed("x", "z"), "node_id").select("node_id", F.concat("x", "z").alias("x"))
        basis, width = orthonormal(cut_lineage(basis), block * steps)
        both = cut_lineage(image(basis, width))
        gram, small, square = _grams(both, width)
        project = np.linalg.solve(gram, small)
        if symmetric:
            values, turn = np.linalg.eigh((project + project.T) / 2)
        else:
            values, turn = np.linalg.eig(project)
        order = np.argsort(-(np.abs(values) if which == "LM" else values.real), kind="stable")[:kept]
        values, turn = values[order], turn[:, order]
        real = np.real(turn) if symmetric else np.concatenate((np.real(turn), np.imag(turn)), axis=1)
        residual = [np.linalg.norm(_root(square, small, gram, values[c], turn[:, c])) for c in range(min(k, len(values)))]
        found, m = _times(both, "x", np.real(turn)[:, :k], "x"), min(k, len(values))
        if width >= n or all(r <= max(tolerance * np.abs(values).max(), 4e-8 * abs(v)) for r, v in zip(residual, values)):
            break
        start, block = orthonormal(cut_lineage(_times(both, "x", real, "x")), real.shape[1])
    found = cut_lineage(found)
    norms = found.agg(*[F.sqrt(F.sum(F.col("x")[c] * F.col("x")[c])) for c in range(m)]).first()
    tops = found.agg(*[F.max_by(F.signum(F.col("x")[c]), F.struct(F.round(F.abs(F.col("x")[c]) / float(norms[c] or 1.0), 6), -F.col("node_id"))) for c in range(m)]).first()
    signed = [F.col("x")[c] * float((tops[c] or 1.0) / (norms[c] or 1.0)) for c in range(m)]
    return np.real(values[:m]), cut_lineage(found.select("node_id", F.array(*signed).alias("emb")))


def _root(square: np.ndarray, small: np.ndarray, gram: np.ndarray, value: complex, v: np.ndarray) -> np.ndarray:
    """|y v - value x v| from the Gram matrices, as a 1-vector."""
    v = v.astype(complex)
    size = (v.conj() @ square @ v - np.conj(value) * (v.conj() @ small @ v) - value * (v.conj() @ small.T @ v) + abs(value) ** 2 * (v.conj() @ gram @ v)).real
    return np.array([np.sqrt(max(size, 0.0) / max((v.conj() @ gram @ v).real, 1e-300))])


def rayleigh(matrix: DataFrame, embedding: DataFrame) -> DataFrame:
    """(pos, value) of x' M x per column of the embedding, each over its norm first (floored at 1e-12)."""
    long = embedding.where(F.col("emb").isNotNull()).select("node_id", F.posexplode("emb").alias("pos", "v"))
    norms = long.groupBy("pos").agg(F.sum(F.col("v") * F.col("v")).alias("n2"))
    a, b = long.select(F.col("node_id").alias("src"), "pos", F.col("v").alias("a")), long.select(F.col("node_id").alias("dst"), "pos", F.col("v").alias("b"))
    form = matrix.join(a, "src").join(b, ["dst", "pos"]).groupBy("pos").agg(F.sum(F.col("weight") * F.col("a") * F.col("b")).alias("f"))
    return norms.join(form, "pos", "left").select("pos", (F.coalesce("f", F.lit(0.0)) / F.greatest("n2", F.lit(1e-24))).alias("value"))


def shave(embedding: DataFrame, k: int, matrix: DataFrame | None = None) -> DataFrame:
    """The k - 1 columns with the largest Rayleigh value under the matrix, largest first; without one, the first k - 1."""
    if matrix is None:
        return embedding.select("node_id", F.slice("emb", 1, max(k - 1, 1)).alias("emb"))
    top = rayleigh(matrix, embedding).orderBy(F.desc("value"), "pos").limit(k - 1).collect()
    return embedding.select("node_id", F.array(*[F.col("emb")[r["pos"]] for r in top]).alias("emb"))


def mean_relative_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """Mean of |new - old| / max(|old|, 1e-12) over (node_id, value) tables."""
    old = before.select("node_id", F.col("value").alias("old"))
    return now.join(old, "node_id").agg(F.avg(F.abs(F.col("value") - F.col("old")) / F.greatest(F.abs("old"), F.lit(1e-12))).alias("change"))


def effective_dim(dim: int, n: int, n_labels: int, n_component: int) -> int:
    """The dimension that an embedding is made with: 0 asks for min(n - 1, labels - 1), and at most nodes - 2 of the
    component are possible; under 1 there is none."""
    wanted = min(n - 1, n_labels - 1) if dim == 0 else dim
    return max(0, min(wanted, n_component - 2))


class NodeEmbedding:
    """fit(edges), then transform(dim): (node_id, emb), made once per dim. out_vectors(dim): the context vectors of
    models that have them, else the same."""

    shaves = True

    def __init__(self) -> None:
        self._made: dict[int, DataFrame] = {}

    def fit(self, edges: DataFrame) -> NodeEmbedding:
        weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
        self.edges = edges.select("src", "dst", weight.cast("double").alias("weight"))
        self._made = {}
        return self

    def transform(self, dim: int) -> DataFrame:
        if dim not in self._made:
            self._made[dim] = self.make(dim)
        return self._made[dim]

    def out_vectors(self, dim: int) -> DataFrame:
        return self.transform(dim)

    def make(self, dim: int) -> DataFrame:
        raise NotImplementedError

    def criterion(self) -> DataFrame:
        """The matrix by which shave_embedding ranks columns."""
        return symmetric_normal(self.edges)

    def shave_embedding(self, dim: int, k: int) -> DataFrame:
        """The k - 1 columns of most use for k groups."""
        return shave(self.transform(dim), k, self.criterion() if self.shaves else None)


class LaplacianEigenMap(NodeEmbedding):
    """D^-1/2 u sqrt|s| of the normalised adjacency's algebraically largest pairs, the first dropped; the out-vectors are
    u. With reconstruction, the in-vectors are u too, the first included."""

    def __init__(self, reconstruction: bool = False):
        super().__init__()
        self.reconstruction = reconstruction

    def out_vectors(self, dim: int) -> DataFrame:
        first = 1 if self.reconstruction else 2
        return eigenpairs(symmetric_normal(self.edges), dim + first - 1, "LR")[1].select("node_id", F.slice("emb", first, dim).alias("emb"))

    def make(self, dim: int) -> DataFrame:
        if self.reconstruction:
            return self.out_vectors(dim)
        s, v = eigenpairs(symmetric_normal(self.edges), dim + 1, "LR")
        x = v.join(degrees(self.edges).select("node_id", "strength"), "node_id")
        return x.select("node_id", F.array(*[F.col("emb")[k] * float(np.sqrt(abs(s[k]))) / F.sqrt(F.greatest("strength", F.lit(1.0))) for k in range(1, len(s))]).alias("emb"))


class AdjacencySpectral(NodeEmbedding):
    """u s^2 of the adjacency matrix's leading pairs."""

    def make(self, dim: int) -> DataFrame:
        s, v = eigenpairs(self.edges, dim)
        return v.select("node_id", F.array(*[F.col("emb")[k] * float(s[k] ** 2) for k in range(len(s))]).alias("emb"))

    def criterion(self) -> DataFrame:
        return self.edges


class ModularitySpectral(NodeEmbedding):
    """u sqrt|s| of the leading pairs of A / 2m - d d' / (2m)^2, which is never formed."""

    def make(self, dim: int) -> DataFrame:
        d = cut_lineage(degrees(self.edges).select("node_id", F.col("strength").alias("value")))
        two_m = d.agg(F.sum("value")).first()[0]
        s, v = eigenpairs(self.edges.withColumn("weight", F.col("weight") / two_m), dim, rank_one=(d, -1.0 / two_m**2))
        return v.select("node_id", F.array(*[F.col("emb")[k] * float(np.sqrt(abs(s[k]))) for k in range(len(s))]).alias("emb"))

    def criterion(self) -> DataFrame:
        return self.edges


class LinearizedNode2Vec(NodeEmbedding):
    """The algebraically largest pairs of the normalised adjacency, |s| -> s (1 - s^T) / (T (1 - s)). Every pair whose |s| is the
    largest goes, so each component of a graph that falls apart loses its constant vector."""

    def __init__(self, window: int = 10):
        super().__init__()
        self.window = window

    def make(self, dim: int) -> DataFrame:
        s, v = eigenpairs(symmetric_normal(self.edges), dim + 1, "LR")
        size, t = np.abs(s), self.window
        keep = [k for k in range(len(s)) if size[k] < size.max() - 1e-7]
        f = [size[k] * (1 - size[k] ** t) / (t * (1 - size[k])) if t > 1 else size[k] for k in keep]
        return v.select("node_id", F.array(*[F.col("emb")[k] * float(np.sqrt(abs(x))) for k, x in zip(keep, f)]).cast("array<double>").alias("emb"))


class NonBacktrackingSpectral(NodeEmbedding):
    """Lower halves of the eigenvectors of [[0, D - I], [-I, A]] with norm 1, times sqrt|s|, the largest dropped. auto_dim: all
    pairs beyond the square root of the largest, unweighted; estimated_clusters counts those on the real axis."""

    shaves = False

    def __init__(self, auto_dim: bool = False, most: int = 20):
        super().__init__()
        self.auto_dim, self.most, self.estimated_clusters = auto_dim, most, None

    def make(self, dim: int) -> DataFrame:
        k = self.most if self.auto_dim else dim + 1
        s, v = eigenpairs(nonbacktracking_matrix(self.edges), k, symmetric=False, tolerance=1e-4)
        self.estimated_clusters = int((s > np.sqrt(s.max())).sum()) - 1
        keep = [c for c in range(len(s)) if not self.auto_dim or abs(s[c]) > np.sqrt(s.max())][1:]
        low = cut_lineage(v.where("node_id % 2 = 1").select(F.floor(F.col("node_id") / 2).alias("node_id"), "emb"))
        norms = low.agg(*[F.sqrt(F.sum(F.col("emb")[c] * F.col("emb")[c])) for c in keep]).first() if keep else []
        cells = [F.col("emb")[c] * float((1.0 if self.auto_dim else np.sqrt(abs(s[c]))) / (n or 1.0)) for c, n in zip(keep, norms)]
        return low.select("node_id", F.array(*cells).cast("array<double>").alias("emb"))


class WalkMatrixFactorization(NodeEmbedding):
    """u s sqrt(s) of the leading pairs of log of the mean T-step walk over the stationary law (a symmetric matrix)."""

    def __init__(self, window: int = 10):
        super().__init__()
        self.window = window

    def make(self, dim: int) -> DataFrame:
        s, v = eigenpairs(walk_pmi(self.edges, self.window).withColumnRenamed("pmi", "weight"), dim + 1)
        return v.select("node_id", F.array(*[F.col("emb")[k] * float(abs(s[k]) ** 1.5) for k in range(len(s))]).alias("emb"))
