"""Embeddings that are trained on random walks, and the registry of all embedding models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.scalars import uniform
from nodeloom.operators import spectral
from nodeloom.operators.structure import cut_lineage, ranked
from nodeloom.operators.walks import context_pairs, random_walks


class WalkEmbedding(spectral.NodeEmbedding):
    """Walks over a graph, which follow the weights where these differ; p and q bias them."""

    def __init__(self, num_walks: int = 10, walk_length: int = 80, window: int = 10, p: float = 1.0, q: float = 1.0):
        super().__init__()
        self.num_walks, self.walk_length, self.window, self.p, self.q = num_walks, walk_length, window, p, q

    def fit(self, edges: DataFrame) -> WalkEmbedding:
        super().fit(edges)
        nodes = self.edges.select(F.col("src").alias("node_id")).distinct()
        self.walks = cut_lineage(random_walks(self.edges, nodes, self.num_walks, self.walk_length, p=self.p, q=self.q))
        return self


class DeepWalk(WalkEmbedding):
    """Skip-gram with hierarchical softmax (MLlib). Training runs in as many partitions as there are, at most `partitions`:
    each trains on its walks from the same vectors, which are summed up after each of `epochs`, so results depend on it."""

    def __init__(self, num_walks: int = 10, walk_length: int = 80, window: int = 10, p: float = 1.0, q: float = 1.0, partitions: int = 4, epochs: int = 5):
        super().__init__(num_walks, walk_length, window, p, q)
        self.partitions, self.epochs = partitions, epochs

    def make(self, dim: int) -> DataFrame:
        words = self.walks.groupBy("walk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node_id"))), lambda x: x["node_id"].cast("string")).alias("w"))
        trainer = Word2Vec(vectorSize=dim, windowSize=self.window, minCount=0, maxIter=self.epochs, seed=1, numPartitions=self.partitions, inputCol="w", outputCol="v")
        return trainer.fit(words).getVectors().select(F.col("word").cast("long").alias("node_id"), vector_to_array("vector").alias("emb"))


def negative_sampling(pairs: DataFrame, dim: int, negatives: int = 5, epochs: int = 15, rate: float = 0.5, block: int = 50_000, cell: int = 200_000) -> DataFrame:
    """(node_id, emb, out): skip-gram vectors of pairs(center, context, n) with negative sampling.

    An epoch is one step down the whole objective: each pair pulls its vectors together, and noise nodes push away from
    the center, which meets `negatives` of them for each of its pairs. They are drawn evenly, each with the weight that
    makes it stand for a draw by count ** 0.75. A node's step is the mean over what it meets, times `rate`.

    Nodes lie in blocks of at most `block`. A cell is a block of centers with a block of contexts; its pairs are dealt into
    slices of about `cell`, a task's work. A slice gets its two blocks' vectors once, whatever the number of pairs, and
    gives back one sum for each vector that it moved, so what is sent an epoch grows with nodes x blocks and slices. Pairs
    whose context is never a center are left out.
    """
    pairs = cut_lineage(pairs.select("center", "context", F.col("n").cast("double").alias("n")))
    nodes = ranked(pairs.groupBy(F.col("center").alias("node_id")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")), ["node_id"], "at")
    count, power = nodes.agg(F.count(F.lit(1)), F.sum(F.pow("n", F.lit(0.75)))).first()
    blocks = max(-(-count // block), 1)
    u = lambda c: (uniform("sgns", F.col("node_id"), F.lit(c)) - 0.5) * 2 / dim**0.5  # noqa: E731  small ones would all go one way first
    start = [F.array(*[u(c + shift) for c in range(dim)]).alias(name) for name, shift in (("x", 0), ("y", dim))]
    place = [(F.col("at") % blocks).alias("block"), F.floor(F.col("at") / blocks).alias("pos")]
    now = cut_lineage(nodes.select("node_id", *place, "n", "k", (F.pow("n", F.lit(0.75)) / power).alias("share"), *start))

    ends = now.select("node_id", "block", "pos")
    at = pairs.join(ends.toDF("center", "i", "a"), "center").join(ends.toDF("context", "j", "b"), "context")
    cells = pairs.sparkSession.range(blocks * blocks).select(F.floor(F.col("id") / blocks).alias("i"), (F.col("id") % blocks).alias("j"))
    sizes = at.groupBy("i", "j").agg(F.count(F.lit(1)).alias("size"))
    cells = cut_lineage(cells.join(sizes, ["i", "j"], "left").select("i", "j", F.greatest(F.ceil(F.coalesce("size", F.lit(0)) / cell), F.lit(1)).alias("slices")))
    at = cut_lineage(at.join(cells, ["i", "j"]).select("i", "j", F.pmod(F.xxhash64("center", "context"), "slices").alias("slice"), "a", "b", "n"))
    slices = cut_lineage(cells.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))))

    for epoch in range(epochs):
        side = lambda s, v, on: now.withColumnRenamed("block", on).join(slices, on).select("i", "j", "slice", "slices", F.lit(s).alias("side"), "pos", "n", "k", "share", F.col(v).alias("v"))
        sent = side(0, "x", "i").union(side(1, "y", "j"))
        keys = ["i", "j", "slice"]
        pulls = at.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_puller(negatives, blocks, epoch), "side int, block long, pos long, g array<double>")
        pulls = pulls.groupBy("side", "block", "pos").agg(F.array(*[F.sum(F.col("g")[c]) for c in range(dim)]).alias("g"))
        for s, v in ((0, "x"), (1, "y")):
            step = F.zip_with(v, "g", lambda a, b: a + rate * b / F.col("n"))
            now = now.join(pulls.where(F.col("side") == s).select("block", "pos", "g"), ["block", "pos"], "left").withColumn(v, F.coalesce(step, v)).drop("g")
        now = cut_lineage(now)
    return now.select("node_id", F.col("x").alias("emb"), F.col("y").alias("out"))


def _puller(negatives: int, blocks: int, epoch: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """What a slice of a cell adds to its centers (side 0) and contexts (side 1), as a task's function that needs nothing else of
    this package. Noise is drawn for every `slices`-th center, by a generator that depends on epoch and slice only, so
    a task that runs again draws the same."""

    def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
        return vectors.combine_chunks().flatten().to_numpy().reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))

    def add(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:  # rows of one place are summed up first
        order = np.argsort(at, kind="stable")
        place, first = np.unique(at[order], return_index=True)
        total[place] += np.add.reduceat(rows[order], first) if len(first) else 0

    def pulls(key: tuple, pairs: pa.Table, sent: pa.Table) -> pa.Table:
        i, j, part = (int(v.as_py()) for v in key)
        mine, other = (sent.filter(pc.equal(sent["side"], s)).sort_by("pos") for s in (0, 1))
        x, y = (matrix(t["v"]) for t in (mine, other))
        gx, gy = np.zeros_like(x), np.zeros_like(y)

        def meet(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
            for low in range(0, len(a), 1 << 16):
                c, d, w = (v[low : low + (1 << 16)] for v in (a, b, n))
                dot = np.clip((x[c] * y[d]).sum(1), -500, 500)
                g = w / (1 + np.exp(np.where(w > 0, dot, -dot)))
                add(gx, c, g[:, None] * y[d])
                add(gy, d, g[:, None] * x[c])

        given = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
        meet(*(given[c].to_numpy() for c in ("a", "b", "n")))
        if negatives and len(x) and len(y):
            centers = np.arange(part, len(x), sent["slices"][0].as_py())
            draws = -(-negatives * mine["k"].to_numpy()[centers] // blocks)
            a = np.repeat(centers, draws)
            b = np.random.default_rng([epoch, i, j, part]).integers(len(y), size=len(a))
            mass = negatives * mine["n"].to_numpy()[centers] / draws
            meet(a, b, -np.repeat(mass, draws) * other["share"].to_numpy()[b] * len(y))
        out = []
        for s, block, g in ((0, i, gx), (1, j, gy)):
            pos = np.flatnonzero(g.any(1))
            flat = pa.ListArray.from_arrays(np.arange(len(pos) + 1, dtype=np.int32) * g.shape[1], g[pos].ravel()) if len(pos) else pa.array([], pa.list_(pa.float64()))
            out.append(pa.table({"side": np.full(len(pos), s, np.int32), "block": np.full(len(pos), block), "pos": pos, "g": flat}))
        return pa.concat_tables(out)

    return pulls


class Node2Vec(WalkEmbedding):
    """Skip-gram with negative sampling over (biased) walks."""

    def __init__(self, num_walks: int = 10, walk_length: int = 80, window: int = 10, p: float = 1.0, q: float = 1.0, negatives: int = 5, epochs: int = 15):
        super().__init__(num_walks, walk_length, window, p, q)
        self.negatives, self.epochs, self._both = negatives, epochs, {}

    def _vectors(self, dim: int) -> DataFrame:
        if dim not in self._both:
            self._both[dim] = negative_sampling(context_pairs(self.walks, self.window), dim, self.negatives, self.epochs)
        return self._both[dim]

    def fit(self, edges: DataFrame) -> Node2Vec:
        self._both = {}
        return super().fit(edges)

    def make(self, dim: int) -> DataFrame:
        return self._vectors(dim).select("node_id", "emb")

    def out_vectors(self, dim: int) -> DataFrame:
        return self._vectors(dim).select("node_id", F.col("out").alias("emb"))


#: Models by key, each made with a window and a number of walks. line is node2vec with window 1 and ten times the walks.
MODELS: dict[str, Callable[[int, int], spectral.NodeEmbedding]] = {
    "node2vec": lambda window, walks: Node2Vec(num_walks=walks, window=window),
    "deepwalk": lambda window, walks: DeepWalk(num_walks=walks, window=window),
    "depthfirst-node2vec": lambda window, walks: Node2Vec(num_walks=walks, window=window, p=100.0),
    "line": lambda window, walks: Node2Vec(num_walks=10 * walks, window=1),
    "leigenmap": lambda window, walks: spectral.LaplacianEigenMap(),
    "adjspec": lambda window, walks: spectral.AdjacencySpectral(),
    "modspec": lambda window, walks: spectral.ModularitySpectral(),
    "linearized-node2vec": lambda window, walks: spectral.LinearizedNode2Vec(window),
    "nonbacktracking": lambda window, walks: spectral.NonBacktrackingSpectral(),
    "node2vec-matrixfact": lambda window, walks: spectral.WalkMatrixFactorization(window),
}


def model(name: str, window: int = 10, num_walks: int = 40) -> spectral.NodeEmbedding:
    """A registered model, not yet fitted."""
    if name not in MODELS:
        raise KeyError(f"no model {name}; there are {sorted(MODELS)}")
    return MODELS[name](window, num_walks)
