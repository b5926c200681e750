"""Eigenpairs and embeddings against dense linear algebra on graphs of the size of the karate club."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import skipgram, spectral


def graph(spark, n=34, seed=3, pairs=None):
    rng = np.random.default_rng(seed)
    if pairs is None:
        pairs = {(k, k + 1) for k in range(n - 1)} | {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.25 if (a < n // 2) == (b < n // 2) else 0.03)}
    a = np.zeros((n, n))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    rows = [(x, y, 1.0) for x, y in zip(*(v.tolist() for v in np.nonzero(a)))]
    return a, spark.createDataFrame(rows, "src long, dst long, weight double")


def dense(df):
    rows = sorted(df.collect(), key=lambda r: r.node_id)
    return np.array([r.emb for r in rows])


def alike(x, y):
    """Equal columns up to their signs."""
    return all(min(np.abs(p - q).max(), np.abs(p + q).max()) < 2e-5 for p, q in zip(x.T, y.T)) and x.shape == y.shape


def normal(a):
    d = np.sqrt(np.maximum(1, a.sum(1)))
    return a / d[:, None] / d


def test_spectral_models_are_those_of_dense_algebra(spark):
    a, g = graph(spark)
    s, u = np.linalg.eigh(normal(a))
    s, u = s[::-1], u[:, ::-1]
    d = np.sqrt(a.sum(1))
    assert alike(dense(spectral.LaplacianEigenMap().fit(g).transform(4)), (u[:, 1:5] * np.sqrt(np.abs(s[1:5]))) / d[:, None])
    t = np.abs(s[1:5])
    assert alike(dense(spectral.LinearizedNode2Vec(5).fit(g).transform(4)), u[:, 1:5] * np.sqrt(t * (1 - t**5) / (5 * (1 - t))))
    two_m = a.sum()
    b = a / two_m - np.outer(a.sum(1), a.sum(1)) / two_m**2
    sb, ub = np.linalg.eigh(b)
    order = np.argsort(-np.abs(sb))[:3]
    assert alike(dense(spectral.ModularitySpectral().fit(g).transform(3)), ub[:, order] * np.sqrt(np.abs(sb[order])))


def test_largest_algebraic_pairs_of_a_bipartite_path(spark):
    a, g = graph(spark, 6, pairs=[(k, k + 1) for k in range(5)])
    values, vectors = spectral.eigenpairs(spectral.symmetric_normal(g), 3, "LR")
    assert values == pytest.approx(np.linalg.eigvalsh(normal(a))[::-1][:3], abs=1e-7)
    x = dense(vectors)
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6) and np.allclose(normal(a) @ x, x * values, atol=1e-6)
    two = [(k, k + 1) for k in range(4)] + [(0, 4), (0, 2)] + [(5 + k, 6 + k) for k in range(3)] + [(5, 8), (5, 7)]
    a, g = graph(spark, 9, pairs=two)
    assert dense(spectral.LinearizedNode2Vec(4).fit(g).transform(3)).shape == (9, 2)  # both constant vectors go


def test_nonbacktracking_spectrum(spark):
    a, g = graph(spark)
    n, d = len(a), a.sum(1)
    m = np.block([[np.zeros((n, n)), np.diag(d) - np.eye(n)], [-np.eye(n), a]])
    s, v = np.linalg.eig(m)
    order = np.argsort(-np.abs(s))
    model = spectral.NonBacktrackingSpectral().fit(g)
    got = dense(model.transform(1))
    low = np.real(v[n:, order[1]])
    want = low / np.linalg.norm(low) * np.sqrt(abs(s[order[1]].real))
    assert min(np.abs(got[:, 0] - want).max(), np.abs(got[:, 0] + want).max()) < 1e-3
    assert np.linalg.norm(got[:, 0]) ** 2 == pytest.approx(s[order[1]].real, abs=1e-4)


def test_walk_matrix_and_shaving(spark):
    a, g = graph(spark, 12, pairs=[(x, y) for x in range(12) for y in range(x + 1, 12) if (x // 6 == y // 6) or (x, y) == (5, 6)])
    p = a / a.sum(1)[:, None]
    total = sum(np.linalg.matrix_power(p, t) for t in (1, 2, 3, 4)) / 4
    r = np.log(np.maximum(total / (a.sum(1) / a.sum()), 1e-12))
    s, u = np.linalg.eigh(r)
    order = np.argsort(-np.abs(s))[:3]
    assert alike(dense(spectral.WalkMatrixFactorization(4).fit(g).transform(2)), u[:, order] * np.abs(s[order]) ** 1.5)
    emb = spark.createDataFrame([(k, [float(k % 2), float(k // 6), 1.0]) for k in range(12)], "node_id long, emb array<double>")
    e = dense(emb)
    want = np.diag((e / np.linalg.norm(e, axis=0)).T @ normal(a) @ (e / np.linalg.norm(e, axis=0)))
    got = {r.pos: r.value for r in spectral.rayleigh(spectral.symmetric_normal(g), emb).collect()}
    assert [got[k] for k in range(3)] == pytest.approx(want)
    assert np.allclose(dense(spectral.shave(emb, 3, spectral.symmetric_normal(g))), e[:, np.argsort(-want)[:2]])
    assert spectral.effective_dim(0, 100, 5, 90) == 4 and spectral.effective_dim(64, 100, 5, 20) == 18 and spectral.effective_dim(3, 4, 2, 1) == 0


def test_trained_models_tell_two_cliques(spark):
    a, g = graph(spark, 12, pairs=[(x, y) for x in range(12) for y in range(x + 1, 12) if (x // 6 == y // 6) or (x, y) == (5, 6)])
    for model in (skipgram.DeepWalk(num_walks=6, walk_length=12, window=3, partitions=1), skipgram.Node2Vec(num_walks=3, walk_length=10, window=3, epochs=10)):
        x = dense(model.fit(g).transform(6))
        x /= np.linalg.norm(x, axis=1)[:, None]
        c = x @ x.T
        same = np.add.outer(np.arange(12) // 6, -(np.arange(12) // 6)) == 0
        assert c[same].mean() > c[~same].mean() + 0.2, type(model)
    assert dense(model.out_vectors(6)).shape == (12, 6) and g.count() == 62
    with pytest.raises(KeyError):
        skipgram.model("glove")
    assert skipgram.model("line", 10, 4).window == 1 and skipgram.model("depthfirst-node2vec").p == 100
