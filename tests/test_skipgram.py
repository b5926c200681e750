"""Negative sampling by blocks of nodes: against the whole objective's gradient, its noise's law, and planted groups."""

import numpy as np
import pyarrow as pa

from nodeloom.operators import skipgram


def vectors(df):
    rows = sorted(df.collect(), key=lambda r: r.node_id)
    return np.array([r.emb for r in rows]), np.array([r.out for r in rows])


def random_pairs(spark, n, m, seed):
    rng = np.random.default_rng(seed)
    found = {(int(a), int(b)): int(c) for a, b, c in zip(rng.integers(n, size=m), rng.integers(n, size=m), rng.integers(1, 9, size=m))}
    found |= {(a, (a + 1) % n): 2 for a in range(n)}
    found |= {(0, b): 5 for b in range(n)}  # a hub
    return found, spark.createDataFrame([(a, b, c) for (a, b), c in found.items()], "center long, context long, n long")


def test_an_epoch_is_the_whole_gradient_however_cells_are_cut(spark):
    found, pairs = random_pairs(spark, 17, 60, 1)
    x, y = vectors(skipgram.negative_sampling(pairs, 3, epochs=0))
    mass = np.zeros(17)
    for (a, _), c in found.items():
        mass[a] += c
    for _ in range(2):
        gx, gy = np.zeros_like(x), np.zeros_like(y)
        for (a, b), c in found.items():
            g = c / (1 + np.exp(x[a] @ y[b]))
            gx[a] += g * y[b]
            gy[b] += g * x[a]
        x, y = x + 0.5 * gx / mass[:, None], y + 0.5 * gy / mass[:, None]
    for block, cell in ((100, 10_000), (5, 7)):
        got = vectors(skipgram.negative_sampling(pairs, 3, negatives=0, epochs=2, block=block, cell=cell))
        assert np.allclose(got[0], x) and np.allclose(got[1], y)


def test_noise_stands_for_draws_by_share(spark):
    """Over many epochs the mean push equals that of `negatives` draws a pair from the law of shares, cut in two blocks."""
    rng = np.random.default_rng(2)
    size, dim, negatives = 6, 2, 3
    x, y = rng.normal(size=(size, dim)), rng.normal(size=(2 * size, dim))
    n, k, share = rng.integers(5, 30, size).astype(float), rng.integers(1, 5, size), rng.dirichlet(np.ones(2 * size))
    want = np.zeros((size, dim))
    for c in range(size):
        for o in range(2 * size):
            want[c] -= negatives * n[c] * share[o] / (1 + np.exp(-x[c] @ y[o])) * y[o]
    none = pa.table({c: pa.array([], t) for c, t in (("a", pa.int64()), ("b", pa.int64()), ("n", pa.float64()))})
    got, rounds = np.zeros((size, dim)), 1500
    for j in range(2):
        side = lambda s, v, kk, nn, p: pa.table({"slices": [1] * size, "side": pa.array([s] * size, pa.int32()), "pos": range(size), "n": nn, "k": kk, "share": p, "v": v.tolist()})
        sent = pa.concat_tables([side(0, x, k, n, share[:size]), side(1, y[j::2], k, n, share[j::2])])
        for epoch in range(rounds):
            for r in skipgram._puller(negatives, 2, epoch)((pa.scalar(0), pa.scalar(j), pa.scalar(0)), none, sent).to_pylist():
                if r["side"] == 0:
                    got[r["pos"]] += r["g"]
    assert np.abs(got / rounds - want).max() < 0.08 * np.abs(want).max()


def test_planted_groups_are_told_apart_over_blocks(spark):
    rng = np.random.default_rng(3)
    group = np.arange(45) % 3
    rows = [(a, b, 4 if group[a] == group[b] else 1) for a in range(45) for b in range(45) if a != b and rng.random() < (0.6 if group[a] == group[b] else 0.1)]
    pairs = spark.createDataFrame(rows, "center long, context long, n long")
    x, _ = vectors(skipgram.negative_sampling(pairs, 8, epochs=12, block=12, cell=100))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c, same = x @ x.T, group[:, None] == group[None]
    assert c[same].mean() > c[~same].mean() + 0.2
    again, _ = vectors(skipgram.negative_sampling(pairs, 8, epochs=1, block=12, cell=100))
    assert np.allclose(again, vectors(skipgram.negative_sampling(pairs, 8, epochs=1, block=12, cell=100))[0])


def test_no_pairs_no_vectors(spark):
    assert skipgram.negative_sampling(spark.createDataFrame([], "center long, context long, n long"), 4, epochs=1).count() == 0
