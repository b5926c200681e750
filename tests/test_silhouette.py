"""Silhouettes of all k and starts in one pass a round, against distances between all pairs."""

import numpy as np
import pytest

from nodeloom.operators import clustering


def plain(x, group):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d, out = 1 - u @ u.T, []
    for i in range(len(x)):
        mine = (group == group[i]) & (np.arange(len(x)) != i)
        if not mine.any():
            out.append(0.0)
            continue
        a, b = d[i, mine].mean(), min(d[i, group == g].mean() for g in set(group.tolist()) - {group[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouettes_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    group = np.repeat([0, 1, 2, 3], [40, 25, 10, 1])  # one group is a lone point
    x = np.array([[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, -5]], float)[group] + rng.normal(scale=0.3, size=(76, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(76, None), (77, [0.0] * 4)]
    t = spark.createDataFrame(rows, "node_id long, emb array<double>")
    got = {r.k: r.silhouette for r in clustering.silhouette_by_k(t, most=6, restarts=4).collect()}
    assert set(got) == {2, 3, 4, 5, 6} and max(got, key=got.get) == 4
    assert got[4] == pytest.approx(plain(x, group), abs=1e-9)
    assert {r.k: r.silhouette for r in clustering.silhouette_by_k(t, most=6, restarts=4).collect()} == pytest.approx(got)


def test_copies_of_one_vector_have_no_silhouette(spark):
    t = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "node_id long, emb array<double>")
    assert clustering.silhouette_by_k(t, most=4, restarts=2).count() == 0
