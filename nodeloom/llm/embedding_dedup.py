"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm._shared import components, groups, n_partitions, written
from nodeloom.llm._shingles import mix

TABLES, PROBES, BLOCK = 12, 4, 512


def rotate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; the width is a power of two."""
    n, d = x.shape
    for _ in range(3):
        x = x * rng.choice((-1.0, 1.0), d)
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
            h *= 2
    return x


def probe_codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables * probes) bucket codes. A hash is the largest rotated coordinate with its sign; a table's code is
    made of `hashes` of them. The probes after the first take the second-largest coordinate where that loses least."""
    n, d = x.shape
    width = 1 << max(1, math.ceil(math.log2(d)))
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng, row, out = np.random.default_rng(seed), np.arange(n), []
    choices = np.array([[(c >> h) & 1 for h in range(hashes)] for c in range(1 << hashes)])  # which hashes take their second
    for t in range(tables):
        picked, loss = [], []
        for _ in range(hashes):
            y = rotate(x, rng)
            size = np.abs(y)
            first = size.argmax(axis=1)
            best = size[row, first].copy()
            size[row, first] = -1.0
            second = size.argmax(axis=1)
            picked.append([2 * c + (y[row, c] < 0) for c in (first, second)])
            loss.append((best - size[row, second]) / np.maximum(best, 1e-300))
        order = np.argsort(np.stack(loss, axis=1) @ choices.T, axis=1, kind="stable")[:, :probes]
        for p in range(order.shape[1]):
            code = np.full(n, t, np.uint64)
            for h in range(hashes):
                code = mix(code * np.uint64(2 * width + 1) + np.where(choices[order[:, p], h] == 1, picked[h][1], picked[h][0]).astype(np.uint64))
            out.append(code)
    return np.stack(out, axis=1).astype(np.int64)


def _forest(linked: np.ndarray, a: list, b: list) -> list[tuple]:
    """A spanning forest of the true entries of linked (rows of a, columns of b), as pairs of ids."""
    comp: dict = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    out = []
    for i, j in zip(*(v.tolist() for v in np.nonzero(linked))):
        x, y = find(a[i]), find(b[j])
        if x != y:
            comp[x] = y
            out.append((a[i], b[j]))
    return out


def _verify(threshold: float):
    """Per bucket block pair: the links that this bucket is the first to hold, as counts per member and a forest."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["x", "y", "n"])
            for c in out:
                c.clear()
            return made

        for (_, code, first, second), (own, ids, times, units, codes) in groups(rows, 4):
            if len(ids) < 2:
                continue
            x, all_codes, times = np.array([np.frombuffer(u) for u in units]), np.array(codes), np.array(times)
            left = [k for k in range(len(ids)) if own[k] == first]
            right = left if first == second else [k for k in range(len(ids)) if own[k] == second]
            if not left or not right:
                continue
            linked = x[left] @ x[right].T >= threshold
            if first == second:
                linked &= np.tri(len(left), k=-1, dtype=bool)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            for s in range(0, len(i), 1 << 14):  # a pair that shares several buckets counts in the one with the least code
                p, q = all_codes[np.array(left)[i[s : s + (1 << 14)]]], all_codes[np.array(right)[j[s : s + (1 << 14)]]]
                least = np.full(len(p), np.iinfo(np.int64).max)
                for c in range(p.shape[1]):
                    least = np.where((p[:, c : c + 1] == q).any(axis=1), np.minimum(least, p[:, c]), least)
                linked[i[s : s + (1 << 14)], j[s : s + (1 << 14)]] = least == code
            for side, other, hits in ((left, right, linked), (right, left, linked.T)):
                n = hits @ times[other]
                for k in np.flatnonzero(n).tolist():
                    out[0].append(ids[side[k]])
                    out[1].append(None)
                    out[2].append(int(n[k]))
            for a, b in _forest(linked, [ids[k] for k in left], [ids[k] for k in right]):
                out[0].append(a)
                out[1].append(b)
                out[2].append(0)
            if len(out[0]) > 20_000:
                yield batch()
        if out[0]:
            yield batch()

    return run


def embedding_dedup(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows with equal, non-null labels (all rows, if label is None) are linked when their cosine, in double precision,
    is threshold or more. Candidates share one of tables * probes buckets; each is verified. Equal vectors are one
    row with a count from the start. The number of hashes in a code follows the number of rows, so that unlike
    vectors seldom meet. A bucket of any size is compared whole, in blocks of `block` rows against each other;
    a pair that meets in several buckets counts in one; out of a block come counts and a spanning forest of its
    links, never its pairs. Buckets with one row are dropped before vectors travel.

    Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
    label or id, link with nothing; vectors of unequal lengths never link; rows that repeat a vec_id are one node
    (the same vector counts once per row); an empty table gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    parts = n_partitions(spark)
    group = F.lit(0) if label is None else F.col(label)
    base = table.select(F.col(vec_id).cast("long").alias("i"), group.cast("string").alias("g"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0.0)
    usable = base.where(F.col("i").isNotNull() & F.col("g").isNotNull() & fine)
    same = usable.groupBy("g", "v").agg(F.min("i").alias("rep"), F.count(F.lit(1)).alias("times"))
    same = written(same, "vectors")
    n = same.count()
    hashes = max(1, math.ceil(math.log(16 * max(n, 2)) / math.log(128)))

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            vectors = batch.column(1).to_pylist()
            units: list = [None] * len(vectors)
            codes: list = [None] * len(vectors)
            for d in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == d]
                x = np.array([vectors[k] for k in at])
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                found = probe_codes(x, tables, hashes, probes, seed + d)
                for k, u, c in zip(at, x, found):
                    units[k], codes[k] = u.tobytes(), c.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(units, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["g", "i", "times", "unit", "codes"])

    codes = same.select("g", "v", F.col("rep").alias("i"), "times").mapInArrow(hashed, "g string, i long, times long, unit binary, codes array<long>")
    codes = written(codes, "codes")
    posts = codes.select("g", "i", F.explode(F.array_distinct("codes")).alias("code"))
    sizes = posts.groupBy("g", "code").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    met = posts.join(sizes, ["g", "code"]).select("g", "i", "code", "blocks")
    met = met.withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = met.join(codes.withColumnRenamed("g", "g2"), "i").where("g = g2")
    full = full.select("g", "code", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "i", "times", "unit", "codes")
    full = full.repartition(parts, "g", "code", "first", "second").sortWithinPartitions("g", "code", "first", "second")
    found = written(full.mapInArrow(_verify(threshold), "x long, y long, n long"), "links")

    near = found.where("y IS NULL").groupBy(F.col("x").alias("rep")).agg(F.sum("n").alias("near"))
    stars = components(found.where("y IS NOT NULL"), "x", "y").withColumnRenamed("node", "rep").withColumnRenamed("component_id", "top")
    classes = same.join(near, "rep", "left").join(stars, "rep", "left")
    classes = classes.select("g", "v", (F.coalesce("near", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("top", "rep").alias("component_id"))
    told = usable.join(classes, ["g", "v"]).select("i", "n_links", "component_id")
    alone = base.where(~F.coalesce(F.col("i").isNotNull() & F.col("g").isNotNull() & fine, F.lit(False))).select("i", F.lit(0).cast("long").alias("n_links"), F.col("i").alias("component_id"))
    return told.union(alone).select(F.col("i").alias("vec_id"), "n_links", "component_id", F.expr("i <=> component_id").alias("kept"))
