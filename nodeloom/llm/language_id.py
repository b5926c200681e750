"""Language id: a bit-sliced Bloom filter whose slots hold language bitmasks, read by letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm._shared import trimmed
from nodeloom.llm._shingles import mix

ORDERS = (2, 3, 4)
SLOTS = 1 << 17
SAMPLE = 1000  # training texts per language at most, the least by a hash of their id
GRAMS = 4000  # n-grams per language at most, the most frequent of its sample
CHUNK = 256 << 10  # letters told at a time: some 80 bytes of arrays for each


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, hash) of every n-gram of lower-cased letters, a word's ends counting as one blank; per order."""
    plain = [" " + t.lower() + " " for t in texts]
    n = np.array([len(t) for t in plain])
    x = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_letters()[np.minimum(x, 0x10FFFF)], x, 0).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    blank = x == 0
    for order in ORDERS:
        m = len(x) - order + 1
        if m <= 0:
            continue
        ok = (doc[:m] == doc[order - 1 :]) & ~(blank[:m] & blank[order - 1 :]) if order == 2 else doc[:m] == doc[order - 1 :]
        for k in range(1, order - 1):
            ok &= ~blank[k : k + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), order, np.uint64)
        for k in range(order):
            h = h * np.uint64(0x100000001B3) + x[at + k]
        yield doc[at], mix(h)


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[int], list[str], pa.RecordBatch]]:
    """Rows of a batch in runs of about CHUNK letters; a longer text is alone, whole."""
    for batch in batches:
        rows, texts, size = [], [], 0
        for k, t in enumerate(batch.column(column)):
            t = t.as_py() or ""
            rows.append(k)
            texts.append(t)
            size += len(t)
            if size >= CHUNK:
                yield rows, texts, batch
                rows, texts, size = [], [], 0
        if rows:
            yield rows, texts, batch


class LanguageFilter:
    """languages; table (slots, words of 64 languages); and each language's false-positive rate."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray], slots: int = SLOTS):
        self.languages = languages
        self.table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        for k, name in enumerate(languages):
            for at in self.positions(grams[name]):
                self.table[at, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        fill = np.array([((self.table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        self.false_rate = fill**2

    def positions(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.uint64(len(self.table) - 1)
        return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Per text: the language whose n-grams cover most of its own, and that share, less what chance hits add."""
        counts, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for doc, h in gram_hashes(texts):
            a, b = self.positions(h)
            total += np.bincount(doc, minlength=len(texts))
            for w in range(self.table.shape[1]):
                both = self.table[a, w] & self.table[b, w]  # all languages that have the n-gram
                for k in range(64 * w, min(len(self.languages), 64 * w + 64)):
                    hit = (both & (np.uint64(1) << np.uint64(k % 64))) != 0
                    counts[:, k] += np.bincount(doc[hit], minlength=len(texts))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        share = (counts / np.maximum(total, 1)[:, None] - self.false_rate) / (1 - self.false_rate)
        best = share.argmax(axis=1)
        names = [self.languages[k] if n else "und" for k, n in zip(best.tolist(), total.tolist())]
        return names, np.where(total > 0, np.clip(share[np.arange(len(texts)), best], 0, 1), 0.0)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, grams: int = GRAMS) -> LanguageFilter:
    """A filter from the rows with text and lang. Bounded: `sample` texts per language, then `grams` n-grams each.

    The choice of texts moves ids only, and of those about `sample` per language: rows are counted by language first,
    and a hash too large for that count is not ranked. What reaches the driver is languages * grams hashes.
    """
    some = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).cast("string").alias("i"), F.col(lang).alias("l"), F.col(text).alias("x"))
    share = F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / float(1 << 40)
    known = some.select("i", "l", share.alias("k")).join(F.broadcast(some.groupBy("l").agg(F.count(F.lit(1)).alias("all"))), "l")
    near = known.where(F.col("k") * F.col("all") < sample + 8 * sample**0.5 + 16)  # hashes that can be among the least
    order = Window.partitionBy("l").orderBy("k", "i")
    ranked = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample)
    ids = ranked.select("i").distinct()
    chosen = some.join(F.broadcast(ids), "i")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, batch in chunks(batches, 1):
            names = batch.column(0).to_pylist()
            by = {}
            for r, t in zip(rows, texts):
                by.setdefault(names[r], []).append(t)
            for name, own in by.items():
                found = [h for _, h in gram_hashes(own)]
                if found:
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["l", "h", "n"])

    counts = chosen.select("l", "x").mapInArrow(count, "l string, h long, n long").groupBy("l", "h").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "h"))).where(F.col("r") <= grams)
    by: dict[str, list[int]] = {}
    for row in top.select("l", "h").collect():
        by.setdefault(row["l"], []).append(row["h"])
    return LanguageFilter(sorted(by), {k: np.array(v, np.int64).view(np.uint64) for k, v in by.items()})


def identify(docs: DataFrame, model: LanguageFilter, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, lang_pred, score (and text, if keep_text). The model (slots * 8 bytes per 64 languages) travels with the task.

    Defined cases: null, empty and letter-free texts, and all texts if nothing was learned, are `und` with score 0;
    ties go to the language first in code-point order; repeated rows each give a row; other columns are ignored.
    """
    given = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("x"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, batch in chunks(batches, 1):
            names, score = shared.value.predict(texts)
            at = pa.array(rows)
            columns = [batch.column(0).take(at), pa.array(names, pa.string()), pa.array(score, pa.float64()), *([batch.column(1).take(at)] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "text"][: len(columns)])

    return given.mapInArrow(trimmed(run), f"doc_id {given.schema['i'].dataType.simpleString()}, lang_pred string, score double" + ", text string" * keep_text)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0
