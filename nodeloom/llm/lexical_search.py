"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are cut into shards where they lie. A shard keeps its terms and, per term, the documents that hold it with their
counts: the points of a grid of terms and documents. Before a search the points become a quadtree whose cells, only those
with a point in them, hold the largest impact below. An item's terms are rows of the grid: their paths go down the
quadtree together, over ranges of documents, the range with the highest bound first, until no range can reach the
item's best documents so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nodeloom.llm._shared import written
from nodeloom.llm.bpe import _Numbers, _pack_numbers, _unpack_numbers

SHARD_BYTES = 16 << 20
CHUNK_TERMS = 20_000  # rows of (item, term) that meet a shard at a time, about
CHUNKS = 32  # of these that one job broadcasts: some 32 MB at most
AT_ONCE = 256  # ranges of documents that are opened together
SALT = 16
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BELOW = np.array([bin(m).count("1") for m in range(16)], np.int32)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and digits and of all characters beyond ASCII; A-Z lower-cased."""
    return text.translate(_TERM).split()


def _shards(kind: pa.DataType):
    """Per shard of rows (doc_id, text in UTF-8): its documents by id, their numbers of terms, its terms, and the points of the
    grid by term and document: documents a term, documents (differences), counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[np.ndarray] = []
        words: dict[bytes, int] = _Numbers()
        size = 0

        def shard() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k]) if ids[k] is not None else (True, 0))
            lengths = np.array([len(texts[k]) for k in order], np.int64)
            keys = np.concatenate([texts[k] for k in order]).astype(np.int64) * len(order) + np.repeat(np.arange(len(order)), lengths)
            keys, counts = np.unique(keys, return_counts=True)
            term, doc = keys // max(1, len(order)), keys % max(1, len(order))
            per = np.bincount(term, minlength=len(words))
            step = np.diff(doc, prepend=0)
            heads = np.cumsum(per) - per
            step[heads] = doc[heads]
            columns = [pa.array([[ids[k] for k in order]], pa.list_(kind)), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
            columns += [pa.array([[w.decode("utf-8", "replace") for w in words]], pa.list_(pa.string())), pa.array([per.astype(np.int32)], pa.list_(pa.int32()))]
            columns += [pa.array([_pack_numbers(x.astype(np.uint32))], pa.binary()) for x in (lengths, step, counts)]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "n_docs", "n_terms", "terms", "df", "lengths", "docs", "tf"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py() or b""
                found = terms_of(data)
                ids.append(i)
                texts.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                size += len(data) + 64
                if size >= SHARD_BYTES:
                    yield shard()
                    ids, texts, words, size = [], [], _Numbers(), 0
        if ids:
            yield shard()

    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: one row per shard of about SHARD_BYTES of text, written to the shared folder."""
    given = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").cast("binary").alias("x"))
    schema = f"ids array<{given.schema['i'].dataType.simpleString()}>, n_docs long, n_terms long, terms array<string>, df array<int>, lengths binary, docs binary, tf binary"
    return written(given.mapInArrow(_shards(to_arrow_type(given.schema["i"].dataType)), schema), "lexical")


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers under 2 ** 32, a zero before each."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


class Treap:
    """Cells of a grid of rows and columns, by level: the largest value in a cell, its first child, and which of its four
    children (2 * row half + column half) hold points. Level 0 is the points."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code = code[order]
        self.top = [values[order].astype(np.int64)]
        self.first, self.mask = [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
        self.height = 0
        while len(code) and int(code[-1]) > 0:
            above = code >> np.uint64(2)
            heads = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
            self.top.append(np.maximum.reduceat(self.top[-1], heads))
            self.mask.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), heads))
            self.first.append(heads.astype(np.int32))
            code, self.height = above[heads], self.height + 1

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the k best columns by the weighted sum of the rows' values, of those with a score of
        floor or more; equal scores by column."""
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.top[0]) or not len(rows):
            return found, scores
        height = self.height
        frontier: list = [None] * (height + 1)  # by level: bounds, ranges, cells of the rows
        ceiling = [-1] * (height + 1)

        def put(level: int, bounds: np.ndarray, ranges: np.ndarray, cells: np.ndarray) -> None:
            nonlocal found, scores, floor
            kept = np.flatnonzero(bounds >= floor)
            if not len(kept):
                return
            bounds, ranges, cells = bounds[kept], ranges[kept], cells[kept]
            if level == 0:
                found, scores = np.concatenate((found, ranges)), np.concatenate((scores, bounds))
                if len(scores) >= k:
                    order = np.lexsort((found, -scores))[:k]
                    found, scores = found[order], scores[order]
                    floor = max(floor, int(scores[-1]))
                return
            old = frontier[level]
            frontier[level] = (bounds, ranges, cells) if old is None else tuple(np.concatenate(x) for x in zip(old, (bounds, ranges, cells)))
            ceiling[level] = max(ceiling[level], int(bounds.max()))

        put(height, np.array([int((weights * self.top[height][0]).sum())]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32))
        while height:
            level = int(np.argmax(ceiling))
            if ceiling[level] < floor or frontier[level] is None:
                break
            bounds, ranges, cells = frontier[level]
            if len(bounds) > AT_ONCE:
                split = np.argpartition(-bounds, AT_ONCE)
                now, rest = split[:AT_ONCE], split[AT_ONCE:]
                rest = rest[bounds[rest] >= floor]
                frontier[level] = (bounds[rest], ranges[rest], cells[rest]) if len(rest) else None
                ceiling[level] = int(bounds[rest].max()) if len(rest) else -1
                ranges, cells = ranges[now], cells[now]
            else:
                frontier[level], ceiling[level] = None, -1
            valid = cells >= 0
            mask = np.where(valid, self.mask[level][cells], 0)
            first, top = self.first[level][cells], self.top[level - 1]
            for half in (0, 1):
                slot = (2 * ((rows >> (level - 1)) & 1) + half).astype(np.uint8)
                child = np.where((mask >> slot) & 1, first + _BELOW[mask & ((np.uint8(1) << slot) - np.uint8(1))], -1).astype(np.int32)
                put(level - 1, np.where(child >= 0, top[child], 0) @ weights, 2 * ranges + half, child)
        order = np.lexsort((found, -scores))[:k]
        return found[order], scores[order]


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L; all whole numbers."""
    wide = n if 25 * n_docs * int(n.max(initial=0)) < 2**62 else n.astype(object)
    m = 75 + ((25 * n_docs * wide) // max(1, n_terms)).astype(np.int64)
    return (10**9 * tf) // (1000 * tf + 12 * m)


def _search(k: int, n_docs: int, n_terms: int, kind: pa.DataType):
    """Rows (item, doc_id, score): the k best documents of each item among the shards of a task. What the earlier shards
    gave bounds the later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                cell = {name: batch.column(j)[at] for j, name in enumerate(batch.schema.names)}
                _one(cell, best)
        rows = [(item, i, -score) for item, found in best.items() for score, _, _, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), kind, pa.int64()))], names=["item", "doc_id", "score"])

    def _one(cell: dict, best: dict[int, list[tuple]]) -> None:
        asked, items, weights = cell["asked"].values, cell["items"].values.to_numpy(), cell["weights"].values.to_numpy()
        names, number = np.unique(asked.to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        place = pc.index_in(pa.array(names, pa.string()), value_set=cell["terms"].values)
        place = place.fill_null(-1).to_numpy()
        per = cell["df"].values.to_numpy().astype(np.int64)
        ends = np.cumsum(per)
        held = np.flatnonzero(place >= 0)
        held = held[np.argsort(-per[place[held]], kind="stable")]  # frequent terms are neighbours, and so are rare ones
        row = np.full(len(names), -1, np.int64)
        row[held] = np.arange(len(held))
        size = per[place[held]]
        heads = np.cumsum(size) - size
        spots = np.arange(int(size.sum())) - np.repeat(heads - (ends[place[held]] - size), size)
        steps, tf = _unpack_numbers(cell["docs"].as_py()).astype(np.int64)[spots], _unpack_numbers(cell["tf"].as_py()).astype(np.int64)[spots]
        docs = np.cumsum(steps)
        docs -= np.repeat(docs[heads] - steps[heads], size) if len(heads) else 0
        lengths = _unpack_numbers(cell["lengths"].as_py()).astype(np.int64)
        treap = Treap(np.repeat(np.arange(len(held)), size), docs, impacts(tf, lengths[docs], n_docs, n_terms))
        ids = cell["ids"].as_py()
        order = np.argsort(items, kind="stable")
        cuts = np.flatnonzero(np.diff(items[order], prepend=-1, append=-2)) if len(order) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine = order[a:b]
            mine = mine[row[number[mine]] >= 0]
            item, old = int(items[order[a]]), best.get(int(items[order[a]]), [])
            floor = -old[-1][0] if len(old) == k else 1
            found, scores = treap.best(row[number[mine]], weights[mine], k, floor)
            if len(found):
                new = [(-s, ids[d] is None, ids[d] if ids[d] is not None else 0, ids[d]) for d, s in zip(found.tolist(), scores.tolist())]
                best[item] = sorted(old + new, key=lambda x: x[:3])[:k]

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = terms_of(text or b"")
            items += [item] * len(found)
            terms += [t.decode("utf-8", "replace") for t in found]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.string())], names=["item", "term"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): of each row of items its k best documents with a score over 0,
    the highest first, equal scores by ascending doc_id (null last).

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score is the sum over the item's terms, repeats
    included, of weight times impact (see `impacts`). The result is exact: a range of documents is left unopened only if the sum of
    its cells' maxima is below the k-th best score so far. A quadtree is made of the rows that the items at hand ask
    for. Items meet the shards in chunks, so any number of them can be asked; shards never move.

    Defined cases: null and empty texts, of documents or items, have no terms; items without terms, or whose terms no
    document holds, have no rows; repeated documents each take a rank; rows of items that share an item_id are searched
    each for itself; empty tables give an empty result; other columns are ignored, whatever their names.
    """
    index = build_index(docs, doc_id, text) if index is None else index
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("x")), "items")
    terms = asked.select("item", "x").mapInArrow(_item_terms, "item long, term string").groupBy("item", "term").agg(F.count(F.lit(1)).alias("q"))
    terms = written(terms, "item-terms")
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = df.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    chunks = max(1, -(-terms.count() // CHUNK_TERMS))
    packed = terms.join(df, "term").withColumn("weight", weight * F.col("q")).where("weight > 0").groupBy(F.pmod(F.xxhash64("item"), F.lit(chunks)).alias("chunk"))
    packed = packed.agg(F.collect_list(F.struct("item", "term", "weight")).alias("r"))
    packed = written(packed.select("chunk", F.col("r.term").alias("asked"), F.col("r.item").alias("items"), F.col("r.weight").alias("weights")), "chunks")
    kind = index.schema["ids"].dataType.elementType
    out = None
    for start in range(0, chunks, CHUNKS):  # the stated query set against all shards, in blocks
        some = packed.where(f"chunk >= {start} AND chunk < {start + CHUNKS}").drop("chunk")
        met = index.select("ids", "terms", "df", "lengths", "docs", "tf").crossJoin(F.broadcast(some))
        found = met.mapInArrow(_search(k, n_docs, n_terms, to_arrow_type(kind)), f"item long, doc_id {kind.simpleString()}, score long")
        out = found if out is None else out.union(found)
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    out = out.withColumn("part", F.spark_partition_id() % SALT)
    out = out.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("r") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)
    return out.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
