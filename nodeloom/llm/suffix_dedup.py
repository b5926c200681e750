"""Suffix-array dedup: repeats of `length` bytes or more, found as intervals of an enhanced suffix array.

The suffix array is sparse: it holds suffixes at anchors. An anchor is the least `gram`-byte hash in a window of
`length` bytes; equal windows have equal anchors at equal offsets, so every repeat of `length` bytes meets at an
anchor that occurs at least twice. Spark sorts the anchored suffixes (anchor key, then the bytes to the right of
it); a stack scan over their common-prefix lengths walks the interval tree bottom-up. Members of an interval are
kept in the order of their reversed left contexts, and each merge of two child intervals tests the left extensions
of the members that become neighbours there: where left plus right extension reach `length`, the interval's members
with that left context are a maximal repeat group, and all its occurrences are reported, not just neighbours.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm._shared import groups, n_partitions, written
from nodeloom.llm._shingles import mix, powers, prefix_hash

GRAM = 128
SLICE = 2 << 20
GROUP = 512  # distinct contexts of one anchor that one scan takes; more are told apart by narrower anchors first


def anchor_rows(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first start, last start, key, context hash) over documents laid end to end in data.

    The starts first..last (positions in data) are those whose window's anchor this is; the context hash is over
    the bytes that these windows cover.
    """
    width, n = length - gram + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    p, (_, down) = prefix_hash(data), powers(n)
    hashes = mix((p[gram:] - p[: n - gram + 1]) * down[: n - gram + 1])
    keyed = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    m = -(-len(keyed) // width)
    square = np.full(m * width, np.iinfo(np.uint64).max, np.uint64)
    square[: len(keyed)] = keyed
    square = square.reshape(m, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    at = np.arange(windows)
    doc = np.searchsorted(ends, at, "right")
    inside = at + length <= ends[doc]
    at, doc, anchor = at[inside], doc[inside], (least[inside] & np.uint64(0xFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none, none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    anchor, first, final = anchor[new], at[new], at[last]
    context = mix(((p[final + length] - p[first]) * down[first]) ^ np.uint64(0x5851F42D4C957F2D))
    return doc[new], anchor, first, final, hashes[anchor].astype(np.int64), context.astype(np.int64)


def _anchors(length: int, gram: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["i", "u", "at", "lo", "hi", "k", "h"]
        kinds = (None, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

        def flush(part: list[tuple]) -> pa.RecordBatch:
            ends = np.cumsum([len(x[3]) for x in part])
            data = np.frombuffer(b"".join(x[3] for x in part), np.uint8)
            doc, at, first, final, key, context = anchor_rows(data, ends, length, gram)
            begins = ends - np.array([len(x[3]) for x in part])
            moved = np.array([x[2] for x in part])  # where the piece begins in its document
            ids = pa.array([x[0] for x in part], kind).take(pa.array(doc)) if len(doc) else pa.array([], kind)
            own = np.array([x[1] for x in part], np.int64)[doc]
            return pa.RecordBatch.from_arrays([ids, *[pa.array(v, t) for v, t in zip((own, at - begins[doc] + moved[doc], at - final, at - first, key, context), kinds[1:])]], names=names)

        part, size, kind = [], 0, None
        for batch in rows:
            kind = batch.column(0).type
            for i, u, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = x.as_py() or b""
                if len(x) < length:
                    continue
                for s in range(0, max(1, len(x) - length + 1), SLICE):  # pieces of a long text overlap, their windows don't
                    piece = x[s : s + SLICE + length - 1]
                    part.append((i, u, s, piece))
                    size += len(piece)
                    if size >= SLICE:
                        yield flush(part)
                        part, size = [], 0
        if part:
            yield flush(part)

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - (((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) >> 3)


def scan_intervals(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """(member, other, left extension, right extension) wherever a member is in a maximal repeat group of length or more.

    rights are sorted: a sparse suffix array; lefts are the reversed bytes before each anchor. A stack scan over the
    common prefixes of neighbours closes the common-prefix intervals innermost first. Merging two child intervals,
    the smaller's members go to their places in the larger's left order, and the left extensions at these places
    decide; any other member shares no more with the newcomer than it shares with a neighbour that it met deeper.
    """
    found: list[tuple[int, int, int, int]] = []
    reach = max(map(len, lefts))

    def merge(a: list, b: list, depth: int) -> list:
        if depth + reach < length:
            return []  # no interval from here on can hold a group; its members need not be kept
        if len(a) < len(b):
            a, b = b, a
        for z in b:
            at = bisect_left(a, z)
            for y in a[max(0, at - 1) : at + 1]:
                left = _common(y[0], z[0])
                if left + depth >= length:
                    found.append((z[1], y[1], left, depth))
                    found.append((y[1], z[1], left, depth))
            a.insert(at, z)
        return a

    stack: list[tuple[int, list]] = []
    for k in range(len(rights)):
        members = [(lefts[k], k)]
        low = _common(rights[k], rights[k + 1]) if k + 1 < len(rights) else -1
        while stack and stack[-1][0] > low:
            depth, before = stack.pop()
            members = merge(before, members, depth)
        stack.append((low, members))
    return found


_STARTS = "k long, h long, lo int, hi int, spans array<struct<from: int, to: int>>"


def _scan(length: int):
    """For each context (distinct bytes around an anchor, and how often they occur) with repeated starts: these, as
    ranges of offsets before the anchor, in one row."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(5)]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["k", "h", "lo", "hi", "spans"])
            for c in out:
                c.clear()
            return made

        for (key,), (rights, hashes, los, his, times, lefts) in groups(rows, 1):
            spans: dict[int, list[tuple[int, int]]] = {}
            for m, n in enumerate(times):
                if n > 1:  # equal contexts are one leaf: all of its starts repeat
                    spans[m] = [(los[m], his[m])]
            if len(rights) > 1:
                for m, _, left, right in scan_intervals([x[::-1] for x in lefts], rights, length):
                    spans.setdefault(m, []).append((max(los[m], length - right), min(his[m], left)))
            for m, each in spans.items():
                whole: list[dict[str, int]] = []
                for a, b in sorted(each):
                    if a > b:
                        continue
                    if whole and a <= whole[-1]["to"] + 1:
                        whole[-1]["to"] = max(whole[-1]["to"], b)
                    else:
                        whole.append({"from": a, "to": b})
                if whole:
                    for c, v in zip(out, (key, hashes[m], los[m], his[m], whole)):
                        c.append(v)
            if len(out[0]) > 5000:
                yield batch()
        if out[0]:
            yield batch()

    return run


def _merged(spans: Column) -> Column:
    """Ranges of offsets, sorted, with those that touch made one. A context has under `length` offsets."""
    kind = "array<struct<from: int, to: int>>"

    def add(have: Column, s: Column) -> Column:
        top = F.element_at(have, -1)
        longer = F.struct(top["from"].alias("from"), F.greatest(top["to"], s["to"]).alias("to"))
        touches = (F.size(have) > 0) & (s["from"] <= F.try_element_at(have, F.lit(-1))["to"] + 1)
        return F.when(touches, F.concat(F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(have, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


_CONTEXT = "k long, h long, lo int, hi int, times long, lefts binary, rights binary"


def _contexts(length: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out, size = [], 0
            for x, list_ in zip(batch.column(0), batch.column(1)):
                x = x.as_py() or b""
                for c in list_.as_py():
                    at, lo, hi = c["at"], c["lo"], c["hi"]
                    out.append((c["k"], c["h"], lo, hi, c["times"], x[at - hi : at], x[at : at - lo + length]))
                    size += length
                if size > 8 << 20:
                    yield _context_batch(out)
                    out, size = [], 0
            if out:
                yield _context_batch(out)

    return run


def _context_batch(rows: list[tuple], more: tuple = ()) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ["k", "h", "lo", "hi", "times", "lefts", "rights", "k0", "h0", "lo0", "hi0"]
    n = len(rows[0])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names[:n])


def _narrower(length: int, step: int):
    """Each context cut at fixed offsets into pieces of at most `step` starts, keyed by the bytes that all windows of
    the piece share: contexts that only differ further out no longer meet, and equal pieces become one."""

    def number(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for k, h, lo, hi, times, left, right in zip(*[c.to_pylist() for c in batch.columns]):
                for piece in range(lo // step, hi // step + 1):
                    a, b = piece * step, piece * step + step - 1
                    a2, b2 = max(a, lo), min(b, hi)
                    core = (left[len(left) - a :] if a else b"") + right[: max(0, length - b)]
                    own_left, own_right = left[len(left) - b2 :] if b2 else b"", right[: length - a2]
                    key = number(k.to_bytes(8, "little", signed=True), piece.to_bytes(4, "little"), step.to_bytes(4, "little"), core)
                    out.append((key, number(own_left, b"|", own_right), a2, b2, times, own_left, own_right, k, h, lo, hi))
                    if len(out) >= 8000:
                        yield _context_batch(out)
                        out = []
            if out:
                yield _context_batch(out)

    return run


def _repeated_starts(contexts: DataFrame, length: int, group: int, steps: tuple[int, ...]) -> DataFrame:
    spark = contexts.sparkSession
    parts = n_partitions(spark)

    def scanned(table: DataFrame) -> DataFrame:
        table = table.select("k", "rights", "h", "lo", "hi", "times", "lefts")
        return table.repartition(parts, "k").sortWithinPartitions("k", "rights").mapInArrow(_scan(length), _STARTS)

    if not steps:
        return scanned(contexts)
    hot = written(contexts.groupBy("k").count().where(F.col("count") > group).select("k"), "hot")  # a table, as keys is
    if hot.isEmpty():
        return scanned(contexts)
    cool = contexts.join(hot, "k", "left_anti")
    pieces = contexts.join(hot, "k", "left_semi").select("k", "h", "lo", "hi", "times", "lefts", "rights")
    pieces = written(pieces.mapInArrow(_narrower(length, steps[0]), _CONTEXT + ", k0 long, h0 long, lo0 int, hi0 int"), "pieces")
    merged = pieces.groupBy("k", "h", "lo", "hi").agg(F.sum("times").alias("times"), F.first("lefts").alias("lefts"), F.first("rights").alias("rights"))
    found = _repeated_starts(written(merged, "contexts"), length, group, steps[1:])
    owners = pieces.select("k", "h", "lo", "hi", "k0", "h0", "lo0", "hi0")
    back = written(found, "found").join(owners, ["k", "h", "lo", "hi"]).groupBy(F.col("k0").alias("k"), F.col("h0").alias("h"), F.col("lo0").alias("lo"), F.col("hi0").alias("hi"))
    back = back.agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    return scanned(cool).union(back)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(base, found): base has i (doc_id), u (text hash), x (bytes) per row; found has i, u, at and spans of anchors:
    the windows of `length` bytes from at - to to at - from of each span also start elsewhere. An occurrence is one row,
    however its context was told apart."""
    base = docs.select(F.col(doc_id).alias("i"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("x"))
    base = base.select("i", F.xxhash64("x").alias("u"), "x")
    kind = base.schema["i"].dataType.simpleString()
    anchors = written(base.mapInArrow(_anchors(length, gram), f"i {kind}, u long, at long, lo int, hi int, k long, h long"), "anchors")
    twice = written(anchors.groupBy("k").count().where("count > 1").select("k"), "keys")  # a table, so that the join may split a hot key
    repeated = written(anchors.join(twice, "k"), "repeated")
    context = ["k", "h", "lo", "hi"]
    classes = repeated.groupBy(*context).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("i", "u", "at")).alias("r"))
    asked = classes.groupBy(F.col("r.i").alias("i2"), F.col("r.u").alias("u2")).agg(F.collect_list(F.struct("k", "h", "lo", "hi", "times", F.col("r.at").alias("at"))).alias("asked"))
    texts = base.join(asked, F.expr("i <=> i2 AND u = u2")).select("x", "asked")
    contexts = written(texts.mapInArrow(_contexts(length), _CONTEXT), "contexts")
    width = length - gram + 1
    starts = _repeated_starts(contexts, length, group, tuple(s for s in (48, 7, 1) if s < width))
    found = repeated.join(written(starts, "starts"), context).select("i", "u", "at", "spans")
    return base, found


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, keep_text: bool = False, **options: int) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (and kept: the bytes that stay, if keep_text).

    Every byte covered by a string of `length` bytes that also starts elsewhere, in any text, goes; overlaps count.
    Complete: nothing is capped; an anchor with over `group` distinct contexts is told apart by narrower anchors
    until each is small, and equal contexts travel once.

    Defined cases: null text is empty; texts under `length` bytes stay whole; rows that repeat a document count as
    occurrences of each other; null doc_id is allowed; an empty table gives an empty result; other columns are
    ignored. A very long text is cut into overlapping pieces for its anchors; what is gathered for one text (its
    anchors, its spans) is smaller than the text.
    """
    base, found = repeated_spans(docs, doc_id, text, length, **options)
    spans = found.groupBy(F.col("i").alias("i2"), F.col("u").alias("u2")).agg(F.collect_set(F.struct("at", "spans")).alias("spans"))
    rows = base.join(spans, F.expr("i <=> i2 AND u = u2"), "left").select("i", "x", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for x, spans in zip(batch.column(1), batch.column(2)):
                x, kept, at, n_spans, removed = x.as_py() or b"", [], 0, 0, 0
                end = -1
                for s in sorted((a["at"] - s["to"], a["at"] - s["from"] + length) for a in (spans.as_py() or []) for s in a["spans"]):
                    if s[0] > end:
                        kept.append(x[max(end, 0) : s[0]])
                        n_spans += 1
                        removed += s[1] - s[0]
                        end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        end = s[1]
                kept.append(x[max(end, 0) :])
                kept = b"".join(kept)
                for c, v in zip(out, (len(x), removed, n_spans, hashlib.sha256(kept).hexdigest(), len(kept), kept if keep_text else None)):
                    c.append(v)
            columns = [batch.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()))]]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept"]
            k = len(names) if keep_text else len(names) - 1
            yield pa.RecordBatch.from_arrays(columns[:k], names=names[:k])

    kind = base.schema["i"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long" + ", kept binary" * keep_text)
