"""Near-duplicate join on word n-gram sets: a prefix-tree (trie) join over globally ordered sets.

1. Every text becomes the set of its 5-word shingle hashes. Sets meet in buckets of the hash space, where each
   shingle's document frequency is known; a document can only have a link if at least 75 % of its set also occurs
   elsewhere, so most documents end here.
2. Documents with equal sets are one class. The class representatives' sets are counted once more among themselves
   and put into the global order: ascending document frequency, then hash. A linked pair shares one of the first
   n - ceil(0.75 n) + 1 shingles of each (prefix filter), and the rarest shingles come first, so a phrase that a
   third of all documents share is in no prefix of a document that has enough of its own.
3. Representatives that share a prefix shingle form candidate clusters. Each cluster is joined by a compressed trie
   of its ordered sets: a probe walks down, sharing the overlap counted on common paths, and leaves a subtree when the
   remaining lengths cannot reach the threshold, or when the whole subtree already is in the probe's component.
   A cluster larger than a block is cut into blocks of alike sets, and only blocks that have a prefix shingle in
   common, and sizes that can link, meet.

A batch sends a shingle once, however many of its texts have it, so a shingle that all texts share is a row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm._shared import components, groups, n_partitions, trimmed, written
from nodeloom.llm._shingles import mix, shingle_sets
from nodeloom.operators.structure import ranked

BATCH_BYTES = 8 << 20
SLICE_BYTES = 512 << 10  # of text hashed at a time: some 10 bytes of arrays for each
BLOCK_SETS = 512
_ALL = 65535  # in place of a text's number in its batch: several texts of the batch have the shingle
_PIECES = "bucket int, batch long, keys binary, docs binary, counts binary, meta binary"
_NAMES = ["bucket", "batch", "keys", "docs", "counts", "meta"]
_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _batches(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list, list[np.ndarray], list[np.ndarray]]]:
    """(batch id, ids, set sizes, elements of the sets) of about BATCH_BYTES of text; the id is the same when a lost task
    runs again. Texts are hashed SLICE_BYTES at a time, whole texts, and only their elements stay; a slice has an array each."""
    task, k, ids, sizes, keys, size = TaskContext.get().partitionId(), 0, [], [], [], 0
    part: list[str] = []
    held = 0

    def hash_part() -> None:
        if part:
            sets = shingle_sets(part, width)
            sizes.append(np.array([len(s) for s in sets], np.int64))
            keys.append(np.concatenate(sets))
            part.clear()

    for batch in rows:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            ids.append(i)
            part.append(t)
            size += len(t)
            held += len(t)
            full = size >= BATCH_BYTES or len(ids) == 60_000
            if full or held >= SLICE_BYTES:
                hash_part()
                held = 0
            if full:
                yield (task << 32) + k, ids, sizes, keys
                k, ids, sizes, keys, size = k + 1, [], [], [], 0
        del batch
    if ids:
        hash_part()
        yield (task << 32) + k, ids, sizes, keys


def _set_hash(sizes: list[np.ndarray], keys: list[np.ndarray], salt: int) -> bytes:
    """A hash of each set, as the order of its elements does not matter; slice by slice."""
    out = []
    for n, each in zip(sizes, keys):
        p, ends = np.concatenate(([np.uint64(0)], np.cumsum(mix(each + np.uint64(salt)), dtype=np.uint64))), np.cumsum(n)
        out.append(mix(p[ends] - p[ends - n]).tobytes())
    return b"".join(out)


def _dealt(batch: int, ids: list, sizes: list[np.ndarray], parts: list[np.ndarray], buckets: int, full: bool) -> pa.RecordBatch:
    """The rows of _pieces of one batch. Empties parts."""
    meta = np.array(ids, np.int64).tobytes() + b"".join(n.tobytes() for n in sizes) + _set_hash(sizes, parts, 1) + _set_hash(sizes, parts, 2)
    keys = np.concatenate(parts)
    parts.clear()
    bucket = (keys >> np.uint64(32)).astype(np.uint32) % np.uint32(buckets)
    order = np.lexsort((keys, bucket))
    keys, bucket = keys[order], bucket[order]
    docs = np.repeat(np.arange(len(ids), dtype=np.uint16), np.concatenate(sizes))[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((first, [len(keys)])))
    cut = np.concatenate(([0], np.cumsum(np.bincount(bucket[first], minlength=buckets))))
    del bucket
    some = np.flatnonzero(np.diff(cut)).tolist()
    if full:
        each, what = keys[first], times.astype(np.uint32)
        del keys, first, times
        out = [(b, batch, each[cut[b] : cut[b + 1]].tobytes(), None, what[cut[b] : cut[b + 1]].tobytes(), None) for b in some]
        out.append((-1, batch, each.tobytes(), docs.tobytes(), what.tobytes(), meta))
    else:
        each, what = keys[first].astype(np.uint32), np.where(times > 1, np.uint16(_ALL), docs[first]).astype(np.uint16)
        own = np.bincount(docs[np.repeat(times > 1, times)], minlength=len(ids)).astype(np.uint32)
        del keys, first, times
        out = [(b, batch, each[cut[b] : cut[b + 1]].tobytes(), what[cut[b] : cut[b + 1]].tobytes(), None, None) for b in some]
        out.append((int(batch % buckets), batch, None, None, own.tobytes(), meta))
    del each, what, docs
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)


def _pieces(buckets: int, width: int, full: bool):
    """Per batch, for each bucket of the hash space: its distinct set elements; and one row of the batch's own, with meta.

    full: elements are whole, with the number of the batch's texts that have them; the batch's own row has all of them,
    in the order of the buckets, with the texts of each, as bucket -1. Otherwise they are the hash's lower half, with the text's
    number, or _ALL; the own row counts, per text, the elements that another text of the batch has too. Own rows have
    the texts' ids, set sizes and set hashes.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, sizes, keys in _batches(rows, width):
            yield _dealt(batch, ids, sizes, keys, buckets, full)

    return run


def _frequencies(full: bool):
    """Answers to a bucket's pieces, per batch. full: each element's document frequency, in the order asked. Otherwise:
    which texts have how many elements that another batch has too."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), columns in groups(rows, 1):
            whole = list(zip(*columns))
            out = [(-1, batch, None, None, count, meta) for batch, _, _, count, meta in whole if meta is not None]
            asked = [row for row in whole if row[4] is None]
            if out:  # a batch's own row only passes through
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)
            if not asked:
                continue
            batches, keys, docs, counts, _ = zip(*asked)
            each = [np.frombuffer(k, np.uint64 if full else np.uint32) for k in keys]
            every, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            order = np.argsort(every, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
            if full:
                times = np.concatenate([np.frombuffer(c, np.uint32) for c in counts])
            else:
                text = np.concatenate([np.frombuffer(d, np.uint16) for d in docs])
                times = np.where(text == _ALL, 2, 1)
            df = np.empty(len(every), np.int64)
            df[order] = np.repeat(np.add.reduceat(times[order].astype(np.int64), edge), np.diff(np.concatenate((edge, [len(every)]))))
            out = []
            for batch, b, a in zip(batches, ends.tolist(), (ends - [len(x) for x in each]).tolist()):
                if full:
                    out.append((bucket, batch, None, None, df[a:b].astype(np.uint32).tobytes(), None))
                else:
                    mine, common = text[a:b], df[a:b] > 1
                    doc, count = np.unique(mine[common & (mine != _ALL)], return_counts=True)
                    out.append((bucket, batch, None, doc.tobytes(), count.astype(np.uint32).tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)

    return run


def _meta(raw: bytes) -> list[np.ndarray]:
    n = len(raw) // 32
    return [np.frombuffer(raw, np.int64, n, 8 * n * k) for k in range(4)]


def _shared_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (_, _, docs, counts, metas) in groups(rows, 1):
        ids, n, a, b = _meta(metas[0])  # bucket -1 stands first
        count = np.frombuffer(counts[0], np.uint32).astype(np.int64)
        for d, v in zip(docs[1:], counts[1:]):
            count[np.frombuffer(d, np.uint16)] += np.frombuffer(v, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, n, a, b, count)], names=["i", "n", "a", "b", "shared"])


def _ordered_sets(percent: int):
    """Documents that can have a link: their shared elements in global order, their prefix of these, the least element."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, keys, docs, counts, metas) in groups(rows, 1):
            ids, n, _, _ = _meta(metas[0])
            each, times = np.frombuffer(keys[0], np.uint64), np.frombuffer(counts[0], np.uint32)
            if not len(each):
                continue
            df = np.concatenate([np.frombuffer(c, np.uint32) for c in counts[1:]])
            doc, key, df = np.frombuffer(docs[0], np.uint16), np.repeat(each, times), np.repeat(df, times)
            common = df > 1
            doc, key, df = doc[common], key[common], df[common]
            order = np.lexsort((key, df, doc))
            doc, key, df = doc[order], key[order], df[order]
            cut = np.searchsorted(doc, np.arange(len(ids) + 1))
            out = []
            for k in range(len(ids)):
                s, size = int(cut[k + 1] - cut[k]), int(n[k])
                if s and 100 * s >= percent * size:
                    prefix = size - -(-percent * size // 100) + 1 - (size - s)
                    part = slice(cut[k], cut[k + 1])
                    out.append((int(ids[k]), size, key[part].tobytes(), df[part].tobytes(), key[part][:prefix].astype(np.int64).tolist(), int(key[part].min().astype(np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()))], names=["i", "n", "keys", "df", "prefix", "low"])

    return run


class Trie:
    """A compressed prefix tree over sorted element sequences: node arrays, leaves in sequence order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.order, self.sets, self.sizes = order, [sets[k] for k in order], sizes[order]
        self.nodes: list[tuple[int, int, int, int, list[int]]] = []  # first leaf, end, depth above, depth, children
        n = len(sets)
        common = []
        for x, y in zip(self.sets, self.sets[1:]):
            m = min(len(x), len(y))
            unequal = np.flatnonzero(x[:m] != y[:m])
            common.append(int(unequal[0]) if len(unequal) else m)
        self.longest = [len(s) for s in self.sets]
        # a stack scan of the common lengths closes the inner nodes; a child's depth above is its parent's depth
        stack: list[list] = []  # [first leaf, depth, children]

        def close(node: list, end: int, above: int) -> int:
            first, depth, children = node
            for c in children:
                a, b, _, d, sub = self.nodes[c]
                self.nodes[c] = (a, b, depth, d, sub)
            self.nodes.append((first, end, above, depth, children))
            return len(self.nodes) - 1

        for k in range(n):
            node: list = [k, len(self.sets[k]), []]
            low = common[k] if k < n - 1 else 0
            stack.append(node)
            while stack and stack[-1][1] > low:
                done = stack.pop()
                at = close(done, k + 1, low)
                if stack and stack[-1][1] >= low:
                    stack[-1][2].append(at)
                else:
                    stack.append([done[0], low, [at]])
                    break
        self.root = close(stack.pop(), n, 0) if stack else None
        assert not stack
        self.most = [int(max(len(s) for s in self.sets[a:b])) for a, b, *_ in self.nodes] if n < 64 else [max(self.longest[a:b]) for a, b, *_ in self.nodes]
        self.low = [int(self.sizes[a:b].min()) for a, b, *_ in self.nodes]
        self.high = [int(self.sizes[a:b].max()) for a, b, *_ in self.nodes]

    def probe(self, x: np.ndarray, size: int, mark: np.ndarray, percent: int, comp: np.ndarray, me: int, link) -> None:
        """Calls link(leaf) for leaves that are linked with x, until all of a subtree is in x's component.

        mark has the elements of x set; comp[leaf] is a leaf's component, me() that of x.
        """
        stack = [(self.root, 0)]
        while stack:
            at, overlap = stack.pop()
            first, end, above, depth, children = self.nodes[at]
            if 100 * self.high[at] < percent * size or percent * self.low[at] > 100 * size:
                continue
            mine = me()
            if comp[first] == mine and (comp[first:end] == mine).all():
                continue
            edge = self.sets[first][above:depth]
            left = len(x)
            if len(edge):
                overlap += int(mark[edge].sum())
            if depth:
                left = len(x) - int(np.searchsorted(x, self.sets[first][depth - 1], "right"))
            most = overlap + min(left, self.most[at] - depth)
            if (100 + percent) * most < percent * (size + self.low[at]):
                continue
            if children:
                stack.extend((c, overlap) for c in children)
            if not children or any(self.longest[k] == depth for k in (first,)):
                for k in range(first, end):  # sequences that end here
                    if self.longest[k] != depth:
                        break
                    if (100 + percent) * overlap >= percent * (size + int(self.sizes[k])) and comp[k] != me():
                        link(k)


def trie_links(ids: list[int], sizes: list[int], sets: list[np.ndarray], built: list[int], probes: list[int], percent: int) -> list[tuple[int, int]]:
    """A forest of links between the members `built` (in the trie) and `probes`, complete up to connectivity."""
    trie = Trie([sets[k] for k in built], np.array([sizes[k] for k in built]))
    member = {k: p for p, k in enumerate(built[o] for o in trie.order)}
    name = np.array([built[o] for o in trie.order])  # leaf -> component, named by a member
    comp, found = name.copy(), []
    universe = 1 + max((int(s[-1]) for s in sets if len(s)), default=0)
    mark = np.zeros(universe, bool)
    outside = {}
    for k in probes:
        x = sets[k]
        mark[x] = True
        here = member.get(k)

        def me(k: int = k, here: int | None = here) -> int:
            return int(comp[here]) if here is not None else outside.get(k, -1 - k)

        def link(leaf: int, k: int = k, here: int | None = here) -> None:
            found.append((ids[int(name[leaf])], ids[k]))
            mine, other = me(), int(comp[leaf])
            if here is None and mine < 0:
                outside[k] = other
            else:
                comp[comp == mine] = other
                for p, c in outside.items():
                    if c == mine:
                        outside[p] = other

        trie.probe(x, sizes[k], mark, percent, comp, me, link)
        mark[x] = False
    return found


def _join_blocks(percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, first, second), (blocks, ids, sizes, keys, dfs) in groups(rows, 3):
            raw = [np.frombuffer(k, np.uint64) for k in keys]
            every, df = np.concatenate(raw), np.concatenate([np.frombuffer(d, np.uint32) for d in dfs])
            distinct, at, place = np.unique(every, return_index=True, return_inverse=True)
            rank = np.empty(len(distinct), np.uint32)
            rank[np.lexsort((distinct, df[at]))] = np.arange(len(distinct), dtype=np.uint32)
            sets = np.split(rank[place], np.cumsum([len(r) for r in raw])[:-1])
            built = [k for k in range(len(ids)) if blocks[k] == first]
            probes = built if first == second else [k for k in range(len(ids)) if blocks[k] == second]
            if built and probes and len(ids) > 1:
                links = trie_links(ids, sizes, sets, built, probes, percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["x", "y"])

    return run


def _met_blocks(ordered: DataFrame, near: DataFrame, posts: DataFrame, block_sets: int, percent: int) -> DataFrame:
    """The members of large clusters, once for each pair of blocks that meets. Blocks are runs of block_sets members by
    (cluster, least element, id): sets that are alike mostly have the same least element."""
    order = near.join(ordered.select("i", "n", "low"), "i")
    order = ranked(order, ["cluster", "low", "i"], "place").select("i", "cluster", "n", F.floor(F.col("place") / block_sets).alias("own"))
    order = written(order, "blocks")
    seen = posts.join(order, "i").groupBy("cluster", "e", "own").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    seen = written(seen, "seen")
    other = seen.select("cluster", "e", F.col("own").alias("second"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    fits = f"own <= second AND 100 * high >= {percent} * low2 AND 100 * high2 >= {percent} * low"
    pairs = seen.join(other, ["cluster", "e"]).where(fits).select("cluster", F.col("own").alias("first"), "second").distinct()
    pairs = written(pairs, "pairs")
    ends = pairs.select("cluster", "first", "second", F.col("first").alias("own")).union(pairs.where("first <> second").select("cluster", "first", "second", F.col("second").alias("own")))
    met = order.select("i", "cluster", "own").join(ends, ["cluster", "own"])
    return met.join(ordered.select("i", "n", "keys", "df"), "i").select("cluster", "first", "second", "own", "i", "n", "keys", "df")


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two texts are linked when 100 * |intersection| >= percent * |union| of their shingle sets. Complete: no pair is
    capped or sampled; clusters over block_sets members are joined by blocks that share a prefix shingle, and a task holds
    two blocks.
    Shingles are told apart by 64-bit hashes.

    Defined cases: null and word-free texts have an empty set and are their own component; texts under `width` words
    have one shingle; rows that repeat a doc_id are one node, each with its own row; rows with null doc_id link with
    nothing and have a null component_id; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = n_partitions(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("x"))
    named = base.where("i IS NOT NULL")

    def answered(asked: DataFrame, full: bool) -> DataFrame:
        return asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_frequencies(full)), _PIECES)

    def by_batch(rows: DataFrame) -> DataFrame:
        return rows.select("batch", "bucket", "keys", "docs", "counts", "meta").repartition(parts, "batch").sortWithinPartitions("batch", "bucket")

    counted = by_batch(answered(named.mapInArrow(trimmed(_pieces(4 * parts, width, False)), _PIECES), False))
    info = written(counted.mapInArrow(trimmed(_shared_counts), "i long, n long, a long, b long, shared long"), "sets")
    may = info.where(f"n > 0 AND 100 * shared >= {percent} * n")
    classes = written(may.groupBy("n", "a", "b").agg(F.min("i").alias("rep")), "classes")  # a table, so that a hot class can be split
    same = may.join(classes, ["n", "a", "b"]).where("i <> rep").select(F.col("rep").alias("x"), F.col("i").alias("y"))
    chosen = classes.select(F.col("rep").alias("i")).distinct().hint("merge")  # grows with the input: never a broadcast
    reps = named.join(chosen, "i", "left_semi").dropDuplicates(["i", "x"])
    pieces = written(reps.mapInArrow(trimmed(_pieces(4 * parts, width, True)), _PIECES), "representatives")
    ordered = by_batch(pieces.where("bucket < 0").union(answered(pieces.where("bucket >= 0"), True))).mapInArrow(trimmed(_ordered_sets(percent)), "i long, n long, keys binary, df binary, prefix array<long>, low long")
    ordered = written(ordered, "ordered")

    posts = ordered.select("i", F.explode("prefix").alias("e"))
    heads = posts.groupBy("e").agg(F.min("i").alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = components(posts.join(heads, "e").where("i <> h").select("i", "h").distinct(), "i", "h")
    near = written(near.select(F.col("node").alias("i"), F.col("component_id").alias("cluster")), "clusters")
    large = written(near.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_sets).select("cluster"), "large")
    sets = ordered.select("i", "n", "keys", "df")
    placed = sets.join(near.join(large, "cluster", "left_anti"), "i").select("cluster", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("second"), F.lit(0).cast("long").alias("own"), "i", "n", "keys", "df")
    if not large.isEmpty():
        placed = placed.union(_met_blocks(ordered, near.join(large, "cluster"), posts, block_sets, percent))
    placed = placed.repartition(parts, "cluster", "first", "second").sortWithinPartitions("cluster", "first", "second")
    links = written(placed.mapInArrow(trimmed(_join_blocks(percent)), "x long, y long"), "links")

    found = components(links.union(same), "x", "y").withColumnRenamed("node", "i")
    out = info.join(found, "i", "left").select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "i").alias("component_id"))
    lost = base.where("i IS NULL").mapInArrow(_sizes(width), "n long").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.union(lost)


def _sizes(width: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sizes, _ in _batches(rows, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sizes))], names=["n"])

    return run
