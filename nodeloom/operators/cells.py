"""Graphs as cells for work that goes over all arcs again and again: nodes lie in blocks by id, arcs in cells of two blocks.

An arc is two places, one in each block. A pass brings the vectors of nodes to the slices of cells, block by block, and takes
one sum a node of the other block back; arcs go with their slice and nothing is looked up arc by arc. A block's vector is
one row, a slice holds SLICE arcs or so; what a pass sends grows with nodes x blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.structure import cut_lineage, forgotten, ranked

SLICE = 2_000_000  # arcs that meet in a task, about; a graph has as many cells as it has times that many arcs
PASS = 20_000_000  # arcs that are brought in order at a time, about, or a fifth of that if they carry something; at most 8 times


class Cells(NamedTuple):
    """arcs(a, b, s, i, j): lists of places i in block a and j in block b, slice s of the cell; slices(a, b, s); blocks(blk, at, ids): of
    a block's nodes the places, ascending, and ids, both int64 bytes; width: places of a block; size: nodes in all;
    parts: the arcs once more, part p has the slices s with s mod their number = p; tables: what each part lies in."""

    arcs: DataFrame
    slices: DataFrame
    blocks: DataFrame
    width: int
    size: int
    parts: list[DataFrame]
    tables: list[DataFrame]


def cell_graph(edges: DataFrame, nodes: DataFrame, once: bool = False, carried: str | None = None) -> Cells:
    """The arcs(src, dst) among nodes(node_id) as cells; once: of arcs that go both ways, src < dst only, each one time. Ids are
    places as they are where they lie close, else their ranks are. carried: a column of arrays of doubles, each as long as the
    others, that goes with the arcs as a list of its numbers, arc by arc."""
    more = [carried] if carried else []
    nodes = cut_lineage(nodes.select("node_id"))
    low, high, size = nodes.agg(F.min("node_id"), F.max("node_id"), F.count(F.lit(1))).first()
    if not size:
        raise ValueError("a graph has nodes")
    own = []
    if high - low >= 4 * size + 1000:
        nodes = cut_lineage(ranked(nodes, ["node_id"], "place"))
        end = lambda c: nodes.select(F.col("node_id").alias(c), F.col("place").alias(f"_{c}"))
        arcs = cut_lineage(edges.select("src", "dst", *more).join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *more), "places")
        own, span = [arcs], size
    else:
        nodes = nodes.withColumn("place", F.col("node_id") - low)
        arcs, span = edges.select((F.col("src") - low).alias("src"), (F.col("dst") - low).alias("dst"), *more), high - low + 1
    arcs = arcs.where(F.col("src").between(0, span - 1) & F.col("dst").between(0, span - 1) & (F.col("src") < F.col("dst") if once else F.lit(True)))
    count = arcs.count()
    width = math.ceil(span / max(1, math.ceil(math.sqrt(count / SLICE))))
    at = arcs.select(F.floor(F.col("src") / width).alias("a"), F.floor(F.col("dst") / width).alias("b"), (F.col("src") % width).cast("int").alias("i"), (F.col("dst") % width).cast("int").alias("j"), *more)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if once and batch.num_rows:  # in order, so that what is there twice follows itself
                keys = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:4]])
                new = np.r_[last is None or (keys[:, 0] != last).any(), (keys[:, 1:] != keys[:, :-1]).any(0)]
                last, batch = keys[:, -1], batch if new.all() else batch.filter(pa.array(new))
            if batch.num_rows:
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.r_[np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]), len(a)].astype(np.int32)
                out = [pa.array(a[cuts[:-1]]), pa.array(b[cuts[:-1]]), *[pa.ListArray.from_arrays(pa.array(cuts), batch.column(c)) for c in (2, 3)]]
                if more:
                    x = batch.column(4).flatten()
                    out.append(pa.ListArray.from_arrays(pa.array(cuts * (len(x) // len(a))), x))
                yield pa.RecordBatch.from_arrays(out, names=["a", "b", "i", "j", *more])

    n, parts = max(1, min(8, count // (PASS // 5 if carried else PASS))), []
    for k in range(n):
        part = at if n == 1 else at.where(F.pmod(F.xxhash64("a", "i"), F.lit(n)) == k)
        parts.append(cut_lineage(part.repartitionByRange("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j").mapInArrow(lists, "a long, b long, i array<int>, j array<int>" + "".join(f", {c} array<double>" for c in more)), "cells"))
    forgotten(*own)
    tables = [p.withColumn("p", F.lit(k).cast("long")) for k, p in enumerate(parts)]
    sizes = cut_lineage(reduce(DataFrame.union, [t.select("a", "b", "p", F.size("i").alias("n")) for t in tables]).groupBy("a", "b", "p").agg(F.ceil(F.sum("n") / SLICE).alias("n")))
    dealt = (F.pmod(F.xxhash64("i", "j"), "n") * n + F.col("p")).alias("s")
    split = [t.join(F.broadcast(sizes), ["a", "b", "p"]).select("a", "b", dealt, "i", "j", *more) for t in tables]
    slices = sizes.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("r"), "p").select("a", "b", (F.col("r") * n + F.col("p")).alias("s"))

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        p, i = rows.column("place").to_numpy(), rows.column("node_id").to_numpy()
        order = np.argsort(p)
        return pa.table({"blk": [key[0].as_py()], "at": [(p[order] % width).astype(np.int64).tobytes()], "ids": [i[order].astype(np.int64).tobytes()]}, schema=pa.schema([("blk", pa.int64()), ("at", pa.binary()), ("ids", pa.binary())]))

    blocks = cut_lineage(nodes.withColumn("blk", F.floor(F.col("place") / width)).groupBy("blk").applyInArrow(gather, "blk long, at binary, ids binary"), "blocks")
    return Cells(reduce(DataFrame.union, split), slices, blocks, width, size, split, parts)


def summed(cells: Cells, vectors: DataFrame, k: int) -> DataFrame:
    """(blk, sums): of each place of a block the sums of vectors(blk, v) over the arcs that leave it, both k rows of
    `width` doubles; blocks with no arcs are absent."""
    width = cells.width

    def meet(key: tuple, arcs: pa.Table, vector: pa.Table) -> pa.Table:
        out = np.zeros((k, width))
        if arcs.num_rows and vector.num_rows:
            v = np.frombuffer(vector.column("v")[0].as_py()).reshape(k, width)
            i, j = (np.concatenate([c.flatten().to_numpy() for c in arcs.column(x).chunks]) for x in ("i", "j"))
            for r in range(k):
                out[r] = np.bincount(i, v[r][j], width)
        return pa.table({"blk": [key[0].as_py()], "sums": [out.tobytes()]}, schema=pa.schema([("blk", pa.int64()), ("sums", pa.binary())]))

    sent = cells.slices.join(vectors.select(F.col("blk").alias("b"), "v"), "b").select("a", "b", "s", "v")
    met = cells.arcs.groupBy("a", "b", "s").cogroup(sent.groupBy("a", "b", "s")).applyInArrow(meet, "blk long, sums binary")
    return added(met, k * width)


def added(rows: DataFrame, many: int) -> DataFrame:
    """(blk, sums): the bytes of `many` doubles in rows(blk, sums), added up by block."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(many)
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("sums")):
                out += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_pydict({"blk": [key[0].as_py()], "sums": [out.tobytes()]}, schema=pa.schema([("blk", pa.int64()), ("sums", pa.binary())]))

    return rows.groupBy("blk").applyInArrow(add, "blk long, sums binary")


def each_block(blocks: DataFrame, work: Callable[..., tuple], columns: list[str], schema: str) -> DataFrame:
    """blocks, each row by itself through work(*columns), which gives the new row's values; bytes go as they are."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = work(*[c[k].as_py() for c in batch.columns])
                yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(names, got)}, schema=kinds)

    return blocks.select(*columns).mapInArrow(run, schema)


def node_rows(cells: Cells) -> DataFrame:
    """(blk, pos, node_id): the nodes of each block, pos 0, 1, ... in the order of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column(0)[k].as_py())), pa.array(np.arange(len(ids))), pa.array(ids)], names=["blk", "pos", "node_id"])

    return cells.blocks.select("blk", "ids").mapInArrow(run, "blk long, pos long, node_id long")


def packed(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(blk, v): arrays of k doubles in rows(blk, pos, column) as the bytes of a matrix, k rows of the block's nodes."""

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("pos").to_numpy())
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, k)[order]
        return pa.table({"blk": [key[0].as_py()], "v": [np.ascontiguousarray(x.T).tobytes()]}, schema=pa.schema([("blk", pa.int64()), ("v", pa.binary())]))

    return rows.select("blk", "pos", F.col(column).alias("x")).groupBy("blk").applyInArrow(gather, "blk long, v binary")


def unpacked(cells: Cells, packs: DataFrame, k: int) -> DataFrame:
    """(node_id, x): what `packed` has packed, v of packs(blk, v), an array of k doubles a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[r].as_py(), np.int64)
                x = np.frombuffer(batch.column(1)[r].as_py()).reshape(k, len(ids)).T
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(ids) + 1, k, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))], names=["node_id", "x"])

    return cells.blocks.select("blk", "ids").join(packs.select("blk", "v"), "blk").select("ids", "v").mapInArrow(run, "node_id long, x array<double>")
