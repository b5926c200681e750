"""Merkle manifest of a dataset, with the proof of every row found by pointer jumping.

Leaves are digests of rows. Each group of rows (a language) is a binary tree over its leaves in order, and a last tree
over the groups' roots gives the root of the dataset. Levels are hashed ten at a time, a run of 1024 neighbours to a
group, so a hot language is many groups. Every node then holds the segment of siblings towards an ancestor; joining the
table with itself doubles the distance and concatenates the segments, until all leaves hold the way to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nodeloom.llm._shared import written
from nodeloom.operators.structure import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 10  # levels that one task makes of a run of 2 ** HEIGHT neighbours
BROADCAST_ROWS = 50_000  # of the side that a jump looks up; beyond it the join is by exchange
TOP = -1  # the number of the tree over the groups' roots
_STEP = 33  # bytes of a step with a sibling: its side, its digest


def leaf(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields one after the other: `-` for null, else UTF-8 byte count, `:`, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in text]), 256)


def _digest(parts: list[bytes]) -> bytes:
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def _climb(kind: pa.DataType):
    """Of one run of neighbours (t, run, n, idx, digest, row, altered; idx from a multiple of 2 ** HEIGHT on; n nodes on
    their level of tree t): a row per node below the next run's level, with its step (L or R and the sibling's digest, or - if it has
    none), and a row per node that the run passes on."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        tree, n = rows.column("t")[0].as_py(), rows.column("n")[0].as_py()
        own, first = rows.column("digest").to_pylist(), rows.column("idx")[0].as_py()
        levels, places, steps, digests, sizes = [], [], [], [], []
        for level in range(HEIGHT):
            if n == 1:
                break
            for k, d in enumerate(own):
                twin = k ^ 1
                steps.append((b"R" if k % 2 == 0 else b"L") + own[twin] if twin < len(own) else b"-")
            levels += [level] * len(own)
            places += range(first, first + len(own))
            digests += own
            sizes += [n] * len(own)
            own, first, n = [_digest(own[k : k + 2]) for k in range(0, len(own), 2)], first // 2, (n + 1) // 2
        passed = len(own) if n > 1 else 1
        rest = len(levels) + passed
        fill = lambda name, kind: pa.concat_arrays([rows.column(name).combine_chunks().cast(kind), pa.nulls(max(0, rest - rows.num_rows), kind)]).slice(0, rest)
        return pa.table(
            {
                "t": pa.array([tree] * rest, pa.int64()),
                "level": pa.array(levels + [HEIGHT if n > 1 else -1] * passed, pa.int32()),
                "idx": pa.array([*places, *range(first, first + passed)], pa.int64()),
                "n": pa.array(sizes + [n] * passed, pa.int64()),
                "step": pa.array(steps + [None] * passed, pa.binary()),
                "digest": pa.array(digests + own[:passed], pa.binary()),
                "row": fill("row", kind),
                "altered": fill("altered", pa.binary()),
            }
        )

    return run


def _trees(leaves: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, tops) of leaves(t, idx, n, digest, row, altered), n the number of leaves of tree t, `most` the largest n.
    nodes(t, level, idx, n, step, digest, row, altered): all but the top of each tree; n is the size of the level. tops(t, digest)."""
    kind = to_arrow_type(leaves.schema["row"].dataType)
    schema = f"t long, level int, idx long, n long, step binary, digest binary, row {leaves.schema['row'].dataType.simpleString()}, altered binary"
    now, base, nodes, tops = leaves, 0, None, None
    while True:
        made = now.withColumn("run", F.shiftright("idx", HEIGHT)).groupBy("t", "run").applyInArrow(_climb(kind), schema)
        made = written(made, "levels")
        some = made.where(f"level between 0 and {HEIGHT - 1}").withColumn("level", (F.col("level") + base).cast("int"))
        ends = made.where("level = -1").select("t", "digest")
        nodes, tops = (some, ends) if nodes is None else (nodes.union(some), tops.union(ends))
        most = -(-most >> HEIGHT)
        if most <= 1:
            return nodes, tops
        now, base = made.where(f"level = {HEIGHT}").drop("level", "step"), base + HEIGHT


def _jumped(nodes: DataFrame, alone: bool) -> DataFrame:
    """nodes (with t, level, idx, n, step, row, altered) as pointers to the parent: at, al, ai, null where that is the root."""
    last = F.col("n") <= 2  # the parent is the top of its tree
    root = (F.col("t") == TOP) & last if not alone else last
    parent = {"at": F.when(last, TOP).otherwise(F.col("t")), "al": F.when(last, 0).otherwise(F.col("level") + 1), "ai": F.when(last, F.col("t")).otherwise(F.shiftright("idx", 1))}
    return nodes.select("t", "level", "idx", *[F.when(~root, v).alias(k) for k, v in parent.items()], F.col("step").alias("way"), "digest", "row", "altered")


def _to_root(points: DataFrame) -> DataFrame:
    """points with `way` to the root for all rows with a `row`. Each round joins the table with itself at the ancestors.

    After k rounds a pointer spans 2 ** k levels, so what it meets is at least that high in its tree, or in the last one:
    only those nodes are looked up, and only leaves and nodes that can still be looked up are kept."""
    points, done, k = written(points, "way"), None, 0
    while True:
        ready = points.where("ai IS NULL AND row IS NOT NULL")
        done = ready if done is None else done.union(ready)
        open_ = points.where("ai IS NOT NULL")
        if open_.isEmpty():
            return done
        high = points.where(f"t = {TOP} OR level >= {2**k}").select(F.col("t").alias("t2"), F.col("level").alias("l2"), F.col("idx").alias("i2"), *[F.col(c).alias(c + "2") for c in ("at", "al", "ai", "way")])
        if high.count() <= BROADCAST_ROWS:
            high = F.broadcast(high)
        met = open_.join(high, (F.col("at") == F.col("t2")) & (F.col("al") == F.col("l2")) & (F.col("ai") == F.col("i2")))
        met = met.select("t", "level", "idx", F.col("at2").alias("at"), F.col("al2").alias("al"), F.col("ai2").alias("ai"), F.concat("way", "way2").alias("way"), "digest", "row", "altered")
        still = f"row IS NOT NULL OR t = {TOP} OR level >= {2 ** (k + 1)}"
        ended = points.where(f"ai IS NULL AND row IS NULL AND (t = {TOP} OR level >= {2 ** (k + 1)})")
        points, k = written(met.where(still).union(ended), "way"), k + 1


def siblings(way: bytes) -> list[tuple[str, bytes]]:
    """The steps of a way: ("L" | "R" | "-", the sibling's digest)."""
    out, at = [], 0
    while at < len(way):
        side = chr(way[at])
        out.append((side, way[at + 1 : at + _STEP] if side != "-" else b""))
        at += _STEP if side != "-" else 1
    return out


def fold(digest: bytes, way: bytes) -> bytes:
    """The root that a leaf's digest gives with the siblings on its way."""
    for side, other in siblings(way):
        digest = _digest([other, digest] if side == "L" else [digest, other] if side == "R" else [digest])
    return digest


def merkle_manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; and way (binary, see `siblings`), the proof.

    A row's leaf is the digest of its fields. Leaves of one group ascend by doc_id (null first, then by digest); two
    neighbours become one node, a last one alone its own digest's, until one is left: the group's subroot. Subroots,
    ordered by group (null first, then by bytes), give the root likewise. proof_sha256 is over the hex of the siblings from
    leaf to root. With `altered` (field -> value), rows that `where` selects fold from those values instead: verified
    tells whether the root comes out.

    Defined cases: nulls are fields like others; equal rows are leaves of their own; an empty table gives an empty result;
    other columns are ignored. Texts are read once, where they lie: what moves is 32 bytes a leaf.
    """
    x = docs.select(*[F.col(c).alias(f"f{k}") for k, c in enumerate(fields)], F.col(doc_id).alias("i"), F.col(group).cast("string").alias("g"), (where if where is not None else F.lit(False)).alias("w"), *[v.alias(f"a{k}") for k, v in enumerate((altered or {}).values())])
    plain = [F.col(f"f{k}") for k in range(len(fields))]
    other = [F.col(f"a{list(altered).index(c)}") if altered and c in altered else p for c, p in zip(fields, plain)]
    x = x.select(F.struct("i").alias("row"), "g", F.unhex(leaf(plain)).alias("digest"), F.when(F.col("w"), F.unhex(leaf(other))).alias("altered"))
    placed = ranked(written(x, "leaves"), ["g", "row", "digest"], "pos")
    groups = ranked(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")), ["g"], "t")
    groups = written(groups, "groups")
    most, trees = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    kind = x.schema["row"].dataType["i"].dataType
    schema = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, way binary"
    if not trees:
        return docs.sparkSession.createDataFrame([], schema)
    own = groups.select(F.col("g").alias("g2"), "n", "first", "t")
    placed = placed.join(own, F.col("g").eqNullSafe(F.col("g2"))).select("t", (F.col("pos") - F.col("first")).alias("idx"), "n", "digest", "row", "altered")
    nodes, tops = _trees(placed, most)
    last = tops.select(F.lit(TOP).cast("long").alias("t"), F.col("t").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest", F.lit(None).cast(x.schema["row"].dataType).alias("row"), F.lit(None).cast("binary").alias("altered"))
    above, top = _trees(last, trees)
    root = top.first()["digest"]
    single = placed.where("n = 1").select("t", F.lit(0).alias("level"), "idx", F.lit(TOP).cast("long").alias("at"), F.lit(0).alias("al"), F.col("t").alias("ai"), F.lit(b"").alias("way"), "digest", "row", "altered")
    if trees == 1:
        single = single.withColumns({"at": F.lit(None).cast("long"), "al": F.lit(None).cast("int"), "ai": F.lit(None).cast("long")})
    found = _to_root(_jumped(nodes, trees == 1).union(_jumped(above, trees == 1)).union(single))
    rows = found.join(tops.select("t", F.col("digest").alias("subroot")), "t").select("row.i", "digest", "altered", "subroot", "way")

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for digest, changed, sub, way in zip(*[batch.column(c).to_pylist() for c in range(1, 5)]):
                folded = fold(changed or digest, way)
                proof = sha256("".join(d.hex() for _, d in siblings(way)).encode()).hexdigest()
                for c, v in zip(out, (digest.hex(), sub.hex(), proof, folded.hex(), folded == root)):
                    c.append(v)
            strings = [pa.array(c, pa.string()) for c in out[:4]]
            columns = [batch.column(0), *strings[:2], pa.array([root.hex()] * batch.num_rows, pa.string()), *strings[2:], pa.array(out[4], pa.bool_()), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "way"])

    return rows.mapInArrow(proofs, schema)
