"""Random walks as step joins: all walks advance together, a step joins each walk with one arc; draws are hash uniforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.scalars import uniform
from nodeloom.operators.structure import cut_lineage, forgotten, is_symmetric, row_normalize, running

ATTEMPTS = 6  # candidates that a second-order step draws for rejection, before it weighs all neighbours
LIST = 512  # neighbours in one row of a list, at most
PASS = 10_000_000  # arcs that are brought in order at a time, about; at most 8 times


def arc_table(edges: DataFrame) -> DataFrame:
    """Per arc: src, k (its number among src's arcs, by dst), lo and hi (its share of [0, 1], hi the running transition
    probability), dst, d (dst's degree), and back, back_lo, back_hi: number and share of the arc from dst to src."""
    share = row_normalize(edges)
    rows = running(share, "src", ["dst"], {"k": F.lit(1).cast("long"), "sum": F.col("weight")}, before_too=True)
    degree = share.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("d"))
    rows = rows.join(degree.withColumnsRenamed({"dst": "src", "d": "own"}), "src")
    hi = F.when(F.col("k") == F.col("own"), 1.0).otherwise(F.col("sum"))
    lo = F.when(F.col("k") == 1, -1.0).otherwise(F.col("sum_before"))
    rows = cut_lineage(rows.select("src", "dst", (F.col("k") - 1).alias("k"), hi.alias("hi"), lo.alias("lo")))
    back = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("k").alias("back"), F.col("lo").alias("back_lo"), F.col("hi").alias("back_hi"))
    out = rows.join(degree, "dst", "left").join(back, ["src", "dst"], "left")
    return cut_lineage(out.withColumn("d", F.coalesce("d", F.lit(0))))


def varied_weights(edges: DataFrame) -> bool:
    """Whether weights differ, in which case walks follow them."""
    if "weight" not in edges.columns:
        return False
    row = edges.agg(F.min("weight").alias("a"), F.max("weight").alias("b")).first()
    return row["a"] != row["b"]


def _in_runs(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """To (src, dsts) from rows (src, dst) in order: what follows each other with one src, `most` at most, is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src = batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, int)
            cuts = [np.arange(a, b, most) for a, b in zip(first, np.r_[first[1:], len(src)])]
            cuts = np.concatenate([*cuts, [len(src)]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(src[cuts[:-1]]), pa.ListArray.from_arrays(pa.array(cuts), batch.column(1))], names=["src", "dsts"])

    return run


def neighbour_lists(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, slot, off, dsts), (node, d)): arcs(src, dst), once each, as lists. dsts are the neighbours number off, off + 1, ... of
    src in ascending order; slot is off div LIST, and no list reaches into the next slot. d: how many there are.

    Arcs lie in ranges of (src, dst), so a hub's are spread over many tasks and rows. They are brought in order a part of the nodes at a
    time, for what is exchanged at once to stay small beside the arcs.
    """
    n = max(1, min(8, arcs.count() // PASS))
    parts = []
    for k in range(n):
        part = arcs.select("src", "dst") if n == 1 else arcs.select("src", "dst").where(F.pmod(F.xxhash64("src"), F.lit(n)) == k)
        parts.append(cut_lineage(part.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").mapInArrow(_in_runs(LIST), "src long, dsts array<long>"), "lists"))
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.union(p)
    before = Window.partitionBy("src").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    heads = runs.select("src", F.col("dsts")[0].alias("first"), F.size("dsts").cast("long").alias("n"))
    heads = cut_lineage(heads.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "heads")
    degree = cut_lineage(heads.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("d")))
    whole = heads.where(F.col("off") > 0).select("src").distinct()  # the others are whole in one row
    several = runs.join(whole, "src").join(heads.withColumnRenamed("src", "of"), (F.col("of") == F.col("src")) & (F.col("dsts")[0] == F.col("first")))
    slots = several.withColumn("slot", F.explode(F.sequence(F.floor(F.col("off") / LIST), F.floor((F.col("off") + F.col("n") - 1) / LIST))))
    low, high = F.greatest("off", F.col("slot") * LIST), F.least(F.col("off") + F.col("n"), (F.col("slot") + 1) * LIST)
    slots = slots.select("src", "slot", low.alias("off"), F.slice("dsts", (low - F.col("off") + 1).cast("int"), (high - low).cast("int")).alias("dsts"))
    one = runs.join(whole, "src", "left_anti").select("src", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("off"), "dsts")
    lists = cut_lineage(one.union(slots), "lists")
    forgotten(heads, *parts)
    return lists, degree


class _EvenStepper:
    """Draws one arc for each row with node, d, before and a uniform u, all arcs of a node alike."""

    def __init__(self, arcs: DataFrame, mutual: bool):
        """mutual: what a walk came along also leads back, wherever that matters."""
        self.lists, self.degree = neighbour_lists(arcs)
        self.mutual, self.hubs = mutual, not self.degree.where(F.col("d") > LIST).isEmpty()

    def _at(self, rows: DataFrame, pick: str) -> DataFrame:
        """rows, with next: neighbour number `pick` of node."""
        a, b = rows.withColumn("_slot", F.floor(F.col(pick) / LIST)).alias("at"), self.lists.alias("of")
        met = a.join(b, (F.col("at.node") == F.col("of.src")) & (F.col("at._slot") == F.col("of.slot")))
        place = F.col(f"at.{pick}") - F.col("of.off")
        return met.where((place >= 0) & (place < F.size("of.dsts"))).select(*[F.col(f"at.{c}") for c in rows.columns], F.get("of.dsts", place.cast("int")).alias("next"))

    def near(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """pairs of which b is a neighbour of a. Of a node with several lists, the pairs meet single arcs."""
        lists = self.lists.select(F.col("src").alias("_of"), "dsts")
        found = lambda some: pairs.join(some, F.col(a) == F.col("_of")).where(F.array_contains("dsts", F.col(b))).select(*pairs.columns)
        if not self.hubs:
            return found(lists)
        long_ = self.degree.where(F.col("d") > LIST).select(F.col("node").alias("_of"))
        arcs = lists.join(long_, "_of", "left_semi").select("_of", F.explode("dsts").alias("_to"))
        return found(lists.join(long_, "_of", "left_anti")).union(pairs.join(arcs, (F.col(a) == F.col("_of")) & (F.col(b) == F.col("_to"))).select(*pairs.columns))

    def draw(self, now: DataFrame, u: Column, keep: list[str], backtrack: bool = True) -> DataFrame:
        """keep, next and its d. Walks with nowhere to go are dropped. The arc back is left out by taking neighbour f, or the one
        after it if f isn't before that arc, for f drawn from one neighbour less: where the arc back is need not be known."""
        if backtrack:
            now = now.where("d > 0").withColumn("_pick", F.least(F.floor(u * F.col("d")), F.col("d") - 1))
            return self._arrived(self._at(now.select(*dict.fromkeys([*keep, "node"]), "_pick"), "_pick"), keep)
        if self.mutual:
            now = now.withColumn("_turn", F.lit(1))
        else:
            ends = now.select(F.col("node").alias("_n"), F.col("before").alias("_b")).distinct()
            back = self.near(ends, "_n", "_b").withColumn("_t", F.lit(1))
            now = now.join(back, (F.col("node") == F.col("_n")) & (F.col("before") == F.col("_b")), "left").withColumn("_turn", F.coalesce("_t", F.lit(0))).drop("_n", "_b", "_t")
        choices = F.col("d") - F.col("_turn")
        now = now.where(choices > 0).withColumn("_f", F.least(F.floor(u * choices), choices - 1))
        rows = dict.fromkeys([*keep, "node", "before"])
        now = now.select(*rows, F.explode(F.when(F.col("_turn") > 0, F.array(F.col("_f"), F.col("_f") + 1)).otherwise(F.array("_f"))).alias("_pick"))
        two = self._at(now, "_pick").groupBy(*rows).agg(F.min("next").alias("_a"), F.max("next").alias("_b"))
        return self._arrived(two.withColumn("next", F.when(F.col("_a") < F.col("before"), F.col("_a")).otherwise(F.col("_b"))), keep)

    def _arrived(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        got = rows.select(*keep, "next").join(self.degree.select(F.col("node").alias("next"), "d"), "next", "left")
        return got.select(*keep, "next", F.coalesce("d", F.lit(0).cast("long")).alias("d"))

    def every(self, rows: DataFrame) -> DataFrame:
        """rows with each neighbour of node: k, next, d."""
        met = rows.drop("d").join(self.lists.select(F.col("src").alias("node"), "off", "dsts"), "node").select(*rows.drop("d").columns, "off", F.posexplode("dsts").alias("_p", "next"))
        met = met.join(self.degree.select(F.col("node").alias("_n"), "d"), F.col("next") == F.col("_n"), "left")
        return met.select(*rows.drop("d").columns, (F.col("off") + F.col("_p")).alias("k"), "next", F.coalesce("d", F.lit(0).cast("long")).alias("d"))


class _Stepper:
    """Draws one arc for each row with node, d, back, back_lo, back_hi and a uniform u."""

    def __init__(self, edges: DataFrame, weighted: bool):
        self.arcs, self.weighted = arc_table(edges), weighted
        self.degree = self.arcs.groupBy(F.col("src").alias("node")).agg((F.max("k") + 1).alias("d"))
        if weighted:  # a guide table: slot s of a node lists the arcs whose share meets [s / d, (s + 1) / d]; two per arc on average
            own = self.arcs.join(self.degree.select(F.col("node").alias("src"), F.col("d").alias("own")), "src")
            last = F.least(F.floor(F.col("hi") * F.col("own")), F.col("own") - 1)
            slots = F.sequence(F.least(F.floor(F.greatest("lo", F.lit(0.0)) * F.col("own")), F.col("own") - 1), last)
            self.guide = cut_lineage(own.withColumn("slot", F.explode(slots)).drop("own"))

    def draw(self, now: DataFrame, u: Column, keep: list[str], backtrack: bool = True) -> DataFrame:
        """keep, and of the drawn arc: next, d, back, back_lo, back_hi. Walks with nowhere to go are dropped."""
        turns = F.lit(0) if backtrack else F.col("at.back").isNotNull().cast("int")  # choices that would turn back
        at = now.alias("at").where(F.col("at.d") - turns > 0)
        if self.weighted:
            mass = F.when(turns > 0, F.col("at.back_hi") - F.greatest("at.back_lo", F.lit(0.0))).otherwise(0.0)
            t = u * (1 - mass) if backtrack else u * (1 - mass) + 2.0**-33
            t = F.least(t + F.when((turns > 0) & ((t > F.col("at.back_lo")) | (F.col("at.back") == 0)), mass).otherwise(0.0), F.lit(1.0))
            at = at.select(*[F.col(f"at.{c}").alias(c) for c in keep], F.col("at.node").alias("here"), t.alias("t"), F.least(F.floor(t * F.col("at.d")), F.col("at.d") - 1).alias("s"))
            a, b = at.alias("at"), self.guide.alias("arc")
            met = a.join(b, (F.col("at.here") == F.col("arc.src")) & (F.col("at.s") == F.col("arc.slot")) & (F.col("arc.lo") < F.col("at.t")) & (F.col("at.t") <= F.col("arc.hi")))
        else:
            pick = F.least(F.floor(u * (F.col("at.d") - turns)), F.col("at.d") - turns - 1)
            pick = pick + F.when((turns > 0) & (pick >= F.col("at.back")), 1).otherwise(0)
            at = at.select(*[F.col(f"at.{c}").alias(c) for c in keep], F.col("at.node").alias("here"), pick.alias("pick"))
            met = at.alias("at").join(self.arcs.alias("arc"), (F.col("at.here") == F.col("arc.src")) & (F.col("at.pick") == F.col("arc.k")))
        return met.select(*[F.col(f"at.{c}").alias(c) for c in keep], F.col("arc.dst").alias("next"), *[F.col(f"arc.{c}").alias(c) for c in ("d", "back", "back_lo", "back_hi")])

    def near(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """pairs of which b is a neighbour of a."""
        return pairs.join(self.arcs.select(F.col("src").alias(a), F.col("dst").alias(b)), [a, b], "left_semi")

    def every(self, rows: DataFrame) -> DataFrame:
        """rows with each arc of node."""
        return rows.join(self.arcs.withColumnsRenamed({"src": "node", "dst": "next"}), "node")


def random_walks(edges: DataFrame, starts: DataFrame | None, num_walks: int, walk_length: int, weighted: bool | None = None, backtrack: bool = True, p: float = 1.0, q: float = 1.0, cut_every: int = 10, first_pass: int = 0) -> DataFrame:
    """(walk_id, start, step, node_id): num_walks walks from every start (None: from every node that has an arc), each of
    walk_length nodes, start included.

    weighted: steps follow the weights; None does so where weights differ. The first step is never biased. Unweighted
    steps take arc floor(u * degree), weighted ones the first whose running probability reaches u; without backtracking
    the arc back is left out of the draw, and a walk ends where there is no other. With p, q (second order) a neighbour
    weighs its transition probability times 1/p if it is the previous node, 1 if it is a neighbour of it, else 1/q:
    ATTEMPTS candidates are drawn and accepted by that factor; walks that accept none weigh all neighbours.

    A weighted step joins each walk with one arc by (node, number), an unweighted one with a list of at most LIST neighbours
    (see `neighbour_lists`), so a hub's neighbours are never gathered.
    """
    edges = cut_lineage(edges.sortWithinPartitions("src", "dst"), "graph")
    weighted = varied_weights(edges) if weighted is None else weighted
    if weighted:
        stepper, nothing = _Stepper(edges, True), [F.lit(None).cast(t).alias(c) for c, t in (("back", "int"), ("back_lo", "double"), ("back_hi", "double"))]
    else:
        stepper, nothing = _EvenStepper(edges, backtrack or is_symmetric(edges.select("src", "dst", F.lit(1.0).alias("weight")))), []
    forgotten(edges)
    starts = stepper.degree.select(F.col("node").alias("node_id")) if starts is None else starts
    passes = starts.sparkSession.range(first_pass, first_pass + num_walks).withColumnRenamed("id", "pass")
    walks = starts.select(F.col("node_id").alias("start")).crossJoin(F.broadcast(passes))
    now = walks.join(stepper.degree.withColumnRenamed("node", "start"), "start", "left")
    now = now.select("pass", "start", F.lit(None).cast("long").alias("before"), F.col("start").alias("node"), F.coalesce("d", F.lit(0)).alias("d"), *nothing)
    out = now.select("pass", "start", F.lit(0).alias("step"), F.col("node").alias("node_id"))
    factor = F.when(F.col("next") == F.col("before"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
    arc, key = ["next", "d", *(["back", "back_lo", "back_hi"] if weighted else [])], ["pass", "start"]
    for step in range(1, walk_length):
        u = lambda *more: uniform("walk", F.col("pass"), F.col("start"), F.lit(step), *more)
        if (p == 1.0 and q == 1.0) or step == 1:
            moved = stepper.draw(now, u(), [*key, "node"], backtrack or step == 1)
        else:
            tries = now.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))))
            drawn = cut_lineage(stepper.draw(tries, u(F.col("try")), [*key, "node", "before", "try"], backtrack), "drawn")
            fine = _with_near(stepper, drawn).where(u(F.col("try"), F.lit("accept")) * max(1 / p, 1.0, 1 / q) < factor)
            got = cut_lineage(fine.groupBy(*key).agg(F.min_by(F.struct("node", *arc), "try").alias("a")).select(*key, "a.*"))
            forgotten(drawn)
            left = now.join(got.select(*key), key, "left_anti").select(*key, "before", "node")
            every = _with_near(stepper, stepper.every(left))
            if not backtrack:
                every = every.where("next <> before")
            share = F.col("hi") - F.greatest("lo", F.lit(0.0)) if weighted else F.lit(1.0)
            order = Window.partitionBy(*key).orderBy("k")
            every = every.withColumn("w", share * factor).withColumn("run", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(Window.partitionBy(*key)))
            some = every.where((F.col("run") >= u(F.lit("all")) * F.col("all")) | F.col("run").eqNullSafe(F.col("all")))
            moved = got.union(some.groupBy(*key).agg(F.min_by(F.struct("node", *arc), "k").alias("a")).select(*key, "a.*"))
        now = moved.select(*key, F.col("node").alias("before"), F.col("next").alias("node"), *arc[1:])
        if p != 1.0 or q != 1.0 or step % cut_every == 0:  # a second-order draw is dear enough to be made once
            now = cut_lineage(now)
        out = out.union(now.select("pass", "start", F.lit(step).alias("step"), F.col("node").alias("node_id")))
    return out.select(F.concat_ws("|", F.col("pass").cast("string"), F.col("start").cast("string")).alias("walk_id"), "start", "step", "node_id")


def _with_near(stepper: _Stepper | _EvenStepper, rows: DataFrame) -> DataFrame:
    """rows, with near: whether next is a neighbour of before, or null."""
    ends = rows.select("before", "next").distinct()
    return rows.join(stepper.near(ends, "before", "next").withColumn("near", F.lit(True)), ["before", "next"], "left")


def nonbacktracking_walks(edges: DataFrame, starts: DataFrame, num_walks: int, walk_length: int, weighted: bool | None = None) -> DataFrame:
    """Passes of walks that never turn back, until they have more than num_walks * walk_length steps for each start in
    all: walks that end early are made up for. At least num_walks passes, at most walk_length times as many."""
    wanted, passes = num_walks * walk_length * starts.count(), num_walks
    out = cut_lineage(random_walks(edges, starts, passes, walk_length, weighted, backtrack=False))
    have = out.count()
    while have <= wanted and passes < num_walks * walk_length:
        more = cut_lineage(random_walks(edges, starts, 1, walk_length, weighted, backtrack=False, first_pass=passes))
        out, have, passes = out.union(more), have + more.count(), passes + 1
    return out


def context_pairs(walks: DataFrame, window: int, walk: str = "walk_id", order: str = "step", node: str = "node_id") -> DataFrame:
    """(center, context, n) within `window` places of each other; a window frame collects the places that follow."""
    ahead = Window.partitionBy(walk).orderBy(order).rowsBetween(1, window)
    pairs = walks.select(F.col(node).alias("a"), F.collect_list(node).over(ahead).alias("next")).select("a", F.explode("next").alias("b"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("center"), F.col("b").alias("context")).agg(F.count(F.lit(1)).alias("n"))
