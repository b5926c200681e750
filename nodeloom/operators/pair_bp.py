"""Belief propagation on cells: what both ends of a pair send each other lies side by side, so that no message is looked up.

A sweep brings the logs of nodes to the slices of cells, block by block, and writes each message once; the same tasks give
the nodes' new sums, the largest change, and what the free energy and the learning step sum over links. Slices go in
parts, and a part's old messages are deleted when the new ones are there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.scalars import uniform
from nodeloom.operators import cells
from nodeloom.operators.structure import cut_lineage, forgotten

ROW = 65_536  # pairs in a row of messages, at most


def _first(q: int, seed: str) -> Column:
    """The hash uniforms of the messages src -> dst and dst -> src, all but the last group of each."""
    out = []
    for a, b in (("src", "dst"), ("dst", "src")):
        raw = [uniform(seed, F.col(a), F.col(b), F.lit(t)) + 1e-3 for t in range(q)]
        out += [x / sum(raw[1:], raw[0]) for x in raw[:-1]]
    return F.array(*out)


class Messages:
    """Of an undirected graph (edges: both directions) the messages, in `parts` (a, b, s, i, j, x), and what nodes have heard."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, q: int, dc: int, seed: str):
        self.graph = cells.cell_graph(edges.select("src", "dst", _first(q, seed).alias("x")).where("src < dst"), nodes, once=True, carried="x")
        self.q, self.dc, self.n = q, dc, self.graph.size
        self.many = len(self.graph.parts)
        self.parts, self.tables, self.heard = list(self.graph.parts), list(self.graph.tables), None
        ones = lambda blk, at: (blk, np.ones(len(at) // 8).tobytes())
        self.factors = cut_lineage(cells.each_block(self.graph.blocks, ones, ["blk", "at"], "blk long, d binary"))
        if dc:
            counts = self._visit(np.ones((q, q)), None, 0.0, True)[1]
            width = self.graph.width
            degree = lambda blk, at, sums: (blk, (np.zeros(len(at) // 8) if sums is None else np.frombuffer(sums).reshape(-1, width)[0][np.frombuffer(at, np.int64)]).tobytes())
            found = cut_lineage(cells.each_block(self.graph.blocks.join(counts, "blk", "left"), degree, ["blk", "at", "sums"], "blk long, d binary"))
            top = max(r["t"] for r in cells.each_block(found, lambda blk, d: (float(np.frombuffer(d).max(initial=0.0)),), ["blk", "d"], "t double").collect()) or 1.0
            self.factors = cut_lineage(cells.each_block(found, lambda blk, d: (blk, (np.frombuffer(d) / (top if dc == 1 else 1.0)).tobytes()), ["blk", "d"], "blk long, d binary"))

    def _visit(self, cab: np.ndarray, vectors: DataFrame | None, damping: float, count: bool = False) -> tuple[np.ndarray, DataFrame]:
        """(totals: largest change, sum over links, expected links of each two groups; (blk, sums): of each place the sums of what is
        heard and its number). vectors(blk, v): logs of the marginals and degree factors by place; with damping messages are
        renewed from them. count: of numbers only."""
        q, n, dc, width, c = self.q, self.n, self.dc, self.graph.width, np.asarray(cab, float)
        k, renew = q + 1, damping > 0

        def work(key: tuple, rows: pa.Table, sent: pa.Table) -> pa.Table:
            if not rows.num_rows:  # a slice that no list was dealt to
                return schema.empty_table()
            i, j = (np.concatenate([x.flatten().to_numpy() for x in rows.column(end).chunks]) for end in ("i", "j"))
            out = {"a": [], "b": [], "s": [], "i": [], "j": [], "x": [], "blk": [], "sums": [], "totals": []}

            def add(**values: object) -> None:
                for name, column in out.items():
                    column.append(values.get(name))

            if count:
                for blk, at in ((key[0], i), (key[1], j)):
                    add(blk=blk.as_py(), sums=np.bincount(at, minlength=width).astype(float).tobytes(), totals=np.zeros(2 + q * q).tobytes())
                return pa.table(out, schema=schema)
            x = np.concatenate([x.flatten().to_numpy() for x in rows.column("x").chunks]).reshape(-1, 2 * (q - 1)).T
            full = lambda y: np.concatenate([y, 1 - y.sum(0, keepdims=True)])
            forth, back = full(x[: q - 1]), full(x[q - 1 :])
            v = {s: np.frombuffer(b).reshape(k, width) for s, b in zip(sent.column("side").to_pylist(), sent.column("v").to_pylist())}
            both = v[0][q][i] * v[1][q][j] if dc else None
            pull = {}
            for s in range(q):
                for t in range(q):
                    y = c[s, t] if dc == 0 else both * c[s, t]
                    pull[s, t] = (y / n) / (1 + y / n) if dc == 2 else y
            said = lambda psi: np.array([np.log(np.maximum(sum(pull[t, s] * psi[t] for t in range(q)), 1e-50)) for s in range(q)])
            to_j, to_i, change = said(forth), said(back), 0.0
            if renew:
                new = []
                for logs, got, old in ((v[0][:q, i], to_i, forth), (v[1][:q, j], to_j, back)):
                    e = logs - got
                    e = np.exp(e - e.max(0))
                    new.append(damping * (e / e.sum(0)) + (1 - damping) * old)
                change = max(np.abs(new[0] - forth).max(), np.abs(new[1] - back).max())
                forth, back = new
                to_j, to_i = said(forth), said(back)
                x = np.ascontiguousarray(np.concatenate([forth[:-1], back[:-1]]).T)
                for low in range(0, len(i), ROW):
                    add(a=key[0].as_py(), b=key[1].as_py(), s=key[2].as_py(), i=i[low : low + ROW], j=j[low : low + ROW], x=x[low : low + ROW].ravel())
            totals = np.zeros(2 + q * q)
            totals[0] = change
            for one, two in ((forth, back), (back, forth)):
                z = np.maximum(sum(pull[s, t] * one[s] * two[t] for s in range(q) for t in range(q)), 1e-50)
                totals[1] += np.log(z).sum()
                totals[2:] += [(pull[s, t] * one[s] * two[t] / z).sum() for s in range(q) for t in range(q)]
            for blk, at, got, sums in ((key[0], i, to_i, totals), (key[1], j, to_j, np.zeros_like(totals))):
                add(blk=blk.as_py(), sums=np.concatenate([*[np.bincount(at, y, width) for y in got], np.bincount(at, minlength=width)]).tobytes(), totals=sums.tobytes())
            return pa.table(out, schema=schema)

        schema = pa.schema([*[(c, pa.int64()) for c in "abs"], ("i", pa.list_(pa.int32())), ("j", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("blk", pa.int64()), ("sums", pa.binary()), ("totals", pa.binary())])
        kind = "a long, b long, s long, i array<int>, j array<int>, x array<double>, blk long, sums binary, totals binary"
        blank = self.graph.blocks.select("blk", F.lit(b"").alias("v")) if vectors is None else vectors
        side = lambda c, k: self.graph.slices.join(blank.select(F.col("blk").alias(c), "v"), c).select("a", "b", "s", F.lit(k).alias("side"), "v")
        sent = side("a", 0).union(side("b", 1))
        tables, totals = [], []
        for p, old in enumerate(self.parts):
            here = sent.where(F.pmod("s", F.lit(self.many)) == p).groupBy("a", "b", "s")
            made = cut_lineage(old.groupBy("a", "b", "s").cogroup(here).applyInArrow(work, kind), "messages")
            tables.append(made)
            if renew:
                forgotten(self.tables[p])
                self.tables[p], self.parts[p] = made, made.where("blk IS NULL").select("a", "b", "s", "i", "j", "x")
        found = None
        for t in tables:
            x = t.where("blk IS NOT NULL").select("blk", "sums")
            found = x if found is None else found.union(x)
            totals += [np.frombuffer(r["totals"]) for r in t.where("totals IS NOT NULL").select("totals").collect()]
        one = np.array(totals).reshape(-1, 2 + q * q)
        sums = cut_lineage(cells.added(found, (1 if count else k) * width))
        forgotten(*([] if renew else tables))
        return np.concatenate([[one[:, 0].max(initial=0.0)], one[:, 1:].sum(0)]), sums

    def visit(self, cab: np.ndarray, logs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, damping: float = 0.0) -> np.ndarray:
        """The totals of a pass; logs(sums, d): of the marginals of a block's nodes. Afterwards heard(blk, at, s, d) has each block's sums, q rows,
        their number, and the degree factors."""
        width, q, old = self.graph.width, self.q, self.heard

        def send(blk: int, at: bytes, s: bytes | None, d: bytes) -> tuple:
            d = np.frombuffer(d)
            x = np.zeros((q, len(d))) if logs is None else logs(np.frombuffer(s).reshape(q + 1, -1)[:q], d)
            out = np.zeros((q + 1, width))
            out[:, np.frombuffer(at, np.int64)] = np.concatenate([x, d[None]])
            return blk, out.tobytes()

        base = self.graph.blocks.join(self.factors, "blk")
        source = base.select("blk", "at", F.lit(None).cast("binary").alias("s"), "d") if logs is None else old
        totals, sums = self._visit(cab, cut_lineage(cells.each_block(source, send, ["blk", "at", "s", "d"], "blk long, v binary")), damping)

        def take(blk: int, at: bytes, sums: bytes | None, d: bytes) -> tuple:
            got = np.zeros((q + 1, len(at) // 8)) if sums is None else np.frombuffer(sums).reshape(q + 1, width)[:, np.frombuffer(at, np.int64)]
            return blk, at, np.ascontiguousarray(got).tobytes(), d

        self.heard = cut_lineage(cells.each_block(base.join(sums, "blk", "left"), take, ["blk", "at", "sums", "d"], "blk long, at binary, s binary, d binary"), "heard")
        forgotten(old, sums)
        return totals

    def over_nodes(self, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over blocks of work(sums, number, d)."""
        q = self.q

        def run(s: bytes, d: bytes) -> tuple:
            s = np.frombuffer(s).reshape(q + 1, -1)
            return (np.asarray(work(s[:q], s[q], np.frombuffer(d)), float).tobytes(),)

        return sum(np.frombuffer(r["v"]) for r in cells.each_block(self.heard, run, ["s", "d"], "v binary").collect())


def learned(edges: DataFrame, nodes: DataFrame, q: int, eta: list[float], cab: np.ndarray, newton: Callable, em_steps: int, sweeps: int, damping: float, crit: float, learn_crit: float, learning_rate: float, dc: int, learn_eta: bool, seed: str) -> tuple[DataFrame, float, list[float]]:
    """((node_id, psi), free energy, group sizes): as blockmodel.bp_learn, from random messages and all at once; psi is null where nothing is heard."""
    m = Messages(edges, nodes, q, dc, seed)
    n, eta, cab = m.n, list(eta), np.asarray(cab, float)
    field = [float(sum(cab[t][s] * eta[t] for t in range(q)) * n) for s in range(q)]

    def logs_with(h: list[float], eta: list[float]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        prior, at = np.log(np.maximum(eta, 1e-50)), np.array(h, float)
        return lambda s, d: s + prior[:, None] - d * (at[:, None] / n)

    def normal(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(0))
        return e / e.sum(0)

    def settled(field: list[float]) -> list[float]:
        asked = newton(eta, cab, n, field)
        h = next(asked)
        while True:
            logs = logs_with(h, eta)

            def moments(s: np.ndarray, number: np.ndarray, d: np.ndarray) -> np.ndarray:
                p = normal(logs(s, d))
                return np.concatenate([(d * p).sum(1), (d * d * p).sum(1), ((d * d * p) @ p.T).ravel()])

            x = m.over_nodes(moments)
            try:
                h = asked.send((x[:q], x[q : 2 * q], x[2 * q :].reshape(q, q)))
            except StopIteration as end:
                return end.value

    energy = None
    for step in range(em_steps):
        totals = m.visit(cab)
        field = settled(field)
        for _ in range(sweeps):
            totals = m.visit(cab, logs_with(field, eta), damping)
            field = settled(field)
            if totals[0] < crit:
                break
        logs = logs_with(field, eta)

        def shares(s: np.ndarray, number: np.ndarray, d: np.ndarray) -> np.ndarray:
            x, some = logs(s, d), number > 0
            p, top = normal(x) * some, x.max(0)
            return np.concatenate([[((top + np.log(np.exp(x - top).sum(0))) * some).sum()], p.sum(1), (d * p).sum(1)])

        x = m.over_nodes(shares)
        plain, size = x[1 : q + 1], x[q + 1 :]
        before, energy = energy, float(-(x[0] / n - totals[1] / (2 * n) + size @ cab @ size / (2.0 * n * n)))
        moved = math.inf if before is None else abs(energy - before)
        if not math.isfinite(energy) or moved < learn_crit or step == em_steps - 1:
            break
        crit = crit * 0.1 if moved < crit else crit
        links, size, plain = totals[2:].reshape(q, q), np.maximum(size, 1e-9), np.maximum(plain, 1e-9)
        new = n * (links + links.T) / 2 / np.outer(size, size)
        eta = [learning_rate * a / n + (1 - learning_rate) * b for a, b in zip(plain, eta)] if learn_eta else eta
        cab = learning_rate * new + (1 - learning_rate) * cab
    logs = logs_with(field, eta)

    def marginal(blk: int, s: bytes, d: bytes) -> tuple:
        s = np.frombuffer(s).reshape(q + 1, -1)
        return blk, np.where(s[q] > 0, normal(logs(s[:q], np.frombuffer(d))), np.nan).tobytes()

    psi = cells.unpacked(m.graph, cells.each_block(m.heard, marginal, ["blk", "s", "d"], "blk long, v binary"), q)
    got = cut_lineage(psi.select("node_id", F.when(~F.isnan(F.col("x")[0]), F.col("x")).alias("psi")), "marginals")
    forgotten(*m.tables, m.heard)
    return got, energy, eta
