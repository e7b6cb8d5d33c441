"""Sparse symmetric positive definite systems too large for a driver: conjugate gradients over coordinate tables.

Nodes are dealt over chunks by a hash of their own, and each pair of chunks has a block: the entries between
them, each pair of nodes once, packed as arrays. Blocks are dealt once and never move again. A step brings
each chunk of the search directions to its blocks and sums what they return by chunk: with c chunks, which
grow with the square root of the entries, every vector is sent c times, as packed arrays, whatever the
number of entries. Step lengths come to the driver, nothing else does. Crossed random effects (a value per
customer and a value per part, seen in lines of both) have such a curvature.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.plans.linalg import NotPositiveDefinite
from lakewright.session import Tables, partitions

#: Right-hand sides that go through the matrix together.
TOGETHER = 8
#: Entries of a block and nodes of a chunk, about; a task holds a block and two chunks of each right-hand side.
BLOCK = CHUNK = 1 << 20
#: Hashes that are tried until no two nodes share one.
SALTS = 8


@dataclass
class Steps:
    """``solution`` (node and a column per right-hand side), and step lengths and ratios, one row per step."""

    solution: DataFrame
    lengths: np.ndarray
    ratios: np.ndarray
    residual: np.ndarray


def doubles(scalar: pa.Scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), float)


def packed(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    """A table of rows whose arrays are bytes."""
    return pa.table({f.name: pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in columns[f.name]], f.type) for f in schema})


_KEYS = pa.schema([("chunk", pa.int32()), ("keys", pa.binary())])
_BLOCK = pa.schema([("block", pa.int32()), ("at", pa.binary()), ("to", pa.binary()), ("values", pa.binary())])
_PART = pa.schema([("chunk", pa.int32()), ("c", pa.int32()), ("q", pa.binary())])
_STATE = pa.schema([("chunk", pa.int32()), ("c", pa.int32()), *[(x, pa.binary()) for x in "dxrp"]])
_STEP = pa.schema([*_STATE, ("q", pa.binary()), *[(x, pa.float64()) for x in ("pq", "rr", "rq", "qq")]])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def pack_keys(key: tuple, rows: pa.Table) -> pa.Table:
    return packed({"chunk": [key[0].as_py()], "keys": [np.sort(rows["key"].to_numpy())]}, _KEYS)


def block_packer(chunks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Places of a block's entries in its two chunks; entries of nodes that aren't there are left out."""

    def pack(entries: pa.Table, lists: pa.Table) -> pa.Table:
        if not entries.num_rows:
            return _BLOCK.empty_table()
        block = entries["block"][0].as_py()
        lo, hi = divmod(block, chunks)
        keys = {c.as_py(): np.frombuffer(k.as_buffer(), np.int64) for c, k in zip(lists["chunk"], lists["keys"], strict=True)}
        places, there = [], np.ones(entries.num_rows, bool)
        for name, c in (("a", lo), ("b", hi)):
            own, sought = keys.get(c, np.zeros(0, np.int64)), entries[name].to_numpy()
            at = np.searchsorted(own, sought)
            there &= (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == sought) if len(own) else False
            places.append(at)
        order = np.lexsort((places[1], places[0]))
        order = order[there[order]]
        at, to = (x[order].astype(np.int32) for x in places)
        return packed({"block": [block], "at": [at], "to": [to], "values": [entries["value"].to_numpy()[order]]}, _BLOCK)

    return pack


def block_times(chunks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a block adds to the products of its two chunks."""

    def times(block: pa.Table, vectors: pa.Table) -> pa.Table:
        out: dict[str, list] = {"chunk": [], "c": [], "q": []}
        if block.num_rows:
            lo, hi = divmod(block["block"][0].as_py(), chunks)
            at, to = (np.frombuffer(block[x][0].as_buffer(), np.int32).astype(np.intp) for x in ("at", "to"))
            values = doubles(block["values"][0])
            given = {(k.as_py(), c.as_py()): doubles(p) for k, c, p in zip(vectors["chunk"], vectors["c"], vectors["p"], strict=True)}
            for c in sorted({c for _, c in given}):
                x, y = given[lo, c], given[hi, c]
                parts = {lo: np.bincount(at, values * y[to], len(x))}
                other = np.bincount(to, values * x[at], len(y))
                parts[hi] = parts[hi] + other if hi == lo else other
                for k, q in parts.items():
                    out["chunk"].append(k), out["c"].append(c), out["q"].append(q)
        return packed(out, _PART)

    return times


def summed(state: pa.Table, parts: pa.Table) -> pa.Table:
    """A chunk of one right-hand side with its product and the sums that step lengths are made of."""
    if not state.num_rows:
        return _STEP.empty_table()
    row = {f.name: [state[f.name][0]] for f in _STATE}
    d, r, p = (doubles(row[x][0]) for x in "drp")
    q = d * p
    for part in parts["q"]:
        q += doubles(part)
    row = {f.name: [doubles(row[f.name][0]) if f.name in "dxrp" else row[f.name][0].as_py()] for f in _STATE}
    return packed(row | {"q": [q], "pq": [float(p @ q)], "rr": [float((r * r / d).sum())], "rq": [float((r * q / d).sum())], "qq": [float((q * q / d).sum())]}, _STEP)


def advance(alpha: np.ndarray, beta: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Solution, residual and search direction after a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = batch["c"][k].as_py()
                d, x, r, p, q = (doubles(batch[n][k]) for n in ("d", "x", "r", "p", "q"))
                left = r - alpha[c] * q
                yield from packed({"chunk": [batch["chunk"][k].as_py()], "c": [c], "d": [d], "x": [x + alpha[c] * p], "r": [left], "p": [left / d + beta[c] * p]}, _STATE).to_batches()

    return run


@dataclass
class System:
    """A symmetric matrix with one entry per (i, j), stored in full, and a positive diagonal.

    ``parts``: its diagonal (node, d) and the entries beside it (i, j, value) with either (i, j) or (j, i) of each
    two nodes, where they are at hand; else they are picked from the matrix.
    """

    matrix: DataFrame
    parts: tuple[DataFrame, DataFrame] | None = None
    diagonal: DataFrame = field(init=False, repr=False)
    #: what else goes when the system is closed
    tables: Tables | None = None

    def __post_init__(self):
        spark = self.matrix.sparkSession
        self.matrix = self.matrix.select("i", "j", F.col("value").cast("double").alias("value")).repartition("j").persist()
        own, beside = self.parts or (self.matrix.filter("i = j").select(F.col("j").alias("node"), F.col("value").alias("d")), self.matrix)
        for salt in range(SALTS):
            key = lambda x, salt=salt: F.xxhash64(x, F.lit(salt))
            diagonal = own.withColumn("key", key("node")).persist()
            self.side, least, different = diagonal.agg(F.count("*"), F.min("d"), F.count_distinct("key")).first()
            if different == self.side:
                break
            diagonal.unpersist()
        else:
            raise ValueError("a node has two diagonal entries")
        self.diagonal = diagonal
        if self.side and not least > 0:
            raise NotPositiveDefinite("a diagonal entry is not positive")
        beside = beside.filter("value is not null").select(key("i").alias("a"), key("j").alias("b"), F.col("value").cast("double").alias("value"))
        beside = beside if self.parts else beside.filter("a < b")
        self.chunks = n = max(1, math.ceil(math.sqrt(2 * beside.count() / BLOCK)), math.ceil(self.side / CHUNK))
        chunk = lambda x: F.pmod(F.col(x), F.lit(n)).cast("int")
        self.keys = self.diagonal.select(chunk("key").alias("chunk"), "key").groupBy("chunk").applyInArrow(pack_keys, ddl(_KEYS)).persist()
        # the block of two chunks is the smaller one's number times their count and the larger one's
        back = chunk("a") > chunk("b")
        sides = beside.select(F.when(back, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("b"), "value")
        entries = sides.select((chunk("a") * n + chunk("b")).alias("block"), "a", "b", "value")
        many = max(partitions(spark), n * (n + 1) // 2)
        met = entries.repartition(many, "block").groupBy("block").cogroup(self._to_blocks(self.keys, "keys").groupBy("block"))
        self.blocks = met.applyInArrow(block_packer(n), ddl(_BLOCK)).repartition(many, "block").persist()

    def close(self) -> None:
        for x in (self.matrix, self.diagonal, self.keys, self.blocks):
            x.unpersist()
        if self.tables:
            self.tables.drop()

    def _to_blocks(self, chunks: DataFrame, *columns: str) -> DataFrame:
        """Rows of chunks, once for every block that has the chunk."""
        n, other = self.chunks, F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("other")
        met = chunks.select("chunk", *columns, other)
        return met.select("chunk", *columns, (F.least("chunk", "other") * n + F.greatest("chunk", "other")).cast("int").alias("block"))

    def times(self, vectors: DataFrame, names: list[str]) -> DataFrame:
        """(node, the matrix times each named column); ``vectors`` has a row per node."""
        met = self.matrix.join(vectors.select(F.col("node").alias("j"), *names), "j")
        return met.groupBy(F.col("i").alias("node")).agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names])

    def _start(self, right: DataFrame, names: list[str]) -> DataFrame:
        """Chunks of the right-hand sides, a row for each of them; nodes without one have zero."""
        at = range(len(names))

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            order = np.argsort(rows["key"].to_numpy())
            d = rows["d"].to_numpy()[order]
            b = [rows[f"b{c}"].to_numpy()[order] for c in at]
            return packed({"chunk": [key[0].as_py() for _ in at], "c": list(at), "d": [d for _ in at], "x": [np.zeros(len(d)) for _ in at], "r": b, "p": [x / d for x in b]}, _STATE)

        met = self.diagonal.join(right.select("node", *[F.col(n).cast("double").alias(f"b{c}") for c, n in enumerate(names)]), "node", "left")
        rows = met.select(F.pmod("key", F.lit(self.chunks)).cast("int").alias("chunk"), "key", "d", *[F.coalesce(f"b{c}", F.lit(0.0)).alias(f"b{c}") for c in at])
        return rows.groupBy("chunk").applyInArrow(pack, ddl(_STATE))

    def _nodes(self, state: DataFrame, names: list[str]) -> DataFrame:
        """(node and a column per right-hand side) of packed solutions."""
        schema = pa.schema([("key", pa.int64()), *[(f"x{c}", pa.float64()) for c in range(len(names))]])

        def unpack(keys: pa.Table, state: pa.Table) -> pa.Table:
            found = {c.as_py(): doubles(x) for c, x in zip(state["c"], state["x"], strict=True)}
            return pa.table([np.frombuffer(keys["keys"][0].as_buffer(), np.int64), *[found[c] for c in range(len(found))]], schema=schema)

        flat = self.keys.groupBy("chunk").cogroup(state.select("chunk", "c", "x").groupBy("chunk")).applyInArrow(unpack, ddl(schema))
        return self.diagonal.join(flat, "key").select("node", *[F.col(f"x{c}").alias(n) for c, n in enumerate(names)])

    def solve(self, right: DataFrame, names: list[str], *, steps: int, tol: float = 0.0) -> Steps:
        """Conjugate gradients with the diagonal as preconditioner, all right-hand sides at once, from zero.

        Stops after ``steps``, or when all residuals, in the preconditioner's norm, are at most ``tol`` times
        those of the right-hand sides. Nodes without a right-hand side have zero.
        """
        k = len(names)
        tables = Tables(self.matrix.sparkSession)
        state = tables.write(self._start(right, names))
        lengths, ratios, left, first = [], [], np.zeros(k), None
        for _ in range(steps):
            sent = self._to_blocks(state, "c", "p")
            parts = self.blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(block_times(self.chunks), ddl(_PART))
            now = tables.write(state.groupBy("chunk", "c").cogroup(parts.groupBy("chunk", "c")).applyInArrow(summed, ddl(_STEP)))
            tables.drop(1)
            pq, rr, rq, qq = np.zeros((4, k))
            for s in now.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("pq", "rr", "rq", "qq")]).collect():
                pq[s.c], rr[s.c], rq[s.c], qq[s.c] = s.pq, s.rr, s.rq, s.qq
            if (pq < 0).any():
                raise NotPositiveDefinite("a direction of negative curvature")
            first = rr if first is None else first
            going = (pq > 0) & (rr > (tol * tol) * first)
            alpha = np.where(going, rr / np.where(pq > 0, pq, 1.0), 0.0)
            left = np.where(going, np.maximum(rr - 2 * alpha * rq + alpha * alpha * qq, 0.0), rr)
            beta = np.where(going, left / np.where(rr > 0, rr, 1.0), 0.0)
            lengths.append(alpha)
            ratios.append(beta)
            state = now.mapInArrow(advance(alpha, beta), ddl(_STATE))
            if (left <= (tol * tol) * first).all():
                break
        relative = np.sqrt(left / np.where(first > 0, first, 1.0)) if first is not None else np.zeros(k)
        return Steps(self._nodes(state, names), np.array(lengths), np.array(ratios), relative)

    def _signs(self, probes: range) -> list[Column]:
        """Fixed random signs: they depend on node and probe alone."""
        return [F.when(F.xxhash64(F.struct("node"), F.lit(c)) % 2 == 0, 1.0).otherwise(-1.0).alias(f"z{c}") for c in probes]

    def log_determinant(self, *, probes: int = 24, steps: int = 30) -> tuple[float, float]:
        """(estimate, standard error): the diagonal's logarithms and, for what is left when the matrix is scaled to a
        unit diagonal, a Gauss quadrature for each random vector of signs. The rule comes from the lengths and
        ratios of the conjugate gradients' steps, which are the tridiagonal matrix of Lanczos's."""
        if not self.side:
            return 0.0, 0.0
        base = self.diagonal.agg(F.sum(F.ln("d"))).first()[0]
        found: list[float] = []
        for lo in range(0, probes, TOGETHER):
            some = range(lo, min(lo + TOGETHER, probes))
            names = [f"z{c}" for c in some]
            signs = self.diagonal.select("node", "d", *self._signs(some))
            run = self.solve(signs.select("node", *[(F.sqrt("d") * F.col(n)).alias(n) for n in names]), names, steps=steps, tol=1e-10)
            found += [self.side * quadrature(run.lengths[:, c], run.ratios[:, c], np.log) for c in range(len(names))]
        return base + float(np.mean(found)), float(np.std(found, ddof=1) / np.sqrt(len(found))) if len(found) > 1 else 0.0

    def trace_of_inverse(self, other: DataFrame, *, probes: int = 24, steps: int = 30) -> tuple[float, float]:
        """(estimate, standard error) of the trace of this matrix's inverse times ``other`` (i, j, value)."""
        found: list[float] = []
        for lo in range(0, probes, TOGETHER):
            some = range(lo, min(lo + TOGETHER, probes))
            names = [f"z{c}" for c in some]
            signs = self.diagonal.select("node", *self._signs(some))
            solved = self.solve(signs, names, steps=steps, tol=1e-10).solution.select("node", *[F.col(n).alias(f"x_{n}") for n in names])
            met = other.join(signs.select(F.col("node").alias("j"), *names), "j").groupBy(F.col("i").alias("node")).agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names])
            found += [x or 0.0 for x in met.join(solved, "node").agg(*[F.sum(F.col(n) * F.col(f"x_{n}")) for n in names]).first()]
        return float(np.mean(found)), float(np.std(found, ddof=1) / np.sqrt(len(found))) if len(found) > 1 else 0.0


def quadrature(lengths: np.ndarray, ratios: np.ndarray, f) -> float:
    """Sum of w f(x) of the Gauss rule that conjugate-gradient steps stand for; weights add up to one."""
    n = int(np.count_nonzero(lengths))
    if not n:
        return 0.0
    a, b = lengths[:n], ratios[:n]
    diagonal = 1 / a
    diagonal[1:] += b[: n - 1] / a[: n - 1]
    beside = np.sqrt(b[: n - 1]) / a[: n - 1]
    x, v = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    return float(v[0] ** 2 @ f(np.maximum(x, np.finfo(float).tiny)))


def crossed_system(rows: DataFrame, factors: dict[str, float], residual: str, sigma: float) -> tuple[System, DataFrame]:
    """(curvature, right-hand side) of a normal model with one random effect per level of each factor.

    ``factors``: columns and the standard deviations of their effects. A node is (factor, level). Rows with
    a null residual or level are left out. Entries are sums over rows: only pairs of levels that rows hold.
    """
    names, weight = list(factors), 1 / (sigma * sigma)
    kept = rows.select(*names, F.col(residual).cast("double").alias("__y")).dropna(subset=names).filter("__y is not null")
    levels = [f"__n{k}" for k in range(len(names))]
    tables = Tables(rows.sparkSession)
    # rows of the same levels are one cell: the lines are read and joined once
    cells = tables.write(kept.select("__y", *[F.col(n).cast("long").alias(x) for n, x in zip(names, levels, strict=True)]).groupBy(*levels).agg(F.count("*").alias("n"), F.sum("__y").alias("y")))
    node = [F.struct(F.lit(k).alias("factor"), F.col(x).alias("level")) for k, x in enumerate(levels)]
    each = [cells.groupBy(x).agg(F.sum("n").alias("n"), F.sum("y").alias("y")).select(node[k].alias("node"), (F.col("n") * weight + 1 / (s * s)).alias("d"), (F.col("y") * weight).alias("b")) for k, (x, s) in enumerate(zip(levels, factors.values(), strict=True))]
    one = tables.write(reduce(DataFrame.unionByName, each))
    diagonal, right = one.select("node", "d"), one.select("node", "b")
    # each two levels that rows hold have an entry, the number of these rows by their weight
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
    counts = [(cells if len(names) == 2 else cells.groupBy(levels[a], levels[b]).agg(F.sum("n").alias("n"))).select(node[a].alias("i"), node[b].alias("j"), (F.col("n") * weight).alias("value")) for a, b in pairs]
    own = diagonal.select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("d").alias("value"))
    beside = reduce(DataFrame.unionByName, counts) if counts else own.filter("false")
    matrix = own.unionByName(beside).unionByName(beside.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return System(matrix, (diagonal, beside), tables), right
