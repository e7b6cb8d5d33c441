"""Exact top-k search by inner product with vector-approximation files.

Two files are written in the shared folder. The exact file has a row per vector: of equal vectors those
of the k + 1 smallest ids, as no query can ask for more. The approximation file has a row per chunk of
them with one byte per component: the cell of a uniform grid that the component falls in. Queries, in
blocks, scan the approximation file alone; every cell vector gives a lower and an upper bound of the
score, and what is below the k-th lower bound is gone. Exact vectors are then read in the order of upper
bounds: those of the k best bounds first, after that only those whose bound reaches the k-th exact score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.exchange import join_blobs, split_blobs
from lakewright.llm.session import cut, join_counted, partitions
from lakewright.llm.vectors import rows_of

CELLS = 255
#: Candidates that a scan holds before those that a raised bound rules out are dropped, or all are passed on.
POOL = 1 << 21

#: How a vector's components are stored: scaled as small integers, scaled as doubles, or as they came.
SMALL, WIDE, PLAIN = 2, 8, 9


def store(x: np.ndarray, scale: float) -> bytes:
    """A vector's floor(scale * x), or x itself where scaling leaves the doubles' range."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x) + 0.0
    if not np.isfinite(y).all():
        return bytes([PLAIN]) + x.tobytes()
    small = y.astype(np.int16) if np.abs(y).max(initial=0) < 2**15 else None
    return bytes([WIDE]) + y.tobytes() if small is None else bytes([SMALL]) + small.tobytes()


def load(data: bytes) -> np.ndarray:
    """The stored components as doubles (unscaled ones of a PLAIN vector)."""
    return np.frombuffer(data, np.int16 if data[0] == SMALL else np.float64, offset=1).astype(np.float64)


def integers(data: bytes, scale: float) -> list[int]:
    if data[0] == PLAIN:
        return [(Fraction(v) * Fraction(scale)).__floor__() for v in load(data).tolist()]
    return [int(v) for v in load(data).tolist()]


def stack(raw: list[bytes], dim: int = 0) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros; those of PLAIN ones are zero."""
    rows = [np.zeros(0) if r[0] == PLAIN else load(r) for r in raw]
    out = np.zeros((len(rows), max([dim, *map(len, rows)])))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class Approximation:
    """Cells of a chunk's components on a uniform grid per dimension, and score bounds from them."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, width: np.ndarray, reach: np.ndarray, unbounded: np.ndarray):
        self.cells, self.low, self.width, self.reach, self.unbounded = cells, low, width, reach, unbounded

    @classmethod
    def of(cls, x: np.ndarray, unbounded: np.ndarray | None = None) -> Approximation:
        low = x.min(0)
        width = np.maximum(x.max(0) / CELLS - low / CELLS, 1e-300)
        cells = np.clip(np.floor((x - low) / width), 0, CELLS - 1).astype(np.uint8)
        return cls(cells, low, width, np.abs(x).max(0), np.zeros(len(x), bool) if unbounded is None else unbounded)

    def pack(self) -> bytes:
        return join_blobs(self.cells.tobytes(), self.low.tobytes(), self.width.tobytes(), self.reach.tobytes(), self.unbounded.tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Approximation:
        cells, low, width, reach, unbounded = split_blobs(data)
        f = [np.frombuffer(b, np.float64) for b in (low, width, reach)]
        return cls(np.frombuffer(cells, np.uint8).reshape(-1, len(f[0])), *f, np.frombuffer(unbounded, bool))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(middle score of each query and candidate, the most a query's scores differ from it)."""
        middle = (queries * self.width) @ self.cells.T.astype(np.float64)
        middle += (queries @ (self.low + self.width / 2))[:, None]
        slack = np.abs(queries) @ self.reach * 1e-9 + 1e-6
        return middle, np.abs(queries) @ (self.width / 2) + slack


    def limits(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of every query's and candidate's score; infinite where doubles can't tell."""
        dim = self.cells.shape[1]
        queries = np.pad(queries, ((0, 0), (0, max(0, dim - queries.shape[1]))))[:, :dim]
        with np.errstate(over="ignore", invalid="ignore"):
            middle, radius = self.bounds(queries)
            lower, upper = middle - radius[:, None], middle + radius[:, None]
        lower[~np.isfinite(lower)], upper[~np.isfinite(upper)] = -np.inf, np.inf
        lower[:, self.unbounded], upper[:, self.unbounded] = -np.inf, np.inf
        return lower, upper


def exact_score(query: bytes, x: bytes, scale: float) -> int:
    """The integer inner product, in Python's integers where doubles could round; held within 64 bits."""
    if PLAIN not in (query[0], x[0]):
        a, b = load(query), load(x)
        n = min(len(a), len(b))
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * n < 2**52:
            return int(a[:n] @ b[:n])
    total = sum(p * q for p, q in zip(integers(query, scale), integers(x, scale), strict=False))
    return max(-(2**63), min(2**63 - 1, total))


KEPT = "vec_id long, digest binary, x binary"


def _store(scale: float, copies: int):
    """Usable rows with their stored vector and its digest; of rows repeated inside a batch ``copies``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0))
            flat, starts, ends, valid = rows_of(batch.column(1))
            valid = valid & ~np.asarray(batch.column(0).is_null())
            out: list[tuple[int, bytes, bytes]] = []
            seen: dict[tuple[int, bytes], int] = {}
            for k in np.flatnonzero(valid):
                x = store(flat[starts[k] : ends[k]], scale)
                # trailing zeros change no score: vectors that differ by them alone are equal
                key = (int(ids[k]), hashlib.blake2b(x[:1] + load(x).astype(np.float64).tobytes().rstrip(b"\0"), digest_size=16).digest())
                seen[key] = seen.get(key, 0) + 1
                if seen[key] <= copies:
                    out.append((*key, x))
            i, d, x = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(d, pa.binary()), pa.array(x, pa.binary())], names=["vec_id", "digest", "x"])

    return run


CHUNK = "rid long, ids binary, cells binary"


def _approximate(chunk_rows: int):
    """The approximation file's rows from the exact file's, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk_rows):
                some = batch.slice(lo, chunk_rows)
                raw = some.column(2).to_pylist()
                packed = Approximation.of(stack(raw, 1), np.array([r[0] == PLAIN for r in raw])).pack()
                # numbers run on inside a partition, so a chunk's are its first and its length
                yield pa.RecordBatch.from_arrays([some.column(0).slice(0, 1), pa.array([np.asarray(some.column(1)).astype(np.int64).tobytes()]), pa.array([packed])], names=["rid", "ids", "cells"])

    return run


class Scan:
    """Bounds of a block of queries: the k best lower bounds of each, and the candidates that reach them."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, unbounded: np.ndarray, k: int):
        self.ids, self.queries, self.unbounded, self.k = ids, queries, unbounded, k
        self.best = np.full((len(ids), k), -np.inf)
        self.pool: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def take(self, rid: int, ids: np.ndarray, cells: Approximation) -> None:
        for lo in range(0, len(self.ids), 256):
            mine = slice(lo, min(lo + 256, len(self.ids)))
            lower, upper = cells.limits(self.queries[mine])
            lower[self.unbounded[mine]], upper[self.unbounded[mine]] = -np.inf, np.inf
            best = self.best[mine]
            own = self.ids[mine][:, None] == ids[None, :]
            lower[own] = -np.inf
            rise = np.flatnonzero(lower.max(1) > best.min(1))
            if len(rise):
                both = np.concatenate([best[rise], lower[rise]], 1)
                best[rise] = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
            i, j = np.nonzero((upper >= best.min(1)[:, None]) & ~own)
            self.pool.append(((i + lo).astype(np.int32), rid + j, lower[i, j], upper[i, j]))
            self.held += len(i)

    def prune(self) -> None:
        if self.pool:
            q, rid, lower, upper = (np.concatenate(c) for c in zip(*self.pool, strict=True))
            ok = upper >= self.best.min(1)[q]
            self.pool, self.held = [(q[ok], rid[ok], lower[ok], upper[ok])], int(ok.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The candidates held, which are held no more."""
        self.prune()
        for q, rid, lower, upper in self.pool:
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(rid), pa.array(lower), pa.array(upper)], names=["query_id", "rid", "lower", "upper"])
        self.pool, self.held = [], 0


BOUNDS = "query_id long, rid long, lower double, upper double"


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan, asked = None, None, []
        for batch in batches:
            for block, slot, rid, query, ids, payload in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (block, slot) != now:
                    if scan is not None:
                        yield from scan.rows()
                    now, scan, asked = (block, slot), None, []
                if rid < 0:
                    asked.append((query, payload))
                    continue
                if scan is None and asked:
                    qi, raw = zip(*asked, strict=True)
                    scan = Scan(np.array(qi, np.int64), stack(list(raw), 1), np.array([r[0] == PLAIN for r in raw]), k)
                if scan is not None:
                    scan.take(rid, np.frombuffer(ids, np.int64), Approximation.unpack(payload))
                    if scan.held > POOL:
                        scan.prune()
                        if scan.held > POOL // 2:
                            yield from scan.rows()
        if scan is not None:
            yield from scan.rows()

    return run


def files(vectors: DataFrame, *, k: int, scale: float, chunk_rows: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(exact file: rid, vec_id, x; approximation file: rid of its first row, ids, cells)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    stored = rows.mapInArrow(_store(scale, k), KEPT)
    near = F.dense_rank().over(Window.partitionBy("digest").orderBy("vec_id"))
    stored = stored.withColumn("near", near).filter(F.col("near") <= k + 1)
    exact = cut(stored.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "x"))
    return exact, cut(exact.mapInArrow(_approximate(chunk_rows), CHUNK))


def candidates(queries: DataFrame, approximations: DataFrame, *, k: int, block_queries: int) -> DataFrame:
    """(query_id, rid, upper, rank): all rows whose upper bound reaches the k-th lower bound, best bounds first."""
    asked = queries.count()
    blocks = max(1, -(-asked // block_queries))
    slots = max(1, -(-partitions(queries.sparkSession) // blocks))
    numbers = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name) for n, name in ((blocks, "block"), (slots, "slot"))]
    chunks = approximations.select(numbers[0], F.pmod(F.hash("rid"), F.lit(slots)).alias("slot"), "rid", F.lit(None).cast("long").alias("query_id"), "ids", "cells")
    blocked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), numbers[1], F.lit(-1).cast("long").alias("rid"), "query_id", F.lit(None).cast("binary").alias("ids"), F.col("x").alias("cells"))
    dealt = blocked.unionByName(chunks).repartition("block", "slot").sortWithinPartitions("block", "slot", "rid")
    found = dealt.mapInArrow(_scan(k), BOUNDS)
    of = Window.partitionBy("query_id")
    whole = of.orderBy(F.desc("lower"), "rid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumn("kth", F.nth_value("lower", k).over(whole)).filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    return found.select("query_id", "rid", "upper", F.row_number().over(of.orderBy(F.desc("upper"), "rid")).alias("rank"))


def read(pairs: DataFrame, exact: DataFrame, queries: DataFrame, scale: float) -> DataFrame:
    """(query_id, vec_id, score) of pairs (query_id, rid) from the exact vectors. Vectors that very many
    queries ask for are not one task's burden."""
    asked = cut(pairs.groupBy("rid").agg(F.count("*").alias("held")).join(exact, "rid").select("rid", "held", F.struct("vec_id", "x").alias("found")))
    met = join_counted(pairs.select("query_id", "rid"), asked, "rid", "held", "query_id", "found")
    met = met.join(queries.select("query_id", F.col("x").alias("q")), "query_id").select("query_id", "found.vec_id", "q", "found.x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [exact_score(q, x, scale) for q, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, *, k: int = 10, scale: float = 1024.0, query_every: int = 100, block_queries: int = 16384, chunk_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows by integer inner product of floor(scale * x).

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but those of the
    query's own id. Queries come in blocks of ``block_queries`` on average; every block meets every chunk
    of the approximation file once, blocks and chunks being dealt over all tasks. Ties go to the smaller
    id. Vectors that are null or empty or hold null or non-finite components, and rows of null id, take no
    part; a finite vector that overflows when scaled is compared exactly; a shorter vector counts as padded
    with zeros; candidate rows that repeat an id each count; a query id given twice asks with its least
    vector; scores are held within 64 bits; an empty table gives no rows; other columns are not read.
    """
    exact, approximations = files(vectors, k=k, scale=scale, chunk_rows=chunk_rows, id_col=id_col, vector_col=vector_col)
    asking = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id") % query_every == 0)
    queries = cut(asking.mapInArrow(_store(scale, 1), KEPT).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x")))
    found = cut(candidates(queries, approximations, k=k, block_queries=block_queries))
    first = cut(read(found.filter(F.col("rank") <= k), exact, queries, scale))
    # a query whose k best bounds gave k scores needs no vector whose bound is below the least of them
    least = first.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
    rest = found.filter(F.col("rank") > k).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least") * F.when(F.col("least") > 0, 1 - 1e-12).otherwise(1 + 1e-12) - 1))
    scored = first.unionByName(read(rest, exact, queries, scale))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
