"""Near-duplicate vectors by cross-polytope hashing and randomised-rotation binary codes.

Equal vectors are one class. Several tables each deal every class to one cell: a random rotation's
coordinate of largest size, with its sign, or several such. How often two vectors share a table's cell
depends on their cosine alone, whatever the other vectors are, so the tables are as many as pairs at the
threshold need for a wanted recall; groups of near copies are cut no worse than lone pairs. In a cell
a vector's residual to the mean is rotated at random and kept as its signs, with two correction
factors: the residual's length and the inner product of code and residual. Code and a rotated query
give an unbiased estimate of the inner product and a confidence bound on its error; only pairs whose
bound reaches the threshold are computed again from the exact vectors, in double precision, and only
those that reach it exactly are links. Cells are cut into tiles of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.graph import connected_components, local_roots
from lakewright.llm.session import cut, join_counted
from lakewright.llm.vectors import rows_of

#: Classes per cell that the number of cells aims at, and rows of a tile's side.
CELL, TILE = 1024, 2048
#: Pairs whose exact cosines are computed at once.
PAIRS = 1 << 14


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled first so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Tables:
    """Hash tables over vectors of one length: ``sizes`` coordinates in each hash of a table."""

    dim: int
    sizes: list[int]
    tables: int

    @classmethod
    def of(cls, dim: int, classes: int, threshold: float, recall: float, seed: int) -> Tables:
        """About ``classes / CELL`` cells a table, and tables that bring together ``recall`` of the pairs at the threshold.

        One cell for all, which is exact, where as many tables as cells would be needed.
        """
        sizes, cells = [], -(-classes // CELL)
        while cells > 1:
            sizes.append(min(dim, -(-cells // 2)))
            cells = -(-cells // (2 * sizes[-1]))
        rng = np.random.default_rng([seed, dim])
        x, w = unit(rng.standard_normal((1 << 13, dim))), rng.standard_normal((1 << 13, dim))
        w -= (w * x).sum(1)[:, None] * x
        y = x if dim == 1 else threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * unit(w)
        p = float(np.prod([(polar(x[:, :m]) == polar(y[:, :m])).mean() for m in sizes]))
        needed = 1 if p >= recall else int(np.ceil(np.log1p(-recall) / np.log1p(-p))) if p > 0 and recall < 1 else 1 << 62
        whole = needed >= np.prod([2.0 * m for m in sizes])
        return cls(dim, [], 1) if whole else cls(dim, sizes, needed)

    @property
    def cells(self) -> int:
        return int(np.prod([2 * m for m in self.sizes], dtype=np.int64))

    def turns(self, seed: int) -> list[list[np.ndarray]]:
        return [[np.linalg.qr(np.random.default_rng([seed, self.dim, t, h]).standard_normal((self.dim, m)))[0] for h, m in enumerate(self.sizes)] for t in range(self.tables)]

    def deal(self, x: np.ndarray, turns: list[list[np.ndarray]]) -> np.ndarray:
        """The cell of each row in each table; table t's are t * cells and up."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t, hashes in enumerate(turns):
            for m, turn in zip(self.sizes, hashes, strict=True):
                out[:, t] = out[:, t] * 2 * m + polar(x @ turn)
            out[:, t] += t * self.cells
        return out


def polar(x: np.ndarray) -> np.ndarray:
    """Position of the coordinate of largest size, doubled, and one more where it is negative."""
    best = np.abs(x).argmax(1)
    return 2 * best + (x[np.arange(len(x)), best] < 0)


@dataclass
class Codes:
    """Binary codes of unit vectors relative to a centroid, with their correction factors."""

    signs: np.ndarray  # +1/-1 over sqrt(dim)
    rotated: np.ndarray  # rotated unit residuals
    length: np.ndarray  # of residuals
    fit: np.ndarray  # inner product of code and residual

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        residual = x - centre
        length = np.linalg.norm(residual, axis=1)
        rotated = (residual / np.maximum(length, 1e-12)[:, None]) @ turn
        signs = np.where(rotated >= 0, 1.0, -1.0) / np.sqrt(x.shape[1])
        return cls(signs.astype(np.float32), rotated.astype(np.float32), length, np.maximum((signs * rotated).sum(1), 1e-6))

    def upper(self, others: Codes, rows: slice, sureness: float) -> np.ndarray:
        """Upper confidence bounds of the cosine of ``rows`` of these (as queries) with the coded ``others``."""
        dim = self.signs.shape[1]
        estimate = (self.rotated[rows] @ others.signs.T) / others.fit
        error = sureness * np.sqrt(np.maximum(1 - others.fit**2, 0)) / others.fit / np.sqrt(max(dim - 1, 1))
        inner = np.minimum(estimate + error, 1.0)
        a, b = self.length[rows][:, None], others.length[None, :]
        return 1 - (a * a + b * b - 2 * a * b * inner) / 2


def tile_links(x: np.ndarray, y: np.ndarray | None, centre: np.ndarray, turn: np.ndarray, threshold: float, sureness: float, mine: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (i, j) between rows of x and y, or i < j inside x, and the number of pairs computed again.

    ``mine`` says of pairs (i, j) whether they are this tile's to compute; all are without it."""
    a = Codes.of(x, centre, turn)
    b = a if y is None else Codes.of(y, centre, turn)
    other, left, right, again = x if y is None else y, [], [], 0
    for lo in range(0, len(x), 256):
        rows = slice(lo, min(lo + 256, len(x)))
        maybe = a.upper(b, rows, sureness) >= threshold - 1e-6
        if y is None:
            maybe &= np.arange(len(other))[None, :] > np.arange(rows.start, rows.stop)[:, None]
        i, j = np.nonzero(maybe)
        if mine is not None and len(i):
            ours = np.concatenate([mine(i[k : k + PAIRS] + lo, j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)])
            i, j = i[ours], j[ours]
        again += len(i)
        if not len(i):
            continue
        hit = np.concatenate([np.einsum("ij,ij->i", x[rows][i[k : k + PAIRS]], other[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]) >= threshold
        left.append(i[hit] + lo)
        right.append(j[hit])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), again
    return np.concatenate(left), np.concatenate(right), again


CLASSED = "vec_id long, digest binary, dim int, v binary"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, starts, ends, valid = rows_of(batch.column(1))
        digest: list[bytes | None] = []
        v: list[bytes | None] = []
        dim: list[int] = []
        for s, e, ok in zip(starts, ends, valid, strict=True):
            x = flat[s:e] + 0.0
            if ok and x.any():
                raw = x.tobytes()
                narrow = x.astype(np.float32)
                v.append(narrow.tobytes() if (narrow == x).all() else raw)
                digest.append(hashlib.blake2b(raw, digest_size=16).digest())
                dim.append(e - s)
            else:
                v.append(None)
                digest.append(None)
                dim.append(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(dim, pa.int32()), pa.array(v, pa.binary())], names=["vec_id", "digest", "dim", "v"])


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors from stored components (single where they are exact, else double)."""
    return unit(np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64) for b in raw]))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, recall: float = 0.99, sureness: float = 4.0, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row in.

    n_links: other vectors with cosine >= ``threshold`` that the index brings together (equal vectors
    are counted, not compared); component_id: the least id that links reach; kept: whether that is the
    row's own. Every row is indexed and nothing is fitted. ``recall`` is the expected part of pairs right
    at the threshold that meet in some table (closer pairs meet more often), whatever groups the vectors
    form; ``sureness`` (in standard errors) bounds what codes may miss of them; precision is exact. A pair
    is compared in the first table that it shares, and counts for links and components alike. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows of null id, link with nothing and are their own component; vectors of different lengths never
    link; rows that repeat an id or a vector are linked rows of their own, told apart by their vectors; an
    empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).mapInArrow(_classes, CLASSED))
    usable = rows.filter("digest is not null and vec_id is not null")
    # classes of equal vectors, numbered: an id may stand for several vectors, a number stands for one
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    index = {dim: Tables.of(dim, n, threshold, recall, seed) for dim, n in classes.groupBy("dim").count().collect()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                tables = index[int(dim)]
                if tables.dim not in turns:
                    turns[tables.dim] = tables.turns(seed)
                for lo in range(0, part.num_rows, 2048):
                    some = part.slice(lo, 2048)
                    cells = tables.deal(matrix(some.column(3).to_pylist(), tables.dim), turns[tables.dim])
                    yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array(cells.tolist(), pa.list_(pa.int64())), some.column(4)], names=["rep", "copies", "dim", "v", "cells", "c"])

    placed = cut(classes.select("rep", "copies", "dim", "v", "c").mapInArrow(assign, "rep long, copies long, dim int, v binary, cells array<long>, c long"))
    placed = placed.withColumn("cell", F.explode("cells"))
    # cells of vectors of one length are numbered apart from those of others
    placed = placed.withColumn("key", F.struct("dim", "cell"))
    tiles = cut(placed.groupBy("key").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("g"), F.count("*").alias("m")))
    placed = join_counted(placed, tiles, "key", "m", "c", "g").withColumn("side", F.pmod(F.xxhash64("c"), F.col("g")))
    every = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    every = every.select("dim", "cell", F.least("side", "k").alias("ti"), F.greatest("side", "k").alias("tj"), "side", "rep", "c", "copies", "v", "cells")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(group.dim.iloc[0]), int(group.cell.iloc[0])
        group = group.sort_values(["side", "rep", "c"], kind="stable").reset_index(drop=True)
        x = matrix(list(group.v), dim)
        centre, turn = x.mean(0), rotation(dim, seed)
        cut_at = int((group.side == group.ti).sum())
        cells, inside = np.array(group.cells.tolist()), group.ti.iloc[0] == group.tj.iloc[0]
        table, after = cell // index[dim].cells, 0 if inside else cut_at

        def mine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # a pair that shares several cells is compared in its first table alone
            return (cells[a] == cells[b + after]).argmax(1) == table

        if not inside and cut_at in (0, len(group)):
            i = j = np.zeros(0, np.int64)
        else:
            i, j, _ = tile_links(x if inside else x[:cut_at], None if inside else x[cut_at:], centre, turn, threshold, sureness, mine)
            j = j + after
        links, copies = np.zeros(len(group), np.int64), group.copies.to_numpy()
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        rep, c = group.rep.to_numpy(), group.c.to_numpy()
        order = np.lexsort((c, rep))
        rank = np.empty(len(c), np.int64)
        rank[order] = np.arange(len(c))
        root = order[local_roots(len(c), rank[i], rank[j])][rank]
        told = links > 0
        return pd.DataFrame({"rep": rep[told], "c": c[told], "links": links[told], "root_rep": rep[root[told]], "root": c[root[told]]})

    found = cut(every.groupBy("dim", "cell", "ti", "tj").applyInPandas(search, "rep long, c long, links long, root_rep long, root long"))
    # nodes are (least id, class), so that the least node of a component has its id
    parts = connected_components(found.select(F.struct("rep", "c").alias("a"), F.struct(F.col("root_rep").alias("rep"), F.col("root").alias("c")).alias("b")))
    parts = parts.select(F.col("node.c").alias("c"), F.col("component.rep").alias("component"))
    linked = found.groupBy("c").agg(F.sum("links").alias("links"))
    per = classes.select("digest", "rep", "copies", "c").join(linked, "c", "left").join(parts, "c", "left")
    told = F.struct((F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    per = cut(per.select("digest", "copies", told.alias("found")))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    out = join_counted(out, per, "digest", "copies", "vec_id", "found")
    component = F.coalesce("found.c", "vec_id")
    return out.select("vec_id", F.coalesce("found.n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
