"""Work along an order that no task holds whole: recurrences, numbering, ranks and quantiles of groups of any size.

Rows are sorted by range, once, into parts that tasks hold one each; a group may reach over many parts. A
recurrence x_k = (a x + b) / (c x + d) of the value before is a product of two by two matrices, so every part
sums up its rows as one matrix without knowing what comes in. What comes in follows from a table of one
row per part and recurrence, and a second look at the parts fills in the values. Sums, counts, values of
the row before, affine recurrences and pivots of tridiagonal matrices are all of this kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.special import finite
from lakewright.session import cut, partitions

PART = "__part"
#: Rows up to which a group's quantiles may be taken from one aggregation buffer.
LARGE_GROUP = 1 << 20


def in_order(rows: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """``rows`` sorted by range, kept in the shared folder, with the number of each row's part.

    Rows of equal order are dealt over parts too, in the order that they came in.
    """
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tie.repartitionByRange(parts or partitions(rows.sparkSession), *order, "__tie").sortWithinPartitions(*order, "__tie")
    return cut(dealt.drop("__tie").withColumn(PART, F.spark_partition_id()))


@dataclass(frozen=True)
class Recurrence:
    """x of a group's first row is ``start``, then (a x + b) / (c x + d) of the row's own a to d.

    ``name``: the column for x; ``name``_in holds the x that came in, null in first rows. ``by``: the group's
    columns, which come first in the rows' order. ``reverse``: from the last row of a group to its first.
    """

    name: str
    by: tuple[str, ...]
    start: Column
    a: Column
    b: Column
    c: Column | None = None
    d: Column | None = None
    reverse: bool = False


def row_number(name: str, by: tuple[str, ...], *, reverse: bool = False) -> Recurrence:
    return Recurrence(name, by, F.lit(1.0), F.lit(1.0), F.lit(1.0), reverse=reverse)


def running_sum(name: str, by: tuple[str, ...], x: Column, *, reverse: bool = False) -> Recurrence:
    return Recurrence(name, by, x, F.lit(1.0), x, reverse=reverse)


def before(name: str, by: tuple[str, ...], x: Column, *, reverse: bool = False) -> Recurrence:
    """``name``_in is x of the row before (or behind)."""
    return Recurrence(name, by, x, F.lit(0.0), x, reverse=reverse)


def _starts(table: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """Whether each row begins a run of equal ``by``; nulls are equal."""
    out = np.zeros(len(table), bool)
    out[:1] = True
    for name in by:
        x = table.column(name).combine_chunks()
        a, b = x[1:], x[:-1]
        differ = np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
        out[1:] |= differ
    return out


def _product(m: np.ndarray) -> np.ndarray:
    """The product of maps (rows a, b, c, d) in order, the last one leftmost, scaled by powers of two, which is exact."""
    while True:
        m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])
        if len(m) == 1:
            return m[0]
        odd = m[len(m) - 1 :] if len(m) % 2 else m[:0]
        p, q = m[0 : len(m) - len(odd) : 2].T, m[1 : len(m) - len(odd) : 2].T
        m = np.concatenate([np.stack([q[0] * p[0] + q[1] * p[2], q[0] * p[1] + q[1] * p[3], q[2] * p[0] + q[3] * p[2], q[2] * p[1] + q[3] * p[3]], axis=1), odd])


def _follow(first: float, m: np.ndarray) -> np.ndarray:
    """Values from ``first`` on along the maps of the rows behind it."""
    a, b, c, d = m.T
    out = np.empty(len(m) + 1)
    out[0] = first
    if not c.any() and (d == 1).all() and not a.any():
        out[1:] = b
    elif not c.any() and (d == 1).all() and (a == 1).all():
        out[1:] = first + np.cumsum(b)
    else:
        try:
            x, values = float(first), []
            for p, q, r, s in m.tolist():
                x = (p * x + q) / (r * x + s)
                values.append(x)
            out[1:] = values
        except ZeroDivisionError:
            # by the rules of floating point, where Python's numbers have an error
            x = np.float64(first)
            for k in range(len(m)):
                x = (a[k] * x + b[k]) / (c[k] * x + d[k])
                out[k + 1] = x
    return out


def _arrays(table: pa.Table, k: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    start = np.asarray(table.column(f"__r{k}_s").combine_chunks(), float)
    m = np.column_stack([np.asarray(table.column(f"__r{k}_{c}").combine_chunks(), float) for c in "abcd"])
    return (start[::-1], m[::-1]) if reverse else (start, m)


def _bounds(table: pa.Table, by: tuple[str, ...], reverse: bool) -> np.ndarray:
    """Offsets of the runs in a recurrence's direction."""
    at = np.append(np.flatnonzero(_starts(table, by)), len(table))
    return len(table) - at[::-1] if reverse else at


def _key(table: pa.Table, by: tuple[str, ...], row: int) -> str:
    return repr(tuple(table.column(c)[row].as_py() for c in by))


EDGES = "rec int, part int, first string, last string, whole boolean, a double, b double, c double, d double, head double, tail double"


def scan(ordered: DataFrame, *recurrences: Recurrence) -> DataFrame:
    """Rows of ``in_order`` with the values of recurrences: two passes over the parts and a table of a row per
    part between them, whatever the groups; rows don't move. A part is held whole by its task."""
    plain = [(r.name, r.by, r.reverse) for r in recurrences]  # what tasks need to know
    wide = ordered.withColumns({f"__r{k}_{n}": x.cast("double") for k, r in enumerate(recurrences) for n, x in (("s", r.start), ("a", r.a), ("b", r.b), ("c", F.lit(0.0) if r.c is None else r.c), ("d", F.lit(1.0) if r.d is None else r.d))})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, out = pa.Table.from_batches(held), []
        for k, (name, by, reverse) in enumerate(plain):
            start, m = _arrays(table, k, reverse)
            at = _bounds(table, by, reverse)
            n = len(table)
            physical = (lambda i: n - 1 - i) if reverse else (lambda i: i)
            with np.errstate(all="ignore"):
                a, b, c, d = _product(m[: at[1]])
                head = _follow(start[0], m[1 : at[1]])[-1]
                tail = _follow(start[at[-2]], m[at[-2] + 1 :])[-1]
            out.append((k, table.column(PART)[0].as_py(), _key(table, by, physical(0)), _key(table, by, physical(n - 1)), len(at) == 2, a, b, c, d, head, tail))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[c.split()[0] for c in EDGES.split(", ")]).astype({"rec": "int32", "part": "int32"}), preserve_index=False)

    needed = sorted({c for r in recurrences for c in r.by})
    edges = wide.select(PART, *needed, *[f"__r{k}_{n}" for k in range(len(recurrences)) for n in "sabcd"]).mapInArrow(summed, EDGES)

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        rec = int(pdf["rec"].iloc[0])
        pdf = pdf.sort_values("part", ascending=not plain[rec][2])
        known, state, out = None, np.float64(0), []
        with np.errstate(all="ignore"):
            for e in pdf.itertuples():
                goes_on = known is not None and e.first == known
                out.append((rec, e.part, float(state) if goes_on else 0.0, goes_on))
                through = (e.a * state + e.b) / (np.float64(e.c) * state + e.d) if goes_on else np.float64(e.head)
                known, state = e.last, through if e.whole else np.float64(e.tail)
        return pd.DataFrame(out, columns=["rec", "part", "carry", "goes_on"])

    carries = edges.groupBy("rec").applyInPandas(carried, "rec int, part int, carry double, goes_on boolean")
    flat = carries.groupBy(F.col("part").alias(PART)).agg(*[F.max(F.when(F.col("rec") == k, F.struct("carry", "goes_on"))).alias(f"__c{k}") for k in range(len(recurrences))])
    # one row per part
    met = wide.join(F.broadcast(flat), PART, "left")
    keep = ordered.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields), *(f"`{n}` double, `{n}_in` double" for n, _, _ in plain)])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = [table.column(c) for c in keep]
        for k, (name, by, reverse) in enumerate(plain):
            start, m = _arrays(table, k, reverse)
            at = _bounds(table, by, reverse)
            carry = table.column(f"__c{k}")[0].as_py()
            value, came = np.empty(len(table)), np.empty(len(table))
            fresh = np.zeros(len(table), bool)
            with np.errstate(all="ignore"):
                for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    goes_on = i == 0 and carry["goes_on"]
                    x = np.nan if carry["carry"] is None else carry["carry"]
                    first = np.float64(m[0, 0] * x + m[0, 1]) / np.float64(m[0, 2] * x + m[0, 3]) if goes_on else start[i]
                    value[i:j] = _follow(first, m[i + 1 : j])
                    came[i] = x if goes_on else 0.0
                    came[i + 1 : j] = value[i : j - 1]
                    fresh[i] = not goes_on
            if reverse:
                value, came, fresh = value[::-1], came[::-1], fresh[::-1]
            columns += [pa.chunked_array([pa.array(value)]), pa.chunked_array([pa.array(came, mask=fresh)])]
        names = [*keep, *(x for n, _, _ in plain for x in (n, f"{n}_in"))]
        yield from pa.table(columns, names=names).to_batches(max_chunksize=1 << 16)

    return met.mapInArrow(filled, schema)


def average_ranks(rows: DataFrame, by: list[str], value: str, *, parts: int | None = None) -> DataFrame:
    """``rows`` with __rank (from 1, ties averaged) and __n (rows) within each group; nulls come first."""
    key, tie = tuple(by), (*by, value)
    ordered = in_order(rows, *by, value, parts=parts)
    out = scan(ordered, row_number("__rank_i", key), row_number("__rank_j", key, reverse=True), row_number("__rank_f", tie), row_number("__rank_l", tie, reverse=True))
    return out.select(*rows.columns, (F.col("__rank_i") + (F.col("__rank_l") - F.col("__rank_f")) / 2).alias("__rank"), (F.col("__rank_i") + F.col("__rank_j") - 1).alias("__n"))


def quantiles(rows: DataFrame, by: list[str], value: str, ps: dict[str, float], *, large: int | None = None, parts: int | None = None) -> DataFrame:
    """Quantiles of a group's finite values by linear interpolation of order statistics, exact for any group.

    Groups of up to ``large`` values (LARGE_GROUP unless given) are aggregated; the order statistics of larger
    ones are found by their numbers in a range sort. Groups without finite values have null quantiles.
    """
    most = LARGE_GROUP if large is None else large
    x = F.when(finite(F.col(value)), F.col(value).cast("double"))
    view = rows.select(*by, x.alias("__v"))
    counts = view.groupBy(*by).agg(F.count("__v").alias("__c"))
    # no more of them than the table has rows over ``most``
    big = counts.filter(F.col("__c") > most)
    at = F.percentile("__v", F.array(*[F.lit(p) for p in ps.values()]))
    picked = [F.col("__q")[k].alias(n) for k, n in enumerate(ps)]
    if big.isEmpty():
        return view.groupBy(*by).agg(at.alias("__q")).select(*by, *picked)
    big = cut(big)
    same = [view[c].eqNullSafe(big[c]) for c in by]
    small = view.join(F.broadcast(big), same, "left_anti").groupBy(*by).agg(at.alias("__q")).select(*by, *picked)
    held = view.join(F.broadcast(big), same).select(*[view[c] for c in by], "__v", "__c").filter("__v is not null")
    numbered = scan(in_order(held, *by, "__v", parts=parts), row_number("__i", tuple(by)))
    # floor and fraction of p (n - 1) for each p: two of a group's rows each
    places = [(n, F.lit(p) * (F.col("__c") - 1)) for n, p in ps.items()]
    near = numbered.filter(" or ".join(f"__i - 1 between floor({p!r} * (__c - 1)) and ceil({p!r} * (__c - 1))" for p in ps.values()))
    sums = []
    for n, place in places:
        i = F.col("__i") - 1
        low, part = F.floor(place), place - F.floor(place)
        lo, hi = F.max(F.when(i == low, F.col("__v"))), F.max(F.when(i == F.ceil(place), F.col("__v")))
        sums.append((lo + F.max(part) * (hi - lo)).alias(n))
    return small.unionByName(near.groupBy(*by).agg(*sums))


def tridiagonal_pivots(ordered: DataFrame, by: tuple[str, ...], diagonal: Column, link: Column) -> DataFrame:
    """``ordered`` with ``pivot`` of each series' symmetric tridiagonal matrix; ``link`` is the entry beside a row
    and the one before it (not read in first rows). Pivots are all positive just where a matrix is positive
    definite, and their logarithms add up to its log determinant; ``pivot_in`` is the pivot before."""
    return scan(ordered, Recurrence("pivot", by, diagonal, diagonal, -link * link, F.lit(1.0), F.lit(0.0)))


def tridiagonal_solve(pivoted: DataFrame, by: tuple[str, ...], link: Column, right: Column, name: str = "solution") -> DataFrame:
    """Rows of ``tridiagonal_pivots`` with the solution of the system for a right-hand side."""
    v = F.col("pivot")
    down = scan(pivoted, Recurrence("__w", by, right / v, -link / v, right / v))
    w = F.col("__w")
    up = scan(down, Recurrence("__z", by, link * w, -link / v, link * w, reverse=True))
    return up.select(*pivoted.columns, (w - F.coalesce("__z_in", F.lit(0.0)) / v).alias(name))


def tridiagonal_inverse(pivoted: DataFrame, by: tuple[str, ...], link: Column) -> DataFrame:
    """Rows of ``tridiagonal_pivots`` with ``variance``, the inverse's diagonal, and ``covariance`` with the row before
    (null in first rows)."""
    v = F.col("pivot")
    square = link * link
    up = scan(pivoted, Recurrence("__t", by, square / v, square / (v * v), square / v, reverse=True))
    variance = 1 / v + F.coalesce("__t_in", F.lit(0.0)) / (v * v)
    return up.withColumn("variance", variance).withColumn("covariance", -link / F.col("pivot_in") * F.col("variance")).select(*pivoted.columns, "variance", "covariance")
