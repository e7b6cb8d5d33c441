"""Key lookups: comparisons within tolerance, effective-dated overrides, interval joins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

NAN = float("nan")


def compare_values(a: DataFrame, b: DataFrame, keys: list[str], value: str, *, how: str = "inner", atol: Column | float = 0.0, rtol: float = 2e-5) -> DataFrame:
    """keys, left, right, difference, relative (null at a zero divisor), within (|difference| <= atol + rtol |right|)."""
    x = a.select(*keys, F.col(value).alias("left"))
    y = b.select(*keys, F.col(value).alias("right"))
    d = F.col("left") - F.col("right")
    out = x.join(y, keys, how).withColumn("difference", d).withColumn("relative", F.try_divide(d, F.col("right")))
    return out.withColumn("within", F.abs(d) <= (atol if isinstance(atol, Column) else F.lit(float(atol))) + rtol * F.abs(F.col("right")))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], value: str, missing: float = NAN) -> DataFrame:
    """``value`` by key; ``missing`` where the key is absent."""
    found = table.select(*keys, value)
    return rows.join(found, keys, "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(missing)))


def last_override(rows: DataFrame, overrides: DataFrame, keys: list[str], *, at: str | None = None, since: str | None = None, order: str, value: str, default: Column) -> DataFrame:
    """``value`` of the last override (by ``order``) of a row's keys whose ``since`` is not after ``at``.

    Distinct times of rows and of overrides are dealt by key and by ranges of time with about equally many
    of them; in a range the last override so far is a running maximum, and what earlier ranges hold is one
    entry each. Rows then join one value by key and time, so neither a key's overrides nor its rows
    come together in one task. Without a match the default holds. Null keys and times match nothing.
    """
    overrides = overrides.dropna(subset=keys)
    hit = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    if not since:
        found = overrides.groupBy(*keys).agg(F.max(hit)["v"].alias("__v"))
        return rows.join(found, keys, "left").withColumn(value, F.coalesce("__v", default)).select(*rows.columns, value)
    points = rows.select(*keys, F.col(at).alias("__at")).dropna().distinct()
    starts = overrides.filter(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("__t")).agg(F.max(hit).alias("__hit"))
    events = points.withColumn("__t", F.col("__at")).unionByName(starts, allowMissingColumns=True)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = events.agg(F.percentile_approx("__t", [k / ranges for k in range(1, ranges)] or [1.0]).alias("__bounds"))
    events = events.crossJoin(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col("__t")))).drop("__bounds")
    so_far = F.max("__hit").over(Window.partitionBy(*keys, "__range").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = F.max("__hit").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carried = events.groupBy(*keys, "__range").agg(F.max("__hit").alias("__hit")).select(*keys, "__range", earlier.alias("__earlier"))
    last = events.withColumn("__last", so_far).filter(F.col("__at").isNotNull()).join(carried, [*keys, "__range"])
    found = last.select(*keys, F.col("__at").alias(at), F.greatest("__last", "__earlier")["v"].alias("__v"))
    return rows.join(found, [*keys, at], "left").withColumn(value, F.coalesce("__v", default)).select(*rows.columns, value)


#: Block edges up to which the axis is split on the driver and looked up by comparisons alone.
MOST_EDGES = 256


def _pieces(blocks: list[Row]) -> tuple[list, list[list[Row]]]:
    """(edges, blocks of each piece): pieces are what lies before, at and between the edges, in order."""
    edges = sorted({x for b in blocks for x in (b.lo, b.hi)})
    place = {x: 2 * k + 1 for k, x in enumerate(edges)}
    held: list[list[Row]] = [[] for _ in range(2 * len(edges) + 1)]
    for b in blocks:
        for k in range(place[b.lo], place[b.hi] + 1):
            held[k].append(b)
    return edges, held


def _adjusted(value: Column, blocks: list[Row]) -> Column:
    """``value`` after blocks in order: what a block replaces is forgotten, the rest is one factor and one term."""
    factor, term, kept = 1.0, 0.0, True
    for b in blocks:
        if b.code == 0:
            factor, term = factor * math.exp(b.adjustment), term * math.exp(b.adjustment)
        elif b.code == 1:
            term += b.adjustment
        else:
            factor, term, kept = 0.0, b.adjustment, False
    return (value * factor + term if blocks else value) if kept else F.lit(float(term))


def interval_blocks(rows: DataFrame, blocks: DataFrame, *, at: str, low: str = "lo", high: str = "hi", base: str, most: int = 10_000) -> DataFrame:
    """Adjust ``base`` by all blocks that hold ``at``, in block order.

    Blocks: block, lo, hi, code, adjustment. Code 0 multiplies by exp(adjustment), 1 adds it, 2 replaces;
    others are errors. Blocks with a null end hold nothing, and a null ``at`` is in none. The blocks table is
    configuration: its size is checked. The axis is split at block edges, so that a row finds its piece by
    halving and applies all blocks of it at once; beyond MOST_EDGES edges blocks are packed into one array
    that every row goes through. Rows need no shuffle whatever the number of matches.
    """
    if blocks.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} blocks")
    view = blocks.select("block", F.col(low).alias("lo"), F.col(high).alias("hi"), F.col("code").cast("int").alias("code"), F.col("adjustment").cast("double").alias("adjustment")).filter("lo is not null and hi is not null and lo <= hi")
    known = view.limit(MOST_EDGES + 1).collect()
    if len({x for b in known for x in (b.lo, b.hi)}) > MOST_EDGES or len(known) > MOST_EDGES:
        return _packed_blocks(rows, blocks, at, low, high, base)
    if any(b.code not in (0, 1, 2) or b.adjustment is None for b in known):
        raise ValueError("unknown block code or no adjustment")
    known.sort(key=lambda b: (b.block, b.lo, b.hi, b.code, b.adjustment))
    edges, held = _pieces(known)
    x, value = F.col(at), F.col(base).cast("double")

    def look(lo: int, hi: int, leaf: Callable[[list[Row]], Column]) -> Column:
        """The piece among edges lo to hi - 1 and what lies around them."""
        if lo == hi:
            return leaf(held[2 * lo])
        mid = (lo + hi) // 2
        return F.when(x < F.lit(edges[mid]), look(lo, mid, leaf)).when(x == F.lit(edges[mid]), leaf(held[2 * mid + 1])).otherwise(look(mid + 1, hi, leaf))

    nothing = x.isNull()
    adjusted = F.when(nothing, value).otherwise(look(0, len(edges), lambda b: _adjusted(value, b)))
    count = F.when(nothing, F.lit(0)).otherwise(look(0, len(edges), lambda b: F.lit(len(b))))
    return rows.withColumn("adjusted", adjusted).withColumn("n_blocks", count)


def _packed_blocks(rows: DataFrame, blocks: DataFrame, at: str, low: str, high: str, base: str) -> DataFrame:
    """``interval_blocks`` by one array of all blocks."""
    packed = blocks.agg(F.array_sort(F.collect_list(F.struct("block", F.col(low).alias("lo"), F.col(high).alias("hi"), "code", "adjustment"))).alias("__blocks"))

    def step(value: Column, b: Column) -> Column:
        inside = (F.col(at) >= b.lo) & (F.col(at) <= b.hi)
        new = F.when(b.code == 0, value * F.exp(b.adjustment)).when(b.code == 1, value + b.adjustment).when(b.code == 2, b.adjustment).otherwise(F.raise_error(F.lit("unknown block code")).cast("double"))
        return F.when(inside, new).otherwise(value)

    out = rows.crossJoin(F.broadcast(packed))
    held = F.filter("__blocks", lambda b: (F.col(at) >= b.lo) & (F.col(at) <= b.hi))
    return out.withColumn("adjusted", F.aggregate("__blocks", F.col(base).cast("double"), step)).withColumn("n_blocks", F.when(F.col(at).isNull(), F.lit(0)).otherwise(F.size(held))).drop("__blocks")


def season_of_month(month: Column, seasons: int = 4) -> dict[str, Column]:
    """Season from 1 and the time inside it of a fractional month in [1, 13)."""
    length = 12.0 / seasons
    season = (F.floor((month - 1) / length) + 1).cast("int")
    ok = (month >= 1) & (month < 13)
    return {"season": F.when(ok, season), "time": F.when(ok, (month - 1) / length - (season - 1))}


def mohns_rho(full: DataFrame, peels: DataFrame, *, year: str = "year", value: str = "value", peel: str = "peel") -> DataFrame:
    """Mean relative difference of each peel's last year from the full run's same year; tiny references are skipped."""
    last = peels.groupBy(peel).agg(F.max_by(value, year).alias("terminal"), F.max(year).alias(year))
    met = last.join(full.select(year, F.col(value).alias("reference")), year).filter(F.abs("reference") > 1e-12)
    return met.agg(F.avg((F.col("terminal") - F.col("reference")) / F.col("reference")).alias("rho"), F.count("*").alias("n_peels"))


def update_column(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """New values by key, old ones where the key has no update."""
    new = updates.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")
