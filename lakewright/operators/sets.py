"""Unions with alignment, unpivots, pivots and record stacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_align(tables: dict[str, DataFrame], renames: dict[str, dict[str, str]] | None = None, label: str = "engine") -> DataFrame:
    """All rows with their table's name; columns that a table lacks are null."""
    named = []
    for name, t in tables.items():
        t = t.withColumnsRenamed((renames or {}).get(name, {}))
        named.append(t.withColumn(label, F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def unpivot(rows: DataFrame, ids: list[str], values: list[str], name: str = "parameter", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, values, name, value)


def unpivot_arrays(rows: DataFrame, ids: list[str], array: str, names: list[str] | str, name: str = "quantity", value: str = "value") -> DataFrame:
    """One row per element of an array column, named by position: from a list, or a prefix with the position from 0."""
    out = rows.select(*ids, F.posexplode(array).alias("__p", value))
    label = F.concat(F.lit(names), F.col("__p").cast("string")) if isinstance(names, str) else F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__p") + 1)
    return out.select(*ids, label.alias(name), value)


def gather(values: Column, positions: list[int]) -> list[Column]:
    """Elements of an array by position from 0; a position outside it is an error, not a null."""
    inside = lambda k: F.when((F.size(values) > k) & F.lit(k >= 0), F.get(values, F.lit(k))).otherwise(F.raise_error(F.lit(f"position {k} is out of range")))
    return [inside(k) for k in positions]


def metrics(row: DataFrame, columns: list[str], section: str | None = None) -> DataFrame:
    """A wide row as (metric, value) rows, with its section if given."""
    out = row.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "value")
    return out if section is None else out.select(F.lit(section).alias("section"), "metric", "value")


def detail_and_summary(detail: DataFrame, summary: DataFrame, rank: str = "rank") -> DataFrame:
    """Detail rows with trailing summary rows; ``rank`` orders them."""
    return detail.withColumn(rank, F.lit(0)).unionByName(summary.withColumn(rank, F.lit(1)), allowMissingColumns=True)


def weight_grid(weights: DataFrame, diagnostics: DataFrame, fleets: list[int], value: str) -> DataFrame:
    """One row per weight with a column per fleet; NaN where a diagnostic is missing."""
    wide = weights.join(diagnostics, "weight", "left").groupBy("weight").pivot("fleet", fleets).agg(F.first(value))
    return wide.select("weight", *[F.coalesce(F.col(str(f)), F.lit(float("nan"))).alias(f"fleet_{f}") for f in fleets])
