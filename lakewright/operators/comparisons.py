"""Comparisons of two runs with verdicts: differences in standard errors, sensitivity to a step, reported figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.operators.ordered import in_order, row_number, scan
from lakewright.operators.validation import require_empty


def standardised_differences(a: DataFrame, b: DataFrame, errors: DataFrame, keys: list[str], value: str, error: str) -> DataFrame:
    """keys, left, right, difference and difference over the standard error, for every key of ``errors``.

    A key that is missing in ``a`` or ``b`` has nulls there (see ``recovered``); keys without a standard error are
    not compared. A zero error gives a null ratio.
    """
    x, y = (t.select(*keys, F.col(value).alias(n)) for t, n in ((a, "left"), (b, "right")))
    out = errors.select(*keys, F.col(error).alias("__se")).join(x, keys, "left").join(y, keys, "left")
    d = F.col("left") - F.col("right")
    return out.select(*keys, "left", "right", d.alias("difference"), F.try_divide(d, F.col("__se")).alias("in_errors"))


def recovered(differences: DataFrame, *, most: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """Per group (or of all) how many were compared, how many could not be, the largest absolute difference in standard
    errors, and whether all could be and none is ``most`` or more."""
    lost = F.count_if(F.col("in_errors").isNull())
    worst = F.max(F.abs("in_errors"))
    out = differences.groupBy(*(by or [])).agg(F.count("*").alias("compared"), lost.alias("lost"), worst.alias("worst"))
    return out.withColumn("recovered", (F.col("lost") == 0) & F.coalesce(F.col("worst") < most, F.lit(False)))


def in_place(a: DataFrame, b: DataFrame, order: list[str], label: str, value: str, *, parts: int | None = None) -> DataFrame:
    """(place from 1, left_label, right_label, left, right): rows of two tables by their places in an order, which are
    counted over range-sorted parts. A row without a counterpart has nulls on the other side."""
    sides = []
    for t, n in ((a, "left"), (b, "right")):
        view = t.select(F.lit(0).alias("__all"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], F.col(label).alias(f"{n}_label"), F.col(value).alias(n))
        numbered = scan(in_order(view, "__all", *[f"__o{k}" for k in range(len(order))], parts=parts), row_number("__place", ("__all",)))
        sides.append(numbered.select(F.col("__place").cast("long").alias("place"), f"{n}_label", n))
    return sides[0].join(sides[1], "place", "full")


def step_sensitivity(coarse: DataFrame, fine: DataFrame, order: list[str], label: str, value: str, *, most: float = 1e-4, parts: int | None = None) -> DataFrame:
    """(place, label, coarse, fine, change, sensitive) of figures at two steps, which must have the same labels in the same
    order (else an error); change is relative to the finer one, null where that is zero."""
    met = in_place(coarse, fine, order, label, value, parts=parts)
    require_empty(met.filter(~F.col("left_label").eqNullSafe(F.col("right_label"))), "labels differ")
    change = F.abs(F.try_divide(F.col("left"), F.col("right")) - 1)
    return met.select("place", F.col("left_label").alias(label), F.col("left").alias("coarse"), F.col("right").alias("fine"), change.alias("change"), F.coalesce(change >= most, F.lit(True)).alias("sensitive"))


def against_report(figures: DataFrame, names: DataFrame, report: DataFrame, *, name: str, label: str, value: str, most: float = 0.01, expected: int | None = None) -> DataFrame:
    """(name, label, ours, theirs, relative, within): figures against a report that has other labels.

    ``names`` (name, label) says which; figures without a label, or whose label the report does not have as a
    finite number, are not compared. With ``expected`` another number of comparisons is an error.
    """
    theirs = report.select(label, F.col(value).cast("double").alias("theirs")).filter("theirs is not null and not isnan(theirs)")
    met = figures.select(name, F.col(value).alias("ours")).join(names.select(name, label), name).join(theirs, label)
    relative = F.abs(F.try_divide(F.col("ours"), F.col("theirs")) - 1)
    out = met.select(name, label, "ours", "theirs", relative.alias("relative"), F.coalesce(relative < most, F.lit(False)).alias("within"))
    if expected is not None:
        found = out.count()
        if found != expected:
            raise ValueError(f"{found} comparisons where {expected} are due")
    return out
