"""Violation queries: each returns the offending rows, so an empty result means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.special import finite


def missing_keys(rows: DataFrame, keys: list[str], reference: DataFrame, reference_keys: list[str]) -> DataFrame:
    """Distinct foreign keys without a row in ``reference``."""
    ref = reference.select(*[F.col(r).alias(k) for r, k in zip(reference_keys, keys, strict=True)]).distinct()
    return rows.select(*keys).distinct().join(ref, keys, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def rule_violations(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) of each row and rule that does not hold; a rule of unknown truth counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(found).alias("rule"))


def finite_rules(columns: list[str]) -> dict[str, Column]:
    return {f"{c} is finite": finite(F.col(c)) for c in columns}


def sums_to_one(rows: DataFrame, keys: list[str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """Groups whose values do not sum to one, such as movement rows."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def key_sets_differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one table only, with the side that has them."""
    left = a.select(*keys).exceptAll(b.select(*keys)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*keys).exceptAll(a.select(*keys)).withColumn("side", F.lit("right")))


def require_empty(violations: DataFrame, message: str, show: int = 5) -> None:
    """Raise with a few offending rows unless there are none."""
    bad = violations.limit(show).collect()
    if bad:
        raise ValueError(f"{message}: {bad}")


def peel(rows: DataFrame, year: str, last: int | Column) -> DataFrame:
    """Rows up to a year."""
    return rows.filter(F.col(year) <= last)


def apply_scenarios(rows: DataFrame, scenarios: DataFrame, factors: dict[str, str]) -> DataFrame:
    """Every row under every scenario, columns multiplied by the scenario's factors (1 where null).

    The scenario table is a configuration of a few rows, which is checked before it is broadcast.
    """
    n = scenarios.limit(10_001).count()
    if n > 10_000:
        raise ValueError("more than 10,000 scenarios")
    out = rows.crossJoin(F.broadcast(scenarios))
    return out.withColumns({c: F.col(c) * F.coalesce(F.col(f), F.lit(1.0)) for c, f in factors.items()}).drop(*set(factors.values()))


def start_agreement(fits: DataFrame, by: list[str], *, baseline: Column, starts: int = 3, gradient: float = 1e-4, objective: float = 1e-6) -> DataFrame:
    """Per model: number of starts, whether all converged, the worst difference of an objective from the baseline,
    and whether just ``starts`` of them converged with small gradients on the baseline's objective."""
    worst = F.max(F.abs(F.col("objective") - baseline))
    out = fits.groupBy(*by).agg(F.count("*").alias("starts"), F.min("converged").alias("converged"), worst.alias("worst_difference"), F.max("gradient_norm").alias("__g"))
    robust = (F.col("starts") == starts) & F.col("converged") & (F.col("__g") < gradient) & (F.col("worst_difference") < objective)
    return out.withColumn("robust", robust).drop("__g")
