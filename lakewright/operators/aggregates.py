"""Grouped summaries of residuals, samples, gradients and benchmark runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.special import finite
from lakewright.operators.ordered import quantiles

LOG_FLOOR = 1e-12


def log_residual(observed: Column, predicted: Column, floor: float = LOG_FLOOR) -> Column:
    return F.ln(F.greatest(observed, F.lit(floor))) - F.ln(F.greatest(predicted, F.lit(floor)))


def _summary(residual: str, error: str) -> list[Column]:
    ok = finite(F.col(residual)) & finite(F.col(error))
    r, e = F.when(ok, F.col(residual)), F.when(ok, F.col(error))
    return [F.count(r).alias("n"), F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("sdnr"), F.sqrt(F.avg(e * e)).alias("rmse")]


def residual_summary(rows: DataFrame, by: list[str], residual: str = "residual", error: str = "error") -> DataFrame:
    """n, mean standardised residual, its sample sd and RMSE of the error, over finite pairs of each group."""
    return rows.groupBy(*by).agg(*_summary(residual, error))


def residual_strata(rows: DataFrame, by: list[str], strata: list[str], residual: str = "residual", error: str = "error") -> DataFrame:
    """The summary by group and each stratum in one pass over grouping sets: stratum, level and figures."""
    view = rows.select(*by, *strata, residual, error)
    sets = [[*by, s] for s in strata]
    out = view.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*by, *strata)]).agg(*_summary(residual, error), *[F.grouping(s).alias(f"__{s}") for s in strata])
    name, level = F.lit(None), F.lit(None)
    for s in strata:
        name = F.when(F.col(f"__{s}") == 0, F.lit(s)).otherwise(name)
        level = F.when(F.col(f"__{s}") == 0, F.col(s).cast("string")).otherwise(level)
    return out.withColumns({"stratum": name, "level": level}).select(*by, "stratum", "level", "n", "mean_residual", "sdnr", "rmse")


def component_shares(rows: DataFrame, component: str, nll: str, observed: str) -> DataFrame:
    """NLL per component, its share of total absolute NLL, observation units and NLL per unit (null without units)."""
    per = rows.groupBy(component).agg(F.sum(nll).alias("nll"), F.count_if(F.col(observed) > 0).alias("units"))
    share = F.try_divide(F.abs("nll"), F.sum(F.abs("nll")).over(Window.partitionBy()))
    return per.withColumn("share", share).withColumn("nll_per_unit", F.try_divide("nll", "units"))


def parameter_displacement(value: Column, initial: Column) -> dict[str, Column]:
    """Displacement and whether it is extreme: not finite, |value| > 20 or |displacement| > 8."""
    d = value - initial
    return {"displacement": d, "extreme": ~finite(value) | (F.abs(value) > 20) | (F.abs(d) > 8)}


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of a row per group side by side; null groups meet."""
    names = [f"__{k}" for k in range(len(by))]
    right = b.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], *[c for c in b.columns if c not in by])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)], F.lit(True))
    return a.join(right, same).drop(*names)


def envelope(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sd (0 for one sample), median, 95 % limits by linear interpolation and n, over finite samples."""
    x = F.when(finite(F.col(value)), F.col(value).cast("double"))
    out = rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.when(F.count(x) == 1, 0.0)).alias("se"), F.count(x).alias("n_samples"))
    q = quantiles(rows, by, value, {"median": 0.5, "lwr_95": 0.025, "upr_95": 0.975})
    return _beside(out, q, by).select(*by, "mean", "median", "lwr_95", "upr_95", "se", "n_samples")


def latent_summary(rows: DataFrame, by: list[str], value: str, index: str) -> DataFrame:
    """Count, mean, population sd, extremes with their first index, and L2 norm."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("sd"),
        F.min(v).alias("min"),
        F.min(F.struct(v.alias("v"), F.col(index).alias("i")))["i"].alias("argmin"),
        F.max(v).alias("max"),
        F.min(F.struct((-v).alias("v"), F.col(index).alias("i")))["i"].alias("argmax"),
        F.sqrt(F.sum(v * v)).alias("l2"),
    )


def bias_summary(rows: DataFrame, by: list[str], bias: str, depletion: str, low: float = 0.2) -> DataFrame:
    """Mean, median, 10 and 90 % points of a bias and the rate of low depletion over finite cases."""
    ok = finite(F.col(bias)) & finite(F.col(depletion))
    b = F.when(ok, F.col(bias).cast("double"))
    out = rows.groupBy(*by).agg(F.count(b).alias("n"), F.avg(b).alias("mean_bias"), F.avg(F.when(ok, (F.col(depletion) < low).cast("double"))).alias("low_rate"))
    q = quantiles(rows.select(*by, b.alias("__b")), by, "__b", {"median_bias": 0.5, "p10": 0.1, "p90": 0.9})
    return _beside(out, q, by).select(*by, "n", "mean_bias", "median_bias", "p10", "p90", "low_rate")


def gradient_volatility(rows: DataFrame, sample: str, component: str, gradient: str, baseline: str) -> tuple[DataFrame, DataFrame]:
    """(gradient norms over samples: mean, sd, cv, max; per component: sd and sign flips against the baseline)."""
    norm = rows.groupBy(sample).agg(F.sqrt(F.sum(F.col(gradient) ** 2)).alias("norm"))
    over = norm.agg(F.count("*").alias("n"), F.avg("norm").alias("mean_norm"), F.stddev_samp("norm").alias("sd_norm"), F.try_divide(F.stddev_samp("norm"), F.avg("norm")).alias("cv_norm"), F.max("norm").alias("max_norm"))
    per = rows.groupBy(component).agg(F.stddev_samp(gradient).alias("sd"), F.count_if(F.signum(gradient) * F.signum(baseline) < 0).alias("sign_flips"))
    return over, per


def first_argmax(rows: DataFrame, by: list[str], name: str, index: str, value: str) -> DataFrame:
    """The largest absolute value and the first name that has it."""
    best = F.min(F.struct((-F.abs(value)).alias("v"), F.col(index).alias("i"), F.col(name).alias("name")))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.name").alias(name), (-F.col("b.v")).alias("max_abs"))


def profiled_log_q(rows: DataFrame, by: list[str], log_base: str, observed: str, se: str, use: str, bias: bool) -> DataFrame:
    """Precision-weighted mean of log(observed) - log_base over used rows (+ half a variance each with ``bias``); 0 if none."""
    w = F.when(F.col(use), 1 / (F.col(se) * F.col(se)))
    x = F.ln(F.when(F.col(use), F.col(observed))) - F.col(log_base)
    extra = F.lit(0.5) * F.count(w) if bias else F.lit(0.0)
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(w * x) + extra, F.sum(w)), F.lit(0.0)).alias("log_q"), F.count(w).alias("n"))


def cold_warm(rows: DataFrame, by: list[str], order: str, time: str) -> DataFrame:
    """Cold = first run, warm = mean of the later half; ratio and improvement in per cent."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("__k", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    out = ranked.groupBy(*by).agg(F.max(F.when(F.col("__k") == 1, F.col(time))).alias("cold"), F.avg(F.when(F.col("__k") > F.floor(F.col("__n") / 2), F.col(time))).alias("warm"), F.count("*").alias("runs"))
    return out.withColumn("ratio", F.try_divide("cold", "warm")).withColumn("improvement_pct", 100 * (1 - F.try_divide("warm", "cold")))


def growth(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """y at the least and the greatest x, their ratio; groups with fewer than two points go."""
    some = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = some.groupBy(*by).agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min_by(y, x).alias("y0"), F.max_by(y, x).alias("y1")).filter("n >= 2")
    return out.withColumn("ratio", F.try_divide("y1", "y0"))


def reuse_ratio(rows: DataFrame, by: str, fresh: str, reuse: str, nnz: str) -> DataFrame:
    """Mean fresh and reused times per size, their ratio and the improvement in per cent."""
    out = rows.groupBy(F.col(by).cast("int").alias(by)).agg(F.avg(fresh).alias("fresh"), F.avg(reuse).alias("reuse"), F.min(nnz).alias("nnz"))
    return out.withColumn("ratio", F.try_divide("fresh", "reuse")).withColumn("improvement_pct", 100 * (1 - F.try_divide("reuse", "fresh")))


def mean_pattern(rows: DataFrame, by: list[str], year: str, value: str, first: int, last: int) -> DataFrame:
    """Mean over a range of years."""
    return rows.filter(F.col(year).between(first, last)).groupBy(*by).agg(F.avg(value).alias("mean"))


def weighted_components(rows: DataFrame, component: str, value: str, weight: str) -> DataFrame:
    return rows.groupBy(component).agg(F.sum(F.col(value) * F.col(weight)).alias("weighted"), F.sum(value).alias("raw"))


def biomass(numbers: Column, weights: Column, maturity: Column | None = None) -> Column:
    """Sum over age arrays of numbers times weight (times maturity)."""
    w = weights if maturity is None else F.zip_with(weights, maturity, lambda a, b: a * b)
    return F.aggregate(F.zip_with(numbers, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def derived_series(rows: DataFrame, by: list[str], year: str, log_state: str, catch: str, log_q: float) -> DataFrame:
    """Biomass, index, depletion against the first year and fishing rate by year."""
    w = Window.partitionBy(*by).orderBy(year)
    b = F.exp(log_state)
    out = rows.withColumn("biomass", b).withColumn("index_fit", b * F.exp(F.lit(log_q)))
    return out.withColumn("depletion", F.col("biomass") / F.first("biomass").over(w)).withColumn("fishing_rate", F.try_divide(F.col(catch), F.col("biomass")))


def largest_holding(rows: DataFrame, by: list[str], value: str, order: str, shares: dict[str, float]) -> DataFrame:
    """Per group, how many of the largest absolute values hold each share of their sum."""
    w = Window.partitionBy(*by)
    run = w.orderBy(F.desc("__a"), order)
    out = rows.withColumn("__a", F.abs(value)).withColumn("__run", F.sum("__a").over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("__a").over(w)).withColumn("__k", F.row_number().over(run))
    return out.groupBy(*by).agg(*[F.min(F.when(F.col("__run") >= t - 1e-12, F.col("__k"))).cast("long").alias(n) for n, t in shares.items()])
