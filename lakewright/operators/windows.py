"""Order-dependent operators: time-series densities, chain diagnostics, spectra, sections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.distributions import dnorm
from lakewright.functions.special import inverse_normal_cdf, normal_cdf
from lakewright.operators.ordered import average_ranks, quantiles


def ar1_logpdf(rows: DataFrame, series: list[str], order: list[str], x: str, mean: float, phi: float, sd: float) -> DataFrame:
    """Log density of each series under a stationary AR(1): first term from the stationary law, then conditional."""
    w = Window.partitionBy(*series).orderBy(*order)
    before = F.lag(x).over(w)
    first = F.row_number().over(w) == 1
    value = F.when(first, dnorm(F.col(x), mean, sd / (1 - phi * phi) ** 0.5)).otherwise(dnorm(F.col(x), F.lit(mean) + phi * (before - mean), sd))
    return rows.withColumn("__l", value).groupBy(*series).agg(F.sum("__l").alias("logpdf"), F.count("*").alias("n"))


def ma1_process(rows: DataFrame, series: list[str], order: list[str], e: str, mean: float, theta: float) -> DataFrame:
    """x_t = mean + e_{t+1} + theta e_t; the last innovation of a series starts nothing."""
    w = Window.partitionBy(*series).orderBy(*order)
    return rows.withColumn("x", F.lit(mean) + F.lead(e).over(w) + theta * F.col(e)).filter(F.col("x").isNotNull())


def iid_logpdf(rows: DataFrame, by: list[str], x: str, mean: float, sd: float) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(dnorm(F.col(x), mean, sd)).alias("logpdf"))


def rank_normalize(draws: DataFrame, parameter: list[str], value: str) -> DataFrame:
    """z = inverse normal of (average rank - 3/8) / (N + 1/4) over all chains of a parameter."""
    ranked = average_ranks(draws, parameter, value)
    return ranked.withColumn("z", inverse_normal_cdf((F.col("__rank") - 0.375) / (F.col("__n") + 0.25))).drop("__rank", "__n")


def split_chains(draws: DataFrame, parameter: list[str], chain: str, iteration: list[str]) -> DataFrame:
    """Halves of the chains as chains ``split`` with ``draw`` from 1; all halves have the shortest chain's half length,
    first and last draws being kept, so an odd middle one goes."""
    w = Window.partitionBy(*parameter, chain)
    out = draws.withColumn("__k", F.row_number().over(w.orderBy(*iteration))).withColumn("__n", F.count("*").over(w))
    out = out.withColumn("__half", F.min(F.floor(F.col("__n") / 2)).over(Window.partitionBy(*parameter)))
    first, last = F.col("__k") <= F.col("__half"), F.col("__k") > F.col("__n") - F.col("__half")
    out = out.filter(first | last).withColumn("split", F.concat_ws("/", F.col(chain).cast("string"), F.when(first, "1").otherwise("2")))
    return out.withColumn("draw", F.when(first, F.col("__k")).otherwise(F.col("__k") - F.col("__n") + F.col("__half")).cast("long")).drop("__k", "__n", "__half")


def split_rhat(split: DataFrame, parameter: list[str], value: str) -> DataFrame:
    """sqrt(((n - 1) / n W + B / n) / W): 1 where nothing varies, +infinity where only means do."""
    per = split.groupBy(*parameter, "split").agg(F.avg(value).alias("__m"), F.var_samp(value).alias("__v"), F.count("*").alias("__n"))
    both = per.groupBy(*parameter).agg(F.avg("__v").alias("__w"), F.var_samp("__m").alias("__b_over_n"), F.min("__n").alias("__n"))
    n, w, b = F.col("__n"), F.col("__w"), F.col("__b_over_n")
    rhat = F.when(w > 0, F.sqrt(((n - 1) / n * w + b) / F.when(w > 0, w))).when(b > 0, F.lit(float("inf"))).otherwise(1.0)
    return both.select(*parameter, rhat.alias("rhat"))


def effective_sample_size(split: DataFrame, parameter: list[str], value: str) -> DataFrame:
    """Effective sample size from autocovariances pooled over split chains.

    Pairs of correlations begin at lag 1; they are summed until one is negative, made to fall, and the
    size is capped at the number of draws. A chain is a group of a grouped map and must fit a task; all its
    lags come from one Fourier transform.
    """
    kinds = dict(split.dtypes)

    def lags_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw", kind="stable")
        x = pdf["__x"].to_numpy(float)
        n, m = len(x), x.mean()
        wide = 1 << (2 * n - 1).bit_length()
        c = np.fft.irfft(np.abs(np.fft.rfft(x - m, wide)) ** 2, wide)[:n]
        c[0] = ((x - m) ** 2).sum()
        # sums that are only the transform's rounding are none
        c[np.abs(c) <= 1e-13 * c[0]] = 0.0
        lag = np.arange(n)
        return pd.DataFrame({**{p: pdf[p].iloc[0] for p in parameter}, "__lag": lag, "__a": c / (n - lag), "__m": m, "__n": n})

    schema = ", ".join([*(f"`{p}` {kinds[p]}" for p in parameter), "__lag int, __a double, __m double, __n int"])
    chains = split.select(*parameter, "split", "draw", F.col(value).cast("double").alias("__x")).groupBy(*parameter, "split").applyInPandas(lags_of, schema)
    lags = chains.groupBy(*parameter, "__lag").agg(F.avg("__a").alias("__acov"), F.avg(F.when(F.col("__lag") == 0, F.col("__a") * F.col("__n") / (F.col("__n") - 1))).alias("__w"), F.var_samp("__m").alias("__b_over_n"), F.first("__n").alias("__n"), F.count("*").alias("__chains"))
    top = Window.partitionBy(*parameter)
    w = F.max("__w").over(top)
    plus = (F.col("__n") - 1) / F.col("__n") * w + F.coalesce("__b_over_n", F.lit(0.0))
    rho = F.when(plus > 0, 1 - (w - F.col("__acov")) / plus).otherwise(0.0)
    lags = lags.withColumn("__rho", rho)
    pair = F.floor((F.col("__lag") - 1) / 2)
    pairs = lags.filter("__lag >= 1").groupBy(*parameter, pair.alias("__pair")).agg(F.sum("__rho").alias("__p"), F.count("*").alias("__k")).filter("__k = 2")
    up = Window.partitionBy(*parameter).orderBy("__pair").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("__ended", F.max((F.col("__p") < 0).cast("int")).over(up)).withColumn("__fall", F.min("__p").over(up))
    sums = pairs.groupBy(*parameter).agg(F.sum(F.when(F.col("__ended") == 0, F.col("__fall")).otherwise(0.0)).alias("__s"))
    out = lags.filter("__lag = 0").select(*parameter, (F.col("__n") * F.col("__chains")).cast("double").alias("__total")).join(sums, parameter, "left")
    return out.select(*parameter, (F.col("__total") / (1 + 2 * F.coalesce("__s", F.lit(0.0)))).alias("ess"))


def tail_indicators(split: DataFrame, parameter: list[str], value: str, p: float, lower: bool) -> DataFrame:
    """Whether a draw is at or beyond the p quantile, as 0 or 1."""
    q = quantiles(split, parameter, value, {"__q": p})
    beyond = F.col(value) <= F.col("__q") if lower else F.col(value) >= F.col("__q")
    return split.join(q, parameter).withColumn("tail", beyond.cast("double")).drop("__q")


def chain_diagnostics(draws: DataFrame, parameter: list[str], chain: str, iteration: list[str], value: str) -> DataFrame:
    """R-hat (the larger of rank-normalised and folded), bulk ESS and tail ESS (the smaller of both tails)."""
    split = split_chains(draws, parameter, chain, iteration)
    middle = quantiles(split, parameter, value, {"__m": 0.5})
    folded = split.join(middle, parameter).withColumn("__f", F.abs(F.col(value) - F.col("__m"))).drop("__m")
    z, zf = rank_normalize(split, parameter, value), rank_normalize(folded, parameter, "__f")
    out = split_rhat(z, parameter, "z").withColumnRenamed("rhat", "__r1").join(split_rhat(zf, parameter, "z").withColumnRenamed("rhat", "__r2"), parameter)
    out = out.join(effective_sample_size(z, parameter, "z").withColumnRenamed("ess", "bulk_ess"), parameter)
    for name, p, lower in (("__t1", 0.05, True), ("__t2", 0.95, False)):
        out = out.join(effective_sample_size(tail_indicators(split, parameter, value, p, lower), parameter, "tail").withColumnRenamed("ess", name), parameter)
    return out.select(*parameter, F.greatest("__r1", "__r2").alias("rhat"), "bulk_ess", F.least("__t1", "__t2").alias("tail_ess"))


def energy_bfmi(rows: DataFrame, chain: list[str], iteration: list[str], energy: str) -> DataFrame:
    """Mean squared energy change over the energy's population variance."""
    w = Window.partitionBy(*chain).orderBy(*iteration)
    d = rows.withColumn("__d", F.col(energy) - F.lag(energy).over(w))
    return d.groupBy(*chain).agg(F.try_divide(F.sum(F.col("__d") * F.col("__d")) / F.nullif(F.count("*") - 1, F.lit(0)), F.var_pop(energy)).alias("bfmi"), F.count("*").alias("n"))


def health(diagnostics: DataFrame, chains: DataFrame, *, rhat: float = 1.01, ess: float = 400, bfmi: float = 0.3) -> DataFrame:
    """Worst figures against thresholds and one verdict. chains: bfmi, divergences, depth_hits per chain."""
    worst = diagnostics.agg(F.max("rhat").alias("max_rhat"), F.min(F.least("bulk_ess", "tail_ess")).alias("min_ess"))
    other = chains.agg(F.min("bfmi").alias("min_bfmi"), F.sum("divergences").alias("divergences"), F.sum("depth_hits").alias("depth_hits"))
    both = worst.crossJoin(other)  # one row each
    return both.withColumn("healthy", (F.col("max_rhat") <= rhat) & (F.col("min_ess") >= ess) & (F.col("min_bfmi") >= bfmi) & (F.col("divergences") == 0) & (F.col("depth_hits") == 0))


def best_so_far(rows: DataFrame, run: list[str], evaluation: str, objective: str) -> DataFrame:
    up = Window.partitionBy(*run).orderBy(evaluation).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("best", F.min(objective).over(up)).withColumn("improved", F.col("best") < F.coalesce(F.lag("best").over(Window.partitionBy(*run).orderBy(evaluation)), F.lit(float("inf"))))


def length_probabilities(bins: DataFrame, by: list[str], edge: str, mean: Column, sd: Column) -> DataFrame:
    """Mass of each length bin under a normal law, both open tails being in the end bins."""
    w = Window.partitionBy(*by).orderBy(edge)
    upper = normal_cdf((F.lead(edge).over(w) - mean) / sd)
    out = bins.withColumn("__u", upper)
    before = F.coalesce(F.lag("__u").over(w), F.lit(0.0))
    return out.withColumn("p", F.coalesce(F.col("__u"), F.lit(1.0)) - before).drop("__u")


def until_sentinel(lines: DataFrame, by: list[str], order: str, sentinel: Column) -> DataFrame:
    """Rows of each group before its first sentinel row."""
    up = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("__s", F.max(sentinel.cast("int")).over(up)).filter("__s = 0").drop("__s")


def sections(lines: DataFrame, by: list[str], order: str, starts: Column) -> DataFrame:
    """Number of the section each line is in: section markers so far."""
    up = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(starts.cast("int")).over(up))


def thin(draws: DataFrame, every: int, most: int, chain: str = "chain", iteration: str = "iteration") -> DataFrame:
    """Draws whose iteration, from 0, is divisible by ``every``; the first ``most`` by chain and iteration."""
    return draws.filter(F.col(iteration) % every == 0).orderBy(chain, iteration).limit(most)


def spr(rows: DataFrame, by: list[str], year: str, fished: str, unfished: str, recruits: str) -> DataFrame:
    """Spawning potential ratio per year: spawners per recruit with fishing over without."""
    out = rows.groupBy(*by, year).agg(F.sum(fished).alias("f"), F.sum(unfished).alias("u"), F.max(recruits).alias("r"))
    return out.select(*by, year, F.try_divide(F.try_divide("f", "r"), F.try_divide("u", "r")).alias("spr"))
