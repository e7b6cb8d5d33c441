"""State-space surplus production: the latent log-biomass model, projections, envelopes, reference points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.biology import surplus_production
from lakewright.operators.aggregates import envelope
from lakewright.plans import expr as X
from lakewright.plans.laplace import ChainLaplace
from lakewright.plans.optimize import finite_gradient, lbfgs

#: Default catch multipliers of projection scenarios.
SCENARIOS = {"zero_catch": 0.0, "low_catch": 0.75, "status_quo": 1.0, "high_catch": 1.25}


def chain_model(*, start: float = 0.82, start_sd: float = 0.15, process_sd: float = 0.10, index_sd: float = 0.08, r_prior: tuple[float, float] = (0.34, 0.25), k_prior: tuple[float, float] = (950.0, 0.50)) -> ChainLaplace:
    """Latent log biomass u_t with logistic production less catch, an index q * B, and weak priors on r and K.

    Parameters log_q, log_r, log_K; data catch_mt and index. Predicted biomass is kept positive by the
    smooth root of its square.
    """
    u, v = X.random("u"), X.random("v")
    log_q, log_r, log_k = (X.param(p) for p in ("log_q", "log_r", "log_K"))
    b = X.exp(u)
    ahead = b + X.exp(log_r) * b * (1 - b * X.exp(-log_k)) - X.data("catch_mt")
    ahead = X.sqrt(X.square(ahead) + 1e-8)
    prior = 0.5 * X.square((log_r - math.log(r_prior[0])) / r_prior[1]) + 0.5 * X.square((log_k - math.log(k_prior[0])) / k_prior[1])
    first = 0.5 * X.square((u - (log_k + math.log(start))) / start_sd) + prior
    step = 0.5 * X.square((v - X.log(ahead)) / process_sd)
    observe = 0.5 * X.square((X.log(X.data("index")) - log_q - u) / index_sd)
    return ChainLaplace(first, step, observe, ["log_q", "log_r", "log_K"])


def _path(start: Column, years: int, step) -> Column:
    """Array of ``years`` states after ``start``."""
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.array(start.cast("double")), lambda acc, t: F.concat(acc, F.array(step(F.element_at(acc, -1), t)))), 2, years)


def project(stocks: DataFrame, scenarios: DataFrame, *, years: int, start_year: int, keys: list[str]) -> DataFrame:
    """scenario x year biomass and index: B' = max(1, B + r B (1 - B / K) - catch).

    stocks: keys, biomass, recent_catch, r, k, q. scenarios (scenario, catch_multiplier) is a table of
    a few rows, checked before it is broadcast. No shuffle: a path is one array per row.
    """
    if scenarios.limit(1001).count() > 1000:
        raise ValueError("more than 1,000 scenarios")
    both = stocks.crossJoin(F.broadcast(scenarios)).withColumn("catch_mt", F.col("recent_catch") * F.col("catch_multiplier"))
    path = _path(F.col("biomass"), years, lambda b, t: surplus_production(b, F.col("r"), F.col("k"), F.col("catch_mt")))
    out = both.select(*keys, "scenario", "catch_mt", "q", F.posexplode(path).alias("t", "biomass"))
    return out.select(*keys, "scenario", (F.col("t") + start_year).alias("year"), "catch_mt", "biomass", (F.col("q") * F.col("biomass")).alias("index"))


def _normal(*keys) -> Column:
    """A standard normal number that the keys determine: Box and Muller's on two hashes."""
    one, two = ((F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in (1, 2))
    return F.sqrt(-2.0 * F.ln(one)) * F.cos(2 * math.pi * two)


def projection_envelopes(projection: DataFrame, terminal_log_b: float, variance: float, q: float, *, samples: int = 1000, seed: int = 8675309) -> DataFrame:
    """Envelope per scenario, year and quantity from lognormal draws of the terminal state.

    Each draw follows the point projection's yearly increments, whole paths of any length, with a floor of
    1e-12. Draws come from hashes of seed, scenario and draw, so they don't depend on partitioning.
    Without a usable variance the statistics are null.
    """
    if not (math.isfinite(variance) and variance >= 0 and samples > 1):
        point = projection.select("scenario", "year", F.explode(F.array(F.struct(F.lit("biomass").alias("quantity"), F.col("biomass").alias("estimate")), F.struct(F.lit("index").alias("quantity"), F.col("index").alias("estimate")))).alias("e"))
        return point.select("scenario", "year", "e.*", *[F.lit(None).cast("double").alias(c) for c in ("mean", "median", "lwr_95", "upr_95", "se")], F.lit(samples).cast("long").alias("n_samples"))
    start, floor = math.exp(terminal_log_b), 1e-12
    # a walk with a floor is the free walk lifted by the largest shortfall so far, so steps need no loop
    free = F.col("biomass") - start
    shortfall = F.max(F.lit(floor) - free).over(Window.partitionBy("scenario").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    path = projection.select("scenario", "year", F.col("biomass").alias("estimate"), free.alias("free"), shortfall.alias("shortfall"))
    first = F.exp(F.lit(terminal_log_b) + math.sqrt(variance) * _normal(F.lit(seed), "scenario", "s"))
    rows = path.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    rows = rows.select("scenario", "year", "estimate", F.greatest(F.lit(floor), F.col("free") + F.greatest(first, "shortfall")).alias("b"))
    long = rows.select("scenario", "year", F.explode(F.array(F.struct(F.lit("biomass").alias("quantity"), F.col("estimate"), F.col("b").alias("value")), F.struct(F.lit("index").alias("quantity"), (q * F.col("estimate")).alias("estimate"), (q * F.col("b")).alias("value")))).alias("e")).select("scenario", "year", "e.*")
    return envelope(long, ["scenario", "year", "quantity", "estimate"], "value")


def reference_points(stocks: DataFrame, r: str = "r", k: str = "k", biomass: str = "biomass", catch: str = "catch_mt") -> DataFrame:
    """B_MSY = K / 2, F_MSY = r / 2, MSY = r K / 4 and the terminal ratios to them."""
    rr, kk = F.col(r), F.col(k)
    out = stocks.withColumns({"b_msy": kk / 2, "f_msy": rr / 2, "msy": rr * kk / 4})
    return out.withColumn("b_ratio", F.col(biomass) / F.col("b_msy")).withColumn("f_ratio", F.try_divide(F.col(catch) / F.col(biomass), F.col("f_msy")))


#: Centres and sds of the soft priors on log r, log K and log q of the deterministic fit.
SOFT_PRIORS = ((math.log(0.34), 0.5), (math.log(950.0), 0.75), (math.log(1e-3), 1.0))


def deterministic_objective(x: np.ndarray, catch: np.ndarray, index: np.ndarray, *, start: float = 0.82, index_sd: float = 0.1, priors: tuple[tuple[float, float], ...] = SOFT_PRIORS) -> float:
    """Negative log density of log r, log K, log q: lognormal index errors around B' = B + r B (1 - B / K) - catch
    from a given share of K, and normal soft priors; biomass has a floor of a millionth of K."""
    r, k, q = np.exp(x)
    b, out = start * k, 0.0
    for c, i in zip(catch, index, strict=True):
        out += 0.5 * ((math.log(i) - math.log(q * b)) / index_sd) ** 2
        b = max(1e-6 * k, b + r * b * (1 - b / k) - c)
    return out + sum(0.5 * ((v - m) / s) ** 2 for v, (m, s) in zip(x, priors, strict=True))


def fit_deterministic(rows: DataFrame, series: str, year: str, catch: str, index: str) -> DataFrame:
    """(series, r, k, q, objective, converged) of each series; a series is a group of a grouped map. Years without
    a positive index or with a null are left out of the data but an empty series is not."""
    kind = dict(rows.dtypes)[series]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf.dropna().sort_values(year)
        some = some[some[index] > 0]
        c, i = some[catch].to_numpy(float), some[index].to_numpy(float)
        f = lambda x: deterministic_objective(x, c, i)
        got = lbfgs(lambda x: (f(x), finite_gradient(f, x)), np.array([m for m, _ in SOFT_PRIORS]), tol=1e-3, most=200)
        return pd.DataFrame({series: [pdf[series].iloc[0]], **dict(zip("rkq", np.exp(got.x)[:, None].tolist(), strict=True)), "objective": [got.value], "converged": [got.converged]})

    return rows.select(series, year, catch, index).groupBy(series).applyInPandas(run, f"{series} {kind}, r double, k double, q double, objective double, converged boolean")
