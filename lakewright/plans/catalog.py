"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can say the same.

Doubles are rounded on both sides, as sums run in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import biology, distributions, special, text, transforms
from lakewright.operators import aggregates, graph, joins, matrix, sets, validation, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG_2PI = math.log(2 * math.pi)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN and infinity as null."""
    return df.select(*[(F.round(F.when(special.finite(F.col(c)), F.col(c)), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- Laplace on grouped data: with a normal model the approximation is exact and has a closed form

MU, SIGMA, TAU = 11.5, 0.8, 0.3


def random_intercept(spark: SparkSession, sf: str):
    from lakewright.plans import expr as X
    from lakewright.plans.laplace import GroupedLaplace

    rows = table(spark, sf, "orders").select("o_custkey", F.ln("o_totalprice").alias("y"))
    u, mu = X.random("u"), X.param("mu")
    return GroupedLaplace(rows, "o_custkey", X.normal_nll(X.data("y"), mu + u, X.param("log_sigma")), X.normal_nll(u, 0.0, X.param("log_tau")), ["mu", "log_sigma", "log_tau"])


_GROUPS = f"""WITH g AS (SELECT o_custkey, count(*)::DOUBLE n, sum(ln(o_totalprice) - {MU}) s, sum((ln(o_totalprice) - {MU}) ** 2) ss FROM orders GROUP BY o_custkey),
m AS (SELECT *, s / {SIGMA**2} / (n / {SIGMA**2} + 1 / {TAU**2}) u, n / {SIGMA**2} + 1 / {TAU**2} h FROM g)"""


@query(
    "laplace_random_intercept",
    _GROUPS
    + f""" SELECT count(*) AS n_groups, round(sum(n * ({0.5 * LOG_2PI} + ln({SIGMA})) + (ss - 2 * u * s + n * u * u) / (2 * {SIGMA**2}) + {0.5 * LOG_2PI} + ln({TAU}) + u * u / (2 * {TAU**2}) + 0.5 * ln(h) - {0.5 * LOG_2PI}), 3) AS objective FROM m""",
)
def laplace_random_intercept(spark, sf):
    """Marginal negative log likelihood of a random-intercept model by the expression engine; the oracle is the closed form."""
    model = random_intercept(spark, sf)
    value, _ = model.evaluate(np.array([MU, math.log(SIGMA), math.log(TAU)]), gradient=False)
    groups = model.obs.select("__g").distinct().count()
    model.close()
    return spark.createDataFrame([(groups, round(value, 3))], "n_groups long, objective double")


def poisson_intercept(spark: SparkSession, sf: str):
    """Lines of each order as Poisson counts with a random intercept per customer: a model whose modes take Newton's steps."""
    from lakewright.plans import expr as X
    from lakewright.plans.laplace import GroupedLaplace

    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("y"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").select("o_custkey", "y")
    u, mu = X.random("u"), X.param("mu")
    return GroupedLaplace(rows, "o_custkey", X.exp(mu + u) - X.data("y") * (mu + u), X.normal_nll(u, 0.0, X.param("log_tau")), ["mu", "log_tau"])


_POISSON = f"""WITH RECURSIVE g AS (SELECT o_custkey, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM orders JOIN (SELECT l_orderkey, count(*) AS y FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1),
w AS (SELECT o_custkey, n, s, 0 AS k, 0.0::DOUBLE AS u FROM g UNION ALL SELECT o_custkey, n, s, k + 1, u - (n * exp(0.8 + u) - s + u / {TAU**2}) / (n * exp(0.8 + u) + 1 / {TAU**2}) FROM w WHERE k < 40),
m AS (SELECT *, n * exp(0.8 + u) + 1 / {TAU**2} AS h FROM w WHERE k = 40)"""


@query("poisson_intercept_mode", _POISSON + " SELECT o_custkey, round(u, 7) AS u, round(1 / h, 7) AS conditional_variance FROM m")
def poisson_intercept_mode(spark, sf):
    """Modes by damped Newton steps; the oracle takes forty plain ones."""
    model = poisson_intercept(spark, sf)
    s = model.mode_sensitivity(np.array([0.8, math.log(TAU)]))
    return rounded(s.select("o_custkey", "u", "conditional_variance"), 7)


@query(
    "laplace_poisson",
    _POISSON
    + f""" SELECT round(sum(n * exp(0.8 + u) - s * (0.8 + u) + {0.5 * LOG_2PI} + ln({TAU}) + u * u / (2 * {TAU**2}) + 0.5 * ln(h) - {0.5 * LOG_2PI}), 3) AS objective,
round(sum(n * exp(0.8 + u) - s + 0.5 * (n * exp(0.8 + u) - n * exp(0.8 + u) * n * exp(0.8 + u) / h) / h), 3) AS d_mu, round(sum(1 - u * u / {TAU**2} + 0.5 * (-2 / {TAU**2} + n * exp(0.8 + u) * (2 * u / {TAU**2}) / h) / h), 3) AS d_log_tau FROM m""",
)
def laplace_poisson(spark, sf):
    """Value and exact marginal gradient of a model that is not quadratic; the oracle differentiates by hand."""
    model = poisson_intercept(spark, sf)
    value, g = model.evaluate(np.array([0.8, math.log(TAU)]))
    model.close()
    return spark.createDataFrame([tuple(round(float(x), 3) for x in (value, *g))], "objective double, d_mu double, d_log_tau double")


@query("random_intercept_mode", _GROUPS + " SELECT o_custkey, round(u, 8) AS u, round(1 / h, 8) AS conditional_variance FROM m")
def random_intercept_mode(spark, sf):
    """Modes and conditional variances by the expression engine's Newton steps."""
    model = random_intercept(spark, sf)
    s = model.mode_sensitivity(np.array([MU, math.log(SIGMA), math.log(TAU)]))
    return rounded(s.select("o_custkey", "u", "conditional_variance"), 8)


@query(
    "laplace_gradient",
    _GROUPS
    + f""", p AS (SELECT *, n * {TAU**2} + {SIGMA**2} v FROM m)
SELECT round(sum(-s / v), 3) AS d_mu, round(sum(n - 1 + {SIGMA**2} / v - (ss - s * s / n) / {SIGMA**2} - s * s * {SIGMA**2} / (n * v * v)), 3) AS d_log_sigma, round(sum(n * {TAU**2} / v - s * s * {TAU**2} / (v * v)), 3) AS d_log_tau FROM p""",
)
def laplace_gradient(spark, sf):
    """Exact marginal gradient by symbolic derivatives; the oracle is the closed form of the normal model."""
    _, g = random_intercept(spark, sf).evaluate(np.array([MU, math.log(SIGMA), math.log(TAU)]))
    return spark.createDataFrame([tuple(round(float(x), 3) for x in g)], "d_mu double, d_log_sigma double, d_log_tau double")


# ---- residual summaries

_PREDICTED = "SELECT l_returnflag, l_linestatus, l_shipdate, p_brand, ln(l_extendedprice) - ln(l_quantity * p_retailprice) AS error, (ln(l_extendedprice) - ln(l_quantity * p_retailprice)) / 0.2 AS residual FROM lineitem JOIN part ON l_partkey = p_partkey"


def residual_rows(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    e = F.ln("l_extendedprice") - F.ln(F.col("l_quantity") * F.col("p_retailprice"))
    return rows.select("l_returnflag", "l_linestatus", "l_shipdate", "p_brand", e.alias("error"), (e / 0.2).alias("residual"))


_SUMMARY = "count(*) AS n, round(avg(residual), 6) AS mean_residual, round(stddev_samp(residual), 6) AS sdnr, round(sqrt(avg(error * error)), 6) AS rmse"


@query("residual_summary", f"SELECT p_brand, l_returnflag, {_SUMMARY} FROM ({_PREDICTED}) GROUP BY ALL")
def residual_summary(spark, sf):
    return rounded(aggregates.residual_summary(residual_rows(spark, sf), ["p_brand", "l_returnflag"]))


@query(
    "residual_strata",
    f"""SELECT p_brand, CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'ship_year' END AS stratum,
CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag WHEN grouping(l_linestatus) = 0 THEN l_linestatus ELSE ship_year::VARCHAR END AS level, {_SUMMARY}
FROM (SELECT *, year(l_shipdate) AS ship_year FROM ({_PREDICTED})) GROUP BY GROUPING SETS ((p_brand, l_returnflag), (p_brand, l_linestatus), (p_brand, ship_year))""",
)
def residual_strata(spark, sf):
    rows = residual_rows(spark, sf).withColumn("ship_year", F.year("l_shipdate"))
    return rounded(aggregates.residual_strata(rows, ["p_brand"], ["l_returnflag", "l_linestatus", "ship_year"]))


@query(
    "component_shares",
    """WITH c AS (SELECT l_shipmode AS component, 0 AS nll, 0 AS units FROM (SELECT 1 AS l_shipmode) WHERE false UNION ALL
SELECT l_returnflag, sum(0.5 * (l_discount - 0.05) ** 2 / 0.0004), count(*) FILTER (l_discount > 0) FROM lineitem GROUP BY 1)
SELECT component, round(nll, 4) AS nll, units, round(abs(nll) / sum(abs(nll)) OVER (), 6) AS share, round(nll / units, 6) AS nll_per_unit FROM c""".replace("SELECT l_shipmode AS component, 0 AS nll, 0 AS units FROM (SELECT 1 AS l_shipmode) WHERE false UNION ALL\nSELECT l_returnflag, sum(0.5 * (l_discount - 0.05) ** 2 / 0.0004), count(*) FILTER (l_discount > 0)", "SELECT l_returnflag AS component, sum(0.5 * (l_discount - 0.05) ** 2 / 0.0004) AS nll, count(*) FILTER (l_discount > 0) AS units"),
)
def component_shares(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("component"), "l_discount", (0.5 * (F.col("l_discount") - 0.05) ** 2 / 0.0004).alias("nll"))
    out = aggregates.component_shares(rows, "component", "nll", "l_discount")
    return out.select("component", F.round("nll", 4).alias("nll"), "units", F.round("share", 6).alias("share"), F.round("nll_per_unit", 6).alias("nll_per_unit"))


@query(
    "projection_envelope",
    """SELECT o_orderpriority AS scenario, year(o_orderdate)::INTEGER AS year, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5) + 1e-7, 3) AS median, round(quantile_cont(o_totalprice, 0.025) + 1e-7, 3) AS lwr_95,
round(quantile_cont(o_totalprice, 0.975) + 1e-7, 3) AS upr_95, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS se, count(*) AS n_samples FROM orders GROUP BY 1, 2""",
)
def projection_envelope(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario"), F.year("o_orderdate").alias("year"), "o_totalprice")
    out = aggregates.envelope(rows, ["scenario", "year"], "o_totalprice")
    return out.select("scenario", "year", F.round("mean", 4).alias("mean"), *[F.round(F.col(c) + 1e-7, 3).alias(c) for c in ("median", "lwr_95", "upr_95")], F.round("se", 4).alias("se"), "n_samples")


@query(
    "latent_summary",
    """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 5) AS mean, round(stddev_pop(c_acctbal), 5) AS sd, min(c_acctbal) AS min, arg_min(c_custkey, (c_acctbal, c_custkey)) AS argmin, max(c_acctbal) AS max, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS argmax, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS l2 FROM customer GROUP BY 1""",
)
def latent_summary(spark, sf):
    out = aggregates.latent_summary(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey")
    return out.select("c_mktsegment", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), "min", "argmin", "max", "argmax", F.round("l2", 4).alias("l2"))


@query(
    "bias_summary",
    """WITH b AS (SELECT l_returnflag, l_discount - 0.05 AS bias, l_quantity / 50 AS depletion FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(bias), 6) AS mean_bias, round(quantile_cont(bias, 0.5), 6) AS median_bias, round(quantile_cont(bias, 0.1), 6) AS p10, round(quantile_cont(bias, 0.9), 6) AS p90, round(avg((depletion < 0.2)::INTEGER), 6) AS low_rate FROM b GROUP BY 1""",
)
def bias_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.05).alias("bias"), (F.col("l_quantity") / 50).alias("depletion"))
    return rounded(aggregates.bias_summary(rows, ["l_returnflag"], "bias", "depletion"))


@query(
    "gradient_volatility",
    """WITH g AS (SELECT o_custkey AS sample, o_orderpriority AS component, sum(o_totalprice - 150000) / 1000 AS gradient FROM orders GROUP BY ALL), b AS (SELECT *, avg(gradient) OVER (PARTITION BY component) AS baseline FROM g)
SELECT component, round(stddev_samp(gradient), 5) AS sd, count(*) FILTER (sign(gradient) * sign(baseline) < 0) AS sign_flips FROM b GROUP BY 1""",
)
def gradient_volatility(spark, sf):
    from pyspark.sql import Window

    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("component")).agg((F.sum(F.col("o_totalprice") - 150000) / 1000).alias("gradient"))
    g = g.withColumn("baseline", F.avg("gradient").over(Window.partitionBy("component")))
    return rounded(aggregates.gradient_volatility(g, "sample", "component", "gradient", "baseline")[1], 5)


@query(
    "gradient_norms",
    """WITH g AS (SELECT o_custkey AS sample, sqrt(sum(o_totalprice ** 2)) / 1000 AS norm FROM orders GROUP BY 1)
SELECT count(*) AS n, round(avg(norm), 5) AS mean_norm, round(stddev_samp(norm), 5) AS sd_norm, round(stddev_samp(norm) / avg(norm), 6) AS cv_norm, round(max(norm), 5) AS max_norm FROM g""",
)
def gradient_norms(spark, sf):
    g = table(spark, sf, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("component"), (F.col("o_totalprice") / 1000).alias("gradient"), F.lit(1.0).alias("baseline"))
    out = aggregates.gradient_volatility(g, "sample", "component", "gradient", "baseline")[0]
    return out.select("n", F.round("mean_norm", 5).alias("mean_norm"), F.round("sd_norm", 5).alias("sd_norm"), F.round("cv_norm", 6).alias("cv_norm"), F.round("max_norm", 5).alias("max_norm"))


@query("gradient_argmax", "SELECT p_brand, arg_min(p_name, (-abs(p_retailprice - 1400), p_partkey)) AS p_name, round(max(abs(p_retailprice - 1400)), 6) AS max_abs FROM part GROUP BY 1")
def gradient_argmax(spark, sf):
    rows = table(spark, sf, "part").withColumn("g", F.col("p_retailprice") - 1400)
    return rounded(aggregates.first_argmax(rows, ["p_brand"], "p_name", "p_partkey", "g"))


@query(
    "parameter_displacement",
    "SELECT s_suppkey, round(s_acctbal / 400, 6) AS value, round(s_acctbal / 400 - s_nationkey, 6) AS displacement, (abs(s_acctbal / 400) > 20 OR abs(s_acctbal / 400 - s_nationkey) > 8) AS extreme FROM supplier",
)
def parameter_displacement(spark, sf):
    v = F.col("s_acctbal") / 400
    return rounded(table(spark, sf, "supplier").select("s_suppkey", v.alias("value"), *[c.alias(n) for n, c in aggregates.parameter_displacement(v, F.col("s_nationkey")).items()]))


@query(
    "profiled_log_q",
    """SELECT p_brand, round((sum((ln(l_extendedprice) - ln(l_quantity * p_retailprice)) / (0.1 + l_tax) ** 2) + 0.5 * count(*)) / sum(1 / (0.1 + l_tax) ** 2), 6) AS log_q, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1""",
)
def profiled_log_q(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    rows = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("p_brand", F.ln(F.col("l_quantity") * F.col("p_retailprice")).alias("base"), "l_extendedprice", (0.1 + F.col("l_tax")).alias("se"), (F.col("l_returnflag") != "R").alias("use"))
    return rounded(aggregates.profiled_log_q(rows, ["p_brand"], "base", "l_extendedprice", "se", "use", True)).filter("n > 0")


@query(
    "cold_warm",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) k, count(*) OVER (PARTITION BY event_type) n FROM events)
SELECT event_type, round(max(value) FILTER (k = 1), 6) AS cold, round(avg(value) FILTER (k > n // 2), 6) AS warm, count(*) AS runs FROM r GROUP BY 1""",
)
def cold_warm(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.struct("ts", "event_id").alias("at"), "value")
    return rounded(aggregates.cold_warm(rows, ["event_type"], "at", "value").select("event_type", "cold", "warm", "runs"))


@query(
    "growth_summary",
    "WITH p AS (SELECT p_brand, p_size, avg(p_retailprice) AS y FROM part GROUP BY 1, 2) SELECT p_brand, count(*) AS n, min(p_size) AS x0, max(p_size) AS x1, round(arg_min(y, p_size), 6) AS y0, round(arg_max(y, p_size), 6) AS y1, round(arg_max(y, p_size) / arg_min(y, p_size), 6) AS ratio FROM p GROUP BY 1 HAVING count(*) >= 2",
)
def growth_summary(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("y"))
    return rounded(aggregates.growth(rows, ["p_brand"], "p_size", "y"))


@query(
    "reuse_ratio",
    "SELECT p_size, round(avg(p_retailprice), 6) AS fresh, round(avg(p_retailprice / (1 + p_size)), 6) AS reuse, min(p_partkey) AS nnz, round(avg(p_retailprice) / avg(p_retailprice / (1 + p_size)), 6) AS ratio, round(100 * (1 - avg(p_retailprice / (1 + p_size)) / avg(p_retailprice)), 6) AS improvement_pct FROM part GROUP BY 1",
)
def reuse_ratio(spark, sf):
    rows = table(spark, sf, "part").withColumn("reuse", F.col("p_retailprice") / (1 + F.col("p_size")))
    return rounded(aggregates.reuse_ratio(rows, "p_size", "p_retailprice", "reuse", "p_partkey"))


@query("mean_pattern", "SELECT o_orderpriority, quarter(o_orderdate)::INTEGER AS season, round(avg(o_totalprice), 4) AS mean FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 GROUP BY 1, 2")
def mean_pattern(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", F.quarter("o_orderdate").alias("season"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return rounded(aggregates.mean_pattern(rows, ["o_orderpriority", "season"], "year", "o_totalprice", 1994, 1996), 4)


@query("weighted_components", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS weighted, round(sum(l_extendedprice), 2) AS raw FROM lineitem GROUP BY 1")
def weighted_components(spark, sf):
    return rounded(aggregates.weighted_components(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "l_discount"), 2)


@query(
    "derived_series",
    """WITH y AS (SELECT o_orderpriority, year(o_orderdate)::INTEGER AS year, avg(ln(o_totalprice)) AS u, count(*)::DOUBLE AS catch FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, year, round(exp(u), 4) AS biomass, round(exp(u) * exp(-2.0), 4) AS index_fit, round(exp(u) / first_value(exp(u)) OVER (PARTITION BY o_orderpriority ORDER BY year), 6) AS depletion, round(catch / exp(u), 6) AS fishing_rate FROM y""",
)
def derived_series(spark, sf):
    y = table(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.avg(F.ln("o_totalprice")).alias("u"), F.count("*").cast("double").alias("catch"))
    out = aggregates.derived_series(y, ["o_orderpriority"], "year", "u", "catch", -2.0)
    return out.select("o_orderpriority", "year", F.round("biomass", 4).alias("biomass"), F.round("index_fit", 4).alias("index_fit"), F.round("depletion", 6).alias("depletion"), F.round("fishing_rate", 6).alias("fishing_rate"))


# ---- chains and series from events

_CHAINS = "SELECT event_type AS parameter, user_id % 4 AS chain, ts, event_id, value FROM events"


def chains(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("parameter"), (F.col("user_id") % 4).alias("chain"), "ts", "event_id", "value")


_SPLIT = f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY parameter, chain ORDER BY ts, event_id) k, count(*) OVER (PARTITION BY parameter, chain) n FROM ({_CHAINS})),
h AS (SELECT *, min(n // 2) OVER (PARTITION BY parameter) half FROM k),
s AS (SELECT parameter, chain || '/' || CASE WHEN k <= half THEN '1' ELSE '2' END AS split, (CASE WHEN k <= half THEN k ELSE k - n + half END)::BIGINT AS draw, value FROM h WHERE k <= half OR k > n - half)"""


@query("split_chains", _SPLIT + " SELECT parameter, split, draw, value FROM s")
def split_chains(spark, sf):
    return windows.split_chains(chains(spark, sf), ["parameter"], "chain", ["ts", "event_id"]).select("parameter", "split", "draw", "value")


_RHAT = """, c AS (SELECT parameter, split, avg({v}) m, var_samp({v}) v, count(*) n FROM {t} GROUP BY 1, 2),
b AS (SELECT parameter, avg(v) w, var_samp(m) b, min(n) n FROM c GROUP BY 1) """


@query("split_rhat", _SPLIT + _RHAT.format(v="value", t="s") + "SELECT parameter, round(sqrt(((n - 1) / n::DOUBLE * w + b) / w), 8) AS rhat FROM b")
def split_rhat(spark, sf):
    split = windows.split_chains(chains(spark, sf), ["parameter"], "chain", ["ts", "event_id"])
    return rounded(windows.split_rhat(split, ["parameter"], "value"), 8)


def _inverse_normal_sql(p: str) -> str:
    def poly(x: str, c: tuple[float, ...]) -> str:
        out = repr(float(c[0]))
        for v in c[1:]:
            out = f"({out} * {x} + {float(v)!r})"
        return out

    def tail(q: str) -> str:
        t = f"sqrt(-2 * ln({q}))"
        return f"({poly(t, special.ACKLAM_C)} / {poly(t, (*special.ACKLAM_D, 1.0))})"

    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    low = special.ACKLAM_LOW
    return f"(CASE WHEN {p} < {low} THEN {tail(p)} WHEN {p} <= {1 - low} THEN {poly(r, special.ACKLAM_A)} * {q} / {poly(r, (*special.ACKLAM_B, 1.0))} ELSE -{tail(f'(1 - {p})')} END)"


_RANKED = f"""r AS (SELECT *, rank() OVER (PARTITION BY parameter ORDER BY value) + (count(*) OVER (PARTITION BY parameter, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY parameter) AS total FROM {{t}}),
p AS (SELECT *, (rk - 0.375::DOUBLE) / (total + 0.25::DOUBLE) AS pr FROM r), z AS (SELECT *, {_inverse_normal_sql("pr")} AS z FROM p)"""


@query("rank_normalize", "WITH " + _RANKED.format(t=f"({_CHAINS})") + " SELECT parameter, event_id, round(z, 7) AS z FROM z")
def rank_normalize(spark, sf):
    return rounded(windows.rank_normalize(chains(spark, sf), ["parameter"], "value").select("parameter", "event_id", "z"), 7)


@query("rank_rhat", _SPLIT + ", " + _RANKED.format(t="s") + _RHAT.format(v="z", t="z") + "SELECT parameter, round(sqrt(((n - 1) / n::DOUBLE * w + b) / w), 7) AS rhat FROM b")
def rank_rhat(spark, sf):
    split = windows.split_chains(chains(spark, sf), ["parameter"], "chain", ["ts", "event_id"])
    return rounded(windows.split_rhat(windows.rank_normalize(split, ["parameter"], "value"), ["parameter"], "z"), 7)


_ESS = """, d AS (SELECT *, value - avg(value) OVER (PARTITION BY parameter, split) AS e FROM s),
v AS (SELECT parameter, avg(w) w, var_samp(m) b, min(n) n, count(*) chains FROM (SELECT parameter, split, var_samp(value) w, avg(value) m, count(*) n FROM s GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT a.parameter, a.split, b.draw - a.draw AS lag, sum(a.e * b.e) AS c FROM d a JOIN d b ON a.parameter = b.parameter AND a.split = b.split AND b.draw > a.draw GROUP BY 1, 2, 3),
r AS (SELECT l.parameter, l.lag, 1 - (any_value(w) - avg(c / (n - lag))) / ((any_value(n) - 1) / any_value(n)::DOUBLE * any_value(w) + any_value(b)) AS rho FROM l JOIN v USING (parameter) GROUP BY 1, 2),
q AS (SELECT parameter, (lag - 1) // 2 AS pair, sum(rho) p FROM r GROUP BY 1, 2 HAVING count(*) = 2),
o AS (SELECT *, max((p < 0)::INTEGER) OVER w AS ended, min(p) OVER w AS fall FROM q WINDOW w AS (PARTITION BY parameter ORDER BY pair ROWS UNBOUNDED PRECEDING))
SELECT v.parameter, round(n * chains / (1 + 2 * coalesce(sum(fall) FILTER (ended = 0), 0)), 4) AS ess FROM v LEFT JOIN o USING (parameter) GROUP BY v.parameter, n, chains"""


@query("ess", _SPLIT + _ESS)
def ess(spark, sf):
    split = windows.split_chains(chains(spark, sf), ["parameter"], "chain", ["ts", "event_id"])
    return rounded(windows.effective_sample_size(split, ["parameter"], "value"), 4)


def _ess_sql(p: str, t: str, v: str) -> str:
    """CTEs after which ``{p}ess`` has the effective sample size of column v of t (parameter, split, draw)."""
    return f""", {p}d AS (SELECT *, {v} - avg({v}) OVER (PARTITION BY parameter, split) AS e FROM {t}),
{p}v AS (SELECT parameter, avg(w) w, var_samp(m) b, min(n) n, count(*) chains FROM (SELECT parameter, split, var_samp({v}) w, avg({v}) m, count(*) n FROM {t} GROUP BY 1, 2) GROUP BY 1),
{p}l AS (SELECT a.parameter, a.split, b.draw - a.draw AS lag, sum(a.e * b.e) AS c FROM {p}d a JOIN {p}d b ON a.parameter = b.parameter AND a.split = b.split AND b.draw > a.draw GROUP BY 1, 2, 3),
{p}r AS (SELECT l.parameter, l.lag, 1 - (any_value(w) - avg(c / (n - lag))) / ((any_value(n) - 1) / any_value(n)::DOUBLE * any_value(w) + any_value(b)) AS rho FROM {p}l l JOIN {p}v v ON l.parameter = v.parameter GROUP BY 1, 2),
{p}q AS (SELECT parameter, (lag - 1) // 2 AS pair, sum(rho) p FROM {p}r GROUP BY 1, 2 HAVING count(*) = 2),
{p}o AS (SELECT *, max((p < 0)::INTEGER) OVER w AS ended, min(p) OVER w AS fall FROM {p}q WINDOW w AS (PARTITION BY parameter ORDER BY pair ROWS UNBOUNDED PRECEDING)),
{p}ess AS (SELECT v.parameter, n * chains / (1 + 2 * coalesce(sum(fall) FILTER (ended = 0), 0)) AS ess FROM {p}v v LEFT JOIN {p}o o ON v.parameter = o.parameter GROUP BY v.parameter, n, chains)"""


def _rank_rhat_sql(p: str, t: str, v: str) -> str:
    """CTEs after which ``{p}z`` has normal scores z of column v of t and ``{p}rhat`` their R-hat."""
    return f""", {p}k AS (SELECT *, rank() OVER (PARTITION BY parameter ORDER BY {v}) + (count(*) OVER (PARTITION BY parameter, {v}) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY parameter) AS total FROM {t}),
{p}p AS (SELECT *, (rk - 0.375::DOUBLE) / (total + 0.25::DOUBLE) AS pr FROM {p}k), {p}z AS (SELECT *, {_inverse_normal_sql("pr")} AS z FROM {p}p),
{p}rhat AS (SELECT parameter, sqrt(((n - 1) / n::DOUBLE * w + b) / w) AS rhat FROM (SELECT parameter, avg(v) w, var_samp(m) b, min(n) n FROM (SELECT parameter, split, avg(z) m, var_samp(z) v, count(*) n FROM {p}z GROUP BY 1, 2) GROUP BY 1))"""


_DIAGNOSTICS = (
    _SPLIT
    + ", mid AS (SELECT parameter, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM s GROUP BY 1), x AS (SELECT s.*, abs(value - med) AS folded, (value <= lo)::DOUBLE AS low, (value >= hi)::DOUBLE AS high FROM s JOIN mid USING (parameter))"
    + _rank_rhat_sql("a", "x", "value")
    + _rank_rhat_sql("f", "x", "folded")
    + _ess_sql("b", "az", "z")
    + _ess_sql("c", "x", "low")
    + _ess_sql("e", "x", "high")
    + ", diagnostics AS (SELECT arhat.parameter, greatest(arhat.rhat, frhat.rhat) AS rhat, bess.ess AS bulk_ess, least(cess.ess, eess.ess) AS tail_ess FROM arhat JOIN frhat USING (parameter) JOIN bess USING (parameter) JOIN cess USING (parameter) JOIN eess USING (parameter))"
)


@query("chain_diagnostics", _DIAGNOSTICS + " SELECT parameter, round(rhat, 4) AS rhat, round(bulk_ess, 4) AS bulk_ess, round(tail_ess, 4) AS tail_ess FROM diagnostics")
def chain_diagnostics(spark, sf):
    return rounded(windows.chain_diagnostics(chains(spark, sf), ["parameter"], "chain", ["ts", "event_id"], "value"), 4)


@query(
    "chain_health",
    _DIAGNOSTICS
    + """, g AS (SELECT parameter, chain, value, value - lag(value) OVER (PARTITION BY parameter, chain ORDER BY ts, event_id) AS d FROM ("""
    + _CHAINS
    + """)), f AS (SELECT parameter, chain, sum(d * d) / (count(*) - 1) / var_pop(value) AS bfmi, count(*) FILTER (value > 400) AS divergences FROM g GROUP BY 1, 2)
SELECT round((SELECT max(rhat) FROM diagnostics), 4) AS max_rhat, round((SELECT min(least(bulk_ess, tail_ess)) FROM diagnostics), 3) AS min_ess, round(min(bfmi), 6) AS min_bfmi, sum(divergences)::BIGINT AS divergences, 0::BIGINT AS depth_hits,
(SELECT max(rhat) FROM diagnostics) <= 1.01 AND (SELECT min(least(bulk_ess, tail_ess)) FROM diagnostics) >= 400 AND min(bfmi) >= 0.3 AND sum(divergences) = 0 AS healthy FROM f""",
)
def chain_health(spark, sf):
    """The verdict on all chains: worst diagnostics, energy fractions, values above 400 as divergences."""
    d = chains(spark, sf)
    worst = windows.chain_diagnostics(d, ["parameter"], "chain", ["ts", "event_id"], "value")
    energy = windows.energy_bfmi(d, ["parameter", "chain"], ["ts", "event_id"], "value")
    odd = d.groupBy("parameter", "chain").agg(F.count_if(F.col("value") > 400).alias("divergences"), F.lit(0).cast("long").alias("depth_hits"))
    out = windows.health(worst, energy.join(odd, ["parameter", "chain"]))
    return out.select(F.round("max_rhat", 4).alias("max_rhat"), F.round("min_ess", 3).alias("min_ess"), F.round("min_bfmi", 6).alias("min_bfmi"), "divergences", "depth_hits", "healthy")


@query(
    "tail_indicators",
    _SPLIT + " , q AS (SELECT parameter, quantile_cont(value, 0.05) q FROM s GROUP BY 1) SELECT parameter, split, draw, (value <= q)::DOUBLE AS tail FROM s JOIN q USING (parameter)",
)
def tail_indicators(spark, sf):
    split = windows.split_chains(chains(spark, sf), ["parameter"], "chain", ["ts", "event_id"])
    return windows.tail_indicators(split, ["parameter"], "value", 0.05, True).select("parameter", "split", "draw", "tail")


@query(
    "energy_bfmi",
    f"WITH d AS (SELECT *, value - lag(value) OVER (PARTITION BY parameter, chain ORDER BY ts, event_id) AS d FROM ({_CHAINS})) SELECT parameter, chain, round(sum(d * d) / (count(*) - 1) / var_pop(value), 6) AS bfmi, count(*) AS n FROM d GROUP BY 1, 2",
)
def energy_bfmi(spark, sf):
    return rounded(windows.energy_bfmi(chains(spark, sf), ["parameter", "chain"], ["ts", "event_id"], "value"))


def _dnorm_sql(x: str, mean: str, sd: float) -> str:
    return f"(-{0.5 * LOG_2PI + math.log(sd)} - 0.5 * (({x}) - ({mean})) ** 2 / {sd * sd})"


@query(
    "ar1_logpdf",
    f"""WITH l AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)
SELECT event_type, round(sum(CASE WHEN k = 1 THEN {_dnorm_sql("value", "40", 30 / (1 - 0.65**2) ** 0.5)} ELSE {_dnorm_sql("value", "40 + 0.65 * (b - 40)", 30.0)} END), 4) AS logpdf, count(*) AS n FROM l GROUP BY 1""",
)
def ar1_logpdf(spark, sf):
    return rounded(windows.ar1_logpdf(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value", 40.0, 0.65, 30.0), 4)


@query("ma1_process", "SELECT event_id, round(x, 6) AS x FROM (SELECT event_id, 1.5 + lead(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) + 0.4 * value AS x FROM events) WHERE x IS NOT NULL")
def ma1_process(spark, sf):
    return rounded(windows.ma1_process(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value", 1.5, 0.4).select("event_id", "x"))


@query("iid_logpdf", f"SELECT event_type, round(sum({_dnorm_sql('value', '40', 30.0)}), 4) AS logpdf FROM events GROUP BY 1")
def iid_logpdf(spark, sf):
    return rounded(windows.iid_logpdf(table(spark, sf, "events"), ["event_type"], "value", 40.0, 30.0), 4)


@query(
    "best_so_far",
    """WITH b AS (SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events)
SELECT user_id, event_id, best, best < coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY event_id), 'infinity'::DOUBLE) AS improved FROM b""",
)
def best_so_far(spark, sf):
    return windows.best_so_far(table(spark, sf, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", "best", "improved")


@query("thin_draws", "SELECT parameter, chain, iteration, value FROM (SELECT event_type AS parameter, user_id % 4 AS chain, event_id AS iteration, value FROM events) WHERE iteration % 5 = 0 ORDER BY chain, iteration LIMIT 300")
def thin_draws(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("parameter"), (F.col("user_id") % 4).alias("chain"), F.col("event_id").alias("iteration"), "value")
    return windows.thin(rows, 5, 300)


@query(
    "until_sentinel",
    "WITH s AS (SELECT *, max((value > 150)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) s FROM events) SELECT user_id, event_id FROM s WHERE s = 0",
)
def until_sentinel(spark, sf):
    return windows.until_sentinel(table(spark, sf, "events"), ["user_id"], "event_id", F.col("value") > 150).select("user_id", "event_id")


@query("sections", "SELECT user_id, event_id, (sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM events")
def section_numbers(spark, sf):
    return windows.sections(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "section")


@query(
    "spawning_ratio",
    """SELECT o_orderpriority, year(o_orderdate)::INTEGER AS year, round((sum(o_totalprice * 0.6) / max(o_custkey)) / (sum(o_totalprice) / max(o_custkey)), 6) AS spr FROM orders GROUP BY 1, 2""",
)
def spawning_ratio(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), (F.col("o_totalprice") * 0.6).alias("f"), F.col("o_totalprice").alias("u"), F.col("o_custkey").alias("r"))
    return rounded(windows.spr(rows, ["o_orderpriority"], "year", "f", "u", "r"))


def _normal_cdf_sql(x: str) -> str:
    t = f"(1 / (1 + {special.NORMAL_P} * abs({x})))"
    b = special.NORMAL_B
    poly = f"({t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]})))))"
    tail = f"({1 / math.sqrt(2 * math.pi)!r} * exp(-0.5 * ({x}) ** 2) * {poly})"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


@query(
    "length_probabilities",
    f"""WITH b AS (SELECT p_partkey, unnest(range(5, 55, 5))::DOUBLE AS edge, p_size::DOUBLE AS mean FROM part), u AS (SELECT *, lead(edge) OVER (PARTITION BY p_partkey ORDER BY edge) AS e FROM b),
c AS (SELECT *, {_normal_cdf_sql("((e - mean) / 6.0)")} AS cdf FROM u)
SELECT p_partkey, edge, round(CASE WHEN e IS NULL THEN 1 ELSE cdf END - coalesce(lag(cdf) OVER (PARTITION BY p_partkey ORDER BY edge), 0), 7) AS p FROM c""",
)
def length_probabilities(spark, sf):
    bins = table(spark, sf, "part").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(5), F.lit(50), F.lit(5)), lambda e: e.cast("double"))).alias("edge"), F.col("p_size").cast("double").alias("mean"))
    out = windows.length_probabilities(bins, ["p_partkey"], "edge", F.col("mean"), F.lit(6.0))
    return rounded(out.select("p_partkey", "edge", "p"), 7)


# ---- matrices from embeddings and orders

_COV = """e AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
cov AS (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS value FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2)"""
_CORR = _COV + ", d AS (SELECT i, value AS v FROM cov WHERE i = j), corr AS (SELECT cov.i, cov.j, CASE WHEN cov.i = cov.j THEN 1.0 ELSE value / sqrt(a.v * b.v) END AS value FROM cov JOIN d a ON cov.i = a.i JOIN d b ON cov.j = b.i)"


def embedding_covariance(spark, sf):
    return matrix.covariance(table(spark, sf, "embeddings"), "embedding")


@query("covariance_coo", f"WITH {_COV} SELECT i, j, round(value, 8) AS value FROM cov")
def covariance_coo(spark, sf):
    return rounded(embedding_covariance(spark, sf), 8)


@query("correlation_coo", f"WITH {_CORR} SELECT i, j, round(value, 6) AS value FROM corr")
def correlation_coo(spark, sf):
    return rounded(matrix.correlation(embedding_covariance(spark, sf)))


@query("correlation_decay", f"WITH {_CORR} SELECT j - i AS lag, count(*) AS count, round(avg(value), 6) AS mean_correlation, round(min(value), 6) AS min_correlation, round(max(value), 6) AS max_correlation FROM corr WHERE j >= i GROUP BY 1")
def correlation_decay(spark, sf):
    return rounded(matrix.decay(matrix.correlation(embedding_covariance(spark, sf))))


_BANDS = """b AS (SELECT j - i AS band_distance, count(*) AS count, count(*) FILTER (abs(value) > 1e-8) AS nonzero_count, avg(abs(value)) AS mean_abs, max(abs(value)) AS max_abs, sum(abs(value)) AS sum_abs FROM cov WHERE j >= i GROUP BY 1),
s AS (SELECT *, sum_abs / sum(sum_abs) OVER () AS share FROM b), c AS (SELECT *, sum(share) OVER (ORDER BY band_distance ROWS UNBOUNDED PRECEDING) AS cum FROM s)"""


@query("band_summary", f"WITH {_COV}, {_BANDS} SELECT band_distance, count, nonzero_count, round(mean_abs, 8) AS mean_abs, round(max_abs, 8) AS max_abs, round(sum_abs, 7) AS sum_abs, round(share, 6) AS share_sum_abs, round(cum, 6) AS cumulative_share_sum_abs FROM c")
def band_summary(spark, sf):
    out = matrix.band_summary(embedding_covariance(spark, sf))
    return out.select("band_distance", "count", "nonzero_count", *[F.round(c, n).alias(c) for c, n in (("mean_abs", 8), ("max_abs", 8), ("sum_abs", 7), ("share_sum_abs", 6), ("cumulative_share_sum_abs", 6))])


_TARGETS = "t AS (SELECT unnest([0.90, 0.95, 0.99, 0.999, 1.0])::DOUBLE AS target)"


@query(
    "effective_sparsity",
    f"""WITH {_COV}, {_TARGETS}, a AS (SELECT abs(value) AS a, row_number() OVER (ORDER BY abs(value) DESC, i, j) AS k, sum(abs(value)) OVER (ORDER BY abs(value) DESC, i, j ROWS UNBOUNDED PRECEDING) / sum(abs(value)) OVER () AS c FROM cov WHERE abs(value) > 1e-8)
SELECT target, CASE WHEN target >= 1 THEN count(*) ELSE min(k) FILTER (c >= target) END AS entries_required, round(count(*)::DOUBLE / CASE WHEN target >= 1 THEN count(*) ELSE min(k) FILTER (c >= target) END, 6) AS compression FROM a, t GROUP BY target""",
)
def effective_sparsity(spark, sf):
    return rounded(matrix.effective_sparsity(embedding_covariance(spark, sf)))


@query(
    "effective_bandwidth",
    f"WITH {_COV}, {_BANDS}, {_TARGETS}, w AS (SELECT target, CASE WHEN target >= 1 THEN 63 ELSE min(band_distance) FILTER (cum >= target) END::BIGINT AS bandwidth FROM c, t GROUP BY target) SELECT target, bandwidth, 64 * (2 * bandwidth + 1) - bandwidth * (bandwidth + 1) AS entries_if_banded FROM w",
)
def effective_bandwidth(spark, sf):
    return matrix.effective_bandwidth(embedding_covariance(spark, sf), 64)


@query("topk_pairs", f"WITH {_CORR} SELECT i, j, round(value, 6) AS value FROM corr WHERE i < j ORDER BY abs(value) DESC, i, j LIMIT 10")
def topk_pairs(spark, sf):
    return rounded(matrix.top_pairs(embedding_covariance(spark, sf)).select("i", "j", "value"))


@query(
    "correlation_extremes",
    f"""WITH {_CORR} SELECT round((SELECT min(v) FROM d), 8) AS min_variance, (SELECT arg_min(i, (v, i)) FROM d) AS min_index, round((SELECT max(v) FROM d), 8) AS max_variance, (SELECT arg_min(i, (-v, i)) FROM d) AS max_index, round(max(abs(value)), 6) AS max_abs_correlation,
arg_max(i, abs(value)) AS pair_i, arg_max(j, abs(value)) AS pair_j, count(*) FILTER (abs(value) > 0.5) AS above_5, count(*) FILTER (abs(value) > 0.8) AS above_8, count(*) FILTER (abs(value) > 0.9) AS above_9 FROM corr WHERE i < j""",
)
def correlation_extremes(spark, sf):
    out = matrix.correlation_extremes(embedding_covariance(spark, sf))
    return out.select(F.round("min_variance", 8).alias("min_variance"), "min_index", F.round("max_variance", 8).alias("max_variance"), "max_index", F.round("max_abs_correlation", 6).alias("max_abs_correlation"), "pair_i", "pair_j", "above_5", "above_8", "above_9")


_EDGES = ", g AS (SELECT i, j FROM corr WHERE i <> j AND abs(value) >= 0.12)"


@query("corr_graph_degree", f"WITH {_CORR}{_EDGES} SELECT d.i, count(g.j) AS degree FROM d LEFT JOIN g ON d.i = g.i GROUP BY 1")
def corr_graph_degree(spark, sf):
    corr = matrix.correlation(embedding_covariance(spark, sf))
    return graph.degrees(corr.filter("i = j").select("i"), graph.edges(corr, 0.12))


@query(
    "corr_graph_components",
    f"WITH RECURSIVE {_CORR}{_EDGES}, r AS (SELECT i, i AS c FROM d UNION SELECT g.j, r.c FROM r JOIN g ON r.i = g.i) SELECT i, min(c) AS component FROM r GROUP BY 1",
)
def corr_graph_components(spark, sf):
    corr = matrix.correlation(embedding_covariance(spark, sf)).cache()
    return graph.components(corr.filter("i = j").select("i"), graph.edges(corr, 0.12))


@query("lognormal_covariance", f"WITH {_COV}, m AS (SELECT i, avg(x) AS x FROM e GROUP BY 1) SELECT cov.i, cov.j, round(value * exp(a.x) * exp(b.x), 8) AS value FROM cov JOIN m a ON cov.i = a.i JOIN m b ON cov.j = b.i")
def lognormal_covariance(spark, sf):
    means = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("value"))
    return rounded(matrix.lognormal_covariance(embedding_covariance(spark, sf), means), 8)


@query("delta_sandwich", f"WITH {_COV}, jac AS (SELECT k AS i, m AS j, 1.0 / (1 + abs(k - m)) AS value FROM range(3) a(k), range(64) b(m)) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.value * cov.value * b.value), 8) AS value FROM jac a JOIN cov ON a.j = cov.i JOIN jac b ON cov.j = b.j GROUP BY 1, 2")
def delta_sandwich(spark, sf):
    jac = spark.range(3).selectExpr("cast(id as int) i", "explode(sequence(0, 63)) j").withColumn("value", 1.0 / (1 + F.abs(F.col("i") - F.col("j"))))
    return rounded(matrix.sandwich(jac, embedding_covariance(spark, sf)), 8)


@query("trace_product", f"WITH {_COV} SELECT round(sum(a.value * b.value), 8) AS trace FROM cov a JOIN cov b ON a.i = b.j AND a.j = b.i")
def trace_product(spark, sf):
    c = embedding_covariance(spark, sf)
    return rounded(matrix.trace_product(c, c), 8)


@query(
    "parameter_geometry",
    f"WITH {_COV}, n AS (SELECT j, sqrt(sum(value ** 2)) AS norm, max(value) FILTER (i = j) AS diagonal FROM cov GROUP BY 1) SELECT j, round(norm, 8) AS norm, round(diagonal, 8) AS diagonal, round(norm / sum(norm) OVER (), 8) AS share FROM n",
)
def parameter_geometry(spark, sf):
    return rounded(matrix.geometry(embedding_covariance(spark, sf)), 8)


@query(
    "band_limits",
    f"WITH {_COV} SELECT b AS bandwidth, count(*) FILTER (abs(i - j) <= b) AS kept, round(sum(abs(value)) FILTER (abs(i - j) <= b) / sum(abs(value)), 6) AS share, round(sqrt(coalesce(sum(value ** 2) FILTER (abs(i - j) > b), 0) / sum(value ** 2)), 6) AS frobenius_error FROM cov, (SELECT unnest([0, 1, 2, 3, 5, 10, 20]) AS b) GROUP BY 1",
)
def band_limits(spark, sf):
    return rounded(matrix.band_limits(embedding_covariance(spark, sf)))


@query(
    "threshold_limits",
    f"WITH {_COV} SELECT t AS threshold, count(*) FILTER (abs(value) >= t) AS kept, round(coalesce(sum(abs(value)) FILTER (abs(value) >= t), 0) / sum(abs(value)), 6) AS share, round(sqrt(coalesce(sum(value ** 2) FILTER (abs(value) < t), 0) / sum(value ** 2)), 6) AS frobenius_error FROM cov, (SELECT unnest([1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6])::DOUBLE AS t) GROUP BY 1",
)
def threshold_limits(spark, sf):
    return rounded(matrix.threshold_limits(embedding_covariance(spark, sf)))


@query(
    "pattern_summary",
    f"WITH {_COV} SELECT count(*) FILTER (abs(value) > 1e-3) AS nnz, count(*) FILTER (abs(value) > 1e-3 AND i <= j) AS upper_nnz, count(*) FILTER (abs(value) > 1e-3 AND i = j) AS diagonal_nnz, count(*) FILTER (abs(value) > 1e-3 AND i <> j) AS offdiagonal_nnz, round(max(abs(value)), 8) AS max_abs, round(min(abs(value)) FILTER (abs(value) > 1e-3), 8) AS min_nonzero_abs FROM cov",
)
def pattern_summary(spark, sf):
    return rounded(matrix.pattern_summary(embedding_covariance(spark, sf), 1e-3), 8)


_NATION = """m AS (SELECT c_nationkey AS i, s_nationkey AS j, sum(l_extendedprice) / 1000 AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def nation_matrix(spark, sf):
    """Trade between customers' and suppliers' nations."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("i"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("j"))
    met = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return met.groupBy("i", "j").agg((F.sum("l_extendedprice") / 1000).alias("value"))


def nation_counts(spark, sf):
    """Lines between customers' and suppliers' nations."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("i"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("j"))
    return li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").groupBy("i", "j").agg(F.count("*").cast("double").alias("value"))


@query(
    "structure_detect",
    f"""WITH {_NATION}, s AS (SELECT count(*) AS nnz, count(*) FILTER (a.i = a.j) AS diagonal_nnz, max(abs(a.i - a.j))::BIGINT AS bandwidth, max(abs(a.value - coalesce(b.value, 0))) AS asym, bool_and(b.value IS NOT NULL) AS structurally_symmetric FROM m a LEFT JOIN m b ON a.i = b.j AND a.j = b.i WHERE abs(a.value) > 1e-12)
SELECT nnz, diagonal_nnz, bandwidth, (SELECT max(k) FROM (SELECT count(*) AS k FROM m GROUP BY i)) AS max_row_nnz, round(asym, 4) AS max_asymmetry, structurally_symmetric, nnz - diagonal_nnz AS offdiagonal_nnz, round(nnz / 625.0::DOUBLE, 6) AS fill_ratio,
CASE WHEN bandwidth = 0 THEN 'Diagonal' WHEN bandwidth = 1 THEN 'Tridiagonal' WHEN bandwidth <= 64 AND nnz / 625.0 < 0.25 THEN 'Banded' WHEN nnz / 625.0 < 0.25 THEN 'Sparse' ELSE 'Dense' END AS detected,
CASE WHEN asym > 1e-8 THEN 'DenseLDLT' WHEN bandwidth = 0 THEN 'Diagonal' WHEN bandwidth = 1 THEN 'Tridiagonal' WHEN bandwidth <= 64 AND nnz / 625.0 < 0.25 THEN 'Banded' WHEN nnz / 625.0 < 0.25 THEN 'SparseLDLT' ELSE 'DenseLDLT' END AS backend FROM s""",
)
def structure_detect(spark, sf):
    out = matrix.structure(nation_matrix(spark, sf), 25)
    return out.select("nnz", "diagonal_nnz", "bandwidth", "max_row_nnz", F.round("max_asymmetry", 4).alias("max_asymmetry"), "structurally_symmetric", "offdiagonal_nnz", F.round("fill_ratio", 6).alias("fill_ratio"), "detected", "backend")


@query("pivot_matrix", f"WITH {_NATION} SELECT i, " + ", ".join(f"round(max(value) FILTER (j = {k}), 2) AS c{k}" for k in range(25)) + " FROM m GROUP BY i")
def pivot_matrix(spark, sf):
    return rounded(matrix.pivot_wide(nation_matrix(spark, sf), 25), 2)


# ---- joins, sets, validation

@query(
    "asof_override",
    """WITH v AS (SELECT p_partkey AS row_no, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][(p_partkey % 5 + 1)::INTEGER] AS pr, TIMESTAMP '1992-01-01' + INTERVAL (p_partkey * 7) DAY AS since, p_retailprice / 1000 AS weight FROM part)
SELECT o_orderkey, round(coalesce(arg_max(weight, row_no), 1), 6) AS weight FROM orders LEFT JOIN v ON o_orderpriority = pr AND since <= o_orderdate GROUP BY 1""",
)
def asof_override(spark, sf):
    """The weight last set for an order's priority before its date, over all orders and all of part."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    over = table(spark, sf, "part").select(F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("o_orderpriority"), F.expr("timestamp_ntz'1992-01-01' + make_dt_interval(cast(p_partkey * 7 as int))").alias("since"), F.col("p_partkey").alias("row_no"), (F.col("p_retailprice") / 1000).alias("weight"))
    out = joins.last_override(rows, over, ["o_orderpriority"], at="o_orderdate", since="since", order="row_no", value="weight", default=F.lit(1.0))
    return rounded(out.select("o_orderkey", "weight"))


@query(
    "interval_block",
    """WITH b AS (SELECT * FROM (VALUES (1, 1993, 1995, 1, 0.5), (2, 1995, 1996, 0, 0.25), (3, 1997, 1997, 2, 9.0)) t(block, lo, hi, code, adjustment)), r AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) AS y, l_quantity AS q FROM lineitem),
x AS (SELECT *, CASE WHEN y BETWEEN 1993 AND 1995 THEN q + 0.5 ELSE q END AS a FROM r), z AS (SELECT *, CASE WHEN y BETWEEN 1995 AND 1996 THEN a * exp(0.25) ELSE a END AS c FROM x)
SELECT l_orderkey, l_linenumber, round(CASE WHEN y = 1997 THEN 9 ELSE c END, 6) AS adjusted, ((y BETWEEN 1993 AND 1995)::INTEGER + (y BETWEEN 1995 AND 1996)::INTEGER + (y = 1997)::INTEGER) AS n_blocks FROM z""",
)
def interval_block(spark, sf):
    blocks = spark.createDataFrame([(1, 1993, 1995, 1, 0.5), (2, 1995, 1996, 0, 0.25), (3, 1997, 1997, 2, 9.0)], "block int, lo int, hi int, code int, adjustment double")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"), "l_quantity")
    return rounded(joins.interval_blocks(rows, blocks, at="year", base="l_quantity").select("l_orderkey", "l_linenumber", "adjusted", "n_blocks"))


@query(
    "compare_values",
    """WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT k, round(v, 2) AS "left", round(o_totalprice, 2) AS "right", round(v - o_totalprice, 2) AS difference, round((v - o_totalprice) / o_totalprice, 6) AS relative, abs(v - o_totalprice) <= 1000 + 0.1 * abs(o_totalprice) AS within FROM a JOIN orders ON k = o_orderkey""",
)
def compare_values(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    out = joins.compare_values(a, b, ["k"], "v", atol=1000.0, rtol=0.1)
    return out.select("k", F.round("left", 2).alias("left"), F.round("right", 2).alias("right"), F.round("difference", 2).alias("difference"), F.round("relative", 6).alias("relative"), "within")


@query("lookup_missing", "SELECT c_custkey, (SELECT any_value(1) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') IS NULL AS missing FROM customer")
def lookup_missing(spark, sf):
    known = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return joins.lookup(table(spark, sf, "customer").select("c_custkey"), known, ["c_custkey"], "v").select("c_custkey", F.isnan("v").alias("missing"))


@query("update_column", "SELECT c_custkey, round(coalesce(m, c_acctbal), 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def update_column(spark, sf):
    new = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return rounded(joins.update_column(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey", "c_acctbal"), 2)


@query("season_of_month", "SELECT event_id, floor((m - 1) / 3)::INTEGER + 1 AS season, round((m - 1) / 3 - floor((m - 1) / 3), 6) AS time FROM (SELECT event_id, month(ts) + (day(ts) - 1) / 31.0::DOUBLE AS m FROM events)")
def season_of_month(spark, sf):
    m = F.month("ts") + (F.dayofmonth("ts") - 1) / F.lit(31.0)
    got = joins.season_of_month(m)
    return rounded(table(spark, sf, "events").select("event_id", got["season"].alias("season"), got["time"].alias("time")))


@query(
    "mohns_rho",
    """WITH f AS (SELECT year(o_orderdate) AS year, avg(o_totalprice) AS value FROM orders GROUP BY 1), p AS (SELECT year(o_orderdate) AS year, k AS peel, exp(avg(ln(o_totalprice))) AS value FROM orders, range(1, 4) t(k) WHERE year(o_orderdate) <= 1998 - k GROUP BY 1, 2),
l AS (SELECT peel, arg_max(value, year) AS terminal, max(year) AS year FROM p GROUP BY 1) SELECT round(avg((terminal - value) / value), 8) AS rho, count(*) AS n_peels FROM l JOIN f USING (year) WHERE abs(value) > 1e-12""",
)
def mohns_rho(spark, sf):
    """Peels of 1 to 3 years, estimated by geometric means, against the full run's arithmetic means."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    full = o.groupBy("year").agg(F.avg("o_totalprice").alias("value"))
    peels = o.withColumn("peel", F.explode(F.sequence(F.lit(1), F.lit(3)))).filter("year <= 1998 - peel").groupBy("peel", "year").agg(F.exp(F.avg(F.ln("o_totalprice"))).alias("value"))
    return rounded(joins.mohns_rho(full, peels), 8)


@query(
    "union_align",
    "SELECT 'customer' AS engine, c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier",
)
def union_align(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    renames = {"customer": {"c_custkey": "id", "c_name": "name", "c_acctbal": "acctbal"}, "supplier": {"s_suppkey": "id", "s_name": "name", "s_acctbal": "acctbal"}}
    return sets.union_align({"customer": c, "supplier": s}, renames)


@query("unpivot_draws", "SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS parameter, unnest([p_size::DOUBLE, p_retailprice]) AS value FROM part")
def unpivot_draws(spark, sf):
    return sets.unpivot(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("unpivot_arrays", "SELECT vec_id, 'q' || i AS quantity, round(embedding[i + 1]::DOUBLE, 6) AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)")
def unpivot_arrays(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rounded(sets.unpivot_arrays(rows, ["vec_id"], "e", "q"))


@query("summary_metrics", "SELECT unnest(['rows', 'total', 'largest']) AS metric, unnest([count(*)::DOUBLE, round(sum(o_totalprice), 0), max(o_totalprice)]) AS value FROM orders")
def summary_metrics(spark, sf):
    one = table(spark, sf, "orders").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 0).alias("total"), F.max("o_totalprice").alias("largest"))
    return sets.metrics(one, ["rows", "total", "largest"])


@query(
    "detail_and_summary",
    "SELECT 0 AS rank, n_name AS label, n_regionkey::DOUBLE AS value FROM nation UNION ALL SELECT 1, 'mean', avg(n_regionkey) FROM nation",
)
def detail_and_summary(spark, sf):
    n = table(spark, sf, "nation")
    detail = n.select(F.col("n_name").alias("label"), F.col("n_regionkey").cast("double").alias("value"))
    return sets.detail_and_summary(detail, n.agg(F.avg("n_regionkey").alias("value")).withColumn("label", F.lit("mean"))).select("rank", "label", "value")


@query(
    "weight_grid",
    "SELECT l_quantity AS weight, round(max(s) FILTER (f = 1), 6) AS fleet_1, round(max(s) FILTER (f = 2), 6) AS fleet_2, round(max(s) FILTER (f = 3), 6) AS fleet_3 FROM (SELECT l_quantity, l_linenumber AS f, stddev_samp(l_discount) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def weight_grid(spark, sf):
    li = table(spark, sf, "lineitem")
    diag = li.groupBy(F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("fleet")).agg(F.stddev_samp("l_discount").alias("sdnr"))
    return rounded(sets.weight_grid(li.select(F.col("l_quantity").alias("weight")).distinct(), diag, [1, 2, 3], "sdnr"))


@query("validate_fk", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def validate_fk(spark, sf):
    return validation.missing_keys(table(spark, sf, "lineitem"), ["l_partkey"], table(spark, sf, "part").filter("p_size <= 40"), ["p_partkey"])


@query("validate_dup", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def validate_dup(spark, sf):
    return validation.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    "validate_rules",
    "SELECT l_orderkey, l_linenumber, 'discount below 9 %' AS rule FROM lineitem WHERE NOT l_discount < 0.09 UNION ALL SELECT l_orderkey, l_linenumber, 'quantity at least 3' FROM lineitem WHERE NOT l_quantity >= 3",
)
def validate_rules(spark, sf):
    rules = {"discount below 9 %": F.col("l_discount") < 0.09, "quantity at least 3": F.col("l_quantity") >= 3}
    return validation.rule_violations(table(spark, sf, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


@query("sums_to_one", "SELECT s_nationkey, total FROM (SELECT s_nationkey, round(sum(p), 6) AS total FROM (SELECT s_nationkey, s_acctbal / 5000 AS p FROM supplier) GROUP BY 1) WHERE abs(total - 1) > 1e-8")
def sums_to_one(spark, sf):
    rows = table(spark, sf, "supplier").select("s_nationkey", (F.col("s_acctbal") / 5000).alias("p"))
    return rounded(validation.sums_to_one(rows, ["s_nationkey"], "p"))


@query("key_sets_differ", "SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'right' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def key_sets_differ(spark, sf):
    """Numbers that only customers or only suppliers have."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).distinct()
    return validation.key_sets_differ(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).distinct(), ["k"])


@query("peel_years", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders WHERE year(o_orderdate) <= 1995 GROUP BY 1")
def peel_years(spark, sf):
    rows = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    return validation.peel(rows, "year", 1995).groupBy("year").agg(F.count("*").alias("n"))


_SCENARIOS = [("base", 1.0, 1.0), ("high_m", 1.25, 1.0), ("low_effort", 1.0, 0.8)]


@query(
    "sensitivity_scenarios",
    "SELECT name, p_partkey, round(p_size * fs, 6) AS p_size, round(p_retailprice * fp, 6) AS p_retailprice FROM part, (VALUES ('base', 1.0, 1.0), ('high_m', 1.25, 1.0), ('low_effort', 1.0, 0.8)) t(name, fs, fp)".replace("p_size * fs", "p_size * fs::DOUBLE").replace("p_retailprice * fp", "p_retailprice * fp::DOUBLE"),
)
def sensitivity_scenarios(spark, sf):
    s = spark.createDataFrame(_SCENARIOS, "name string, fs double, fp double")
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(validation.apply_scenarios(rows, s, {"p_size": "fs", "p_retailprice": "fp"}))


# ---- scalar functions

@query("normal_logpdf", f"SELECT l_orderkey, l_linenumber, round({_dnorm_sql('l_quantity', '25', 14.0)}, 8) AS logpdf, round({_dnorm_sql('ln(l_quantity)', '3', 0.9)} - ln(l_quantity), 8) AS lognormal FROM lineitem")
def normal_logpdf(spark, sf):
    x = F.col("l_quantity")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", distributions.dnorm(x, 25.0, 14.0).alias("logpdf"), distributions.dlnorm(x, 3.0, 0.9).alias("lognormal")), 8)


@query(
    "count_logpmf",
    """SELECT l_orderkey, l_linenumber, round(x * ln(20) - 20 - lgamma(x + 1), 7) AS poisson, round(lgamma(51) - lgamma(x + 1) - lgamma(51 - x) + x * ln(0.4) + (50 - x) * ln(0.6), 7) AS binomial,
round(lgamma(x + 3) - lgamma(3) - lgamma(x + 1) + 3 * ln(3 / 23.0::DOUBLE) + x * ln(20 / 23.0::DOUBLE), 7) AS nbinom2 FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity) AS x FROM lineitem)""",
)
def count_logpmf(spark, sf):
    x = F.floor("l_quantity").cast("double")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", distributions.dpois(x, 20.0).alias("poisson"), distributions.dbinom(x, 50.0, 0.4).alias("binomial"), distributions.dnbinom2(x, 20.0, 3.0).alias("nbinom2")), 7)


@query(
    "gamma_beta_logpdf",
    "SELECT l_orderkey, l_linenumber, round(2.5 * ln(0.1) - lgamma(2.5) + 1.5 * ln(x) - 0.1 * x, 7) AS gamma, round(lgamma(5) - lgamma(2) - lgamma(3) + ln(y) + 2 * ln(1 - y), 7) AS beta FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, (l_discount + 0.01) / 0.2 AS y FROM lineitem)",
)
def gamma_beta_logpdf(spark, sf):
    y = (F.col("l_discount") + 0.01) / 0.2
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", distributions.dgamma(F.col("l_quantity"), 2.5, 0.1).alias("gamma"), distributions.dbeta(y, 2.0, 3.0).alias("beta")), 7)


_COMPOSITION = "SELECT o_orderkey, [count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'N'), count(*) FILTER (l_returnflag = 'R')] AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"


def composition(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array(*[F.count_if(F.col("l_returnflag") == f) for f in "ANR"]).alias("x"))


def _polya_sql(alpha: tuple[float, float, float]) -> str:
    a = sum(alpha)
    n = "list_sum(x)"
    each = " + ".join(f"lgamma(x[{k + 1}] + {v}) - lgamma({v}) - lgamma(x[{k + 1}] + 1)" for k, v in enumerate(alpha))
    return f"lgamma({n} + 1) + lgamma({a}) - lgamma({n} + {a}) + {each}"


@query(
    "dirichlet_multinomial",
    f"""SELECT l_orderkey AS o_orderkey, round({_polya_sql((2.0, 5.0, 3.0))}, 7) AS dm, round({_polya_sql((0.4, 1.0, 0.6))}, 7) AS linear, round({_polya_sql((2.0, 5.0, 3.0))}, 7) AS robust,
round(lgamma(list_sum(x) + 1) - lgamma(x[1] + 1) - lgamma(x[2] + 1) - lgamma(x[3] + 1) + x[1] * ln(0.2) + x[2] * ln(0.5) + x[3] * ln(0.3), 7) AS multinomial
FROM (SELECT l_orderkey, [count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'N'), count(*) FILTER (l_returnflag = 'R')] AS x FROM lineitem GROUP BY 1)""",
)
def dirichlet_multinomial(spark, sf):
    p, x = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), F.col("x")
    d = distributions
    return rounded(composition(spark, sf).select("o_orderkey", d.ddirichlet_multinomial(x, p, 10.0).alias("dm"), d.ddirichlet_multinomial_linear(x, p, 0.5).alias("linear"), d.ddirichlet_multinomial_robust(x, p, 10.0).alias("robust"), d.dmultinom(x, p).alias("multinomial")), 7)


@query(
    "composition_deviance",
    """WITH c AS (SELECT l_orderkey, [a / n, b / n, c / n] AS o FROM (SELECT l_orderkey, count(*)::DOUBLE AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1))
SELECT l_orderkey AS o_orderkey, round(30 * (CASE WHEN o[1] > 0 THEN o[1] * (ln(o[1]) - ln(0.2)) ELSE 0 END + CASE WHEN o[2] > 0 THEN o[2] * (ln(o[2]) - ln(0.5)) ELSE 0 END + CASE WHEN o[3] > 0 THEN o[3] * (ln(o[3]) - ln(0.3)) ELSE 0 END), 7) AS deviance,
round(-30 * (o[1] * ln(0.2) + o[2] * ln(0.5) + o[3] * ln(0.3)), 7) AS nll FROM c""",
)
def composition_deviance(spark, sf):
    share = F.transform("x", lambda v: v / F.aggregate("x", F.lit(0).cast("bigint"), lambda s, w: s + w))
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    return rounded(composition(spark, sf).withColumn("o", share).select("o_orderkey", distributions.multinomial_deviance(F.col("o"), p, 30.0).alias("deviance"), distributions.age_comp_nll(F.col("o"), p, 30.0).alias("nll")), 7)


@query("special_functions", f"SELECT p_partkey, round(lgamma(p_retailprice / 100), 7) AS lgamma, round({_normal_cdf_sql('((p_size - 25) / 10.0::DOUBLE)')}, 8) AS cdf, round({_inverse_normal_sql('(p_size / 51.0::DOUBLE)')}, 8) AS quantile, round(1 / (1 + exp(-(p_size - 25) / 5.0::DOUBLE)), 8) AS logistic FROM part")
def special_functions(spark, sf):
    size = F.col("p_size").cast("double")
    return rounded(table(spark, sf, "part").select("p_partkey", F.round(special.lgamma(F.col("p_retailprice") / 100), 7).alias("lgamma"), special.normal_cdf((size - 25) / 10.0).alias("cdf"), special.inverse_normal_cdf(size / 51.0).alias("quantile"), special.logistic((size - 25) / 5.0).alias("logistic")), 8)


_T = "['identity', 'log', 'logit', 'square'][(p_partkey % 4 + 1)::INTEGER]"


@query(
    "transform_jacobian",
    f"""WITH x AS (SELECT p_partkey, {_T} AS t, (p_size - 25.5) / 10.0::DOUBLE AS x FROM part)
SELECT p_partkey, t AS transform, round(CASE t WHEN 'identity' THEN x WHEN 'log' THEN exp(x) WHEN 'logit' THEN 1 / (1 + exp(-x)) ELSE x * x END, 8) AS natural, round(CASE t WHEN 'identity' THEN 0 WHEN 'log' THEN x WHEN 'logit' THEN -x - 2 * ln(1 + exp(-x)) ELSE ln(abs(2 * x)) END, 8) AS log_jacobian FROM x""",
)
def transform_jacobian(spark, sf):
    names = F.array(*[F.lit(x) for x in transforms.TRANSFORMS])
    rows = table(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")).alias("transform"), ((F.col("p_size") - 25.5) / 10.0).alias("x"))
    t, x = F.col("transform"), F.col("x")
    return rounded(rows.select("p_partkey", "transform", transforms.apply_transform(x, t).alias("natural"), transforms.log_jacobian(x, t).alias("log_jacobian")), 8)


@query(
    "biology_functions",
    """SELECT p_partkey, round(4 * 0.8 * 1000 * s / (5000 * 0.2 + 3 * s), 6) AS recruits, round(1 / (1 + exp(-ln(19) * (a - 20) / 8)), 8) AS selectivity, round(1e-5 * a ** 3.1, 8) AS weight, round(CASE WHEN z * 0.25 < 1e-5 THEN 0.25 ELSE (1 - exp(-z * 0.25)) / z END, 8) AS exposure, round(greatest(1, s + 0.3 * s * (1 - s / 3000) - a), 6) AS next_biomass
FROM (SELECT p_partkey, p_retailprice AS s, p_size::DOUBLE AS a, p_size / 50.0::DOUBLE AS z FROM part)""",
)
def biology_functions(spark, sf):
    s, a = F.col("p_retailprice"), F.col("p_size").cast("double")
    b = biology
    out = table(spark, sf, "part").select("p_partkey", F.round(b.beverton_holt(s, 1000.0, 5000.0, 0.8), 6).alias("recruits"), b.logistic_selectivity(a, 20.0, 8.0).alias("selectivity"), b.weight_at_length(a, 1e-5, 3.1).alias("weight"), b.exposure(a / 50.0, 0.25).alias("exposure"), F.round(b.surplus_production(s, 0.3, 3000.0, a), 6).alias("next_biomass"))
    return rounded(out, 8)


@query(
    "index_residuals",
    "SELECT l_orderkey, l_linenumber, round(0.5 * ((ln(l_extendedprice) - 10) / 0.5) ** 2 + ln(0.5), 7) AS nll, round(ln(1.1 * l_extendedprice) - ln(30000 + 0.1 * l_extendedprice), 7) AS catch_residual FROM lineitem",
)
def index_residuals(spark, sf):
    x = F.col("l_extendedprice")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", distributions.lognormal_index_nll(10.0, x, 0.5).alias("nll"), distributions.catch_residual(x, 30000.0).alias("catch_residual")), 7)


@query("row_keys", "SELECT l_orderkey, l_linenumber, 'y' || year(l_shipdate) || '_s' || quarter(l_shipdate) || '_f' || l_linenumber || '_r' || (l_suppkey % 4) AS key, year(l_shipdate)::INTEGER AS y, (l_suppkey % 4)::INTEGER AS r FROM lineitem")
def row_keys(spark, sf):
    key = text.row_key(F.year("l_shipdate"), F.quarter("l_shipdate"), F.col("l_linenumber"), F.col("l_suppkey") % 4)
    parsed = text.parse_row_key(F.col("key"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("key")).withColumn("y", parsed["y"]).withColumn("r", parsed["r"])


@query(
    "number_formats",
    "SELECT event_id, CASE WHEN abs(v) >= 100 THEN printf('%.1f', v) WHEN abs(v) >= 1 THEN printf('%.3f', v) ELSE printf('%.6f', v) END AS shown, TRY_CAST(props AS DOUBLE) IS NOT NULL AS numeric_props FROM (SELECT event_id, floor(value * 64) / 64 + 0.0003 AS v, props FROM events)",
)
def number_formats(spark, sf):
    v = F.floor(F.col("value") * 64) / 64 + 0.0003
    return table(spark, sf, "events").select("event_id", text.report_number(v).alias("shown"), text.finite_double(F.col("props")).isNotNull().alias("numeric_props"))


@query(
    "model_health",
    """WITH h AS (SELECT s_suppkey, s_suppkey % 5 <> 0 AS ok, s_suppkey % 7 <> 0 AS pd, abs(s_acctbal) / 50000 AS g, abs(s_acctbal) * 1.5 AS c FROM supplier), l AS (SELECT *, CASE WHEN g < 0.01 THEN 'PASS' WHEN g < 0.1 THEN 'CAUTION' ELSE 'CHECK' END AS gradient, CASE WHEN c < 100 THEN 'EXCELLENT' WHEN c < 1000 THEN 'GOOD' WHEN c < 10000 THEN 'CAUTION' ELSE 'HIGH RISK' END AS conditioning FROM h)
SELECT s_suppkey, CASE WHEN ok THEN 'PASS' ELSE 'CHECK' END AS optimization, gradient, CASE WHEN pd THEN 'PASS' ELSE 'CHECK' END AS curvature, conditioning,
CASE WHEN ok AND pd AND g < 0.01 AND c < 100 THEN 'EXCELLENT' WHEN ok AND pd AND g < 0.1 AND c < 1000 THEN 'GOOD' WHEN ok THEN 'REVIEW' ELSE 'CHECK' END AS quality, CASE WHEN ok AND pd AND gradient = 'PASS' AND conditioning IN ('EXCELLENT', 'GOOD') THEN 'HEALTHY' ELSE 'REVIEW' END AS overall,
CASE WHEN ok AND pd AND gradient = 'PASS' AND conditioning = 'EXCELLENT' THEN 'HIGH' WHEN ok AND pd AND gradient = 'PASS' AND conditioning = 'GOOD' THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM l""",
)
def model_health(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 != 0).alias("ok"), (F.col("s_suppkey") % 7 != 0).alias("pd"), (F.abs("s_acctbal") / 50000).alias("g"), (F.abs("s_acctbal") * 1.5).alias("c"))
    return s.select("s_suppkey", *[x.alias(n) for n, x in text.model_health(F.col("ok"), F.col("g"), F.col("pd"), F.col("c")).items()])


@query(
    "uncertainty_structure",
    """SELECT s_suppkey, CASE WHEN a <= 2 AND m <= 3 THEN 'LOCAL' WHEN a <= 0.25 * n AND d >= 0.25 * n THEN 'MODERATE' WHEN a > 0.5 * n THEN 'GLOBAL' ELSE 'MIXED' END AS label FROM (SELECT s_suppkey, (s_suppkey % 11)::DOUBLE AS a, (s_suppkey % 11 + 1)::DOUBLE AS m, (s_suppkey % 6)::DOUBLE AS d, 16.0 AS n FROM supplier)""",
)
def uncertainty_structure(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", text.uncertainty_structure((k % 11).cast("double"), (k % 11 + 1).cast("double"), (k % 6).cast("double"), F.lit(16.0)).alias("label"))


@query("positive_interval", "SELECT p_partkey, round(p_retailprice * exp(-1.95996398454005 * p_size / p_retailprice), 6) AS lower, round(p_retailprice * exp(1.95996398454005 * p_size / p_retailprice), 6) AS upper FROM part")
def positive_interval(spark, sf):
    from lakewright.plans.inference import positive_interval as interval

    got = interval(F.col("p_retailprice"), F.col("p_size").cast("double") ** 2)
    return rounded(table(spark, sf, "part").select("p_partkey", got["lower"].alias("lower"), got["upper"].alias("upper")))


# ---- projections

@query(
    "scenario_projection",
    """WITH RECURSIVE s AS (SELECT * FROM (VALUES ('zero_catch', 0.0), ('status_quo', 1.0), ('high_catch', 1.25)) t(scenario, m)), k AS (SELECT s_suppkey AS stock, greatest(s_acctbal, 100)::DOUBLE AS b0, 8000.0::DOUBLE AS cap, greatest(s_acctbal, 100) * 0.07 AS c FROM supplier),
p AS (SELECT stock, scenario, 0 AS t, b0 AS b, cap, c * m::DOUBLE AS c FROM k, s UNION ALL SELECT stock, scenario, t + 1, greatest(1.0::DOUBLE, b + 0.34::DOUBLE * b * (1 - b / cap) - c), cap, c FROM p WHERE t < 12)
SELECT stock, scenario, 2024 + t AS year, round(b, 4) AS biomass, round(0.001::DOUBLE * b, 6) AS index FROM p WHERE t > 0""",
)
def scenario_projection(spark, sf):
    from lakewright.models import surplus

    b = F.greatest("s_acctbal", F.lit(100.0))
    stocks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stock"), b.alias("biomass"), (b * 0.07).alias("recent_catch"), F.lit(0.34).alias("r"), F.lit(8000.0).alias("k"), F.lit(0.001).alias("q"))
    cases = spark.createDataFrame([("zero_catch", 0.0), ("status_quo", 1.0), ("high_catch", 1.25)], "scenario string, catch_multiplier double")
    out = surplus.project(stocks, cases, years=12, start_year=2025, keys=["stock"])
    return out.select("stock", "scenario", "year", F.round("biomass", 4).alias("biomass"), F.round("index", 6).alias("index"))


@query("reference_points", "SELECT s_suppkey, round(k / 2, 6) AS b_msy, 0.17::DOUBLE AS f_msy, round(0.34 * k / 4, 6) AS msy, round(b / (k / 2), 6) AS b_ratio, round(50 / b / 0.17, 6) AS f_ratio FROM (SELECT s_suppkey, 4000.0::DOUBLE + s_nationkey AS k, greatest(s_acctbal, 100)::DOUBLE AS b FROM supplier)")
def reference_points(spark, sf):
    from lakewright.models import surplus

    s = table(spark, sf, "supplier").select("s_suppkey", F.lit(0.34).alias("r"), (4000.0 + F.col("s_nationkey")).alias("k"), F.greatest("s_acctbal", F.lit(100.0)).alias("biomass"), F.lit(50.0).alias("catch_mt"))
    return rounded(surplus.reference_points(s).select("s_suppkey", "b_msy", "f_msy", "msy", "b_ratio", "f_ratio"))


_AGE_WEIGHT = (0.2, 0.5, 0.9, 1.4, 1.9, 2.4, 2.8, 3.1, 3.4, 3.6)
_AGE_MATURE = (0.0, 0.1, 0.4, 0.7, 0.9, 1.0, 1.0, 1.0, 1.0, 1.0)


def _over_ages(term: str) -> str:
    return " + ".join(term.replace("AGE", str(k + 1)).replace("WEIGHT", str(_AGE_WEIGHT[k])).replace("MATURE", str(_AGE_MATURE[k])) for k in range(10))


@query(
    "age_structured_runs",
    f"""WITH RECURSIVE k AS (SELECT s_suppkey AS id, exp(7.0 + s_suppkey % 5 / 10.0::DOUBLE) AS r0, 0.18::DOUBLE AS m, 0.05 + (s_suppkey % 7) / 20.0::DOUBLE AS fbar FROM supplier),
p AS (SELECT *, [{", ".join(f"1 / (1 + exp(-1.2 * ({a} - 3)))" for a in range(1, 11))}]::DOUBLE[] AS s FROM k), z AS (SELECT *, list_transform(s, lambda x : m + fbar * x) AS z FROM p),
w AS (SELECT *, 1 AS year, [{", ".join(f"r0 * exp(-{a} * m)" + (" / (1 - exp(-m))" if a == 9 else "") for a in range(10))}]::DOUBLE[] AS n FROM z
UNION ALL SELECT id, r0, m, fbar, s, z, year + 1, [r0, {", ".join(f"n[{a}] * exp(-z[{a}])" for a in range(1, 9))}, n[9] * exp(-z[9]) + n[10] * exp(-z[10])]::DOUBLE[] FROM w WHERE year < 15),
o AS (SELECT *, {_over_ages("n[AGE] * WEIGHT")} AS biomass, {_over_ages("n[AGE] * WEIGHT * MATURE")} AS ssb, {_over_ages("n[AGE] * WEIGHT * fbar * s[AGE] * (1 - exp(-z[AGE])) / z[AGE]")} AS caught FROM w)
SELECT id AS set, year, round(biomass, 6) AS biomass, round(ssb, 6) AS ssb, round(ssb / first_value(ssb) OVER (PARTITION BY id ORDER BY year), 6) AS depletion, round(caught, 6) AS catch, round(0.001 * biomass, 6) AS index FROM o""",
)
def age_structured_runs(spark, sf):
    """Yearly age-structured dynamics of one stock per supplier; the oracle runs the recursion by age in SQL."""
    from lakewright.models.age_structured import run_stocks

    k = F.col("s_suppkey")
    sets_ = table(spark, sf, "supplier").select(k.alias("set"), (7.0 + k % 5 / 10.0).alias("log_r0"), F.lit(math.log(0.18)).alias("log_m"), (F.ln(0.05 + (k % 7) / 20.0)).alias("log_fbar"), F.lit(math.log(1e-3)).alias("log_q"), F.lit(3.0).alias("a50"), F.lit(1.2).alias("slope"))
    return rounded(run_stocks(sets_, 15, list(_AGE_WEIGHT), list(_AGE_MATURE)))


@query(
    "tridiagonal_series",
    """WITH RECURSIVE k AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, 2 + value / 100 AS d FROM events), r AS (SELECT event_type, k, d AS v, ln(d) AS logdet FROM k WHERE k = 1
UNION ALL SELECT k.event_type, k.k, k.d - 0.49 / r.v, r.logdet + ln(k.d - 0.49 / r.v) FROM r JOIN k ON k.event_type = r.event_type AND k.k = r.k + 1)
SELECT event_type, max(k) AS n, round(arg_max(logdet, k), 6) AS logdet, round(1 / arg_max(v, k), 8) AS last_variance FROM r GROUP BY 1""",
)
def tridiagonal_series(spark, sf):
    """Log determinant and last marginal variance of one tridiagonal precision per series, whose rows lie over many
    tasks; the oracle runs the pivots."""
    from lakewright.operators import ordered

    rows = ordered.in_order(table(spark, sf, "events").select("event_type", "ts", "event_id", (2 + F.col("value") / 100).alias("d")), "event_type", "ts", "event_id")
    pivots = ordered.tridiagonal_pivots(rows, ("event_type",), F.col("d"), F.lit(-0.7))
    out = pivots.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.ln("pivot")).alias("logdet"), F.max_by("pivot", F.struct("ts", "event_id")).alias("last"))
    return out.select("event_type", "n", F.round("logdet", 6).alias("logdet"), F.round(1 / F.col("last"), 8).alias("last_variance"))


@query("state_space_series")
def state_space_series(spark, sf):
    """Laplace values of one tridiagonal state-space model per event type; checked in the tests by finite differences."""
    from lakewright.models.surplus import chain_model
    from lakewright.plans.laplace import evaluate_series

    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").groupBy("event_type", day.alias("day")).agg((F.avg("value") / 1000 + 0.5).alias("index"), F.lit(18.0).alias("catch_mt"), F.lit(math.log(780.0)).alias("start"))
    out = evaluate_series(rows, chain_model(), np.array([math.log(7e-4), math.log(0.34), math.log(950.0)]), series="event_type", time="day", columns=["catch_mt", "index"], start="start")
    return rounded(out.select("event_type", "n", "value", "gradient_norm"), 4)
