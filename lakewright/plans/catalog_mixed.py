"""Registered queries of mixed models: several random effects, exact outer Hessians, crossed effects, long series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lakewright.plans.catalog import _POISSON, LOG_2PI, TAU, poisson_intercept, query, rounded, table


@query(
    "laplace_outer_hessian",
    _POISSON
    + f""", t AS (SELECT n * exp(0.8 + u) AS l, 1 / {TAU**2} AS t, u, h FROM m),
d AS (SELECT *, -l / h AS um, 2 * u * t / h AS us FROM t),
e AS (SELECT *, l * (1 + um) AS hm, l * us - 2 * t AS hs, -l * (1 + um) ** 2 / h AS umm, -(l * us * (1 + um) - 2 * t * um) / h AS ums, -(4 * u * t - 4 * t * us + l * us * us) / h AS uss FROM d),
s AS (SELECT sum(l * (1 + um) + 0.5 * ((l * (1 + um) ** 2 + l * umm) / h - hm * hm / (h * h))) AS mm, sum(l * us + 0.5 * ((l * us * (1 + um) + l * ums) / h - hm * hs / (h * h))) AS ms,
sum(2 * u * u * t - 2 * u * t * us + 0.5 * ((4 * t + l * us * us + l * uss) / h - hs * hs / (h * h))) AS ss FROM e)
SELECT unnest(['mu', 'mu', 'log_tau']) AS a, unnest(['mu', 'log_tau', 'log_tau']) AS b, unnest([round(mm, 4), round(ms, 4), round(ss, 4)]) AS value FROM s""",
)
def laplace_outer_hessian(spark, sf):
    """Exact second derivatives of a marginal likelihood whose modes take Newton's steps; the oracle differentiates by hand."""
    model = poisson_intercept(spark, sf)
    _, _, h = model.outer_hessian(np.array([0.8, math.log(TAU)]))
    model.close()
    names = model.params
    return spark.createDataFrame([(names[a], names[b], round(float(h[a, b]), 4)) for a in range(2) for b in range(a, 2)], "a string, b string, value double")


_MU, _SIGMA, _TAU0, _TAU1, _RHO = 11.6, 0.7, 0.4, 0.2, 0.25


def intercept_slope(spark, sf):
    """Log order values of customers with a correlated random intercept and slope over the years."""
    from lakewright.plans import expr as X
    from lakewright.plans.laplace import GroupedLaplace

    rows = table(spark, sf, "orders").select("o_custkey", F.ln("o_totalprice").alias("y"), (F.year("o_orderdate") - 1995).cast("double").alias("x"))
    u0, u1 = X.random("u0"), X.random("u1")
    l0, l1, rho = X.param("log_tau0"), X.param("log_tau1"), 2 * X.logistic(X.param("z")) - 1
    z0, z1, rest = u0 * X.exp(-l0), u1 * X.exp(-l1), 1 - X.square(rho)
    prior = LOG_2PI + l0 + l1 + 0.5 * X.log(rest) + 0.5 * (X.square(z0) - 2 * rho * z0 * z1 + X.square(z1)) / rest
    row = X.normal_nll(X.data("y"), X.param("mu") + u0 + u1 * X.data("x"), X.param("log_sigma"))
    return GroupedLaplace(rows, "o_custkey", row, prior, ["mu", "log_sigma", "log_tau0", "log_tau1", "z"], ("u0", "u1"))


_AT = np.array([_MU, math.log(_SIGMA), math.log(_TAU0), math.log(_TAU1), math.log((1 + _RHO) / (1 - _RHO))])
_LEFT = 1 - _RHO**2
#: Sums of each customer, the precision matrix H and its inverse C by the formula for two by two matrices.
_SLOPES = f"""WITH g AS (SELECT o_custkey, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(r) AS sr, sum(x * r) AS sxr, sum(r * r) AS srr FROM (SELECT o_custkey, ln(o_totalprice) - {_MU} AS r, (year(o_orderdate) - 1995)::DOUBLE AS x FROM orders) GROUP BY 1),
h AS (SELECT *, n / {_SIGMA**2} + {1 / (_LEFT * _TAU0**2)} AS h00, sx / {_SIGMA**2} - {_RHO / (_LEFT * _TAU0 * _TAU1)} AS h01, sxx / {_SIGMA**2} + {1 / (_LEFT * _TAU1**2)} AS h11 FROM g),
c AS (SELECT *, h00 * h11 - h01 * h01 AS det FROM h),
m AS (SELECT *, h11 / det AS c00, -h01 / det AS c01, h00 / det AS c11, (h11 * sr - h01 * sxr) / (det * {_SIGMA**2}) AS u0, (h00 * sxr - h01 * sr) / (det * {_SIGMA**2}) AS u1 FROM c),
f AS (SELECT *, srr - 2 * (u0 * sr + u1 * sxr) + u0 * u0 * n + 2 * u0 * u1 * sx + u1 * u1 * sxx AS rss, u0 / {_TAU0} AS z0, u1 / {_TAU1} AS z1 FROM m)"""


@query("intercept_slope_mode", _SLOPES + " SELECT o_custkey, round(u0, 7) AS u0, round(u1, 7) AS u1, round(c00, 7) AS covariance_u0_u0, round(c01, 7) AS covariance_u0_u1, round(c11, 7) AS covariance_u1_u1 FROM m")
def intercept_slope_mode(spark, sf):
    """Modes and conditional covariances of two effects per customer; the oracle inverts two by two matrices."""
    s = intercept_slope(spark, sf).mode_sensitivity(_AT)
    return rounded(s.select("o_custkey", "u0", "u1", "covariance_u0_u0", "covariance_u0_u1", "covariance_u1_u1"), 7)


@query(
    "laplace_intercept_slope",
    _SLOPES
    + f""" SELECT round(sum(n * ({0.5 * LOG_2PI} + ln({_SIGMA})) + rss / (2 * {_SIGMA**2}) + ln({_TAU0}) + ln({_TAU1}) + 0.5 * ln({_LEFT}) + 0.5 * (z0 * z0 - 2 * {_RHO} * z0 * z1 + z1 * z1) / {_LEFT} + 0.5 * ln(det)), 3) AS objective,
round(sum(-(sr - n * u0 - sx * u1) / {_SIGMA**2}), 3) AS d_mu, round(sum(n - rss / {_SIGMA**2} - (n * c00 + 2 * sx * c01 + sxx * c11) / {_SIGMA**2}), 3) AS d_log_sigma,
round(sum(1 - (z0 * z0 - {_RHO} * z0 * z1) / {_LEFT} - c00 / ({_LEFT} * {_TAU0**2}) + c01 * {_RHO / (_LEFT * _TAU0 * _TAU1)}), 3) AS d_log_tau0,
round(sum(1 - (z1 * z1 - {_RHO} * z0 * z1) / {_LEFT} - c11 / ({_LEFT} * {_TAU1**2}) + c01 * {_RHO / (_LEFT * _TAU0 * _TAU1)}), 3) AS d_log_tau1 FROM f""",
)
def laplace_intercept_slope(spark, sf):
    """Marginal value and gradient with two correlated effects per group; exact, as the model is normal."""
    model = intercept_slope(spark, sf)
    value, g = model.evaluate(_AT)
    model.close()
    return spark.createDataFrame([tuple(round(float(x), 3) for x in (value, *g[:4]))], "objective double, d_mu double, d_log_sigma double, d_log_tau0 double, d_log_tau1 double")


_CROSSED = (11.0, 0.9, 0.4, 0.3)
#: Steps whose result is compared; each adds three tables to the SQL.
_STEPS = 4


def _steps_sql() -> str:
    mean, sigma, c, p = _CROSSED
    out = f"""WITH l AS MATERIALIZED (SELECT 0 AS f, o_custkey AS c, l_partkey AS p, ln(l_extendedprice) - {mean} AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS MATERIALIZED (SELECT fi, i, fj, j, v / {sigma**2} + CASE WHEN fi = fj THEN CASE fi WHEN 0 THEN {1 / c**2} ELSE {1 / p**2} END ELSE 0 END AS v FROM (SELECT 0 AS fi, c AS i, 0 AS fj, c AS j, count(*) AS v FROM l GROUP BY c UNION ALL SELECT 1, p, 1, p, count(*) FROM l GROUP BY p
UNION ALL SELECT 0, c, 1, p, count(*) FROM l GROUP BY c, p UNION ALL SELECT 1, p, 0, c, count(*) FROM l GROUP BY c, p)),
b AS (SELECT 0 AS f, c AS k, sum(y) / {sigma**2} AS b FROM l GROUP BY c UNION ALL SELECT 1, p, sum(y) / {sigma**2} FROM l GROUP BY p),
s0 AS MATERIALIZED (SELECT f, k, v AS d, 0.0::DOUBLE AS x, b AS r, b / v AS p FROM b JOIN a ON fi = f AND i = k AND fj = f AND j = k)"""
    for t in range(_STEPS):
        out += f""", q{t} AS MATERIALIZED (SELECT f, k, d, x, r, s.p, q FROM s{t} s JOIN (SELECT fi, i, sum(v * p) AS q FROM a JOIN s{t} ON f = fj AND k = j GROUP BY 1, 2) ON fi = f AND i = k),
t{t} AS MATERIALIZED (SELECT f, k, d, x + al * p AS x, r - al * q AS r, p, rr FROM q{t}, (SELECT sum(r * r / d) / sum(p * q) AS al, sum(r * r / d) AS rr FROM q{t})),
s{t + 1} AS MATERIALIZED (SELECT f, k, d, x, r, r / d + be * p AS p FROM t{t}, (SELECT sum(r * r / d) / max(rr) AS be FROM t{t}))"""
    return out + f" SELECT f::INTEGER AS factor, k AS level, round(x, 7) AS effect FROM s{_STEPS}"


def crossed_effects(spark, sf):
    """Log line prices with an effect of each customer and one of each part."""
    from lakewright.plans.krylov import crossed_system

    mean, sigma, c, p = _CROSSED
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.ln("l_extendedprice") - mean).alias("y")).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return crossed_system(rows, {"o_custkey": c, "l_partkey": p}, "y", sigma)


@query("crossed_effects_steps", _steps_sql())
def crossed_effects_steps(spark, sf):
    """Effects of customers and parts after a fixed number of conjugate-gradient steps; the oracle takes the same steps in SQL."""
    system, right = crossed_effects(spark, sf)
    out = system.solve(right, ["b"], steps=_STEPS).solution
    return rounded(out.select(F.col("node.factor").alias("factor"), F.col("node.level").alias("level"), F.col("b").alias("effect")), 7)


@query("crossed_effects_fit")
def crossed_effects_fit(spark, sf):
    """Unknowns, relative residual and log determinant of the crossed model; checked against dense matrices in the tests."""
    system, right = crossed_effects(spark, sf)
    run = system.solve(right, ["b"], steps=60, tol=1e-8)
    value, error = system.log_determinant(probes=8, steps=10)
    out = spark.createDataFrame([(system.side, bool(run.residual[0] <= 1e-8), value, error)], "unknowns long, solved boolean, log_determinant double, standard_error double")
    system.close()
    return out


_PHI, _PROCESS, _NOISE = 0.9, 0.4, 0.7


def _kalman(name: str, dq: str, dr: str) -> tuple[str, str, str]:
    """(first row's, next rows' and objective's derivative columns) of a Kalman filter by one parameter."""
    dp = f"{_PHI**2} * dp_{name} + {dq}"
    ds = f"({dp} + {dr})"
    dk = f"(({dp}) / s - pm * {ds} / (s * s))"
    dm = f"{_PHI} * dm_{name}"
    return f"{dm} + {dk} * v - pm / s * {dm} AS dm_{name}", f"(({dp}) * {_NOISE**2} + pm * {dr}) / s - pm * {_NOISE**2} * {ds} / (s * s) AS dp_{name}", f"dl_{name} + 0.5 * ({ds} / s - 2 * v * {dm} / s - v * v * {ds} / (s * s)) AS dl_{name}"


@query(
    "long_series_laplace",
    f"""WITH RECURSIVE y AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, value / 100 AS y FROM events),
f AS (SELECT event_type, 0 AS k, 0.0::DOUBLE AS m, {(1 - _PROCESS**2) / _PHI**2}::DOUBLE AS p, 0.0::DOUBLE AS l, 0.0::DOUBLE AS dm_q, {-2 * _PROCESS**2 / _PHI**2}::DOUBLE AS dp_q, 0.0::DOUBLE AS dl_q, 0.0::DOUBLE AS dm_r, 0.0::DOUBLE AS dp_r, 0.0::DOUBLE AS dl_r FROM (SELECT DISTINCT event_type FROM events)
UNION ALL SELECT event_type, k, {_PHI} * m + pm / s * v, pm * {_NOISE**2} / s, l + 0.5 * ({LOG_2PI} + ln(s) + v * v / s), """
    + ", ".join([*_kalman("q", str(2 * _PROCESS**2), "0"), *_kalman("r", "0", str(2 * _NOISE**2))])
    + f""" FROM (SELECT f.* EXCLUDE (k), y.k, {_PHI**2} * p + {_PROCESS**2} AS pm, {_PHI**2} * p + {_PROCESS**2 + _NOISE**2} AS s, y - {_PHI} * m AS v FROM f JOIN y ON y.event_type = f.event_type AND y.k = f.k + 1))
SELECT event_type, max(k) AS n, round(arg_max(l, k), 5) AS value, round(arg_max(dl_q, k), 5) AS d_log_process, round(arg_max(dl_r, k), 5) AS d_log_noise FROM f GROUP BY 1""",
)
def long_series_laplace(spark, sf):
    """Marginal objective and gradient of an autoregressive state seen through noise, series lying over many tasks; the
    oracle runs the Kalman filter and its derivatives."""
    from lakewright.plans import expr as X
    from lakewright.plans.laplace import ChainLaplace
    from lakewright.plans.long_chain import LongChain

    u, v = X.random("u"), X.random("v")
    model = ChainLaplace(X.normal_nll(u, 0.0, 0.0), X.normal_nll(v, _PHI * u, X.param("log_process")), X.normal_nll(X.data("y"), u, X.param("log_noise")), ["log_process", "log_noise"])
    rows = table(spark, sf, "events").select("event_type", "ts", "event_id", (F.col("value") / 100).alias("y"))
    out = LongChain(rows, "event_type", ("ts", "event_id"), model).evaluate(np.log([_PROCESS, _NOISE]))
    return rounded(out.select("event_type", "n", "value", "d_log_process", "d_log_noise"), 5)


@query(
    "curvature_directions",
    _POISSON
    + f""", e AS (SELECT o_custkey, n * exp(0.8 + u) AS l, h FROM m), d AS (SELECT c_nationkey AS direction, c_custkey AS o_custkey, c_acctbal / 1e4 AS w FROM customer WHERE c_acctbal <> 0),
v AS (SELECT direction, o_custkey, w * l AS value, h FROM d JOIN e USING (o_custkey) UNION ALL SELECT -1, o_custkey, 0.5 * l - 2 * (-2 / {TAU**2}), h FROM e)
SELECT direction, count(*) AS n_entries, round(sum(value), 4) AS total, round(sum(value / h), 6) AS log_determinant FROM v GROUP BY 1""",
)
def curvature_directions(spark, sf):
    """How the curvature of every customer changes along one direction per nation (its customers' effects) and one of
    parameters, as entries formed and changes of the log determinant; the oracle differentiates by hand."""
    model = poisson_intercept(spark, sf)
    own = table(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("direction"), F.col("c_custkey").alias("group"), F.lit("u").alias("name"), (F.col("c_acctbal") / 1e4).alias("weight"))
    both = spark.createDataFrame([(-1, None, "mu", 0.5), (-1, None, "log_tau", -2.0)], own.schema)
    out = model.curvature_along(np.array([0.8, math.log(TAU)]), own.unionByName(both))
    per = out.groupBy("direction").agg(F.count("*").alias("n_entries"), F.sum("value").alias("total"), F.sum("trace").alias("log_determinant"))
    return per.select("direction", "n_entries", F.round("total", 4).alias("total"), F.round("log_determinant", 6).alias("log_determinant"))


@query(
    "standardised_differences",
    """WITH c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS l, stddev_samp(c_acctbal) / sqrt(count(*)) AS se FROM customer GROUP BY 1), r AS (SELECT s_nationkey AS k, avg(s_acctbal) AS r FROM supplier GROUP BY 1),
d AS (SELECT n_regionkey, (l - r) / CASE WHEN se <> 0 THEN se END AS e FROM c JOIN nation ON n_nationkey = k LEFT JOIN r USING (k))
SELECT n_regionkey, count(*) AS compared, count(*) FILTER (e IS NULL) AS lost, round(max(abs(e)), 6) AS worst, count(*) FILTER (e IS NULL) = 0 AND coalesce(max(abs(e)) < 5, false) AS recovered FROM d GROUP BY 1""",
)
def standardised_differences(spark, sf):
    """Balances of every nation's customers and suppliers compared in standard errors, with a verdict per region."""
    from lakewright.operators.comparisons import recovered
    from lakewright.operators.comparisons import standardised_differences as differences

    place = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    c = table(spark, sf, "customer").join(place, F.col("c_nationkey") == F.col("k"))
    s = table(spark, sf, "supplier").join(place, F.col("s_nationkey") == F.col("k"))
    keys = ["n_regionkey", "k"]
    errors = c.groupBy(*keys).agg((F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("se"))
    out = differences(c.groupBy(*keys).agg(F.avg("c_acctbal").alias("v")), s.groupBy(*keys).agg(F.avg("s_acctbal").alias("v")), errors, keys, "v", "se")
    return rounded(recovered(out, most=5.0, by=["n_regionkey"]))


@query(
    "step_sensitivity",
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_clerk AS label, round(abs(o_totalprice * (1 + o_custkey / 1e8) / o_totalprice - 1), 9) AS change, abs(o_totalprice * (1 + o_custkey / 1e8) / o_totalprice - 1) >= 1e-5 AS sensitive FROM (SELECT *, o_orderpriority AS o_clerk FROM orders)""",
)
def step_sensitivity(spark, sf):
    """Order values at two precisions, matched by their places in the order of keys, which no task counts alone."""
    from lakewright.operators.comparisons import step_sensitivity as sensitivity

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"), "o_custkey", F.col("o_totalprice").alias("v"))
    coarse = o.withColumn("v", F.col("v") * (1 + F.col("o_custkey") / 1e8))
    out = sensitivity(coarse.select("o_orderkey", "label", "v"), o.select("o_orderkey", "label", "v"), ["o_orderkey"], "label", "v", most=1e-5)
    return rounded(out.select("place", "label", "change", "sensitive"), 9)


@query(
    "likelihood_parts",
    _POISSON
    + f""", c AS (SELECT sum(n * exp(0.8 + u) - s * (0.8 + u)) AS counts, sum({0.5 * LOG_2PI} + ln({TAU}) + u * u / (2 * {TAU**2})) AS effects, sum(0.5 * ln(h)) AS d, count(*) * {-0.5 * LOG_2PI} AS k, count(*) AS g FROM m),
v AS (SELECT unnest(['counts', 'effects', 'log_determinant', 'constant']) AS component, unnest([counts, effects, d, k]) AS value, g AS groups FROM c)
SELECT component, round(value, 4) AS value, round(abs(value) / sum(abs(value)) OVER (), 7) AS share, groups FROM v""",
)
def likelihood_parts(spark, sf):
    """What counts, effects and the curvature contribute to a marginal objective."""
    from lakewright.plans import expr as X

    model = poisson_intercept(spark, sf)
    out = model.components(np.array([0.8, math.log(TAU)]), {"counts": (model.row, X.num(0.0)), "effects": (X.num(0.0), model.prior)})
    model.close()
    return out.select("component", (F.round("value", 4) + F.lit(0.0)).alias("value"), F.round("share", 7).alias("share"), "groups")
