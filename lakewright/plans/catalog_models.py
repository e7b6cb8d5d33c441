"""Registered queries of report shapes, fits, sampling and assessment models.

Fits and samplers have no SQL oracle; the tests check them against closed forms, finite differences and
known moments.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lakewright.operators import joins, matrix, windows
from lakewright.plans import catalog
from lakewright.plans.catalog import embedding_covariance, query, rounded, table
from lakewright.sinks import writers

# ---- report shapes


@query("posterior_draws_report", "SELECT user_id % 4 + 1 AS chain, event_id + 1 AS iteration, event_type AS parameter, value, round(-value / 100, 8) AS log_density FROM events")
def posterior_draws_report(spark, sf):
    d = table(spark, sf, "events").select((F.col("user_id") % 4).alias("chain"), F.col("event_id").alias("iteration"), F.col("event_type").alias("parameter"), "value", F.round(-F.col("value") / 100, 8).alias("log_density"))
    return writers.posterior_draws(d)


@query("wide_draws_to_long", "SELECT p_partkey % 3 + 1 AS chain, p_partkey + 1 AS iteration, p_retailprice AS log_density, unnest(['a', 'b']) AS parameter, unnest([p_size::DOUBLE, p_retailprice / 2]) AS value FROM part")
def wide_draws_to_long(spark, sf):
    d = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("chain"), F.col("p_partkey").alias("iteration"), F.col("p_retailprice").alias("log_density"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 2).alias("b"))
    return writers.wide_draws_to_long(d, ["a", "b"])


@query("csv_lines", """SELECT c_custkey || ',' || c_name || ',"' || c_mktsegment || ', ""' || c_nationkey || '""\"' AS line FROM customer""")
def csv_lines(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')).alias("note"))
    return writers.csv_lines(rows)


@query("json_rows", """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","z":null}' AS json FROM supplier""")
def json_rows(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit(float("nan")).alias("z"))
    return writers.json_rows(rows)


@query(
    "spatial_animation",
    """SELECT 'region' AS record, year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS season, c_nationkey AS region, NULL::INTEGER AS from_region, NULL::INTEGER AS to_region, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2, 3, 4
UNION ALL SELECT 'movement', NULL, n_nationkey % 4 + 1, NULL, n_nationkey, n_regionkey, 0.5 FROM nation""",
)
def spatial_animation(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region"))
    r = table(spark, sf, "orders").join(c, "o_custkey").groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("season"), "region").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    m = table(spark, sf, "nation").select((F.col("n_nationkey") % 4 + 1).alias("season"), F.col("n_nationkey").alias("from_region"), F.col("n_regionkey").alias("to_region"), F.lit(0.5).alias("value"))
    return writers.spatial_animation(r, m).select("record", "year", "season", "region", "from_region", "to_region", "value")


@query("management_summary", "SELECT vec_id AS run, i + 1 AS year, embedding[i + 1]::DOUBLE AS ssb, CASE WHEN embedding[1] > 0 THEN round(embedding[i + 1]::DOUBLE / embedding[1]::DOUBLE, 6) END AS depletion FROM (SELECT vec_id, embedding, unnest(range(len(embedding)))::INTEGER AS i FROM embeddings)")
def management_summary(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("run"), F.transform("embedding", lambda x: x.cast("double")).alias("ssb"), F.element_at("embedding", 1).cast("double").alias("ssb0"))
    return writers.management_summary(e).select("run", "year", "ssb", F.round("depletion", 6).alias("depletion"))


@query(
    "structure_report",
    f"""WITH {catalog._COV}, {catalog._BANDS}, {catalog._TARGETS}, big AS (SELECT * FROM cov WHERE abs(value) > 1e-12),
a AS (SELECT abs(value) AS a, row_number() OVER (ORDER BY abs(value) DESC, i, j) AS k, sum(abs(value)) OVER (ORDER BY abs(value) DESC, i, j ROWS UNBOUNDED PRECEDING) / sum(abs(value)) OVER () AS c FROM cov WHERE abs(value) > 1e-8),
sp AS (SELECT target, CASE WHEN target >= 1 THEN count(*) ELSE min(k) FILTER (c >= target) END AS need, count(*)::DOUBLE AS nonzeros FROM a, t GROUP BY target),
bw AS (SELECT target, CASE WHEN target >= 1 THEN 63 ELSE min(band_distance) FILTER (cum >= target) END::BIGINT AS bandwidth FROM c, t GROUP BY target)
SELECT unnest(['nnz', 'diagonal_nnz', 'bandwidth', 'max_row_nnz', 'fill_ratio']) AS metric, NULL::DOUBLE AS target, unnest([count(*)::DOUBLE, count(*) FILTER (i = j), max(abs(i - j)), (SELECT max(k) FROM (SELECT count(*) AS k FROM big GROUP BY i)), round(count(*) / 4096.0::DOUBLE, 6)]) AS value, '' AS extra FROM big
UNION ALL SELECT 'effective_sparsity', target, need::DOUBLE, 'compression=' || round(nonzeros / need, 6)::DOUBLE FROM sp
UNION ALL SELECT 'effective_bandwidth', target, bandwidth::DOUBLE, 'entries=' || (64 * (2 * bandwidth + 1) - bandwidth * (bandwidth + 1)) FROM bw""",
)
def structure_report(spark, sf):
    cov = embedding_covariance(spark, sf)
    return rounded(writers.structure_report(matrix.structure(cov, 64), matrix.effective_sparsity(cov), matrix.effective_bandwidth(cov, 64)))


@query("functional_analysis")
def functional_analysis(spark, sf):
    """Structure, uncertainty, geometry and spectrum of the embedding covariance in one long report."""
    from lakewright.plans.linalg import spectral_summary

    cov = embedding_covariance(spark, sf).cache()
    one = matrix.structure(cov, 64).select("nnz", "bandwidth", "fill_ratio")
    spectrum = [(k, float(v)) for k, v in spectral_summary(matrix.to_numpy(cov, 64)).items()]
    from lakewright.operators.sets import metrics

    extremes = matrix.correlation_extremes(cov)
    parts = {
        "structure": metrics(one, one.columns),
        "uncertainty": metrics(extremes, extremes.columns),
        "geometry": matrix.geometry(cov).select(F.lit("column_norm").alias("metric"), F.col("j").cast("string").alias("target"), F.col("norm").alias("value")),
        "spectral": spark.createDataFrame(spectrum, "metric string, value double"),
    }
    return rounded(writers.analysis_report(parts))


@query(
    "derived_uncertainty",
    """WITH y AS (SELECT year(o_orderdate)::INTEGER AS year, avg(ln(o_totalprice)) AS u, count(*)::DOUBLE AS c, var_samp(ln(o_totalprice)) / count(*) AS v FROM orders GROUP BY 1), f AS (SELECT arg_min(u, year) AS x0, arg_min(v, year) AS v0, min(year) AS y0 FROM y),
q AS (SELECT year, unnest(['log_biomass', 'biomass', 'depletion', 'fishing_rate']) AS quantity, unnest([u, exp(u), exp(u - x0), c / exp(u)]) AS estimate, unnest([sqrt(v), exp(u) * sqrt(v), exp(u - x0) * sqrt(CASE WHEN year = y0 THEN 0 ELSE v + v0 END), c / exp(u) * sqrt(v)]) AS se FROM y, f)
SELECT year, quantity, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate - 1.96 * se, 6) AS lwr_95, round(estimate + 1.96 * se, 6) AS upr_95 FROM q""",
)
def derived_uncertainty(spark, sf):
    from lakewright.plans.inference import derived_uncertainty as report

    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg(F.ln("o_totalprice")).alias("u"), F.count("*").cast("double").alias("c"), (F.var_samp(F.ln("o_totalprice")) / F.count("*")).alias("v"))
    cov = y.select(F.col("year").alias("i"), F.col("year").alias("j"), F.col("v").alias("value"))
    return rounded(report(y.select("year", "u", "c"), cov, "year", "u", "c"))


@query(
    "projection_comparison",
    """WITH t AS (SELECT l_orderkey, sum(l_extendedprice) AS lines FROM lineitem GROUP BY 1), a AS (SELECT o_orderpriority AS scenario, year(o_orderdate)::INTEGER AS year, avg(lines) AS v FROM orders JOIN t ON l_orderkey = o_orderkey GROUP BY 1, 2), b AS (SELECT o_orderpriority AS scenario, year(o_orderdate)::INTEGER AS year, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT scenario, year, round(a.v - b.v, 4) AS difference, round((a.v - b.v) / b.v, 8) AS relative, abs(a.v - b.v) <= 0.02 * abs(b.v) AS within FROM a JOIN b USING (scenario, year)""",
)
def projection_comparison(spark, sf):
    """Means of orders' lines against means of orders' totals by priority and year."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("scenario"), F.year("o_orderdate").alias("year"), "o_totalprice")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("lines"))
    a = o.join(lines, "o_orderkey").groupBy("scenario", "year").agg(F.avg("lines").alias("v"))
    out = joins.compare_values(a, o.groupBy("scenario", "year").agg(F.avg("o_totalprice").alias("v")), ["scenario", "year"], "v", rtol=0.02)
    return out.select("scenario", "year", F.round("difference", 4).alias("difference"), F.round("relative", 8).alias("relative"), "within")


# ---- fits and sampling


@query("laplace_fit")
def laplace_fit(spark, sf):
    """Fit of intercept and residual sd, the sd between customers held at 0.1, by L-BFGS on exact marginal gradients."""
    from lakewright.plans import expr as X
    from lakewright.plans import inference, optimize
    from lakewright.plans.laplace import GroupedLaplace

    rows = table(spark, sf, "orders").select("o_custkey", F.ln("o_totalprice").alias("y"))
    mean, sd, n = rows.agg(F.avg("y"), F.stddev_samp("y"), F.count("*")).first()
    u = X.random("u")
    model = GroupedLaplace(rows, "o_custkey", X.normal_nll(X.data("y"), X.param("mu") + u, X.param("log_sigma")), X.normal_nll(u, 0.0, math.log(0.1)), ["mu", "log_sigma"])
    # steps are measured in rough standard errors
    f, back = optimize.scaled(model.evaluate, np.array([mean, math.log(sd)]), np.diag([sd * sd / n, 0.5 / n]))
    x = back(optimize.lbfgs(f, np.zeros(2), tol=1e-3, most=30).x)
    c = inference.covariance_from_hessian(model.outer_hessian(x)[2])
    return rounded(inference.fixed_effect_report(spark, model.params, x, c.covariance), 4)


@query("surplus_fits")
def surplus_fits(spark, sf):
    """Deterministic surplus production with soft priors, fitted to each priority's yearly orders; checked in the tests on simulated data."""
    from lakewright.models.surplus import fit_deterministic

    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("stock"), F.year("o_orderdate").alias("year"))
    rows = o.agg((F.count("*") * 20.0 / F.lit(table(spark, sf, "orders").count()) * 35).alias("catch_mt"), (F.avg("o_totalprice") / 200_000).alias("index"))
    return rounded(fit_deterministic(rows, "stock", "year", "catch_mt", "index"), 3)


def order_posterior(spark, sf):
    """(target's maker, what turns its coordinates into mu and log_sigma): the posterior of a normal law of all orders'
    log prices under flat priors, in rough standard errors about its mode. Counts, mean and sd are the table's."""
    rows = table(spark, sf, "orders").select(F.ln("o_totalprice").alias("y"))
    n, mean, sd = rows.agg(F.count("y"), F.avg("y"), F.stddev_pop("y")).first()
    root = math.sqrt(n)

    def make():
        def f(q):
            a, b = q[0], q[1] / (math.sqrt(2) * root)
            shrink = math.exp(-2 * b)
            # n times log sigma's deviation, and the squares about mu
            value = -n * b - 0.5 * (n + a * a) * shrink
            return value, np.array([-a * shrink, (-n + (n + a * a) * shrink) / (math.sqrt(2) * root)])

        return f

    return make, (lambda a: mean + a * sd / root), (lambda b: math.log(sd) + b / (math.sqrt(2) * root)), n


@query("nuts_chains")
def nuts_chains(spark, sf):
    """Four chains over the posterior of mean and log sd of all orders' log prices, with diagnostics; moments are checked
    in the tests."""
    from lakewright.plans.sampling import Options, sample

    make, mu, log_sigma, _ = order_posterior(spark, sf)
    draws = sample(spark, make, ["mu", "log_sigma"], np.zeros(2), chains=4, options=Options(warmup=200, draws=200))
    draws = draws.withColumn("value", F.when(F.col("parameter") == "mu", mu(F.col("value"))).otherwise(log_sigma(F.col("value")))).cache()
    per = draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    return rounded(per.join(windows.chain_diagnostics(draws, ["parameter"], "chain", ["iteration"], "value"), "parameter"), 6)


@query("posterior_simulation")
def posterior_simulation(spark, sf):
    """Predicted prices of new orders from draws of the posterior; checked in the tests by moments."""
    from lakewright.plans.sampling import Options, sample, simulate

    make, mu, log_sigma, _ = order_posterior(spark, sf)
    draws = sample(spark, make, ["mu", "log_sigma"], np.zeros(2), chains=2, options=Options(warmup=100, draws=100))
    price = lambda q, rng: np.array([math.exp(mu(q[0])), math.exp(mu(q[0]) + math.exp(log_sigma(q[1])) * rng.standard_normal())])
    return rounded(simulate(draws, ["mu", "log_sigma"], ["median", "new_order"], price, healthy=True, every=2, most=60))


# ---- assessment models


def seasonal_stock():
    """A two-sex, four-season stock with two fleets, at round values."""
    from lakewright.models.age_structured import SeasonalStock, logistic

    ages = 16
    age = np.arange(ages)
    weight = np.concatenate([80 * (1 - np.exp(-0.25 * (age + 0.5))) ** 3, 60 * (1 - np.exp(-0.3 * (age + 0.5))) ** 3])
    fecundity = np.concatenate([weight[:ages] * logistic(1.5 * (age - 4)), np.zeros(ages)])
    sel = np.stack([np.tile(logistic(1.2 * (age - 3)), 2), np.tile(logistic(0.8 * (age - 6)), 2)])
    return SeasonalStock(ages, np.full(2 * ages, 0.25), np.repeat(weight[None], 4, 0), fecundity, sel, 1000.0, 0.8, 4, 1)


@query("seasonal_projection")
def seasonal_projection(spark, sf):
    """A scenario for every supplier, of one of five kinds of targets by its nation and with a value by its balance,
    resolved and projected ten years."""
    from lakewright.models.age_structured import project_scenarios

    stock = seasonal_stock()
    share = (F.abs("s_acctbal") % 1000) / 1000
    kinds = F.array(*[F.struct(F.lit(k).alias("target"), v.alias("value")) for k, v in (("multiplier", 0.2 + share), ("msy", F.lit(0.0)), ("spr", 0.25 + share / 2), ("ssb_ratio", 0.3 + share / 3), ("annual_f", 0.05 + share / 4))])
    cases = table(spark, sf, "supplier").withColumn("kind", F.get(kinds, F.col("s_nationkey") % 5)).select(F.col("s_name").alias("scenario"), "kind.target", "kind.value")
    return rounded(project_scenarios(cases, stock, stock.unfished()[0], np.full((4, 2), 0.1), 10), 4)


def order_effort(spark, sf) -> np.ndarray:
    """Orders of two kinds of priority as the effort of two fleets by year (1992 to 1997), quarter and region of the
    customer, against their mean; the model's 240 cells come to the driver."""
    place = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").cast("int").alias("region"))
    day = F.col("o_orderdate")
    cells = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("fleet"), (F.year(day) - 1992).alias("year"), (F.quarter(day) - 1).alias("season"))
    counts = cells.filter("year between 0 and 5").join(place, "o_custkey").groupBy("fleet", "year", "season", "region").agg(F.count("*").alias("n")).filter("region between 0 and 4").collect()
    out = np.ones((2, 6, 4, 5))
    for r in counts:
        out[r.fleet, r.year, r.season, r.region] += r.n
    return out / out.mean()


def spatial_data(effort: np.ndarray | None = None):
    """Data of a spatial model for effort by fleet, year, season and region (made up for three regions if not given);
    catches and indices are the model's."""
    from dataclasses import replace

    from lakewright.models.age_structured import logistic
    from lakewright.models.spatial import SpatialData, SpatialFit, dynamics

    rng, a = np.random.default_rng(5), 8
    f, y, s, r = (2, 6, 4, 3) if effort is None else effort.shape
    move = rng.random((s, r, r)) + 3 * np.eye(r)
    age = np.arange(a)
    d = SpatialData(rng.uniform(0.5, 2, (f, y, s, r)) if effort is None else effort, np.zeros((f, y, s, r)), np.zeros((f, y, s, r)), move / move.sum(2, keepdims=True), np.full(a, 0.3), 1 - np.exp(-0.4 * (age + 0.5)), logistic(2 * (age - 2)), np.stack([logistic(age - 2), logistic(age - 3)]))
    out = dynamics(d, SpatialFit(8.0, -3.0, -1.0))
    return replace(d, catch=out["catch"], index=out["index"])


@query("spatial_retrospective")
def spatial_retrospective(spark, sf):
    """Refits of a spatial model to peeled data, in parallel, and Mohn's rho of each peel's last year."""
    from lakewright.models.spatial import by_case

    data = spatial_data(order_effort(spark, sf))
    cases = spark.createDataFrame([(f"peel{k}",) for k in range(3)], "case string")
    fits = by_case(cases, lambda name: data.peel(6 - int(name[4:])), np.array([7.8, -3.1, -0.9])).cache()
    peels = fits.filter("case <> 'peel0'").select(F.col("case").alias("peel"), "year", F.col("ssb").alias("value"))
    return rounded(joins.mohns_rho(fits.filter("case = 'peel0'").select("year", F.col("ssb").alias("value")), peels))


@query("spatial_residuals")
def spatial_residuals(spark, sf):
    """Residual strata of a spatial fit to simulated data."""
    from lakewright.models.spatial import SpatialFit, dynamics, residual_table, simulate
    from lakewright.operators.aggregates import residual_strata

    data, p = spatial_data(order_effort(spark, sf)), SpatialFit(8.0, -3.0, -1.0)
    rows = spark.createDataFrame(residual_table(simulate(data, p, 7), dynamics(data, p)))
    return rounded(residual_strata(rows, ["component", "fleet"], ["year", "season", "region"]))


@query("spatial_reference_points")
def spatial_reference_points(spark, sf):
    """Maximum sustainable yield of a spatial stock at every nation's steepness; checked in the tests by long runs."""
    from lakewright.models.spatial import SpatialFit, reference_cases

    cases = table(spark, sf, "nation").select(F.col("n_name").alias("case"), (0.4 + F.col("n_nationkey") / 50).alias("steepness"))
    return rounded(reference_cases(cases, spatial_data(order_effort(spark, sf)), SpatialFit(8.0, -3.0, -1.0)), 4)


@query("spatial_projection")
def spatial_projection(spark, sf):
    """Ten years of a spatial stock under every supplier's multiple of recent fishing; checked in the tests by equilibria."""
    from lakewright.models.spatial import SpatialFit, project_cases

    cases = table(spark, sf, "supplier").select(F.col("s_name").alias("case"), (F.abs("s_acctbal") / 5000).alias("multiple"), F.lit(0.8).alias("steepness"))
    return rounded(project_cases(cases, spatial_data(order_effort(spark, sf)), SpatialFit(8.0, -3.0, -1.0), 10), 4)


def _ages(term: str) -> str:
    """The SQL sum of ``term`` over seven ages; N, S, W and M stand for an age's numbers, selectivity, weight and maturity."""
    return " + ".join(term.replace("N", f"n[{a}]").replace("S", f"s[{a}]").replace("W", f"w[{a}]").replace("M", f"m[{a}]") for a in range(1, 8))


def _left(a: int) -> str:
    return f"n[{a}] * exp(-0.2) * (1 - rate * s[{a}])"


_AGES = "[" + ", ".join(f"{a}.0" for a in range(1, 8)) + "]::DOUBLE[]"


@query(
    "ricker_stock",
    f"""WITH RECURSIVE g AS (SELECT c_nationkey AS k, year(o_orderdate) AS yr, count(*)::DOUBLE AS c, sum(o_totalprice)::DOUBLE / 1e5 AS i FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
o AS (SELECT k, c, i, row_number() OVER (PARTITION BY k ORDER BY yr) AS y, avg(c) OVER (PARTITION BY k) * 2 AS r0 FROM g),
a AS (SELECT list_transform({_AGES}, lambda a : 1 / (1 + exp(1.5 * (3 - a)))) AS s, list_transform({_AGES}, lambda a : 2 * (1 - exp(-0.4 * a)) ** 3) AS w, list_transform({_AGES}, lambda a : 1 / (1 + exp(3 - a))) AS m,
[{", ".join(f"exp(-{a} * 0.2)" + (" / (1 - exp(-0.2))" if a == 6 else "") for a in range(7))}]::DOUBLE[] AS n),
p AS (SELECT *, {_ages("N * W * M")} AS per FROM a),
b AS (SELECT k, 1 AS y, r0, s, w, m, per, list_transform(n, lambda x : r0 * x) AS n FROM o, p WHERE o.y = 1
UNION ALL SELECT k, y + 1, r0, s, w, m, per, [r0 * x * exp(1.5 * (1 - x) + ((y - 1) % 3 - 1) / 10.0::DOUBLE), {", ".join(_left(a) for a in range(1, 6))}, {_left(6)} + {_left(7)}]::DOUBLE[]
FROM (SELECT b.*, least(0.9, o.c / (exp(-0.1) * ({_ages("N * S * W")}))) AS rate, ({_ages("N * W * M")}) / (b.r0 * per) AS x FROM b JOIN o ON b.k = o.k AND b.y = o.y)),
e AS (SELECT o.k, o.y, o.r0, {_ages("N * W")} AS biomass, least(o.c, 0.9 * exp(-0.1) * ({_ages("N * S * W")})) AS removed, ln(o.i) - ln({_ages("N * W")}) AS e,
((o.y - 1) % 3 - 1) / 10.0::DOUBLE AS u, ((o.y + 1) % 3 - 1) / 10.0::DOUBLE AS v FROM b JOIN o ON b.k = o.k AND b.y = o.y)
SELECT k AS nation, round(arg_max(biomass, y), 6) AS biomass, round(sum(removed), 6) AS removed, round(0.5 * ((ln(any_value(r0)) - 7) / 5) ** 2 + 0.5 * ln(1.5) ** 2 + sum(0.5 * (e / 0.2) ** 2
+ CASE WHEN y = 1 THEN 0.5 * 0.75 * (u / 0.2) ** 2 + ln(0.2 / sqrt(0.75)) ELSE 0.5 * ((u - 0.5 * v) / 0.2) ** 2 + ln(0.2::DOUBLE) END), 6) AS objective FROM e GROUP BY k""",
)
def ricker_stock(spark, sf):
    """Joint objective, last biomass and removals of one Ricker stock per nation under its yearly orders as catches;
    weights follow a growth curve. The oracle runs the recursion by age in SQL."""
    import pandas as pd

    from lakewright.models.examples import RickerStock

    ages = np.arange(1, 8)
    weight, mature = 2 * (1 - np.exp(-0.4 * ages)) ** 3, 1 / (1 + np.exp(3.0 - ages))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        stock = RickerStock(pdf.i.to_numpy(), pdf.c.to_numpy(), weight, mature)
        theta, u = np.log([2 * pdf.c.mean(), 1.5]), (np.arange(len(pdf)) % 3 - 1) / 10
        b, removed = stock.series(theta, u)
        return pd.DataFrame({"nation": [pdf.k.iloc[0]], "biomass": [b[-1]], "removed": [removed.sum()], "objective": [stock.joint(theta, u)]})

    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("k"))
    met = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice").join(customers, "o_custkey")
    yearly = met.groupBy("k", "year").agg(F.count("*").cast("double").alias("c"), (F.sum("o_totalprice").cast("double") / 1e5).alias("i"))
    return rounded(yearly.groupBy("k").applyInPandas(run, "nation int, biomass double, removed double, objective double"))


@query("projection_uncertainty")
def projection_uncertainty(spark, sf):
    """Envelopes of scenario projections of the suppliers' typical balance, from draws of its terminal state: the mean
    logarithm over all suppliers and its variance."""
    from lakewright.models.surplus import SCENARIOS, project, projection_envelopes

    log_b = F.ln(F.greatest("s_acctbal", F.lit(100.0)))
    centre, variance = table(spark, sf, "supplier").agg(F.avg(log_b), F.var_samp(log_b) / F.count("*")).first()
    one = spark.createDataFrame([("s", math.exp(centre), 0.07 * math.exp(centre), 0.34, 8000.0, 1e-3)], "stock string, biomass double, recent_catch double, r double, k double, q double")
    cases = spark.createDataFrame(list(SCENARIOS.items()), "scenario string, catch_multiplier double")
    path = project(one, cases, years=10, start_year=2025, keys=["stock"])
    return rounded(projection_envelopes(path, centre, variance, 1e-3, samples=400), 4)


@query("streaming_summary", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1, 2""")
def streaming_summary(spark, sf):
    """The windowed summary as a batch; the tests run the same operator on a stream."""
    from lakewright.streaming.summaries import windowed_summary

    e = table(spark, sf, "events").select("ts", "event_type", "value")
    out = windowed_summary(e, time="ts", by=["event_type"], value="value")
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")))

