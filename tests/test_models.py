import math

import numpy as np
import pytest

from lakewright.models import age_structured as ag
from lakewright.models import spatial, surplus
from lakewright.plans.catalog_models import seasonal_stock, spatial_data


def test_surplus(spark):
    stocks = spark.createDataFrame([("a", 100.0, 20.0, 0.3, 500.0, 0.01)], "stock string, biomass double, recent_catch double, r double, k double, q double")
    cases = spark.createDataFrame([("none", 0.0), ("all", 50.0)], "scenario string, catch_multiplier double")
    got = {(r.scenario, r.year): r.biomass for r in surplus.project(stocks, cases, years=3, start_year=2000, keys=["stock"]).collect()}
    b = 100.0
    for y in range(2000, 2003):
        b = max(1.0, b + 0.3 * b * (1 - b / 500))
        assert got["none", y] == pytest.approx(b)
    assert got["all", 2002] == 1.0
    path = surplus.project(stocks, cases, years=3, start_year=2000, keys=["stock"])
    env = surplus.projection_envelopes(path, math.log(100.0), 0.04, 0.01, samples=500).filter("quantity = 'biomass' and scenario = 'none' and year = 2000").first()
    assert env.lwr_95 < env.estimate < env.upr_95 and env.n_samples == 500
    assert surplus.projection_envelopes(path, 4.6, -1.0, 0.01).filter("mean is not null").count() == 0


def test_surplus_chain_gradient():
    model, n = surplus.chain_model(), 25
    t = np.arange(n)
    catch, index = 18 + 3 * np.sin(0.4 * t), 0.8 + 0.1 * np.cos(t)
    theta = np.array([math.log(1e-3), math.log(0.34), math.log(950.0)])
    value, grad, u = model.evaluate(theta, {"catch_mt": catch, "index": index}, np.full(n, math.log(780.0)))
    from lakewright.plans.optimize import finite_gradient, lbfgs

    assert np.allclose(grad, finite_gradient(lambda x: model.evaluate(x, {"catch_mt": catch, "index": index}, u)[0], theta), rtol=1e-4, atol=1e-3)
    r = lbfgs(lambda x: model.evaluate(x, {"catch_mt": catch, "index": index}, u)[:2], theta, most=60)
    assert r.converged and r.value < value


def test_survivorship_and_spr():
    n = ag.survivorship(np.full(4, 0.5))
    assert n[1] == pytest.approx(math.exp(-0.5)) and n[3] == pytest.approx(math.exp(-1.5) / (1 - math.exp(-0.5)))
    w, m = np.array([0.2, 0.6, 1.0, 1.4]), np.array([0.0, 0.3, 0.9, 1.0])
    sel = ag.logistic(2 * (np.arange(4) - 1.0))
    f = ag.f_at_spr(np.array([0.3, 0.5, 0.9]), 0.2, sel, w, m)
    ratio = ag.spawners_per_recruit(f, 0.2, sel, w, m) / ag.spawners_per_recruit(np.zeros(()), 0.2, sel, w, m)
    assert np.allclose(ratio, [0.3, 0.5, 0.9])
    assert np.isnan(ag.f_at_spr(np.array([1e-9]), 0.2, sel * 0, w, m))[0]


def test_age_structured_like_hand(spark):
    w, mat = [0.5, 1.0, 1.5], [0.0, 0.5, 1.0]
    rows = [(1, math.log(100.0), math.log(0.2), math.log(0.3), math.log(0.01), 1.5, 2.0)]
    got = ag.run_stocks(spark.createDataFrame(rows, "set long, log_r0 double, log_m double, log_fbar double, log_q double, a50 double, slope double"), 4, w, mat).orderBy("year").collect()
    s = 1 / (1 + np.exp(-2.0 * (np.arange(1, 4) - 1.5)))
    n = np.array([100.0, 100 * math.exp(-0.2), 100 * math.exp(-0.4) / (1 - math.exp(-0.2))])
    for r in got:
        z = 0.2 + 0.3 * s
        assert r.biomass == pytest.approx((n * w).sum())
        assert r["catch"] == pytest.approx((n * w * 0.3 * s / z * (1 - np.exp(-z))).sum())
        alive = n * np.exp(-z)
        n = np.array([100.0, alive[0], alive[1] + alive[2]])
    assert got[0].depletion == pytest.approx(1)


def test_hybrid_fishing_meets_catches():
    s = seasonal_stock()
    n, _ = s.unfished()
    sel = s.selectivity
    want = np.array([500.0, 0.0])
    f, caught = ag.hybrid_fishing(n, s.m, sel * s.weight[0], sel, want, 0.25)
    assert f[1] == 0 and caught[0] == pytest.approx(500, rel=1e-3)
    f, _ = ag.hybrid_fishing(n, s.m, sel * s.weight[0], sel, np.array([1e9, 0.0]), 0.25)
    assert f[0] <= 4.0 + 1e-9


def test_seasonal_stock():
    s = seasonal_stock()
    n, ssb0 = s.unfished()
    still = s.run(n.copy(), 30, pattern=np.zeros((4, 2)))
    assert still[-1]["ssb"] == pytest.approx(still[0]["ssb"], rel=0.05)
    p = np.full((4, 2), 0.1)
    b = s.benchmarks(p, spr_target=0.4)
    assert s.equilibrium(p * b["f_spr"])["spr"] == pytest.approx(0.4, abs=1e-6)
    top = s.equilibrium(p * b["f_msy"])["yield"]
    assert top >= max(s.equilibrium(p * b["f_msy"] * k)["yield"] for k in (0.9, 1.1)) - 1e-6
    x = s.resolve("annual_f", 0.2, p, n)
    assert s.run(n.copy(), 1, pattern=p * x)[0]["annual_f"] == pytest.approx(0.2, abs=1e-6)
    assert s.resolve("multiplier", 0.7, p, n) == 0.7 and s.resolve("ssb_ratio", 0.5, p, n) > 0
    with pytest.raises(ValueError):
        s.resolve("luck", 1, p, n)
    caught = s.run(n.copy(), 3, catches=np.full((3, 4, 2), 50.0))
    assert caught[0]["catch"] == pytest.approx(400, rel=1e-2)


def test_objective_components():
    import pandas as pd

    obs = pd.DataFrame({"catch_mt": [1.0, 2.0], "index": [0.0, 1.0]})
    out = ag.objective_components(obs, {"catch": np.array([1.0, 2.0]), "index": np.array([1e-12, 1.0])}, np.array([[0.5, 0.5]]), np.array([[2.0, 2.0]]), catch_sd=0.1, index_sd=0.2, effective_n=10)
    assert out["catch"] == pytest.approx(2 * math.log(0.1)) and out["age"] == pytest.approx(-10 * math.log(0.5))


def test_spatial(spark):
    d = spatial_data()
    d.validate()
    bad = spatial_data()
    bad.movement = bad.movement * 2
    with pytest.raises(ValueError):
        bad.validate()
    true = np.array([8.0, -3.0, -1.0])
    x, value, ok = spatial.fit(d, [true - 0.2, true + 0.3])
    r, best = spatial.dynamics(d, spatial.SpatialFit(*x)), spatial.dynamics(d, spatial.SpatialFit(*true))
    assert np.allclose(r["ssb"] / best["ssb"], 1, atol=0.1) and np.isfinite(value)
    assert d.peel(3).catch.shape[1] == 3 and d.scenario(m=1.5).m[0] == pytest.approx(0.45)
    sim = spatial.simulate(d, spatial.SpatialFit(*true), 3)
    assert np.allclose(sim.catch, spatial.simulate(d, spatial.SpatialFit(*true), 3).catch)
    table = spatial.residual_table(sim, best)
    assert len(table) == 2 * d.catch.size and abs(table.residual.std() - 1) < 0.15


def test_spatial_reference_points(spark):
    from dataclasses import replace

    d, p = spatial_data(), spatial.SpatialFit(8.0, -3.0, -1.0)
    f = spatial.fishing_pattern(d, p)
    # constant effort for many years comes to the solved equilibrium
    long = replace(d, **{k: np.repeat(d.effort[:, -3:].mean(1, keepdims=True), 120, 1) for k in ("effort", "catch", "index")})
    run, eq = spatial.dynamics(long, p), spatial.equilibrium(d, f, p.log_r0)
    assert run["ssb"][-1] == pytest.approx(eq["ssb"], rel=1e-9) and run["catch"][:, -1].sum() == pytest.approx(eq["yield"], rel=1e-9)
    assert spatial.equilibrium(d, 0 * f, p.log_r0)["ssb"] == pytest.approx(run["ssb0"], rel=1e-9)
    # with a stock-recruit curve, projections come to it as well
    far = spatial.project(d, p, 0.7, 600, steepness=0.6)
    eq = spatial.equilibrium(d, 0.7 * f, p.log_r0, 0.6)
    assert far["ssb"][-1] == pytest.approx(eq["ssb"], rel=1e-6) and far["yield"][-1] == pytest.approx(eq["yield"], rel=1e-6)
    assert spatial.equilibrium(d, 500 * f, p.log_r0, 0.3)["recruits"] == 0
    r = spatial.reference_points(d, p, steepness=0.6)
    near = spatial.equilibrium(d, r["f_msy"] * np.linspace(0.5, 1.5, 101)[:, None, None, None, None] * f, p.log_r0, 0.6)["yield"]
    assert not r["at_boundary"] and near.max() <= r["msy"] * (1 + 1e-9) and r["status_quo_f_ratio"] == pytest.approx(1 / r["f_msy"])
    assert spatial.reference_points(d, p, most=1e-3, doublings=1)["at_boundary"]
    with pytest.raises(ValueError):
        spatial.reference_points(replace(d, effort=0 * d.effort), p)
    for bad in (lambda: spatial.project(d, p, -1.0, 3), lambda: spatial.project(d, p, 1.0, 3, recruitment=np.ones(2)), lambda: spatial.equilibrium(d, f, 8.0, 0.2)):
        with pytest.raises(ValueError):
            bad()
    doubled = spatial.project(d, p, 1.0, 2, recruitment=np.array([2.0, 1.0]))
    assert doubled["ssb"][1] > spatial.project(d, p, 1.0, 2)["ssb"][1]
    cases = spark.createDataFrame([("a", 0.5, 0.7), ("b", 1.5, 0.7)], "case string, multiple double, steepness double")
    rows = spatial.project_cases(cases, d, p, 4).collect()
    assert len(rows) == 8 and spatial.project_cases(cases.limit(0), d, p, 4).count() == 0 and spatial.reference_cases(cases.limit(0), d, p).count() == 0
    assert {x["case"]: x["f_msy"] for x in spatial.reference_cases(cases, d, p).collect()}["a"] == pytest.approx(spatial.reference_points(d, p, steepness=0.7)["f_msy"])


def test_ricker_stock():
    from lakewright.models.examples import RickerStock, ar1_nll
    from lakewright.plans.dense import DenseLaplace

    ages = np.arange(1, 8)
    weight, maturity = 2 * (1 - np.exp(-0.4 * ages)) ** 3, 1 / (1 + np.exp(3.0 - ages))
    u = np.array([0.3, -0.1, 0.2])
    cov = 0.15**2 / (1 - 0.36) * 0.6 ** np.abs(np.subtract.outer(np.arange(3), np.arange(3)))
    assert ar1_nll(u, 0.6, 0.15) == pytest.approx(0.5 * u @ np.linalg.solve(cov, u) + 0.5 * np.linalg.slogdet(cov)[1])
    assert ar1_nll(np.zeros(0), 0.6, 0.15) == 0
    theta = np.array([8.0, 0.4])
    # without catches and deviations an unfished stock stays as it is
    idle = RickerStock(np.ones(9), np.zeros(9), weight, maturity).series(theta, np.zeros(0))
    assert np.allclose(idle[0], idle[0][0]) and not idle[1].any()
    small = RickerStock(np.ones(6), np.full(6, 500.0), weight, maturity)
    b, removed = small.series(theta, np.zeros(6))
    assert np.allclose(removed, 500) and (np.diff(b) < 0).any()
    # the first year's catch above what may be taken
    first = np.exp(8.0) * np.append(np.exp(-0.2 * np.arange(6)), np.exp(-1.2) / (1 - np.exp(-0.2)))
    at_hand = np.exp(-0.1) * (first * weight / (1 + np.exp(-1.5 * (ages - 3.0)))).sum()
    assert RickerStock(np.ones(6), np.full(6, 1e9), weight, maturity).series(theta, np.zeros(6))[1][0] == pytest.approx(0.9 * at_hand)
    # recruits of the second year by the curve's usual form, alpha * s * exp(-beta * s)
    s, a = (first * weight * maturity).sum(), np.exp(0.4)
    alpha, beta = np.exp(8.0) / s * np.exp(a), a / s
    more = small.series(theta, np.array([0.5, 0, 0, 0, 0, 0]))[0]
    assert (more - b)[1] == pytest.approx(weight[0] * alpha * s * np.exp(-beta * s) * (np.exp(0.5) - 1))
    true = np.array([0.1, -0.1, 0.15, 0.0, 0.1, 0.0])
    model = RickerStock(small.series(theta, true)[0], np.full(6, 500.0), weight, maturity)
    fit = DenseLaplace(model.joint, np.zeros(6)).fit(np.array([7.6, 0.2]), most=15, tol=0.05)
    assert abs(fit.x[0] - 8) < 0.3 and model.joint(theta, np.zeros(0)) > 0


def test_dense_laplace_like_chain():
    from lakewright.models.examples import latent_abundance
    from lakewright.plans.dense import DenseLaplace

    rng, model = np.random.default_rng(2), latent_abundance()
    u = np.cumsum(rng.normal(size=8) * 0.2)
    data = {"log_index": u + 0.1 * rng.normal(size=8), "log_cpue": u - 1 + 0.2 * rng.normal(size=8)}
    theta = np.array([-1.0, 0.0, -1.5, -2.0, -1.5])
    value, grad, mode = model.evaluate(theta, data, np.zeros(8))
    dense = DenseLaplace(lambda t, x: model.joint(t, x, data), np.zeros(8))
    assert dense.value(theta) == pytest.approx(value, abs=1e-3)
    assert np.allclose(dense.gradient(theta), grad, atol=2e-2)
    assert np.allclose(dense.sensitivity(theta), model.sensitivity(theta, mode, data), atol=1e-2)


def test_model_library(spark):
    from lakewright.models.examples import CatchAtAge, Recruitment, random_year_effects, selectivity_random_walk
    from lakewright.plans.dense import DenseLaplace
    from lakewright.plans.optimize import finite_gradient

    rng = np.random.default_rng(4)
    rows = [(y, float(1 + 0.5 * x + 0.2 * z + 0.1 * rng.normal()), float(x)) for y in range(6) for z in [rng.normal()] for x in rng.normal(size=5)]
    m = random_year_effects(spark.createDataFrame(rows, "year int, y double, x double"), "year", "y", "x")
    t = np.array([1.0, 0.5, -2.0, -1.5])
    assert np.allclose(m.evaluate(t)[1], finite_gradient(lambda p: m.evaluate(p)[0], t), rtol=1e-3, atol=1e-3)
    s, age = selectivity_random_walk(), np.arange(1.0, 11)
    k = np.round(20 / (1 + np.exp(-(age - 4))))
    t = np.array([4.0, 1.0, -1.0])
    data = {"age": age, "n": np.full(10, 20.0), "k": k}
    _, g, u = s.evaluate(t, data, np.zeros(10))
    assert np.allclose(g, finite_gradient(lambda p: s.evaluate(p, data, u)[0], t), atol=1e-4)
    weight = 2 * (1 - np.exp(-0.4 * np.arange(1, 8))) ** 3
    base = Recruitment(np.ones(6), np.ones(6), weight)
    b, c = base.series(np.array([8.0, -3.0]), np.zeros(6))
    r = Recruitment(b, c, weight)
    fit = DenseLaplace(r.joint, np.zeros(6)).fit(np.array([7.5, -3.3]), most=15, tol=0.05)
    assert np.allclose(fit.x, [8.0, -3.0], atol=0.3)
    caa = CatchAtAge(np.ones((4, 5)))
    seen = caa.expected(np.array([5.0, -1.0, -2.0]), np.zeros(8))
    caa = CatchAtAge(seen)
    u = DenseLaplace(caa.joint, np.full(8, 0.1)).mode(np.array([5.0, -1.0, -2.0]))
    assert np.abs(u).max() < 0.02 and caa.derived(np.array([5.0, -1.0, -2.0]), u)["fishing"].shape == (4,)
    assert caa.simulator()(np.concatenate([[5.0, -1.0, -2.0], u]), rng).shape == (4,)


def test_bounds_and_scaling():
    from lakewright.plans.optimize import bounded, finite_gradient, lbfgs, scaled

    f = lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3))
    inner, to, back = bounded(f, np.zeros(2), np.array([2.0, 5.0]))
    x = np.array([0.3, -0.4])
    assert np.allclose(back(to(x)), x) and np.allclose(inner(x)[1], finite_gradient(lambda z: inner(z)[0], x), atol=1e-6)
    assert np.allclose(to(lbfgs(inner, x, tol=1e-6).x), [2, 3], atol=1e-2)
    with pytest.raises(ValueError):
        back(np.array([0.0, 1.0]))
    g, to = scaled(f, np.zeros(2), np.array([[4.0, 1.0], [1.0, 2.0]]))
    assert np.allclose(to(lbfgs(g, np.ones(2), tol=1e-8).x), 3)


def test_scenarios_are_resolved_together(spark, monkeypatch):
    """As many calls of the model for 400 scenarios as for one, rows that repeat a name projected too."""
    s, p, kinds = seasonal_stock(), np.full((4, 2), 0.1), ("multiplier", "msy", "spr", "ssb_ratio", "annual_f")
    n, _ = s.unfished()
    targets, values = np.array([kinds[k % 5] for k in range(400)], object), 0.2 + np.arange(400) / 1000
    calls, one = [], ag.SeasonalStock.equilibrium
    monkeypatch.setattr(ag.SeasonalStock, "equilibrium", lambda self, f: calls.append(1) or one(self, f))
    x = s.resolve_all(targets, values, p, n)
    assert len(calls) < 600
    monkeypatch.undo()
    assert all(x[k] == pytest.approx(s.resolve(targets[k], values[k], p, n), rel=1e-9) for k in range(100, 110))
    with pytest.raises(ValueError):
        s.resolve_all(np.array([None], object), np.ones(1), p, n)
    cases = spark.createDataFrame([("a", "multiplier", 0.5), ("a", "multiplier", 1.5), ("b", "spr", 0.4)], "scenario string, target string, value double")
    got = ag.project_scenarios(cases, s, n, p, 3).collect()
    assert sorted((r.scenario, round(r.multiplier, 6), r.year) for r in got) == sorted((c, round(m, 6), y) for c, m in (("a", 0.5), ("a", 1.5), ("b", s.resolve("spr", 0.4, p, n))) for y in range(3))
    last = s.run(n, 3, pattern=p * 1.5)[-1]
    r = next(r for r in got if r.multiplier == 1.5 and r.year == 2)
    assert (r.ssb, r["catch"], r.annual_f) == pytest.approx((last["ssb"], last["catch"], last["annual_f"]))
