import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.plans import expr as X
from lakewright.plans import inference, linalg, optimize, sampling
from lakewright.plans.laplace import LOG_2PI, ChainLaplace, GroupedLaplace, evaluate_series


def test_symbolic_derivatives_like_differences():
    p, u = X.param("p"), X.random("u")
    exprs = [X.exp(p * u), X.log(p + u * u), X.sqrt(p + 2) * u, X.sin(p) * X.cos(u), X.tan(p * 0.3), X.asin(p * 0.4), X.acos(u * 0.3), X.lgamma(p + 1), X.digamma(p + u), X.logistic(p * u), (p + u) ** -2.5, p / u, X.square(p - u), X.normal_nll(u, p, 0.3 * p)]
    for e in exprs:
        for by in (p, u):
            first = X.diff(e, by)
            for f, d in ((e, first), (first, X.diff(first, by)) if not X.leaves(e, "none") and "digamma" not in repr(e) else (e, first)):
                at = {p: np.array([0.7]), u: np.array([1.3])}
                h = 1e-5
                up, down = dict(at), dict(at)
                up[by], down[by] = at[by] + h, at[by] - h
                fd = (X.to_numpy(f, up) - X.to_numpy(f, down)) / (2 * h)
                assert np.allclose(X.to_numpy(d, at), fd, rtol=1e-5, atol=1e-6), (f, by)
    assert X.is_number(X.diff(X.exp(p), u), 0.0) and X.exp(p) is X.exp(p)


def test_columns_like_numpy(spark):
    e = X.logistic(X.data("x") * X.param("p")) + X.square(X.data("x")) ** 0.5 + X.lgamma(X.data("x") + 3) - X.data("x") ** 3
    df = spark.createDataFrame([(x,) for x in (-1.5, 0.2, 2.0)], "x double")
    got = [r[0] for r in df.select(X.to_column(e, {X.data("x"): F.col("x"), X.param("p"): F.lit(0.6)})).collect()]
    assert np.allclose(got, X.to_numpy(e, {X.data("x"): np.array([-1.5, 0.2, 2.0]), X.param("p"): 0.6}))


def dense_normal(y, mu, sigma, tau):
    c = sigma**2 * np.eye(len(y)) + tau**2
    r = y - mu
    return 0.5 * (r @ np.linalg.solve(c, r) + np.linalg.slogdet(c)[1] + len(y) * LOG_2PI)


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(20260814)
    rows = [(g, float(1.25 + 0.4 * z + 0.3 * rng.standard_normal())) for g in range(3) for z in [rng.standard_normal()] for _ in range(8)]
    u, mu = X.random("u"), X.param("mu")
    model = GroupedLaplace(spark.createDataFrame(rows, "g int, y double"), "g", X.normal_nll(X.data("y"), mu + u, X.param("log_sigma")), X.normal_nll(u, 0.0, X.param("log_tau")), ["mu", "log_sigma", "log_tau"])
    return rows, model


def test_grouped_laplace_is_exact_for_normal_models(grouped):
    rows, model = grouped
    theta = np.array([1.0, math.log(0.5), math.log(0.6)])
    value, grad = model.evaluate(theta)

    def closed(t):
        return sum(dense_normal(np.array([y for h, y in rows if h == g]), t[0], math.exp(t[1]), math.exp(t[2])) for g in range(3))

    assert value == pytest.approx(closed(theta), abs=1e-9)
    assert np.allclose(grad, optimize.finite_gradient(closed, theta), atol=1e-6)
    assert model.is_quadratic()


def test_grouped_laplace_newton_for_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.poisson(math.exp(1 + 0.5 * z)))) for g in range(12) for z in [rng.standard_normal()] for _ in range(5)]
    u, mu = X.random("u"), X.param("mu")
    row = X.exp(mu + u) - X.data("y") * (mu + u) + X.lgamma(X.data("y") + 1)
    model = GroupedLaplace(spark.createDataFrame(rows, "g int, y double"), "g", row, X.normal_nll(u, 0.0, X.param("log_tau")), ["mu", "log_tau"])
    assert not model.is_quadratic()
    theta = np.array([0.9, math.log(0.5)])
    value, grad = model.evaluate(theta)
    _, envelope = model.evaluate(theta, envelope=True)

    def by_hand(t):
        total, tau = 0.0, math.exp(t[1])
        for g in range(12):
            y = np.array([v for h, v in rows if h == g])
            m = 0.0
            for _ in range(60):
                lam = len(y) * math.exp(t[0] + m)
                m -= (lam - y.sum() + m / tau**2) / (lam + 1 / tau**2)
            lam = len(y) * math.exp(t[0] + m)
            joint = lam - y.sum() * (t[0] + m) + sum(math.lgamma(v + 1) for v in y) + 0.5 * LOG_2PI + t[1] + 0.5 * (m / tau) ** 2
            total += joint + 0.5 * math.log(lam + 1 / tau**2) - 0.5 * LOG_2PI
        return total

    assert value == pytest.approx(by_hand(theta), abs=1e-7)
    assert np.allclose(grad, optimize.finite_gradient(by_hand, theta), atol=1e-5)
    assert not np.allclose(grad, envelope, atol=1e-4)


def chain():
    u, v = X.random("u"), X.random("v")
    a, s = X.param("a"), X.param("s")
    return ChainLaplace(X.normal_nll(u, 0.0, 0.0), X.normal_nll(v, X.sin(a) * u + 0.2 * X.square(u) * 0.5, s), X.exp(u) - X.data("y") * u, ["a", "s"])


def test_chain_laplace_gradient_like_differences():
    y = np.random.default_rng(0).poisson(2.0, 40).astype(float)
    model, theta = chain(), np.array([0.4, -0.5])
    value, grad, u = model.evaluate(theta, {"y": y}, np.zeros(40))
    assert np.abs(model._gradient(theta, u, {"y": y})).max() < 1e-7
    fd = optimize.finite_gradient(lambda t: model.evaluate(t, {"y": y}, u)[0], theta)
    assert np.allclose(grad, fd, atol=1e-5)
    d, e = model.hessian(theta, u, {"y": y})
    dense = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert value == pytest.approx(model.joint(theta, u, {"y": y}) + 0.5 * np.linalg.slogdet(dense)[1] - 20 * LOG_2PI)
    h = 1e-5
    moved = (model.mode(theta + [h, 0], {"y": y}, u) - model.mode(theta - [h, 0], {"y": y}, u)) / (2 * h)
    assert np.allclose(model.sensitivity(theta, u, {"y": y})[:, 0], moved, atol=1e-4)


def test_series_in_parallel(spark):
    rows = [(k, t, float((t * (k + 3)) % 5), 0.0) for k in range(3) for t in range(20)]
    out = evaluate_series(spark.createDataFrame(rows, "k int, t int, y double, start double"), chain(), np.array([0.4, -0.5]), series="k", time="t", columns=["y"], start="start").collect()
    y = np.array([r[2] for r in rows if r[0] == 1])
    assert {r.k: r.value for r in out}[1] == pytest.approx(chain().evaluate(np.array([0.4, -0.5]), {"y": y}, np.zeros(20))[0])


@pytest.mark.parametrize("width", [0, 1, 3, 30])
def test_structured_backends_agree(width):
    rng, n = np.random.default_rng(width), 30
    a = np.zeros((n, n))
    for k in range(1, min(width, n - 1) + 1):
        a += np.diag(rng.uniform(-0.3, 0.3, n - k), k)
    a = a + a.T + np.diag(rng.uniform(1, 2, n) + 0.7 * width)
    f, b = linalg.backend_for(a), rng.standard_normal(n)
    assert type(f).__name__ == {0: "Diagonal", 1: "Tridiagonal", 3: "Banded", 30: "Dense"}[width]
    inv = np.linalg.inv(a)
    assert f.logdet() == pytest.approx(np.linalg.slogdet(a)[1], abs=1e-9)
    assert np.allclose(f.solve(b), inv @ b, atol=1e-9) and np.allclose(f.solve(np.eye(n)), inv, atol=1e-9)
    assert np.allclose(f.inverse_diagonal(), np.diag(inv), atol=1e-9)
    assert np.allclose(linalg.inverse_entries(f, [(0, 3), (5, 5)], n), [inv[0, 3], inv[5, 5]], atol=1e-9)
    if width == 1:
        assert np.allclose(f.inverse_band()[1], np.diag(inv, 1), atol=1e-9)
    du, c = rng.standard_normal((n, 2)), np.array([[0.5, 0.1], [0.1, 0.3]])
    assert np.allclose(linalg.marginal_variance(f.inverse_diagonal(), du, c), np.diag(inv + du @ c @ du.T))
    z, x = rng.standard_normal((7, n)), rng.standard_normal((7, 2))
    assert np.allclose(linalg.predictor_variance(f, z, x, du, c, block=3), np.diag(z @ inv @ z.T + (x + z @ du) @ c @ (x + z @ du).T))


def test_factor_failures():
    bad = -np.eye(3)
    with pytest.raises(linalg.NotPositiveDefinite):
        linalg.backend_for(bad)
    f, jitter = linalg.with_jitter(np.diag([1.0, 1.0, 0.0]))
    assert jitter > 0 and np.isfinite(f.logdet())
    assert linalg.covariance_from_hessian(bad) is None
    with pytest.raises(IndexError):
        linalg.inverse_entries(linalg.Diagonal(np.ones(2)), [(0, 5)], 2)
    a = np.diag([2.0, 3.0, 4.0])
    assert linalg.hutchinson_trace(linalg.Diagonal(np.diag(a)).solve, lambda z: a @ z, 3) == pytest.approx(3)
    s = linalg.spectral_summary(np.diag([4.0, 4.0, -1.0]))
    assert (s["positive"], s["negative"], s["k_50"]) == (2, 1, 2)
    assert linalg.diagnose_covariance(np.eye(2))["valid"] and not linalg.diagnose_covariance(-np.eye(2))["valid"]


def rosenbrock(x):
    a, b = 1 - x[0], x[1] - x[0] ** 2
    return a * a + 100 * b * b, np.array([-2 * a - 400 * x[0] * b, 200 * b])


def test_lbfgs():
    r = optimize.lbfgs(rosenbrock, np.array([-1.2, 1.0]), tol=1e-6, most=200)
    assert r.converged and np.allclose(r.x, 1, atol=1e-5)
    few = optimize.lbfgs(rosenbrock, np.array([-1.2, 1.0]), most=3)
    assert not few.converged
    rough = lambda x: (rosenbrock(x)[0], rosenbrock(x)[1] + 0.3)
    r = optimize.lbfgs(rough, np.array([-1.2, 1.0]), tol=1e-6, most=300, switch=(2.0, rosenbrock))
    assert r.converged
    best = optimize.multistart(rosenbrock, [np.array([-1.2, 1.0]), np.array([2.0, 2.0])], [np.array([True, False]), np.array([True, True])], tol=1e-6, most=300)
    assert best.value < 1e-8
    assert np.allclose(optimize.finite_hessian(lambda x: rosenbrock(x)[0], np.ones(2)), [[802, -400], [-400, 200]], rtol=1e-3)


def test_inference(spark):
    h = np.array([[4.0, 1.0], [1.0, 3.0]])
    c = inference.covariance_from_hessian(h)
    assert c.positive_definite and np.allclose(c.covariance, np.linalg.inv(h)) and c.correlation[0, 1] < 0
    assert not inference.covariance_from_hessian(np.diag([1.0, -1.0])).positive_definite
    est, se = inference.delta_scalar(lambda t: t[0] * t[1], np.array([2.0, 3.0]), c.covariance)
    g = np.array([3.0, 2.0])
    assert est == 6 and se == pytest.approx(math.sqrt(g @ c.covariance @ g), rel=1e-6)
    r = inference.fixed_effect_report(spark, ["a", "b"], np.array([1.0, 2.0]), c.covariance).orderBy("parameter").collect()
    assert r[0].upper - r[0].lower == pytest.approx(2 * 1.96 * r[0].std_error)
    j = inference.profiled_jacobian(np.eye(2), np.ones((2, 1)), np.array([[0.5, -0.5]]))
    assert np.allclose(j, [[1.5, -0.5], [0.5, 0.5]])
    d = inference.derived_report(spark, ["q", "z"], np.array([2.0, 0.0]), j, c.covariance).collect()
    assert d[0].cv == pytest.approx(d[0].std_error / 2) and d[1].cv is None
    assert np.allclose(inference.validated_curvature(h, h), h)
    for bad in (h + np.array([[0, 1], [0, 0]]), -h):
        with pytest.raises(ValueError):
            inference.validated_curvature(bad, bad)
    with pytest.raises(ValueError):
        inference.validated_curvature(h, h * 1.1)
    assert inference.profile_curvature(lambda x: 3 * x * x, 0.5)[1] == pytest.approx(1 / math.sqrt(6), rel=1e-4)
    assert np.allclose(inference.sensitivity(h, np.eye(2)), -np.linalg.inv(h))


def target():
    c = np.array([[1.0, 0.8], [0.8, 4.0]])
    p = np.linalg.inv(c)
    return lambda q: (-0.5 * float(q @ p @ q), -p @ q)


def test_leapfrog_keeps_energy():
    q, p = np.array([1.0, -0.5]), np.array([0.3, 0.7])
    f, metric = target(), np.ones(2)
    v, g = f(q)
    start = v - 0.5 * p @ p
    for _ in range(50):
        q, p, v, g = sampling.leapfrog(f, q, p, g, 0.05, metric)
    assert v - 0.5 * p @ p == pytest.approx(start, abs=1e-3)
    step = sampling.first_step(f, np.zeros(2), metric, np.random.default_rng(0))
    assert 1e-6 <= step <= 10


@pytest.mark.parametrize("dense", [False, True])
def test_nuts_moments(spark, dense):
    o = sampling.Options(warmup=300, draws=500, dense_mass=dense)
    draws = sampling.sample(spark, target, ["a", "b"], np.zeros(2), chains=4, options=o).cache()
    m = {r.parameter: r for r in draws.groupBy("parameter").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()}
    assert abs(m["a"].m) < 0.12 and abs(m["b"].m) < 0.25 and m["a"].s == pytest.approx(1, abs=0.12) and m["b"].s == pytest.approx(2, abs=0.2)
    again = sampling.sample(spark, target, ["a", "b"], np.zeros(2), chains=4, options=o)
    assert again.exceptAll(draws).count() == 0
    assert draws.select("divergences").distinct().first()[0] == 0
    with pytest.raises(ValueError):
        sampling.sample(spark, target, ["a", "a"], np.zeros(2))
    sim = sampling.simulate(draws, ["a", "b"], ["s"], lambda q, rng: q.sum(keepdims=True), healthy=True, every=5, most=37)
    assert sim.count() == 37 and sim.filter("iteration % 5 <> 0").count() == 0
    with pytest.raises(ValueError):
        sampling.simulate(draws, ["a", "b"], ["s"], None, healthy=False)


def test_flow():
    rng, mask = np.random.default_rng(0), np.array([1.0, 0.0])
    net = lambda: [(rng.normal(size=(4, 2)), rng.normal(size=4)), (rng.normal(size=(2, 4)) * 0.3, rng.normal(size=2))]
    flow = sampling.RealNVP(np.array([1.0, -1.0]), np.array([2.0, 0.5]), [(mask, net(), net()), (1 - mask, net(), net())])
    x = rng.normal(size=(6, 2))
    z, log_det = flow.forward(x)
    assert np.allclose(flow.inverse(z), x)
    h = 1e-6
    jac = np.stack([(flow.forward(x + h * e)[0] - flow.forward(x - h * e)[0]) / (2 * h) for e in np.eye(2)], 2)
    assert np.allclose(np.log(np.abs(np.linalg.det(jac))), log_det, atol=1e-5)
    assert np.isfinite(flow.log_density(x)).all()
