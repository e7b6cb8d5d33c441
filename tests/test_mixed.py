import math

import numpy as np
import pytest

from lakewright.plans import expr as X
from lakewright.plans import laplace, optimize, sums
from lakewright.plans.laplace import GroupedLaplace
from lakewright.plans.linalg import NotPositiveDefinite
from tests.test_failures import counts, poisson


def crossed_rows(spark, groups=9, per=7, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        a, b = 0.5 * rng.standard_normal(2)
        for x in rng.uniform(-1, 1, per):
            rows.append((g, float(x), float(rng.poisson(math.exp(0.7 + a + b * x)))))
    return rows, spark.createDataFrame([*rows, (None, 1.0, 2.0), (1, None, 3.0), (2, 0.5, None)], "g int, x double, y double").repartition(3)


def two_effects(spark, rows):
    """Poisson counts with a correlated intercept and slope."""
    a, b, mu = X.random("a"), X.random("b"), X.param("mu")
    eta = mu + a + b * X.data("x")
    rho = 2 * X.logistic(X.param("z")) - 1
    za, zb, rest = a * X.exp(-X.param("la")), b * X.exp(-X.param("lb")), 1 - X.square(rho)
    prior = math.log(2 * math.pi) + X.param("la") + X.param("lb") + 0.5 * X.log(rest) + 0.5 * (X.square(za) - 2 * rho * za * zb + X.square(zb)) / rest
    return GroupedLaplace(rows, "g", X.exp(eta) - X.data("y") * eta, prior, ["mu", "la", "lb", "z"], ("a", "b"))


def by_hand(rows, theta):
    """The same marginal objective by numpy, group by group."""
    mu, la, lb, z = theta
    rho = 2 / (1 + math.exp(-z)) - 1
    cov = np.array([[math.exp(2 * la), rho * math.exp(la + lb)], [rho * math.exp(la + lb), math.exp(2 * lb)]])
    p, total = np.linalg.inv(cov), 0.0
    for g in sorted({r[0] for r in rows}):
        x, y = np.array([r[1:] for r in rows if r[0] == g]).T
        design, u = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
        for _ in range(100):
            lam = np.exp(mu + design @ u)
            h = design.T @ (lam[:, None] * design) + p
            u = u - np.linalg.solve(h, design.T @ (lam - y) + p @ u)
        lam = np.exp(mu + design @ u)
        h = design.T @ (lam[:, None] * design) + p
        total += (lam - y * (mu + design @ u)).sum() + 0.5 * u @ p @ u + 0.5 * np.linalg.slogdet(cov)[1] + 0.5 * np.linalg.slogdet(h)[1]
    return total


THETA = np.array([0.6, -0.5, -0.8, 0.3])


def test_two_effects_like_numpy(spark):
    rows, df = crossed_rows(spark)
    model = two_effects(spark, df)
    value, grad = model.evaluate(THETA)
    assert value == pytest.approx(by_hand(rows, THETA), abs=1e-8)
    assert np.allclose(grad, optimize.finite_gradient(lambda t: by_hand(rows, t), THETA), atol=1e-6)
    v, g, h = model.outer_hessian(THETA)
    assert v == pytest.approx(value) and np.allclose(g, grad)
    assert np.allclose(h, optimize.gradient_hessian(lambda t: model.evaluate(t)[1], THETA), atol=1e-5)
    assert np.allclose(h, optimize.finite_hessian(lambda t: by_hand(rows, t), THETA, 1e-3), atol=1e-3)
    s = {r.g: r for r in model.mode_sensitivity(THETA).collect()}
    assert len(s) == 9
    step = 1e-5
    moved = [{r.g: r for r in model.mode_sensitivity(THETA + d * step * np.eye(4)[1]).collect()} for d in (1, -1)]
    for g in s:
        assert s[g].d_a_la == pytest.approx((moved[0][g].a - moved[1][g].a) / (2 * step), abs=1e-5)
        assert s[g].covariance_a_a > 0 and s[g].covariance_a_a * s[g].covariance_b_b > s[g].covariance_a_b ** 2
    model.close()


def test_outer_hessian_of_one_effect_like_differences(spark):
    model = poisson(counts(spark))
    theta = np.array([0.9, -0.6])
    _, _, h = model.outer_hessian(theta)
    assert np.allclose(h, optimize.gradient_hessian(lambda t: model.evaluate(t)[1], theta), atol=1e-5)


def test_three_effects_of_a_normal_model(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), *map(float, rng.standard_normal(3))) for g in rng.integers(0, 6, 60)]
    u = [X.random(f"u{i}") for i in range(3)]
    mean = X.param("mu") + u[0] + u[1] * X.data("x") + u[2] * X.data("z")
    prior = sum((X.normal_nll(v, 0.0, X.param("lt")) for v in u), X.num(0.0))
    model = GroupedLaplace(spark.createDataFrame(rows, "g int, x double, z double, y double"), "g", X.normal_nll(X.data("y"), mean, X.param("ls")), prior, ["mu", "ls", "lt"], ("u0", "u1", "u2"))
    assert model.is_quadratic()
    theta = np.array([0.2, -0.1, -0.4])

    def closed(t):
        total = 0.0
        for g in {r[0] for r in rows}:
            a = np.array([r[1:] for r in rows if r[0] == g])
            d = np.column_stack([np.ones(len(a)), a[:, :2]])
            cov = math.exp(2 * t[2]) * d @ d.T + math.exp(2 * t[1]) * np.eye(len(a))
            r = a[:, 2] - t[0]
            total += 0.5 * (len(a) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + r @ np.linalg.solve(cov, r))
        return total

    value, grad, h = model.outer_hessian(theta)
    assert value == pytest.approx(closed(theta), abs=1e-9)
    assert np.allclose(grad, optimize.finite_gradient(closed, theta), atol=1e-6)
    assert np.allclose(h, optimize.finite_hessian(closed, theta, 1e-3), atol=2e-4)


def test_rounds_read_unfinished_groups_only(spark):
    # one group far from where the others end
    rows = [(g, float(y)) for g in range(40) for y in (2, 3, 4)] + [(99, 4000.0)] * 2
    model = poisson(spark.createDataFrame(rows, "g int, y double"))
    model.evaluate(np.array([1.1, 0.5]))
    assert model.converged and model.rounds[0] == (41, 122)
    assert model.rounds[-1][0] == 1 and model.rounds[-1][1] == 2
    assert all(a[0] >= b[0] for a, b in zip(model.rounds, model.rounds[1:], strict=False))
    # a second call starts from the modes and needs one round
    model.evaluate(np.array([1.1, 0.5]))
    assert len(model.rounds) == 1


def test_a_step_must_lower_the_objective(spark):
    """A full Newton step overshoots here: log(1 + u**2) is concave away from its mode."""
    u = X.random("u")
    rows = spark.createDataFrame([(1, 3.0), (2, -40.0), (3, 0.001)], "g int, y double")
    model = GroupedLaplace(rows, "g", X.log(1 + X.square(u - X.data("y"))), 0.001 * X.square(u), [], "u")
    modes = {r[0]: r[1] for r in model.solve_modes(np.zeros(0), most=60).collect()}
    assert model.converged
    for g, y in ((1, 3.0), (3, 0.001)):
        grid = np.linspace(y - 1, y + 1, 200001)
        assert modes[g] == pytest.approx(grid[np.argmin(np.log(1 + (grid - y) ** 2) + 0.001 * grid**2)], abs=1e-4)


def test_indefinite_blocks_are_errors(spark):
    a, b = X.random("a"), X.random("b")
    rows = spark.createDataFrame([(1, 1.0), (2, 3.0)], "g int, y double")
    model = GroupedLaplace(rows, "g", 0.5 * X.square(a) + 0.5 * X.square(b) + X.data("y") * a * b * 0.5, X.num(0.0), [], ("a", "b"))
    with pytest.raises(NotPositiveDefinite, match="1 of 2"):
        model.evaluate(np.zeros(0))


def test_slices_of_two_effects(spark, monkeypatch):
    _, df = crossed_rows(spark)
    whole = two_effects(spark, df).outer_hessian(THETA)
    monkeypatch.setattr(laplace, "SLICE_ROWS", 3)
    sliced = two_effects(spark, df)
    assert sliced.sliced
    got = sliced.outer_hessian(THETA)
    assert got[0] == pytest.approx(whole[0]) and np.allclose(got[1], whole[1]) and np.allclose(got[2], whole[2])


def test_plans_sum_few_things(spark):
    u, mu, ls = X.random("u"), X.param("mu"), X.param("log_sigma")
    model = GroupedLaplace(counts(spark), "g", X.normal_nll(X.data("y"), mu + u, ls), X.normal_nll(u, 0.0, X.param("log_tau")), ["mu", "log_sigma", "log_tau"])
    parts = model._parts(3, params=1)
    plan = model.plan(parts)
    # 13 derivatives; of data: a sum, a sum of squares about the mean, the rest are counts
    assert len(parts) == 13 and plan.static == [X.data("y")] and len(plan.moving) == 1
    assert len(model.plan(model._parts(4, params=2)).moving) == 1
    p = poisson(counts(spark))
    plan = p.plan(p._parts(4, params=2))
    assert plan.moving == [] and plan.static == [X.data("y")]
    # one kind of term in all derivatives of a count model with a covariate and two effects
    two = two_effects(spark, crossed_rows(spark)[1])
    plan = two.plan(two._parts(4, params=2))
    assert len(plan.moving) == 5 and len(plan.static) == 2 and len(two._parts(4, params=2)) > 90


def test_terms_add_up():
    rng = np.random.default_rng(0)
    x, y, p, u = X.data("x"), X.data("y"), X.param("p"), X.random("u")
    for e in (X.normal_nll(y, p + u * x, 0.3 * p), X.exp(p + u * x) - y * (p + u * x), (x * p) ** 3 * (y + u), X.square(p * (x + u)) / (y * p), X.num(2.0), p * u, X.lgamma(x + p) * u * 3, (x + y + p) * u * (p + 1)):
        for d in (e, X.diff(e, u), X.diff(X.diff(e, p), u)):
            at = {x: rng.uniform(1, 2, 5), y: rng.uniform(1, 2, 5), p: 0.7, u: 0.4}
            whole = np.broadcast_to(X.to_numpy(d, at), (5,)).sum()
            parts = sum(X.to_numpy(c, at) * np.broadcast_to(X.to_numpy(r, at), (5,)).sum() for c, r in sums.terms(d))
            assert all(not sums.uses(c, ("data",)) for c, _ in sums.terms(d))
            assert parts == pytest.approx(whole)


def test_statistics_are_summed_once(spark):
    """A count model's Newton rounds read one row per group, not observations."""
    model = poisson(counts(spark, 4000))
    theta = np.array([0.9, -0.6])
    model.evaluate(theta)
    found, _ = model._by_group(model.modes, theta, model._parts(2))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and "Aggregate [" not in plan


def test_no_rows_and_no_parameters(spark):
    model = two_effects(spark, crossed_rows(spark)[1].limit(0))
    value, g, h = model.outer_hessian(THETA)
    assert value == 0.0 and not g.any() and not h.any()


DIRECTIONS = "direction int, group int, name string, weight double"


def test_directions_like_differences_and_only_where_active(spark):
    rows, df = crossed_rows(spark, groups=5)
    model = two_effects(spark, df)
    named = [(1, 0, "a", 1.0), (1, 3, "b", -2.0), (2, 2, "a", 0.5), (2, 2, "a", 0.5), (3, 77, "a", 1.0), (4, 1, "nothing", 1.0), (5, 1, "a", 0.0)]
    out = model.curvature_along(THETA, spark.createDataFrame(named, DIRECTIONS)).collect()
    # no direction but 1 and 2 meets a group; groups 1 and 4 are not formed
    assert {(r.direction, r.g) for r in out} == {(1, 0), (1, 3), (2, 2)} and len(out) == 9
    modes = {r.g: (r.a, r.b) for r in model.mode_sensitivity(THETA).collect()}

    def block(g, a, b):
        x = np.array([r[1] for r in rows if r[0] == g])
        lam = np.exp(THETA[0] + a + b * x)
        return {(0, 0): lam.sum(), (0, 1): (lam * x).sum(), (1, 1): (lam * x * x).sum()}

    for r in out:
        a, b = modes[r.g]
        da, db = {(1, 0): (1, 0), (1, 3): (0, -2), (2, 2): (1, 0)}[r.direction, r.g]
        h = 1e-5
        want = (block(r.g, a + h * da, b + h * db)[r.i, r.j] - block(r.g, a - h * da, b - h * db)[r.i, r.j]) / (2 * h)
        assert r.value == pytest.approx(want, rel=1e-6)
    model.close()


def test_parameter_directions_are_log_determinants(spark):
    """At fixed modes the traces of a parameter's direction add up to the derivative of the log determinants."""
    _, df = crossed_rows(spark, groups=4)
    model = two_effects(spark, df)
    out = model.curvature_along(THETA, spark.createDataFrame([(7, None, "la", 1.0), (8, None, "mu", 1.0)], DIRECTIONS)).groupBy("direction").agg({"trace": "sum", "*": "count"}).collect()
    got = {r.direction: (r["sum(trace)"], r["count(1)"]) for r in out}
    # la changes two of three entries of each block, mu all
    assert got[7][1] == 4 * 2 and got[8][1] == 4 * 3
    modes = model.solve_modes(THETA)

    def logdet(theta):
        per, part = model._by_group(modes, theta, model._parts(2))
        return sum(math.log(r[model._name((0, 0))] * r[model._name((1, 1))] - r[model._name((0, 1))] ** 2) for r in per.collect())

    for d, k in ((7, 1), (8, 0)):
        e = 1e-5 * np.eye(4)[k]
        assert got[d][0] == pytest.approx((logdet(THETA + e) - logdet(THETA - e)) / 2e-5, rel=1e-5)


def test_directions_of_a_normal_model_are_dropped(spark):
    """The curvature of a normal model doesn't change along its effects or its mean: nothing is formed."""
    u, mu, ls = X.random("u"), X.param("mu"), X.param("ls")
    model = GroupedLaplace(counts(spark), "g", X.normal_nll(X.data("y"), mu + u, ls), X.normal_nll(u, 0.0, 0.0), ["mu", "ls"])
    assert set(model.active_names()) == {"ls"}
    got = model.curvature_along(np.zeros(2), spark.createDataFrame([(1, 0, "u", 1.0), (2, None, "mu", 1.0)], DIRECTIONS))
    assert got.collect() == []


def test_components_add_up(spark):
    _, df = crossed_rows(spark, groups=4)
    model = two_effects(spark, df)
    out = {r.component: r for r in model.components(THETA, {"rows": (model.row, X.num(0.0)), "effects": (X.num(0.0), model.prior), "nothing": (X.num(0.0), X.num(0.0))}).collect()}
    assert sum(r.value for r in out.values()) == pytest.approx(model.evaluate(THETA)[0])
    assert out["nothing"].value == 0 and sum(r.share for r in out.values()) == pytest.approx(1) and out["rows"].groups == 4
