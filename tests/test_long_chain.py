import math

import numpy as np
import pytest

from lakewright.operators.ordered import PART
from lakewright.plans import expr as X
from lakewright.plans.laplace import ChainLaplace, NotConverged
from lakewright.plans.long_chain import LongChain
from tests.test_plans import chain


def test_like_one_task_with_newton_steps(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, float(y)) for s, n in ((1, 40), (2, 5), (3, 1)) for t, y in enumerate(rng.poisson(2.0, n))]
    df = spark.createDataFrame([*rows, (1, 99, None), (None, 1, 1.0)], "s int, t int, y double").repartition(3)
    model, theta = chain(), np.array([0.4, -0.5])
    long = LongChain(df, "s", ("t",), model, parts=5)
    assert not long.is_quadratic() and long.base.select(PART).distinct().count() >= 4
    got = {r.s: r for r in long.evaluate(theta).collect()}
    assert set(got) == {1, 2, 3}
    for s in got:
        y = np.array([r[2] for r in rows if r[0] == s])
        value, grad, _ = model.evaluate(theta, {"y": y}, np.zeros(len(y)))
        assert got[s].n == len(y) and got[s].value == pytest.approx(value, abs=1e-8)
        assert [got[s].d_a, got[s].d_s] == pytest.approx(list(grad), abs=1e-7)
    assert long.rounds > 2
    long.solve_modes(theta)
    assert long.rounds == 1  # from the modes


def test_steps_use_data_of_their_first_state(spark):
    u, v = X.random("u"), X.random("v")
    model = ChainLaplace(X.normal_nll(u, 0.0, 0.0), X.normal_nll(v, X.param("b") * u + X.data("x"), X.param("s")), X.normal_nll(X.data("y"), u, -0.3), ["b", "s"])
    rng = np.random.default_rng(1)
    rows = [(1, t, float(a), float(b)) for t, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    long = LongChain(spark.createDataFrame(rows, "s int, t int, x double, y double").repartition(3), "s", ("t",), model, parts=5)
    assert long.is_quadratic()
    got = long.evaluate(np.array([0.8, -0.2])).first()
    x, y = np.array([r[2:] for r in rows]).T
    value, grad, _ = model.evaluate(np.array([0.8, -0.2]), {"x": x, "y": y}, np.zeros(50))
    assert got.value == pytest.approx(value) and [got.d_b, got.d_s] == pytest.approx(list(grad), abs=1e-8) and long.rounds == 1


def test_trace_of_all_parameters_in_one_scan(spark):
    """The gradient is one aggregation over kept rows; parts are not sorted or shuffled again."""
    rows = [(1, t, float(t % 5)) for t in range(40)]
    long = LongChain(spark.createDataFrame(rows, "s int, t int, y double"), "s", ("t",), chain(), parts=4)
    out = long.evaluate(np.array([0.4, -0.5]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan and plan.count("Aggregate") == 1


def test_indefinite_series_and_no_rows(spark):
    u, v = X.random("u"), X.random("v")
    model = ChainLaplace(-1.0 * X.square(u), X.normal_nll(v, u, 1.0), X.num(0.0) * u, [])
    with pytest.raises(NotConverged, match="not positive"):
        LongChain(spark.createDataFrame([(1, t) for t in range(9)], "s int, t int"), "s", ("t",), model, parts=3).evaluate(np.zeros(0))
    assert LongChain(spark.createDataFrame([], "s int, t int, y double"), "s", ("t",), chain()).evaluate(np.array([0.4, math.log(0.6)])).collect() == []
