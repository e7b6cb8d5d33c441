import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.plans import krylov
from lakewright.plans.krylov import System, crossed_system, quadrature
from lakewright.plans.linalg import NotPositiveDefinite


def factor(a):
    """Cholesky factor by columns, with no call of a threaded library."""
    a, low = a.copy(), np.zeros_like(a)
    for j in range(len(a)):
        low[j:, j] = a[j:, j] / np.sqrt(a[j, j])
        a[j + 1 :, j + 1 :] -= np.multiply.outer(low[j + 1 :, j], low[j + 1 :, j])
    return low


def solve(low, b):
    x = b.copy()
    for j in range(len(b)):
        x[j] /= low[j, j]
        x[j + 1 :] -= low[j + 1 :, j] * x[j]
    for j in reversed(range(len(b))):
        x[j] = (x[j] - (low[j + 1 :, j] * x[j + 1 :]).sum()) / low[j, j]
    return x


@pytest.fixture(scope="module")
def crossed(spark):
    """500 unknowns: 300 customers and 200 parts, some of them in very many lines."""
    rng = np.random.default_rng(0)
    c, p = np.minimum(rng.geometric(0.01, 3000) - 1, 299), np.minimum(rng.geometric(0.02, 3000) - 1, 199)
    c[:300], p[:200] = np.arange(300), np.arange(200)
    y = rng.normal(size=3000)
    rows = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(c, p, y, strict=True)] + [(None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "c long, p long, y double").repartition(5)
    z = np.zeros((3000, 500))
    z[np.arange(3000), c] = 1
    z[np.arange(3000), 300 + p] = 1
    h = np.einsum("ki,kj->ij", z, z) / 0.8**2 + np.diag([1 / 0.5**2] * 300 + [1 / 0.3**2] * 200)
    system, right = crossed_system(rows, {"c": 0.5, "p": 0.3}, "y", 0.8)
    return system, right, h, (z * y[:, None]).sum(0) / 0.8**2


def place(node):
    return node.factor * 300 + node.level


def test_solutions_like_dense(crossed):
    system, right, h, b = crossed
    assert system.side == 500
    run = system.solve(right, ["b"], steps=80, tol=1e-10)
    want = solve(factor(h), b)
    got = {place(r.node): r.b for r in run.solution.collect()}
    assert run.residual[0] <= 1e-10 and len(run.lengths) < 80
    assert np.allclose([got[k] for k in range(500)], want, atol=1e-8)


def test_log_determinant_and_trace_like_dense(crossed, spark):
    system, _, h, _ = crossed
    low = factor(h)
    want = 2 * np.log(np.diag(low)).sum()
    value, error = system.log_determinant(probes=8, steps=12)
    assert value == pytest.approx(want, rel=1e-3) and 0 < error < 2e-3 * want
    # signs depend on node and probe alone
    signs = [{r.node: r.z3 for r in d.select("node", *system._signs(range(2, 5))).collect()} for d in (system.diagonal, system.diagonal.repartition(3))]
    assert signs[0] == signs[1] and set(signs[0].values()) == {1.0, -1.0}
    # the derivative by the log precision of the second factor's effects
    other = system.diagonal.filter("node.factor = 1").select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1 / 0.3**2).alias("value"))
    exact = sum(solve(low, np.eye(500)[k])[k] for k in range(300, 500)) / 0.3**2
    trace, error = system.trace_of_inverse(other, probes=8, steps=12)
    assert abs(trace - exact) < max(5 * error, 0.02 * exact)


def test_a_step_is_one_shuffle(crossed):
    system, right, _, _ = crossed
    v = system.solve(right, ["b"], steps=1).solution.select("node", F.col("b").alias("v")).repartition("node").persist()
    v.count()
    plan = system.times(v, ["v"])
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.split("InMemoryRelation")[0].count("Exchange hashpartitioning") <= 2
    v.unpersist()


def test_several_right_hand_sides(spark):
    rows = [(0, 0, 4.0), (1, 1, 3.0), (2, 2, 5.0), (0, 1, 1.0), (1, 0, 1.0)]
    system = System(spark.createDataFrame(rows, "i long, j long, value double"))
    right = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 0.0)], "node long, u double, v double")
    run = system.solve(right, ["u", "v"], steps=9, tol=1e-12)
    got = {r.node: (r.u, r.v) for r in run.solution.collect()}
    assert got[0] == (pytest.approx(1 / 11), 0.0) and got[1] == (pytest.approx(7 / 11), 0.0) and got[2] == (0.0, 0.0)
    value, _ = system.log_determinant(probes=8, steps=5)
    assert value == pytest.approx(np.log(4 * 3 * 5 - 5), rel=0.05)


def test_indefinite_and_empty(spark):
    with pytest.raises(NotPositiveDefinite):
        System(spark.createDataFrame([(0, 0, -1.0)], "i long, j long, value double"))
    bad = System(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 3.0), (1, 0, 3.0)], "i long, j long, value double"))
    with pytest.raises(NotPositiveDefinite):
        bad.solve(spark.createDataFrame([(0, 1.0), (1, -1.0)], "node long, b double"), ["b"], steps=5)
    empty = System(spark.createDataFrame([], "i long, j long, value double"))
    assert empty.log_determinant() == (0.0, 0.0)
    assert empty.solve(spark.createDataFrame([], "node long, b double"), ["b"], steps=3).solution.collect() == []


def test_quadrature_of_a_diagonal():
    """Steps of conjugate gradients on diag(1, 2, 5) give the exact rule."""
    d, r = np.array([1.0, 2.0, 5.0]), np.ones(3)
    p, rr, a, b = r.copy(), 3.0, [], []
    for _ in range(3):
        a.append(rr / (p * d * p).sum())
        r = r - a[-1] * d * p
        b.append((r * r).sum() / rr)
        rr = (r * r).sum()
        p = r + b[-1] * p
    assert 3 * quadrature(np.array(a), np.array(b), np.log) == pytest.approx(np.log(10.0))


def test_blocks_hold_each_pair_once(spark, monkeypatch):
    """Steps meet packed blocks of bounded size, not rows of entries; nodes of any type, one without entries beside its own."""
    monkeypatch.setattr(krylov, "BLOCK", 40)
    monkeypatch.setattr(krylov, "CHUNK", 20)
    rng = np.random.default_rng(3)
    h = np.triu(rng.normal(size=(50, 50)) * (rng.random((50, 50)) < 0.2), 1)
    h[:, 49] = 0
    h = h + h.T + np.diag(np.full(50, 12.0))
    rows = [(f"n{i}", f"n{j}", float(h[i, j])) for i, j in zip(*np.nonzero(h), strict=True)]
    system = System(spark.createDataFrame([*rows, ("n0", "elsewhere", 1.0), ("elsewhere", "n0", 1.0), ("n1", "n49", None)], "i string, j string, value double"))
    assert system.chunks > 2 and system.side == 50
    blocks = system.blocks.select("block", F.length("values") / 8).collect()
    assert len(blocks) == len({b for b, _ in blocks}) <= system.chunks * (system.chunks + 1) // 2
    assert sum(n for _, n in blocks) == np.count_nonzero(np.triu(h, 1)) and max(n for _, n in blocks) < 120
    b = rng.normal(size=(50, 2))
    right = spark.createDataFrame([(f"n{k}", float(b[k, 0]), float(b[k, 1])) for k in range(1, 50)], "node string, u double, v double")
    run = system.solve(right, ["u", "v"], steps=20, tol=1e-9)
    b[0] = 0
    low = factor(h)
    got = {r.node: (r.u, r.v) for r in run.solution.collect()}
    assert len(got) == 50 and (run.residual <= 1e-9).all()
    assert np.allclose([got[f"n{k}"] for k in range(50)], np.stack([solve(low, b[:, 0]), solve(low, b[:, 1])], 1), atol=1e-7)
    system.close()
    with pytest.raises(ValueError):
        System(spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i long, j long, value double"))
