"""Cases that once gave a wrong value without a word."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.models.surplus import projection_envelopes
from lakewright.plans import expr as X
from lakewright.plans import laplace
from lakewright.plans.laplace import GroupedLaplace, NotConverged
from lakewright.plans.linalg import NotPositiveDefinite
from lakewright.plans.optimize import lbfgs


def poisson(rows):
    u, mu = X.random("u"), X.param("mu")
    return GroupedLaplace(rows, "g", X.exp(mu + u) - X.data("y") * (mu + u), X.normal_nll(u, 0.0, X.param("log_tau")), ["mu", "log_tau"])


def counts(spark, n=400, groups=7):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(int(k % groups), float(v)) for k, v in enumerate(rng.poisson(3, n))], "g int, y double").repartition(3)


def test_indefinite_groups_are_errors(spark):
    # (u**2 - 1)**2 has a positive curvature at its mode only where y is 1; where it is -1 the curve opens downwards
    u = X.random("u")
    row = X.data("y") * X.square(u) * 0.5
    rows = spark.createDataFrame([(1, 1.0), (2, -30.0)], "g int, y double")
    model = GroupedLaplace(rows, "g", row, X.normal_nll(u, 0.0, X.param("log_tau")), ["log_tau"])
    with pytest.raises(NotPositiveDefinite):
        model.evaluate(np.array([0.0]))
    value, _ = GroupedLaplace(rows.filter("g = 1"), "g", row, X.normal_nll(u, 0.0, X.param("log_tau")), ["log_tau"]).evaluate(np.array([0.0]))
    assert value == pytest.approx(0.5 * math.log(2.0))


def test_unfinished_modes_are_told(spark):
    model = poisson(counts(spark))
    model.solve_modes(np.array([-3.0, 1.0]), most=1)
    assert not model.converged
    model.solve_modes(np.array([-3.0, 1.0]))
    assert model.converged
    u = X.random("u")
    downhill = GroupedLaplace(counts(spark), "g", X.data("y") * -X.exp(u), X.normal_nll(u, 0.0, X.param("log_tau")), ["log_tau"])
    with pytest.raises((NotConverged, NotPositiveDefinite)):
        downhill.evaluate(np.array([0.0]))


def test_groups_in_slices_give_the_same(spark, monkeypatch):
    rows, theta = counts(spark), np.array([1.0, -0.5])
    whole = poisson(rows).evaluate(theta)
    monkeypatch.setattr(laplace, "SLICE_ROWS", 9)
    sliced = poisson(rows)
    assert sliced.sliced
    got = sliced.evaluate(theta)
    sliced.close()
    assert got[0] == pytest.approx(whole[0]) and np.allclose(got[1], whole[1])


def test_no_groups(spark):
    assert poisson(counts(spark).limit(0)).evaluate(np.array([0.0, 0.0]))[0] == 0.0


def test_lbfgs_steps_back_from_undefined_values():
    def f(x):
        if x[0] > 3:
            raise NotPositiveDefinite("too far")
        return float(-math.log(3.000001 - x[0]) - 4 * x[0] + x[0] ** 2), np.array([1 / (3.000001 - x[0]) - 4 + 2 * x[0]])

    out = lbfgs(f, np.array([-20.0]), tol=1e-6)
    assert out.converged and out.x[0] < 3


def test_long_paths_come_back_whole_and_alike(spark):
    path = spark.range(12_000).select(F.lit("s").alias("scenario"), F.col("id").alias("year"), (500.0 + F.col("id") % 7).alias("biomass"), F.lit(1.0).alias("index"))
    one = projection_envelopes(path, math.log(500.0), 0.01, 1e-3, samples=3)
    assert one.count() == 24_000
    short = path.filter("year < 5")
    a = projection_envelopes(short, math.log(500.0), 0.01, 1e-3, samples=50).orderBy("year", "quantity").collect()
    b = projection_envelopes(short.repartition(5), math.log(500.0), 0.01, 1e-3, samples=50).orderBy("year", "quantity").collect()
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a] == [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b]
    spread = [math.log(r.se) for r in a if r.quantity == "biomass"]
    assert abs(spread[0] - math.log(500 * 0.1)) < 0.35


def test_checkpoints_need_a_shared_folder():
    from lakewright import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        session.checkpoint_dir(Session())


def test_deterministic_surplus_fit(spark):
    from lakewright.models.surplus import fit_deterministic

    r, k, q, b, rows = 0.4, 800.0, 1.2e-3, 0.82 * 800.0, []
    for year in range(40):
        rows.append(("a", year, 20.0 + 60 * (10 < year < 22), q * b))
        b = b + r * b * (1 - b / k) - rows[-1][2]
    rows += [("a", 50, 1.0, None), ("b", 0, None, None)]
    got = {x.stock: x for x in fit_deterministic(spark.createDataFrame(rows, "stock string, year int, catch_mt double, index double"), "stock", "year", "catch_mt", "index").collect()}
    assert got["a"].r == pytest.approx(0.4, rel=0.05) and got["a"].k == pytest.approx(800, rel=0.05) and got["a"].q == pytest.approx(1.2e-3, rel=0.05)
    assert got["b"].k == pytest.approx(950, rel=1e-3)


def test_large_counts_have_a_density(spark):
    from lakewright.functions import distributions as d

    x, w = F.array(F.lit(4_000_000_000), F.lit(1_000_000_000)), F.array(F.lit(0.8), F.lit(0.2))
    got = spark.range(1).select(d.ddirichlet_multinomial_robust(x, w, 5.0).alias("a"), d.ddirichlet_multinomial(x, w, 5.0).alias("b")).first()
    assert got.a == pytest.approx(got.b, rel=1e-6)


def test_structured_matrices_agree():
    from lakewright.plans import linalg

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 40):
        d, e, b = rng.uniform(3, 4, (5, n)), rng.uniform(-1, 1, (5, n - 1)), rng.random((5, n))
        many = linalg.Tridiagonal(d, e)
        full = np.stack([np.diag(x) + np.diag(y, 1) + np.diag(y, -1) for x, y in zip(d, e, strict=True)])
        inverse = np.linalg.inv(full)
        assert np.allclose(many.logdet(), np.linalg.slogdet(full)[1]) and np.allclose(many.solve(b), np.einsum("kij,kj->ki", inverse, b))
        diag, off = many.inverse_band()
        assert np.allclose(diag, np.diagonal(inverse, 0, 1, 2)) and np.allclose(off, np.diagonal(inverse, 1, 1, 2))
        a = np.where(rng.random((n, n)) < 0.15, rng.uniform(-1, 1, (n, n)), 0)
        a = a + a.T + n * np.eye(n)
        i, j = np.nonzero(np.tril(a))
        s, before = linalg.Sparse(n, i, j, a[i, j]), dict(linalg.PATTERN_USES)
        assert np.allclose(s.logdet(), np.linalg.slogdet(a)[1]) and np.allclose(s.solve(b[0]), np.linalg.solve(a, b[0]))
        assert np.allclose(linalg.Sparse(n, i, j, 2 * a[i, j]).inverse_diagonal(), np.diag(np.linalg.inv(a)) / 2)
        assert linalg.PATTERN_USES["found"] == before["found"] + 1
        i, j = np.nonzero(a)
        assert s.trace_product(i, j, a[i, j]) == pytest.approx(n)
        for w in range(2, min(n, 5)):
            bands = [rng.uniform(9, 10, n), *(rng.uniform(-1, 1, n - k) for k in range(1, w + 1))]
            m = sum(np.diag(x, -k) + (np.diag(x, k) if k else 0) for k, x in enumerate(bands))
            f = linalg.Banded(bands)
            assert np.allclose(f.logdet(), np.linalg.slogdet(m)[1]) and np.allclose(f.solve(b[0]), np.linalg.solve(m, b[0])) and np.allclose(f.inverse_diagonal(), np.diag(np.linalg.inv(m)))
    for bad in (lambda: linalg.Tridiagonal(np.array([1.0, 0.1]), np.array([1.0])), lambda: linalg.Banded([np.ones(3), np.ones(2) * 2, np.zeros(1)]), lambda: linalg.Sparse(2, np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([1.0, 2.0, 1.0]))):
        with pytest.raises(NotPositiveDefinite):
            bad()


def test_hot_keys_are_joined_whole(spark):
    from lakewright.session import join_counted

    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(7)).when(F.col("id") < 2990, F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("k is not null and k <> 2500")
    got = {r.id: r.top for r in join_counted(rows, table, "k", "n", "id", "top").collect()}
    assert len(got) == 3000 and all(got[i] == (1999 if i < 2000 else None if i >= 2990 or i == 2500 else i) for i in range(3000))


def test_report_pages(spark):
    from lakewright.operators.sets import gather
    from lakewright.sinks import reports

    page = reports.markdown_page("Fit", {"Values": spark.createDataFrame([("a", 250.0)], "name string, value double"), "Text": "done"}, {"Values": "in tonnes"})
    assert page == "# Fit\n\n## Values\n\n| name | value |\n| --- | --- |\n| a | 250.0 |\n\nin tonnes\n\n## Text\n\ndone\n"
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(*gather(F.array(F.lit(1.0)), [3])).collect()
