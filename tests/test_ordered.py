import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.operators import aggregates, ordered, windows
from lakewright.operators.ordered import Recurrence, before, in_order, row_number, running_sum, scan
from lakewright.plans.linalg import Tridiagonal


def series(spark, sizes, seed=0, **kinds):
    """(g, t, x): series of given lengths, shuffled."""
    rng = np.random.default_rng(seed)
    rows = [(g, t, float(rng.normal())) for g, n in sizes.items() for t in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([(None if g is None else int(g), int(t), float(x)) for g, t, x in rows], "g int, t int, x double").repartition(3)


@pytest.mark.parametrize("sizes", [{1: 900}, {k: 3 for k in range(200)}, {1: 400, 2: 1, 3: 1, 4: 300, None: 50}])
def test_recurrences_over_parts_like_loops(spark, sizes):
    df = in_order(series(spark, sizes), "g", "t", parts=12)
    by = ("g",)
    x = F.col("x")
    got = scan(
        df,
        Recurrence("y", by, x, F.lit(0.9), x),
        Recurrence("m", by, 3 + x * 0.1, 3 + x * 0.1, F.lit(-0.5), F.lit(1.0), F.lit(0.0)),
        Recurrence("r", by, x, F.lit(-0.5), x + 1, reverse=True),
        row_number("k", by),
        row_number("back", by, reverse=True),
        running_sum("s", by, x),
        before("prev", by, x),
        before("next", by, x, reverse=True),
    )
    rows = got.collect()
    assert len(rows) == sum(sizes.values())
    assert got.select(ordered.PART).distinct().count() > 6
    for g in sizes:
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.t)
        v = [r.x for r in own]
        y = m = s = None
        for k, r in enumerate(own):
            assert (r.k, r.back, r.t) == (k + 1, len(own) - k, k)
            assert r.y_in == (None if k == 0 else pytest.approx(y))
            y = v[k] if k == 0 else 0.9 * y + v[k]
            m = 3 + 0.1 * v[k] - (0 if k == 0 else 0.5 / m)
            s = v[k] if k == 0 else s + v[k]
            assert r.y == pytest.approx(y) and r.m == pytest.approx(m) and r.s == pytest.approx(s)
            assert r.prev_in == (v[k - 1] if k else None) and r.next_in == (v[k + 1] if k + 1 < len(v) else None)
        z = None
        for k in range(len(own) - 1, -1, -1):
            z = v[k] if z is None else -0.5 * z + v[k] + 1
            assert own[k].r == pytest.approx(z)


def test_one_series_reaches_over_many_tasks(spark):
    df = in_order(series(spark, {7: 2000}), "g", "t", parts=10)
    sizes = [r["count"] for r in df.groupBy(ordered.PART).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 600
    out = ordered.tridiagonal_pivots(df, ("g",), 2 + F.abs("x"), F.lit(-0.7))
    got = out.agg(F.sum(F.ln("pivot"))).first()
    total, v = 0.0, None
    for r in df.orderBy("t").collect():
        v = 2 + abs(r.x) - (0.0 if v is None else 0.49 / v)
        total += math.log(v)
    assert got[0] == pytest.approx(total, rel=1e-12)
    # rows never move: only the table of edges is shuffled
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_tridiagonal_systems_like_one_task(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, n in ((1, 300), (2, 1), (3, 2), (4, 90)):
        d, e, b = 2.5 + rng.random(n), rng.uniform(-1, 1, n), rng.normal(size=n)
        rows += [(g, t, float(d[t]), None if t == 0 else float(e[t]), float(b[t])) for t in range(n)]
        whole = Tridiagonal(d, e[1:])
        want[g] = (whole.solve(b), *whole.inverse_band())
    df = in_order(spark.createDataFrame(rows, "g int, t int, d double, e double, b double"), "g", "t", parts=9)
    by, e = ("g",), F.col("e")
    pivoted = ordered.tridiagonal_pivots(df, by, F.col("d"), e)
    solved = ordered.tridiagonal_inverse(ordered.tridiagonal_solve(pivoted, by, e, F.col("b")), by, e)
    for r in solved.collect():
        x, variance, covariance = want[r.g]
        assert r.solution == pytest.approx(x[r.t], rel=1e-9, abs=1e-12)
        assert r.variance == pytest.approx(variance[r.t], rel=1e-9)
        assert r.covariance == (None if r.t == 0 else pytest.approx(covariance[r.t - 1], rel=1e-9, abs=1e-12))


def test_a_pivot_of_zero_is_told_not_raised(spark):
    df = in_order(spark.createDataFrame([(1, t, 1.0) for t in range(20)], "g int, t int, x double"), "g", "t", parts=4)
    got = [r.pivot for r in ordered.tridiagonal_pivots(df, ("g",), F.col("x"), F.lit(1.0)).orderBy("t").collect()]
    assert got[:2] == [1.0, 0.0] and not all(p > 0 for p in got)


def test_empty(spark):
    df = in_order(spark.createDataFrame([], "g int, t int, x double"), "g", "t")
    assert scan(df, row_number("k", ("g",))).collect() == []
    assert ordered.average_ranks(spark.createDataFrame([], "g int, x double"), ["g"], "x").collect() == []


@pytest.mark.parametrize("parts", [3, 11])
def test_average_ranks_like_a_sort(spark, parts):
    rng = np.random.default_rng(parts)
    # one value holds a third of a group, so its ties reach over parts
    rows = [("a", float(v)) for v in rng.integers(0, 40, 400)] + [("a", 7.0)] * 200 + [("b", float(v)) for v in rng.normal(size=100)] + [(None, 1.0), (None, 1.0), ("c", 5.0), ("d", None), ("d", 2.0)]
    out = ordered.average_ranks(spark.createDataFrame(rows, "g string, x double").repartition(4), ["g"], "x", parts=parts).collect()
    assert len(out) == len(rows)
    for g in ("a", "b", "c", None):
        v = sorted(x for h, x in rows if h == g)
        for r in (r for r in out if r.g == g):
            low = v.index(r.x) + 1
            assert r["__rank"] == low + (v.count(r.x) - 1) / 2 and r["__n"] == len(v)
    assert sorted(r["__rank"] for r in out if r.g == "d") == [1.0, 2.0]


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=501)] + [("b", float(v)) for v in rng.integers(0, 3, 300)] + [("small", 1.0), ("small", 4.0), (None, 2.0), ("none", None), ("none", float("nan"))] + [(None, float(v)) for v in range(60)] + [("a", float("inf")), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    ps = {"lo": 0.025, "mid": 0.5, "p9": 0.9, "hi": 1.0}
    for large in (50, 0, None):
        got = {r.g: r for r in ordered.quantiles(df, ["g"], "x", ps, large=large, parts=7).collect()}
        assert set(got) == {"a", "b", "small", None, "none"}
        for g in got:
            v = [x for h, x in rows if h == g and x is not None and math.isfinite(x)]
            for n, p in ps.items():
                assert got[g][n] == (pytest.approx(np.quantile(v, p)) if v else None)


def test_summaries_without_a_buffer_of_a_whole_group(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(c, k, float(v)) for c in range(4) for k, v in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame([("p", *r) for r in rows], "par string, chain int, it int, x double")
    whole = (aggregates.envelope(df, ["par"], "x").first(), windows.chain_diagnostics(df, ["par"], "chain", ["it"], "x").first(), aggregates.bias_summary(df, ["par"], "x", "x").first())
    monkeypatch.setattr(ordered, "LARGE_GROUP", 100)
    ranged = (aggregates.envelope(df, ["par"], "x").first(), windows.chain_diagnostics(df, ["par"], "chain", ["it"], "x").first(), aggregates.bias_summary(df, ["par"], "x", "x").first())
    for a, b in zip(whole, ranged, strict=True):
        assert all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))
