import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.operators import aggregates, graph, joins, matrix, sets, validation, windows


def coo(spark, a):
    return matrix.from_numpy(spark, np.asarray(a, float))


def test_matrix_products(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    got = matrix.to_numpy(matrix.multiply(coo(spark, a), coo(spark, b)), 3)
    assert np.allclose(got, a @ b)
    assert np.allclose(matrix.to_numpy(matrix.sandwich(coo(spark, a), coo(spark, b)), 3), a @ b @ a.T)
    assert matrix.trace_product(coo(spark, a), coo(spark, b)).first()[0] == pytest.approx(np.trace(a @ b))
    with pytest.raises(ValueError):
        matrix.to_numpy(coo(spark, a), 10_000)


def test_correlation_edges(spark):
    c = [[4.0, 2.0, 0.0], [2.0, 1.0 - 1e-12, 0.0], [0.0, 0.0, 0.0]]
    got = {(r.i, r.j): r.value for r in matrix.correlation(coo(spark, c)).collect()}
    assert got[0, 1] == 1.0 and math.isnan(got[0, 2]) and got[0, 0] == 1.0


@pytest.mark.parametrize(
    ("a", "detected", "backend"),
    [
        (np.eye(20), "Diagonal", "Diagonal"),
        (np.eye(20) * 2 + np.eye(20, k=1) + np.eye(20, k=-1), "Tridiagonal", "Tridiagonal"),
        (np.eye(40) * 5 + np.eye(40, k=3) + np.eye(40, k=-3), "Banded", "Banded"),
        (np.ones((10, 10)) + np.eye(10), "Dense", "DenseLDLT"),
        (np.eye(20) + np.eye(20, k=1), "Tridiagonal", "DenseLDLT"),
    ],
)
def test_structure(spark, a, detected, backend):
    r = matrix.structure(coo(spark, a).filter("value <> 0"), len(a)).first()
    assert (r.detected, r.backend) == (detected, backend)


def test_sparsity_and_bands(spark):
    a = coo(spark, np.eye(4) * 10 + np.eye(4, k=1) + np.eye(4, k=-1))
    s = {r.target: r.entries_required for r in matrix.effective_sparsity(a).collect()}
    assert s[1.0] == 10 and s[0.9] == 6
    b = {r.target: r for r in matrix.effective_bandwidth(a, 4).collect()}
    assert b[0.9].bandwidth == 0 and b[1.0].bandwidth == 3 and b[1.0].entries_if_banded == 16
    assert matrix.banded_entry_count(5, 1) == 13
    assert matrix.pattern_summary(a).first().nnz == 10
    t = {r.threshold: r.kept for r in matrix.threshold_limits(a).collect()}
    assert t[0.1] == 10
    wide = matrix.pivot_wide(a, 4, spark.createDataFrame([(0, "zero")], "i int, label string")).collect()
    assert sorted(r.label for r in wide) == ["1", "2", "3", "zero"]


def test_graph(spark):
    corr = np.eye(6)
    for i, j in ((0, 1), (1, 2), (3, 4)):
        corr[i, j] = corr[j, i] = 0.7
    c = coo(spark, corr)
    nodes, e = c.filter("i = j").select("i"), graph.edges(c)
    assert {r.i: r.component for r in graph.components(nodes, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert graph.diameter(nodes, e) == 2
    s = graph.graph_summary(nodes, e).first()
    assert (s.nodes, s.edges, s.max_degree, s.isolated, s.components) == (6, 3, 2, 1, 3)


def test_overrides_and_blocks(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, phase int")
    over = spark.createDataFrame([(1, "a", 2, 0.5), (2, "a", 4, 0.7), (3, "a", 6, 0.9)], "n int, k string, since int, w double")
    got = joins.last_override(rows, over, ["k"], at="phase", since="since", order="n", value="w", default=F.lit(1.0))
    assert {r.id: r.w for r in got.collect()} == {1: 0.7, 2: 1.0, 3: 1.0}
    blocks = spark.createDataFrame([(2, 1, 9, 1, 1.0), (1, 5, 9, 0, math.log(2)), (3, 9, 9, 2, 7.0)], "block int, lo int, hi int, code int, adjustment double")
    out = joins.interval_blocks(rows.withColumn("v", F.lit(3.0)), blocks, at="phase", base="v")
    assert {r.id: (r.adjusted, r.n_blocks) for r in out.collect()} == {1: (pytest.approx(7.0), 2), 2: (4.0, 1), 3: (7.0, 3)}
    with pytest.raises(ValueError):
        joins.interval_blocks(rows, blocks, at="phase", base="id", most=2)
    with pytest.raises(ValueError):
        joins.interval_blocks(rows, blocks.withColumn("code", F.lit(7)), at="phase", base="id")
    late = rows.select(F.lit(12.5).alias("m")).limit(1).select(*[c.alias(n) for n, c in joins.season_of_month(F.col("m")).items()]).first()
    assert late.season == 4 and late.time == pytest.approx(5 / 6)


def test_overrides_like_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)])) for i in range(400)]
    over = [(rng.randrange(80), rng.choice(["a", "a", "b", None]), rng.choice([None, *map(float, range(70))]), rng.choice([None, rng.random()])) for _ in range(300)]
    r = spark.createDataFrame(rows, "id int, k string, phase int").repartition(3)
    o = spark.createDataFrame(over, "n int, k string, since double, w double").repartition(3)
    for timed in (True, False):
        got = joins.last_override(r, o, ["k"], at="phase", since="since" if timed else None, order="n", value="w", default=F.lit(-1.0))
        assert got.columns == ["id", "k", "phase", "w"]
        want = {}
        for i, k, at in rows:
            met = [(n, w is not None, w or 0.0) for n, key, s, w in over if k is not None and key == k and (not timed or (s is not None and at is not None and s <= at))]
            want[i] = max(met)[2] if met and max(met)[1] else -1.0
        assert {x.id: x.w for x in got.collect()} == want and got.count() == len(rows)


def test_overrides_of_a_key_are_not_collected(spark, capsys):
    """A key's overrides don't become one array that all its rows hold."""
    r = spark.createDataFrame([(1, "a", 5)], "id int, k string, phase int")
    o = spark.createDataFrame([(1, "a", 2, 0.5)], "n int, k string, since int, w double")
    joins.last_override(r, o, ["k"], at="phase", since="since", order="n", value="w", default=F.lit(1.0)).explain()
    assert "collect_list" not in capsys.readouterr().out


def test_overrides_over_whole_tables(spark, tmp_path):
    from lakewright.plans import catalog

    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    day = datetime.datetime(1992, 1, 1)
    orders = [(k, names[k % 5], day + datetime.timedelta(days=9 * k)) for k in range(600)]
    part = [(p, 900.0 + p) for p in range(1, 701)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(part, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.o_orderkey: r.weight for r in catalog.QUERIES["asof_override"](spark, str(tmp_path)).collect()}
    want = {}
    for k, pr, at in orders:
        met = [(p, price / 1000) for p, price in part if names[p % 5] == pr and day + datetime.timedelta(days=7 * p) <= at]
        want[k] = pytest.approx(max(met)[1] if met else 1.0)
    assert got == want


def test_summaries_handle_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", nan, 1.0), ("a", 3.0, inf), ("b", None, 1.0)], "g string, r double, e double")
    got = {r.g: r for r in aggregates.residual_summary(rows, ["g"], "r", "e").collect()}
    assert got["a"].n == 1 and got["a"].sdnr is None and got["a"].rmse == 2.0 and got["b"].n == 0
    env = aggregates.envelope(rows, ["g"], "r").orderBy("g").collect()
    assert env[0].n_samples == 2 and env[0].se == pytest.approx(math.sqrt(2)) and env[1].median is None
    one = aggregates.envelope(rows.limit(1), ["g"], "r").first()
    assert one.se == 0.0
    q = spark.createDataFrame([(float(k),) for k in range(1, 5)], "x double").select(F.lit("s").alias("s"), "x")
    assert aggregates.envelope(q, ["s"], "x").first().median == 2.5
    assert aggregates.profiled_log_q(spark.createDataFrame([("a", 0.0, 1.0, 1.0, False)], "g string, b double, o double, s double, u boolean"), ["g"], "b", "o", "s", "u", True).first().log_q == 0.0


def test_validation(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, None), (2, float("nan"))], "k int, v double")
    assert validation.duplicate_keys(rows, ["k"]).collect() == [(1, 2)]
    assert validation.missing_keys(rows, ["k"], rows.filter("k = 1"), ["k"]).collect() == [(2,)]
    assert validation.rule_violations(rows, validation.finite_rules(["v"]), ["k"]).count() == 2
    with pytest.raises(ValueError, match="bad"):
        validation.require_empty(rows, "bad")
    assert {r.side for r in validation.key_sets_differ(rows.filter("k = 1"), rows.filter("k = 2"), ["k"]).collect()} == {"left", "right"}


def test_rhat_edges(spark):
    def r(values):
        rows = [(str(c), k, v) for c, vs in enumerate(values) for k, v in enumerate(vs)]
        return windows.split_rhat(spark.createDataFrame(rows, "split string, draw int, v double").withColumn("p", F.lit("x")), ["p"], "v").first().rhat

    assert r([[1.0, 1.0], [1.0, 1.0]]) == 1.0 and r([[1.0, 1.0], [2.0, 2.0]]) == float("inf")
    assert r([[1.0, 3.0], [1.0, 3.0]]) == pytest.approx(math.sqrt(0.5))


def reference_ess(split):
    m, n = split.shape
    mean, var = split.mean(1), split.var(1, ddof=1)
    plus = (n - 1) / n * var.mean() + mean.var(ddof=1)
    rho = [1 - (var.mean() - np.mean([(d[: n - k] * d[k:]).sum() / (n - k) for d in split - mean[:, None]])) / plus for k in range(1, n)]
    total, last = 0.0, math.inf
    for k in range(0, len(rho) - 1, 2):
        pair = rho[k] + rho[k + 1]
        if pair < 0:
            break
        last = min(last, pair)
        total += last
    return min(m * n, m * n / (1 + 2 * total))


def test_ess_and_diagnostics(spark):
    rng = np.random.default_rng(1)
    x = np.zeros((4, 101))
    for k in range(1, 101):
        x[:, k] = 0.7 * x[:, k - 1] + rng.normal(size=4)
    rows = spark.createDataFrame([("p", c, k, float(x[c, k])) for c in range(4) for k in range(101)], "p string, chain int, it int, v double")
    split = windows.split_chains(rows, ["p"], "chain", ["it"])
    got = split.groupBy("split").count().collect()
    assert len(got) == 8 and {r["count"] for r in got} == {50}
    halves = np.concatenate([x[:, :50], x[:, 51:]])
    assert windows.effective_sample_size(split, ["p"], "v").first().ess == pytest.approx(reference_ess(halves))
    d = windows.chain_diagnostics(rows, ["p"], "chain", ["it"], "v").first()
    assert 0.9 < d.rhat < 1.3 and 10 < d.bulk_ess < 400 and 0 < d.tail_ess <= 400
    chains = spark.createDataFrame([(0.9, 0, 0), (0.8, 0, 0)], "bfmi double, divergences int, depth_hits int")
    assert windows.health(windows.chain_diagnostics(rows, ["p"], "chain", ["it"], "v"), chains, rhat=2, ess=1).first().healthy
    constant = rows.withColumn("v", F.lit(1.0))
    assert windows.effective_sample_size(windows.split_chains(constant, ["p"], "chain", ["it"]), ["p"], "v").first().ess == 400


def test_ar1_like_hand(spark):
    x = [0.1, 0.5, -0.2, 0.9]
    rows = spark.createDataFrame([("s", t, v) for t, v in enumerate(x)], "s string, t int, x double")
    got = windows.ar1_logpdf(rows, ["s"], ["t"], "x", 0.3, 0.65, 0.8).first().logpdf

    def ld(v, m, s):
        return -0.5 * math.log(2 * math.pi) - math.log(s) - 0.5 * ((v - m) / s) ** 2

    want = ld(x[0], 0.3, 0.8 / math.sqrt(1 - 0.65**2)) + sum(ld(b, 0.3 + 0.65 * (a - 0.3), 0.8) for a, b in zip(x, x[1:], strict=False))
    assert got == pytest.approx(want, abs=1e-11)
    assert windows.ma1_process(rows, ["s"], ["t"], "x", 1.0, 0.5).count() == 3


def test_sets(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "id int, x double"), spark.createDataFrame([(3, 4.0)], "key int, y double")
    out = sets.union_align({"a": a, "b": b}, {"b": {"key": "id"}}).orderBy("id").collect()
    assert out[0].x == 2.0 and out[0].y is None and out[1].engine == "b"
    assert sets.metrics(a, ["x"], "s").first()[:] == ("s", "x", 2.0)


def test_stacks(spark):
    stack = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 3, 0.0), (1, 0, 0, 0.0)], "direction int, i int, j int, value double")
    assert [r.direction for r in matrix.active_directions(stack).collect()] == [0]
    assert [r.j for r in matrix.needed_columns(stack).collect()] == [1]
    a = coo(spark, np.diag([1.0, 2.0, 3.0]) + np.diag([4.0, 5.0], -1))
    assert {r.band: r["values"] for r in matrix.to_bands(a, 1).collect()} == {0: [1, 2, 3], 1: [4, 5]}
    s = spark.createDataFrame([("d", 0.5, 0.0, 1.0), ("d", 0.25, math.log(2), 0.0)], "d string, inv double, u double, du double")
    got = matrix.random_walk_traces(s, "d", "inv", "u", "du", weight=2.0, weight_slope=0.5, rate=3.0, rate_slope=0.1).first()
    assert got["trace"] == pytest.approx(0.5 * (1 + 3 * 1.1) + 0.25 * (1 + 6 * 0.1))


def test_blocks_by_pieces_like_one_after_the_other(spark, monkeypatch):
    rng = np.random.default_rng(0)
    blocks = [(int(rng.integers(9)), float(lo), float(lo + rng.integers(0, 4)), int(rng.integers(3)), float(rng.normal())) for lo in rng.integers(0, 20, 25)] + [(1, None, 3.0, 1, 1.0), (1, 5.0, 4.0, 1, 1.0)]
    points = [(k, float(x), float(v)) for k, (x, v) in enumerate(zip(rng.integers(-2, 50, 200) / 2, rng.normal(size=200), strict=True))] + [(900, None, 2.0), (901, float("nan"), 3.0), (902, 3.0, None)]
    rows, table = spark.createDataFrame(points, "id int, x double, v double"), spark.createDataFrame(blocks, "block int, lo double, hi double, code int, adjustment double")
    found = []
    for edges in (256, 0):
        monkeypatch.setattr(joins, "MOST_EDGES", edges)
        found.append({r.id: (r.adjusted, r.n_blocks) for r in joins.interval_blocks(rows, table, at="x", base="v").collect()})
    assert found[0].keys() == found[1].keys()
    for k in found[0]:
        assert found[0][k] == (pytest.approx(found[1][k][0]) if found[1][k][0] is not None else None, found[1][k][1])
    assert found[0][900] == (2.0, 0) and found[0][901] == (3.0, 0)
