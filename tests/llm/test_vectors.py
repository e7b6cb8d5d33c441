import random

import numpy as np
import pytest

import lakewright.llm.neardup as nd
from lakewright.llm import topk
from lakewright.llm.neardup import Codes, near_duplicates, rotation, unit

from lakewright.llm.topk import Approximation, top_k

VECTORS = "vec_id long, embedding array<double>, label int"


def sample(n, dim, seed, groups=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for g in range(groups):
        a = rng.integers(0, n)
        for k in rng.integers(0, n, 6):
            x[k] = x[a] * rng.uniform(0.5, 2) + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.4, 0.5])
    return x


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] + [1.0] * 15, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]


def frame(spark, x, odd=True):
    rows = [(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(5000, rows[3][1], 1), (5001, rows[3][1], 2)]
    return rows, spark.createDataFrame(rows + (ODD if odd else []), VECTORS).repartition(3)


@pytest.mark.parametrize("cell", [64, 10_000])
def test_near_duplicates_like_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(nd, "CELL", cell)
    monkeypatch.setattr(nd, "TILE", 96)
    rows, df = frame(spark, sample(500, 16, 3, groups=40))
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    u = unit(np.array([r[1] for r in rows]))
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    ids = np.array([r[0] for r in rows])
    comp = ids.copy()
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    found = sum(got[i].n_links for i in ids)
    assert 0.95 * link.sum() <= found <= link.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(ids, comp, strict=True)]) > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    for i, *_ in ODD[:-1]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].kept


def test_near_duplicates_in_a_hot_group_over_many_cells(spark, monkeypatch):
    """A third of the vectors are near copies of one, spread over more than 50 cells."""
    monkeypatch.setattr(nd, "CELL", 4)
    monkeypatch.setattr(nd, "TILE", 256)
    rng = np.random.default_rng(7)
    u = unit(rng.standard_normal((1, 64)))
    hot = u + rng.uniform(0.18, 0.32, (1200, 1)) * unit(rng.standard_normal((1200, 64)))
    x = np.concatenate([hot, rng.standard_normal((2400, 64))])
    df = spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)], VECTORS).repartition(3)
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    link = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(link, False)
    assert link[:1200, :1200].mean() > 0.95
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.95 * link.sum()
    assert all(got[i].component_id == 0 for i in range(1200))


def test_repeated_ids_with_other_vectors_stay_apart(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.99, 0.01, 0.0], 0), (3, [0.0, 0.98, 0.02], 0), (4, [0.0, 0.0, 1.0], 0), (4, [0.0, 0.0, 1.0], 0)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    # each vector of id 1 links with one other; 2 and 3 meet through the id alone, not through a link
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]
    rows = [(7, [1.0, 0.0, 0.0], 0), (7, [0.0, 1.0, 0.0], 0), (5, [0.99, 0.01, 0.0], 0), (8, [0.0, 0.98, 0.02], 0)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(5, 1, 5, True), (7, 1, 5, False), (7, 1, 7, True), (8, 1, 7, False)]


@pytest.mark.parametrize("dim", [1, 2, 16, 64])
def test_tables_bring_threshold_pairs_together(dim, monkeypatch):
    monkeypatch.setattr(nd, "CELL", 4)
    rng = np.random.default_rng(dim)
    x, w = unit(rng.standard_normal((3000, dim))), rng.standard_normal((3000, dim))
    w -= (w * x).sum(1)[:, None] * x
    y = x if dim == 1 else 0.9 * x + np.sqrt(0.19) * unit(w)
    tables = nd.Tables.of(dim, 3000, 0.9, 0.99, 0)
    turns = tables.turns(0)
    assert (tables.deal(x, turns) == tables.deal(y, turns)).any(1).mean() > 0.97


def test_bounds_hold():
    x = unit(np.random.default_rng(0).standard_normal((400, 64)))
    codes = Codes.of(x, x[:50].mean(0), rotation(64, 1))
    upper = codes.upper(codes, slice(0, 400), 4.0)
    assert (upper + 1e-6 >= x @ x.T).mean() > 0.9995


def test_empty_tables(spark):
    df = spark.createDataFrame([], VECTORS)
    assert near_duplicates(df).count() == 0 and top_k(df).count() == 0
    only_odd = spark.createDataFrame(ODD, VECTORS)
    assert near_duplicates(only_odd).count() == len(ODD) and top_k(only_odd).count() == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_top_k_like_brute_force(spark, block):
    x = np.round(sample(330, 16, 5), 2)
    x[200:260] = x[100]  # ties
    rows, df = frame(spark, x)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df, block_queries=block, chunk_rows=50).collect()}
    q = {i: [int(np.floor(1024 * v)) for v in e] for i, e, _ in rows} | {9003: [0] * 16}
    want = {}
    for a in q:
        if a % 100 == 0:
            best = sorted((-sum(s * t for s, t in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:10]
            want |= {(a, k + 1): (b, -s) for k, (s, b) in enumerate(best)}
    assert got == want


def test_fewer_than_k_and_huge(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0], 0), (2, [1e300, 1.0], 0), (3, [1e306, 0.0], 0)], VECTORS).withColumn("score", df_lit())
    got = [(r.rank, r.vec_id, r.score) for r in top_k(df).orderBy("rank").collect()]
    assert got == [(1, 2, 2**63 - 1), (2, 3, 2**63 - 1), (3, 1, 1024 * 3 * 1024)]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit(7)


def test_approximation_bounds():
    rng = random.Random(1)
    x = np.array([[float(rng.randint(-600, 600)) for _ in range(12)] for _ in range(80)])
    a = Approximation.unpack(Approximation.of(x).pack())
    lower, upper = a.limits(x[:9])
    assert ((lower <= x[:9] @ x.T) & (x[:9] @ x.T <= upper)).all()


def test_few_exact_vectors_are_read(spark):
    x = np.random.default_rng(8).standard_normal((3000, 32))
    df = spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)], VECTORS)
    exact, cells = topk.files(df, k=10, scale=1024.0, chunk_rows=256, id_col="vec_id", vector_col="embedding")
    assert exact.count() == 3000 and cells.selectExpr("sum(octet_length(cells))").first()[0] < 1.3 * 3000 * 32
    queries = exact.filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "x")
    found = topk.candidates(queries, cells, k=10, block_queries=16)
    assert 30 * 10 <= found.count() < 0.02 * 30 * 3000


def test_equal_vectors_and_repeated_rows(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(0, 400)] + [(3, [1.0, 2.0], 1)] * 15 + [(500, [3.0, 0.0], 1), (501, [1.0, 2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = {}
    for r in top_k(df, query_every=3, k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got[3]) == [(1, 0), (2, 1), (3, 2), (4, 4)] and sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 3)]
    assert sorted(got[501]) == [(1, 0), (2, 1), (3, 2), (4, 3)]
