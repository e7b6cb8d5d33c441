import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.functions import biology, distributions, special, text, transforms


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_lgamma_digamma_trigamma(spark):
    xs = [1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 7.9, 30.0, 1e4, 1e12, 1e25]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(special.lgamma(F.col("x")), special.digamma(F.col("x")), special.trigamma(F.col("x"))).collect()
    for x, (a, b, c) in zip(xs, got, strict=True):
        assert a == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)
        if x < 1e5:
            h = 1e-5 * x
            assert b == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5, abs=1e-4)
            assert c > 1 / x
    assert got[3][1] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert got[3][2] == pytest.approx(math.pi**2 / 6, abs=1e-12)
    odd = spark.createDataFrame([(None,), (-1.0,), (0.0,)], "x double").select(special.lgamma(F.col("x"))).collect()
    assert odd[0][0] is None and math.isnan(odd[1][0]) and math.isnan(odd[2][0])


def test_normal_and_logistic(spark):
    df = spark.createDataFrame([(x,) for x in (-800.0, -3.0, -0.5, 0.0, 1.2, 6.0, 800.0)], "x double")
    for x, cdf, lo in df.select("x", special.normal_cdf(F.col("x")), special.logistic(F.col("x"))).collect():
        assert cdf == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-7)
        assert 0 <= lo <= 1 and lo == pytest.approx(0.5 * (1 + math.tanh(x / 2)), abs=1e-12)
    p = spark.createDataFrame([(x,) for x in (1e-9, 0.01, 0.3, 0.5, 0.98, 1 - 1e-9)], "p double")
    for q, z in p.select("p", special.inverse_normal_cdf(F.col("p"))).collect():
        assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(q, rel=1e-6, abs=1e-8)
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(1.0,)], "p double").select(special.inverse_normal_cdf(F.col("p"))).collect()


def test_densities_sum_to_one(spark):
    df = spark.range(0, 400).select(F.col("id").cast("double").alias("x"))
    for d in (distributions.dpois(F.col("x"), 7.5, log=False), distributions.dnbinom2(F.col("x"), 9.0, 2.5, log=False)):
        assert df.agg(F.sum(d)).first()[0] == pytest.approx(1, abs=1e-9)
    b = df.filter("x <= 20").agg(F.sum(distributions.dbinom(F.col("x"), 20.0, 0.3, log=False))).first()[0]
    assert b == pytest.approx(1, abs=1e-9)
    grid = spark.range(1, 20000).select((F.col("id") / 1000.0).alias("x"))
    assert grid.agg(F.sum(distributions.dgamma(F.col("x"), 2.0, 1.5, log=False)) / 1000).first()[0] == pytest.approx(1, abs=1e-3)
    assert grid.filter("x < 1").agg(F.sum(distributions.dbeta(F.col("x"), 2.0, 3.0, log=False)) / 1000).first()[0] == pytest.approx(1, abs=1e-3)
    assert grid.agg(F.sum(distributions.dlnorm(F.col("x"), 0.1, 0.5, log=False)) / 1000).first()[0] == pytest.approx(1, abs=1e-3)


def test_compositions(spark):
    rows = [([a, b, 4 - a - b],) for a in range(5) for b in range(5 - a)]
    df = spark.createDataFrame(rows, "x array<int>")
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    for d in (distributions.dmultinom(F.col("x"), p, False), distributions.ddirichlet_multinomial(F.col("x"), p, 4.0, False), distributions.ddirichlet_multinomial_linear(F.col("x"), p, 0.25, False), distributions.ddirichlet_multinomial_robust(F.col("x"), p, 4.0, False)):
        assert df.agg(F.sum(d)).first()[0] == pytest.approx(1, abs=1e-9)
    zero = F.array(F.lit(0.0), F.lit(0.7), F.lit(0.3))
    got = df.select("x", distributions.ddirichlet_multinomial_robust(F.col("x"), zero, 4.0).alias("v")).collect()
    assert all((r.v == float("-inf")) == (r.x[0] > 0) for r in got)
    with pytest.raises(Exception, match="invalid"):
        df.select(distributions.ddirichlet_multinomial_robust(F.col("x"), p, -1.0)).collect()
    assert df.select(distributions.multinomial_deviance(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), p, 10.0)).first()[0] == pytest.approx(0)


def test_transforms(spark):
    rows = [(t, x) for t in transforms.TRANSFORMS for x in (-1.3, 0.4, 2.0)]
    df = spark.createDataFrame(rows, "t string, x double")
    t, x, h = F.col("t"), F.col("x"), 1e-6
    up, down = transforms.apply_transform(x + h, t), transforms.apply_transform(x - h, t)
    for r in df.select("t", "x", transforms.log_jacobian(x, t).alias("j"), F.ln(F.abs(up - down) / (2 * h)).alias("fd"), transforms.invert_transform(transforms.apply_transform(x, t), t).alias("back")).collect():
        assert r.j == pytest.approx(r.fd, abs=1e-6)
        assert r.back == pytest.approx(abs(r.x) if r.t == "square" else r.x)
    with pytest.raises(Exception, match="unknown"):
        df.select(transforms.apply_transform(x, F.lit("cube"))).collect()
    assert df.select(transforms.correlation_from_unconstrained(F.lit(0.0)), transforms.positive_from_unconstrained(F.lit(0.0))).first()[:] == (0.0, 1.0)


def test_biology(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(biology.beverton_holt(5000.0, 100.0, 5000.0, 0.7)) == pytest.approx(100)
    assert get(biology.beverton_holt(1000.0, 100.0, 5000.0, 0.7)) == pytest.approx(70)
    assert get(biology.logistic_selectivity(18.0, 10.0, 8.0)) == pytest.approx(0.95)
    assert get(biology.exposure(1e-9, 0.5)) == pytest.approx(0.5)
    assert get(biology.exposure(0.8, 0.5)) == pytest.approx((1 - math.exp(-0.4)) / 0.8)
    assert get(biology.growth(1.0, 30.0, 200.0, 0.2)) == pytest.approx(30) and get(biology.growth(15.0, 30.0, 200.0, 0.2)) == pytest.approx(200)
    assert get(biology.double_normal_selectivity(50.0, 50.0, 10.0, 3.0, 4.0)) == pytest.approx(1, abs=0.51)
    assert get(biology.selectivity(F.lit(0), 3.0, 1.0, 1.0)) == 1.0
    assert get(biology.surplus_production(10.0, 0.3, 100.0, 500.0)) == 1.0
    with pytest.raises(Exception, match="selectivity"):
        get(biology.selectivity(F.lit(7), 3.0, 1.0, 1.0))


def test_text(spark):
    rows = [("1.5",), (" 2 ",), ("nan",), ("inf",), ("x",), (None,), ("1e3",), ("0x1",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(text.finite_double(F.col("s"))).collect()] == [1.5, 2.0, None, None, None, None, 1000.0, None]
    assert [r[0] for r in df.select(text.strict_integer(F.col("s"))).collect()] == [None] * 8
    fields = spark.createDataFrame([("a",), ('b"c',), ("d,e",), ("f\ng",)], "s string")
    assert [r[0] for r in fields.select(text.csv_field(F.col("s"))).collect()] == ["a", '"b""c"', '"d,e"', '"f\ng"']
    key = text.row_key(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    back = text.parse_row_key(F.col("k"))
    assert spark.range(1).select(key.alias("k")).select(*[back[n] for n in "ysfr"]).first()[:] == (1, 2, 3, 4)
    seeds = {text.mix_seed(k) for k in range(1000)}
    assert len(seeds) == 1000 and all(0 <= s < 2**64 for s in seeds)
    assert np.mean([bin(text.mix_seed(k) ^ text.mix_seed(k + 1)).count("1") for k in range(500)]) == pytest.approx(32, abs=1)
