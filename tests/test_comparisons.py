import pytest
from pyspark.sql import functions as F

from lakewright.operators import comparisons as C


def frame(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(names))


def test_differences_in_standard_errors(spark):
    kind = ("k string", "v double")
    a, b = frame(spark, [("a", 1.0), ("b", 2.0), ("x", 9.0)], *kind), frame(spark, [("a", 1.5), ("b", 2.0), ("c", 1.0)], *kind)
    errors = frame(spark, [("a", 0.25), ("b", 0.0), ("c", 1.0)], "k string", "se double")
    out = C.standardised_differences(a, b, errors, ["k"], "v", "se")
    assert {r.k: (r.left, r.right, r.difference, r.in_errors) for r in out.collect()} == {"a": (1.0, 1.5, -0.5, -2.0), "b": (2.0, 2.0, 0.0, None), "c": (None, 1.0, None, None)}
    assert tuple(C.recovered(out).first()) == (3, 2, 2.0, False)
    good = out.filter("k = 'a'").withColumn("in_errors", F.lit(0.005))
    assert tuple(C.recovered(good).first()) == (1, 0, 0.005, True)
    assert tuple(C.recovered(good.limit(0)).first()) == (0, 0, None, False)


def test_steps_must_have_the_same_labels_in_order(spark):
    rows = [(k, f"q{k % 7}", 1.0 + k) for k in range(60)]
    fine = frame(spark, rows, "n int", "q string", "se double").repartition(4)
    coarse = fine.withColumn("se", F.col("se") * F.when(F.col("n") == 13, 1.001).otherwise(1.00001))
    out = C.step_sensitivity(coarse, fine, ["n"], "q", "se", parts=5).orderBy("place").collect()
    assert [r.place for r in out] == list(range(1, 61)) and [r.q for r in out] == [r[1] for r in rows]
    assert [r.place for r in out if r.sensitive] == [14] and out[0].change == pytest.approx(1e-5)
    with pytest.raises(ValueError, match="labels differ"):
        C.step_sensitivity(coarse.filter("n <> 30"), fine, ["n"], "q", "se")
    with pytest.raises(ValueError, match="labels differ"):
        C.step_sensitivity(coarse, fine.withColumn("n", -F.col("n")), ["n"], "q", "se")
    zero = fine.withColumn("se", F.lit(0.0))
    assert C.step_sensitivity(zero, zero, ["n"], "q", "se").filter("change is null and sensitive").count() == 60


def test_reported_figures(spark):
    ours = frame(spark, [("m", 1.0), ("k", 2.0), ("u", 3.0), ("z", 1.0)], "name string", "se double")
    names = frame(spark, [("m", "M_1"), ("k", "K_1"), ("z", "Z_1")], "name string", "label string")
    report = spark.createDataFrame([("M_1", "1.001"), ("K_1", "2.5"), ("Z_1", "_")], "label string, se string").withColumn("se", F.col("se").try_cast("double"))
    out = C.against_report(ours, names, report, name="name", label="label", value="se", expected=2)
    assert {r.name: r.within for r in out.collect()} == {"m": True, "k": False}
    with pytest.raises(ValueError, match="2 comparisons where 39"):
        C.against_report(ours, names, report, name="name", label="label", value="se", expected=39)
