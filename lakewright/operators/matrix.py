"""Matrices as coordinate tables (i, j, value), symmetric ones stored in full.

Sums over entries are aggregates; eigenvalues and factorisations of small matrices run in numpy once the
size is checked (``to_numpy``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions.special import finite

#: Shares of total absolute curvature that sparsity and bandwidth are reported for.
TARGETS = (0.90, 0.95, 0.99, 0.999, 1.0)
#: The largest side of a matrix that comes to the driver.
DRIVER_SIDE = 4096


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch's list column without nulls, as a matrix; all must have one length."""
    column = batch.column(0).drop_null()
    offsets = np.asarray(column.offsets)
    width = np.diff(offsets)
    if not len(width):
        return np.zeros((0, 0))
    if (width != width[0]).any():
        raise ValueError("vectors differ in length")
    flat = np.asarray(column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64()).fill_null(float("nan")))
    x = flat.reshape(len(width), width[0])
    return x[~np.isnan(x).any(1)]


def covariance(rows: DataFrame, vector: str) -> DataFrame:
    """Sample covariance (i, j, value) of array columns, positions from 0.

    Two passes: means, then centred cross products, one small matrix per task by a matrix product; only
    those are shuffled, and the means (one number per position) are what comes to the driver. Rows that
    are null or hold a null or NaN are left out.
    """
    x = rows.select(vector)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            m = _stacked(batch)
            if len(m):
                n, total = n + len(m), m.sum(0) if total is None else total + m.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), n), pa.int64())], names=["i", "s", "n"])

    got = x.mapInArrow(sums, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n")).orderBy("i").collect()
    means = np.array([r.m for r in got])
    count = got[0].n if got else 0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross = np.zeros((len(means), len(means)))
        for batch in batches:
            m = _stacked(batch)
            if len(m):
                m = m - means
                cross += m.T @ m
        i, j = np.divmod(np.arange(cross.size), max(len(means), 1))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(cross.reshape(-1))], names=["i", "j", "c"])

    out = x.mapInArrow(products, "i int, j int, c double").groupBy("i", "j")
    return out.agg(F.try_divide(F.sum("c"), F.lit(float(count - 1))).alias("value"))


def with_diagonal(cov: DataFrame) -> DataFrame:
    d = cov.filter("i = j")
    di, dj = d.select("i", F.col("value").alias("di")), d.select("j", F.col("value").alias("dj"))
    return cov.join(di, "i").join(dj, "j")


def correlation(cov: DataFrame) -> DataFrame:
    """c / sqrt(vi vj), held in [-1, 1] within 1e-10; NaN where a variance is not positive or the value is farther out."""
    r = F.col("value") / F.sqrt(F.col("di") * F.col("dj"))
    ok = (F.col("di") > 0) & (F.col("dj") > 0)
    value = F.when(~ok, F.lit(float("nan"))).when(F.abs(r) <= 1, r).when(F.abs(r) <= 1 + 1e-10, F.signum(r)).otherwise(F.lit(float("nan")))
    return with_diagonal(cov).select("i", "j", value.alias("value"))


def lognormal_covariance(cov: DataFrame, estimates: DataFrame) -> DataFrame:
    """exp(xi) exp(xj) cov of log estimates (i, value)."""
    x = estimates.select(F.col("i").alias("a"), F.exp("value").alias("e"))
    out = cov.join(x.select(F.col("a").alias("i"), F.col("e").alias("ei")), "i").join(x.select(F.col("a").alias("j"), F.col("e").alias("ej")), "j")
    return out.select("i", "j", (F.col("value") * F.col("ei") * F.col("ej")).alias("value"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product by a join on the inner index."""
    x = a.select("i", F.col("j").alias("k"), F.col("value").alias("x"))
    y = b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def sandwich(jacobian: DataFrame, cov: DataFrame) -> DataFrame:
    """J C J'."""
    return multiply(multiply(jacobian, cov), transpose(jacobian))


def trace_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """trace(A B): sum of a(i, j) b(j, i), reading only entries that both have."""
    return a.join(transpose(b).withColumnRenamed("value", "w"), ["i", "j"]).agg(F.sum(F.col("value") * F.col("w")).alias("trace"))


def decay(corr: DataFrame) -> DataFrame:
    """Count, mean, least and greatest finite entry by lag j - i >= 0."""
    v = F.when(finite(F.col("value")), F.col("value"))
    return corr.filter("j >= i").groupBy((F.col("j") - F.col("i")).alias("lag")).agg(F.count(v).alias("count"), F.avg(v).alias("mean_correlation"), F.min(v).alias("min_correlation"), F.max(v).alias("max_correlation"))


def band_summary(coo: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Upper-triangle entries by distance from the diagonal, with shares and cumulative shares of absolute sums."""
    a = F.abs("value")
    out = coo.filter("j >= i").groupBy((F.col("j") - F.col("i")).alias("band_distance")).agg(F.count("*").alias("count"), F.count_if(a > tol).alias("nonzero_count"), F.avg(a).alias("mean_abs"), F.max(a).alias("max_abs"), F.sum(a).alias("sum_abs"))
    share = F.try_divide("sum_abs", F.sum("sum_abs").over(Window.partitionBy()))
    up = Window.orderBy("band_distance").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("share_sum_abs", share).withColumn("cumulative_share_sum_abs", F.sum("share_sum_abs").over(up))


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "target double")


def effective_sparsity(coo: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Entries, largest first, that hold each target share of total absolute value; all non-zeros for 1.

    Entries are summed by magnitude, in buckets of a sixteenth of a power of two, of which there are a few
    thousand at most; only the buckets in which a target is met, one per target, are put in order.
    """
    big = coo.filter(F.abs("value") > tol).select(F.abs("value").alias("a"), "i", "j", F.floor(16 * F.log2(F.abs("value"))).alias("b"))
    per = big.groupBy("b").agg(F.count("*").alias("n"), F.sum("a").alias("s"))
    up = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("upto", F.sum("s").over(up)).withColumn("before", F.coalesce(F.sum("n").over(up) - F.col("n"), F.lit(0))).withColumn("total", F.sum("s").over(Window.partitionBy()))
    met = run.withColumn("prior", F.col("upto") - F.col("s"))
    crossed = met.select("b", "before", "prior", "upto", "total", F.explode(F.array(*[F.lit(t) for t in TARGETS if t < 1])).alias("target")).filter((F.col("upto") >= F.col("target") * F.col("total")) & (F.col("prior") < F.col("target") * F.col("total")))
    inside = big.join(F.broadcast(crossed), "b")  # a row per target
    w = Window.partitionBy("target").orderBy(F.desc("a"), "i", "j")
    held = (F.col("prior") + F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, 0))) / F.col("total")
    need = inside.withColumn("k", F.col("before") + F.row_number().over(w)).withColumn("c", held).groupBy("target").agg(F.min(F.when(F.col("c") >= F.col("target"), F.col("k"))).alias("need"))
    count = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nonzeros"))
    out = _targets(coo.sparkSession).join(F.broadcast(need), "target", "left").crossJoin(count)  # a row per target, and one
    entries = F.coalesce("need", "nonzeros").cast("long")
    return out.select("target", entries.alias("entries_required"), F.try_divide("nonzeros", entries).alias("compression"))


def banded_entry_count(n: Column | int, b: Column | int) -> Column | int:
    """Cells of an n x n matrix within distance b of the diagonal."""
    return n * (2 * b + 1) - b * (b + 1)


def effective_bandwidth(coo: DataFrame, n: int) -> DataFrame:
    """Least bandwidth whose upper band holds each target share of absolute value; n - 1 for 1."""
    run = band_summary(coo).select("band_distance", "cumulative_share_sum_abs")
    first = [F.min(F.when(F.col("cumulative_share_sum_abs") >= t, F.col("band_distance"))) if t < 1 else F.lit(n - 1) for t in TARGETS]
    one = run.agg(F.array(*[F.coalesce(x, F.lit(n - 1)).cast("long") for x in first]).alias("e"))
    out = one.select(F.posexplode("e").alias("p", "bandwidth")).select(F.element_at(F.array(*[F.lit(t) for t in TARGETS]), F.col("p") + 1).alias("target"), "bandwidth")
    return out.withColumn("entries_if_banded", banded_entry_count(F.lit(n).cast("long"), F.col("bandwidth")))


def structure(coo: DataFrame, n: int, *, zero_tol: float = 1e-12, symmetry_tol: float = 1e-8, max_band: int = 64, dense_fill: float = 0.25, small: int = 16) -> DataFrame:
    """Structure and back-end of a square matrix from one pass of counts and a join with its transpose.

    Rules hold in order: diagonal, tridiagonal, banded, small dense, sparse, dense; a matrix that is not
    symmetric goes to the dense back-end.
    """
    big = coo.filter(F.abs("value") > zero_tol)
    other = transpose(coo).withColumnRenamed("value", "t")
    met = big.join(other, ["i", "j"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    rows = big.groupBy("i").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("max_row_nnz"))
    one = met.agg(
        F.count("*").alias("nnz"),
        F.count_if(F.col("i") == F.col("j")).alias("diagonal_nnz"),
        F.coalesce(F.max(F.abs(F.col("i") - F.col("j"))), F.lit(0)).cast("long").alias("bandwidth"),
        F.coalesce(F.max(F.abs(F.col("value") - F.col("t"))), F.lit(0.0)).alias("max_asymmetry"),
        F.coalesce(F.min(F.abs("t") > zero_tol), F.lit(True)).alias("structurally_symmetric"),
    ).crossJoin(rows)  # one row each
    fill, band = F.col("nnz") / F.lit(float(n) * n), F.col("bandwidth")
    sym = F.col("max_asymmetry") <= symmetry_tol
    detected = F.when(band == 0, "Diagonal").when(band == 1, "Tridiagonal").when((band <= max_band) & (fill < dense_fill), "Banded").when(fill < dense_fill, "Sparse").otherwise("Dense")
    backend = F.when(~sym, "DenseLDLT").when(band == 0, "Diagonal").when(band == 1, "Tridiagonal").when((band <= max_band) & (fill < dense_fill), "Banded").when(F.lit(n <= small), "DenseLDLT").when(fill < dense_fill, "SparseLDLT").otherwise("DenseLDLT")
    return one.withColumn("offdiagonal_nnz", F.col("nnz") - F.col("diagonal_nnz")).withColumn("fill_ratio", fill).withColumn("detected", detected).withColumn("backend", backend)


def pattern_summary(coo: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Non-zeros by place and the extremes of their absolute values."""
    a = F.abs("value")
    on = a > tol
    return coo.agg(
        F.count_if(on).alias("nnz"),
        F.count_if(on & (F.col("i") <= F.col("j"))).alias("upper_nnz"),
        F.count_if(on & (F.col("i") == F.col("j"))).alias("diagonal_nnz"),
        F.count_if(on & (F.col("i") != F.col("j"))).alias("offdiagonal_nnz"),
        F.max(a).alias("max_abs"),
        F.min(F.when(on, a)).alias("min_nonzero_abs"),
    )


def drop_small(coo: DataFrame, tol: float = 1e-12) -> DataFrame:
    return coo.filter(F.abs("value") > tol)


def band_limits(coo: DataFrame, widths: tuple[int, ...] = (0, 1, 2, 3, 5, 10, 20)) -> DataFrame:
    """Kept entries, retained absolute share and relative Frobenius error of each band limit, in one pass."""
    return _retained(coo, "bandwidth", [(F.lit(b), F.abs(F.col("i") - F.col("j")) <= b) for b in widths])


def threshold_limits(coo: DataFrame, absolute: tuple[float, ...] = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6)) -> DataFrame:
    """The same for entries of at least a threshold."""
    return _retained(coo, "threshold", [(F.lit(t), F.abs("value") >= t) for t in absolute])


def relative_threshold_limits(coo: DataFrame, shares: tuple[float, ...] = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6)) -> DataFrame:
    """The same for entries of at least a share of the largest absolute value."""
    top = coo.agg(F.max(F.abs("value")).alias("__top"))
    return _retained(coo.crossJoin(F.broadcast(top)), "threshold", [(F.lit(t), F.abs("value") >= t * F.col("__top")) for t in shares])  # one row


def _retained(coo: DataFrame, name: str, cases: list[tuple[Column, Column]]) -> DataFrame:
    v = F.col("value")
    each = [F.struct(label.alias(name), F.count_if(keep).alias("kept"), F.try_divide(F.sum(F.when(keep, F.abs(v)).otherwise(0.0)), F.sum(F.abs(v))).alias("share"), F.sqrt(F.try_divide(F.sum(F.when(keep, 0.0).otherwise(v * v)), F.sum(v * v))).alias("frobenius_error")) for label, keep in cases]
    return coo.agg(F.array(*each).alias("e")).select(F.explode("e").alias("e")).select("e.*")


def correlation_extremes(cov: DataFrame) -> DataFrame:
    """Extreme variances with their first index; the largest absolute correlation and its first pair; counts above 0.5, 0.8, 0.9."""
    v = cov.filter("i = j").agg(F.min(F.struct("value", "i")).alias("lo"), F.min(F.struct((-F.col("value")).alias("v"), "i")).alias("hi"))
    r = correlation(cov).filter("i < j").withColumn("a", F.abs("value"))
    c = r.agg(F.min(F.struct((-F.col("a")).alias("v"), "i", "j")).alias("top"), *[F.count_if(F.col("a") > t).alias(f"above_{int(10 * t)}") for t in (0.5, 0.8, 0.9)])
    out = v.crossJoin(c)  # one row each
    return out.select(F.col("lo.value").alias("min_variance"), F.col("lo.i").alias("min_index"), (-F.col("hi.v")).alias("max_variance"), F.col("hi.i").alias("max_index"), (-F.col("top.v")).alias("max_abs_correlation"), F.col("top.i").alias("pair_i"), F.col("top.j").alias("pair_j"), "above_5", "above_8", "above_9")


def top_pairs(cov: DataFrame, k: int = 10) -> DataFrame:
    """The k pairs of largest absolute correlation, ties in index order."""
    r = correlation(cov).filter("i < j").filter(finite(F.col("value")))
    return r.withColumn("abs_correlation", F.abs("value")).orderBy(F.desc("abs_correlation"), "i", "j").limit(k)


def geometry(hessian: DataFrame) -> DataFrame:
    """Column norms, diagonal and each norm's share of their sum by parameter."""
    per = hessian.groupBy("j").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"), F.max(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("diagonal"))
    return per.withColumn("share", F.try_divide("norm", F.sum("norm").over(Window.partitionBy())))


def to_bands(coo: DataFrame, width: int) -> DataFrame:
    """(band, values): the diagonals 0 to width of the lower triangle as arrays in order of position."""
    near = coo.filter((F.col("i") >= F.col("j")) & (F.col("i") - F.col("j") <= width))
    return near.groupBy((F.col("i") - F.col("j")).alias("band")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda s: s["value"]).alias("values"))


def active_directions(stack: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Directions of (direction, i, j, value) whose matrix has a Frobenius norm above the tolerance."""
    return stack.groupBy("direction").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm")).filter(F.col("norm") > tolerance)


def needed_columns(stack: DataFrame) -> DataFrame:
    """Columns in which any of the matrices has a non-zero entry."""
    return stack.filter("value <> 0").select("j").distinct()


def random_walk_traces(states: DataFrame, by: str, inverse: str, u: str, du: str, *, weight: float, weight_slope: float, rate: float, rate_slope: float) -> DataFrame:
    """trace(H**-1 dH) of a random walk with Poisson-like curvature, by direction, in one sum.

    Only the diagonal's own term moves: weight * weight_slope + rate * exp(u) * (rate_slope + du).
    """
    term = F.col(inverse) * (F.lit(weight * weight_slope) + rate * F.exp(u) * (rate_slope + F.col(du)))
    return states.groupBy(by).agg(F.sum(term).alias("trace"))


def to_numpy(coo: DataFrame, n: int) -> np.ndarray:
    """A dense array on the driver; refuses sides above ``DRIVER_SIDE``."""
    if n > DRIVER_SIDE:
        raise ValueError(f"a matrix of side {n} is too large for the driver")
    out = np.zeros((n, n))
    for r in coo.select("i", "j", "value").toLocalIterator():
        out[r.i, r.j] = r.value
    return out


def from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    i, j = np.nonzero(np.ones_like(a))
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "i int, j int, value double")


def pivot_wide(coo: DataFrame, n: int, labels: DataFrame | None = None, prefix: str = "c") -> DataFrame:
    """One row per i with columns for j; rows labelled, by number where a label is missing."""
    wide = coo.groupBy("i").pivot("j", list(range(n))).agg(F.first("value"))
    wide = wide.select("i", *[F.col(str(k)).alias(f"{prefix}{k}") for k in range(n)])
    if labels is None:
        return wide
    named = wide.join(labels.select("i", "label"), "i", "left")
    return named.select(F.coalesce("label", F.col("i").cast("string")).alias("label"), *[f"{prefix}{k}" for k in range(n)])
