"""Special functions that Spark lacks, as Columns inside code generation.

lgamma, digamma and trigamma shift the argument up by eight and use asymptotic series there, which
leaves errors near 1e-13 for positive arguments. Other arguments give NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
NAN = float("nan")

# Coefficients of the asymptotic series (Bernoulli numbers over their factors).
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)

# Acklam's published coefficients of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425

# The five-term rational approximation of the normal distribution function.
NORMAL_P = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Polynomial with the highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def _series(s: Column, coefficients: tuple[float, ...]) -> Column:
    """sum of c_k * s**(-2k), k from 0."""
    return horner(F.lit(1.0) / (s * s), coefficients[::-1])


def lgamma(x: Column) -> Column:
    """log Gamma of a positive Column; null stays null, others are NaN."""
    x = x.cast("double")
    s = x + SHIFT
    product = x
    for k in range(1, SHIFT):
        product = product * (x + k)
    value = (s - 0.5) * F.ln(s) - s + 0.5 * math.log(2 * math.pi) + _series(s, LGAMMA_SERIES) / s - F.ln(product)
    big = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + _series(x, LGAMMA_SERIES) / x
    return F.when(x > 1e20, big).when(x > 0, value).when(x.isNotNull(), F.lit(NAN))


def digamma(x: Column) -> Column:
    x = x.cast("double")
    s = x + SHIFT
    back = sum((F.lit(1.0) / (x + k) for k in range(1, SHIFT)), F.lit(1.0) / x)
    return F.when(x > 0, F.ln(s) - 0.5 / s + _series(s, DIGAMMA_SERIES) / (s * s) - back).when(x.isNotNull(), F.lit(NAN))


def trigamma(x: Column) -> Column:
    x = x.cast("double")
    s = x + SHIFT
    back = sum((F.lit(1.0) / ((x + k) * (x + k)) for k in range(1, SHIFT)), F.lit(1.0) / (x * x))
    return F.when(x > 0, 1.0 / s + 0.5 / (s * s) + _series(s, TRIGAMMA_SERIES) / (s * s * s) + back).when(x.isNotNull(), F.lit(NAN))


def inverse_normal_cdf(p: Column) -> Column:
    """Standard normal quantile; an error outside (0, 1)."""
    p = p.cast("double")
    q = p - 0.5
    r = q * q
    centre = horner(r, ACKLAM_A) * q / horner(r, (*ACKLAM_B, 1.0))

    def tail(x: Column) -> Column:
        t = F.sqrt(-2.0 * F.ln(x))
        return horner(t, ACKLAM_C) / horner(t, (*ACKLAM_D, 1.0))

    value = F.when(p < ACKLAM_LOW, tail(p)).when(p <= 1 - ACKLAM_LOW, centre).otherwise(-tail(1.0 - p))
    return F.when(p.isNull(), F.lit(None)).when((p > 0) & (p < 1), value).otherwise(F.raise_error(F.lit("probability outside (0, 1)")).cast("double"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by the five-term approximation (absolute error below 1e-7)."""
    x = x.cast("double")
    t = F.lit(1.0) / (1.0 + NORMAL_P * F.abs(x))
    upper = F.exp(-0.5 * x * x) * (1 / math.sqrt(2 * math.pi)) * t * horner(t, NORMAL_B[::-1])
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    x = x.cast("double")
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def finite(x: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
