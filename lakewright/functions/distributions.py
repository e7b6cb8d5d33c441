"""Log densities and deviances as Columns. ``log=False`` gives the density itself.

Scalar arguments may be Columns or numbers; counts and proportions of composition densities are array
Columns of equal length. Null in, null out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewright.functions.special import lgamma

LOG_2PI = math.log(2 * math.pi)
Number = Column | float


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _out(value: Column, log: bool) -> Column:
    return value if log else F.exp(value)


def dnorm(x: Number, mean: Number, sd: Number, log: bool = True) -> Column:
    z = (col(x) - col(mean)) / col(sd)
    return _out(-0.5 * LOG_2PI - F.ln(col(sd)) - 0.5 * z * z, log)


def dlnorm(x: Number, meanlog: Number, sdlog: Number, log: bool = True) -> Column:
    return _out(dnorm(F.ln(col(x)), meanlog, sdlog) - F.ln(col(x)), log)


def dpois(x: Number, rate: Number, log: bool = True) -> Column:
    return _out(col(x) * F.ln(col(rate)) - col(rate) - lgamma(col(x) + 1), log)


def dbinom(x: Number, size: Number, p: Number, log: bool = True) -> Column:
    x, size, p = col(x), col(size), col(p)
    choose = lgamma(size + 1) - lgamma(x + 1) - lgamma(size - x + 1)
    return _out(choose + x * F.ln(p) + (size - x) * F.ln(1 - p), log)


def dgamma(x: Number, shape: Number, rate: Number, log: bool = True) -> Column:
    x, shape, rate = col(x), col(shape), col(rate)
    return _out(shape * F.ln(rate) - lgamma(shape) + (shape - 1) * F.ln(x) - rate * x, log)


def dbeta(x: Number, a: Number, b: Number, log: bool = True) -> Column:
    x, a, b = col(x), col(a), col(b)
    return _out(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x), log)


def dnbinom2(x: Number, mean: Number, size: Number, log: bool = True) -> Column:
    """Negative binomial with variance mean + mean**2 / size."""
    x, mean, size = col(x), col(mean), col(size)
    value = lgamma(x + size) - lgamma(size) - lgamma(x + 1) + size * F.ln(size / (size + mean)) + x * F.ln(mean / (size + mean))
    return _out(value, log)


def fold(array: Column, term, start: float = 0.0) -> Column:
    """Sum of ``term`` over an array."""
    return F.aggregate(array, F.lit(float(start)), lambda acc, v: acc + term(v))


def pairs(x: Column, p: Column) -> Column:
    return F.zip_with(x, p, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("p")))


def total(array: Column) -> Column:
    return fold(array, lambda v: v.cast("double"))


def dmultinom(x: Column, p: Column, log: bool = True) -> Column:
    """Multinomial log mass; classes of no count add nothing."""
    each = fold(pairs(x, p), lambda v: F.when(v.x > 0, v.x * F.ln(v.p)).otherwise(0.0) - lgamma(v.x + 1))
    return _out(lgamma(total(x) + 1) + each, log)


def _polya(x: Column, alpha: Column) -> Column:
    n, a = total(x), total(alpha)
    each = fold(pairs(x, alpha), lambda v: lgamma(v.x + v.p) - lgamma(v.p) - lgamma(v.x + 1))
    return lgamma(n + 1) + lgamma(a) - lgamma(n + a) + each


def ddirichlet_multinomial(x: Column, p: Column, theta: Number, log: bool = True) -> Column:
    """Dirichlet-multinomial with concentrations theta * p."""
    return _out(_polya(x, F.transform(p, lambda v: v * col(theta))), log)


def ddirichlet_multinomial_linear(x: Column, p: Column, theta: Number, log: bool = True) -> Column:
    """Dirichlet-multinomial with concentrations p / theta."""
    return _out(_polya(x, F.transform(p, lambda v: v / col(theta))), log)


#: Factors of a rising factorial that are multiplied one by one.
RISING = 512


def _rising_log(a: Column, n: Column) -> Column:
    """log of a (a+1) ... (a+n-1): factor by factor, from ``RISING`` factors on by Stirling's series, which has all
    digits there."""

    def stirling(z: Column) -> Column:
        return (z - 0.5) * F.ln(z) - z + 1 / (12 * z)

    few = F.aggregate(F.sequence(F.lit(0), (F.least(n, F.lit(RISING)) - 1).cast("int")), F.lit(0.0), lambda acc, k: acc + F.ln(a + k))
    rest = F.when(n > RISING, stirling(a + n) - stirling(a + RISING)).otherwise(0.0)
    return F.when(n <= 0, F.lit(0.0)).otherwise(few + rest)


def ddirichlet_multinomial_robust(x: Column, weight: Column, concentration: Number, log: bool = True) -> Column:
    """Dirichlet-multinomial in rising factorials, weights being normalised.

    Arguments are checked: lengths agree, counts are whole and not negative, weights are finite, not
    negative and not all zero, the concentration is positive; otherwise an error. A class of zero weight
    must have no count (else minus infinity) and adds nothing.
    """
    c, w = col(concentration), total(weight)
    ok = (
        (F.size(x) == F.size(weight))
        & (F.size(x) > 0)
        & (c > 0)
        & (c < float("inf"))
        & F.forall(x, lambda v: (v >= 0) & (v == F.floor(v)))
        & F.forall(weight, lambda v: (v >= 0) & (v < float("inf")))
        & (w > 0)
    )
    alpha = F.transform(weight, lambda v: c * v / w)
    each = fold(pairs(x, alpha), lambda v: F.when(v.x > 0, F.when(v.p > 0, _rising_log(v.p, v.x)).otherwise(F.lit(float("-inf")))).otherwise(0.0) - _rising_log(F.lit(1.0), v.x))
    value = _rising_log(F.lit(1.0), total(x)) - _rising_log(c, total(x)) + each
    return _out(F.when(ok, value).when(x.isNotNull() & weight.isNotNull(), F.raise_error(F.lit("invalid Dirichlet-multinomial arguments")).cast("double")), log)


def multinomial_deviance(observed: Column, expected: Column, n: Number) -> Column:
    """n * sum of o (log o - log e) over positive observations."""
    return col(n) * fold(pairs(observed, expected), lambda v: F.when(v.x > 0, v.x * (F.ln(v.x) - F.ln(v.p))).otherwise(0.0))


def age_comp_nll(observed: Column, predicted: Column, effective_n: Number, floor: float = 1e-12) -> Column:
    """Multinomial composition negative log likelihood with predictions floored and normalised."""
    held = F.transform(predicted, lambda v: F.greatest(v, F.lit(floor)))
    return -col(effective_n) * fold(pairs(observed, held), lambda v: v.x * F.ln(v.p / total(held)))


def lognormal_index_nll(log_expected: Number, observed: Number, se: Number, sd_offset: Number = 1) -> Column:
    """r**2 / 2 + sd_offset * log(se), r the standardised log residual."""
    r = (F.ln(col(observed)) - col(log_expected)) / col(se)
    return 0.5 * r * r + col(sd_offset) * F.ln(col(se))


def catch_residual(observed: Number, predicted: Number) -> Column:
    """log(1.1 * observed) - log(predicted + 0.1 * observed)."""
    return F.ln(1.1 * col(observed)) - F.ln(col(predicted) + 0.1 * col(observed))
