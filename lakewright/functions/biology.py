"""Growth, selectivity, mortality and recruitment as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewright.functions.distributions import Number, col
from lakewright.functions.special import logistic


def growth(age: Number, l_min: Number, l_max: Number, k: Number, a_min: float = 1.0, a_max: float = 15.0) -> Column:
    """Von Bertalanffy length at age through (a_min, l_min) and (a_max, l_max); linear below a_min."""
    age, l_min, l_max, k = col(age), col(l_min), col(l_max), col(k)
    limit = l_min + (l_max - l_min) / (1 - F.exp(-k * (a_max - a_min)))
    curve = limit + (l_min - limit) * F.exp(-k * (age - a_min))
    return F.when(age < a_min, l_min * age / a_min).otherwise(curve)


def weight_at_length(length: Number, a: Number, b: Number) -> Column:
    return col(a) * F.pow(col(length), col(b))


def logistic_selectivity(x: Number, inflection: Number, width: Number) -> Column:
    """Half at ``inflection``, 95 % one ``width`` above it."""
    return logistic(math.log(19.0) * (col(x) - col(inflection)) / col(width))


def double_normal_selectivity(x: Number, peak: Number, top: Number, log_ascend: Number, log_descend: Number) -> Column:
    """Two half normals around a plateau from ``peak`` to ``peak + top``, joined by steep logistic switches."""
    x, peak, top = col(x), col(peak), col(top)
    rise = F.exp(-((x - peak) ** 2) / F.exp(col(log_ascend)))
    fall = F.exp(-((x - peak - top) ** 2) / F.exp(col(log_descend)))
    left = logistic(20.0 * (x - peak) / (1 + F.abs(x - peak)))
    right = logistic(20.0 * (x - peak - top) / (1 + F.abs(x - peak - top)))
    return rise * (1 - left) + left * ((1 - right) + fall * right)


def selectivity(kind: Column, x: Number, p1: Number, p2: Number, p3: Number = 0.0, p4: Number = 0.0) -> Column:
    """By pattern code: 0 constant, 1 logistic, 24 double normal; mirrored fleets (15) are resolved by a join first."""
    return F.when(kind == 0, F.lit(1.0)).when(kind == 1, logistic_selectivity(x, p1, p2)).when(kind == 24, double_normal_selectivity(x, p1, p2, p3, p4)).otherwise(F.raise_error(F.lit("unknown selectivity code")).cast("double"))


def exposure(z: Number, duration: Number) -> Column:
    """(1 - exp(-z t)) / z, by its Taylor series of five terms where z t < 1e-5."""
    z, t = col(z), col(duration)
    x = z * t
    series = t * (1 - x / 2 * (1 - x / 3 * (1 - x / 4 * (1 - x / 5))))
    return F.when(x < 1e-5, series).otherwise((1 - F.exp(-x)) / z)


def beverton_holt(ssb: Number, r0: Number, b0: Number, steepness: Number) -> Column:
    s, r0, b0, h = col(ssb), col(r0), col(b0), col(steepness)
    return 4 * h * r0 * s / (b0 * (1 - h) + (5 * h - 1) * s)


def surplus_production(biomass: Number, r: Number, k: Number, catch: Number, floor: float = 1.0) -> Column:
    """Next biomass of the logistic surplus production model, not below ``floor``."""
    b = col(biomass)
    return F.greatest(F.lit(float(floor)), b + col(r) * b * (1 - b / col(k)) - col(catch))
