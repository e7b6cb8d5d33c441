"""Parameter transforms from unconstrained to natural scale, and their log Jacobians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewright.functions.special import logistic

TRANSFORMS = ("identity", "log", "logit", "square")


def _unknown() -> Column:
    return F.raise_error(F.lit("unknown transform")).cast("double")


def apply_transform(x: Column, transform: Column) -> Column:
    """identity: x, log: exp(x), logit: 1 / (1 + exp(-x)), square: x**2."""
    return F.when(transform == "identity", x).when(transform == "log", F.exp(x)).when(transform == "logit", logistic(x)).when(transform == "square", x * x).otherwise(_unknown())


def invert_transform(y: Column, transform: Column) -> Column:
    """The unconstrained value of a natural one (the positive root for square)."""
    return F.when(transform == "identity", y).when(transform == "log", F.ln(y)).when(transform == "logit", F.ln(y) - F.ln(1 - y)).when(transform == "square", F.sqrt(y)).otherwise(_unknown())


def log_jacobian(x: Column, transform: Column) -> Column:
    """log |d natural / d unconstrained|."""
    y = logistic(x)
    return F.when(transform == "identity", F.lit(0.0)).when(transform == "log", x).when(transform == "logit", F.ln(y) + F.ln(1 - y)).when(transform == "square", F.ln(F.abs(2 * x))).otherwise(_unknown())


def positive_from_unconstrained(x: Column) -> Column:
    return F.exp(x)


def correlation_from_unconstrained(x: Column) -> Column:
    """2 / (1 + exp(-x)) - 1."""
    return 2 * logistic(x) - 1
