"""Uncertainty after a fit: covariance, reports, delta method, profiled derived quantities, local curvature checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.linalg import Dense, NotPositiveDefinite
from lakewright.plans.optimize import finite_gradient

Z95 = 1.96
#: The exact two-sided 95 % point, which positive quantities' intervals use.
Z95_EXACT = 1.95996398454005


@dataclass
class Covariance:
    hessian: np.ndarray
    covariance: np.ndarray | None
    correlation: np.ndarray | None
    eigenvalues: np.ndarray
    positive_definite: bool
    condition: float


def covariance_from_hessian(h: np.ndarray, tolerance: float = float(np.sqrt(np.finfo(float).eps))) -> Covariance:
    """Inverse Hessian where its least eigenvalue exceeds tolerance * max(1, largest), with condition and correlation."""
    h = (h + h.T) / 2
    eig = np.linalg.eigvalsh(h)
    ok = bool(eig[0] > tolerance * max(1.0, float(eig[-1])))
    condition = float(abs(eig[-1]) / max(abs(eig[0]), 1e-300))
    if not ok:
        return Covariance(h, None, None, eig, False, condition)
    c = Dense(h).inverse()
    sd = np.sqrt(np.diag(c))
    return Covariance(h, c, c / np.outer(sd, sd), eig, True, condition)


def fixed_effect_report(spark: SparkSession, names: list[str], estimates: np.ndarray, cov: np.ndarray) -> DataFrame:
    """parameter, estimate, std_error, z_value, lower, upper."""
    se = np.sqrt(np.diag(cov))
    rows = [(n, float(x), float(s), float(x / s) if s > 0 else None, float(x - Z95 * s), float(x + Z95 * s)) for n, x, s in zip(names, estimates, se, strict=True)]
    return spark.createDataFrame(rows, "parameter string, estimate double, std_error double, z_value double, lower double, upper double")


def delta_scalar(f: Callable[[np.ndarray], float], theta: np.ndarray, cov: np.ndarray, gradient: np.ndarray | None = None) -> tuple[float, float]:
    """(estimate, standard error) of f(theta): g' C g with the given or a finite-difference gradient."""
    g = finite_gradient(f, theta) if gradient is None else gradient
    variance = float(g @ cov @ g)
    if variance < -1e-12:
        raise ValueError("negative delta-method variance")
    return float(f(theta)), float(np.sqrt(max(variance, 0.0)))


def delta_vector(jacobian: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covariance J C J', standard errors, correlation)."""
    c = jacobian @ cov @ jacobian.T
    se = np.sqrt(np.maximum(np.diag(c), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return c, se, c / np.outer(se, se)


def profiled_jacobian(g_theta: np.ndarray, g_u: np.ndarray, du: np.ndarray) -> np.ndarray:
    """Jacobian of q(theta, u(theta)): direct plus through the mode."""
    return g_theta + g_u @ du


def derived_report(spark: SparkSession, names: list[str], estimates: np.ndarray, jacobian: np.ndarray, cov: np.ndarray) -> DataFrame:
    """quantity, estimate, std_error, cv."""
    _, se, _ = delta_vector(jacobian, cov)
    rows = [(n, float(x), float(s), float(s / abs(x)) if x else None) for n, x, s in zip(names, estimates, se, strict=True)]
    return spark.createDataFrame(rows, "quantity string, estimate double, std_error double, cv double")


def sensitivity(h_uu: np.ndarray, h_u_theta: np.ndarray) -> np.ndarray:
    """du / d theta by the implicit function theorem."""
    return -Dense(h_uu).solve(h_u_theta)


def positive_interval(estimate: Column, variance: Column) -> dict[str, Column]:
    """Log-scale interval of a positive quantity: estimate * exp(+-z se / estimate)."""
    ratio = F.sqrt(variance) / estimate
    ok = (estimate > 0) & (variance >= 0)
    return {"lower": F.when(ok, estimate * F.exp(-Z95_EXACT * ratio)), "upper": F.when(ok, estimate * F.exp(Z95_EXACT * ratio))}


def derived_uncertainty(rows: DataFrame, log_cov: DataFrame, year: str, log_state: str, catch: str) -> DataFrame:
    """Four rows per year (log_biomass, biomass, depletion, fishing_rate) with delta-method errors and 95 % limits.

    ``log_cov``: covariance (i, j, value) of log states, i and j being years. The depletion's log variance
    is v_i + v_0 - 2 c_i0.
    """
    first = rows.agg(F.min_by(log_state, year).alias("x0"), F.min(year).alias("y0"))
    v = log_cov.filter("i = j").select(F.col("i").alias(year), F.col("value").alias("v"))
    met = rows.join(v, year).crossJoin(first)  # one row
    c0 = log_cov.select(F.col("i").alias(year), F.col("j").alias("y0"), F.col("value").alias("c0"))
    v0 = v.select(F.col(year).alias("y0"), F.col("v").alias("v0"))
    met = met.join(c0, [year, "y0"], "left").join(v0, "y0", "left")
    b, d = F.exp(log_state), F.exp(F.col(log_state) - F.col("x0"))
    dv = F.greatest(F.col("v") + F.col("v0") - 2 * F.coalesce("c0", F.lit(0.0)), F.lit(0.0))
    f = F.col(catch) / b
    each = [("log_biomass", F.col(log_state), F.sqrt("v")), ("biomass", b, b * F.sqrt("v")), ("depletion", d, d * F.sqrt(dv)), ("fishing_rate", f, f * F.sqrt("v"))]
    out = met.select(year, F.explode(F.array(*[F.struct(F.lit(n).alias("quantity"), x.alias("estimate"), s.alias("std_error")) for n, x, s in each])).alias("q")).select(year, "q.*")
    return out.withColumn("lwr_95", F.col("estimate") - Z95 * F.col("std_error")).withColumn("upr_95", F.col("estimate") + Z95 * F.col("std_error"))


def validated_curvature(coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """The finer of two step sizes' Hessians if both are symmetric to 1e-5, agree to 1e-5, are positive
    definite and give standard errors within 1e-3 of each other; otherwise an error."""
    for h in (coarse, fine):
        if np.abs(h - h.T).max() > 1e-5 * max(1.0, float(np.abs(h).max())):
            raise ValueError("the Hessian is not symmetric")
    if np.abs(coarse - fine).max() > 1e-5 * max(1.0, float(np.abs(fine).max())):
        raise ValueError("the Hessian depends on the step size")
    try:
        a, b = (np.sqrt(Dense((h + h.T) / 2).inverse_diagonal()) for h in (coarse, fine))
    except NotPositiveDefinite as e:
        raise ValueError("the Hessian is not positive definite") from e
    if np.abs(a / b - 1).max() > 1e-3:
        raise ValueError("standard errors depend on the step size")
    return (fine + fine.T) / 2


def profile_curvature(f: Callable[[float], float], x: float) -> tuple[float, float]:
    """(second derivative, standard error) of a profiled objective in one parameter by three points."""
    h = max(1e-5, 1e-4 * (1 + abs(x)))
    c = (f(x + h) - 2 * f(x) + f(x - h)) / (h * h)
    return c, float(1 / np.sqrt(c)) if c > 0 else float("nan")
