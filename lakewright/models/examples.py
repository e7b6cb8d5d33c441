"""Model library: year effects, latent abundance, selectivity random walk, recruitment deviations and curves, catch at age."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lakewright.models.age_structured import exposure, logistic, survivorship
from lakewright.plans import expr as X
from lakewright.plans.laplace import ChainLaplace, GroupedLaplace


def random_year_effects(rows: DataFrame, year: str, log_index: str, covariate: str) -> GroupedLaplace:
    """log index = intercept + slope * covariate + year effect + noise; diagonal curvature over years."""
    u, b0, b1 = X.random("u"), X.param("intercept"), X.param("slope")
    return GroupedLaplace(rows, year, X.normal_nll(X.data(log_index), b0 + b1 * X.data(covariate) + u, X.param("log_sigma")), X.normal_nll(u, 0.0, X.param("log_tau")), ["intercept", "slope", "log_sigma", "log_tau"])


def latent_abundance() -> ChainLaplace:
    """Log abundance as a random walk with drift, an index of it and catch per unit effort; tridiagonal curvature."""
    u, v = X.random("u"), X.random("v")
    observe = X.normal_nll(X.data("log_index"), u, X.param("log_index_sd")) + X.normal_nll(X.data("log_cpue"), X.param("log_q") + u, X.param("log_cpue_sd"))
    return ChainLaplace(0.005 * X.square(u), X.normal_nll(v, u + X.param("drift"), X.param("log_process_sd")), observe, ["log_q", "drift", "log_process_sd", "log_index_sd", "log_cpue_sd"])


def selectivity_random_walk() -> ChainLaplace:
    """Logit selectivity at age: logistic base plus random-walk deviations, with binomial observations (k of n)."""
    u, v, age = X.random("u"), X.random("v"), X.data("age")
    eta = X.param("slope") * (age - X.param("a50")) + u
    p = X.logistic(eta)
    observe = -(X.data("k") * X.log(p) + (X.data("n") - X.data("k")) * X.log(1 - p))
    return ChainLaplace(X.normal_nll(u, 0.0, 0.0), X.normal_nll(v, u, X.param("log_sd")), observe, ["a50", "slope", "log_sd"])


def ar1_nll(u: np.ndarray, rho: float, sd: float) -> float:
    """Negative log density, without constants, of a stationary AR(1) with innovations of ``sd``; 0 for no values."""
    if not len(u):
        return 0.0
    first = sd / np.sqrt(1 - rho**2)
    return float(0.5 * (u[0] / first) ** 2 + np.log(first) + (0.5 * ((u[1:] - rho * u[:-1]) / sd) ** 2 + np.log(sd)).sum())


def _aged(alive: np.ndarray, recruits: float) -> np.ndarray:
    """Numbers a year on: recruits first, the last age a plus group."""
    n = np.concatenate([[recruits], alive[:-1]])
    n[-1] += alive[-1]
    return n


def normal_prior(x: np.ndarray, prior: tuple[tuple[float, float], ...]) -> float:
    """Half the squared distances from (centre, sd) of each number."""
    centre, sd = np.array(prior).T
    return float(0.5 * (((x - centre) / sd) ** 2).sum())


@dataclass
class Recruitment:
    """Cohorts with recruitment deviations that follow a stationary AR(1), an index and optional catches.

    theta: log_r0, log_fbar. u: one deviation per year.
    """

    index: np.ndarray
    catch: np.ndarray
    weight: np.ndarray
    m: float = 0.2
    log_q: float = 0.0
    a50: float = 3.0
    slope: float = 1.5
    rho: float = 0.5
    sd: float = 0.2
    index_sd: float = 0.2
    catch_sd: float = 0.2
    use_catch: bool = True
    prior: tuple[tuple[float, float], ...] = ((7.0, 5.0), (-2.0, 2.0))

    def series(self, theta: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(biomass, catch) by year; catches by Baranov's equation."""
        ages = np.arange(1, len(self.weight) + 1)
        f = np.exp(theta[1]) * logistic(self.slope * (ages - self.a50))
        z, r0 = self.m + f, np.exp(theta[0])
        n = r0 * survivorship(np.full(len(ages), self.m))
        b, c = np.empty(len(u)), np.empty(len(u))
        for y in range(len(u)):
            n[0] = r0 * np.exp(u[y] - self.sd**2 / 2)
            b[y], c[y] = (n * self.weight).sum(), (n * self.weight * f * exposure(z, 1.0)).sum()
            n = _aged(n * np.exp(-z), 0.0)
        return b, c

    def joint(self, theta: np.ndarray, u: np.ndarray) -> float:
        b, c = self.series(theta, u)
        seen = [(self.index, np.exp(self.log_q) * b, self.index_sd), *([(self.catch, c, self.catch_sd)] if self.use_catch else [])]
        return normal_prior(theta, self.prior) + ar1_nll(u, self.rho, self.sd) + sum(float(0.5 * (np.log(x / np.maximum(m, 1e-12)) ** 2).sum() / sd**2) for x, m, sd in seen)


@dataclass
class RickerStock:
    """Ages under known catches, recruits by Ricker's curve times deviations that follow an AR(1).

    Ricker's curve R = alpha S exp(-beta S) in unfished terms: with x the spawners over those of an unfished
    stock of r0 recruits, R = r0 x exp(a (1 - x)). Catches are taken at mid-year, as in Pope's
    approximation: a rate of the selected biomass then, at most ``most``.

    theta: log_r0, log_a. u: a deviation of the recruits that each year's spawners leave (so the last one is
    told by its prior alone), or none at all.
    """

    index: np.ndarray
    catch: np.ndarray
    weight: np.ndarray
    maturity: np.ndarray
    m: float = 0.2
    log_q: float = 0.0
    a50: float = 3.0
    slope: float = 1.5
    rho: float = 0.5
    sd: float = 0.2
    index_sd: float = 0.2
    most: float = 0.9
    prior: tuple[tuple[float, float], ...] = ((7.0, 5.0), (0.0, 1.0))

    def series(self, theta: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(biomass, catch removed) by year."""
        r0, steep = np.exp(theta)
        alive = survivorship(np.full(len(self.weight), self.m))
        unfished = r0 * (alive * self.weight * self.maturity).sum()
        selected = logistic(self.slope * (np.arange(1, len(self.weight) + 1) - self.a50))
        dev, n, out = np.zeros(len(self.catch)), r0 * alive, []
        dev[: len(u)] = u
        for caught, d in zip(self.catch, dev, strict=True):
            at_hand = np.exp(-self.m / 2) * (n * selected * self.weight).sum()
            rate = min(self.most, caught / at_hand)
            out.append(((n * self.weight).sum(), rate * at_hand))
            x = (n * self.weight * self.maturity).sum() / unfished
            n = _aged(n * np.exp(-self.m) * (1 - rate * selected), r0 * x * np.exp(steep * (1 - x) + d))
        b, removed = np.array(out).T
        return b, removed

    def joint(self, theta: np.ndarray, u: np.ndarray) -> float:
        e = np.log(self.index) - self.log_q - np.log(self.series(theta, u)[0])
        return normal_prior(theta, self.prior) + ar1_nll(u, self.rho, self.sd) + float(0.5 * (e @ e) / self.index_sd**2)


@dataclass
class CatchAtAge:
    """Catches at age with yearly recruitment and fishing deviations: u holds both, theta log_r0, log_f, log_sd.

    ``observed``: [year, age] catches in numbers; lognormal errors.
    """

    observed: np.ndarray
    m: float = 0.2
    a50: float = 3.0
    slope: float = 1.5

    def expected(self, theta: np.ndarray, u: np.ndarray) -> np.ndarray:
        years, ages = self.observed.shape
        r, f = np.exp(theta[0] + u[:years]), np.exp(theta[1] + u[years:])
        s = logistic(self.slope * (np.arange(1, ages + 1) - self.a50))
        n = np.exp(theta[0]) * survivorship(np.full(ages, self.m))
        out = np.empty((years, ages))
        for y in range(years):
            n[0] = r[y]
            z = self.m + f[y] * s
            out[y] = n * f[y] * s * exposure(z, 1.0)
            n = _aged(n * np.exp(-z), 0.0)
        return out

    def joint(self, theta: np.ndarray, u: np.ndarray) -> float:
        e = (np.log(self.observed) - np.log(np.maximum(self.expected(theta, u), 1e-12))) / np.exp(theta[2])
        return float(0.5 * (e * e).sum() + e.size * theta[2] + 0.5 * (u @ u) / 0.3**2 + len(u) * np.log(0.3) + 0.5 * theta @ theta / 100)

    def derived(self, theta: np.ndarray, u: np.ndarray) -> dict[str, np.ndarray]:
        years = len(self.observed)
        return {"recruits": np.exp(theta[0] + u[:years]), "fishing": np.exp(theta[1] + u[years:])}

    def simulator(self) -> Callable[[np.ndarray, np.random.Generator], np.ndarray]:
        """Posterior-predictive total catch by year of a draw (theta and u in one vector)."""

        def run(draw: np.ndarray, rng: np.random.Generator) -> np.ndarray:
            theta, u = draw[:3], draw[3:]
            return (self.expected(theta, u) * np.exp(np.exp(theta[2]) * rng.standard_normal(self.observed.shape))).sum(1)

        return run
