"""Regions linked by seasonal movement: dynamics, likelihood, retrospectives, sensitivities, simulation, reference points, projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lakewright.functions.text import mix_seed
from lakewright.models.age_structured import exposure, survivorship


@dataclass
class SpatialData:
    """effort, catch, index [fleet, year, season, region]; movement [season, from, to] with rows that sum to one."""

    effort: np.ndarray
    catch: np.ndarray
    index: np.ndarray
    movement: np.ndarray
    m: np.ndarray  # [age]
    weight: np.ndarray
    maturity: np.ndarray
    selectivity: np.ndarray  # [fleet, age]

    def validate(self) -> None:
        for name in ("effort", "catch", "index", "movement", "m", "weight", "maturity", "selectivity"):
            x = getattr(self, name)
            if not np.isfinite(x).all() or (x < 0).any():
                raise ValueError(f"{name} must be finite and not negative")
        if not self.effort.shape == self.catch.shape == self.index.shape:
            raise ValueError("effort, catch and index differ in shape")
        f, _, s, r = self.effort.shape
        if self.movement.shape != (s, r, r) or self.selectivity.shape != (f, len(self.m)):
            raise ValueError("movement or selectivity has the wrong shape")
        if np.abs(self.movement.sum(2) - 1).max() > 1e-8:
            raise ValueError("movement rows must sum to one")

    def peel(self, keep: int) -> SpatialData:
        """The first ``keep`` years."""
        return replace(self, effort=self.effort[:, :keep], catch=self.catch[:, :keep], index=self.index[:, :keep])

    def scenario(self, *, m: float = 1.0, effort: float = 1.0, index: float = 1.0) -> SpatialData:
        return replace(self, m=self.m * m, effort=self.effort * effort, index=self.index * index)


@dataclass
class SpatialFit:
    log_r0: float
    log_q: float
    log_index_q: float


def dynamics(d: SpatialData, p: SpatialFit) -> dict[str, np.ndarray]:
    """Predicted catch and index [fleet, year, season, region], spawners by year and the numbers of the next January."""
    fleets, years, seasons, regions = d.effort.shape
    n = np.exp(p.log_r0) / regions * survivorship(np.repeat(d.m[None], regions, 0))
    ssb0 = float((n * d.weight * d.maturity).sum())
    catch, index, ssb = np.zeros(d.effort.shape), np.zeros(d.effort.shape), np.zeros(years)
    q, qi, t = np.exp(p.log_q), np.exp(p.log_index_q), 1 / seasons
    for y in range(years):
        ssb[y] = (n * d.weight * d.maturity).sum()
        for s in range(seasons):
            n = d.movement[s].T @ n
            f = q * d.effort[:, y, s, :, None] * d.selectivity[:, None, :]  # [fleet, region, age]
            z = d.m + f.sum(0)
            average = n * exposure(z, t)
            catch[:, y, s] = (f * average * d.weight).sum(2)
            index[:, y, s] = qi * (average / t * d.weight * d.selectivity[:, None, :]).sum(2)
            n = n * np.exp(-z * t)
        alive = n
        n = np.zeros_like(alive)
        n[:, 1:] = alive[:, :-1]
        n[:, -1] += alive[:, -1]
        n[:, 0] = np.exp(p.log_r0) / regions
    return {"catch": catch, "index": index, "ssb": ssb, "ssb0": np.array(ssb0), "next": n}


def negative_log_likelihood(d: SpatialData, x: np.ndarray, *, catch_sd: float = 0.2, index_sd: float = 0.2) -> float:
    """Lognormal catches and indices over positive observations, with weak priors."""
    r = dynamics(d, SpatialFit(*x))
    total = 0.5 * ((x - np.array([8.0, -4.0, 0.0])) ** 2 / 25).sum()
    for seen, made, sd in ((d.catch, r["catch"], catch_sd), (d.index, r["index"], index_sd)):
        on = seen > 0
        e = np.log(seen[on]) - np.log(np.maximum(made[on], 1e-12))
        total += 0.5 * (e / sd) @ (e / sd) + on.sum() * np.log(sd)
    return float(total)


def fit(d: SpatialData, starts: list[np.ndarray]) -> tuple[np.ndarray, float, bool]:
    """Best of several starts by L-BFGS on finite-difference gradients."""
    from lakewright.plans.optimize import finite_gradient, multistart

    def f(x):
        return negative_log_likelihood(d, x), finite_gradient(lambda z: negative_log_likelihood(d, z), x)

    free = np.ones(3, bool)
    phases = [np.array([True, False, False]), np.array([True, True, False]), free]
    r = multistart(f, starts, phases, tol=1e-3, most=100)
    return r.x, r.value, r.converged


def residual_table(d: SpatialData, r: dict[str, np.ndarray], sd: float = 0.2) -> pd.DataFrame:
    """component, fleet, year, season, region, residual, error over positive observations, numbers from 1."""
    out = []
    for name, seen in (("catch", d.catch), ("index", d.index)):
        f, y, s, g = np.nonzero(seen > 0)
        e = np.log(seen[f, y, s, g]) - np.log(np.maximum(r[name][f, y, s, g], 1e-12))
        out.append(pd.DataFrame({"component": name, "fleet": f + 1, "year": y + 1, "season": s + 1, "region": g + 1, "residual": e / sd, "error": e}))
    return pd.concat(out, ignore_index=True)


def simulate(d: SpatialData, p: SpatialFit, seed: int, cv: float = 0.2) -> SpatialData:
    """Observations with lognormal noise of mean one around the model's."""
    rng, r = np.random.default_rng(mix_seed(seed)), dynamics(d, p)
    sd = np.sqrt(np.log1p(cv * cv))

    def noisy(x):
        return x * np.exp(sd * rng.standard_normal(x.shape) - sd * sd / 2)

    return replace(d, catch=noisy(r["catch"]), index=noisy(r["index"]))


def by_case(cases: DataFrame, make: Callable[[str], SpatialData], start: np.ndarray) -> DataFrame:
    """Refit every case (case): peels, sensitivities or simulations, one task each; case, year, ssb, ssb0, value, converged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf.case.iloc[0]
        d = make(name)
        x, value, ok = fit(d, [start, start + 0.1])
        r = dynamics(d, SpatialFit(*x))
        return pd.DataFrame({"case": name, "year": np.arange(1, len(r["ssb"]) + 1), "ssb": r["ssb"], "ssb0": float(r["ssb0"]), "value": value, "converged": ok})

    return cases.groupBy("case").applyInPandas(run, "case string, year int, ssb double, ssb0 double, value double, converged boolean")


def fishing_pattern(d: SpatialData, p: SpatialFit, recent: int = 3) -> np.ndarray:
    """Fishing mortality [fleet, season, region, age] at the mean effort of the last ``recent`` years."""
    return np.exp(p.log_q) * d.effort[:, -recent:].mean(1)[..., None] * d.selectivity[:, None, None, :]


def _year(d: SpatialData, n: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(catch in weight, survivors) of a year from January's numbers [..., region, age] under ``f`` [..., fleet, season, region, age]."""
    t, caught = 1 / f.shape[-3], 0.0
    for s in range(f.shape[-3]):
        n = d.movement[s].T @ n
        z = d.m + f[..., s, :, :].sum(-3)
        caught = caught + (f[..., s, :, :].sum(-3) * n * exposure(z, t) * d.weight).sum((-1, -2))
        n = n * np.exp(-z * t)
    return np.asarray(caught), n


def _recruits(ssb: np.ndarray, b0: float, r0: float, steepness: float) -> np.ndarray:
    """Beverton-Holt recruits; r0 at any spawners when steepness is 1."""
    s = np.maximum(ssb, 1e-300) / b0
    return r0 * 4 * steepness * s / ((1 - steepness) + (5 * steepness - 1) * s)


def equilibrium(d: SpatialData, f: np.ndarray, log_r0: float, steepness: float = 1.0) -> dict[str, np.ndarray]:
    """Spawners, recruits and yield under constant patterns ``f`` [..., fleet, season, region, age].

    A year is linear in the numbers: every age has a matrix over regions, and the plus group is one solve.
    Recruits follow from spawners a recruit; a stock that can't replace itself has none.
    """
    if not 0.2 < steepness <= 1:
        raise ValueError("steepness must be over 0.2 and at most 1")
    seasons, regions, ages = f.shape[-3:]
    keep = np.exp(-(d.m + f.sum(-4)) / seasons)
    year = np.eye(regions)
    for s in range(seasons):
        year = np.swapaxes(keep[..., s, :, :], -1, -2)[..., None] * (d.movement[s].T @ year)  # [..., age, to, from]
    n = [np.full((*f.shape[:-4], regions, 1), 1 / regions)]
    for a in range(ages - 1):
        n.append(year[..., a, :, :] @ n[-1])
    n[-1] = np.linalg.solve(np.eye(regions) - year[..., -1, :, :], n[-1])
    per_recruit = np.concatenate(n, -1)
    spawning = (per_recruit * d.weight * d.maturity).sum((-1, -2))
    unfished = (survivorship(d.m[None]) * d.weight * d.maturity).sum()
    recruits = np.exp(log_r0) * np.maximum((4 * steepness * spawning - (1 - steepness) * unfished) / ((5 * steepness - 1) * spawning), 0)
    return {"ssb": recruits * spawning, "recruits": recruits, "yield": recruits * _year(d, per_recruit, f)[0]}


def reference_points(d: SpatialData, p: SpatialFit, *, steepness: float = 1.0, most: float = 3.0, points: int = 150, doublings: int = 4) -> dict[str, float | bool]:
    """Maximum sustainable yield over multiples of the recent fishing pattern.

    The grid is doubled while its end is best, then refined around the best multiple; ``at_boundary`` says that
    no range had its best inside. The ratios are of the last fitted spawners and of recent fishing.
    """
    f = fishing_pattern(d, p)

    def at(multiples: np.ndarray) -> dict[str, np.ndarray]:
        return equilibrium(d, multiples[:, None, None, None, None] * f, p.log_r0, steepness)

    for _ in range(doublings + 1):
        grid = np.linspace(0, most, points + 1)
        best = int(at(grid)["yield"].argmax())
        if best < points:
            break
        most *= 2
    if best == 0:
        raise ValueError("no multiple of the fishing pattern has a yield")
    boundary = best == points
    for _ in range(0 if boundary else 4):
        grid = np.linspace(grid[best - 1], grid[best + 1], points + 1)
        best = min(max(int(at(grid)["yield"].argmax()), 1), points - 1)
    top = at(grid[best : best + 1])
    b0, b = float(at(np.zeros(1))["ssb"][0]), float(top["ssb"][0])
    return {
        "b0": b0, "msy": float(top["yield"][0]), "b_msy": b, "f_msy": float(grid[best]),
        "terminal_b_ratio": float(dynamics(d, p)["ssb"][-1] / b), "status_quo_f_ratio": float(1 / grid[best]), "at_boundary": boundary,
    }


def project(d: SpatialData, p: SpatialFit, multiple: float, years: int, *, steepness: float = 1.0, recruitment: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Spawners, depletion and yield of ``years`` after the fit, under a multiple of the recent fishing pattern.

    ``recruitment`` multiplies each year's recruits, which the spawners of the January before leave.
    """
    factor = np.ones(years) if recruitment is None else np.asarray(recruitment, float)
    if years < 1 or len(factor) != years or not (np.isfinite(multiple) and multiple >= 0):
        raise ValueError("a projection takes a finite multiple from 0 on and a recruitment factor for each of its years")
    f, past = multiple * fishing_pattern(d, p), dynamics(d, p)
    n, ssb, regions, r0 = past["next"].copy(), past["ssb"][-1], f.shape[2], np.exp(p.log_r0)
    b0 = float(equilibrium(d, 0 * f, p.log_r0)["ssb"])
    out = np.empty((2, years))
    for y in range(years):
        n[:, 0] = factor[y] * _recruits(ssb, b0, r0, steepness) / regions
        ssb = (n * d.weight * d.maturity).sum()
        caught, alive = _year(d, n, f)
        out[:, y] = ssb, caught
        n = np.zeros_like(alive)
        n[:, 1:] = alive[:, :-1]
        n[:, -1] += alive[:, -1]
    return {"ssb": out[0], "depletion": out[0] / b0, "yield": out[1]}


def reference_cases(cases: DataFrame, d: SpatialData, p: SpatialFit) -> DataFrame:
    """Reference points of every case (case, steepness)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([{"case": c} | reference_points(d, p, steepness=h) for c, h in zip(pdf.case, pdf.steepness)], columns=["case", *names])

    names = ["b0", "msy", "b_msy", "f_msy", "terminal_b_ratio", "status_quo_f_ratio", "at_boundary"]
    return cases.select("case", "steepness").mapInPandas(run, f"case string, {', '.join(f'{x} double' for x in names[:-1])}, at_boundary boolean")


def project_cases(cases: DataFrame, d: SpatialData, p: SpatialFit, years: int) -> DataFrame:
    """Projection of every case (case, multiple, steepness): case, year from 1, ssb, depletion, yield."""

    def run(batches):
        for pdf in batches:
            for c, k, h in zip(pdf.case, pdf.multiple, pdf.steepness):
                yield pd.DataFrame({"case": c, "year": np.arange(1, years + 1)} | project(d, p, k, years, steepness=h))

    return cases.select("case", "multiple", "steepness").mapInPandas(run, "case string, year int, ssb double, depletion double, yield double")
