"""L-BFGS with Armijo line search, bounds on failure, and an honest convergence flag."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from lakewright.plans.laplace import NotConverged
from lakewright.plans.linalg import NotPositiveDefinite

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class Result:
    x: np.ndarray
    value: float
    gradient: np.ndarray
    iterations: int
    evaluations: int
    converged: bool
    recoveries: int = 0
    trajectory: list[tuple[int, float, float]] = field(default_factory=list)


def two_loop(g: np.ndarray, s: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Quasi-Newton descent direction from stored steps and gradient changes."""
    q, alphas = g.copy(), []
    for a, b in zip(reversed(s), reversed(y), strict=True):
        alpha = a @ q / (a @ b)
        alphas.append(alpha)
        q -= alpha * b
    if s:
        q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1])
    for (a, b), alpha in zip(zip(s, y, strict=True), reversed(alphas), strict=True):
        q += a * (alpha - b @ q / (a @ b))
    return -q


def failed_is_infinite(f: Objective) -> Objective:
    """``f`` with an infinite value where it can't be told: no mode found, or curvature not positive there."""

    def safe(x: np.ndarray) -> tuple[float, np.ndarray]:
        try:
            return f(x)
        except (NotConverged, NotPositiveDefinite):
            return float("inf"), np.full(len(x), np.nan)

    return safe


def lbfgs(f: Objective, x0: np.ndarray, *, memory: int = 20, tol: float = 1e-4, most: int = 100, linesearch: int = 50, c1: float = 1e-4, recoveries: int = 2, switch: tuple[float, Objective] | None = None) -> Result:
    """Minimise ``f``; converged means the gradient norm is at most ``tol`` and nothing else.

    A failed value (not finite) shortens the step. When the line search fails, the memory is dropped and
    the steepest descent tried, at most ``recoveries`` times. The best iterate is returned. ``switch``
    (norm, exact): ``f`` is approximate until its gradient norm falls below the norm, then ``exact`` is
    used for good.
    """
    x = np.array(x0, dtype=float)
    exact = switch is None
    value, g = f(x)
    f, switch = failed_is_infinite(f), switch and (switch[0], failed_is_infinite(switch[1]))
    out = Result(x, value, g, 0, 1, False)
    s: list[np.ndarray] = []
    y: list[np.ndarray] = []
    for it in range(most):
        norm = float(np.linalg.norm(g))
        out.trajectory.append((it, value, norm))
        if not exact and norm < switch[0]:
            f, exact, s, y = switch[1], True, [], []
            value, g = f(x)
            out.evaluations += 1
            norm = float(np.linalg.norm(g))
        if exact and norm <= tol:
            break
        d = two_loop(g, s, y)
        if d @ g >= 0:
            d = -g
        step = 1.0 if s else min(1.0, 1.0 / max(norm, 1e-12))
        for _ in range(linesearch):
            new, gn = f(x + step * d)
            out.evaluations += 1
            if np.isfinite(new) and np.isfinite(gn).all() and new <= value + c1 * step * (d @ g):
                break
            step *= 0.5
        else:
            if not s or out.recoveries >= recoveries:
                break
            out.recoveries += 1
            s, y = [], []
            continue
        ds, dy = step * d, gn - g
        if ds @ dy > 1e-12 * np.linalg.norm(ds) * np.linalg.norm(dy):
            s, y = [*s[-memory + 1 :], ds], [*y[-memory + 1 :], dy]
        x, value, g = x + ds, new, gn
        out.iterations = it + 1
    out.x, out.value, out.gradient = x, value, g
    out.converged = bool(np.linalg.norm(g) <= tol)
    return out


def finite_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """Central differences."""
    out = np.empty(len(x))
    for k in range(len(x)):
        h = np.zeros(len(x))
        h[k] = step * (1 + abs(x[k]))
        out[k] = (f(x + h) - f(x - h)) / (2 * h[k])
    return out


def finite_hessian(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    n, out = len(x), np.empty((len(x), len(x)))
    e = np.eye(n) * step
    for i in range(n):
        for j in range(i, n):
            v = (f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * step * step)
            out[i, j] = out[j, i] = v
    return out


def gradient_hessian(g: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """Symmetrised central differences of an exact gradient with step cbrt(eps)."""
    h, out = np.cbrt(np.finfo(float).eps), np.empty((len(x), len(x)))
    for k in range(len(x)):
        e = np.zeros(len(x))
        e[k] = h * (1 + abs(x[k]))
        out[k] = (g(x + e) - g(x - e)) / (2 * e[k])
    return (out + out.T) / 2


def multistart(f: Objective, starts: list[np.ndarray], phases: list[np.ndarray], **options) -> Result:
    """Best of several starts, each through phases of free parameters (boolean masks)."""
    best = None
    for x0 in starts:
        x = np.array(x0, dtype=float)
        for free in phases:

            def part(z, x=x, free=free):
                full = x.copy()
                full[free] = z
                v, g = f(full)
                return v, g[free]

            r = lbfgs(part, x[free], **options)
            x[free] = r.x
        v, g = f(x)
        r = Result(x, v, g, r.iterations, r.evaluations, bool(np.linalg.norm(g) <= options.get("tol", 1e-4)), r.recoveries)
        if best is None or (np.isfinite(v) and v < best.value):
            best = r
    return best


def bounded(f: Objective, low: np.ndarray, high: np.ndarray) -> tuple[Objective, Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """(objective of unconstrained x, to natural values, from natural values) with logit bounds."""
    low, width = np.asarray(low, float), np.asarray(high, float) - np.asarray(low, float)

    def to(x: np.ndarray) -> np.ndarray:
        return low + width * 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))

    def back(y: np.ndarray) -> np.ndarray:
        p = (np.asarray(y, float) - low) / width
        if ((p <= 0) | (p >= 1)).any():
            raise ValueError("a value is not inside its bounds")
        return np.log(p) - np.log1p(-p)

    def inner(x: np.ndarray) -> tuple[float, np.ndarray]:
        y = to(x)
        value, g = f(y)
        p = (y - low) / width
        return value, g * width * p * (1 - p)

    return inner, to, back


def scaled(f: Objective, x0: np.ndarray, metric: np.ndarray) -> tuple[Objective, Callable[[np.ndarray], np.ndarray]]:
    """(objective of z, to x) with x = x0 + L z and L L' the metric, for preconditioning by a covariance."""
    factor = np.linalg.cholesky(metric)

    def to(z: np.ndarray) -> np.ndarray:
        return x0 + factor @ z

    def inner(z: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = f(to(z))
        return value, factor.T @ g

    return inner, to
