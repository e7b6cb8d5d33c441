"""Laplace approximation of models whose random effects depend on one another in any way, by differences.

For models that neither group nor chain, such as cohort models where a deviation acts on all later
years. The joint function is a numpy callable; curvature is dense, so the number of random effects is
limited by ``linalg.DENSE_SIDE``. Many models run in parallel as groups of a grouped map.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from lakewright.plans.laplace import LOG_2PI
from lakewright.plans.linalg import with_jitter
from lakewright.plans.optimize import Result, finite_gradient, finite_hessian, lbfgs


@dataclass
class DenseLaplace:
    """joint(theta, u) -> negative log density; modes are warm-started from the last call."""

    joint: Callable[[np.ndarray, np.ndarray], float]
    u: np.ndarray
    normalise: bool = True
    evaluations: int = field(default=0)

    def mode(self, theta: np.ndarray, *, most: int = 30, tol: float = 1e-6) -> np.ndarray:
        f = lambda u: self.joint(theta, u)
        u = self.u.copy()
        for _ in range(most):
            g = finite_gradient(f, u)
            if np.abs(g).max() <= tol:
                break
            factor, _ = with_jitter(finite_hessian(f, u), start=1e-6)
            move, step, now = -factor.solve(g), 1.0, f(u)
            while step > 1e-8 and not f(u + step * move) <= now + 1e-4 * step * (g @ move) + 1e-10 * (1 + abs(now)):
                step /= 2
            if step <= 1e-8:
                break
            u = u + step * move
        self.u = u
        return u

    def value(self, theta: np.ndarray) -> float:
        self.evaluations += 1
        u = self.mode(theta)
        factor, _ = with_jitter(finite_hessian(lambda x: self.joint(theta, x), u))
        return self.joint(theta, u) + 0.5 * factor.logdet() - 0.5 * len(u) * LOG_2PI * self.normalise

    def gradient(self, theta: np.ndarray, *, envelope: bool = False) -> np.ndarray:
        """Central differences of the value, or of the joint function at the mode (``envelope``)."""
        if envelope:
            u = self.mode(theta)
            return finite_gradient(lambda t: self.joint(t, u), theta)
        return finite_gradient(self.value, theta, step=1e-4)

    def fit(self, theta: np.ndarray, **options) -> Result:
        return lbfgs(lambda t: (self.value(t), self.gradient(t)), theta, **({"tol": 1e-3} | options))

    def sensitivity(self, theta: np.ndarray) -> np.ndarray:
        """du / d theta by the implicit function theorem."""
        u, n = self.mode(theta), len(self.u)
        both = finite_hessian(lambda z: self.joint(z[n:], z[:n]), np.concatenate([u, theta]))
        factor, _ = with_jitter(both[:n, :n])
        return -factor.solve(both[:n, n:])
