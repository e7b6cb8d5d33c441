"""No-U-Turn sampling: one chain per group of a grouped map, and posterior simulation.

Slice-free multinomial trees would change acceptance figures; this is the slice version: doubling with
a slice variable, dual averaging of the step size, and mass adaptation in doubling windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.text import mix_seed

Target = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class Options:
    warmup: int = 500
    draws: int = 500
    max_depth: int = 10
    acceptance: float = 0.8
    dense_mass: bool = False
    seed: int = 8675309
    divergence: float = 1000.0


def leapfrog(target: Target, q: np.ndarray, p: np.ndarray, grad: np.ndarray, step: float, metric: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    p = p + 0.5 * step * grad
    q = q + step * (metric @ p if metric.ndim == 2 else metric * p)
    value, grad = target(q)
    return q, p + 0.5 * step * grad, value, grad


def first_step(target: Target, q: np.ndarray, metric: np.ndarray, rng: np.random.Generator) -> float:
    """Double or halve until the acceptance of one step crosses one half; at most 20 times, within [1e-6, 10]."""
    value, grad = target(q)
    p = _momentum(rng, metric)
    start = value - _kinetic(p, metric)
    step = 1.0

    def gain(s: float) -> float:
        _, pn, v, _ = leapfrog(target, q, p, grad, s, metric)
        x = v - _kinetic(pn, metric) - start
        return x if np.isfinite(x) else -np.inf

    direction = 1 if gain(step) > math.log(0.5) else -1
    for _ in range(20):
        new = step * 2.0**direction
        if (gain(new) > math.log(0.5)) != (direction == 1):
            break
        step = new
    return float(np.clip(step, 1e-6, 10.0))


def _kinetic(p: np.ndarray, metric: np.ndarray) -> float:
    return 0.5 * float(p @ (metric @ p if metric.ndim == 2 else metric * p))


def _momentum(rng: np.random.Generator, metric: np.ndarray) -> np.ndarray:
    z = rng.standard_normal(len(metric))
    return np.linalg.solve(np.linalg.cholesky(metric).T, z) if metric.ndim == 2 else z / np.sqrt(metric)


class _Tree:
    """Recursive doubling in one direction."""

    def __init__(self, target: Target, step: float, metric: np.ndarray, log_slice: float, start: float, rng: np.random.Generator, limit: float):
        self.target, self.step, self.metric, self.log_slice, self.start, self.rng, self.limit = target, step, metric, log_slice, start, rng, limit
        self.alpha, self.n_alpha, self.divergent = 0.0, 0, False

    def turned(self, a, b) -> bool:
        d = b[0] - a[0]
        va, vb = ((self.metric @ x[1] if self.metric.ndim == 2 else self.metric * x[1]) for x in (a, b))
        return d @ va < 0 or d @ vb < 0

    def build(self, state, direction: int, depth: int):
        """(leftmost, rightmost, proposal, number of valid states, whether to go on); a state is (q, p, value, gradient)."""
        if depth == 0:
            q, p, v, g = leapfrog(self.target, state[0], state[1], state[3], direction * self.step, self.metric)
            joint = v - _kinetic(p, self.metric)
            joint = joint if np.isfinite(joint) else -np.inf
            self.alpha += min(1.0, math.exp(min(0.0, joint - self.start)))
            self.n_alpha += 1
            ok = joint > self.log_slice - self.limit
            self.divergent |= not ok
            new = (q, p, v, g)
            return new, new, new, int(self.log_slice <= joint), ok
        a, b, proposal, n, ok = self.build(state, direction, depth - 1)
        if ok:
            if direction < 0:
                a, _, other, m, ok = self.build(a, direction, depth - 1)
            else:
                _, b, other, m, ok = self.build(b, direction, depth - 1)
            if m and self.rng.random() < m / (n + m):
                proposal = other
            n += m
            ok = ok and not self.turned(a, b)
        return a, b, proposal, n, ok


def sample_chain(target: Target, q: np.ndarray, options: Options, seed: int) -> dict[str, object]:
    """One chain: draws, log densities, energies and diagnostics."""
    rng, dim = np.random.default_rng(seed), len(q)
    metric = np.eye(dim) if options.dense_mass else np.ones(dim)
    q = np.array(q, float)
    value, grad = target(q)
    step = first_step(target, q, metric, rng)
    mu, h_bar, log_bar, count = math.log(10 * step), 0.0, math.log(step), 0
    window_end, window, updates, failures = min(75, max(1, options.warmup // 4)), [], 0, 0
    width = max(25, options.warmup // 10)
    out: dict[str, list] = {"draws": [], "log_density": [], "energy": []}
    accept, divergences, depth_hits = 0.0, 0, 0
    for it in range(options.warmup + options.draws):
        p = _momentum(rng, metric)
        start = value - _kinetic(p, metric)
        log_slice = start + math.log(max(rng.random(), 1e-300))
        tree = _Tree(target, step, metric, log_slice, start, rng, options.divergence)
        left = right = now = (q, p, value, grad)
        n, depth, going = 1, 0, True
        while going and depth < options.max_depth:
            direction = 1 if rng.random() < 0.5 else -1
            if direction < 0:
                left, _, proposal, m, ok = tree.build(left, direction, depth)
            else:
                _, right, proposal, m, ok = tree.build(right, direction, depth)
            if ok and m and rng.random() < m / n:
                now = proposal
            n += m
            going = ok and not tree.turned(left, right)
            depth += 1
        q, _, value, grad = now
        rate = tree.alpha / max(tree.n_alpha, 1)
        if it < options.warmup:
            count += 1
            h_bar = (1 - 1 / (count + 10)) * h_bar + (options.acceptance - rate) / (count + 10)
            log_step = mu - math.sqrt(count) / 0.05 * h_bar
            eta = count**-0.75
            log_bar = eta * log_step + (1 - eta) * log_bar
            step = math.exp(log_step)
            if it >= options.warmup // 10:
                window.append(q)
            if it + 1 == window_end and len(window) > 10:
                new = _mass(np.array(window), options.dense_mass)
                if new is None:
                    failures += 1
                else:
                    metric, updates = new, updates + 1
                    step = first_step(target, q, metric, rng)
                    mu, h_bar, log_bar, count = math.log(10 * step), 0.0, math.log(step), 0
                window, width = [], width * 2
                window_end = min(it + 1 + width, max(options.warmup - 50, it + 2))
            if it + 1 == options.warmup:
                step = math.exp(log_bar)
        else:
            accept += rate
            divergences += int(tree.divergent)
            depth_hits += int(depth == options.max_depth)
            out["draws"].append(q.copy())
            out["log_density"].append(value)
            out["energy"].append(-start)
    return out | {"acceptance": accept / max(1, options.draws), "step_size": step, "divergences": divergences, "depth_hits": depth_hits, "mass_updates": updates, "mass_update_failures": failures}


def _mass(draws: np.ndarray, dense: bool) -> np.ndarray | None:
    """Regularised covariance (dense) or variances of a window, or None if unusable."""
    n = len(draws)
    shrink = n / (n + 5.0)
    if dense:
        c = shrink * np.atleast_2d(np.cov(draws.T)) + 1e-3 * (1 - shrink) * np.eye(draws.shape[1])
        return c if np.isfinite(c).all() and np.linalg.eigvalsh(c)[0] > 0 else None
    v = shrink * draws.var(0, ddof=1) + 1e-3 * (1 - shrink)
    return v if np.isfinite(v).all() and (v > 0).all() else None


def initial_states(mode: np.ndarray, chains: int, jitter: float = 0.01, seed: int = 8675309) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.asarray(mode, float) + jitter * rng.standard_normal(len(mode)) for _ in range(chains)]


DRAWS = "chain int, iteration int, parameter string, value double, log_density double, energy double"
CHAINS = "chain int, acceptance double, step_size double, divergences long, depth_hits long, mass_updates long, mass_update_failures long"


def sample(spark: SparkSession, make_target: Callable[[], Target], names: list[str], mode: np.ndarray, *, chains: int = 4, options: Options | None = None) -> DataFrame:
    """Draws of all chains in long form, iterations from 0; one task per chain.

    ``make_target`` is called in each task. A chain's seed comes from the options' seed and the chain
    number alone, so draws don't depend on the cluster.
    """
    if chains < 2:
        raise ValueError("at least two chains")
    if len(set(names)) != len(names) or not all(names):
        raise ValueError("parameter names must be unique and not empty")
    o = options or Options()
    starts = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(initial_states(mode, chains, seed=o.seed))], "chain int, start array<double>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.chain.iloc[0])
        r = sample_chain(make_target(), np.array(pdf.start.iloc[0]), o, mix_seed(o.seed + k + 1))
        d, n = np.array(r["draws"]), len(names)
        return pd.DataFrame({"chain": k, "iteration": np.repeat(np.arange(len(d)), n), "parameter": names * len(d), "value": d.reshape(-1), "log_density": np.repeat(r["log_density"], n), "energy": np.repeat(r["energy"], n), **{c: r[c] for c in ("acceptance", "step_size", "divergences", "depth_hits", "mass_updates", "mass_update_failures")}})

    return starts.repartition(chains, "chain").groupBy("chain").applyInPandas(run, DRAWS + ", " + CHAINS.split(", ", 1)[1])


def simulate(draws: DataFrame, names: list[str], quantities: list[str], simulator: Callable[[np.ndarray, np.random.Generator], np.ndarray], *, healthy: bool, every: int = 1, most: int = 1000, seed: int = 1) -> DataFrame:
    """Posterior predictive quantities (chain, iteration, quantity, value) of thinned draws.

    Refuses an unhealthy posterior. Each draw has a random stream of its own from (seed, chain,
    iteration), so results don't depend on partitioning.
    """
    if not healthy:
        raise ValueError("the posterior failed its health checks")
    wide = draws.groupBy("chain", "iteration").pivot("parameter", names).agg(F.first("value"))
    chosen = wide.filter(F.col("iteration") % every == 0).orderBy("chain", "iteration").limit(most)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng(mix_seed(mix_seed(seed ^ mix_seed(int(r[0]))) ^ int(r[1])))
                out += [(r[0], r[1], q, float(v)) for q, v in zip(quantities, simulator(np.array(r[2:], float), rng), strict=True)]
            yield pd.DataFrame(out, columns=["chain", "iteration", "quantity", "value"])

    return chosen.mapInPandas(run, "chain int, iteration int, quantity string, value double")


@dataclass
class RealNVP:
    """A trained flow: standardise, then affine couplings with alternating masks, scale = limit * tanh.

    Each layer: mask, and weights of two small networks as lists of (W, b) with tanh between.
    """

    mean: np.ndarray
    sd: np.ndarray
    layers: list[tuple[np.ndarray, list, list]]
    limit: float = 2.0

    def _net(self, net, x):
        for k, (w, b) in enumerate(net):
            x = x @ w.T + b
            if k + 1 < len(net):
                x = np.tanh(x)
        return x

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(latent z, log |dz / dx|)."""
        z = (x - self.mean) / self.sd
        log_det = np.full(len(z), -np.log(self.sd).sum())
        for mask, scale, shift in self.layers:
            s = self.limit * np.tanh(self._net(scale, z * mask)) * (1 - mask)
            z = z * mask + (1 - mask) * (z * np.exp(s) + self._net(shift, z * mask))
            log_det += s.sum(1)
        return z, log_det

    def inverse(self, z: np.ndarray) -> np.ndarray:
        for mask, scale, shift in reversed(self.layers):
            s = self.limit * np.tanh(self._net(scale, z * mask)) * (1 - mask)
            z = z * mask + (1 - mask) * (z - self._net(shift, z * mask)) * np.exp(-s)
        return z * self.sd + self.mean

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z, log_det = self.forward(x)
        return -0.5 * (z * z).sum(1) - 0.5 * z.shape[1] * math.log(2 * math.pi) + log_det
