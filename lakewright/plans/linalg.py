"""Structured symmetric matrices on the driver or in a grouped-map task: factor, solve, determinant, inverse entries.

One back-end each for diagonal, tridiagonal, banded, sparse and dense matrices, chosen by ``backend_for``.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field

import numpy as np

DENSE_SIDE = 4096


class NotPositiveDefinite(ValueError):
    pass


def solve_tridiagonal(d: np.ndarray, e: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve with diagonal d and off-diagonal e (symmetric, positive definite)."""
    return Tridiagonal(d, e).solve(b)


@dataclass
class Diagonal:
    d: np.ndarray

    def __post_init__(self):
        if not (self.d > 0).all():
            raise NotPositiveDefinite("a pivot is not positive")

    def logdet(self) -> float:
        return float(np.log(self.d).sum())

    def solve(self, b: np.ndarray) -> np.ndarray:
        return b / (self.d if b.ndim == 1 else self.d[:, None])

    def inverse_diagonal(self) -> np.ndarray:
        return 1 / self.d

    def inverse_band(self) -> tuple[np.ndarray, np.ndarray]:
        return 1 / self.d, np.zeros(max(len(self.d) - 1, 0))


@dataclass
class Tridiagonal:
    """Symmetric, diagonal d [..., n] and off-diagonal e [..., n - 1]; leading axes are matrices factored at once.

    Every other unknown is eliminated at a time, so a level is a few array operations and there are about
    log2(n) levels; pivots of all levels are positive just where the matrix is positive definite.
    """

    d: np.ndarray
    e: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(init=False, repr=False)

    def __post_init__(self):
        d, e, self.levels = np.asarray(self.d, float), np.asarray(self.e, float), []
        while d.shape[-1] > 1:
            # unknown 2k + 1 goes; left and right are its couplings to 2k and 2k + 2
            pivot, left, right = d[..., 1::2], e[..., 0::2], e[..., 1::2]
            if not (pivot > 0).all():
                raise NotPositiveDefinite("a pivot is not positive")
            self.levels.append((pivot, left, right))
            rest = d[..., 0::2].copy()
            k = right.shape[-1]
            rest[..., : left.shape[-1]] -= left * left / pivot
            rest[..., 1 : k + 1] -= right * right / pivot[..., :k]
            d, e = rest, -(left[..., :k] * right / pivot[..., :k])[..., : rest.shape[-1] - 1]
        if not (d > 0).all():
            raise NotPositiveDefinite("a pivot is not positive")
        self.last = d

    def logdet(self) -> float | np.ndarray:
        out = np.log(self.last).sum(-1) + sum(np.log(p).sum(-1) for p, _, _ in self.levels)
        return float(out) if out.ndim == 0 else out

    def solve(self, b: np.ndarray) -> np.ndarray:
        """Solutions for b of shape [n], [n, m] for one matrix, or [..., n] for several."""
        b = np.asarray(b, float)
        if np.ndim(self.d) == 1 and b.ndim == 2:
            each = Tridiagonal.__new__(Tridiagonal)
            each.d, each.e, each.last = self.d[None], self.e[None], self.last[None]
            each.levels = [(p[None], x[None], y[None]) for p, x, y in self.levels]
            return each.solve(b.T).T
        held = []
        for pivot, left, right in self.levels:
            odd, rest, k = b[..., 1::2], b[..., 0::2].copy(), right.shape[-1]
            held.append(odd)
            rest[..., : left.shape[-1]] -= left / pivot * odd
            rest[..., 1 : k + 1] -= right / pivot[..., :k] * odd[..., :k]
            b = rest
        x = b / self.last
        for (pivot, left, right), odd in zip(reversed(self.levels), reversed(held), strict=True):
            k = right.shape[-1]
            mine = odd - left * x[..., : left.shape[-1]]
            mine[..., :k] -= right * x[..., 1 : k + 1]
            both = np.empty((*x.shape[:-1], x.shape[-1] + odd.shape[-1]))
            both[..., 0::2], both[..., 1::2] = x, mine / pivot
            x = both
        return x

    def inverse_band(self) -> tuple[np.ndarray, np.ndarray]:
        """Diagonal and first off-diagonal of the inverse, back through the levels."""
        diag, off = 1 / self.last, np.zeros((*self.last.shape[:-1], 0))
        for pivot, left, right in reversed(self.levels):
            k, m = right.shape[-1], left.shape[-1]
            r = np.zeros_like(left)
            r[..., :k] = right
            over = np.zeros_like(left)  # between the neighbours of what was eliminated
            over[..., :k] = off[..., :k]
            beyond = np.zeros_like(left)
            beyond[..., :k] = diag[..., 1 : k + 1]
            before = diag[..., :m]
            to_left, to_right = -(left * before + r * over) / pivot, -(left * over + r * beyond) / pivot
            own = 1 / pivot - (left * to_left + r * to_right) / pivot
            all_diag = np.empty((*diag.shape[:-1], diag.shape[-1] + m))
            all_off = np.empty((*diag.shape[:-1], diag.shape[-1] + m - 1))
            all_diag[..., 0::2], all_diag[..., 1::2] = diag, own
            all_off[..., 0::2], all_off[..., 1::2] = to_left, to_right[..., : all_off.shape[-1] // 2]
            diag, off = all_diag, all_off
        return diag, off

    def inverse_diagonal(self) -> np.ndarray:
        return self.inverse_band()[0]


@dataclass
class Banded:
    """bands[k][i] is the entry (i + k, i). Factored as a block tridiagonal matrix with blocks as wide as the band."""

    bands: list[np.ndarray]

    def __post_init__(self):
        self.n, w = len(self.bands[0]), max(len(self.bands) - 1, 1)
        self.w, self.count = w, -(-self.n // w)
        padded = self.count * w
        # rows of a dense strip: row i holds entries (i, i - w .. i + w), unknowns beyond n alone with 1
        strip = np.zeros((padded, 2 * w + 1))
        strip[:, w] = 1.0
        for k, band in enumerate(self.bands):
            x = np.asarray(band, float)[: max(self.n - k, 0)]
            strip[: len(x), w + k] = x
            strip[k : k + len(x), w - k] = x
        self.factors: list[np.ndarray] = []
        self.below: list[np.ndarray] = []
        i = np.arange(w)
        for b in range(self.count):
            rows = strip[b * w : (b + 1) * w]
            own = rows[i[:, None], np.clip(i[None, :] - i[:, None] + w, 0, 2 * w)]
            if b:
                at = i[None, :] - w - i[:, None] + w
                coupling = np.where(at >= 0, rows[i[:, None], np.clip(at, 0, 2 * w)], 0.0)
                half = _lower_solve(self.factors[-1], coupling.T)
                self.below.append(half.T)
                own = own - half.T @ half
            try:
                self.factors.append(np.linalg.cholesky(own))
            except np.linalg.LinAlgError as e:
                raise NotPositiveDefinite(str(e)) from e

    def logdet(self) -> float:
        return float(2 * sum(np.log(np.diagonal(f)).sum() for f in self.factors))

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = np.zeros((self.count * self.w, *np.shape(b)[1:]))
        x[: self.n] = b
        x = x.reshape(self.count, self.w, -1)
        for k, f in enumerate(self.factors):
            x[k] = _lower_solve(f, x[k] - (self.below[k - 1] @ x[k - 1] if k else 0.0))
        for k in range(self.count - 1, -1, -1):
            x[k] = np.linalg.solve(self.factors[k].T, x[k] - (self.below[k].T @ x[k + 1] if k + 1 < self.count else 0.0))
        return x.reshape(self.count * self.w, *np.shape(b)[1:])[: self.n]

    def inverse_diagonal(self) -> np.ndarray:
        out, own, last = np.empty((self.count, self.w)), np.eye(self.w), None
        for k in range(self.count - 1, -1, -1):
            root = _lower_solve(self.factors[k], own)
            block = root.T @ root
            if last is not None:
                through = self.below[k] @ root
                block = block + through.T @ last @ through
            out[k], last = np.diagonal(block), block
        return out.reshape(-1)[: self.n]


def _lower_solve(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(factor, b)


@dataclass(frozen=True)
class Pattern:
    """Elimination order and factor structure of a symmetric sparsity pattern: worked out once, used for any values."""

    n: int
    order: np.ndarray  # unknowns in the order of elimination
    place: np.ndarray  # of each unknown in it
    below: tuple[np.ndarray, ...]  # by place: later places that its factor column reaches

    @classmethod
    def of(cls, n: int, i: np.ndarray, j: np.ndarray) -> Pattern:
        """By least degree: the unknown of fewest remaining neighbours goes next, and its neighbours become one clique."""
        near: list[set[int]] = [set() for _ in range(n)]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if a != b:
                near[a].add(b)
                near[b].add(a)
        heap = [(len(x), k) for k, x in enumerate(near)]
        heapq.heapify(heap)
        place, order, reach = np.full(n, -1), [], []
        while heap:
            size, k = heapq.heappop(heap)
            if place[k] >= 0 or size != len(near[k]):
                continue
            place[k] = len(order)
            order.append(k)
            reach.append(near[k])
            for x in near[k]:
                near[x] |= near[k]
                near[x] -= {k, x}
                heapq.heappush(heap, (len(near[x]), x))
        return cls(n, np.array(order, int), place, tuple(np.sort(place[list(r)]).astype(int) if r else np.zeros(0, int) for r in reach))


#: Patterns by what they are of, and how often one was found again or made.
_patterns: dict[bytes, Pattern] = {}
PATTERN_USES = {"found": 0, "made": 0}
MOST_PATTERNS = 64


def pattern_for(n: int, i: np.ndarray, j: np.ndarray) -> Pattern:
    """The pattern of entries (i, j), kept for the next matrix of the same pattern."""
    key = hashlib.sha256(np.concatenate([[n], np.unique(np.minimum(i, j).astype(np.int64) * n + np.maximum(i, j))]).tobytes()).digest()
    if key in _patterns:
        PATTERN_USES["found"] += 1
        return _patterns[key]
    PATTERN_USES["made"] += 1
    if len(_patterns) >= MOST_PATTERNS:
        _patterns.clear()
    _patterns[key] = Pattern.of(n, i, j)
    return _patterns[key]


@dataclass
class Sparse:
    """L D L' of a symmetric matrix given by entries (i, j, value), each of a pair (i, j) and (j, i) at most once or both."""

    n: int
    i: np.ndarray
    j: np.ndarray
    value: np.ndarray

    def __post_init__(self):
        p = self.pattern = pattern_for(self.n, self.i, self.j)
        a, b = p.place[self.i], p.place[self.j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        key, first = np.unique(low * self.n + high, return_index=True)
        value = np.asarray(self.value, float)[first]
        self.pivots = np.zeros(self.n)
        columns = [np.zeros(len(x)) for x in p.below]
        for k, v in zip(key.tolist(), value.tolist(), strict=True):
            c, r = divmod(k, self.n)
            if c == r:
                self.pivots[c] = v
            else:
                columns[c][np.searchsorted(p.below[c], r)] = v
        for c, (rows, x) in enumerate(zip(p.below, columns, strict=True)):
            d = self.pivots[c]
            if not d > 0:
                raise NotPositiveDefinite("a pivot is not positive")
            l = x / d
            columns[c] = l
            self.pivots[rows] -= l * x
            for q in range(len(rows) - 1):
                to = rows[q]
                columns[to][np.searchsorted(p.below[to], rows[q + 1 :])] -= l[q + 1 :] * x[q]
        self.columns = columns

    def logdet(self) -> float:
        return float(np.log(self.pivots).sum())

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = np.array(b, float)[self.pattern.order]
        for c, (rows, l) in enumerate(zip(self.pattern.below, self.columns, strict=True)):
            if len(rows):
                x[rows] -= np.multiply.outer(l, x[c])
        x = x / (self.pivots if x.ndim == 1 else self.pivots[:, None])
        for c in range(self.n - 1, -1, -1):
            rows = self.pattern.below[c]
            if len(rows):
                x[c] -= self.columns[c] @ x[rows]
        return x[self.pattern.place]

    def selected_inverse(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(diagonal, entries below it) of the inverse where the factor has entries, by places, last to first."""
        below, diag = self.pattern.below, np.empty(self.n)
        out: list[np.ndarray] = [np.zeros(0)] * self.n
        for c in range(self.n - 1, -1, -1):
            rows, l = below[c], self.columns[c]
            if len(rows):
                z = np.empty((len(rows), len(rows)))
                for q, r in enumerate(rows):
                    z[q, q] = diag[r]
                    z[q, q + 1 :] = z[q + 1 :, q] = out[r][np.searchsorted(below[r], rows[q + 1 :])]
                out[c] = -z @ l
            diag[c] = 1 / self.pivots[c] - l @ out[c]
        return diag, out

    def inverse_diagonal(self) -> np.ndarray:
        return self.selected_inverse()[0][self.pattern.place]

    def trace_product(self, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> float:
        """trace(A**-1 B) for a symmetric B with entries, (i, j) and (j, i) both given, inside A's factor pattern."""
        diag, out = self.selected_inverse()
        a, b = self.pattern.place[i], self.pattern.place[j]
        total = 0.0
        for low, high, v in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), np.asarray(value).tolist(), strict=True):
            if low == high:
                total += diag[low] * v
                continue
            at = int(np.searchsorted(self.pattern.below[low], high))
            if at == len(self.pattern.below[low]) or self.pattern.below[low][at] != high:
                raise IndexError("an entry is outside the factor's pattern")
            total += out[low][at] * v
        return total


@dataclass
class Dense:
    a: np.ndarray

    def __post_init__(self):
        if len(self.a) > DENSE_SIDE:
            raise ValueError(f"side {len(self.a)} is too large for a dense factor")
        try:
            self.factor = np.linalg.cholesky(self.a)
        except np.linalg.LinAlgError as e:
            raise NotPositiveDefinite(str(e)) from e

    def logdet(self) -> float:
        return float(2 * np.log(np.diag(self.factor)).sum())

    def solve(self, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, b))

    def inverse(self) -> np.ndarray:
        return self.solve(np.eye(len(self.a)))

    def inverse_diagonal(self) -> np.ndarray:
        return np.diag(self.inverse())


def bandwidth(a: np.ndarray, tol: float = 1e-12) -> int:
    i, j = np.nonzero(np.abs(a) > tol)
    return int(np.abs(i - j).max()) if len(i) else 0


def backend_for(a: np.ndarray, *, max_band: int = 64, dense_fill: float = 0.25, small: int = 16) -> Diagonal | Tridiagonal | Banded | Sparse | Dense:
    """The back-end by structure: diagonal, tridiagonal, narrow band, small or full and so dense, else sparse."""
    w, fill = bandwidth(a), np.count_nonzero(np.abs(a) > 1e-12) / max(a.size, 1)
    if w == 0:
        return Diagonal(np.diag(a).copy())
    if w == 1:
        return Tridiagonal(np.diag(a).copy(), np.diag(a, -1).copy())
    if w <= max_band and fill < dense_fill:
        return Banded([np.diag(a, -k).copy() for k in range(w + 1)])
    if len(a) > small and fill < dense_fill:
        i, j = np.nonzero(np.abs(np.tril(a)) > 1e-12)
        return Sparse(len(a), i, j, a[i, j])
    return Dense(a)


def with_jitter(a: np.ndarray, start: float = 1e-12, factor: float = 10.0, attempts: int = 12):
    """Factor, adding growing multiples of the identity until it succeeds; returns (factor, jitter)."""
    jitter = 0.0
    for _ in range(attempts + 1):
        try:
            return backend_for(a + jitter * np.eye(len(a))), jitter
        except NotPositiveDefinite:
            jitter = start if jitter == 0 else jitter * factor
    raise NotPositiveDefinite(f"not positive definite with jitter {jitter}")


def hutchinson_trace(solve, product, n: int, probes: int = 8, seed: int = 12345) -> float:
    """Estimate of trace(A**-1 B) from Rademacher probes."""
    z = np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, probes))
    return float((z * solve(product(z))).sum() / probes)


def inverse_entries(factor, pairs: list[tuple[int, int]], n: int) -> np.ndarray:
    """Requested entries of the inverse, one solve per distinct column."""
    if any(not (0 <= i < n and 0 <= j < n) for i, j in pairs):
        raise IndexError("an entry is out of range")
    columns = sorted({j for _, j in pairs})
    unit = np.zeros((n, len(columns)))
    unit[columns, range(len(columns))] = 1
    solved, at = factor.solve(unit), {j: k for k, j in enumerate(columns)}
    return np.array([solved[i, at[j]] for i, j in pairs])


def covariance_from_hessian(h: np.ndarray) -> np.ndarray | None:
    """Inverse of a positive definite matrix, else None."""
    try:
        return Dense(h).inverse()
    except NotPositiveDefinite:
        return None


def spectral_summary(h: np.ndarray) -> dict[str, float]:
    """Inertia, entropy effective rank, participation ratio, stable rank and eigenvalues that hold shares of the absolute spectrum."""
    values = np.linalg.eigvalsh(h)
    a = np.sort(np.abs(values))[::-1]
    share = a / a.sum() if a.sum() > 0 else a
    some = share[share > 0]
    run = np.cumsum(share)
    out = {
        "positive": int((values > 1e-12).sum()),
        "negative": int((values < -1e-12).sum()),
        "zero": int((np.abs(values) <= 1e-12).sum()),
        "effective_rank": float(np.exp(-(some * np.log(some)).sum())) if len(some) else 0.0,
        "participation_ratio": float(a.sum() ** 2 / (a**2).sum()) if a.any() else 0.0,
        "stable_rank": float((a**2).sum() / a[0] ** 2) if a.any() else 0.0,
    }
    return out | {f"k_{int(100 * t)}": int(np.searchsorted(run, t - 1e-12) + 1) for t in (0.5, 0.9, 0.95, 0.99)}


def marginal_variance(inverse_diagonal: np.ndarray, du: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Conditional variance of random effects plus the part through fixed effects: diag(H**-1) + diag(du C du')."""
    return inverse_diagonal + np.einsum("ij,jk,ik->i", du, cov, du)


def predictor_variance(factor, z: np.ndarray, x: np.ndarray, du: np.ndarray, cov: np.ndarray, block: int = 256) -> np.ndarray:
    """Variance of each row of X theta + Z u, block by block."""
    out = np.empty(len(z))
    for lo in range(0, len(z), block):
        zb = z[lo : lo + block]
        j = x[lo : lo + block] + zb @ du
        out[lo : lo + block] = np.einsum("ij,ji->i", zb, factor.solve(zb.T)) + np.einsum("ij,jk,ik->i", j, cov, j)
    return out


def diagnose_covariance(c: np.ndarray, symmetry_tol: float = 1e-8, psd_tol: float = 1e-8) -> dict[str, object]:
    """Finite, positive diagonal, symmetry, eigenvalue range and the verdict."""
    finite = bool(np.isfinite(c).all())
    asymmetry = float(np.abs(c - c.T).max()) if finite and c.size else 0.0
    eig = np.linalg.eigvalsh((c + c.T) / 2) if finite and c.size else np.array([np.nan])
    positive = bool((np.diag(c) > 0).all())
    return {"finite": finite, "positive_diagonal": positive, "max_asymmetry": asymmetry, "min_eigenvalue": float(eig[0]), "max_eigenvalue": float(eig[-1]), "valid": finite and positive and asymmetry <= symmetry_tol and bool(eig[0] >= -psd_tol)}
