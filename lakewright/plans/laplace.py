"""Laplace-approximate marginal likelihoods.

``GroupedLaplace``: rows in a DataFrame, one random effect per group or a few. Everything is aggregation:
a Newton step is one groupBy over the observations, groups stay distributed and only sums come to the
driver. ``ChainLaplace``: a series with one state per step, whose curvature is tridiagonal; runs in
numpy, for many series as a grouped map. Both give the value, the marginal gradient (with half the
trace of H**-1 dH) and the envelope gradient (without it).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.plans import expr as X
from lakewright.plans.linalg import NotPositiveDefinite, Tridiagonal
from lakewright.plans.sums import ONE, Plan, staged
from lakewright.session import Tables, cut

LOG_2PI = math.log(2 * math.pi)


#: Rows of a group that one task sums at most; a larger group is dealt over several.
SLICE_ROWS = 1 << 20
#: The most parameter weights of directions, which are broadcast.
MOST_DIRECTIONS = 100_000
#: Part of the expected decrease that a Newton step must reach.
ARMIJO = 1e-4


class NotConverged(ValueError):
    pass


def _plus(*xs: Column | None) -> Column | None:
    """The sum of Columns; None is a structural zero."""
    return _fold([x for x in xs if x is not None])


def _fold(xs: list[Column]) -> Column | None:
    return reduce(lambda a, b: a + b, xs) if xs else None


def _minus(x: Column | None) -> Column | None:
    return None if x is None else -x


def _times(*xs: Column | None) -> Column | None:
    return None if any(x is None for x in xs) else reduce(lambda a, b: a * b, xs)


def _or_zero(x: Column | None) -> Column:
    return F.lit(0.0) if x is None else x


class _Sheet:
    """A DataFrame that is widened step by step: ``put`` names Columns, ``done`` makes them columns, so that later
    ones refer to names and not to ever longer expressions."""

    def __init__(self, df: DataFrame, prefix: str):
        self.df, self.prefix, self.pending, self.made = df, prefix, {}, 0

    def put(self, x: Column | None) -> Column | None:
        if x is None:
            return None
        name = f"{self.prefix}{self.made}"
        self.made += 1
        self.pending[name] = x
        return F.col(name)

    def done(self) -> None:
        if self.pending:
            self.df, self.pending = self.df.withColumns(self.pending), {}


def cholesky_columns(sheet: _Sheet, h: Callable[[int, int], Column | None], k: int) -> dict[tuple[int, int], Column | None]:
    """Lower Cholesky factors of packed symmetric k x k blocks (h(i, j), i <= j) as columns; null where a
    block is not positive definite."""
    low: dict[tuple[int, int], Column | None] = {}
    for j in range(k):
        taken = _fold([low[j, m] * low[j, m] for m in range(j) if low[j, m] is not None])
        pivot = sheet.put(_or_zero(h(j, j)) if taken is None else _or_zero(h(j, j)) - taken)
        sheet.done()
        low[j, j] = sheet.put(F.when(pivot > 0, F.sqrt(pivot)))
        sheet.done()
        for i in range(j + 1, k):
            taken = _fold([low[i, m] * low[j, m] for m in range(j) if low[i, m] is not None and low[j, m] is not None])
            left = h(j, i) if taken is None else _or_zero(h(j, i)) - taken
            low[i, j] = sheet.put(_times(left, 1 / low[j, j]))
        sheet.done()
    return low


def inverse_columns(sheet: _Sheet, low: dict[tuple[int, int], Column | None], k: int) -> Callable[[int, int], Column | None]:
    """Entries (i, j) of the inverse blocks from their Cholesky factors."""
    back: dict[tuple[int, int], Column | None] = {}
    for i in range(k):
        for j in range(i):
            through = _fold([low[i, m] * back[m, j] for m in range(j, i) if low[i, m] is not None and back[m, j] is not None])
            back[i, j] = sheet.put(None if through is None else -through / low[i, i])
        back[i, i] = sheet.put(1 / low[i, i])
        sheet.done()
    inverse = {}
    for i in range(k):
        for j in range(i, k):
            inverse[i, j] = sheet.put(_fold([back[m, i] * back[m, j] for m in range(j, k) if back[m, i] is not None and back[m, j] is not None]))
    sheet.done()
    return lambda i, j: inverse[min(i, j), max(i, j)]


@dataclass
class GroupedLaplace:
    """f(theta, u) = sum of ``row`` over observations + sum of ``prior`` over groups, with the random effects
    named in ``effect`` (one name, or a few), a value of each per group.

    Rows with a null group or a null in a data column that the model uses are left out. Derivatives are
    sums over rows as ``sums.Plan`` makes them: statistics of data alone are summed once and kept, one row
    per group; where no others are needed, observations are not read again. Blocks of k effects are
    packed symmetric columns, factored as Columns, so k should be small. ``converged`` says whether the
    last search for modes ended within its tolerance, ``rounds`` what each of its rounds read, as (groups,
    rows). ``close`` gives what is kept back.
    """

    rows: DataFrame
    group: str
    row: X.Expr
    prior: X.Expr
    params: list[str]
    effect: str | tuple[str, ...] = "u"
    modes: DataFrame | None = field(default=None, repr=False)
    converged: bool = field(default=False, init=False)
    rounds: list[tuple[int, int]] = field(default_factory=list, init=False)

    def __post_init__(self):
        self.effects = [self.effect] if isinstance(self.effect, str) else list(self.effect)
        self.u = [X.random(e) for e in self.effects]
        self.theta = [X.param(p) for p in self.params]
        self.used = sorted({d.args[0] for d in X.leaves(self.row, "data")})
        obs = self.rows.select(F.col(self.group).alias("__g"), *[F.col(c).cast("double").alias(c) for c in self.used])
        obs = obs.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in obs.columns]))
        # dealt by group (large ones in slices) once: no later aggregation or join with modes moves the observations
        counts = obs.groupBy("__g").agg(F.count("*").alias("__n"))
        large = counts.filter(F.col("__n") > SLICE_ROWS).select("__g", F.ceil(F.col("__n") / F.lit(SLICE_ROWS)).alias("__slices"))
        self.sliced = not large.isEmpty()
        if self.sliced:
            # groups above SLICE_ROWS rows: no more of them than the table has rows over SLICE_ROWS
            self.large = cut(large)
            obs = cut(obs.withColumn("__row", F.monotonically_increasing_id()))  # a row stays in its slice when a task runs again
            obs = obs.join(F.broadcast(self.large), "__g", "left").withColumn("__s", F.when(F.col("__slices").isNotNull(), F.pmod(F.xxhash64("__row"), F.col("__slices"))).otherwise(F.lit(0)).cast("int")).drop("__slices", "__row")
            self.keys = ["__g", "__s"]
        else:
            self.keys = ["__g"]
        self.obs = obs.repartition(*self.keys).persist()
        self.statistics: dict[X.Expr, str] = {}
        self.groups: DataFrame | None = None

    def close(self) -> None:
        self.obs.unpersist()
        if self.groups is not None:
            self.groups.unpersist()

    def _derivative(self, us: tuple[int, ...] = (), ts: tuple[int, ...] = ()) -> tuple[X.Expr, X.Expr]:
        """Row and prior differentiated by effects and parameters, given by their numbers."""
        out = []
        for e in (self.row, self.prior):
            for by in [*[self.u[i] for i in sorted(us)], *[self.theta[t] for t in sorted(ts)]]:
                e = X.diff(e, by)
            out.append(e)
        return tuple(out)

    @staticmethod
    def _name(us: tuple[int, ...] = (), ts: tuple[int, ...] = ()) -> str:
        return "__p" + "".join(f"_u{i}" for i in sorted(us)) + "".join(f"_t{t}" for t in sorted(ts))

    def _parts(self, order: int, *, params: int = 0) -> dict[str, tuple[X.Expr, X.Expr]]:
        """All derivatives of up to ``order`` in effects and parameters together, up to ``params`` in parameters."""
        k, p = range(len(self.u)), range(len(self.theta))
        out = {}
        for n in range(order + 1):
            for m in range(min(n, params) + 1):
                for us in combinations_with_replacement(k, n - m):
                    for ts in combinations_with_replacement(p, m):
                        out[self._name(us, ts)] = self._derivative(us, ts)
        return out

    def plan(self, parts: dict[str, tuple[X.Expr, X.Expr]]) -> Plan:
        return Plan({n: r for n, (r, _) in parts.items()})

    def _group_table(self, plan: Plan) -> DataFrame:
        """(__g, __n, statistics): one row per group, kept; summed anew only where a plan needs other statistics."""
        fresh = [r for r in plan.static if r not in self.statistics]
        if self.groups is None or fresh:
            for r in fresh:
                self.statistics[r] = f"__s{len(self.statistics)}"
            values = {X.data(c): F.col(c) for c in self.used}
            sums = self.obs.groupBy(*self.keys).agg(F.count("*").alias("__n"), *[F.sum(X.to_column(r, values)).alias(n) for r, n in self.statistics.items()])
            if self.sliced:
                sums = sums.groupBy("__g").agg(F.sum("__n").alias("__n"), *[F.sum(n).alias(n) for n in self.statistics.values()])
            old, self.groups = self.groups, sums.persist()
            if old is not None:
                old.unpersist()
        return self.groups

    def _by_group(self, modes: DataFrame, theta: np.ndarray, parts: dict[str, tuple[X.Expr, X.Expr]]) -> tuple[DataFrame, Callable[..., Column | None]]:
        """(__g, effects, __n and parts of each group of ``modes`` at its mode, what finds a part by effect and
        parameter numbers: None where it is zero for all).

        Parameters come as a row of one, not as literals: the generated code stays the same and is
        compiled once for all evaluations.
        """
        plan, names = self.plan(parts), [f"__t{k}" for k in range(len(self.theta))]
        table = self._group_table(plan)
        point = F.broadcast(self.rows.sparkSession.createDataFrame([tuple(float(t) for t in theta)], ", ".join(f"{n} double" for n in names)))
        values: dict[X.Expr, Column] = {p: F.col(n) for p, n in zip(self.theta, names, strict=True)} | {u: F.col(e) for u, e in zip(self.u, self.effects, strict=True)}
        met = modes.join(table, "__g")
        if plan.moving:
            at = modes
            if self.sliced:
                at = modes.join(F.broadcast(self.large), "__g", "left").withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)).cast("int") - 1))).drop("__slices")
            rows, known = staged(self.obs.join(at, self.keys).crossJoin(point), plan.moving, values | {X.data(c): F.col(c) for c in self.used}, "__x")
            sums = [F.sum(X.to_column(r, values, known)).alias(f"__m{k}") for k, r in enumerate(plan.moving)]
            moved = rows.groupBy(*self.keys).agg(*sums)
            if self.sliced:
                moved = moved.groupBy("__g").agg(*[F.sum(f"__m{k}").alias(f"__m{k}") for k in range(len(plan.moving))])
            met = met.join(moved, "__g")
        met = met.crossJoin(point)
        column = {r: F.col(n) for r, n in self.statistics.items()} | {r: F.col(f"__m{k}") for k, r in enumerate(plan.moving)} | {ONE: F.col("__n").cast("double")}
        priors = {n: p for n, (_, p) in parts.items() if not X.is_number(p, 0.0)}
        met, known = staged(met, [*[c for made in plan.recipe.values() for c in made.values()], *priors.values()], values, "__y")
        out: dict[str, Column] = {}
        for n in parts:
            made = [X.to_column(c, values, known) * column[r] if not X.is_number(c, 1.0) else column[r] for r, c in plan.recipe.get(n, {}).items()]
            total = _fold(made + ([X.to_column(priors[n], values, known)] if n in priors else []))
            if total is not None:
                out[n] = total.alias(n)
        found = met.select("__g", *self.effects, "__n", *out.values())

        def part(us: tuple[int, ...] = (), ts: tuple[int, ...] = ()) -> Column | None:
            n = self._name(us, ts)
            return F.col(n) if n in out else None

        return found, part

    def is_quadratic(self) -> bool:
        """Whether the curvature does not depend on the random effects, so that one Newton step is exact."""
        third = combinations_with_replacement(range(len(self.u)), 3)
        return all(X.is_number(e, 0.0) for us in third for e in self._derivative(us))

    def _steps(self, df: DataFrame, part: Callable[..., Column | None], bounded: bool = True) -> DataFrame:
        """``df`` with the steps __d0, __d1, .. and the slope along them: Newton's where the block is positive
        definite, else against the gradient over the block's largest row sum; bounded by the effects' size."""
        k = len(self.u)
        sheet = _Sheet(df, "__c")
        low = cholesky_columns(sheet, lambda i, j: part((i, j)), k)
        inverse = inverse_columns(sheet, low, k)
        g = [_or_zero(part((i,))) for i in range(k)]
        newton = [-_or_zero(_fold([x for j in range(k) if (x := _times(inverse(i, j), g[j])) is not None])) for i in range(k)]
        if bounded:
            rows = [_or_zero(_fold([F.abs(part((min(i, j), max(i, j)))) for j in range(k) if part((min(i, j), max(i, j))) is not None])) for i in range(k)]
            scale = F.greatest(*rows, F.lit(1e-200))
            step = [sheet.put(F.coalesce(n, -x / scale)) for n, x in zip(newton, g, strict=True)]
            sheet.done()
            # the whole step is shortened, so that it stays a descent
            ratio = [10 * (1 + F.abs(F.col(e))) / F.greatest(F.abs(s), F.lit(1e-200)) for e, s in zip(self.effects, step, strict=True)]
            short = sheet.put(F.least(F.lit(1.0), *ratio))
            sheet.done()
            newton = [s * short for s in step]
        out = sheet.df.withColumns({f"__d{i}": s for i, s in enumerate(newton)})
        return out.withColumn("__slope", _fold([x * F.col(f"__d{i}") for i, x in enumerate(g)]))

    def solve_modes(self, theta: np.ndarray, *, most: int = 25, tol: float = 1e-8) -> DataFrame:
        """(__g, effects): the mode of each group by damped Newton steps, all groups at once.

        Modes start where the last call ended. Each round reads the groups that are not finished, and no
        others; a group takes a step only if it lowers the objective enough (Armijo's rule), else half of
        it is tried next. Where the curvature is not positive definite the step goes against the gradient.
        ``converged`` is false where some group was unfinished after ``most`` rounds.
        """
        self.rounds = []
        curve = self._parts(2)
        everything = self._parts(3, params=1)
        zero = self._group_table(self.plan(everything)).select("__g", *[F.lit(0.0).alias(e) for e in self.effects])
        if self.is_quadratic():
            # one step is exact from anywhere, and cheap enough not to be kept
            now, part = self._by_group(zero, theta, {n: curve[n] for n in curve if n != self._name()})
            self.converged = True
            step = self._steps(now, part, bounded=False)
            return step.select("__g", *[F.col(f"__d{i}").alias(e) for i, e in enumerate(self.effects)])
        frontier = zero if self.modes is None else self.modes
        finished: list[DataFrame] = []
        state, self.converged = None, False
        tables = Tables(self.rows.sparkSession)
        moved = [F.col(e) + F.col("__t") * F.col(f"__d{i}") for i, e in enumerate(self.effects)]
        d = [f"__d{i}" for i in range(len(self.u))]
        for _ in range(most):
            now, part = self._by_group(frontier, theta, curve)
            now = self._steps(now, part)
            f = _or_zero(part())
            kept = [*self.effects, *d, "__f", "__slope"]
            new = now.select("__g", "__n", *self.effects, *d, f.alias("__f"), "__slope")
            if state is None:
                judged = new.select("__g", "__n", *kept, F.lit(1.0).alias("__t"), F.lit(True).alias("__took"))
            else:
                old = state.select("__g", *[F.col(c).alias(f"__o{c}") for c in [*kept, "__t"]])
                enough = F.col("__o__f") + ARMIJO * F.col("__o__t") * F.col("__o__slope") + 1e-10 * (1 + F.abs("__o__f"))
                met = new.join(old, "__g").withColumn("__took", F.coalesce(F.col("__f") <= enough, F.lit(False)))
                judged = met.select("__g", "__n", *[F.when(F.col("__took"), F.col(c)).otherwise(F.col(f"__o{c}")).alias(c) for c in kept], F.when(F.col("__took"), 1.0).otherwise(F.col("__o__t") / 2).alias("__t"), "__took")
            small = reduce(lambda a, b: a & b, [F.abs(F.col(x)) <= tol * (1 + F.abs(F.col(e))) for x, e in zip(d, self.effects, strict=True)])
            state = tables.write(judged.withColumn("__done", F.col("__took") & F.coalesce(small, F.lit(False))))
            read, rows, left = state.agg(F.count("*"), F.sum("__n"), F.count_if(~F.col("__done"))).first()
            self.rounds.append((read, rows or 0))
            finished.append(state.filter("__done").select("__g", *[m.alias(e) for m, e in zip(moved, self.effects, strict=True)]))
            state = state.filter("not __done")
            if left == 0:
                self.converged = True
                break
            frontier = state.select("__g", *[m.alias(e) for m, e in zip(moved, self.effects, strict=True)])
        if not self.converged:
            finished.append(state.select("__g", *self.effects))
        self.modes = cut(reduce(DataFrame.unionByName, finished))
        tables.drop()
        return self.modes

    def _at_modes(self, theta: np.ndarray, parts: dict[str, tuple[X.Expr, X.Expr]]):
        """(sheet over all groups at their modes, parts, inverse blocks, log determinant, whether a block is not
        positive definite)."""
        modes = self.solve_modes(theta)
        if not self.converged:
            raise NotConverged("modes were not found within the rounds allowed")
        per, part = self._by_group(modes, theta, parts)
        sheet, k = _Sheet(per, "__c"), len(self.u)
        low = cholesky_columns(sheet, lambda i, j: part((i, j)), k)
        inverse = inverse_columns(sheet, low, k)
        logdet = _fold([2 * F.ln(low[i, i]) for i in range(k)])
        bad = reduce(lambda a, b: a | b, [low[i, i].isNull() for i in range(k)])
        return sheet, part, inverse, logdet, bad

    def _slopes(self, sheet: _Sheet, part, inverse) -> dict[tuple[int, int], Column | None]:
        """du_i / d theta_a by the implicit function theorem, as columns."""
        k, p = range(len(self.u)), range(len(self.theta))
        out = {(i, a): sheet.put(_minus(_fold([x for j in k if (x := _times(inverse(i, j), part((j,), (a,)))) is not None]))) for i in k for a in p}
        sheet.done()
        return out

    def _curvature_slopes(self, sheet: _Sheet, part, du) -> dict[tuple[int, int, int], Column | None]:
        """Total derivative of block entry (i, j) by theta_a: directly and through the mode."""
        k, p = range(len(self.u)), range(len(self.theta))
        out = {}
        for a in p:
            for i in k:
                for j in range(i, len(self.u)):
                    through = [x for m in k if (x := _times(part((i, j, m)), du[m, a])) is not None]
                    own = part((i, j), (a,))
                    out[a, i, j] = out[a, j, i] = sheet.put(_fold(through + ([own] if own is not None else [])))
        sheet.done()
        return out

    def _trace(self, inverse, entry: Callable[[int, int], Column | None]) -> Column | None:
        """The trace of the inverse block times a symmetric block, in one pass over its entries."""
        k = len(self.u)
        return _fold([x for i in range(k) for j in range(i, k) if (x := _times(inverse(i, j), entry(i, j), F.lit(1.0 if i == j else 2.0))) is not None])

    def _totals(self, sheet: _Sheet, bad: Column, wanted: list[Column]) -> list[float]:
        groups, wrong, *sums = sheet.df.agg(F.count("*"), F.count_if(bad), *[F.sum(w) for w in wanted]).first()
        if wrong:
            raise NotPositiveDefinite(f"the curvature of {wrong} of {groups} groups is not positive definite at the mode")
        return [groups, *[x or 0.0 for x in sums]]

    def evaluate(self, theta: np.ndarray, *, gradient: bool = True, envelope: bool = False) -> tuple[float, np.ndarray]:
        """(value, gradient): value = f + log det H / 2 - G k log(2 pi) / 2 at the modes of G groups of k effects.

        NotConverged where the search for modes didn't end; NotPositiveDefinite where a group's curvature
        at its mode is not positive definite, as the approximation is not defined there. Without groups
        both are 0. Traces of the inverse curvature against its derivatives are taken in the pass that
        makes the derivatives.
        """
        k, p = len(self.u), len(self.theta)
        parts = self._parts(3, params=1) if gradient else {n: x for n, x in self._parts(2).items() if n.count("_u") != 1}
        sheet, part, inverse, logdet, bad = self._at_modes(theta, parts)
        wanted = [_or_zero(_plus(part(), 0.5 * logdet))]
        if gradient:
            du = {} if envelope else self._slopes(sheet, part, inverse)
            dh = {} if envelope else self._curvature_slopes(sheet, part, du)
            for a in range(p):
                trace = None if envelope else self._trace(inverse, lambda i, j, a=a: dh[a, i, j])
                wanted.append(_or_zero(_plus(part((), (a,)), _times(F.lit(0.5), trace))))
        groups, value, *g = self._totals(sheet, bad, wanted)
        return value - 0.5 * groups * k * LOG_2PI if groups else 0.0, np.array(g, dtype=float)

    def outer_hessian(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(value, gradient, Hessian) of the marginal objective, exact up to rounding.

        All entries come from one aggregation over groups: with u(theta) the mode, H its curvature and dots
        total derivatives, an entry is f_ab + f_au u_b + (tr(H**-1 H..ab) - tr(H**-1 H.a H**-1 H.b)) / 2, where
        H..ab needs fourth derivatives of the row and the second derivatives of the mode, which the implicit
        function theorem gives once more.
        """
        k, p = len(self.u), len(self.theta)
        ks, pairs = range(k), [(a, b) for a in range(p) for b in range(a, p)]
        sheet, part, inverse, logdet, bad = self._at_modes(theta, self._parts(4, params=2))
        du = self._slopes(sheet, part, inverse)
        dh = self._curvature_slopes(sheet, part, du)

        def along(us: tuple[int, ...], a: int, b: int) -> list[Column]:
            """Second total derivative of a part by theta_a and theta_b, without the mode's own second derivative."""
            own = [part(us, (a, b))]
            once = [_times(part((*us, m), (x,)), du[m, y]) for m in ks for x, y in ((a, b), (b, a))]
            twice = [_times(part((*us, m, n)), du[m, a], du[n, b]) for m in ks for n in ks]
            return [x for x in own + once + twice if x is not None]

        push = {(i, a, b): sheet.put(_fold(along((i,), a, b))) for a, b in pairs for i in ks}
        sheet.done()
        ddu = {(i, a, b): sheet.put(_minus(_fold([x for j in ks if (x := _times(inverse(i, j), push[j, a, b])) is not None]))) for a, b in pairs for i in ks}
        sheet.done()
        ddh = {}
        for a, b in pairs:
            for i in ks:
                for j in range(i, k):
                    third = [x for m in ks if (x := _times(part((i, j, m)), ddu[m, a, b])) is not None]
                    ddh[a, b, i, j] = sheet.put(_fold(along((i, j), a, b) + third))
        turned = {(a, i, j): sheet.put(_fold([x for m in ks if (x := _times(inverse(i, m), dh[a, m, j])) is not None])) for a in range(p) for i in ks for j in ks}
        sheet.done()
        wanted = [_or_zero(_plus(part(), 0.5 * logdet))]
        wanted += [_or_zero(_plus(part((), (a,)), _times(F.lit(0.5), self._trace(inverse, lambda i, j, a=a: dh[a, i, j])))) for a in range(p)]
        for a, b in pairs:
            joint = _plus(part((), (a, b)), *[_times(part((i,), (a,)), du[i, b]) for i in ks])
            bent = self._trace(inverse, lambda i, j, a=a, b=b: ddh[a, b, i, j])
            turn = _fold([x for i in ks for j in ks if (x := _times(turned[a, i, j], turned[b, j, i])) is not None])
            wanted.append(_or_zero(_plus(joint, _times(F.lit(0.5), bent), _times(F.lit(-0.5), turn))))
        groups, value, *rest = self._totals(sheet, bad, wanted)
        hessian = np.zeros((p, p))
        for (a, b), x in zip(pairs, rest[p:], strict=True):
            hessian[a, b] = hessian[b, a] = x
        return value - 0.5 * groups * k * LOG_2PI if groups else 0.0, np.array(rest[:p], dtype=float), hessian

    def components(self, theta: np.ndarray, parts: dict[str, tuple[X.Expr, X.Expr]]) -> DataFrame:
        """(component, value, share, groups): parts of the objective at the modes, summed over all groups, and their
        shares of the sum of absolute values; ``parts`` are named pairs of a row's and a group's expression. The
        log determinants' half and its constant are components of their own, log_determinant and constant, so that
        values add up to the marginal objective where the parts add up to the joint one.
        """
        named = {f"__q{k}": x for k, x in enumerate(parts.values())}
        curve = {self._name((i, j)): self._derivative((i, j)) for i in range(len(self.u)) for j in range(i, len(self.u))}
        sheet, part, _, logdet, bad = self._at_modes(theta, named | curve)
        sums = [F.col(n) if n in sheet.df.columns else F.lit(0.0) for n in named]
        groups, *values = self._totals(sheet, bad, [*sums, 0.5 * logdet])
        constant = -0.5 * LOG_2PI * groups * len(self.u)
        rows = list(zip([*parts, "log_determinant", "constant"], [*values, constant], strict=True))
        size = sum(abs(v) for _, v in rows)
        return self.rows.sparkSession.createDataFrame([(n, float(v), abs(v) / size if size else None, int(groups)) for n, v in rows], "component string, value double, share double, groups long")

    def active_names(self) -> dict[str, list[tuple[int, int]]]:
        """Effects and parameters along which some entry of the curvature changes, with those entries."""
        k, out = range(len(self.u)), {}
        for name, us, ts in [*((e, (i,), ()) for i, e in enumerate(self.effects)), *((p, (), (a,)) for a, p in enumerate(self.params))]:
            entries = [(i, j) for i in k for j in range(i, len(self.u)) if not all(X.is_number(e, 0.0) for e in self._derivative((i, j, *us), ts))]
            if entries:
                out[name] = entries
        return out

    def curvature_along(self, theta: np.ndarray, directions: DataFrame) -> DataFrame:
        """(direction, group, i, j, value, trace): how each group's curvature at its mode changes along directions.

        ``directions`` (direction, group, name, weight) are rows: weights of a group's effects, or of parameters,
        where the group is null and all groups are meant. Names along which no entry changes are dropped
        before anything is formed; so are groups that no direction touches, unless a parameter does. Entries
        i <= j that stay zero are not formed. ``trace`` is the entry's part of the trace of the inverse
        curvature times the change: over a direction's rows it adds up to the change of the log determinant.
        Weights of one name add up. Parameter directions are a checked table.
        """
        active = self.active_names()
        kept = directions.filter(F.col("name").isin(*active) & (F.col("weight") != 0)) if active else directions.limit(0)
        kept = cut(kept.groupBy("direction", "group", "name").agg(F.sum("weight").alias("weight")))
        named = {r[0] for r in kept.select("name").distinct().collect()}  # no more than effects and parameters
        everywhere = kept.filter(F.col("group").isNull() & F.col("name").isin(*self.params))
        if everywhere.limit(MOST_DIRECTIONS + 1).count() > MOST_DIRECTIONS:
            raise ValueError(f"more than {MOST_DIRECTIONS} parameter weights")
        modes = self.solve_modes(theta)
        if everywhere.isEmpty():
            modes = modes.join(kept.select(F.col("group").alias("__g")).distinct(), "__g", "left_semi")
        k = len(self.u)
        number = {**{e: ((i,), ()) for i, e in enumerate(self.effects)}, **{p: ((), (a,)) for a, p in enumerate(self.params)}}
        wanted = {self._name((i, j)): self._derivative((i, j)) for i in range(k) for j in range(i, k)}
        for name in sorted(named):
            us, ts = number[name]
            wanted |= {self._name((i, j, *us), ts): self._derivative((i, j, *us), ts) for i, j in active[name]}
        per, part = self._by_group(modes, theta, wanted)
        sheet = _Sheet(per, "__c")
        inverse = inverse_columns(sheet, cholesky_columns(sheet, lambda i, j: part((i, j)), k), k)
        entries = [
            F.struct(F.lit(name).alias("name"), F.lit(i).alias("i"), F.lit(j).alias("j"), part((i, j, *number[name][0]), number[name][1]).alias("value"), (_or_zero(inverse(i, j)) * (1.0 if i == j else 2.0)).alias("inverse"))
            for name in sorted(named)
            for i, j in active[name]
        ]
        none = F.array().cast("array<struct<name: string, i: int, j: int, value: double, inverse: double>>")
        formed = sheet.df.select("__g", F.explode(F.array(*entries) if entries else none).alias("e")).select("__g", "e.*")
        own = kept.filter(F.col("group").isNotNull() & F.col("name").isin(*self.effects))
        one = formed.join(own.withColumnRenamed("group", "__g"), ["__g", "name"])
        all_ = formed.join(F.broadcast(everywhere.drop("group")), "name")
        out = one.unionByName(all_).groupBy("direction", "__g", "i", "j").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.first("inverse").alias("inverse"))
        return out.select("direction", F.col("__g").alias(self.group), "i", "j", "value", (F.col("inverse") * F.col("value")).alias("trace"))

    def mode_sensitivity(self, theta: np.ndarray) -> DataFrame:
        """Modes with du / d theta of each group by the implicit function theorem, and conditional (co)variances.

        With one effect the columns are its name, conditional_variance and d_<param>; with several, their
        names, covariance_<effect>_<effect> for each pair and d_<effect>_<param>. Null where the curvature is not
        positive definite.
        """
        k, one = len(self.u), len(self.u) == 1
        parts = self._parts(2, params=1)
        per, part = self._by_group(self.solve_modes(theta), theta, parts)
        sheet = _Sheet(per, "__c")
        inverse = inverse_columns(sheet, cholesky_columns(sheet, lambda i, j: part((i, j)), k), k)
        du = self._slopes(sheet, part, inverse)
        variance = {(i, j): _or_zero(inverse(i, j)).alias("conditional_variance" if one else f"covariance_{self.effects[i]}_{self.effects[j]}") for i in range(k) for j in range(i, k)}
        moves = [_or_zero(du[i, a]).alias(f"d_{name}" if one else f"d_{self.effects[i]}_{name}") for i in range(k) for a, name in enumerate(self.params)]
        return sheet.df.select(F.col("__g").alias(self.group), *self.effects, *variance.values(), *moves)


@dataclass
class ChainLaplace:
    """A series u_0..u_{n-1}: ``start`` in u, ``step`` in (u, v) with v the next state, ``observe`` in u and data.

    ``u`` and ``v`` are random(\"u\") and random(\"v\"). Data are arrays of length n; ``step`` may use data of
    its first state.
    """

    start: X.Expr
    step: X.Expr
    observe: X.Expr
    params: list[str]

    def __post_init__(self):
        self.u, self.v = X.random("u"), X.random("v")
        self.theta = [X.param(p) for p in self.params]

    def _all(self, theta, u, data, by: list[tuple[X.Expr, ...]]) -> list[list[np.ndarray]]:
        """For each tuple of variables: derivative arrays of start (one), steps (n - 1) and observations (n)."""
        base = {p: float(t) for p, t in zip(self.theta, theta, strict=True)}
        full = {X.data(k): np.asarray(x, float) for k, x in data.items()}
        early = {k: x[:-1] for k, x in full.items()}
        places = ((self.start, base | {self.u: u[:1]} | {k: x[:1] for k, x in full.items()}, 1), (self.step, base | {self.u: u[:-1], self.v: u[1:]} | early, len(u) - 1), (self.observe, base | {self.u: u} | full, len(u)))
        known: list[dict] = [{}, {}, {}]
        out = []
        for variables in by:
            row = []
            for k, (e, values, n) in enumerate(places):
                for b in variables:
                    e = X.diff(e, b)
                row.append(np.broadcast_to(np.asarray(X.to_numpy(e, values, known[k]), float), (n,)))
            out.append(row)
        return out

    def joint(self, theta, u, data) -> float:
        return float(sum(x.sum() for x in self._all(theta, u, data, [()])[0]))

    def _gradient(self, theta, u, data) -> np.ndarray:
        a, b = self._all(theta, u, data, [(self.u,), (self.v,)])
        g = a[2].copy()
        g[0] += a[0][0]
        g[:-1] += a[1]
        g[1:] += b[1]
        return g

    def _band(self, parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Diagonal and off-diagonal from derivative arrays of uu, vv, uv."""
        uu, vv, uv = parts
        d = uu[2].copy()
        d[0] += uu[0][0]
        d[:-1] += uu[1]
        d[1:] += vv[1]
        return d, uv[1].copy()

    def hessian(self, theta, u, data) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.u, self.v
        return self._band(self._all(theta, u, data, [(x, x), (y, y), (x, y)]))

    def mode(self, theta, data, u0: np.ndarray, *, most: int = 50, tol: float = 1e-9) -> np.ndarray:
        """Damped Newton with Armijo steps; the damping grows tenfold while the curvature is not positive definite."""
        u, f = np.array(u0, float), self.joint(theta, u0, data)
        for _ in range(most):
            g = self._gradient(theta, u, data)
            if np.abs(g).max() <= tol:
                break
            d, e = self.hessian(theta, u, data)
            damping = 0.0
            for _ in range(12):
                try:
                    move = -Tridiagonal(d + damping, e).solve(g)
                    break
                except NotPositiveDefinite:
                    damping = max(10 * damping, 1e-10 * max(1.0, float(np.abs(d).max())), 1e-6 if damping else 0.0) * (100 if damping else 1)
            else:
                move = -g
            step = 1.0
            for _ in range(40):
                new = self.joint(theta, u + step * move, data)
                if np.isfinite(new) and new <= f + 1e-4 * step * (g @ move) + 1e-12 * (1 + abs(f)):
                    break
                step /= 2
            else:
                break
            u, f = u + step * move, new
        return u

    def evaluate(self, theta, data, u0: np.ndarray, *, envelope: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        """(value, gradient, mode)."""
        u = self.mode(theta, data, u0)
        d, e = self.hessian(theta, u, data)
        h = Tridiagonal(d, e)
        value = self.joint(theta, u, data) + 0.5 * h.logdet() - 0.5 * len(u) * LOG_2PI
        sd, so = h.inverse_band()
        du = self.sensitivity(theta, u, data, h)
        x, y = self.u, self.v
        third = self._all(theta, u, data, [(x, x, x), (y, y, x), (x, y, x), (x, x, y), (y, y, y), (x, y, y)])
        grad = np.empty(len(self.theta))
        for k, p in enumerate(self.theta):
            own = self._all(theta, u, data, [(p,), (x, x, p), (y, y, p), (x, y, p)])
            grad[k] = sum(a.sum() for a in own[0])
            if envelope:
                continue
            # total derivative of the curvature: directly and through the mode
            through = []
            for q in range(3):
                a, b = third[q], third[q + 3]
                through.append([own[q + 1][0] + a[0] * du[:1, k], own[q + 1][1] + a[1] * du[:-1, k] + b[1] * du[1:, k], own[q + 1][2] + a[2] * du[:, k]])
            dd, de = self._band(through)
            grad[k] += 0.5 * ((sd * dd).sum() + 2 * (so * de).sum())
        return value, grad, u

    def sensitivity(self, theta, u, data, h: Tridiagonal | None = None) -> np.ndarray:
        """du / d theta = -H**-1 H_u_theta."""
        h = h or Tridiagonal(*self.hessian(theta, u, data))
        cross = np.empty((len(u), len(self.theta)))
        for k, p in enumerate(self.theta):
            a, b = self._all(theta, u, data, [(self.u, p), (self.v, p)])
            c = a[2].copy()
            c[0] += a[0][0]
            c[:-1] += a[1]
            c[1:] += b[1]
            cross[:, k] = c
        return -h.solve(cross)


def evaluate_series(rows: DataFrame, model: ChainLaplace, theta: np.ndarray, *, series: str, time: str, columns: list[str], start: str) -> DataFrame:
    """(series, n, value, gradient norm, mode) of each series at fixed parameters; a grouped map by series.

    A series is sequential and must fit a task; series are independent.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        data = {c: pdf[c].to_numpy(float) for c in columns}
        value, grad, u = model.evaluate(theta, data, pdf[start].to_numpy(float))
        return pd.DataFrame({series: [pdf[series].iloc[0]], "n": [len(pdf)], "value": [value], "gradient_norm": [float(np.linalg.norm(grad))], "mode": [u.tolist()]})

    kind = dict(rows.dtypes)[series]
    return rows.select(series, time, *{*columns, start}).groupBy(series).applyInPandas(run, f"{series} {kind}, n long, value double, gradient_norm double, mode array<double>")
