"""Laplace approximations of series that no task holds whole.

The model is ``ChainLaplace``'s: a state per row, a start, steps between neighbours and observations, so that the
curvature is tridiagonal. Rows lie in range-sorted parts; what a row needs of its neighbours, pivots, solutions and
entries of the inverse all come from recurrences over the parts (``operators.ordered``), and rows never move.

Gradients need the trace of the inverse curvature against its derivative by every parameter, directly and through
the mode. Through the mode an adjoint solve serves all parameters at once: with t the half trace against the
derivative by each state and l = H**-1 t, the part of parameter a is -l' f_ua. So derivatives of the curvature are
never stored: every row multiplies its own by its own entries of the inverse, and one aggregation sums them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators import ordered
from lakewright.operators.ordered import PART, before, in_order, row_number, scan
from lakewright.plans import expr as X
from lakewright.plans.laplace import LOG_2PI, ChainLaplace, NotConverged
from lakewright.session import cut

BY = ("series",)
ZERO = X.num(0.0)


@dataclass
class LongChain:
    """``rows`` in series by ``series``, ordered by ``time`` columns, with the data columns that ``model`` uses.

    Rows with a null series or datum are left out. ``step`` uses data of its first state, as in the model.
    """

    rows: DataFrame
    series: str
    time: tuple[str, ...]
    model: ChainLaplace
    parts: int | None = None
    rounds: int = field(default=0, init=False)

    def __post_init__(self):
        m = self.model
        self.used = sorted({d.args[0] for e in (m.start, m.step, m.observe) for d in X.leaves(e, "data")})
        self.held = sorted({d.args[0] for d in X.leaves(m.step, "data")})
        names = [f"t{k}" for k in range(len(self.time))]
        view = self.rows.select(F.col(self.series).alias("series"), *[F.col(t).alias(n) for t, n in zip(self.time, names, strict=True)], *[F.col(c).cast("double").alias(f"x_{c}") for c in self.used])
        known = view.filter(" and ".join(["series is not null", *(f"`x_{c}` is not null" for c in self.used)]))
        numbered = scan(in_order(known, "series", *names, parts=self.parts), row_number("k", BY), *[before(f"b_{c}", BY, F.col(f"x_{c}")) for c in self.held])
        kept = numbered.select("series", PART, "k", *[f"x_{c}" for c in self.used], *[F.col(f"b_{c}_in").alias(f"y_{c}") for c in self.held])
        self.base = cut(kept)
        self.state: DataFrame | None = None

    def _column(self, theta: np.ndarray, *by: str | int) -> tuple[Column | None, Column | None, Column | None]:
        """(start, step, observation) differentiated by "u", "v" and parameter numbers; None is a structural zero.

        In start and observation the row's own state is "v"; in the step "u" is the state before it.
        """
        m, out = self.model, []
        for place, e in enumerate((m.start, m.step, m.observe)):
            own = {"u": m.u, "v": m.v} if place == 1 else {"v": m.u}
            for b in by:
                e = ZERO if isinstance(b, str) and b not in own else X.diff(e, own[b] if isinstance(b, str) else m.theta[b])
            if X.is_number(e, 0.0):
                out.append(None)
                continue
            values: dict[X.Expr, Column] = {p: F.lit(float(t)) for p, t in zip(m.theta, theta, strict=True)}
            values |= {m.u: F.col("up"), m.v: F.col("u")} if place == 1 else {m.u: F.col("u")}
            values |= {X.data(c): F.col(f"y_{c}" if place == 1 else f"x_{c}") for c in (self.held if place == 1 else self.used)}
            here = X.to_column(e, values)
            out.append(here if place == 2 else F.when(F.col("k") == 1 if place == 0 else F.col("k") > 1, here).otherwise(0.0))
        return tuple(out)

    def _own(self, theta: np.ndarray, *by: str | int) -> Column:
        """A derivative by the row's own state and parameters, over all three places."""
        return self._sum([x for x in self._column(theta, *by) if x is not None])

    def _step(self, theta: np.ndarray, *by: str | int) -> Column:
        return self._sum([x for x in self._column(theta, *by)[1:2] if x is not None])

    @staticmethod
    def _sum(xs: list[Column]) -> Column:
        out = F.lit(0.0)
        for x in xs:
            out = out + x
        return out

    def is_quadratic(self) -> bool:
        u, v = self.model.u, self.model.v
        thirds = [(self.model.start, (u, u, u)), (self.model.observe, (u, u, u)), *((self.model.step, b) for b in ((u, u, u), (u, u, v), (u, v, v), (v, v, v)))]
        for e, by in thirds:
            for b in by:
                e = X.diff(e, b)
            if not X.is_number(e, 0.0):
                return False
        return True

    def _factored(self, state: DataFrame, theta: np.ndarray) -> DataFrame:
        """``state`` with the state before (up), gradient (g), link to the row before (e) and pivots."""
        met = cut(scan(state, before("w", BY, F.col("u"))).withColumn("up", F.col("w_in")).drop("w", "w_in"))
        # what a step says of its first state belongs to the row before
        shifted = scan(met, before("gu", BY, self._step(theta, "u"), reverse=True), before("hu", BY, self._step(theta, "u", "u"), reverse=True))
        behind = {c: F.coalesce(f"{c}_in", F.lit(0.0)) for c in ("gu", "hu")}
        full = cut(shifted.withColumns({"g": self._own(theta, "v") + behind["gu"], "d": self._own(theta, "v", "v") + behind["hu"], "e": self._step(theta, "u", "v")}).select(*met.columns, "g", "d", "e"))
        return cut(ordered.tridiagonal_pivots(full, BY, F.col("d"), F.col("e")))

    def solve_modes(self, theta: np.ndarray, *, most: int = 30, tol: float = 1e-9) -> DataFrame:
        """Rows with the factored curvature at the mode of every series, by Newton's steps on all series at once; a
        quadratic model takes one. Starts where the last call ended. NotConverged where steps stay large, or a
        series' curvature isn't positive definite."""
        state = self.state if self.state is not None else self.base.withColumn("u", F.lit(0.0))
        quadratic, self.rounds = self.is_quadratic(), 0
        for _ in range(most):
            met = self._factored(state, theta)
            solved = ordered.tridiagonal_solve(met, BY, F.col("e"), -F.col("g"), "move")
            moved = cut(solved.select(*self.base.columns, (F.col("u") + F.col("move")).alias("u"), "move", "e", "pivot", "pivot_in"))
            large, bad = moved.agg(F.max(F.abs("move") / (1 + F.abs("u"))), F.count_if(~F.coalesce(F.col("pivot") > 0, F.lit(False)))).first()
            state = moved.select(*self.base.columns, "u")
            self.rounds += 1
            if bad:
                raise NotConverged(f"{bad} pivots are not positive")
            if quadratic:
                # the curvature is the same everywhere
                self.state = state
                return cut(scan(moved.drop("move"), before("w", BY, F.col("u"))).withColumn("up", F.col("w_in")).drop("w", "w_in"))
            if large is None or large <= tol:
                self.state = state
                return self._factored(state, theta)
        raise NotConverged("modes were not found within the rounds allowed")

    def evaluate(self, theta: np.ndarray) -> DataFrame:
        """(series, n, value, d_<param>, ..): each series' marginal objective and gradient."""
        p = range(len(self.model.theta))
        entries = ordered.tridiagonal_inverse(self.solve_modes(theta), BY, F.col("e"))
        met = cut(scan(entries, before("sv", BY, F.col("variance"))))
        s, c, first = F.col("variance"), F.coalesce("covariance", F.lit(0.0)), F.coalesce("sv_in", F.lit(0.0))

        def half_trace(*by: str | int) -> Column:
            """Half the trace of the inverse against the row's own part of the curvature's derivative."""
            own = [x for x in self._column(theta, "v", "v", *by) if x is not None]
            return 0.5 * (s * self._sum(own) + first * self._step(theta, "u", "u", *by) + 2 * c * self._step(theta, "u", "v", *by))

        adjoint = first_adjoint = F.lit(0.0)
        if not self.is_quadratic():
            ahead = 0.5 * (s * self._step(theta, "v", "v", "u") + first * self._step(theta, "u", "u", "u") + 2 * c * self._step(theta, "u", "v", "u"))
            shifted = cut(scan(met, before("tu", BY, ahead, reverse=True)).withColumn("t", half_trace("v") + F.coalesce("tu_in", F.lit(0.0))).drop("tu", "tu_in"))
            solved = cut(ordered.tridiagonal_solve(shifted, BY, F.col("e"), F.col("t"), "l"))
            met = cut(scan(solved, before("lb", BY, F.col("l"))))
            adjoint, first_adjoint = F.col("l"), F.coalesce("lb_in", F.lit(0.0))
        value = self._own(theta) + 0.5 * F.ln("pivot") - 0.5 * LOG_2PI
        slopes = [self._own(theta, a) + half_trace(a) - adjoint * self._own(theta, "v", a) - first_adjoint * self._step(theta, "u", a) for a in p]
        return met.groupBy("series").agg(F.count("*").alias("n"), F.sum(value).alias("value"), *[F.sum(x).alias(f"d_{name}") for x, name in zip(slopes, self.model.params, strict=True)]).withColumnRenamed("series", self.series)
