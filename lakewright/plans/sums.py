"""Planning of sums of expressions over rows.

A model needs the row sums of many derivatives, most of which are made of few different things. ``Plan``
splits every expression into terms of a factor that no row changes and a factor of the row, so that

- expressions that are zero need no sum, and those that no row changes need a count;
- equal row factors of all expressions are summed once;
- row factors of data alone (statistics of a group) are told apart from those that change with
  parameters or random effects: the first never need a second look at the rows.

``staged`` puts subexpressions that several expressions use into columns of their own, level by level, so
that a graph with shared nodes isn't written out as a tree.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.plans import expr as X

ONE = X.num(1.0)
LEAVES = ("num", "param", "random", "data")


@lru_cache(maxsize=None)
def uses(e: X.Expr, ops: tuple[str, ...]) -> bool:
    """Whether a leaf of one of the kinds stands in an expression."""
    return e.op in ops or any(uses(a, ops) for a in e.args if isinstance(a, X.Expr))


def _factors(e: X.Expr) -> list[X.Expr]:
    """Factors of a product; whole powers of products are products of powers."""
    if e.op == "mul":
        return [f for a in e.args for f in _factors(a)]
    if e.op == "pow" and e.args[1] == int(e.args[1]):
        inner = _factors(e.args[0])
        if len(inner) > 1:
            return [f ** e.args[1] for f in inner]
    return [e]


@lru_cache(maxsize=None)
def terms(e: X.Expr) -> tuple[tuple[X.Expr, X.Expr], ...]:
    """``e`` as a sum of products of (a factor without data, a factor of the row)."""
    if X.is_number(e, 0.0):
        return ()
    if not uses(e, ("data",)):
        return ((e, ONE),)
    if e.op == "add":
        return terms(e.args[0]) + terms(e.args[1])
    fixed, moving = ONE, []
    for f in _factors(e):
        if uses(f, ("data",)):
            moving.append(f)
        else:
            fixed = fixed * f
    powers = _powers(moving)
    sums = [f for f in powers if f.op == "add"]
    if len(sums) == 1:
        # a sum among the factors is multiplied out; a square about a mean is not, as its terms would cancel
        others = [f for f in powers if f is not sums[0]]
        return tuple((fixed * c, _product([*others, *([] if r is ONE else _factors(r))])) for c, r in terms(sums[0]))
    return ((fixed, _product(powers)),)


def _powers(factors: list[X.Expr]) -> list[X.Expr]:
    """Factors with positive powers of one base taken together."""
    power: dict[tuple[X.Expr, bool], float] = {}
    for f in factors:
        base, n = f.args if f.op == "pow" else (f, 1.0)
        power[base, n > 0] = power.get((base, n > 0), 0.0) + n
    return [base**n for (base, _), n in power.items()]


def _product(factors: list[X.Expr]) -> X.Expr:
    """The product of factors, the same whatever their order."""
    return reduce(lambda a, b: a * b, sorted(_powers(factors), key=id), ONE)


@dataclass
class Plan:
    """``wanted``: named expressions. ``static``, ``moving``: row factors to sum, of data alone or not;
    ``recipe``: each name's terms as (factor, row factor). Names of zero are not in it."""

    wanted: Mapping[str, X.Expr]
    recipe: dict[str, dict[X.Expr, X.Expr]] = field(default_factory=dict, init=False)
    static: list[X.Expr] = field(default_factory=list, init=False)
    moving: list[X.Expr] = field(default_factory=list, init=False)

    def __post_init__(self):
        seen = set()
        for name, e in self.wanted.items():
            made: dict[X.Expr, X.Expr] = {}
            for c, r in terms(e):
                made[r] = made.get(r, X.num(0.0)) + c
            made = {r: c for r, c in made.items() if not X.is_number(c, 0.0)}
            if made:
                self.recipe[name] = made
            for r in made:
                if r is not ONE and r not in seen:
                    seen.add(r)
                    (self.moving if uses(r, ("param", "random")) else self.static).append(r)


def staged(df: DataFrame, exprs: list[X.Expr], values: Mapping[X.Expr, Column], prefix: str) -> tuple[DataFrame, dict[X.Expr, Column]]:
    """(``df`` with columns of the subexpressions that more than one place uses, those expressions' columns)."""
    uses_of: dict[X.Expr, int] = {}
    order: list[X.Expr] = []

    def walk(e: X.Expr) -> None:
        uses_of[e] = uses_of.get(e, 0) + 1
        if uses_of[e] == 1:
            for a in e.args:
                if isinstance(a, X.Expr):
                    walk(a)
            order.append(e)

    for e in dict.fromkeys(exprs):
        walk(e)
    shared = [e for e in order if uses_of[e] > 1 and e.op not in LEAVES]
    level: dict[X.Expr, int] = {}
    for e in order:
        below = max((level[a] for a in e.args if isinstance(a, X.Expr)), default=0)
        level[e] = below + 1 if uses_of[e] > 1 and e.op not in LEAVES else below
    known: dict[X.Expr, Column] = dict(values)
    for at in sorted({level[e] for e in shared}):
        now = {f"{prefix}{len(known)}_{k}": e for k, e in enumerate(x for x in shared if level[x] == at)}
        df = df.withColumns({n: X.to_column(e, values, known) for n, e in now.items()})
        known |= {e: F.col(n) for n, e in now.items()}
    return df, known
