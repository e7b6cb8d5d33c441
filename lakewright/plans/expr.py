"""Model expressions: trees with symbolic derivatives that become Spark Columns or numpy values.

A tree is built from parameters, random effects, data columns and numbers. Derivatives are taken
symbolically, zeros and ones being folded away, so that unneeded derivative columns never exist. Equal
subtrees are one object (hash-consing), which lets numpy evaluation share them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewright.functions import special

_nodes: dict[tuple, Expr] = {}


class Expr:
    """An operation over arguments; leaves hold a name or a number."""

    __slots__ = ("op", "args", "_diffs")

    def __new__(cls, op: str, *args):
        key = (op, *args)
        found = _nodes.get(key)
        if found is None:
            found = object.__new__(cls)
            found.op, found.args, found._diffs = op, args, {}
            _nodes[key] = found
        return found

    def __reduce__(self):
        return Expr, (self.op, *self.args)

    def __hash__(self):
        return id(self)

    def __eq__(self, other):
        return self is other

    def __add__(self, o):
        a, b = self, wrap(o)
        if is_number(a, 0.0):
            return b
        if is_number(b, 0.0):
            return a
        if a.op == b.op == "num":
            return num(a.args[0] + b.args[0])
        return Expr("add", a, b)

    def __mul__(self, o):
        a, b = self, wrap(o)
        if is_number(a, 0.0) or is_number(b, 0.0):
            return num(0.0)
        if is_number(a, 1.0):
            return b
        if is_number(b, 1.0):
            return a
        if a.op == b.op == "num":
            return num(a.args[0] * b.args[0])
        return Expr("mul", a, b)

    def __pow__(self, n: float):
        if n == 0:
            return num(1.0)
        if n == 1:
            return self
        return num(self.args[0] ** n) if self.op == "num" else Expr("pow", self, float(n))

    def __neg__(self):
        return num(-1.0) * self

    def __sub__(self, o):
        return self + -wrap(o)

    def __truediv__(self, o):
        return self * wrap(o) ** -1

    def __radd__(self, o):
        return wrap(o) + self

    def __rmul__(self, o):
        return wrap(o) * self

    def __rsub__(self, o):
        return wrap(o) - self

    def __rtruediv__(self, o):
        return wrap(o) / self

    def __repr__(self):
        return f"{self.op}({', '.join(map(repr, self.args))})"


def num(x: float) -> Expr:
    return Expr("num", float(x))


def wrap(x) -> Expr:
    return x if isinstance(x, Expr) else num(x)


def is_number(e: Expr, x: float) -> bool:
    return e.op == "num" and e.args[0] == x


def param(name: str) -> Expr:
    """A fixed effect."""
    return Expr("param", name)


def random(name: str) -> Expr:
    """A random effect of the row's group (or of a chain's step)."""
    return Expr("random", name)


def data(name: str) -> Expr:
    return Expr("data", name)


def _unary(op: str):
    def make(x) -> Expr:
        return Expr(op, wrap(x))

    return make


exp, log, sqrt, sin, cos, tan, asin, acos, lgamma, digamma, trigamma, logistic = map(_unary, ("exp", "log", "sqrt", "sin", "cos", "tan", "asin", "acos", "lgamma", "digamma", "trigamma", "logistic"))


def square(x) -> Expr:
    return wrap(x) ** 2


def normal_nll(x, mean, log_sd) -> Expr:
    """Negative log density of a normal law by its log sd."""
    return 0.5 * math.log(2 * math.pi) + wrap(log_sd) + 0.5 * square((wrap(x) - mean) * exp(-wrap(log_sd)))


def diff(e: Expr, by: Expr) -> Expr:
    """Derivative by a parameter or random effect."""
    got = e._diffs.get(by)
    if got is None:
        got = e._diffs[by] = _diff(e, by)
    return got


def _diff(e: Expr, by: Expr) -> Expr:
    if e is by:
        return num(1.0)
    if e.op in ("num", "param", "random", "data"):
        return num(0.0)
    a = e.args[0]
    if e.op == "add":
        return diff(a, by) + diff(e.args[1], by)
    if e.op == "mul":
        return diff(a, by) * e.args[1] + a * diff(e.args[1], by)
    d = diff(a, by)
    if is_number(d, 0.0):
        return d
    if e.op == "pow":
        return e.args[1] * a ** (e.args[1] - 1) * d
    rules = {
        "exp": lambda: e,
        "log": lambda: a**-1,
        "sqrt": lambda: 0.5 * e**-1,
        "sin": lambda: cos(a),
        "cos": lambda: -sin(a),
        "tan": lambda: 1 + e**2,
        "asin": lambda: (1 - a**2) ** -0.5,
        "acos": lambda: -((1 - a**2) ** -0.5),
        "logistic": lambda: e * (1 - e),
        "lgamma": lambda: digamma(a),
        "digamma": lambda: trigamma(a),
    }
    if e.op not in rules:
        raise ValueError(f"no derivative of {e.op}")
    return rules[e.op]() * d


def leaves(e: Expr, op: str) -> set[Expr]:
    """All leaves of a kind."""
    found, stack, seen = set(), [e], set()
    while stack:
        x = stack.pop()
        if x in seen:
            continue
        seen.add(x)
        if x.op == op:
            found.add(x)
        stack += [a for a in x.args if isinstance(a, Expr)]
    return found


def _digamma(x: np.ndarray) -> np.ndarray:
    s = x + special.SHIFT
    series = sum(c * s ** (-2.0 * k) for k, c in enumerate(special.DIGAMMA_SERIES))
    return np.log(s) - 0.5 / s + series / s**2 - sum(1 / (x + k) for k in range(special.SHIFT))


def _trigamma(x: np.ndarray) -> np.ndarray:
    s = x + special.SHIFT
    series = sum(c * s ** (-2.0 * k) for k, c in enumerate(special.TRIGAMMA_SERIES))
    return 1 / s + 0.5 / s**2 + series / s**3 + sum(1 / (x + k) ** 2 for k in range(special.SHIFT))


_lgamma = np.vectorize(math.lgamma, otypes=[float])
NUMPY = {"exp": np.exp, "log": np.log, "sqrt": np.sqrt, "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "lgamma": _lgamma, "digamma": _digamma, "trigamma": _trigamma, "logistic": lambda x: 0.5 * (1 + np.tanh(0.5 * x))}
SPARK = {"exp": F.exp, "log": F.ln, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "lgamma": special.lgamma, "digamma": special.digamma, "trigamma": special.trigamma, "logistic": special.logistic}


def _evaluate(e: Expr, values: Mapping[Expr, object], known: dict, table: dict, number, power):
    got = known.get(e)
    if got is not None:
        return got
    if e.op == "num":
        got = number(e.args[0])
    elif e.op in ("param", "random", "data"):
        got = values[e]
    else:
        args = [_evaluate(a, values, known, table, number, power) for a in e.args if isinstance(a, Expr)]
        if e.op == "add":
            got = args[0] + args[1]
        elif e.op == "mul":
            got = args[0] * args[1]
        elif e.op == "pow":
            got = power(args[0], e.args[1])
        else:
            got = table[e.op](args[0])
    known[e] = got
    return got


def to_numpy(e: Expr, values: Mapping[Expr, object], known: dict | None = None):
    """Value over numpy arrays; pass one ``known`` to share subtrees between expressions."""
    return _evaluate(e, values, {} if known is None else known, NUMPY, float, lambda x, n: np.power(x, n))


def _column_power(x: Column, n: float) -> Column:
    if n in (2.0, -1.0, -2.0, 0.5):
        return {2.0: lambda: x * x, -1.0: lambda: 1.0 / x, -2.0: lambda: 1.0 / (x * x), 0.5: lambda: F.sqrt(x)}[n]()
    return F.pow(x, F.lit(n))


def to_column(e: Expr, values: Mapping[Expr, Column], known: Mapping[Expr, Column] | None = None) -> Column:
    """A Column; subtrees in ``known`` are taken from there. Spark shares equal subtrees when it generates code."""
    return _evaluate(e, values, dict(known or {}), SPARK, F.lit, _column_power)
