"""Bounds of trees by interval arithmetic, and what they say of the loss."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions.pointwise import EXP_CLIP, LOG_FLOOR, POW_CLIP, POW_FLOOR, finite
from galena.operators.tree import BinOp, Const, FunctionalOp, FunctionalOp2D, Node, UnOp, Var


@dataclass(frozen=True)
class Interval:
    """All finite values lie in [low, high]. holes: there may be NaN besides, which comparisons and powers turn into 0."""

    low: float
    high: float
    holes: bool = False

    @property
    def bounded(self) -> bool:
        return math.isfinite(self.low) and math.isfinite(self.high)

    @property
    def reach(self) -> float:
        return max(abs(self.low), abs(self.high))


EVERYTHING = Interval(-math.inf, math.inf, True)


def of_points(values: Iterable[float]) -> Interval:
    values = list(values)
    good = [v for v in values if math.isfinite(v)]
    return Interval(min(good), max(good), len(good) < len(values)) if good else EVERYTHING


def _span(values: Iterable[float]) -> Interval:
    values = [0.0 if math.isnan(v) else v for v in values]
    return Interval(min(values), max(values))


def of_columns(df: DataFrame, names: list[str]) -> dict[str, Interval]:
    """The range of finite values of every column, in one pass."""
    good = {n: F.when(finite(F.col(n).cast("double")), F.col(n).cast("double")) for n in names}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[f(good[n]).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max, F.count)]).first()
    return {n: EVERYTHING if row[f"min_{n}"] is None else Interval(row[f"min_{n}"], row[f"max_{n}"], row[f"count_{n}"] < row["rows"]) for n in names}


def _compare(op: str, a: Interval, b: Interval) -> Interval:
    if op in ("lt", "le"):
        a, b, op = b, a, {"lt": "gt", "le": "ge"}[op]
    above = a.low > b.high if op == "gt" else a.low >= b.high
    below = a.high <= b.low if op == "gt" else a.high < b.low
    return Interval(1.0, 1.0) if above else Interval(0.0, 0.0) if below else Interval(0.0, 1.0)


def _binary(op: str, a: Interval, b: Interval) -> Interval:
    match op:
        case "add":
            return Interval(a.low + b.low, a.high + b.high)
        case "sub":
            return Interval(a.low - b.high, a.high - b.low)
        case "mul":
            return _span(x * y for x in (a.low, a.high) for y in (b.low, b.high))
        case "div":
            if b.low <= 0 <= b.high:
                return Interval(0.0, 0.0) if a.low == a.high == 0 else EVERYTHING
            return _span(x / y for x in (a.low, a.high) for y in (b.low, b.high))
        case "min":
            return Interval(min(a.low, b.low), min(a.high, b.high))
        case "max":
            return Interval(max(a.low, b.low), max(a.high, b.high))
        case "gt" | "lt" | "ge" | "le":
            return _compare(op, a, b)
        case "pow":
            low = 0.0 if a.low <= 0 <= a.high else min(abs(a.low), abs(a.high))
            base = (max(low, POW_FLOOR), max(a.reach, POW_FLOOR))
            power = (min(max(b.low, -POW_CLIP), POW_CLIP), min(max(b.high, -POW_CLIP), POW_CLIP))
            # a power that is no number is taken as zero
            corners = [x**y if math.isfinite(x) else (math.inf if y > 0 else 1.0 if y == 0 else 0.0) for x in base for y in power]
            return Interval(min(0.0, *corners) if not a.bounded else min(corners), max(corners))
        case "atan2":
            return Interval(-math.pi, math.pi)
    raise ValueError(op)


def _unary(op: str, a: Interval) -> Interval:
    clip = lambda v, low, high: min(max(v, low), high)
    nearest = 0.0 if a.low <= 0 <= a.high else min(abs(a.low), abs(a.high))
    match op:
        case "neg":
            return Interval(-a.high, -a.low)
        case "abs":
            return Interval(nearest, a.reach)
        case "tanh":
            return Interval(math.tanh(a.low), math.tanh(a.high))
        case "sign":
            return Interval(float(np.sign(a.low)), float(np.sign(a.high)))
        case "step":
            return Interval(float(a.low > 0), float(a.high > 0))
        case "sqrt":
            return Interval(math.sqrt(nearest), math.sqrt(a.reach))
        case "log":
            return Interval(math.log(max(nearest, LOG_FLOOR)), math.log(max(a.reach, LOG_FLOOR)))
        case "exp":
            return Interval(math.exp(clip(a.low, -EXP_CLIP, EXP_CLIP)), math.exp(clip(a.high, -EXP_CLIP, EXP_CLIP)))
        case "sin" | "cos":
            return Interval(-1.0, 1.0)
        case "acos":
            return Interval(math.acos(clip(a.high, -1, 1)), math.acos(clip(a.low, -1, 1)))
        case "asin":
            return Interval(math.asin(clip(a.low, -1, 1)), math.asin(clip(a.high, -1, 1)))
        case "reduce_mean" | "reduce_max":
            return a
        case "reduce_sum":
            return Interval(0.0 if a.low >= 0 else -math.inf, 0.0 if a.high <= 0 else math.inf)
        case "reduce_std":
            return Interval(0.0, a.high - a.low)
    raise ValueError(op)


ZERO_FOR_NAN = {"gt", "lt", "ge", "le", "pow", "step"}


def _with_holes(op: str, r: Interval, *args: Interval) -> Interval:
    holes = any(a.holes or not a.bounded for a in args)
    if op in ZERO_FOR_NAN:
        return Interval(min(r.low, 0.0), max(r.high, 0.0)) if holes else r
    return Interval(r.low, r.high, holes or not r.bounded)


def evaluate(node: Node, env: dict[str, Interval]) -> Interval:
    """A range that holds every finite value of the tree over rows whose columns lie in env."""
    match node:
        case Var(name):
            return env.get(name, EVERYTHING)
        case Const(value):
            return Interval(value, value)
        case BinOp(op, a, b):
            x, y = evaluate(a, env), evaluate(b, env)
            return _with_holes(op, _binary(op, x, y), x, y)
        case UnOp(op, a):
            x = evaluate(a, env)
            return _with_holes(op, _unary(op, x), x)
        case FunctionalOp(f, args):
            reach = 1.0
            for mu, i in f.parts():
                reach *= mu.l1() * evaluate(args[i], env).reach
            return Interval(-reach, reach, True) if math.isfinite(reach) else EVERYTHING
        case FunctionalOp2D(m, arg):
            reach = m.l1() * evaluate(arg, env).reach
            return Interval(-reach, reach, True) if math.isfinite(reach) else EVERYTHING
    raise TypeError(node)


class TargetBound:
    """The least mean square error that predictions inside a range can have, from y sorted once: O(log n) a query."""

    def __init__(self, y: np.ndarray) -> None:
        y = np.sort(y[np.isfinite(y)])
        self.y, self.n = y, max(1, len(y))
        zero = np.zeros(1)
        self.sums, self.squares = np.concatenate([zero, np.cumsum(y)]), np.concatenate([zero, np.cumsum(y * y)])

    def mse(self, r: Interval) -> float:
        if not r.bounded or not len(self.y) or r.reach > 1e100:
            return 0.0
        i, j = np.searchsorted(self.y, r.low, "left"), np.searchsorted(self.y, r.high, "right")
        low = self.squares[i] - 2 * r.low * self.sums[i] + i * r.low**2
        k = len(self.y) - j
        high = (self.squares[-1] - self.squares[j]) - 2 * r.high * (self.sums[-1] - self.sums[j]) + k * r.high**2
        return max(0.0, float(low + high) / self.n)


class TableBound:
    """As TargetBound, for a target of any length: sums of `bins` ranges of it, a row each. The range that a bound falls into counts as no error, so the bound
    stays below the exact one, by a bin's share at most."""

    def __init__(self, df: DataFrame, y: str, bins: int = 1024) -> None:
        c = F.col(f"`{y}`").cast("double")
        rows = df.select(c.alias("y")).where(finite(c))
        cuts = sorted(set(rows.approxQuantile("y", [i / bins for i in range(1, bins)], 0.5 / bins)))
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col("y"))) if cuts else F.lit(0)
        found = sorted(tuple(r) for r in rows.groupBy(place.alias("p")).agg(F.count("y"), F.sum("y"), F.sum(F.col("y") * F.col("y")), F.min("y"), F.max("y")).collect())
        table = np.array([r[1:] for r in found], float).reshape(-1, 5)
        self.lows, self.highs = table[:, 3], table[:, 4]
        self.sums = np.concatenate([np.zeros((1, 3)), np.cumsum(table[:, :3], axis=0)])
        self.n = max(1.0, float(self.sums[-1, 0]))

    def mse(self, r: Interval) -> float:
        if not r.bounded or not len(self.lows) or r.reach > 1e100:
            return 0.0
        below = self.sums[np.searchsorted(self.highs, r.low, "right")]
        above = self.sums[-1] - self.sums[np.searchsorted(self.lows, r.high, "left")]
        found = sum(squares - 2 * end * total + n * end * end for (n, total, squares), end in ((below, r.low), (above, r.high)))
        slack = 1e-12 * (self.sums[-1, 2] + self.n * max(r.low**2, r.high**2))  # sums are rounded
        return max(0.0, float(found - slack) / self.n)


def least_mse(df: DataFrame, y: str, ranges: dict[str, Interval]) -> dict[str, float]:
    """The same for many ranges in one pass over a column of any length."""
    bounded = {k: r for k, r in ranges.items() if r.bounded}
    c = F.when(finite(F.col(y)), F.col(y))
    out = dict.fromkeys(ranges, 0.0)
    if bounded:
        row = df.agg(*[F.avg(F.pow(c - F.greatest(F.least(c, F.lit(r.high)), F.lit(r.low)), F.lit(2.0))).alias(f"b{i}") for i, r in enumerate(bounded.values())]).first()
        out |= {k: float(row[f"b{i}"] or 0.0) for i, k in enumerate(bounded)}
    return out


def pareto_threshold(front: list, complexity: int) -> float:
    """The least loss of front members that are no more complex."""
    return min((c.loss for c in front if c.complexity <= complexity), default=math.inf)


__all__ = ["EVERYTHING", "Interval", "TableBound", "TargetBound", "evaluate", "least_mse", "of_columns", "of_points", "pareto_threshold"]
