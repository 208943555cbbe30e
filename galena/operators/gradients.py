"""Exact derivatives of pointwise trees by their constants, and constants fitted with them, in memory or over all rows of a table.

Derivatives are carried forward beside the values. Where a protected operator is flat (beyond a clip, at a floor, in a
comparison) its derivative is zero, as the value's own slope is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions.pointwise import EXP_CLIP, LOG_FLOOR, NP_BINARY, NP_UNARY, POW_CLIP, POW_FLOOR
from galena.operators import tree as T
from galena.operators.tree import BinOp, Const, Node, Var


def _power_slopes(a, b, out):
    base, inside, low = np.maximum(np.abs(a), POW_FLOOR), np.abs(b) <= POW_CLIP, np.abs(a) > POW_FLOOR
    fine = np.isfinite(np.power(base, np.clip(b, -POW_CLIP, POW_CLIP)))
    return np.where(fine & low, np.clip(b, -POW_CLIP, POW_CLIP) * out / base * np.sign(a), 0.0), np.where(fine & inside, out * np.log(base), 0.0)


def _quotient_slopes(a, b, out):
    safe = np.where(np.equal(b, 0), 1.0, b)
    return np.where(np.equal(b, 0), 0.0, 1 / safe), np.where(np.equal(b, 0), 0.0, -a / safe**2)


def _angle_slopes(a, b, out):
    size = a * a + b * b
    safe = np.where(size == 0, 1.0, size)
    return np.where(size == 0, 0.0, b / safe), np.where(size == 0, 0.0, -a / safe)


_FLAT = lambda a, b, out: (0.0, 0.0)

#: operator -> slopes by each operand, from the operands and the value
BINARY_SLOPES: dict[str, Callable] = {
    "add": lambda a, b, out: (1.0, 1.0), "sub": lambda a, b, out: (1.0, -1.0), "mul": lambda a, b, out: (b, a), "div": _quotient_slopes,
    "min": lambda a, b, out: ((a <= b) * 1.0, (a > b) * 1.0), "max": lambda a, b, out: ((a >= b) * 1.0, (a < b) * 1.0),
    "gt": _FLAT, "lt": _FLAT, "ge": _FLAT, "le": _FLAT, "pow": _power_slopes, "atan2": _angle_slopes,
}


def _inverse_slope(sign: float) -> Callable:
    return lambda x, out: np.where(np.abs(x) < 1, sign / np.sqrt(np.where(np.abs(x) < 1, 1 - x * x, 1.0)), 0.0)


UNARY_SLOPES: dict[str, Callable] = {
    "tanh": lambda x, out: 1 - out * out, "abs": lambda x, out: np.sign(x), "sign": lambda x, out: 0.0, "neg": lambda x, out: -1.0, "step": lambda x, out: 0.0,
    "sqrt": lambda x, out: np.where(out == 0, 0.0, np.sign(x) / (2 * np.where(out == 0, 1.0, out))),
    "log": lambda x, out: np.where(np.abs(x) > LOG_FLOOR, 1 / np.where(np.abs(x) > LOG_FLOOR, x, 1.0), 0.0),
    "exp": lambda x, out: out * (np.abs(x) <= EXP_CLIP), "sin": lambda x, out: np.cos(x), "cos": lambda x, out: -np.sin(x), "acos": _inverse_slope(-1.0), "asin": _inverse_slope(1.0),
}


def value_and_slopes(tree: Node, env: dict[str, np.ndarray], values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The values of a pointwise tree over arrays of one length, and [constant, row] of their derivatives, constants in the order of T.constants.

    values: taken in place of the tree's constants.
    """
    if not T.is_pointwise(tree):
        raise ValueError("only pointwise trees have these derivatives")
    rows = len(next(iter(env.values())))
    held = np.array(T.constants(tree) if values is None else values, float)
    at = iter(range(len(held)))

    def walk(n: Node) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(n, Var):
            return np.asarray(env[n.name], float), np.zeros((len(held), 1))
        if isinstance(n, Const):
            i = next(at)
            return np.full(rows, held[i]), (np.arange(len(held)) == i)[:, None] * 1.0
        if isinstance(n, BinOp):
            (a, da), (b, db) = walk(n.a), walk(n.b)
            out = NP_BINARY[n.op](a, b)
            sa, sb = BINARY_SLOPES[n.op](a, b, out)
            return out, da * sa + db * sb
        x, dx = walk(n.a)
        out = NP_UNARY[n.op](x)
        return out, dx * UNARY_SLOPES[n.op](x, out)

    with np.errstate(all="ignore"):
        out, slopes = walk(tree)
    return out, np.broadcast_to(slopes, (len(held), rows))


def _sums(tree: Node, env: dict[str, np.ndarray], y: np.ndarray, values: np.ndarray) -> np.ndarray:
    """[gram, projection, squares, rows, valid rows] of the residuals and slopes of finite rows, flat."""
    p, g = value_and_slopes(tree, env, values)
    fine = np.isfinite(p)
    good = fine & np.isfinite(y)
    r = np.where(good, p - y, 0.0)
    g = np.where(good & np.isfinite(g), g, 0.0)
    return np.concatenate([(g @ g.T).ravel(), g @ r, [r @ r, float(good.sum()), float(fine.sum()), float(len(y))]])


def _damped(sums: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, share: float) -> tuple[np.ndarray, float]:
    """Levenberg's walk: Newton steps on the sums, damped until the error falls; never a worse point than the start."""
    k = len(start)

    def at(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        s = sums(c)
        squares, good, fine, rows = s[-4:]
        valid = good > 0 and fine >= max(2, math.floor(share * rows)) and math.isfinite(squares)
        return s[: k * k].reshape(k, k), s[k * k : k * k + k], float(squares / good) if valid else math.inf

    c, damp = np.array(start, float), 1e-3
    gram, slope, loss = at(c)
    for _ in range(steps):
        if not math.isfinite(loss) or loss <= 1e-24 or damp > 1e9:
            break
        scale = np.diag(np.maximum(np.diag(gram), 1e-12))
        try:
            new = c - np.linalg.solve(gram + damp * scale, slope)
        except np.linalg.LinAlgError:
            damp *= 10
            continue
        found = at(new)
        if found[2] < loss:
            still = loss - found[2] <= 1e-12 * loss
            c, (gram, slope, loss), damp = new, found, max(damp / 10, 1e-12)
            if still:
                break
        else:
            damp *= 10
    return c, loss


def fit_constants(tree: Node, env: dict[str, np.ndarray], y: np.ndarray, steps: int = 40, share: float = 0.9) -> tuple[Node, float]:
    """The tree with its constants fitted by exact slopes, and its mean square error; a tree without constants as it is."""
    c, loss = _damped(lambda v: _sums(tree, env, y, v), np.array(T.constants(tree)), steps if T.constants(tree) else 0, share)
    return T.with_constants(tree, c.tolist()), loss


def fit_constants_by_data(df: DataFrame, tree: Node, y: str, steps: int = 12, share: float = 0.9) -> tuple[Node, float]:
    """The same over all rows of a table: a pass a step, in which each task adds up (k + 1)**2 numbers of its rows, k the number of constants.

    Nulls count as rows without a value. A table without rows has an infinite error.
    """
    names = sorted(T.used_features(tree))
    rows = df.select(F.col(f"`{y}`").cast("double").alias("__y"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    size = len(T.constants(tree))
    width = size * size + size + 4

    def sums(values: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                target, *columns = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns))
                if len(target):
                    # a tree of constants alone still has a value a row
                    total += _sums(tree, dict(zip(names, columns, strict=True)) or {"": target}, target, values)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{i}" for i in range(width)])

        made = rows.mapInArrow(run, ", ".join(f"s{i} double" for i in range(width)))
        return np.array([x or 0.0 for x in made.agg(*[F.sum(f"s{i}") for i in range(width)]).first()])

    c, loss = _damped(sums, np.array(T.constants(tree)), steps if size else 0, share)
    return T.with_constants(tree, c.tolist()), loss


def bfgs(f: Callable[[np.ndarray], float], start: np.ndarray, slope: Callable[[np.ndarray], np.ndarray] | None = None, steps: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Quasi-Newton descent with a halving line search; slopes by central differences where none are given."""

    def differences(x: np.ndarray) -> np.ndarray:
        h = 1e-6 * np.maximum(np.abs(x), 1e-3)
        return np.array([(f(x + d) - f(x - d)) / (2 * d[i]) for i, d in enumerate(np.diag(h))])

    slope = slope or differences
    x, value = np.array(start, float), f(np.array(start, float))
    inverse, g = np.eye(len(x)), slope(x)
    for _ in range(steps):
        if not (math.isfinite(value) and np.isfinite(g).all()) or np.abs(g).max(initial=0.0) <= tolerance:
            break
        way = -inverse @ g
        if way @ g >= 0:
            inverse, way = np.eye(len(x)), -g
        length = 1.0
        while length > 1e-12 and not f(x + length * way) <= value + 1e-4 * length * (way @ g):
            length /= 2
        if length <= 1e-12:
            break
        moved = length * way
        new = slope(x + moved)
        bent = new - g
        x, value, g = x + moved, f(x + moved), new
        if (curve := moved @ bent) > 1e-14:
            left = np.eye(len(x)) - np.outer(moved, bent) / curve
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / curve
    return x, value


def powell(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 30, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Line searches along a set of directions, the one that gained most replaced by the way that all of them went together."""

    def along(x: np.ndarray, value: float, way: np.ndarray) -> tuple[np.ndarray, float]:
        length, best, at = 0.1 * max(1.0, float(np.abs(x).max())), value, 0.0
        while length > 1e-10:
            for t in (at + length, at - length):
                if (v := f(x + t * way)) < best:
                    best, at = v, t
                    length *= 2.5
                    break
            else:
                length /= 4
            if abs(at) > 1e8:
                break
        return x + at * way, best

    x, value = np.array(start, float), f(np.array(start, float))
    ways = list(np.eye(len(x)))
    for _ in range(steps):
        before, old, gains = x, value, []
        for w in ways:
            x, new = along(x, value, w)
            gains.append(value - new)
            value = new
        if old - value <= tolerance * (abs(old) + tolerance):
            break
        if (size := np.linalg.norm(x - before)) > 0:
            ways[int(np.argmax(gains))] = (x - before) / size
            x, value = along(x, value, ways[int(np.argmax(gains))])
    return x, value
