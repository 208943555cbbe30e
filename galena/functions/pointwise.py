"""Protected pointwise operators.

Two tables hold each operator twice: as an expression over Spark columns, which stays in whole-stage code, and as a
numpy function for work on arrays that fit one task. Both agree on zero, negative, NaN and infinite input. In Spark a
null is a missing value: arithmetic gives null, indicators give 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the guards of the protected operators
POW_FLOOR, POW_CLIP = 1e-12, 8.0
LOG_FLOOR, EXP_CLIP = 1e-12, 50.0



def finite(x: Column) -> Column:
    """True for a double that is a number; false for NaN and infinities, null for null."""
    return (x - x) == F.lit(0.0)


def _both(a: Column, b: Column, value: Column) -> Column:
    """value, but null if an operand is null and NaN if one is NaN."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(value)


def _kept(x: Column, value: Column) -> Column:
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x), F.lit(float("nan"))).otherwise(value)


def _holds(a: Column, b: Column, test: Column) -> Column:
    """1.0 where the comparison holds between two numbers."""
    return F.when(~F.isnan(a) & ~F.isnan(b) & test, F.lit(1.0)).otherwise(F.lit(0.0))


def _power(a: Column, b: Column) -> Column:
    raised = F.pow(F.greatest(F.abs(a), F.lit(POW_FLOOR)), F.greatest(F.least(b, F.lit(POW_CLIP)), F.lit(-POW_CLIP)))
    # as in IEEE: one to any power is one, and anything to the power zero
    whole = F.when(F.isnan(b), (F.abs(a) == 1).cast("double")).when(finite(raised), raised).otherwise(F.lit(0.0))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(whole)


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, F.lit(0.0)).otherwise(a / b),
    "min": lambda a, b: _both(a, b, F.least(a, b)),
    "max": lambda a, b: _both(a, b, F.greatest(a, b)),
    "gt": lambda a, b: _holds(a, b, a > b),
    "lt": lambda a, b: _holds(a, b, a < b),
    "ge": lambda a, b: _holds(a, b, a >= b),
    "le": lambda a, b: _holds(a, b, a <= b),
    "pow": _power,
    "atan2": lambda a, b: F.atan2(a, b),
}

UNARY: dict[str, Callable[[Column], Column]] = {
    "tanh": F.tanh,
    "abs": F.abs,
    "sign": F.signum,
    "neg": lambda x: -x,
    "step": lambda x: F.when(~F.isnan(x) & (x > 0), F.lit(1.0)).otherwise(F.lit(0.0)),
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "log": lambda x: _kept(x, F.log(F.greatest(F.abs(x), F.lit(LOG_FLOOR)))),
    "exp": lambda x: _kept(x, F.exp(F.greatest(F.least(x, F.lit(EXP_CLIP)), F.lit(-EXP_CLIP)))),
    "sin": F.sin,
    "cos": F.cos,
    "acos": lambda x: _kept(x, F.acos(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))),
    "asin": lambda x: _kept(x, F.asin(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))),
}


def _only_finite(x: Column) -> Column:
    return F.when(finite(x), x)


#: Reductions over all rows, of the finite entries alone; NaN where there is none. std is that of the population.
REDUCE: dict[str, Callable[[Column], Column]] = {
    "reduce_mean": lambda x: F.coalesce(F.avg(_only_finite(x)), F.lit(float("nan"))),
    "reduce_max": lambda x: F.coalesce(F.max(_only_finite(x)), F.lit(float("nan"))),
    "reduce_sum": lambda x: F.coalesce(F.sum(_only_finite(x)), F.lit(float("nan"))),
    "reduce_std": lambda x: F.coalesce(F.stddev_pop(_only_finite(x)), F.lit(float("nan"))),
}


# --- the same over numpy arrays


def _np_power(a, b):
    with np.errstate(all="ignore"):
        out = np.power(np.maximum(np.abs(a), POW_FLOOR), np.clip(b, -POW_CLIP, POW_CLIP))
    return np.where(np.isfinite(out), out, 0.0)


def _np_div(a, b):
    with np.errstate(all="ignore"):
        return np.where(np.equal(b, 0), 0.0, np.divide(a, np.where(np.equal(b, 0), 1.0, b)))


def _indicator(test):
    return lambda a, b: test(a, b).astype(float)


NP_BINARY: dict[str, Callable] = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "div": _np_div, "min": np.minimum, "max": np.maximum,
    "gt": _indicator(np.greater), "lt": _indicator(np.less), "ge": _indicator(np.greater_equal), "le": _indicator(np.less_equal), "pow": _np_power, "atan2": lambda a, b: np.arctan2(a + 0.0, b + 0.0),  # as in Spark, -0.0 counts as 0.0
}

NP_UNARY: dict[str, Callable] = {
    "tanh": np.tanh, "abs": np.abs, "sign": np.sign, "neg": np.negative, "step": lambda x: np.greater(x, 0).astype(float), "sqrt": lambda x: np.sqrt(np.abs(x)),
    "log": lambda x: np.log(np.maximum(np.abs(x), LOG_FLOOR)), "exp": lambda x: np.exp(np.clip(x, -EXP_CLIP, EXP_CLIP)), "sin": np.sin, "cos": np.cos,
    "acos": lambda x: np.arccos(np.clip(x, -1, 1)), "asin": lambda x: np.arcsin(np.clip(x, -1, 1)),
}


def _np_reduce(f):
    def run(x):
        x = np.atleast_1d(np.asarray(x, float))
        good = x[np.isfinite(x)]
        return float(f(good)) if len(good) else float("nan")

    return run


NP_REDUCE: dict[str, Callable] = {"reduce_mean": _np_reduce(np.mean), "reduce_max": _np_reduce(np.max), "reduce_sum": _np_reduce(np.sum), "reduce_std": _np_reduce(np.std)}

COMMUTATIVE = frozenset({"add", "mul", "min", "max"})
