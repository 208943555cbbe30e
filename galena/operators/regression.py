"""Least squares at machine precision over tables of any length, and the fitters built on it.

TSQR: every task reduces its rows of [1, features, target], scaled by column norms, to one triangular factor; factors
are reduced again until one is left. Normal equations would square the condition number. Everything after that, nested
models and thresholding included, works on that small factor.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.pointwise import finite
from galena.operators.tree import BinOp, Const, Node, UnOp, Var

FAN_IN = 64


@dataclass
class Factor:
    """R of [design, target] by QR, columns scaled by `scale`; n rows."""

    r: np.ndarray
    scale: np.ndarray
    names: list[str]
    n: int

    def solve(self, subset: list[int] | None = None, ridge: float = 0.0) -> tuple[np.ndarray, float]:
        """Coefficients of the chosen design columns and the residual sum of squares."""
        k = len(self.names)
        subset = list(range(k)) if subset is None else subset
        y = self.r[:, k]
        if not subset:
            return np.zeros(0), float(y @ y) * self.scale[k] ** 2
        a = self.r[:, subset]
        if ridge:
            a = np.vstack([a, math.sqrt(ridge) * np.eye(len(subset))])
            y = np.concatenate([y, np.zeros(len(subset))])
        c, *_ = np.linalg.lstsq(a, y, rcond=None)
        rest = self.r[:, k] - self.r[:, subset] @ c
        return c * self.scale[k] / self.scale[subset], float(rest @ rest) * self.scale[k] ** 2


def _stack(blocks, width: int) -> np.ndarray:
    r = np.zeros((0, width))
    for b in blocks:
        r = np.linalg.qr(np.vstack([r, b]), mode="r")
    return r


def factor(df: DataFrame, features: dict[str, Column], target: Column, intercept: bool = True) -> Factor:
    """One pass for the scales and the count, one for the factor. Rows with a missing or infinite entry are left out."""
    names = (["1"] if intercept else []) + list(features)
    columns = {**({"__f0": F.lit(1.0)} if intercept else {}), **{f"__f{i + intercept}": c.cast("double") for i, c in enumerate(features.values())}, "__y": target.cast("double")}
    rows = df.select(*[c.alias(n) for n, c in columns.items()])
    good = finite(F.col("__y"))
    for n in columns:
        good = good & finite(F.col(n))
    rows = rows.where(good)
    first = rows.agg(F.count(F.lit(1)), *[F.sqrt(F.sum(F.col(n) * F.col(n))) for n in columns]).first()
    n, width = first[0], len(columns)
    scale = np.array([float(v) if v else 1.0 for v in first[1:]])

    def local(batches):
        found = (pdf.to_numpy(float) / scale for pdf in batches if len(pdf))
        r = _stack(found, width)
        if len(r):
            yield pd.DataFrame({"r": [r.ravel().tolist()]})

    def again(batches):
        r = _stack((np.array(v).reshape(-1, width) for pdf in batches for v in pdf["r"]), width)
        if len(r):
            yield pd.DataFrame({"r": [r.ravel().tolist()]})

    parts = rows.mapInPandas(local, "r array<double>")
    count = rows.rdd.getNumPartitions()
    while count > FAN_IN:  # a tree, so no task and not the driver gets more than FAN_IN small factors
        count = -(-count // FAN_IN)
        parts = parts.repartition(count).mapInPandas(again, "r array<double>")
    r = _stack((np.array(row[0]).reshape(-1, width) for row in parts.collect()), width)
    return Factor(np.vstack([r, np.zeros((max(0, width - len(r)), width))]), scale, names, n)


@dataclass
class Fit:
    names: list[str]
    coefficients: np.ndarray
    r2: float
    mse: float
    n: int

    def __getitem__(self, name: str) -> float:
        return float(self.coefficients[self.names.index(name)]) if name in self.names else 0.0


def _fit(f: Factor, subset: list[int] | None, total: float, ridge: float = 0.0) -> Fit:
    subset = list(range(len(f.names))) if subset is None else subset
    c, rss = f.solve(subset, ridge)
    return Fit([f.names[i] for i in subset], c, 1 - rss / total if total > 0 else float(rss <= 1e-24), rss / max(1, f.n), f.n)


def _total(f: Factor) -> float:
    """The target's squares about its mean (about zero, without an intercept)."""
    return f.solve([0] if f.names and f.names[0] == "1" else [])[1]


def ols(df: DataFrame, features: dict[str, Column], target: Column, intercept: bool = True, ridge: float = 0.0) -> Fit:
    f = factor(df, features, target, intercept)
    return _fit(f, None, _total(f), ridge)


def stlsq(df: DataFrame, features: dict[str, Column], target: Column, threshold: float = 0.05, rounds: int = 12) -> Fit:
    """Least squares with small coefficients set to zero and the rest fitted again, never the intercept; all rounds on one factor."""
    f = factor(df, features, target)
    return stlsq_on(f, threshold, rounds)


def stlsq_on(f: Factor, threshold: float, rounds: int = 12) -> Fit:
    subset = list(range(len(f.names)))
    for _ in range(rounds):
        c, _ = f.solve(subset)
        kept = [i for i, v in zip(subset, c, strict=True) if f.names[i] == "1" or abs(v) >= threshold]
        if kept == subset:
            break
        subset = kept
    return _fit(f, subset, _total(f))


def monomials(names: list[str], degree: int) -> list[tuple[int, ...]]:
    """Exponents of all monomials of degree 1 to `degree`, by degree."""
    out = []
    for d in range(1, degree + 1):
        for combo in itertools.combinations_with_replacement(range(len(names)), d):
            out.append(tuple(combo.count(i) for i in range(len(names))))
    return out


def monomial_column(names: list[str], powers: tuple[int, ...]) -> Column:
    out = None
    for name, k in zip(names, powers, strict=True):
        for _ in range(k):
            c = F.col(f"`{name}`").cast("double")
            out = c if out is None else out * c
    return F.lit(1.0) if out is None else out


def monomial_tree(names: list[str], powers: tuple[int, ...]) -> Node:
    out: Node | None = None
    for name, k in zip(names, powers, strict=True):
        for _ in range(k):
            out = Var(name) if out is None else BinOp("mul", out, Var(name))
    return Const(1.0) if out is None else out


def weighted_sum(terms: list[tuple[float, Node]], constant: float = 0.0) -> Node:
    """constant + sum of coefficient * tree, as a balanced tree."""
    parts: list[Node] = [t if c == 1 else BinOp("mul", Const(float(c)), t) for c, t in terms if c]
    if constant or not parts:
        parts.append(Const(float(constant)))
    while len(parts) > 1:
        parts = [BinOp("add", *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


# --- structure detectors


@dataclass
class PowerLaw:
    """y = scale * product of |x|**exponent, with y's sign."""

    scale: float
    exponents: dict[str, float]
    r2: float

    def tree(self) -> Node:
        out: Node = Const(self.scale)
        for name, e in self.exponents.items():
            if not e:
                continue
            x: Node = Var(name)
            whole, half = abs(e) == int(abs(e)) and abs(e) <= 4, abs(e) == 0.5
            if whole:
                for _ in range(int(abs(e))):
                    out = BinOp("mul" if e > 0 else "div", out, x)
            elif half:
                out = BinOp("mul" if e > 0 else "div", out, UnOp("sqrt", x))
            else:
                out = BinOp("mul", out, BinOp("pow", x, Const(e)))
        return out


def neat_exponent(e: float, tolerance: float = 0.02) -> float:
    """The nearest k, k/2 or k/3 within the tolerance, else e."""
    best = min((round(e * d) / d for d in (1, 2, 3)), key=lambda v: (abs(v - e) > tolerance, [1, 2, 3][[round(e * d) / d for d in (1, 2, 3)].index(v)]))
    return best if abs(best - e) <= tolerance else e


def power_law_of(df: DataFrame, names: list[str], target: Column, least_r2: float = 0.99) -> PowerLaw | None:
    """Least squares of ln|y| on the ln|x|, on rows where all are over 1e-12; those must be 95 of 100 and 50 at least."""
    log = lambda c: F.when(F.abs(c) > 1e-12, F.log(F.abs(c)))
    n, positive, negative = df.agg(F.count(F.lit(1)), F.count(F.when(target > 0, 1)), F.count(F.when(target < 0, 1))).first()
    if min(positive, negative) > 0.05 * n:
        return None
    f = factor(df, {x: log(F.col(f"`{x}`").cast("double")) for x in names}, log(target))
    if f.n < max(50, n / 4) or f.n < 0.95 * n:
        return None
    fit = _fit(f, None, _total(f))
    if fit.r2 < least_r2:
        return None
    exponents = {x: neat_exponent(fit[x]) for x in names}
    # the scale again, with the exponents as they are now
    rest = log(target)
    for x, e in exponents.items():
        rest = rest - F.lit(e) * log(F.col(f"`{x}`").cast("double"))
    level = df.agg(F.avg(rest)).first()[0]
    return PowerLaw(math.exp(level) * (1 if positive >= negative else -1), exponents, fit.r2)


def power_law(df: DataFrame, names: list[str], y: str, least_r2: float = 0.99) -> PowerLaw | None:
    return power_law_of(df, names, F.col(f"`{y}`").cast("double"), least_r2)


@dataclass
class ExpWrapper:
    """y = sign * scale * exp(rate * product of |x|**exponent)."""

    sign: float
    inner: PowerLaw
    r2: float

    def tree(self) -> Node:
        return BinOp("mul", Const(self.sign), UnOp("exp", self.inner.tree()))


def exp_wrapper(df: DataFrame, names: list[str], y: str, least_r2: float = 0.99) -> ExpWrapper | None:
    """A power law in ln|y|, if y keeps one sign and its logarithm another or the same throughout."""
    c = F.col(f"`{y}`").cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None or low <= 0 <= high:
        return None
    inner = power_law_of(df, names, F.log(F.abs(c)), least_r2)
    return ExpWrapper(1.0 if low > 0 else -1.0, inner, inner.r2) if inner else None


def power_law_seed(df: DataFrame, names: list[str], y: str) -> Node | None:
    """A tree from the first structure that fits."""
    found = power_law(df, names, y) or exp_wrapper(df, names, y)
    return found.tree() if found else None


#: Transforms of the target, and what undoes each as a tree.
TARGETS = {
    "identity": (lambda y: y, lambda t: t), "log_abs": (lambda y: F.log(F.abs(y)), lambda t: UnOp("exp", t)), "sqrt_abs": (lambda y: F.sqrt(F.abs(y)), lambda t: BinOp("mul", t, t)),
    "square": (lambda y: y * y, lambda t: UnOp("sqrt", t)), "inverse": (lambda y: F.when(y != 0, 1 / y), lambda t: BinOp("div", Const(1.0), t)),
}


def coordinate_seed(df: DataFrame, names: list[str], y: str, least_r2: float = 0.99) -> tuple[str, Node, float] | None:
    """The transform of y under which a power law fits best, and the tree with that undone."""
    best = None
    for name, (forward, back) in TARGETS.items():
        found = power_law_of(df, names, forward(F.col(f"`{y}`").cast("double")), least_r2)
        if found and (best is None or found.r2 > best[2] + 1e-12):
            best = (name, back(found.tree()), found.r2)
    return best


@dataclass
class Polynomial:
    names: list[str]
    terms: list[tuple[float, tuple[int, ...]]]
    constant: float
    r2: float

    def tree(self) -> Node:
        return weighted_sum([(c, monomial_tree(self.names, p)) for c, p in self.terms], self.constant)


def additive_polynomial(df: DataFrame, names: list[str], y: str, degree: int = 3, top: int = 8, least_r2: float = 0.99, most_terms: int = 500) -> Polynomial | None:
    """Least squares on all monomials to the degree; the `top` largest coefficients are kept and fitted again on the same factor."""
    powers = monomials(names, degree)
    if len(powers) + 1 > most_terms:
        return None
    f = factor(df, {str(p): monomial_column(names, p) for p in powers}, F.col(f"`{y}`"))
    full = _fit(f, None, _total(f))
    if full.r2 < least_r2:
        return None
    order = sorted(range(1, len(f.names)), key=lambda i: -abs(full.coefficients[i]))[:top]
    kept = [0, *sorted(i for i in order if abs(full.coefficients[i]) > 1e-10)]
    fit = _fit(f, kept, _total(f))
    return Polynomial(names, [(float(c), powers[i - 1]) for i, c in zip(kept[1:], fit.coefficients[1:], strict=True)], float(fit.coefficients[0]), fit.r2)


# --- sufficient statistics: what a term would change, without another pass


@dataclass
class Moments:
    """Of a basis and a residual r: gram = sum of basis_i basis_j, projection = sum of basis_i r, for n rows."""

    gram: np.ndarray
    projection: np.ndarray
    n: int

    @classmethod
    def of(cls, df: DataFrame, basis: list[Column], residual: Column) -> Moments:
        k = len(basis)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        rows = df.select(*[b.cast("double").alias(f"b{i}") for i, b in enumerate(basis)], residual.cast("double").alias("r")).where(finite(F.col("r")))
        row = rows.agg(F.count(F.lit(1)), *[F.sum(F.col(f"b{i}") * F.col(f"b{j}")) for i, j in pairs], *[F.sum(F.col(f"b{i}") * F.col("r")) for i in range(k)]).first()
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 : 1 + len(pairs)], strict=True):
            gram[i, j] = gram[j, i] = v or 0.0
        return cls(gram, np.array([v or 0.0 for v in row[1 + len(pairs) :]]), row[0])

    def change(self, c: np.ndarray) -> float:
        """What adding c times the basis to the *residual* (prediction minus target) does to the mean square error."""
        return float(2 * c @ self.projection + c @ self.gram @ c) / max(1, self.n)

    def best(self, ridge: float = 1e-12) -> np.ndarray:
        return -np.linalg.solve(self.gram + ridge * np.eye(len(self.gram)), self.projection)

    def best_change(self, ridge: float = 1e-12) -> float:
        return self.change(self.best(ridge))


def polish_with_terms(df: DataFrame, tree_column: Column, tree: Node, names: list[str], y: str, degree: int = 3, top: int = 3) -> tuple[Node, float]:
    """The tree plus the `top` univariate powers that help most together, and the expected change of the error."""
    powers = [(x, k) for x in names for k in range(1, degree + 1)]
    columns = [monomial_column([x], (k,)) for x, k in powers]
    m = Moments.of(df, [F.lit(1.0), *columns], tree_column - F.col(f"`{y}`"))
    c = m.best(1e-9)
    kept = sorted(range(1, len(c)), key=lambda i: -abs(c[i] * math.sqrt(max(m.gram[i, i], 0.0))))[:top]
    kept = [0, *sorted(kept)]
    part = Moments(m.gram[np.ix_(kept, kept)], m.projection[kept], m.n)
    best = part.best(1e-9)
    if part.change(best) >= 0:
        return tree, 0.0
    terms = [(float(best[j]), monomial_tree([powers[i - 1][0]], (powers[i - 1][1],))) for j, i in enumerate(kept) if i]
    return BinOp("add", tree, weighted_sum(terms, float(best[0]))), part.change(best)
