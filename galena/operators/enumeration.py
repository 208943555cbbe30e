"""Formulas by enumeration and sparse regression, and by taking a target apart.

A dictionary of all small trees is evaluated on the rows in memory (a bounded table; see `sample_rows`), by candidate on the
executors when a session is given. Few of its columns, chosen greedily or by a beam, explain the target.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions.pointwise import COMMUTATIVE
from galena.operators import tree as T
from galena.operators.regression import monomial_tree, monomials, weighted_sum
from galena.operators.simplify import simplify
from galena.operators.tree import BinOp, Const, Node, UnOp, Var

DEFAULT_UNARY = ("sqrt", "log", "exp", "sin", "cos")
DEFAULT_BINARY = ("add", "sub", "mul", "div")


def sample_rows(df: DataFrame, columns: list[str], most: int = 20_000) -> dict[str, np.ndarray]:
    """Columns of at most `most` rows, those of the least hashes: enumeration works on a bounded sample, scoring afterwards on all rows."""
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    pdf = df.select(*cols, F.xxhash64(*cols).alias("__h")).orderBy("__h", *columns).limit(most).toPandas()
    return {c: pdf[c].to_numpy(float) for c in columns}


@dataclass
class DiscoveryConfig:
    max_size: int = 3
    max_terms: int = 4
    max_features: int = 20_000
    beam: int = 10
    top: int = 24
    parsimony: float = 1e-4
    unary: tuple[str, ...] = DEFAULT_UNARY
    binary: tuple[str, ...] = DEFAULT_BINARY
    polynomial: int = 0  # a degree: thresholded least squares on monomials instead of a dictionary
    threshold: float = 0.05
    greedy: bool = False
    refine: bool = False


@dataclass
class Discovery:
    tree: Node
    r2: float
    terms: list[tuple[float, Node]] = field(default_factory=list)
    constant: float = 0.0


def enumerate_trees(names: list[str], config: DiscoveryConfig) -> list[Node]:
    """All trees without constants of 0 to max_size operators, smaller first; operands of commutative operators in one order only."""
    sizes: list[list[Node]] = [[Var(n) for n in names]]
    seen = {T.key(v) for v in sizes[0]}
    total = len(seen)
    for size in range(1, config.max_size + 1):
        found: list[Node] = []

        def add(node: Node) -> None:
            nonlocal total
            k = T.key(node)
            if k not in seen and total < config.max_features:  # noqa: B023
                seen.add(k)
                found.append(node)  # noqa: B023
                total += 1

        for a in sizes[size - 1]:
            for op in config.unary:
                add(UnOp(op, a))
        for left in range(size):
            for a, b in itertools.product(sizes[left], sizes[size - 1 - left]):
                for op in config.binary:
                    if op in COMMUTATIVE and T.key(a) > T.key(b) or a == b and op in ("sub", "div"):
                        continue
                    add(BinOp(op, a, b))
        sizes.append(found)
    return [t for part in sizes for t in part]


def dictionary(trees: list[Node], env: dict[str, np.ndarray], spark: SparkSession | None = None) -> tuple[list[Node], np.ndarray]:
    """Trees with columns that are finite, vary and differ (to seven digits of their scale); the first of equals stays."""

    def column(t: Node) -> np.ndarray | None:
        v = np.broadcast_to(np.asarray(T.run_tape(T.to_tape(t), env), float), next(iter(env.values())).shape)
        spread = v.std() if np.isfinite(v).all() else 0.0
        return v if spread > 1e-9 * max(1.0, float(np.abs(v).max())) and float(np.abs(v).max()) < 1e12 else None

    if spark is None:
        columns = [column(t) for t in trees]
    else:
        import pickle

        import pandas as pd

        data = spark.sparkContext.broadcast(env)

        def run(batches):
            for pdf in batches:
                made = []
                for tape in pdf["tape"]:
                    v = np.asarray(T.run_tape(pickle.loads(tape), data.value), float)
                    v = np.broadcast_to(v, next(iter(data.value.values())).shape)
                    good = np.isfinite(v).all() and v.std() > 1e-9 * max(1.0, float(np.abs(v).max())) and float(np.abs(v).max()) < 1e12
                    made.append(v.tobytes() if good else None)
                yield pd.DataFrame({"i": pdf["i"], "v": made})

        rows = spark.createDataFrame([(i, bytearray(pickle.dumps(T.to_tape(t)))) for i, t in enumerate(trees)], "i long, tape binary")
        found = {r["i"]: np.frombuffer(bytes(r["v"])) for r in rows.repartition(spark.sparkContext.defaultParallelism, "i").mapInPandas(run, "i long, v binary").where("v is not null").collect()}
        columns = [found.get(i) for i in range(len(trees))]
    kept, seen, out = [], set(), []
    for t, v in zip(trees, columns, strict=True):
        if v is None:
            continue
        mark = np.round(v / (np.abs(v).max() or 1.0), 7).tobytes()
        if mark not in seen:
            seen.add(mark)
            kept.append(t)
            out.append(v)
    return kept, np.array(out) if out else np.zeros((0, len(next(iter(env.values())))))


def _refit(phi: np.ndarray, rows: tuple[int, ...], y: np.ndarray) -> tuple[np.ndarray, float]:
    a = np.column_stack([np.ones_like(y), *(phi[i] for i in rows)])
    scale = np.sqrt((a * a).sum(0))
    c, *_ = np.linalg.lstsq(a / scale, y, rcond=None)
    rest = y - a @ (c / scale)
    return c / scale, float(rest @ rest)


def select_terms(trees: list[Node], phi: np.ndarray, y: np.ndarray, config: DiscoveryConfig) -> Discovery:
    """Subsets of columns grown by their correlation with what is left, the best `beam` of them kept."""
    total = float(((y - y.mean()) ** 2).sum()) or 1e-300
    sizes = np.array([T.complexity(t) for t in trees])
    centred = phi - phi.mean(1, keepdims=True)
    norms = np.sqrt((centred * centred).sum(1))
    best = Discovery(Const(float(y.mean())), 0.0, [], float(y.mean()))
    beam: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    width, top = (1, 1) if config.greedy else (config.beam, config.top)
    for _ in range(config.max_terms):
        tried: dict[tuple[int, ...], tuple[float, np.ndarray]] = {}
        for _, rows in beam:
            c, _ = _refit(phi, rows, y)
            rest = y - c[0] - sum((w * phi[i] for w, i in zip(c[1:], rows, strict=True)), np.zeros_like(y))
            score = np.abs(centred @ (rest - rest.mean())) / norms / (np.linalg.norm(rest - rest.mean()) + 1e-300) - config.parsimony * sizes
            score[list(rows)] = -np.inf
            for i in np.argsort(-score, kind="stable")[:top].tolist():
                new = tuple(sorted((*rows, i)))
                if new not in tried and np.isfinite(score[i]):
                    c, rss = _refit(phi, new, y)
                    tried[new] = (1 - rss / total, c)
        ranked = sorted(tried, key=lambda r: (-round(tried[r][0], 12), len(r), int(sizes[list(r)].sum())))[:width]
        if not ranked:
            break
        beam = [(tried[r][0], r) for r in ranked]
        r2, c = tried[ranked[0]]
        if r2 > best.r2 + 1e-9:
            terms = [(float(w), trees[i]) for w, i in zip(c[1:], ranked[0], strict=True)]
            constant = float(c[0]) if abs(c[0]) > 1e-9 * (np.abs(y).max() or 1) else 0.0
            best = Discovery(weighted_sum(terms, constant), r2, terms, constant)
        else:
            break
        if best.r2 >= 1 - 1e-12:
            break
    return best


def thresholded_polynomial(names: list[str], env: dict[str, np.ndarray], y: np.ndarray, degree: int, threshold: float) -> Discovery:
    """Least squares on monomials; of scaled columns those with little share go, and the rest is fitted again."""
    powers = monomials(names, degree)
    trees = [monomial_tree(names, p) for p in powers]
    phi = np.array([np.prod([env[n] ** k for n, k in zip(names, p, strict=True) if k], axis=0) for p in powers])
    total = float(((y - y.mean()) ** 2).sum()) or 1e-300
    rows = tuple(range(len(trees)))
    for _ in range(12):
        c, rss = _refit(phi, rows, y)
        kept = tuple(i for i, w in zip(rows, c[1:], strict=True) if abs(w) >= threshold * 1e-6 * max(1e-12, float(np.abs(c[1:]).max())) and abs(w) * phi[i].std() >= 1e-6 * y.std())
        if kept == rows:
            break
        rows = kept
    c, rss = _refit(phi, rows, y)
    terms = [(float(w), trees[i]) for w, i in zip(c[1:], rows, strict=True)]
    constant = float(c[0]) if abs(c[0]) > 1e-9 * (np.abs(y).max() or 1) else 0.0
    return Discovery(weighted_sum(terms, constant), 1 - rss / total, terms, constant)


def refine_constant(names: list[str], env: dict[str, np.ndarray], y: np.ndarray) -> Discovery | None:
    """a * g(x; theta) + b for templates g with one free constant: theta by golden sections from several starts, a and b by least squares."""
    templates: list[Callable[[Node, float], Node]] = [
        lambda x, t: UnOp("exp", BinOp("mul", Const(t), x)), lambda x, t: UnOp("sin", BinOp("mul", Const(t), x)), lambda x, t: UnOp("tanh", BinOp("mul", Const(t), x)),
        lambda x, t: BinOp("pow", x, Const(t)), lambda x, t: BinOp("div", Const(1.0), BinOp("add", x, Const(t))),
    ]
    total, best = float(((y - y.mean()) ** 2).sum()) or 1e-300, None

    def at(g, x: Node, t: float) -> tuple[float, np.ndarray]:
        v = np.broadcast_to(np.asarray(T.evaluate(g(x, t), env), float), y.shape)
        if not np.isfinite(v).all() or np.abs(v).max() > 1e12 or v.std() < 1e-12:
            return math.inf, np.zeros(2)
        c, rss = _refit(v[None], (0,), y)
        return rss, c

    for name in names:
        for g in templates:
            for low, high in ((-4.0, -0.05), (0.05, 1.0), (1.0, 6.0)):
                grid = np.linspace(low, high, 12)
                i = int(np.argmin([at(g, Var(name), float(t))[0] for t in grid]))
                low, high = float(grid[max(0, i - 1)]), float(grid[min(len(grid) - 1, i + 1)])
                for _ in range(40):
                    third = (high - low) * 0.381966
                    if at(g, Var(name), low + third)[0] < at(g, Var(name), high - third)[0]:
                        high -= third
                    else:
                        low += third
                t = (low + high) / 2
                rss, c = at(g, Var(name), t)
                if math.isfinite(rss) and (best is None or 1 - rss / total > best.r2 + 1e-9):
                    node = g(Var(name), t)
                    best = Discovery(weighted_sum([(float(c[1]), node)], float(c[0])), 1 - rss / total, [(float(c[1]), node)], float(c[0]))
    return best


def discover(env: dict[str, np.ndarray], y: np.ndarray, config: DiscoveryConfig | None = None, spark: SparkSession | None = None) -> Discovery:
    config, names = config or DiscoveryConfig(), sorted(env)
    good = np.isfinite(y) & np.all([np.isfinite(v) for v in env.values()], axis=0)
    env, y = {k: v[good] for k, v in env.items()}, y[good]
    if config.polynomial:
        found = thresholded_polynomial(names, env, y, config.polynomial, config.threshold)
    else:
        trees, phi = dictionary(enumerate_trees(names, config), env, spark)
        found = select_terms(trees, phi, y, config) if len(trees) else Discovery(Const(float(y.mean())), 0.0, [], float(y.mean()))
    if config.refine and found.r2 < 1 - 1e-9:
        other = refine_constant(names, env, y)
        found = other if other and other.r2 > found.r2 else found
    return found


def discover_boosted(env: dict[str, np.ndarray], y: np.ndarray, rounds: int = 3, config: DiscoveryConfig | None = None) -> Discovery:
    """Each round explains what the last left."""
    parts, rest, total = [], y.astype(float), float(((y - y.mean()) ** 2).sum()) or 1e-300
    for _ in range(rounds):
        found = discover(env, rest, config)
        if found.r2 < 1e-6:
            break
        parts.append(found.tree)
        rest = rest - T.evaluate(found.tree, env)
    return Discovery(weighted_sum([(1.0, p) for p in parts]), 1 - float(rest @ rest) / total)


def discover_deep(env: dict[str, np.ndarray], y: np.ndarray, depth: int = 2, config: DiscoveryConfig | None = None) -> Discovery:
    """Each layer may use the formula before it as one more variable."""
    found, layers = discover(env, y, config), dict(env)
    for i in range(depth - 1):
        layers[f"layer{i}"] = np.broadcast_to(np.asarray(T.evaluate(found.tree, env), float), y.shape)
        new = discover(layers, y, config)
        if new.r2 <= found.r2 + 1e-9:
            break
        inner = found.tree

        def put(n: Node, name: str = f"layer{i}", inner: Node = inner) -> Node:
            return inner if n == Var(name) else T.with_children(n, tuple(put(c, name, inner) for c in T.children(n)))

        found = Discovery(put(new.tree), new.r2)
    return found


# --- taking apart

#: Outer functions that may be peeled off: what to do to the target, and how the tree undoes it.
PEELS = {
    "square": (lambda y: y * y, lambda t: UnOp("sqrt", t)), "sqrt": (lambda y: np.sqrt(np.abs(y)), lambda t: BinOp("mul", t, t)),
    "log": (lambda y: np.log(np.maximum(np.abs(y), 1e-300)), lambda t: UnOp("exp", t)), "inverse": (lambda y: 1 / np.where(np.abs(y) < 1e-300, np.nan, y), lambda t: BinOp("div", Const(1.0), t)),
    "inverse_square": (lambda y: 1 / np.where(np.abs(y) < 1e-150, np.nan, y * y), lambda t: BinOp("div", Const(1.0), UnOp("sqrt", t))), "sine": (lambda y: np.sin(y), lambda t: UnOp("asin", t)),
}


def _r2(tree: Node, env: dict[str, np.ndarray], y: np.ndarray) -> float:
    p = np.broadcast_to(np.asarray(T.evaluate(tree, env), float), y.shape)
    good = np.isfinite(p) & np.isfinite(y)
    if good.sum() < max(2, 0.9 * len(y)):
        return -math.inf
    total = float(((y[good] - y[good].mean()) ** 2).sum()) or 1e-300
    return 1 - float(((p[good] - y[good]) ** 2).sum()) / total


def _power_law(env: dict[str, np.ndarray], y: np.ndarray) -> Node | None:
    from galena.operators.regression import PowerLaw, neat_exponent

    names = sorted(env)
    good = np.all([np.abs(env[n]) > 1e-12 for n in names], axis=0) & (np.abs(y) > 1e-12) & np.isfinite(y)
    if good.sum() < 0.95 * len(y) or not (np.all(y[good] > 0) or np.all(y[good] < 0)):
        return None
    a = np.column_stack([np.ones(good.sum()), *(np.log(np.abs(env[n][good])) for n in names)])
    target = np.log(np.abs(y[good]))
    c, *_ = np.linalg.lstsq(a, target, rcond=None)
    exponents = {n: neat_exponent(float(e)) for n, e in zip(names, c[1:], strict=True)}
    level = float(np.mean(target - sum(e * np.log(np.abs(env[n][good])) for n, e in exponents.items())))
    rest = target - a @ c
    if float(rest @ rest) > 0.01 * float(((target - target.mean()) ** 2).sum() or 1e-300):
        return None
    return PowerLaw(math.exp(level) * (1 if y[good][0] > 0 else -1), exponents, 1.0).tree()


def interaction_groups(env: dict[str, np.ndarray], y: np.ndarray, least: float = 0.04) -> list[list[str]]:
    """Variables that act together: an edge where a product explains what separate cubic curves leave; groups are the components."""
    names = sorted(env)
    a = np.column_stack([np.ones(len(y)), *(env[n] ** k for n in names for k in (1, 2, 3))])
    scale = np.sqrt((a * a).sum(0))
    c, *_ = np.linalg.lstsq(a / scale, y, rcond=None)
    rest = y - a @ (c / scale)
    parent = {n: n for n in names}

    def find(n: str) -> str:
        while parent[n] != n:
            n = parent[n]
        return n

    if np.linalg.norm(rest) > 1e-9 * np.linalg.norm(y):
        for p, q in itertools.combinations(names, 2):
            x = (env[p] - env[p].mean()) * (env[q] - env[q].mean())
            if max(abs(np.corrcoef(x, rest)[0, 1]), abs(np.corrcoef(x * x, rest)[0, 1])) > least:
                parent[find(p)] = find(q)
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(find(n), []).append(n)
    return sorted(groups.values())


def _leftover(env: dict[str, np.ndarray], y: np.ndarray) -> np.ndarray:
    """What cubic polynomials of the variables leave of y (linear ones, where those are too many), scaled up for the terms used."""
    names = sorted(env)
    degree = 3 if math.comb(len(names) + 3, 3) < 0.2 * len(y) else 1
    cols = [np.prod([env[n] ** k for n, k in zip(names, p, strict=True) if k], axis=0) for p in monomials(names, degree)]
    a = np.column_stack([np.ones(len(y)), *cols])
    a = a / np.sqrt((a * a).sum(0))
    return (y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) * math.sqrt(len(y) / max(1, len(y) - a.shape[1]))


def common_factor(env: dict[str, np.ndarray], y: np.ndarray) -> tuple[str, int] | None:
    """A variable and a power whose quotient of y does not depend on the variable any more: neither what other variables
    leave of the quotient, nor its square, goes with it, and the quotient varies less than y."""
    limit = 4 / math.sqrt(len(y))
    for name in sorted(env):
        x, others = env[name], {k: v for k, v in env.items() if k != name}
        if not others or np.abs(x).min() < 1e-9:
            continue
        for power in (1, -1, 2, -2):
            q = y / x**power
            rest = _leftover(others, q)
            scale = float(np.std(q)) or 1e-300
            if np.std(rest) < 1e-9 * scale:
                return name, power
            marks = [abs(np.corrcoef(f, g)[0, 1]) for f in (rest, rest * rest, q) for g in (x, np.log(np.abs(x)))]
            both = _leftover(env, q)
            if max(marks) < limit and np.std(both) > 0.97 * np.std(rest):
                return name, power
    return None


def decompose(env: dict[str, np.ndarray], y: np.ndarray, config: DiscoveryConfig | None = None, depth: int = 2, spark: SparkSession | None = None) -> Discovery:
    """A formula by the first of: a power law, a polynomial, a small free form, the same under a peeled outer function, a sum over
    groups of variables. Each branch is judged on the last fifth of the rows, which no fit sees."""
    config, cut = config or DiscoveryConfig(max_features=4000), max(1, int(0.8 * len(y))) if len(y) >= 40 else len(y)
    fit = ({k: v[:cut] for k, v in env.items()}, y[:cut])
    held = ({k: v[cut:] for k, v in env.items()}, y[cut:]) if cut < len(y) else fit
    exact = 1 - 1e-12

    def judged(tree: Node) -> float:
        return min(_r2(tree, *fit), _r2(tree, *held))

    def leaf(e: dict[str, np.ndarray], t: np.ndarray) -> list[Node]:
        out = []
        good = np.isfinite(t)
        e, t = {k: v[good] for k, v in e.items()}, t[good]
        if len(t) < 10:
            return out
        law = _power_law(e, t)
        if law is not None:
            out.append(law)
            if _r2(law, e, t) >= exact:
                return out
        for degree in range(1, 7):
            if math.comb(len(e) + degree, degree) > 0.5 * len(t) or math.comb(len(e) + degree, degree) > 220:
                break
            found = discover(e, t, DiscoveryConfig(polynomial=degree))
            out.append(found.tree)
            if found.r2 >= exact:
                return out
        found = discover(e, t, config, spark)
        out.append(found.tree)
        if found.r2 < exact:
            other = discover(e, t, DiscoveryConfig(max_size=config.max_size, max_features=config.max_features, refine=True), spark) if len(e) <= 3 else None
            out += [other.tree] if other else []
        return out

    best, score = Const(float(np.nanmean(y))), -math.inf

    def consider(tree: Node) -> bool:
        nonlocal best, score
        r2 = judged(tree)
        if r2 > score + 1e-9 or r2 > score - 1e-9 and T.complexity(tree) < T.complexity(best):
            best, score = tree, max(r2, score)
        return score >= exact

    for t in leaf(*fit):
        if consider(simplify(t, fast=False)):
            return Discovery(best, score)
    if len(env) > 1 and (factor := common_factor(*fit)):
        name, power = factor
        inner = decompose({k: v for k, v in env.items() if k != name}, y / env[name] ** power, config, depth, spark)
        tree = inner.tree
        for _ in range(abs(power)):
            tree = BinOp("mul" if power > 0 else "div", tree, Var(name))
        if consider(simplify(tree, fast=False)):
            return Discovery(best, score)
    for forward, back in PEELS.values():
        with np.errstate(all="ignore"):
            inner = forward(fit[1])
        if np.isfinite(inner).mean() < 0.95:
            continue
        for t in leaf(fit[0], inner):
            sign = 1.0 if np.nanmean(fit[1]) >= 0 else -1.0
            tree = back(t)
            if consider(simplify(tree if sign > 0 else UnOp("neg", tree), fast=False)):
                return Discovery(best, score)
    if depth > 0 and len(env) >= 2:
        groups = interaction_groups(*fit)
        if len(groups) > 1:
            parts: list[Node] = [Const(0.0)] * len(groups)
            for _ in range(2):  # each group against what the others leave
                for i, g in enumerate(groups):
                    others = [np.broadcast_to(np.asarray(T.evaluate(p, fit[0]), float), fit[1].shape) for k, p in enumerate(parts) if k != i]
                    parts[i] = decompose({n: fit[0][n] for n in g}, fit[1] - sum(others, np.zeros(fit[1].shape)), config, depth - 1, spark).tree
                if consider(simplify(weighted_sum([(1.0, p) for p in parts]), fast=False)):
                    return Discovery(best, score)
    return Discovery(best, score)
