"""Search for formulas: random trees, mutation, evolution, annealing, constants.

Populations are small and live on the driver; what costs is scoring, which goes through operators.scoring, by data or by
candidate. Every random choice comes from a generator seeded by (seed, generation, index), so results do not depend on
how work is dealt out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from galena.functions.pointwise import BINARY, REDUCE, UNARY
from galena.operators import gradients, intervals, measures
from galena.operators import tree as T
from galena.operators.lowering import Series, pointwise
from galena.operators.measures import Linear, SeparableBilinear, Volterra2
from galena.operators.regression import polish_with_terms
from galena.operators.scoring import Candidate, DataScorer, HallOfFame, losses_by_candidate, score_arrays
from galena.operators.simplify import simplify
from galena.operators.tree import BinOp, Const, FunctionalOp, FunctionalOp2D, Node, UnOp, Var

# fixed values: limits of trees, and the grids that random measures are drawn from
MOST_DEPTH, MOST_COMPLEXITY, MOST_CONSTANT = 8, 40, 1e4
HALF_LIVES = [3, 6, 12, 24, 48, 168, 336, 720]
LAGS = [1, 2, 3, 6, 12, 24, 48, 72, 168, 336]
WINDOWS = [3, 6, 12, 24, 48, 168, 336]
ALPHAS = [1.2, 1.5, 2.0, 2.5, 3.0]
SWAPS = [("add", "sub"), ("div", "mul", "pow"), ("max", "min"), ("sign", "tanh"), ("abs", "neg"), ("exp", "log", "sqrt"), ("cos", "sin"), ("acos", "asin")]


def is_valid(node: Node, features: set[str]) -> bool:
    return T.depth(node) <= MOST_DEPTH and T.complexity(node) <= MOST_COMPLEXITY and all(abs(c) <= MOST_CONSTANT for c in T.constants(node)) and T.used_features(node) <= features


def _pick(rng: random.Random, weighted: dict) -> object:
    return rng.choices(list(weighted), list(weighted.values()))[0]


def random_constant(rng: random.Random) -> float:
    return rng.choice((-1, 1)) * math.exp(rng.uniform(math.log(0.01), math.log(10)))


def random_measure(rng: random.Random) -> measures.Measure:
    kind = _pick(rng, {"lag": 0.2, "diff": 0.15, "ema": 0.3, "roll": 0.15, "power": 0.1, "sum": 0.1})
    if kind == "lag":
        return measures.lag(rng.choice(LAGS))
    if kind == "diff":
        return measures.diff(rng.choice(LAGS))
    if kind == "ema":
        return measures.ema(rng.choice(HALF_LIVES))
    if kind == "roll":
        return measures.roll_mean(rng.choice(WINDOWS))
    if kind == "power":
        return measures.power_law(rng.choice(WINDOWS), rng.choice(ALPHAS))
    return measures.signed_sum([(rng.uniform(-1, 1), rng.choice([0, *LAGS])) for _ in range(rng.randint(2, 3))])


def random_measure_2d(rng: random.Random) -> measures.Measure2D:
    kind = _pick(rng, {"laplacian": 0.3, "grad": 0.15, "diff": 0.15, "separable": 0.2, "stencil": 0.2})
    if kind == "laplacian":
        return measures.laplacian()
    if kind == "grad":
        return measures.grad_x()
    if kind == "diff":
        return measures.diff_t(rng.choice((1, 2, 3)))
    if kind == "separable":
        return measures.separable_2d(measures.lag(rng.choice((0, 1, 2))), measures.signed_sum([(rng.uniform(-1, 1), k) for k in range(3)]))
    return measures.atomic_2d([(rng.uniform(-1, 1), rng.choice((0, 1)), rng.choice((-1, 0, 1))) for _ in range(rng.randint(2, 4))])


@dataclass
class Grammar:
    features: list[str]
    measures_1d: bool = True
    measures_2d: bool = False
    unary: dict[str, float] = field(default_factory=lambda: {**dict.fromkeys(UNARY, 1.0), **dict.fromkeys(REDUCE, 0.1)})

    def tree(self, rng: random.Random, depth: int = 4) -> Node:
        kinds = {"leaf": 0.1, "unary": 0.2, "binary": 0.45, "functional": 0.25 if self.measures_1d or self.measures_2d else 0.0}
        kind = "leaf" if depth <= 1 else _pick(rng, kinds)
        if kind == "leaf":
            return Var(rng.choice(self.features)) if rng.random() < 0.8 else Const(random_constant(rng))
        if kind == "unary":
            return UnOp(_pick(rng, self.unary), self.tree(rng, depth - 1))
        if kind == "binary":
            return BinOp(rng.choice(sorted(BINARY)), self.tree(rng, depth - 1), self.tree(rng, depth - 1))
        # over a field, where both kinds may stand, a measure along one axis says which: mostly time
        if self.measures_2d and (not self.measures_1d or rng.random() < 0.5):
            return FunctionalOp2D(random_measure_2d(rng), self.tree(rng, depth - 1))
        axis = _pick(rng, {"time": 0.8, "space": 0.2}) if self.measures_2d else None
        f = _pick(rng, {"linear": 0.5, "bilinear": 0.25, "volterra": 0.25})
        if f == "linear":
            return FunctionalOp(Linear(random_measure(rng), axis), (self.tree(rng, depth - 1),))
        if f == "bilinear":
            return FunctionalOp(SeparableBilinear(random_measure(rng), random_measure(rng), axis), (self.tree(rng, depth - 1), self.tree(rng, depth - 1)))
        return FunctionalOp(Volterra2(random_measure(rng), random_measure(rng), axis), (self.tree(rng, depth - 1),))


# --- mutations: each takes and gives a tree


def _where(node: Node, test: Callable[[Node], bool]) -> list[int]:
    return [i for i, n in enumerate(T.subtrees(node)) if test(n)]


def _at(node: Node, index: int) -> Node:
    return next(n for i, n in enumerate(T.subtrees(node)) if i == index)


def swap_subtree(node: Node, g: Grammar, rng: random.Random) -> Node:
    return T.replace_at(node, rng.randrange(T.complexity(node)), g.tree(rng, 3))


def crossover(a: Node, b: Node, rng: random.Random) -> Node:
    return T.replace_at(a, rng.randrange(T.complexity(a)), _at(b, rng.randrange(T.complexity(b))))


def jitter(node: Node, g: Grammar, rng: random.Random) -> Node:
    return T.with_constants(node, [c * math.exp(rng.gauss(0, 0.1)) for c in T.constants(node)])


def insert_term(node: Node, g: Grammar, rng: random.Random) -> Node:
    return BinOp(rng.choice(("add", "sub")), node, g.tree(rng, 2))


def delete_term(node: Node, g: Grammar, rng: random.Random) -> Node:
    found = _where(node, lambda n: isinstance(n, BinOp) and n.op in ("add", "sub"))
    if not found:
        return node
    at = rng.choice(found)
    n = _at(node, at)
    return T.replace_at(node, at, rng.choice((n.a, n.b)))


def swap_operator(node: Node, g: Grammar, rng: random.Random) -> Node:
    groups = {op: group for group in SWAPS for op in group}
    found = _where(node, lambda n: isinstance(n, BinOp | UnOp) and n.op in groups)
    if not found:
        return node
    at = rng.choice(found)
    n = _at(node, at)
    op = rng.choice([o for o in groups[n.op] if o != n.op])
    return T.replace_at(node, at, BinOp(op, n.a, n.b) if isinstance(n, BinOp) else UnOp(op, n.a))


def mutate_measure(node: Node, g: Grammar, rng: random.Random) -> Node:
    found = _where(node, lambda n: isinstance(n, FunctionalOp | FunctionalOp2D))
    if not found:
        return node
    at = rng.choice(found)
    n = _at(node, at)
    if isinstance(n, FunctionalOp2D):
        return T.replace_at(node, at, FunctionalOp2D(random_measure_2d(rng), n.arg))
    f = n.functional
    new = replace(f, mu=random_measure(rng)) if isinstance(f, Linear) or rng.random() < 0.5 else replace(f, nu=random_measure(rng))
    return T.replace_at(node, at, FunctionalOp(new, n.args))


def collapse(node: Node, g: Grammar, rng: random.Random) -> Node:
    """One measure for two in a row."""
    from galena.operators.simplify import _functional

    for at in _where(node, lambda n: isinstance(n, FunctionalOp)):
        new = _functional(_at(node, at))
        if new is not None:
            return T.replace_at(node, at, new)
    return node


MUTATIONS = {swap_subtree: 0.2, jitter: 0.2, insert_term: 0.15, delete_term: 0.1, swap_operator: 0.1, mutate_measure: 0.15, collapse: 0.1}


def mutate(node: Node, g: Grammar, rng: random.Random, tries: int = 5) -> Node:
    for _ in range(tries):
        new = _pick(rng, MUTATIONS)(node, g, rng)
        if new != node and is_valid(new, set(g.features)):
            return new
    return node


# --- constants


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 200, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """A simplex walk downhill."""
    n = len(start)
    points = [np.array(start, float)]
    for i in range(n):
        p = points[0].copy()
        p[i] = p[i] * 1.05 if p[i] else 0.00025
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance) and np.ptp(points, axis=0).max() < 1e-10:
            break
        middle = np.mean(points[:-1], axis=0)
        far = middle + (middle - points[-1])
        value = f(far)
        if value < values[0]:
            farther = middle + 2 * (middle - points[-1])
            v = f(farther)
            points[-1], values[-1] = (farther, v) if v < value else (far, value)
        elif value < values[-2]:
            points[-1], values[-1] = far, value
        else:
            near = middle + 0.5 * ((far if value < values[-1] else points[-1]) - middle)
            v = f(near)
            if v < min(value, values[-1]):
                points[-1], values[-1] = near, v
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best]


def optimise_constants(node: Node, loss: Callable[[Node], float], steps: int = 200, method: str = "simplex") -> tuple[Node, float]:
    """The tree with its constants where the loss is least nearby; never a worse one. method: simplex, bfgs or powell."""
    start = T.constants(node)
    before = loss(node)
    if not start or not math.isfinite(before):
        return node, before
    walk = {"simplex": nelder_mead, "bfgs": gradients.bfgs, "powell": gradients.powell}[method]
    c, after = walk(lambda v: loss(T.with_constants(node, list(v))), np.array(start), steps=steps)
    return (T.with_constants(node, list(c)), after) if after < before else (node, before)


def neat_values() -> list[float]:
    """By a rule, of either sign: whole numbers to ten, simple fractions, powers of pi and e with small factors, roots, and the reciprocals of all these."""
    simple = [float(k) for k in range(0, 11)] + [p / q for q in (2, 3, 4, 5, 6, 8, 10) for p in range(1, 3 * q) if p % q]
    circle = [k * math.pi**n for n in (1, 2, 3) for k in (1, 2, 3, 4, 6, 8, 1 / 2, 1 / 3, 1 / 4, 2 / 3, 3 / 2, 4 / 3)]
    special = [*circle, math.e, math.e**2, *(k**0.5 for k in (2, 3, 5, 6, 7, 10)), (2 * math.pi) ** 0.5, math.pi**0.5]
    return sorted({s * v for v in simple + special + [1 / v for v in special] for s in (1, -1)})


def snap_constants(node: Node, loss: Callable[[Node], float], tolerance: float = 0.005) -> tuple[Node, float]:
    """All constants that lie within the tolerance of a neat value moved there at once, if the loss hardly rises."""
    before, neat = loss(node), neat_values()
    new = []
    for c in T.constants(node):
        near = min(neat, key=lambda v: abs(v - c))
        new.append(near if abs(near - c) <= tolerance * max(abs(near), 1e-9) else c)
    snapped = T.with_constants(node, new)
    after = loss(snapped)
    return (snapped, after) if after - before <= max(1e-9, 1e-3 * before) else (node, before)


# --- searchers


@dataclass
class SearchConfig:
    population: int = 100
    generations: int = 50
    tournament: int = 3
    parsimony: float = 0.005
    final_parsimony: float | None = None  # if given: low until three tenths, then linearly up to this
    patience: int = 10
    polish_every: int = 5
    polish_steps: int = 60
    snap: bool = True
    crossover: float = 0.3
    share: float = 0.9
    fill: float = 0.0
    prune: bool = True
    method: str = "simplex"  # how constants are polished: simplex, bfgs, powell, or slopes (exact ones, of pointwise trees)
    adapt_every: int = 0  # generations after which unary operators are drawn as the front uses them; 0: never
    seed: int = 0
    seeds: list[Node] = field(default_factory=list)


def parsimony_at(config: SearchConfig, generation: int) -> float:
    if config.final_parsimony is None:
        return config.parsimony
    at = generation / max(1, config.generations)
    return config.parsimony if at < 0.3 else config.parsimony + (config.final_parsimony - config.parsimony) * (at - 0.3) / 0.7


class Evolution:
    """(mu + lambda): breed by tournament, score, keep the best of parents and children; polish the front's constants now and then.

    score: losses of a list of trees. With a session and arrays it runs by candidate; hand another function to score by data.
    fit: a tree with fitted constants and its loss, in place of the walk on the arrays (gradients.fit_constants_by_data sees all rows).
    judge: what selection goes by, from a tree and its loss, before parsimony (fitness.py has hold-out rows and description length).
    accept: trees that may live at all (fitness.causal, for one); others are never scored.
    ranges and bound: of the variables and of the target, where arrays are not all rows; on_table takes them from the table.
    extend: a tree with terms that help it, tried on the front's best whenever constants are polished (regression.polish_with_terms knows them from one pass).
    """

    def __init__(
        self, grammar: Grammar, env: dict[str, np.ndarray], y: np.ndarray, config: SearchConfig | None = None, spark: SparkSession | None = None, score: Callable[[list[Node]], list[float]] | None = None,
        fit: Callable[[Node], tuple[Node, float]] | None = None, judge: Callable[[Node, float], float] | None = None, accept: Callable[[Node], bool] | None = None,
        ranges: dict[str, intervals.Interval] | None = None, bound: intervals.TargetBound | intervals.TableBound | None = None, extend: Callable[[Node], Node] | None = None,
    ) -> None:
        self.g, self.env, self.y, self.config, self.spark = grammar, env, y, config or SearchConfig(), spark
        self.score = score or (self._by_candidate if spark else self._here)
        self.fit, self.judge, self.accept = fit, judge or (lambda tree, loss: loss), accept or (lambda tree: True)
        self.extend = extend
        self.refused = 0
        self.hall = HallOfFame()
        self.ranges = ranges or {k: intervals.of_points(v.ravel()) for k, v in env.items()}
        self.bound = bound or intervals.TargetBound(y.ravel())
        self.pruned = 0

    @classmethod
    def on_table(
        cls, grammar: Grammar, df: DataFrame, y: str, config: SearchConfig | None = None, series: Series | None = None, fit_steps: int = 6,
        judge: Callable[[Node, float], float] | None = None, accept: Callable[[Node], bool] | None = None, terms: int = 0, degree: int = 3,
    ) -> Evolution:
        """A search that never holds rows: losses, fitted constants, the ranges of the variables and the target's bounds all come from passes over df.

        fit_steps: passes that fit a front member's constants. terms: powers of variables, up to `degree`, that may be added to the front's best from sums over all rows. Measures that two trees of a generation hold become columns that later generations find again.
        """
        config = config or SearchConfig()
        names = list(grammar.features)
        scorer = DataScorer(df, y, series, config.fill, config.share)
        fit = lambda tree: gradients.fit_constants_by_data(df, tree, y, fit_steps)
        extend = (lambda tree: polish_with_terms(df, pointwise(tree), tree, names, y, degree, terms)[0] if T.is_pointwise(tree) else tree) if terms else None
        return cls(grammar, {}, np.zeros(0), config, score=scorer, fit=fit, judge=judge, accept=accept, ranges=intervals.of_columns(df, names), bound=intervals.TableBound(df, y), extend=extend)

    def _here(self, trees: list[Node]) -> list[float]:
        memo: dict = {}
        return [score_arrays(t, self.env, self.y, self.config.fill, self.config.share, memo) for t in trees]

    def _by_candidate(self, trees: list[Node]) -> list[float]:
        return losses_by_candidate(self.spark, trees, self.env, self.y, self.config.fill, self.config.share)

    def loss(self, node: Node) -> float:
        return score_arrays(node, self.env, self.y, self.config.fill, self.config.share)

    def _scored(self, trees: list[Node], generation: int) -> list[Candidate]:
        trees = [simplify(t) for t in trees]
        front, weight = self.hall.pareto_front(), parsimony_at(self.config, generation)
        keep = []
        for t in trees:
            if not self.accept(t):
                self.refused += 1
                continue
            # a tree that cannot beat the front whatever its values is not scored
            if self.config.prune and front and self.bound.mse(intervals.evaluate(t, self.ranges)) > intervals.pareto_threshold(front, T.complexity(t)):
                self.pruned += 1
            else:
                keep.append(t)
        losses = self.score(keep) if keep else []
        found = [Candidate(t, v, T.complexity(t), self.judge(t, v) + weight * T.complexity(t), generation) for t, v in zip(keep, losses, strict=True)]
        self.hall.update_many(found)
        return found

    def _adapt(self) -> None:
        from galena.operators.fitness import operator_weights

        weights = operator_weights(self.hall.pareto_front())
        self.g = replace(self.g, unary={op: weights.get(op, w) for op, w in self.g.unary.items()})

    def _rng(self, generation: int, index: int) -> random.Random:
        return random.Random(f"{self.config.seed}/{generation}/{index}")

    def run(self) -> list[Candidate]:
        c = self.config
        rank = lambda x: (x.fitness, x.complexity, T.key(x.tree))
        alive = self._scored([*c.seeds, *[self.g.tree(self._rng(0, i)) for i in range(c.population - len(c.seeds))]], 0)
        best, idle = math.inf, 0
        for generation in range(1, c.generations + 1):
            children = []
            for i in range(c.population):
                rng = self._rng(generation, i)
                if not alive:  # nothing accepted so far
                    children.append(self.g.tree(rng))
                    continue
                pick = lambda: min(rng.sample(alive, min(c.tournament, len(alive))), key=rank).tree  # noqa: B023, E731
                child = crossover(pick(), pick(), rng) if rng.random() < c.crossover and len(alive) > 1 else mutate(pick(), self.g, rng)
                children.append(child if is_valid(child, set(self.g.features)) else pick())
            new = self._scored(children, generation)
            pool = {T.key(x.tree): x for x in [*alive, *new, *self.hall.pareto_front()]}
            alive = sorted(pool.values(), key=rank)[: c.population]
            if generation % c.polish_every == 0:
                self._polish(generation)
            if c.adapt_every and generation % c.adapt_every == 0:
                self._adapt()
            top = self.hall.top()
            idle = 0 if top and top.loss < best - 1e-12 else idle + 1
            best = top.loss if top else best
            if idle >= c.patience or best <= 1e-24:
                break
        self._polish(c.generations)
        return self.hall.pareto_front()

    def _polish(self, generation: int) -> None:
        for member in self.hall.pareto_front():
            if self.fit:
                node, loss = self.fit(member.tree) if T.is_pointwise(member.tree) and T.constants(member.tree) else (member.tree, member.loss)
            elif self.config.method == "slopes" and T.is_pointwise(member.tree) and self.y.ndim == 1:
                node, loss = gradients.fit_constants(member.tree, self.env, self.y, self.config.polish_steps, self.config.share)
            else:
                node, loss = optimise_constants(member.tree, self.loss, self.config.polish_steps, "simplex" if self.config.method == "slopes" else self.config.method)
            whole = (lambda t: self.score([t])[0]) if self.fit else self.loss
            if self.config.snap and math.isfinite(loss) and T.constants(node):
                node, loss = snap_constants(node, whole)
            if (neat := simplify(node)) != node:
                node, loss = neat, whole(neat)
            if self.accept(node):
                self.hall.update(Candidate(node, loss, T.complexity(node), self.judge(node, loss) + self.config.parsimony * T.complexity(node), generation))
        if self.extend and (top := self.hall.top()):
            longer = simplify(self.extend(top.tree))
            if longer != top.tree and is_valid(longer, set(self.g.features)):
                self._scored([longer], generation)


def random_search(grammar: Grammar, env: dict[str, np.ndarray], y: np.ndarray, trees: int = 2000, seed: int = 0, spark: SparkSession | None = None, depth: int = 4) -> list[Candidate]:
    found = [simplify(grammar.tree(random.Random(f"{seed}/{i}"), depth)) for i in range(trees)]
    losses = losses_by_candidate(spark, found, env, y) if spark else [score_arrays(t, env, y) for t in found]
    hall = HallOfFame()
    hall.update_many(Candidate(t, v, T.complexity(t), v) for t, v in zip(found, losses, strict=True))
    return hall.pareto_front()


def anneal(grammar: Grammar, env: dict[str, np.ndarray], y: np.ndarray, steps: int = 2000, restarts: int = 4, hot: float = 1.0, cold: float = 1e-3, parsimony: float = 0.005, patience: int = 500, seed: int = 0, spark: SparkSession | None = None) -> list[Candidate]:
    """Metropolis walks with falling temperature, one a restart; all that they visit feeds one hall. Restarts are rows, where there is a session."""

    def walk(restart: int) -> list[Candidate]:
        rng, hall = random.Random(f"{seed + 1000 * restart}"), HallOfFame()
        scale = float(np.nanvar(y)) or 1.0

        def scored(t: Node) -> Candidate:
            v = score_arrays(t, env, y)
            return Candidate(t, v, T.complexity(t), v / scale + parsimony * T.complexity(t))

        now = scored(grammar.tree(rng))
        hall.update(now)
        idle = 0
        for i in range(steps):
            heat = hot * (cold / hot) ** (i / max(1, steps - 1))
            new = scored(simplify(mutate(now.tree, grammar, rng)))
            gain = new.fitness - now.fitness
            idle = 0 if hall.update(new) else idle + 1
            if gain <= 0 or math.isfinite(gain) and rng.random() < math.exp(-gain / heat):
                now = new
            if idle >= patience:
                break
        return hall.candidates()

    hall = HallOfFame()
    if spark is None:
        for r in range(restarts):
            hall.update_many(walk(r))
        return hall.pareto_front()
    import pickle

    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"found": [pickle.dumps(walk(int(r))) for r in pdf["id"]]})

    for row in spark.range(restarts).repartition(restarts).mapInPandas(run, "found binary").collect():
        hall.update_many(pickle.loads(row[0]))
    return hall.pareto_front()
