"""Terms for a formula, chosen over all rows of a table of any length.

A dictionary of trees is evaluated inside the tasks, as one program over Arrow batches; what leaves them are sums. A first pass tells which columns
are finite, vary and differ, a second one how each goes with the target. From then on subsets of columns are grown on their Gram matrix, of
which only the tiles of chosen columns are ever made: adding a term extends a Cholesky factor by a row and updates what every other
column has left beside the chosen ones, so each candidate's exact gain is known without a fit; taking one away turns the factor back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions.pointwise import finite
from galena.operators import tree as T
from galena.operators.enumeration import Discovery, DiscoveryConfig, enumerate_trees
from galena.operators.lowering import pointwise
from galena.operators.population import Population
from galena.operators.regression import ols, weighted_sum
from galena.operators.tree import Const, Node

#: Columns of the Gram matrix that one pass makes.
TILE = 16
#: Beside the chosen columns, less than this share of a column's squares counts as nothing.
COLLINEAR = 1e-9


def _rows(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """(__y, __h, names): the rows where all are finite; __h spreads equal values alike over 64 bits."""
    columns = {n: F.col(f"`{n}`").cast("double") for n in names}
    good = finite(F.col(f"`{y}`").cast("double"))
    for c in columns.values():
        good = good & finite(c)
    return df.where(good).select(F.col(f"`{y}`").cast("double").alias("__y"), F.xxhash64(*columns.values(), F.col(f"`{y}`")).alias("__h"), *[c.alias(n) for n, c in columns.items()])


def _batches(batches, names: list[str], size: int):
    """(target, weights of the rows, columns by name), in steps of `size` rows."""
    for batch in batches:
        y, h, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + len(names)))
        for at in range(0, len(y), size):
            yield y[at : at + size], h[at : at + size], dict(zip(names, (c[at : at + size] for c in columns), strict=True))


def _uniform(h: np.ndarray, k: int) -> np.ndarray:
    """Numbers from -1 to 1, others for every k."""
    h = (h.view(np.uint64) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(29)).astype(np.float64) / 2.0**63 - 1


@dataclass
class Columns:
    """The trees that stand for columns worth having, with each column's mean and greatest size; n rows."""

    trees: list[Node]
    means: np.ndarray
    peaks: np.ndarray
    n: int
    y_mean: float
    y_peak: float


def survey(rows: DataFrame, names: list[str], trees: list[Node], most: float = 1e12) -> Columns:
    """One pass: of the trees, those whose columns are finite on all rows, vary and differ; the first of equals stays.

    Columns are equal that have equal sums under two sets of weights of the rows, to nine digits of their scale. Each task sends six numbers a tree.
    """
    made = Population(trees, stack=False)

    def run(batches):
        out = np.zeros((len(trees) + 1, 6))
        for y, h, env in _batches(batches, names, made.rows):
            weights = np.stack([np.ones(len(y)), _uniform(h, 1), _uniform(h, 2)])
            out[-1] += len(y), 0, y.sum(), 0, 0, 0
            out[-1, 5] = max(out[-1, 5], np.abs(y).max(initial=0))
            for (places,), v in made.run(env):
                v = np.broadcast_to(v, y.shape)
                peak = float(np.abs(v).max(initial=0))
                if not peak < most:
                    out[places, 1] += 1
                    continue
                sums = weights @ v
                spread = float(v.max() - v.min()) if len(v) else 0.0
                for i in places:
                    out[i, 0] = max(out[i, 0], spread)
                    out[i, 2:5] += sums
                    out[i, 5] = max(out[i, 5], peak)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *(pa.array(c) for c in out.T)], ["i", "spread", "bad", "sum", "u", "v", "peak"])

    found = rows.mapInArrow(run, "i int, spread double, bad double, sum double, u double, v double, peak double").groupBy("i")
    found = found.agg(F.max("spread"), F.sum("bad"), F.sum("sum"), F.sum("u"), F.sum("v"), F.max("peak"), F.sum("spread"), F.min("sum"), F.max("sum"))
    table = {r[0]: r[1:] for r in found.collect()}  # a row a tree
    if len(trees) not in table:
        return Columns([], np.zeros(0), np.zeros(0), 0, 0.0, 1.0)
    last = table.pop(len(trees))
    n = int(last[6])  # the target's row holds counts in place of spreads
    kept, seen = [], set()
    for i in sorted(table):
        spread, bad, total, u, v, peak, *_ = table[i]
        if bad or not peak or not n:
            continue
        scale = peak * n**0.5
        mark = tuple(round(x, 9) for x in (total / (peak * n), u / scale, v / scale))
        # a column may be level within every task and still vary between them: then its mean is not its peak
        if (spread > 1e-9 * max(1.0, peak) or abs(abs(total / n) - peak) > 1e-9 * max(1.0, peak)) and mark not in seen:
            seen.add(mark)
            kept.append(i)
    return Columns([trees[i] for i in kept], np.array([table[i][2] / n for i in kept]), np.array([table[i][5] for i in kept]), n, last[2] / n if n else 0.0, last[5] or 1.0)


class Gram:
    """Products of centred, scaled columns, over all rows: with the target, of each with itself, and of all with the columns asked for."""

    def __init__(self, rows: DataFrame, names: list[str], columns: Columns) -> None:
        self.rows, self.names, self.columns = rows, names, columns
        self.population = Population(columns.trees, stack=False)
        self.made: dict[int, np.ndarray] = {}
        self.passes = 0
        found = self._pass([])
        self.target, self.squares = found[:-1, 0], found[:-1, 1]
        self.total = float(found[-1, 0])

    def _pass(self, wanted: list[int]) -> np.ndarray:
        """For each column, and the target last: its products with `wanted`, or with the target and with itself."""
        self.passes += 1
        c, names, made = self.columns, self.names, self.population
        some = Population([c.trees[i] for i in wanted], stack=False) if wanted else None
        width = len(wanted) or 2

        def run(batches):
            out = np.zeros((len(c.trees) + 1, width))
            for y, _, env in _batches(batches, names, made.rows):
                target = (y - c.y_mean) / c.y_peak
                right = ((some.predictions(env) - c.means[wanted][:, None]) / c.peaks[wanted][:, None]).T if some else target[:, None]
                out[-1] += target @ right
                for (places,), v in made.run(env):
                    for i in places:
                        z = (np.broadcast_to(v, y.shape) - c.means[i]) / c.peaks[i]
                        if some:
                            out[i] += z @ right
                        else:
                            out[i] += z @ target, z @ z
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *(pa.array(x) for x in out.T)], ["i", *[f"c{k}" for k in range(width)]])

        sums = self.rows.mapInArrow(run, ", ".join(["i int", *[f"c{k} double" for k in range(width)]])).groupBy("i").agg(*[F.sum(f"c{k}") for k in range(width)])
        out = np.zeros((len(c.trees) + 1, width))
        for i, *values in sums.collect():  # a row a tree
            out[i] = values
        return out

    def need(self, wanted: list[int]) -> None:
        """Makes these columns, TILE a pass."""
        new = [i for i in dict.fromkeys(wanted) if i not in self.made]
        for at in range(0, len(new), TILE):
            some = new[at : at + TILE]
            found = self._pass(some)
            for k, i in enumerate(some):
                self.made[i] = found[:-1, k]


class Subset:
    """Chosen columns with the Cholesky factor L of their products; rows of u are what L makes of their products with all columns, w of those with the target."""

    def __init__(self, gram: Gram, chosen: tuple[int, ...] = (), u: np.ndarray | None = None, w: np.ndarray | None = None) -> None:
        self.gram, self.chosen = gram, chosen
        self.u = np.zeros((0, len(gram.squares))) if u is None else u
        self.w = np.zeros(0) if w is None else w

    @property
    def explained(self) -> float:
        return float(self.w @ self.w)

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """(squares, product with the target) of what each column has beside the chosen ones; squares are 0 where that is nothing."""
        g = self.gram
        squares = g.squares - (self.u * self.u).sum(0)
        squares[squares <= COLLINEAR * g.squares] = 0
        return squares, g.target - self.w @ self.u

    def gains(self) -> np.ndarray:
        """How much each column would add to what is explained."""
        squares, product = self.left()
        return np.divide(product * product, squares, out=np.zeros(len(squares)), where=squares > 0)

    def plus(self, i: int) -> Subset:
        """The factor extended by a row; the column must have been made."""
        squares, product = self.left()
        root = squares[i] ** 0.5
        row = (self.gram.made[i] - self.u[:, i] @ self.u) / root
        return Subset(self.gram, (*self.chosen, i), np.vstack([self.u, row]), np.append(self.w, product[i] / root))

    def minus(self, k: int) -> Subset:
        """Without the k-th chosen column: its row leaves L, and turns of neighbouring rows make L triangular again."""
        chosen = self.chosen[:k] + self.chosen[k + 1 :]
        u, w = self.u.copy(), self.w.copy()
        for j in range(k, len(chosen)):
            a, b = u[j, chosen[j]], u[j + 1, chosen[j]]
            r = (a * a + b * b) ** 0.5 or 1.0
            turn = np.array([[a, b], [-b, a]]) / r
            u[j : j + 2], w[j : j + 2] = turn @ u[j : j + 2], turn @ w[j : j + 2]
        return Subset(self.gram, chosen, u[:-1], w[:-1])


def choose(gram: Gram, config: DiscoveryConfig) -> Subset:
    """Subsets grown by the column with the most gain, the best `beam` of them kept; a term that others have made needless is dropped again."""
    sizes = np.array([T.complexity(t) for t in gram.columns.trees])
    beam, best = [Subset(gram)], Subset(gram)
    width, top = (1, 1) if config.greedy else (config.beam, config.top)
    rank = lambda s: (-round(s.explained / gram.total, 12), len(s.chosen), int(sizes[list(s.chosen)].sum()), s.chosen)
    while gram.total > 0 and len(beam[0].chosen) < config.max_terms:
        tried: dict[tuple[int, ...], tuple[float, Subset, int]] = {}
        for s in beam:
            gains = s.gains()
            rest = max(gram.total - s.explained, 1e-300)
            score = np.sqrt(gains / rest) - config.parsimony * sizes
            score[list(s.chosen)] = -np.inf
            score[gains <= 0] = -np.inf
            for i in np.argsort(-score, kind="stable")[:top].tolist():
                new = tuple(sorted((*s.chosen, i)))
                if np.isfinite(score[i]) and new not in tried:
                    tried[new] = (s.explained + gains[i], s, i)
        order = sorted(tried, key=lambda c: (-round(tried[c][0] / gram.total, 12), int(sizes[list(c)].sum()), c))[:width]
        if not order:
            break
        gram.need([tried[c][2] for c in order])
        beam = [tried[c][1].plus(tried[c][2]) for c in order]
        for s in list(beam):
            for k in range(len(s.chosen) - 1):
                less = s.minus(k)
                if s.explained - less.explained <= 1e-9 * gram.total:
                    beam.append(less)
        beam = sorted({tuple(sorted(s.chosen)): s for s in sorted(beam, key=rank, reverse=True)}.values(), key=rank)[:width]
        if beam[0].explained <= best.explained + 1e-9 * gram.total:
            break
        best = beam[0]
        if best.explained >= (1 - 1e-12) * gram.total:
            break
    return best


def discover_by_data(df: DataFrame, names: list[str], y: str, config: DiscoveryConfig | None = None) -> Discovery:
    """A sum of few trees of the dictionary that explains the column y, over all rows where y and the variables are finite.

    Two passes and one for each term choose the terms; weights are then fitted at machine precision by regression.ols. No column leaves the tasks: a pass brings a
    few numbers for each tree of the dictionary to the driver. Without rows, or where y does not vary, the mean alone.
    """
    config = config or DiscoveryConfig()
    rows = _rows(df, names, y)
    columns = survey(rows, names, enumerate_trees(names, config))
    if not columns.n:
        return Discovery(Const(0.0), 0.0)
    mean = Discovery(Const(columns.y_mean), 0.0, [], columns.y_mean)
    if not columns.trees:
        return mean
    chosen = choose(Gram(rows, names, columns), config).chosen
    if not chosen:
        return mean
    trees = [columns.trees[i] for i in chosen]
    fit = ols(rows, {f"t{k}": pointwise(t) for k, t in enumerate(trees)}, F.col("__y"))
    weights = [float(fit[f"t{k}"]) for k in range(len(trees))]
    constant = float(fit["1"]) if abs(fit["1"]) > 1e-9 * columns.y_peak else 0.0
    terms = list(zip(weights, trees, strict=True))
    return Discovery(weighted_sum(terms, constant), float(fit.r2), terms, constant)


__all__ = ["Columns", "Gram", "Subset", "choose", "discover_by_data", "survey"]
