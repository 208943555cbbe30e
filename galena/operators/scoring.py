"""Losses as aggregates, Pareto fronts, halls of fame, and scoring of whole populations.

A population is scored in one of two ways. By data: one pass over rows of any number for all candidates, whose measures and
reductions are columns first. By candidate: the table, whose size is checked, goes to every task, and trees
travel as rows. Both give the same losses.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.functions.pointwise import finite
from galena.operators import tree as T
from galena.operators.lowering import MeasureCache, Series, compiled, evaluate, in_layers
from galena.operators.population import Population, ordered
from galena.operators.tree import Node

#: Candidates of one aggregate.
BATCH = 25
#: A table of up to so many cells may go to every task.
MOST_LOCAL_CELLS = 4_000_000


def _inf(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("inf")))


def mse(p: Column, y: Column) -> Column:
    """The mean square error of rows where both are finite; infinite where there are none."""
    return _inf(F.avg(F.when(finite(p) & finite(y), (p - y) * (p - y))))


def valid_rows(p: Column) -> Column:
    return F.count(F.when(finite(p), F.lit(1)))


def guarded(loss: Column, p: Column, share: float = 0.9) -> Column:
    """The loss, infinite unless enough predictions are finite: two, and the share of all rows."""
    return F.when(valid_rows(p) >= F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * F.lit(share))), loss).otherwise(F.lit(float("inf")))


def pnl_hard(df: DataFrame, p: str, y: str, series: Series, fee: float = 0.003) -> DataFrame:
    """One row (loss): gains of a position tanh(100 p) and a fee for each change of the prediction's sign."""
    good = finite(F.col(p)) & finite(F.col(y))
    rows = df.select(F.when(good, F.col(p)).otherwise(0.0).alias("p"), F.when(good, F.col(y)).otherwise(0.0).alias("y"), *series.keys, *series.order)
    turned = rows.withColumn("turn", F.abs(F.signum("p") - F.lag(F.signum("p")).over(series.window())))
    return turned.agg((-F.avg(F.tanh(100 * F.col("p")) * F.col("y")) + fee * F.coalesce(F.sum("turn"), F.lit(0.0)) / (2 * F.count(F.lit(1)))).alias("loss"))


def pnl_smooth(df: DataFrame, p: str, y: str, series: Series, beta: float = 1.0, weight_position: float = 0.0, weight_flip: float = 0.0) -> DataFrame:
    """One row (loss): as pnl_hard, but smooth in p; positions away from +-1 and changes of position cost."""
    good = finite(F.col(p)) & finite(F.col(y))
    rows = df.select(F.when(good, F.col(p)).otherwise(0.0).alias("p"), F.when(good, F.col(y)).otherwise(0.0).alias("y"), *series.keys, *series.order)
    held = rows.withColumn("s", F.tanh(beta * F.col("p")))
    moved = held.withColumn("d", F.col("s") - F.lag("s").over(series.window()))
    away = F.col("s") * F.col("s") - 1
    return moved.agg((-F.avg(F.col("s") * F.col("y")) + weight_position * F.avg(away * away) + weight_flip * F.coalesce(F.avg(F.col("d") * F.col("d")), F.lit(0.0))).alias("loss"))


@dataclass(frozen=True)
class Candidate:
    tree: Node
    loss: float
    complexity: int
    fitness: float
    born: int = 0


def pareto_front(found: Iterable[Candidate]) -> list[Candidate]:
    """By rising complexity, those of strictly less loss than every simpler one."""
    out: list[Candidate] = []
    for c in sorted(found, key=lambda c: (c.complexity, c.loss, T.key(c.tree))):
        if math.isfinite(c.loss) and (not out or c.loss < out[-1].loss):
            out.append(c)
    return out


def pareto_rows(df: DataFrame, complexity: str = "complexity", loss: str = "loss") -> DataFrame:
    """Of rows, those on the front, with all ties of a complexity; losses that are not finite are not on it.

    Losses are computed once: sums of doubles differ in their last bits from one evaluation to the next, so a join of df with its own least
    losses would miss rows. The window without keys runs over the best of each complexity alone: a few rows, however many candidates.
    """
    rank = F.rank().over(Window.partitionBy(complexity).orderBy(loss))
    least = df.where(finite(F.col(loss))).withColumn("__rank", rank).where("__rank = 1")
    # up to here, ties in the loss to the simplest
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(complexity).alias("cx"))).over(Window.orderBy(complexity))
    return least.withColumn("__best", best).where(F.col("__best.cx") == F.col(complexity)).drop("__rank", "__best")


class HallOfFame:
    """The best candidate ever of each complexity."""

    def __init__(self, tolerance: float = 1e-12) -> None:
        self.best: dict[int, Candidate] = {}
        self.tolerance = tolerance

    def update(self, c: Candidate) -> bool:
        held = self.best.get(c.complexity)
        if math.isfinite(c.loss) and (held is None or c.loss < held.loss - self.tolerance):
            self.best[c.complexity] = c
            return True
        return False

    def update_many(self, found: Iterable[Candidate]) -> int:
        return sum(self.update(c) for c in found)

    def merge(self, other: HallOfFame) -> int:
        return self.update_many(other.best.values())

    def candidates(self) -> list[Candidate]:
        return [self.best[k] for k in sorted(self.best)]

    def top(self) -> Candidate | None:
        return min(self.best.values(), key=lambda c: (c.loss, c.complexity), default=None)

    def pareto_front(self) -> list[Candidate]:
        return pareto_front(self.best.values())


def merge_halls(halls: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables (tree, complexity, loss) as one with the least loss of each complexity, ties to the first name."""
    both = halls.unionByName(more)
    return both.groupBy("complexity").agg(F.min_by(F.struct("tree", "loss"), F.struct("loss", "tree")).alias("b")).select("b.tree", "complexity", "b.loss")


Loss = Callable[[Column, Column], Column]


def losses_by_data(df: DataFrame, trees: list[Node], y: str, series: Series | None = None, fill: float | None = 0.0, loss: Loss = mse, share: float = 0.9) -> list[float]:
    """One loss for each tree over all rows of df. Measures and reductions that trees share, up to the order of commutative operands, are one column.

    Mean square errors: one pass over the rows, in which every task runs the population as one program over Arrow batches and adds up four
    numbers a tree. Other losses: an aggregate for each BATCH trees.
    """
    c, flat = compiled(df, [ordered(t) for t in trees], series, fill)
    needed = sorted(set().union(*map(T.used_features, flat)))
    rows = (c.df if c.own is None else c.df.where(c.own)).select(F.col(f"`{y}`").cast("double").alias("__y"), *[F.col(f"`{n}`").cast("double").alias(n) for n in needed])
    if loss is mse:
        return _square_errors(rows, flat, needed, share)
    out: list[float] = []
    for at in range(0, len(flat), BATCH):
        laid, columns = in_layers(rows, flat[at : at + BATCH], ["__y", *needed])
        made = laid.select("__y", *[p.alias(f"__p{i}") for i, p in enumerate(columns)])
        row = made.agg(*[guarded(loss(F.col(f"__p{i}"), F.col("__y")), F.col(f"__p{i}"), share).alias(f"l{i}") for i in range(len(columns))]).first()
        out += [float(v) if v is not None and not math.isnan(v) else math.inf for v in row]
    return out


def _square_errors(rows: DataFrame, trees: list[Node], names: list[str], share: float, stack: bool = True) -> list[float]:
    """The guarded mean square errors of pointwise trees over rows (__y, names): one program for all, which every task runs over its batches."""
    population = Population(trees, stack)

    def run(batches):
        sums = np.zeros((len(trees), 4))
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)]
            for at in range(0, batch.num_rows, population.rows):
                y, *columns = (v[at : at + population.rows] for v in values)
                known = np.isfinite(y)
                every = known.all()
                for places, p in population.run(dict(zip(names, columns, strict=True))):
                    gap = np.broadcast_to(p - y, (len(places), len(y)))
                    squares = np.einsum("ij,ij->i", gap, gap)
                    for k, (row, e) in enumerate(zip(places, squares.tolist(), strict=True)):
                        if every and math.isfinite(e):
                            sums[row] += len(y), len(y), len(y), e
                            continue
                        fine = np.isfinite(np.broadcast_to(p[k] if np.ndim(p) == 2 else p, y.shape))
                        left = gap[k][fine & known]
                        sums[row] += len(y), fine.sum(), len(left), left @ left
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees))), *(pa.array(x) for x in sums.T)], ["i", "n", "fine", "good", "e"])

    found = rows.mapInArrow(run, "i long, n double, fine double, good double, e double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("fine").alias("fine"), F.sum("good").alias("good"), F.sum("e").alias("e"))
    losses = [math.inf] * len(trees)
    for r in found.collect():  # a row a tree
        if r["fine"] >= max(2, math.floor(r["n"] * share)) and r["good"] and not math.isnan(r["e"]):
            losses[r["i"]] = r["e"] / r["good"]
    return losses


def score_arrays(tree: Node, env: dict[str, np.ndarray], y: np.ndarray, fill: float = 0.0, share: float = 0.9, memo: dict | None = None) -> float:
    """The guarded mean square error in memory."""
    try:
        p = np.broadcast_to(np.asarray(T.evaluate(tree, env, fill, memo), float), y.shape)
    except (ValueError, KeyError):
        return math.inf
    good = np.isfinite(p)
    if good.sum() < max(2, int(share * p.size)):
        return math.inf
    good &= np.isfinite(y)
    return float(np.mean((p[good] - y[good]) ** 2)) if good.any() else math.inf


def losses_by_candidate(spark: SparkSession, trees: list[Node], env: dict[str, np.ndarray], y: np.ndarray, fill: float = 0.0, share: float = 0.9, parts: int | None = None) -> list[float]:
    """One loss for each tree; the arrays are broadcast (their size is checked), trees are dealt out as rows."""
    if (len(env) + 1) * y.size > MOST_LOCAL_CELLS:
        raise ValueError("too many cells for every task; score by data")
    data = spark.sparkContext.broadcast((env, y))

    def run(batches):
        import pickle

        arrays, target = data.value
        memo: dict = {}
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "loss": [score_arrays(pickle.loads(b), arrays, target, fill, share, memo) for b in pdf["tree"]]})

    import pickle

    rows = spark.createDataFrame([(i, bytearray(pickle.dumps(t))) for i, t in enumerate(trees)], "i long, tree binary")
    found = dict(rows.repartition(parts or spark.sparkContext.defaultParallelism, "i").mapInPandas(run, "i long, loss double").collect())
    return [found[i] for i in range(len(trees))]


class DataScorer:
    """Losses of lists of trees over all rows of one table, list after list, as a search asks for them.

    Trees are compared in canonical order: one that was scored before, in any order of commutative operands, is not scored again (of the last `most` of them), and
    measures of earlier lists are columns that are kept (lowering.MeasureCache). asked, scored and columns count trees and columns made.
    """

    def __init__(self, df: DataFrame, y: str, series: Series | None = None, fill: float | None = 0.0, share: float = 0.9, most: int = 100_000, columns: int = 64) -> None:
        self.cache = MeasureCache(df, series, fill, threshold=2, most=columns)
        self.y, self.series, self.fill, self.share, self.most = y, series, fill, share, most
        self.known: dict[Node, float] = {}
        self.asked = self.scored = 0

    @property
    def columns(self) -> int:
        return self.cache.made

    def __call__(self, trees: list[Node]) -> list[float]:
        trees = [ordered(t) for t in trees]
        new = [t for t in dict.fromkeys(trees) if t not in self.known]
        self.asked, self.scored = self.asked + len(trees), self.scored + len(new)
        out = {t: self.known[t] for t in trees if t in self.known}
        if new:
            rows, short = self.cache.rewrite(new)
            out |= zip(new, losses_by_data(rows, short, self.y, self.series, self.fill, share=self.share), strict=True)
        self.known = dict([*((t, v) for t, v in self.known.items() if t not in out), *out.items()][-self.most :])
        return [out[t] for t in trees]

    def close(self) -> None:
        self.cache.close()


def population_table(df: DataFrame, trees: dict[str, Node], y: str, series: Series | None = None, fill: float | None = None, loss: Loss = mse) -> DataFrame:
    """(tree, complexity, loss) of each named tree, from one aggregate."""
    made = evaluate(df, {f"p{i}": t for i, t in enumerate(trees.values())}, series, fill)
    row = made.agg(*[loss(F.col(f"p{i}"), F.col(y)).alias(f"p{i}") for i in range(len(trees))])
    each = ", ".join(f"'{name}', {T.complexity(t)}, p{i}" for i, (name, t) in enumerate(trees.items()))
    return row.selectExpr(f"stack({len(trees)}, {each}) as (tree, complexity, loss)")
