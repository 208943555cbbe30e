"""Other ways to judge a formula: hold-out rows, summary statistics, description length, perturbed data sets, adaptive operator weights."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions.pointwise import UNARY
from galena.operators import tree as T
from galena.operators.axes import mixes_time_and_space
from galena.operators.lowering import Series, evaluate
from galena.operators.scoring import Candidate, mse, score_arrays
from galena.operators.tree import Node, UnOp


def summary_statistics(df: DataFrame, value: str, series: Series) -> DataFrame:
    """One row of six numbers of a long field: variance, mean size, lag-one correlation in time and space, variances of row and column means."""
    from pyspark.sql import Window

    t, x = series.order[0], series.space
    over_t, over_x = Window.partitionBy(x).orderBy(t), Window.partitionBy(t).orderBy(x)
    v = F.col(value)
    rows = df.select(t, x, v.alias("v"), F.lag(v).over(over_t).alias("vt"), F.lag(v).over(over_x).alias("vx"))
    base = rows.agg(F.var_pop("v").alias("variance"), F.avg(F.abs("v")).alias("size"), F.corr("v", "vt").alias("corr_t"), F.corr("v", "vx").alias("corr_x"))
    by_t = df.groupBy(t).agg(F.avg(v).alias("m")).agg(F.var_pop("m").alias("var_rows"))
    by_x = df.groupBy(x).agg(F.avg(v).alias("m")).agg(F.var_pop("m").alias("var_columns"))
    return base.join(F.broadcast(by_t)).join(F.broadcast(by_x))


def statistics_distance(a: dict[str, float], b: dict[str, float]) -> float:
    """The mean relative difference."""
    return sum(abs(a[k] - b[k]) / (abs(a[k]) + abs(b[k]) + 1e-12) for k in a) / max(1, len(a))


def with_holdout(train_loss: float, tree: Node, env: dict[str, np.ndarray], y: np.ndarray, weight: float = 1.0) -> float:
    """The training loss plus a weighted loss on rows kept out of the search."""
    return train_loss + weight * score_arrays(tree, env, y)


def description_bits(tree: Node, features: int) -> float:
    """Bits to name a tree: each node's kind and what it chooses from, and 32 a constant."""
    bits = 0.0
    for n in T.subtrees(tree):
        bits += math.log2(4)
        if isinstance(n, T.Var):
            bits += math.log2(max(2, features))
        elif isinstance(n, T.Const):
            bits += 32
        elif isinstance(n, T.BinOp):
            bits += math.log2(12)
        elif isinstance(n, T.UnOp):
            bits += math.log2(16)
        else:
            bits += 64
    return bits


def mdl_fitness(loss: float, tree: Node, features: int, n: int, noise: float = 1.0, root: bool = False) -> float:
    """loss / 2 sigma^2 + description length / n (or / sqrt n)."""
    return loss / (2 * noise**2) + description_bits(tree, features) / (math.sqrt(n) if root else n)


def holdout_judge(env: dict[str, np.ndarray], y: np.ndarray, weight: float = 1.0, statistics: float = 0.0) -> Callable[[Node, float], float]:
    """For Evolution: the loss, plus weighted the loss on held-out rows, plus (of fields [t, x]) the distance of six summary numbers of prediction and target."""
    from galena.operators.tree import evaluate as values

    asked = field_statistics(y) if statistics else {}

    def judge(tree: Node, loss: float) -> float:
        out = with_holdout(loss, tree, env, y, weight)
        if statistics and math.isfinite(out):
            out += statistics * statistics_distance(field_statistics(np.broadcast_to(np.asarray(values(tree, env, 0.0), float), y.shape)), asked)
        return out

    return judge


def field_statistics(u: np.ndarray) -> dict[str, float]:
    """The numbers of summary_statistics of a field [t, x] in memory."""

    def corr(a: np.ndarray, b: np.ndarray) -> float:
        a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
        size = math.sqrt(float(a @ a) * float(b @ b))
        return float(a @ b) / size if size else 0.0

    return {"variance": float(u.var()), "size": float(np.abs(u).mean()), "corr_t": corr(u[1:], u[:-1]), "corr_x": corr(u[:, 1:], u[:, :-1]), "var_rows": float(u.mean(1).var()), "var_columns": float(u.mean(0).var())}


def mdl_judge(features: int, n: int, noise: float = 1.0, root: bool = False) -> Callable[[Node, float], float]:
    """For Evolution: description length beside the loss; parsimony is then best 0."""
    return lambda tree, loss: mdl_fitness(loss, tree, features, n, noise, root)


def causal(tree: Node) -> bool:
    """For Evolution: no measure looks back in time and aside at once."""
    return mixes_time_and_space(tree) == 0


def operator_weights(front: list[Candidate], base: float = 1.0, gain: float = 2.0) -> dict[str, float]:
    """Weights of unary operators by how the front uses them."""
    used = Counter(n.op for c in front for n in T.subtrees(c.tree) if isinstance(n, UnOp) and n.op in UNARY)
    return {op: base + gain * used[op] / max(1, len(front)) for op in UNARY}


@dataclass
class Counterfactual:
    name: str
    field: np.ndarray  # [t, x]
    target: np.ndarray
    oracle: float  # the loss of the true rule on it


def heat_field(alpha: float, t: int, x: int, start: np.ndarray | None = None, noise: float = 0.0, seed: int = 0) -> np.ndarray:
    u = np.zeros((t, x))
    u[0] = start if start is not None else 10 * (np.exp(-0.5 * ((np.arange(x) - x / 3) / 3) ** 2) + np.exp(-0.5 * ((np.arange(x) - 2 * x / 3) / 4) ** 2))
    for k in range(1, t):
        u[k] = u[k - 1]
        u[k, 1:-1] += alpha * (u[k - 1, 2:] - 2 * u[k - 1, 1:-1] + u[k - 1, :-2])
    return u + noise * np.random.default_rng(seed).standard_normal(u.shape)


def counterfactuals(alpha: float = 0.05, t: int = 200, x: int = 32, noise: float = 0.002, seed: int = 0) -> list[Counterfactual]:
    """Five data sets that the rule should survive: two other beginnings, twice the rate, ten times the noise, half the width."""
    rng = np.random.default_rng(seed)
    cases = {
        "spike": heat_field(alpha, t, x, np.where(np.arange(x) == x // 2, 10.0, 0.0), noise, seed + 1), "random": heat_field(alpha, t, x, 5 * rng.standard_normal(x), noise, seed + 2),
        "rate": heat_field(2 * alpha, t, x, None, noise, seed + 3), "noise": heat_field(alpha, t, x, None, 10 * noise, seed + 4), "narrow": heat_field(alpha, t, x // 2, None, noise, seed + 5),
    }
    out = []
    for name, u in cases.items():
        y, rate = np.diff(u, axis=0), 2 * alpha if name == "rate" else alpha
        rule = rate * (u[:-1, 2:] - 2 * u[:-1, 1:-1] + u[:-1, :-2])
        out.append(Counterfactual(name, u[:-1], y, float(((rule - y[:, 1:-1]) ** 2).mean())))
    return out


def rank_by_counterfactuals(front: list[Candidate], cases: list[Counterfactual], var: str = "U") -> list[tuple[Candidate, float]]:
    """Candidates by the median over cases of their loss in units of the true rule's."""
    scored = [(c, float(np.median([score_arrays(c.tree, {var: k.field}, k.target, share=0.5) / max(k.oracle, 1e-300) for k in cases]))) for c in front]
    return sorted(scored, key=lambda x: (x[1], x[0].complexity))


def losses_by_group(df: DataFrame, trees: dict[str, Node], y: str, group: str, series: Series | None = None) -> DataFrame:
    """(group, tree, loss): a front on many data sets at once, the data set a key of every window and of the aggregate."""
    keyed = Series(series.order, [group, *series.keys], series.space) if series else None
    made = evaluate(df, {f"p{i}": t for i, t in enumerate(trees.values())}, keyed)
    sums = made.groupBy(group).agg(*[mse(F.col(f"p{i}"), F.col(y)).alias(f"p{i}") for i in range(len(trees))])
    each = ", ".join(f"'{n}', p{i}" for i, n in enumerate(trees))
    return sums.selectExpr(group, f"stack({len(trees)}, {each}) as (tree, loss)")
