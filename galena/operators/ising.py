"""Energies of spin systems: evaluation, ground states, sampling, and recovery of couplings."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators import tree as T
from galena.operators.tree import BinOp, Const, Node, Var

if TYPE_CHECKING:
    from galena.operators.scoring import Candidate
    from galena.operators.search import SearchConfig


@dataclass
class Ising:
    """H(s) = -1/2 s J s - h s for spins of -1 and 1; J symmetric with a zero diagonal."""

    j: np.ndarray
    h: np.ndarray

    def energy(self, s: np.ndarray) -> np.ndarray:
        s = np.atleast_2d(s)
        return -0.5 * np.einsum("ri,ij,rj->r", s, self.j, s) - s @ self.h


def random_ising(n: int, density: float = 0.5, seed: int = 0, field: float = 0.0) -> Ising:
    rng = np.random.default_rng(seed)
    j = np.triu(rng.standard_normal((n, n)) * (rng.random((n, n)) < density), 1)
    return Ising(j + j.T, field * rng.standard_normal(n))


def energy_column(system: Ising, spins: list[str]) -> Column:
    """The energy of a row of spin columns as one expression."""
    out = F.lit(0.0)
    for a, b in itertools.combinations(range(len(spins)), 2):
        if system.j[a, b]:
            out = out - F.lit(float(system.j[a, b])) * F.col(spins[a]) * F.col(spins[b])
    for i, name in enumerate(spins):
        if system.h[i]:
            out = out - F.lit(float(system.h[i])) * F.col(name)
    return out


def all_states(spark: SparkSession, n: int) -> DataFrame:
    """(state long, s0 ... s{n-1}) of all 2**n states, generated on the executors."""
    bit = lambda i: F.shiftright("id", i).bitwiseAND(1)
    return spark.range(1 << n).select(F.col("id").alias("state"), *[(bit(i) * 2 - 1).cast("double").alias(f"s{i}") for i in range(n)])


def ground_state(spark: SparkSession, system: Ising) -> tuple[int, float]:
    """(state, energy) of the least energy, ties to the smaller number, by one aggregate over all states."""
    n = len(system.h)
    row = all_states(spark, n).select("state", energy_column(system, [f"s{i}" for i in range(n)]).alias("e")).agg(F.min_by("state", F.struct("e", "state")).alias("state"), F.min("e").alias("e")).first()
    return row["state"], row["e"]


def gibbs(system: Ising, beta: float, chains: int, sweeps: int, seed: int = 0) -> np.ndarray:
    """The chains' states after the sweeps, each spin drawn in turn given the others."""
    rng, n = np.random.default_rng(seed), len(system.h)
    s = rng.choice((-1.0, 1.0), (chains, n))
    for _ in range(sweeps):
        for i in range(n):
            up = 1 / (1 + np.exp(-2 * beta * (s @ system.j[i] + system.h[i])))
            s[:, i] = np.where(rng.random(chains) < up, 1.0, -1.0)
    return s


Terms = dict[tuple[int, ...], float]
LOCAL_PATTERNS = 1 << 14  # spin patterns whose sums need no job


def monomial_gibbs(terms: Terms, n: int, beta: float, chains: int, sweeps: int, seed: int = 0) -> np.ndarray:
    """As gibbs, for the energy minus the sum of coefficients times products of any number of spins."""
    rng = np.random.default_rng(seed)
    s = rng.choice((-1.0, 1.0), (chains, n))
    others = [[(c, [k for k in t if k != i]) for t, c in terms.items() if i in t] for i in range(n)]
    for _ in range(sweeps):
        for i in range(n):
            local = sum((c * s[:, rest].prod(axis=1) for c, rest in others[i]), np.zeros(chains))
            s[:, i] = np.where(rng.random(chains) < 1 / (1 + np.exp(-2 * beta * local)), 1.0, -1.0)
    return s


def _chains(spark: SparkSession, draw: Callable[[int, int], np.ndarray], n: int, chains: int, per_task: int, seed: int) -> DataFrame:
    tasks = -(-chains // per_task)

    def run(batches):
        for pdf in batches:
            for t in pdf["id"]:
                size = min(per_task, chains - int(t) * per_task)
                s = draw(size, seed * 1_000_003 + int(t))
                yield pd.DataFrame({"chain": np.arange(size) + int(t) * per_task, **{f"s{i}": s[:, i] for i in range(n)}})

    return spark.range(tasks).repartition(tasks).mapInPandas(run, "chain long, " + ", ".join(f"s{i} double" for i in range(n)))


def sample(spark: SparkSession, system: Ising, beta: float, chains: int, sweeps: int = 100, per_task: int = 500, seed: int = 0) -> DataFrame:
    """(chain, s0 ...): chains by rows; a task's chains are seeded by their number, so the samples do not depend on how they are dealt out."""
    return _chains(spark, lambda size, own: gibbs(system, beta, size, sweeps, own), len(system.h), chains, per_task, seed)


def sample_monomials(spark: SparkSession, terms: Terms, n: int, beta: float, chains: int, sweeps: int = 100, per_task: int = 500, seed: int = 0) -> DataFrame:
    """The same for an energy of spin monomials of any order."""
    return _chains(spark, lambda size, own: monomial_gibbs(terms, n, beta, size, sweeps, own), n, chains, per_task, seed)


def bifurcation(system: Ising, replicas: int = 32, steps: int = 400, dt: float = 0.2, seed: int = 0) -> tuple[np.ndarray, float]:
    """Ballistic simulated bifurcation: positions between walls, pumped until they choose a side. The best replica's spins and energy."""
    rng, n = np.random.default_rng(seed), len(system.h)
    x, v = 0.02 * rng.standard_normal((replicas, n)), 0.02 * rng.standard_normal((replicas, n))
    strength = 0.5 * (n - 1) ** 0.5 / (np.sqrt((system.j**2).sum()) + 1e-12)
    for k in range(steps):
        v += dt * (-(1 - k / steps) * x + strength * (x @ system.j + system.h))
        x += dt * v
        out = np.abs(x) > 1
        v[out] = 0
        x = np.clip(x, -1, 1)
    s = np.where(x >= 0, 1.0, -1.0)
    e = system.energy(s)
    return s[e.argmin()], float(e.min())


def couplings_from_energies(df: DataFrame, spins: list[str], energy: str) -> Ising:
    """Least squares of the energy on all spins and pairs, on one factor."""
    from galena.operators.regression import ols

    pairs = list(itertools.combinations(range(len(spins)), 2))
    features = {f"h{i}": F.col(s) for i, s in enumerate(spins)} | {f"j{a}_{b}": F.col(spins[a]) * F.col(spins[b]) for a, b in pairs}
    fit = ols(df, features, F.col(energy))
    j = np.zeros((len(spins), len(spins)))
    for a, b in pairs:
        j[a, b] = j[b, a] = -fit[f"j{a}_{b}"]
    return Ising(j, np.array([-fit[f"h{i}"] for i in range(len(spins))]))


def pseudo_log_likelihood(df: DataFrame, system: Ising, spins: list[str], beta: float = 1.0) -> float:
    """The mean over rows and spins of the log chance of the spin given the others; the partition function cancels."""
    total = F.lit(0.0)
    for i, s in enumerate(spins):
        local = F.lit(float(system.h[i]))
        for k, other in enumerate(spins):
            if system.j[i, k]:
                local = local + F.lit(float(system.j[i, k])) * F.col(other)
        z = F.lit(2.0 * beta) * F.col(s) * local
        total = total - F.when(z > -30, F.log1p(F.exp(-F.greatest(z, F.lit(-30.0))))).otherwise(-z)
    return df.agg(F.avg(total / len(spins))).first()[0]


def patterns(df: DataFrame, spins: list[str]) -> DataFrame:
    """(spins, __w): the distinct rows with how often each occurs, at most 2**n of them, combined before the shuffle."""
    return df.select(*[F.col(s).cast("double").alias(s) for s in spins]).dropna().groupBy(*spins).agg(F.count(F.lit(1)).cast("double").alias("__w"))


def _monomial_sums(s: np.ndarray, w: np.ndarray, tried: list[list[tuple[int, ...]]], at: list[np.ndarray], beta: float) -> list[np.ndarray]:
    """For each list of monomials at its coefficients: [slopes, curvature, log chance] summed over patterns and spins, flat."""
    products: dict[tuple[int, ...], np.ndarray] = {}
    out = []
    for chosen, c in zip(tried, at, strict=True):
        for t in chosen:
            if t not in products:
                flips = np.zeros(s.shape)
                flips[:, list(t)] = 2 * beta * s[:, list(t)].prod(axis=1)[:, None]
                products[t] = flips
        x = np.stack([products[t] for t in chosen], 2)
        z = x @ c
        p = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        weight = w[:, None]
        out.append(np.concatenate([np.einsum("ri,rik->k", weight * p, x), np.einsum("rik,ri,ril->kl", x, weight * p * (1 - p), x).ravel(), [-(weight * np.logaddexp(0, -z)).sum()]]))
    return out


def monomial_energy(df: DataFrame, spins: list[str], order: int = 2, beta: float = 1.0, most: int = 20, steps: int = 60) -> Terms:
    """Couplings of spin monomials by greedy forward selection on the pseudo-likelihood; a monomial stays while it gains half a log N per N n.

    Rows count by distinct patterns first. All monomials of a round are fitted side by side, a pass over the patterns a Newton
    step: each task adds up its patterns' slopes, so nothing that grows with the table reaches the driver. Where the patterns are
    few (LOCAL_PATTERNS), the same sums are made here, without a job a step. Rows with a null are left out; no rows give no terms.
    """
    n = len(spins)
    table = patterns(df, spins).persist()
    many, rows = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("__w"), F.lit(0.0))).first()
    few = table.orderBy(*spins).toPandas() if many <= LOCAL_PATTERNS else None
    terms = [c for k in range(1, order + 1) for c in itertools.combinations(range(n), k)]

    def summed(tried: list[list[tuple[int, ...]]], at: list[np.ndarray]) -> list[np.ndarray]:
        if few is not None:
            return _monomial_sums(few[spins].to_numpy(float), few["__w"].to_numpy(float), tried, at, beta)

        def run(batches):
            total = None
            for pdf in batches:
                if len(pdf):
                    new = _monomial_sums(pdf[spins].to_numpy(float), pdf["__w"].to_numpy(float), tried, at, beta)
                    total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
            if total is not None:
                sizes = [len(t) for t in total]
                yield pd.DataFrame({"t": np.repeat(np.arange(len(total)), sizes), "k": np.concatenate([np.arange(z) for z in sizes]), "v": np.concatenate(total)})

        out = [np.zeros(len(c) + len(c) ** 2 + 1) for c in tried]
        for r in table.mapInPandas(run, "t int, k int, v double").groupBy("t", "k").agg(F.sum("v")).collect():  # a row a statistic of a monomial
            out[r[0]][r[1]] = r[2]
        return out

    def fitted(tried: list[list[tuple[int, ...]]], start: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        at, values, open_, done = list(start), [-math.inf] * len(tried), list(range(len(tried))), set()
        for step in range(steps + 1):
            for i, total in zip(open_, summed([tried[i] for i in open_], [at[i] for i in open_]), strict=True):
                k = len(at[i])
                values[i] = float(total[-1] / (rows * n))
                move = np.linalg.solve(total[k:-1].reshape(k, k) + 1e-6 * rows * np.eye(k), total[:k]) if step < steps else np.zeros(k)
                if np.abs(move).max() < 1e-8:
                    done.add(i)
                else:
                    at[i] = at[i] + move
            open_ = [i for i in open_ if i not in done]
            if not open_:
                break
        return list(zip(at, values, strict=True))

    chosen: list[tuple[int, ...]] = []
    value, coefficients = -math.log(2), np.zeros(0)
    gain = 0.5 * math.log(rows * n) / (rows * n) if rows else math.inf
    while len(chosen) < most and rows:
        left = [t for t in terms if t not in chosen]
        if not left:
            break
        found = fitted([[*chosen, t] for t in left], [np.append(coefficients, 0.0)] * len(left))
        i = max(range(len(left)), key=lambda k: found[k][1])
        if found[i][1] - value < gain:
            break
        chosen.append(left[i])
        coefficients, value = found[i]
    table.unpersist()
    return {t: float(c) for t, c in zip(chosen, coefficients, strict=True)}


# --- energies as trees, and the search for one


def energy_tree(system: Ising, spins: list[str]) -> Node:
    """The energy as a tree on spin columns."""
    from galena.operators.regression import weighted_sum

    pairs = [(-float(system.j[a, b]), BinOp("mul", Var(spins[a]), Var(spins[b]))) for a, b in itertools.combinations(range(len(spins)), 2) if system.j[a, b]]
    return weighted_sum([*pairs, *[(-float(h), Var(s)) for h, s in zip(system.h, spins, strict=True) if h]])


def with_spin(tree: Node, name: str, value: float) -> Node:
    """The tree with one variable at a value."""
    if isinstance(tree, Var):
        return Const(value) if tree.name == name else tree
    return T.with_children(tree, tuple(with_spin(c, name, value) for c in T.children(tree)))


def energy_correlation(df: DataFrame, tree: Node, system: Ising, spins: list[str]) -> float:
    """How a tree's energy goes with the true one over the rows, in one aggregate."""
    from galena.operators.lowering import pointwise

    return df.agg(F.corr(pointwise(tree), energy_column(system, spins))).first()[0]


def _log_chances(trees: list[Node], env: dict[str, np.ndarray], w: np.ndarray, spins: list[str], beta: float) -> np.ndarray:
    """For each tree the sum over patterns and spins of the log chance of the spin given the others; minus infinity where its energy is not a number."""
    out = np.zeros(len(trees))
    for i, tree in enumerate(trees):
        for s in spins:
            if s in T.used_features(tree):
                up, down = (np.broadcast_to(np.asarray(T.evaluate(tree, {**env, s: np.full(len(w), v)}), float), w.shape) for v in (1.0, -1.0))
                z = -beta * (up - down) * env[s]
                out[i] += float(-(w * np.logaddexp(0, -z)).sum()) if np.isfinite(z).all() else -np.inf
            else:
                out[i] -= math.log(2) * w.sum()
    return out


def energy_losses(table: DataFrame, trees: list[Node], spins: list[str], beta: float = 1.0) -> list[float]:
    """Minus the mean log pseudo-likelihood of each pointwise tree as an energy, over rows of `patterns`, in one pass for all."""

    def run(batches):
        total, seen = np.zeros(len(trees)), 0.0
        for pdf in batches:
            w = pdf["__w"].to_numpy(float)
            if len(w):
                total += _log_chances(trees, {s: pdf[s].to_numpy(float) for s in spins}, w, spins, beta)
                seen += w.sum()
        yield pd.DataFrame({"i": np.arange(len(trees)), "v": total, "w": seen})

    found = {r[0]: -r[1] / (r[2] * len(spins)) if r[2] else math.inf for r in table.mapInPandas(run, "i int, v double, w double").groupBy("i").agg(F.sum("v"), F.sum("w")).collect()}
    return [x if math.isfinite(x) else math.inf for x in (found[i] for i in range(len(trees)))]


def energy_search(df: DataFrame, spins: list[str], beta: float = 1.0, config: SearchConfig | None = None, most_patterns: int = 4096) -> list[Candidate]:
    """A front of energies that explain the rows best by pseudo-likelihood, by evolution over sums, differences, products and signs of spins.

    Every candidate is scored on all rows; constants are walked on the `most_patterns` most frequent patterns and the result is
    scored on all rows again.
    """
    from galena.operators.search import Evolution, Grammar, SearchConfig, optimise_constants

    table = patterns(df, spins).persist()
    held = table.orderBy(F.desc("__w"), *spins).limit(most_patterns).toPandas()
    env, w = {s: held[s].to_numpy(float) for s in spins}, held["__w"].to_numpy(float)

    def nearby(tree: Node) -> float:
        return float(-_log_chances([tree], env, w, spins, beta)[0] / (w.sum() * len(spins)))

    def fit(tree: Node) -> tuple[Node, float]:
        moved, _ = optimise_constants(tree, nearby, 60)
        before, after = energy_losses(table, [tree, moved], spins, beta)
        return (moved, after) if after < before else (tree, before)

    config = replace(config or SearchConfig(population=200, generations=40, parsimony=2e-3), prune=False, snap=False)
    grammar = Grammar(spins, measures_1d=False, unary={"neg": 1.0})
    simple = lambda t: all(n.op in ("add", "sub", "mul") for n in T.subtrees(t) if isinstance(n, BinOp))
    seeds = [energy_tree(covariance_seed(df, spins, beta), spins), *(BinOp("mul", Const(-1.0), BinOp("mul", Var(a), Var(b))) for a, b in itertools.combinations(spins, 2))]
    config = replace(config, seeds=[*config.seeds, *(t for t in seeds if T.complexity(t) <= 40)][: config.population])
    found = Evolution(grammar, env, w, config, score=lambda trees: energy_losses(table, trees, spins, beta), fit=fit, accept=simple).run()
    table.unpersist()
    return found


def as_couplings(terms: dict[tuple[int, ...], float], n: int) -> Ising:
    j, h = np.zeros((n, n)), np.zeros(n)
    for t, c in terms.items():
        if len(t) == 1:
            h[t[0]] = c
        elif len(t) == 2:
            j[t[0], t[1]] = j[t[1], t[0]] = c
    return Ising(j, h)


def covariance_seed(df: DataFrame, spins: list[str], beta: float = 1.0, ridge: float = 1e-3) -> Ising:
    """Mean-field couplings: minus the inverse covariance over beta."""
    n = len(spins)
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    row = df.agg(*[F.covar_samp(spins[a], spins[b]) for a, b in pairs]).first()
    c = np.zeros((n, n))
    for (a, b), v in zip(pairs, row, strict=True):
        c[a, b] = c[b, a] = v
    j = -np.linalg.inv(c + ridge * np.eye(n)) / beta
    np.fill_diagonal(j, 0)
    return Ising(j, np.zeros(n))
