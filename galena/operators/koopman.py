"""A linear latent forecaster: ridge regression of the next value on a stack of past ones, cut to its leading directions.

All sums over time are three Gram aggregates of one window plan; the rest is small linear algebra on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.operators.lowering import Series


@dataclass
class Forecaster:
    names: list[str]
    past: int
    mean: np.ndarray
    encode: np.ndarray  # latent x stack
    step: np.ndarray  # latent x latent
    decode: np.ndarray  # values x latent
    singular: np.ndarray
    delta: bool = False
    drift: np.ndarray | None = None

    def _latent(self, history: np.ndarray) -> np.ndarray:
        """history: rows of values, oldest first."""
        rows = np.diff(history, axis=0) - self.drift if self.delta else history - self.mean
        return self.encode @ rows[::-1][: self.past].ravel()

    def one_step(self, history: np.ndarray) -> np.ndarray:
        return self.horizon(history, 1)[1]

    def horizon(self, history: np.ndarray, steps: int) -> np.ndarray:
        """The last value and `steps` forecasts."""
        z, out = self._latent(np.asarray(history, float)), [np.asarray(history, float)[-1]]
        for _ in range(steps):
            v = self.decode @ z
            out.append(out[-1] + v + self.drift if self.delta else v + self.mean)
            z = self.step @ z
        return np.array(out)

    def eigenmodes(self) -> np.ndarray:
        return np.linalg.eigvals(self.step)

    @property
    def n_params(self) -> int:
        return self.encode.size + self.step.size + self.decode.size

    def one_step_columns(self, series: Series) -> dict[str, Column]:
        """The forecast of the next row as expressions over each series: batch scoring without leaving Spark."""
        w, weights = series.window(), self.decode @ self.encode
        out = {}
        for i, name in enumerate(self.names):
            total = F.lit(float(self.mean[i]))
            for k in range(self.past):
                for j, other in enumerate(self.names):
                    c = F.col(other) if k == 0 else F.lag(other, k).over(w)
                    total = total + F.lit(float(weights[i, k * len(self.names) + j])) * (c - F.lit(float(self.mean[j])))
            out[name] = total
        return out


def fit(df: DataFrame, names: list[str], series: Series, past: int = 2, rank: int = 4, ridge: float = 1e-6, delta: bool = False) -> Forecaster:
    d, w = len(names), series.window()
    drift = None
    if delta:
        df = df.select(*series.keys, *series.order, *[(F.col(n) - F.lag(n).over(w)).alias(n) for n in names]).dropna(subset=names)
        drift = np.array(df.agg(*[F.avg(n) for n in names]).first(), float)
    mean = np.array(df.agg(*[F.avg(n) for n in names]).first(), float)
    centred = df.select(*series.keys, *series.order, *[(F.col(n) - F.lit(float(m))).alias(n) for n, m in zip(names, mean, strict=True)])
    # columns: the stack (newest first), the next values, the stack one step on
    stack = [(F.lag(n, k).over(w) if k else F.col(n)).alias(f"p{k}_{j}") for k in range(past) for j, n in enumerate(names)]
    ahead = [F.lead(n, 1).over(w).alias(f"n_{j}") for j, n in enumerate(names)]
    rows = centred.select(*stack, *ahead).dropna()
    p, q = [f"p{k}_{j}" for k in range(past) for j in range(d)], [f"n_{j}" for j in range(d)]
    shifted = [*q, *p[: (past - 1) * d]]
    sums = [F.sum(F.col(a) * F.col(b)) for a in p for b in p] + [F.sum(F.col(a) * F.col(b)) for a in q for b in p] + [F.sum(F.col(a) * F.col(b)) for a in shifted for b in p]
    n, *flat = rows.agg(F.count(F.lit(1)), *sums).first()
    if not n or n < 2:
        raise ValueError("too few rows for this many past steps")
    m = past * d
    pp, qp, sp = np.array(flat[: m * m]).reshape(m, m), np.array(flat[m * m : m * m + d * m]).reshape(d, m), np.array(flat[m * m + d * m :]).reshape(m, m)
    whole = qp @ np.linalg.inv(pp + ridge * np.eye(m))
    # with few values a step has few directions; the stack's own principal ones fill up the rank
    _, singular, v = np.linalg.svd(whole, full_matrices=False)
    k = min(rank, m)
    encode = v[: min(k, len(v))]
    if len(encode) < k:
        values, vectors = np.linalg.eigh(pp)
        for x in vectors.T[::-1]:
            x = x - encode.T @ (encode @ x)
            if len(encode) < k and np.linalg.norm(x) > 1e-6:
                encode = np.vstack([encode, x / np.linalg.norm(x)])
    small = np.linalg.inv(encode @ pp @ encode.T + ridge * np.eye(len(encode)))
    return Forecaster(names, past, mean, encode, encode @ sp @ encode.T @ small, qp @ encode.T @ small, singular, delta, drift)
