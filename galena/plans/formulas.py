"""Thirty formulas of physics with uniform inputs: the recovery benchmark of discovery."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PI = np.pi
# fixed values: the formulas and the ranges of their inputs
FORMULAS: dict[str, tuple[dict[str, tuple[float, float]], str]] = {
    "I.6.20a": ({"theta": (0.5, 5)}, "exp(-theta**2 / 2)"),
    "I.6.20": ({"theta": (0.5, 5), "sigma": (0.5, 2)}, "exp(-(theta / sigma)**2 / 2)"),
    "I.8.14": ({k: (-1, 1) for k in ("x1", "x2", "y1", "y2")}, "sqrt((x2 - x1)**2 + (y2 - y1)**2)"),
    "I.9.18": ({"G": (1, 2), "m1": (1, 2), "m2": (1, 2), "x1": (1, 2), "y1": (1, 2), "z1": (1, 2), "x2": (3, 4), "y2": (3, 4), "z2": (3, 4)}, "G * m1 * m2 / ((x2 - x1)**2 + (y2 - y1)**2 + (z2 - z1)**2)"),
    "I.10.7": ({"m0": (1, 5), "v": (0.1, 0.5), "c": (1, 2)}, "m0 / sqrt(1 - v**2 / c**2)"),
    "I.11.19": ({k: (1, 5) for k in ("x1", "x2", "x3", "y1", "y2", "y3")}, "x1 * y1 + x2 * y2 + x3 * y3"),
    "I.12.1": ({"mu": (1, 5), "Nn": (1, 5)}, "mu * Nn"),
    "I.12.2": ({k: (1, 5) for k in ("q1", "q2", "eps", "r")}, "q1 * q2 / (4 * pi * eps * r**2)"),
    "I.12.4": ({k: (1, 5) for k in ("q1", "q2", "eps", "r")}, "q1 * q2 / (4 * pi * eps * r**2)"),
    "I.12.5": ({k: (1, 5) for k in ("q1", "q2", "r")}, "q1 * q2 / r**2"),
    "I.12.11": ({"q": (1, 5), "Ef": (1, 5), "B": (1, 5), "v": (1, 5), "theta": (0, PI)}, "q * (Ef + B * v * sin(theta))"),
    "I.14.3": ({k: (1, 5) for k in ("m", "g", "z")}, "m * g * z"),
    "I.14.4": ({"k": (1, 5), "x": (1, 5)}, "k * x**2 / 2"),
    "I.15.3t": ({"x": (1, 5), "t": (1, 5), "u": (0.1, 0.5), "c": (1, 2)}, "(x - u * t) / sqrt(1 - u**2 / c**2)"),
    "I.16.6": ({"u": (0.1, 0.5), "v": (0.1, 0.5), "c": (1, 2)}, "(u + v) / (1 + u * v / c**2)"),
    "I.18.4": ({k: (1, 5) for k in ("m1", "m2", "r1", "r2")}, "(m1 * r1 + m2 * r2) / (m1 + m2)"),
    "I.24.6": ({k: (1, 5) for k in ("m", "w", "w0", "x")}, "m * (w**2 + w0**2) * x**2 / 2"),
    "I.25.13": ({"q": (1, 5), "C": (1, 5)}, "q / C"),
    "I.26.2": ({"n": (0.7, 1.3), "theta2": (0.1, 1)}, "arcsin(n * sin(theta2))"),
    "I.27.6": ({"d1": (1, 5), "d2": (1, 5)}, "d1 * d2 / (d1 + d2)"),
    "I.29.4": ({"w": (1, 5), "c": (1, 5)}, "w / c"),
    "I.30.3": ({"I0": (1, 5), "n": (2, 5), "theta": (0.1, 1)}, "I0 * sin(n * theta / 2)**2 / sin(theta / 2)**2"),
    "I.32.5": ({"q": (1, 5), "a": (1, 5), "eps": (1, 5), "c": (1.5, 3)}, "q**2 * a**2 / (6 * pi * eps * c**3)"),
    "I.34.8": ({k: (1, 5) for k in ("q", "v", "B", "p")}, "q * v * B / p"),
    "I.39.22": ({k: (1, 5) for k in ("n", "k", "T", "V")}, "n * k * T / V"),
    "I.40.1": ({"n0": (1, 5), "m": (1, 5), "g": (1, 5), "x": (0.1, 1), "k": (1, 5), "T": (1, 5)}, "n0 * exp(-m * g * x / (k * T))"),
    "I.43.31": ({k: (1, 5) for k in ("k", "T", "eta", "r")}, "k * T / (6 * pi * eta * r)"),
    "I.43.43": ({k: (1, 5) for k in ("kappa", "v", "n", "sigma")}, "kappa * v**2 / (n * sigma)"),
    "I.47.23": ({"gamma": (1, 2), "pr": (1, 5), "rho": (1, 5)}, "sqrt(gamma * pr / rho)"),
    "I.48.2": ({"m": (1, 5), "c": (1.5, 3), "v": (0.1, 0.5)}, "m * c**2 / sqrt(1 - v**2 / c**2)"),
}
NAMES = {"exp": np.exp, "sqrt": np.sqrt, "sin": np.sin, "arcsin": np.arcsin, "pi": PI}


def sample(name: str, n: int = 2000, seed: int = 0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    ranges, formula = FORMULAS[name]
    rng = np.random.default_rng(seed)
    env = {k: rng.uniform(a, b, n) for k, (a, b) in ranges.items()}
    with np.errstate(invalid="ignore"):
        y = eval(formula, {"__builtins__": {}}, {**NAMES, **env})  # noqa: S307  a text of this file
    good = np.isfinite(y)
    return {k: v[good] for k, v in env.items()}, y[good]


def recover(name: str, n: int = 2000) -> tuple[str, float, str, float]:
    """(formula, error over variance on the last three tenths of the rows, what was found, seconds)."""
    import time

    from galena.operators import tree as T
    from galena.operators.enumeration import decompose

    began = time.time()
    env, y = sample(name, n, sorted(FORMULAS).index(name))
    cut = int(0.7 * len(y))
    found = decompose({k: v[:cut] for k, v in env.items()}, y[:cut]).tree
    p = np.broadcast_to(np.asarray(T.evaluate(found, {k: v[cut:] for k, v in env.items()}), float), (len(y) - cut,))
    good = np.isfinite(p)
    rel = float(np.mean((p[good] - y[cut:][good]) ** 2) / np.var(y[cut:])) if good.mean() > 0.9 else float("inf")
    return name, rel, str(found)[:500], time.time() - began


def recovery(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(formula, rel, exact, found, seconds): formulas are rows, a formula a task."""
    names = names or list(FORMULAS)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([recover(n) for n in pdf["formula"]], columns=["formula", "rel", "found", "seconds"])

    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, formula string")
    return rows.repartitionByRange(len(names), "i").mapInPandas(run, "formula string, rel double, found string, seconds double").selectExpr("formula", "rel", "rel < 1e-8 as exact", "found", "seconds")
