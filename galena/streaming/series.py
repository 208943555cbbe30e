"""Exponential averages, lags and windowed losses on Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators.measures import Measure, smoothing


def measure_stream(events: DataFrame, key: str, order: str, value: str, mu: Measure, key_type: str = "long", order_type: str = "timestamp") -> DataFrame:
    """(key, order, value, y) for each arriving row: a causal measure along each key's rows in order of arrival.

    State is what the measure needs: the held average, or the last values up to its last lag. Rows of one batch are put in
    order first; rows later than those already seen continue from the state as they come.
    """
    recursive = mu.is_recursive
    a = smoothing(dict(mu.density.params)["halflife"]) if recursive else 0.0
    kernel = mu.kernel()
    last = mu.warmup

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for v in rows[value].to_numpy(float).tolist():
            if recursive:
                held = [v if not held else a * v + (1 - a) * held[0]]
                out.append(held[0])
            else:
                held = [*held, v][-(last + 1) :]
                out.append(float(np.dot(kernel[: last + 1], held[::-1])) if len(held) > last else None)
        state.update((held,))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), value: rows[value].to_numpy(float), "y": pd.Series(out, dtype="float64").to_numpy()})

    schema = f"{key} {key_type}, {order} {order_type}, {value} double, y double"
    return events.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, schema, "held array<double>", "append", "NoTimeout")


def windowed_loss(scored: DataFrame, order: str, prediction: str, target: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, n, mse) of event-time windows; rows later than the watermark are left out by the source of the stream."""
    error = F.pow(F.col(prediction) - F.col(target), F.lit(2.0))
    found = scored.withWatermark(order, late).groupBy(F.window(order, width)).agg(F.count(error).alias("n"), F.avg(error).alias("mse"))
    return found.select(F.col("window.start").alias("start"), "n", "mse")
