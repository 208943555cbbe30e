"""Measures along streams in the order of events, whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from galena.operators.measures import Measure, smoothing
from galena.operators.streams import Averages

#: What becomes of a row that is older than one already given out: it goes, or it comes out without a value.
LATE = ("drop", "mark")


class InOrder(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them, then gives them out in order, each with the measure's value.

    State is the rows that wait, the last values that the measure reaches back to (or the held average), and the time of the last row given out. A timer
    wakes a key whose rows the watermark passes while nothing arrives for it.
    """

    def __init__(self, key: str, order: str, value: str, mu: Measure, late: str) -> None:
        self.key, self.order, self.value, self.mu, self.late = key, order, value, mu, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, value double")
        self.held = handle.getValueState("held", "last long, values array<double>")

    def _give(self, key, rows: list[tuple[int, float]], last: int | None, values: list[float]) -> tuple[pd.DataFrame, list[float]]:
        """The rows in order with their values, and what is held after them."""
        x = np.array([v for _, v in rows], float)
        if self.mu.is_recursive:
            state = Averages(smoothing(dict(self.mu.density.params)["halflife"]))
            first = np.zeros(len(x), bool)
            if values:
                state.held = values[0]
            elif len(x):
                first[0] = True
            y = state.push(x, first)
            values = [state.held] if len(x) else values
        else:
            kernel, reach = self.mu.kernel()[: self.mu.warmup + 1], self.mu.warmup
            whole = np.array([*values, *x])
            y = np.array([float(kernel @ whole[i - reach : i + 1][::-1]) if i >= reach else np.nan for i in range(len(values), len(whole))])
            values = whole[max(0, len(whole) - reach) :].tolist() if reach else []
        at = pd.to_datetime([t for t, _ in rows], unit="us")
        return pd.DataFrame({self.key: [key[0]] * len(rows), self.order: at, self.value: x, "y": y, "late": False}), values

    def _ready(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """All rows that the watermark has passed, in order."""
        rows = sorted((int(a), float(v) if v is not None else float("nan")) for a, v in self.waiting.get())
        due, rest = [r for r in rows if r[0] <= watermark * 1000], [r for r in rows if r[0] > watermark * 1000]
        if due:
            last, values = self.held.get() if self.held.exists() else (None, [])
            out, values = self._give(key, due, last, list(values))
            self.held.update((due[-1][0], values))
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield out
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.held.get()[0] if self.held.exists() else None
        new, old = [], []
        for pdf in rows:
            at = pdf[self.order].astype("datetime64[us]").astype("int64")
            for t, v in zip(at.tolist(), pdf[self.value].astype(float).tolist(), strict=True):
                (old if last is not None and t < last else new).append((t, v))
        if new:
            self.waiting.appendList(new)
        if old and self.late == "mark":
            yield pd.DataFrame({self.key: [key[0]] * len(old), self.order: pd.to_datetime([t for t, _ in old], unit="us"), self.value: [v for _, v in old], "y": np.nan, "late": True})
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def measure_in_order(events: DataFrame, key: str, order: str, value: str, mu: Measure, delay: str = "10 minutes", late: str = "drop", key_type: str = "long") -> DataFrame:
    """(key, order, value, y, late) of a stream: a causal measure along each key's rows in the order of their times, as over the whole table at rest.

    Rows wait until the watermark (the latest time seen less `delay`) has passed them, so arrivals may be shuffled by that much. A row that is older than one of
    its key already given out does not change what was said: late = "drop" leaves it out, "mark" gives it with late set and without
    a value. Rows of one time stand by their values. The session needs the state store that keeps its state on disk
    (spark.sql.streaming.stateStore.providerClass of RocksDB). Before the warmup y is NaN.
    """
    if late not in LATE:
        raise ValueError(f"late is one of {LATE}")
    rows = events.select(key, order, F.col(value).cast("double").alias(value)).withWatermark(order, delay)
    schema = f"{key} {key_type}, {order} timestamp, {value} double, y double, late boolean"
    return rows.groupBy(key).transformWithStateInPandas(InOrder(key, order, value, mu, late), schema, "append", "EventTime")


__all__ = ["InOrder", "measure_in_order"]
