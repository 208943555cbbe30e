"""Queries of long kernels and of mixed trees along one series of the whole events table, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators import measures as M
from galena.operators.lowering import Series, evaluate
from galena.operators.measures import Density, Measure
from galena.operators.tree import BinOp, Const, UnOp, Var
from galena.plans.registry import _ALPHA, linear, query
from galena.sources.tables import table

#: All events as one series.
ONE = Series(["ts", "event_id"])
_ROWS = "o AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)"


def _kernel_sql(name: str, weight: str, last: int, total: str) -> str:
    """The sum of weight(k) * value k rows before, k = 0 to last, null before the first such row."""
    return f"{name} AS (SELECT a.event_id, CASE WHEN any_value(a.n) > {last} THEN round(sum(b.value * {weight}) / {total}, 6) + 0.0 END AS {name} FROM o a JOIN o b ON b.n BETWEEN a.n - {last} AND a.n GROUP BY a.event_id)"


_GAUSS = "exp(-(a.n - b.n) * (a.n - b.n) / 80000.0)"
_POWER = "pow(1 + (a.n - b.n) / 24.0, -1.5)"


@query(
    "measure_kernels_720",
    f"WITH {_ROWS}, {_kernel_sql('slow', _POWER, 720, '(SELECT sum(pow(1 + k / 24.0, -1.5)) FROM range(721) t(k))')}, {_kernel_sql('bell', _GAUSS, 900, '(SELECT sum(exp(-k * k / 80000.0)) FROM range(901) t(k))')}"
    " SELECT event_id, slow, bell FROM slow JOIN bell USING (event_id)",
)
def _long_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels of 721 and 901 weights along all events: both by transforms, in one pass over the rows of a range."""
    trees = {"slow": linear(M.power_law(24, 1.5, 720)), "bell": linear(Measure((), Density("gaussian_half", (("sigma", 200.0),), 900)))}
    made = evaluate(table(spark, sf_dir, "events").select("event_id", "ts", "value"), trees, ONE, keep=["event_id"])
    return made.select("event_id", *[F.round(c, 6).alias(c) for c in trees])


@query(
    "measures_mixed_one_series",
    f"WITH RECURSIVE {_ROWS}, m AS (SELECT avg(value) AS mean FROM o), r AS (SELECT event_id, n, value AS e FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.n, {_ALPHA} * o.value + (1 - {_ALPHA}) * r.e FROM r JOIN o ON o.n = r.n + 1)"
    " SELECT event_id, round(value - lag(value, 3) OVER w + e - mean, 6) + 0.0 AS mixed, round(lag(e, 2) OVER w, 6) + 0.0 AS late, round(stddev_pop(e - value) OVER () * value, 5) + 0.0 AS spread FROM r JOIN o USING (event_id, n), m WINDOW w AS (ORDER BY n)",
)
def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, an exponential average, a lag of it and reductions along one series without keys: averages hand over between ranges, the rest runs in ranges."""
    average, value = linear(M.ema(3)), Var("value")
    spread = UnOp("reduce_std", BinOp("sub", average, value))
    trees = {
        "mixed": BinOp("sub", BinOp("add", linear(M.diff(3)), average), UnOp("reduce_mean", value)),
        "late": linear(M.lag(2), average),
        "spread": BinOp("mul", BinOp("add", spread, Const(0.0)), value),
    }
    made = evaluate(table(spark, sf_dir, "events").select("event_id", "ts", "value"), trees, ONE, keep=["event_id"])
    return made.select("event_id", F.round("mixed", 6).alias("mixed"), F.round("late", 6).alias("late"), F.round("spread", 5).alias("spread"))
