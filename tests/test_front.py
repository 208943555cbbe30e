"""Fronts of rows whose losses are sums of doubles: their last bits differ from one evaluation to the next."""

import datetime
import math
import os
import random

import pandas as pd
import pytest

from galena.operators.scoring import pareto_rows
from galena.plans import registry

ROWS = "tree string, complexity int, loss double"


def _front(rows):
    return sorted((t, c, v) for t, c, v in rows if v is not None and math.isfinite(v) and not any(w is not None and (d < c and w <= v or d == c and w < v) for _, d, w in rows))


def test_front_of_losses_that_differ_at_each_evaluation(spark):
    def noisy(batches):
        for pdf in batches:
            yield pdf.assign(loss=[v * (1 + int.from_bytes(os.urandom(3)) * 2.0**-50) for v in pdf["loss"]])

    rows = [(f"{kind}{c}", c, 10.0 - c + worse) for c in range(1, 9) for kind, worse in (("best", 0.0), ("next", 0.5))] + [("late", 9, 5.0)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["tree", "complexity", "loss"])).mapInPandas(noisy, ROWS)
    got = pareto_rows(df)
    assert got.columns == df.columns
    assert sorted(r["tree"] for r in got.collect()) == [f"best{c}" for c in range(1, 9)]


@pytest.mark.parametrize("seed", range(3))
def test_front_with_ties_and_losses_that_are_no_numbers(spark, seed):
    rng = random.Random(seed)
    rows = [("a", 1, math.inf), ("b", 1, None), ("c", 1, math.nan)]
    rows += [(f"t{i}", rng.randint(2, 9), rng.choice([None, math.nan, math.inf, *(float(k) for k in range(12))])) for i in range(60)]
    got = pareto_rows(spark.createDataFrame(rows, ROWS).repartition(3)).collect()
    assert sorted(map(tuple, got)) == _front(rows)


@pytest.mark.parametrize("each", [1, 2, 40])
def test_flagship_equals_its_sql(spark, tmp_path, each):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(each)
    start = datetime.datetime(2024, 1, 1)
    rows = [(u * each + i, u, start + datetime.timedelta(seconds=rng.randint(0, 30)), round(rng.expovariate(0.01), 2)) for u in range(5) for i in range(each)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()["flagship_pareto"]).fetchall()
    got = registry.queries()["flagship_pareto"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert (len(want) > 0) == (each > 1)
