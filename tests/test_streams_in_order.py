"""Streams whose rows arrive out of order against the table at rest."""

import numpy as np
import pandas as pd
import pytest

from galena.operators import measures

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _run(spark, tmp_path, parts, mu, **how):
    from galena.streaming.ordered import measure_in_order

    schema = "k long, ts timestamp, v double"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n:03}"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    name = f"ordered_{abs(hash(str(tmp_path)))}"
    q = measure_in_order(stream, "k", "ts", "v", mu, **how).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.set(PROVIDER, before)
    return spark.table(name).toPandas()


def _rows(n, seed=1):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01")
    return [(int(i % 2), (start + pd.Timedelta(minutes=i)).to_pydatetime(), float(rng.normal())) for i in range(n)]


@pytest.mark.parametrize("mu", [measures.ema(3), measures.signed_sum([(1.0, 0), (-0.5, 2)])])
def test_shuffled_arrivals_give_the_result_at_rest(spark, tmp_path, mu):
    rows = _rows(60)
    rng = np.random.default_rng(2)
    # everything moves by less than the delay; a last row far on lets the watermark pass all others
    order = np.argsort(np.arange(60) + rng.uniform(0, 20, 60))
    parts = [[rows[i] for i in order[a : a + 20]] for a in (0, 20, 40)]
    end = pd.Timestamp("2024-01-02").to_pydatetime()
    got = _run(spark, tmp_path, [*parts, [(0, end, 0.0), (1, end, 0.0)], [(0, (pd.Timestamp(end) + pd.Timedelta(days=1)).to_pydatetime(), 0.0)]], mu, delay="30 minutes")
    got = got[got["ts"] < pd.Timestamp("2024-01-02")]
    assert len(got) == 60 and not got["late"].any()
    for k, g in got.sort_values("ts").groupby("k"):
        want = mu.apply(np.array([v for kk, _, v in rows if kk == k]))
        assert np.allclose(g["y"].to_numpy(float), want, equal_nan=True)


@pytest.mark.parametrize("late", ["drop", "mark"])
def test_rows_behind_what_was_given_out(spark, tmp_path, late):
    rows = [r for r in _rows(40) if r[0] == 0]
    end = pd.Timestamp("2024-01-03")
    straggler = (0, rows[2][1], 99.0)
    parts = [rows, [(0, end.to_pydatetime(), 0.0)], [(0, (end + pd.Timedelta(days=1)).to_pydatetime(), 0.0)], [straggler], [(0, (end + pd.Timedelta(days=2)).to_pydatetime(), 0.0)]]
    got = _run(spark, tmp_path, parts, measures.ema(3), delay="5 minutes", late=late)
    assert (got["v"] == 99.0).sum() == 0 or late == "mark" and got[got["v"] == 99.0]["late"].all()
    kept = got[(got["ts"] < end) & ~got["late"]].sort_values("ts")
    assert np.allclose(kept["y"].to_numpy(float), measures.ema(3).apply(np.array([v for *_, v in rows])))


def test_an_unknown_policy_is_an_error(spark):
    from galena.streaming.ordered import measure_in_order

    with pytest.raises(ValueError):
        measure_in_order(spark.range(1), "id", "id", "id", measures.lag(1), late="never")
