"""Signatures as aggregates against whole series and clouds in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galena.operators import aggregated, dynamics
from galena.operators.lowering import Series


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(1)
    parts = {"a": np.sin(np.arange(3000) * 2 * np.pi * 10 / 64) + 0.1 * rng.normal(size=3000), "b": rng.normal(size=700), "short": rng.normal(size=63), None: 2 + np.cos(np.arange(200) / 3)}
    pdf = pd.concat([pd.DataFrame({"s": k, "i": np.arange(len(v)), "x": v}) for k, v in parts.items()])
    return parts, spark.createDataFrame(pdf.astype({"s": object}).where(pdf.notna(), None), "s string, i long, x double").repartition(6)


def test_spectra_equal_those_of_whole_series(waves):
    parts, df = waves
    got = {r["s"]: (r["peak"], r["flatness"], r["frequency"]) for r in aggregated.spectral_content(df, "x", Series(["i"], ["s"]), 64, 0.5).collect()}
    assert set(got) == {"a", "b", None}  # the short one has no whole segment
    for k in got:
        want = dynamics.spectral(parts[k], 0.5, 64)
        assert np.allclose(got[k], (want["peak"], want["flatness"], want["frequency"]), rtol=1e-9)
    assert abs(got["a"][2] - 10 / 64 / 0.5) < 1e-12


def test_one_series_is_numbered_by_ranges(spark, waves):
    parts, df = waves
    one = df.where("s = 'a'").drop("s")
    numbers = aggregated.numbered(one, Series(["i"]), "n")
    assert numbers.where("n <> i").count() == 0 and numbers.count() == 3000
    plan = numbers._jdf.queryExecution().optimizedPlan().toString()
    assert all("__block" in line for line in plan.splitlines() if "Window [" in line)
    want = dynamics.spectral(parts["a"], 1.0, 64)
    got = aggregated.spectral_content(one, "x", Series(["i"]), 64).first()
    assert np.allclose(tuple(got), (want["peak"], want["flatness"], want["frequency"]))


def test_segments_with_missing_values_do_not_count(spark):
    x = [float(np.sin(i)) if i != 20 else None for i in range(64)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double")
    got = aggregated.spectra(df, "x", Series(["i"]), 16).collect()
    assert {r["segments"] for r in got} == {5} and len(got) == 8  # two of seven hold row 20
    assert aggregated.spectra(df.limit(0), "x", Series(["i"]), 16).count() == 0
    level = spark.createDataFrame([(i, 1.0) for i in range(32)], "i long, x double")
    assert tuple(aggregated.spectral_content(level, "x", Series(["i"]), 16).first()) == (0.0, 1.0, 0.0)


def test_conserved_quantities_stand_out(spark):
    rng = np.random.default_rng(2)
    angle = rng.random(4000) * 2 * np.pi
    pdf = pd.concat([pd.DataFrame({"k": "circle", "p": np.cos(angle), "q": np.sin(angle)}), pd.DataFrame({"k": "cloud", "p": rng.normal(size=4000), "q": rng.normal(size=4000)}), pd.DataFrame({"k": "line", "p": angle, "q": 2 * angle + 1})])
    got = {(r["k"], r["degree"]): r for r in aggregated.conserved(spark.createDataFrame(pdf).repartition(5), ["p", "q"], ["k"], 3).collect()}
    assert len(got) == 9
    assert got["circle", 1]["ratio"] > 0.9 and got["circle", 2]["ratio"] < 1e-9  # p^2 + q^2 stays
    assert got["line", 1]["ratio"] < 1e-9 and got["cloud", 2]["ratio"] > 0.8
    for k, g in pdf.groupby("k"):
        want = dynamics.conservation(g[["p", "q"]].to_numpy())
        z = g[["p", "q"]].to_numpy()
        z = (z - z.mean(0)) / (z.std(0) + 1e-12)
        for d in (1, 2, 3):
            powers = [(a, b) for a in range(d + 1) for b in range(d + 1 - a) if a + b]
            phi = np.column_stack([z[:, 0] ** a * z[:, 1] ** b for a, b in powers])
            phi = (phi - phi.mean(0)) / (phi.std(0) + 1e-12)
            assert abs(got[k, d]["variance"] - max(0, np.linalg.eigvalsh(phi.T @ phi / len(phi))[0])) < 1e-8
            assert (got[k, d]["ratio"] < 0.05) == (want[f"degree{d}"] < 0.05)  # the shuffled columns of the whole series say the same


def test_conserved_of_one_cloud_of_missing_and_of_level_columns(spark):
    df = spark.createDataFrame([(float(i % 7), 3.0) for i in range(50)] + [(None, 1.0), (float("nan"), 1.0)], "p double, q double")
    (one,) = aggregated.conserved(df, ["p", "q"], degree=1).collect()
    assert one["degree"] == 1 and 0 <= one["variance"] <= 1
    assert aggregated.conserved(df.limit(0), ["p", "q"], degree=1).count() == 0
    nulls = df.withColumn("k", F.lit(None).cast("string"))
    assert aggregated.conserved(nulls, ["p", "q"], ["k"], 2).count() == 2


def test_modes_are_counted_over_all_rows(spark):
    rng = np.random.default_rng(3)
    three = np.concatenate([rng.normal(size=(900, 2)) * 0.3 + c for c in ((0, 0), (4, 0), (0, 5))])
    df = spark.createDataFrame(pd.DataFrame(three, columns=["a", "b"])).repartition(4)
    made = aggregated.mixture_counts(df, ["a", "b"], 4)
    assert made.loc[made["bic"].idxmin(), "k"] == 3 and made["loglik"].is_monotonic_increasing
    one = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=800)}))
    assert aggregated.mode_count_by_data(one, ["a"], 3) == 1
    assert aggregated.mode_count_by_data(one.limit(0), ["a"], 3) == 0
    same = spark.createDataFrame([(1.0,)] * 30, "a double")
    assert aggregated.mode_count_by_data(same, ["a"], 3) == 1


def test_a_pass_equals_em_in_memory(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=300), rng.normal(size=200) + 3])[:, None]
    df = spark.createDataFrame(pd.DataFrame({"__x0": x[:, 0]})).repartition(3)
    start = aggregated.Mixture(np.array([0.4, 0.6]), np.array([[0.0], [2.0]]), np.array([[[1.0]], [[2.0]]]))
    loglik, n, sums = aggregated._pass(df, 1, {2: start})[2]
    logs = start.logs(x)
    total = np.log(np.exp(logs).sum(1))
    share = np.exp(logs - total[:, None])
    assert n == 500 and abs(loglik - total.sum()) < 1e-8
    assert np.allclose(sums, aggregated._moments(x, share))
    new = aggregated._mixture(sums, 1, 0.0)
    assert np.allclose(new.means[:, 0], (share * x).sum(0) / share.sum(0))
