"""Signatures of series and point clouds as aggregates: spectra, conserved combinations, and how many modes there are.

Tasks add up what a signature needs (powers of segments, products of monomials, moments under a mixture), and only those sums travel. No
series and no cloud ever stands in one task, be one key a third of all rows or all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from galena.functions.pointwise import finite
from galena.operators.lowering import Series
from galena.operators.regression import monomials


def numbered(df: DataFrame, series: Series, out: str) -> DataFrame:
    """df with each row's number in its series, from 0.

    One series without keys is numbered by ranges of its order: counts of the ranges come first, so no task sorts more than a range.
    """
    if series.keys:
        return df.withColumn(out, F.row_number().over(series.window()).cast("long") - 1)
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = series.order[0]
    place = (F.col(f"`{first}`").cast("timestamp") if dict(df.dtypes)[first] == "timestamp_ntz" else F.col(f"`{first}`")).cast("double")
    bounds = sorted(set(df.select(place.alias("p")).approxQuantile("p", [i / blocks for i in range(1, blocks)], 0.001))) if blocks > 1 else []
    own = (F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= place)) if bounds else F.lit(0)).cast("int")
    dealt = df.withColumn("__block", own)
    counts = sorted(map(tuple, dealt.groupBy("__block").count().collect()))  # a row a range
    starts = dict(zip([b for b, _ in counts], np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False))
    before = F.element_at(F.create_map(*[F.lit(v) for b, s in starts.items() for v in (b, s)]), F.col("__block")) if starts else F.lit(0)
    within = Window.partitionBy("__block").orderBy(*series.order)
    return dealt.withColumn(out, F.row_number().over(within).cast("long") - 1 + before).drop("__block")


# --- spectra


def spectra(df: DataFrame, x: str, series: Series, size: int = 256) -> DataFrame:
    """(keys, bin, power, segments): each series' mean power by frequency (bin / size of the sampling rate), over all its segments of `size` rows.

    Segments overlap by half, lose their mean and are tapered by a Hann window. A row belongs to two of them, so segments are two groupings of the same rows; each is
    transformed by itself, and powers are added up. Segments that are not full or hold a missing value do not count; series without one give no rows.
    """
    half = size // 2
    at = F.floor(F.col("__i") / half).cast("long")
    value = F.col(f"`{x}`").cast("double")
    rows = numbered(df.select(*series.keys, *[c for c in series.order if c not in series.keys], value.alias("__x")), series, "__i")
    both = rows.select(*series.keys, "__i", "__x", F.explode(F.array(at, at - 1)).alias("__seg")).where(F.col("__seg") >= 0)
    place = (F.col("__i") - F.col("__seg") * half).cast("int")
    whole = both.where(finite(F.col("__x"))).groupBy(*series.keys, "__seg").agg(F.collect_list(F.struct(place.alias("p"), F.col("__x").alias("x"))).alias("rows"))
    whole = whole.where(F.size("rows") == size).select(*series.keys, F.transform(F.array_sort("rows"), lambda r: r["x"]).alias("__v"))
    window = np.hanning(size + 1)[:-1]
    bins = size // 2

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            power = np.abs(np.fft.rfft((values - values.mean(1, keepdims=True)) * window, axis=1)[:, 1:]) ** 2
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(power) + 1, dtype=np.int32) * bins), pa.array(power.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in series.keys], flat], [*series.keys, "__p"])

    powers = whole.mapInArrow(run, whole.drop("__v").schema.add("__p", types.ArrayType(types.DoubleType())))
    each = powers.select(*series.keys, F.posexplode("__p").alias("bin", "power"))
    return each.groupBy(*series.keys, (F.col("bin") + 1).alias("bin")).agg(F.avg("power").alias("power"), F.count(F.lit(1)).alias("segments"))


def spectral_content(df: DataFrame, x: str, series: Series, size: int = 256, dt: float = 1.0) -> DataFrame:
    """(keys, peak, flatness, frequency): the greatest power over the mean, the geometric over the arithmetic mean, and where the greatest power is."""
    rows = spectra(df, x, series, size)
    found = rows.groupBy(*series.keys) if series.keys else rows.groupBy()
    mean = F.avg("power")
    made = found.agg(
        F.coalesce(F.max("power") / F.nullif(mean, F.lit(0.0)), F.lit(0.0)).alias("peak"), F.coalesce(F.exp(F.avg(F.log(F.col("power") + 1e-300))) / F.nullif(mean, F.lit(0.0)), F.lit(1.0)).alias("flatness"),
        F.when(mean > 0, F.max_by("bin", F.struct("power", -F.col("bin"))) / (size * dt)).otherwise(0.0).alias("frequency"), F.count(F.lit(1)).alias("__n"),
    )
    return made.where("__n > 0").drop("__n")


# --- conserved combinations


def conserved(df: DataFrame, columns: list[str], keys: list[str] | None = None, degree: int = 3) -> DataFrame:
    """(keys, degree, variance, independent, ratio): the least variance of a combination of monomials of the columns up to each degree.

    Columns are scaled to mean 0 and variance 1 within a key, monomials too, and the weights of a combination have length 1, so a conserved quantity shows as a variance near 0. independent is the same for columns that do not
    depend on one another, from their moments alone; ratio is the one over the other. Rows with a missing entry are left out; keys whose columns do not vary at all have
    zero columns. A task sends one row for each product of two monomials and key of its batch; the eigenvalues of a key are taken from its sums.
    """
    keys = keys or []
    values = [F.col(f"`{c}`").cast("double").alias(f"__c{j}") for j, c in enumerate(columns)]
    names = [f"__c{j}" for j in range(len(columns))]
    rows = df.select(*keys, *values)
    for n in names:
        rows = rows.where(finite(F.col(n)))
    at = [f"__k{j}" for j in range(len(keys))]
    stats = rows.groupBy(*keys).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).withColumnsRenamed(dict(zip(keys, at, strict=True)))
    match = F.lit(True)
    for k, a in zip(keys, at, strict=True):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(a))
    scaled = (rows.join(stats, match) if keys else rows.join(F.broadcast(stats))).select(*keys, *[((F.col(n) - F.col(f"{n}_m")) / (F.col(f"{n}_s") + 1e-12)).alias(n) for n in names])
    powers = [(0,) * len(columns), *monomials(names, degree)]
    upper = np.triu_indices(len(powers))

    def run(batches):
        for batch in batches:
            x = np.array([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).reshape(len(names), -1)
            phi = np.array([np.prod([c**k for c, k in zip(x, p, strict=True)], axis=0) for p in powers])
            single = np.array([c**k for c in x for k in range(2 * degree + 1)])
            owner = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                code, kinds = pd.factorize(batch.column(k).to_pandas(), use_na_sentinel=False)
                owner = owner * len(kinds) + code
            order = np.argsort(owner, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []:
                gram = (phi[:, i] @ phi[:, i].T)[upper]
                sums = np.concatenate([gram, single[:, i].sum(1)])
                out = [pa.array([batch.column(k)[int(i[0])].as_py()] * len(sums), batch.column(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], [*keys, "__at", "__sum"])

    schema = scaled.select(*keys).schema.add("__at", "integer").add("__sum", "double")
    sums = scaled.mapInArrow(run, schema).groupBy(*keys, "__at").agg(F.sum("__sum").alias("__sum"))
    made = len(upper[0])

    def least(gram: np.ndarray, count: int) -> float:
        mean = gram[0, 1 : count + 1]
        cov = gram[1 : count + 1, 1 : count + 1] - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-12
        return float(max(0.0, np.linalg.eigvalsh(cov / np.outer(spread, spread))[0]))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        all_sums = pdf.sort_values("__at")["__sum"].to_numpy()
        gram = np.zeros((len(powers), len(powers)))
        gram[upper] = all_sums[:made]
        n = gram[0, 0]
        gram = (gram + np.triu(gram, 1).T) / n
        moment = all_sums[made:].reshape(len(names), -1) / n
        apart = np.array([[np.prod([moment[j, a + b] for j, (a, b) in enumerate(zip(p, q, strict=True))]) for q in powers] for p in powers])
        out = []
        for d in range(1, degree + 1):
            count = sum(0 < sum(p) <= d for p in powers)
            v, w = least(gram, count), least(apart, count)
            out.append((*(pdf[k].iloc[0] for k in keys), d, v, w, v / (w + 1e-12)))
        return pd.DataFrame(out, columns=[*keys, "degree", "variance", "independent", "ratio"])

    fields = scaled.select(*keys).schema.add("degree", "integer").add("variance", "double").add("independent", "double").add("ratio", "double")
    if not keys:
        sums = sums.withColumn("__one", F.lit(0))
    return sums.groupBy(*(keys or ["__one"])).applyInPandas(solve, fields)  # a row for each product: no more than the monomials allow


# --- modes


@dataclass
class Mixture:
    """Gaussians: weights (k), means (k, d), covariances (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of each Gaussian's weighted density at the rows of x."""
        out, d = np.empty((len(x), len(self.weights))), x.shape[1]
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            gap = x - m
            out[:, j] = math.log(w + 1e-300) - 0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap) + np.linalg.slogdet(c)[1] + d * math.log(2 * math.pi))
        return out

    def bic(self, loglik: float, n: int) -> float:
        k, d = self.means.shape
        return -2 * loglik + (k * (d + d * (d + 1) / 2) + k - 1) * math.log(max(1, n))


def _moments(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each Gaussian the sums of its share of the rows, of the rows and of their products."""
    d = x.shape[1]
    products = (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)
    return np.hstack([share.sum(0)[:, None], share.T @ x, share.T @ products])


def _mixture(sums: np.ndarray, d: int, ridge: float) -> Mixture:
    n = sums[:, 0] + 1e-9
    means = sums[:, 1 : d + 1] / n[:, None]
    second = sums[:, d + 1 :].reshape(-1, d, d) / n[:, None, None]
    return Mixture(sums[:, 0] / max(1e-300, sums[:, 0].sum()), means, second - means[:, :, None] * means[:, None, :] + ridge * np.eye(d))


def _points(df: DataFrame, columns: list[str], more: list[Column] | None = None) -> DataFrame:
    """The columns where all are finite, on the scale of their spread, and others."""
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    good = F.lit(True)
    for v in values:
        good = good & finite(v)
    rows = df.where(good)
    m = rows.agg(*[f(v) for v in values for f in (F.avg, F.stddev_pop)]).first()
    scaled = [((v - (m[2 * j] or 0.0)) / ((m[2 * j + 1] or 0.0) + 1e-12)).alias(f"__x{j}") for j, v in enumerate(values)]
    return rows.select(*scaled, *(more or []))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.array([batch.column(j).to_numpy(zero_copy_only=False) for j in range(d)]).reshape(d, -1).T.astype(float)


def _pass(points: DataFrame, d: int, mixtures: dict[int, Mixture]) -> dict[int, tuple[float, int, np.ndarray]]:
    """One pass for all mixtures: (log-likelihood, rows, moments under the responsibilities) of each."""
    width = 1 + d + d * d

    def run(batches):
        sums = {k: np.zeros((len(m.weights), width + 2)) for k, m in mixtures.items()}
        for batch in batches:
            x = _matrix(batch, d)
            for k, m in mixtures.items():
                logs = m.logs(x)
                top = logs.max(1, keepdims=True, initial=-np.inf)
                share = np.exp(logs - top)
                total = share.sum(1, keepdims=True)
                sums[k][:, :width] += _moments(x, share / total)
                sums[k][0, width:] += (top + np.log(total)).sum(), len(x)
        rows = [(k, j, i, float(v)) for k, s in sums.items() for j, line in enumerate(s) for i, v in enumerate(line)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32()] * 3 + [pa.float64()])], ["k", "j", "i", "v"])

    out = {k: np.zeros((len(m.weights), width + 2)) for k, m in mixtures.items()}
    for k, j, i, v in points.mapInArrow(run, "k int, j int, i int, v double").groupBy("k", "j", "i").agg(F.sum("v")).collect():  # a row a number
        out[k][j, i] = v
    return {k: (float(s[0, width]), int(s[0, width + 1]), s[:, :width]) for k, s in out.items()}


def mixture_of(df: DataFrame, columns: list[str], group: Column, ridge: float = 1e-4) -> tuple[Mixture, float, int]:
    """(the mixture of one Gaussian for each value of `group`, its log-likelihood, rows): fixed responsibilities, no steps."""
    d = len(columns)
    points = _points(df, columns, [group.alias("__g")])
    xs = [f"__x{j}" for j in range(d)]
    sums = points.groupBy("__g").agg(F.count(F.lit(1)), *[F.sum(x) for x in xs], *[F.sum(F.col(a) * F.col(b)) for a in xs for b in xs]).orderBy("__g").collect()
    made = _mixture(np.array([r[1:] for r in sums], float), d, ridge)
    loglik, n, _ = _pass(points.drop("__g"), d, {0: made})[0]
    return made, loglik, n


def _seeds(points: DataFrame, d: int, most: int, rounds: int = 3, seed: int = 4) -> np.ndarray:
    """Points far from one another: rounds draw rows by their squared distance from those drawn before, some 2 * most a round, and the farthest of them are taken in turn."""
    columns = [f"__x{j}" for j in range(d)]
    hashed = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    first = points.orderBy(hashed, *columns).limit(1).collect()
    if not first:
        return np.zeros((0, d))
    drawn = np.array([list(first[0])], float)
    for r in range(rounds):
        far = F.least(*[sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, row, strict=True)), F.lit(0.0)) for row in drawn], F.lit(float("inf")))
        total = points.agg(F.sum(far)).first()[0] or 0.0
        if total <= 0:
            break
        coin = F.pmod(F.xxhash64(*columns, F.lit(seed + 1 + r)), F.lit(1 << 30)).cast("double") / float(1 << 30)
        # rows that repeat share a coin, so a round is cut at its most likely ones
        new = points.where(coin < far * F.lit(2.0 * most / total)).distinct().orderBy(far.desc(), *columns).limit(8 * most).collect()
        drawn = np.vstack([drawn, *[np.array([list(x)], float) for x in new]])
    chosen = [int(np.argmin((drawn**2).sum(1)))]  # the one nearest the centre, then always the farthest from all so far
    while len(chosen) < min(most, len(drawn)):
        far = ((drawn[:, None] - drawn[chosen][None]) ** 2).sum(2).min(1)
        chosen.append(int(far.argmax()))
    return drawn[chosen]


def mixture_counts(df: DataFrame, columns: list[str], most: int = 5, steps: int = 60, ridge: float = 1e-4) -> pd.DataFrame:
    """(k, bic, loglik, steps): for each number of Gaussians up to `most` the criterion of the best fit found, over all rows where the columns are finite.

    All numbers are fitted side by side, a pass over the rows a step; a fit rests once its likelihood has settled. The one of the least bic says how many modes
    there are. Columns are taken on the scale of their spread. No rows give an empty table.
    """
    d = len(columns)
    points = _points(df, columns).persist()
    try:
        seeds = _seeds(points, d, most)
        mixtures = {k: Mixture(np.full(k, 1 / k), seeds[:k].copy(), np.array([np.eye(d)] * k)) for k in range(1, len(seeds) + 1)}
        found: dict[int, tuple[float, int]] = {}
        settled: dict[int, int] = {}
        n = 0
        for step in range(steps):
            going = {k: m for k, m in mixtures.items() if k not in settled}
            if not going:
                break
            for k, (loglik, n, sums) in _pass(points, d, going).items():
                if k in found and loglik - found[k][0] < 1e-5 * abs(loglik):
                    settled[k] = step
                else:
                    mixtures[k] = _mixture(sums, d, ridge)
                found[k] = (loglik, n)
        return pd.DataFrame([(k, mixtures[k].bic(v, n), v, settled.get(k, steps)) for k, (v, n) in sorted(found.items())], columns=["k", "bic", "loglik", "steps"])
    finally:
        points.unpersist()


def mode_count_by_data(df: DataFrame, columns: list[str], most: int = 5) -> int:
    """The number of Gaussians of the least bic; 0 without rows."""
    made = mixture_counts(df, columns, most)
    return int(made.loc[made["bic"].idxmin(), "k"]) if len(made) else 0


__all__ = ["Mixture", "conserved", "mixture_counts", "mixture_of", "mode_count_by_data", "numbered", "spectra", "spectral_content"]
