"""Queries of signatures that are aggregates, with SQL for the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.plans.registry import EVENTS, FIELD, FIELD_SQL, W, field, query
from galena.plans.series import ONE
from galena.sources.tables import table

_SIZE = 16
_TAPER = f"(0.5 - 0.5 * cos(2 * pi() * p / {_SIZE}))"


def _dft_sql(by: str, order: str) -> str:
    """Mean powers of the segments of one series for each `by`, by the definition of the transform."""
    keys = f"{by}, " if by else ""
    return f"""
        o AS (SELECT {keys}value, row_number() OVER {order} - 1 AS i FROM events), h AS (SELECT unnest([i // {_SIZE // 2}, i // {_SIZE // 2} - 1]) AS seg, * FROM o),
        s AS (SELECT {keys}seg, i - seg * {_SIZE // 2} AS p, value - avg(value) OVER (PARTITION BY {keys}seg) AS v, count(*) OVER (PARTITION BY {keys}seg) AS n FROM h WHERE seg >= 0),
        f AS (SELECT {keys}seg, k AS bin, power(sum(v * {_TAPER} * cos(2 * pi() * k * p / {_SIZE})), 2) + power(sum(v * {_TAPER} * sin(2 * pi() * k * p / {_SIZE})), 2) AS power FROM s, range(1, {_SIZE // 2 + 1}) t(k) WHERE n = {_SIZE} GROUP BY {keys}seg, k)
    """


@query("spectra_by_user", f"WITH {_dft_sql('user_id', W)} SELECT user_id, CAST(bin AS INTEGER) AS bin, round(avg(power), 4) AS power, count(*) AS segments FROM f GROUP BY user_id, bin")
def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean powers of each user's values, in short segments that overlap by half."""
    from galena.operators.aggregated import spectra

    rows = spectra(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "value", EVENTS, _SIZE)
    return rows.withColumn("power", F.round("power", 4))


@query("spectral_one_series", f"WITH {_dft_sql('', '(ORDER BY ts, event_id)')}, m AS (SELECT bin, avg(power) AS power FROM f GROUP BY bin) SELECT round(max(power) / avg(power), 6) AS peak, round(exp(avg(ln(power))) / avg(power), 6) AS flatness, round(arg_max(bin, power) / {_SIZE}.0, 6) AS frequency FROM m")
def _one_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, numbered by ranges."""
    from galena.operators.aggregated import spectral_content

    found = spectral_content(table(spark, sf_dir, "events").select("ts", "event_id", "value"), "value", ONE, _SIZE)
    return found.select(*[F.round(c, 6).alias(c) for c in ("peak", "flatness", "frequency")])


@query("conserved_by_type", "SELECT event_type, 1 AS degree, round(1 - abs(corr(value, event_id)), 7) AS variance, 1.0::DOUBLE AS independent FROM events GROUP BY event_type")
def _conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least variance of a combination of two columns: of degree one it is what their correlation leaves."""
    from galena.operators.aggregated import conserved

    rows = conserved(table(spark, sf_dir, "events"), ["value", "event_id"], ["event_type"], 1)
    return rows.select("event_type", "degree", F.round("variance", 7).alias("variance"), F.round("independent", 7).alias("independent"))


_BIC = "round(-2 * sum(ln(density)) + (3 * {k} - 1) * ln(count(*)), 3)"
_PDF = "exp(-(x - m) * (x - m) / 2 / s) / sqrt(2 * pi() * s)"


@query(
    "mixture_bic",
    f"""WITH v AS (SELECT l_returnflag AS g, (l_extendedprice - avg(l_extendedprice) OVER ()) / (stddev_pop(l_extendedprice) OVER () + 1e-12) AS x FROM lineitem),
    parts AS (SELECT g, avg(x) AS m, var_pop(x) + 1e-4 AS s, count(*) / (SELECT count(*) FROM v) AS w FROM v GROUP BY g), whole AS (SELECT avg(x) AS m, var_pop(x) + 1e-4 AS s FROM v),
    three AS (SELECT (SELECT sum(w * {_PDF}) FROM parts) AS density FROM v), one AS (SELECT {_PDF} AS density FROM v, whole)
    SELECT 3 AS k, {_BIC.format(k=3)} AS bic FROM three UNION ALL SELECT 1, {_BIC.format(k=1)} FROM one""",
)
def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criterion of one Gaussian, and of one for each flag: responsibilities are given, so SQL can follow."""
    from galena.operators.aggregated import mixture_of

    rows, found = table(spark, sf_dir, "lineitem"), []
    for k, group in ((3, F.col("l_returnflag")), (1, F.lit(1))):
        mixture, loglik, n = mixture_of(rows, ["l_extendedprice"], group)
        found.append((k, round(float(mixture.bic(loglik, n)), 3)))
    return spark.createDataFrame(found, "k int, bic double")


@query("mixture_modes")
def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many Gaussians two columns ask for, fitted over all rows."""
    from galena.operators.aggregated import mixture_counts

    made = mixture_counts(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 3, 20)
    return spark.createDataFrame([(int(r.k), float(r.bic), float(r.loglik)) for r in made.itertuples()], "k int, bic double, loglik double")


@query(
    "neighbours_in_time",
    "WITH o AS (SELECT value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c, row_number() OVER w - 1 AS i FROM events WINDOW w AS (ORDER BY ts, event_id)), p AS (SELECT * FROM o WHERE c IS NOT NULL)"
    " SELECT x.i, round(min((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)), 6) AS d FROM p x JOIN p y ON abs(x.i - y.i) > 10 GROUP BY x.i",
)
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every three events in a row the squared distance to the nearest others that are more than ten events away."""
    from galena.operators.neighbours import embedded, nearest_neighbours_apart

    points = embedded(table(spark, sf_dir, "events").select("ts", "event_id", "value"), "value", ONE)
    return nearest_neighbours_apart(points, 10, 1024).select("i", F.round("d", 6).alias("d"))


@query("lyapunov_one_series")
def _exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fast neighbours among all events part."""
    from galena.operators.neighbours import lyapunov_by_data

    found = lyapunov_by_data(table(spark, sf_dir, "events").select("ts", "event_id", "value"), "value", ONE)
    return spark.createDataFrame([("value", found)], "series string, exponent double")


@query(
    "field_both_axes",
    f"WITH {FIELD_SQL}, l AS (SELECT t, x, u, lag(u) OVER r - 2 * u + lead(u) OVER r AS lap FROM g WINDOW r AS (PARTITION BY t ORDER BY x)), s AS (SELECT *, lap - lag(lap, 3) OVER p AS d, CASE WHEN row_number() OVER p >= 4 THEN avg(u) OVER (PARTITION BY x ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS m, u - lag(u, 2) OVER (PARTITION BY t ORDER BY x) AS side FROM l WINDOW p AS (PARTITION BY x ORDER BY t))"
    " SELECT t, x, round(d + 0.5 * m, 6) + 0.0 AS later, round(side * m, 6) + 0.0 AS beside FROM s",
)
def _both_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a field: how a stencil's values change in time, a mean along time, and a difference along space, in one tree each."""
    from galena.operators import measures as M
    from galena.operators.lowering import evaluate
    from galena.operators.measures import Linear
    from galena.operators.tree import BinOp, Const, FunctionalOp, FunctionalOp2D, Var

    u = Var("u")
    along = lambda mu, axis, arg=u: FunctionalOp(Linear(mu, axis), (arg,))
    mean = along(M.roll_mean(4), "time")
    trees = {"later": BinOp("add", along(M.diff(3), "time", FunctionalOp2D(M.laplacian(), u)), BinOp("mul", Const(0.5), mean)), "beside": BinOp("mul", along(M.diff(2), "space"), mean)}
    made = evaluate(field(spark, sf_dir), trees, FIELD, keep=["t", "x"])
    return made.select("t", "x", *[F.round(c, 6).alias(c) for c in trees])
