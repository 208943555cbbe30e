"""Readers and writers, all through Spark's own sources."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialised(df: DataFrame, tidy: bool = False) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names, read again; where that is unset, in one of this process on a local master, and an error on a cluster.

    tidy: the shuffles that made it are deleted when it is written.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    if tidy:
        spark.conf.set(CLEANUP, "true")  # as in galena.llm.session
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(CLEANUP, before)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def daily_flow(spark: SparkSession, path: str) -> DataFrame:
    """(date, flow) of a daily-values JSON document (value.timeSeries[].values[].value[]); negative markers are missing."""
    point = "struct<dateTime:string,value:string>"
    schema = f"value struct<timeSeries:array<struct<values:array<struct<value:array<{point}>>>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    each = docs.select(F.explode("value.timeSeries").alias("s")).select(F.explode("s.values").alias("v")).select(F.explode("v.value").alias("p"))
    flow = F.try_to_number("p.value", F.lit("S999999999.999999")).cast("double")
    return each.select(F.to_date(F.substring("p.dateTime", 1, 10)).alias("date"), F.when(flow >= 0, flow).alias("flow"))


def daily_weather(spark: SparkSession, path: str) -> DataFrame:
    """(date, prcp, tmax, tmin) of a daily CSV whose lines before "year,yday,..." are remarks."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d{4}\s*,"))
    day = F.date_add(F.make_date(F.trim(parts[0]).cast("int"), F.lit(1), F.lit(1)), F.trim(parts[1]).cast("int") - 1)
    number = lambda i: F.trim(parts[i]).cast("double")
    return rows.select(day.alias("date"), number(2).alias("prcp"), number(3).alias("tmax"), number(4).alias("tmin"))


def basin(weather: DataFrame, flow: DataFrame, lags: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    """Weather and flow of the same days, with mean temperature, log flow and earlier rain."""
    from pyspark.sql import Window

    both = weather.join(flow, "date")
    w = Window.orderBy("date")  # one basin's days
    return both.select("*", ((F.col("tmax") + F.col("tmin")) / 2).alias("tmean"), F.log(F.greatest(F.col("flow"), F.lit(1e-6))).alias("log_q"), *[F.lag("prcp", k).over(w).alias(f"prcp_lag{k}") for k in lags])


def candles(spark: SparkSession, path: str) -> DataFrame:
    """(ts, open, high, low, close, volume) of JSON arrays of rows [ms, o, h, l, c, v, ...], a page a line."""
    pages = spark.read.text(path).select(F.from_json("value", "array<array<string>>").alias("rows"))
    r = F.col("r")
    return pages.select(F.explode("rows").alias("r")).select(F.timestamp_millis(r[0].cast("long")).alias("ts"), *[r[i].cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)])


def candle_features(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Returns over several spans, their sizes, volatility, momentum, volume change and range; targets: the next return and its size."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(keys or [])).orderBy("ts")
    back = lambda k: F.log(F.col("close") / F.lag("close", k).over(w))
    df = df.withColumn("r1", back(1))
    df = df.withColumns({**{f"r{k}": back(k) for k in (2, 3, 6, 12, 24)}, **{f"a{k}": F.abs(F.lag("r1", k).over(w)) for k in (1, 2, 3)}, **{f"vol{k}": F.stddev_pop("r1").over(w.rowsBetween(-(k - 1), 0)) for k in (6, 12, 24)}})
    return df.withColumns({"mom6": F.avg("r1").over(w.rowsBetween(-5, 0)), "lv": F.log(F.col("volume") + 1), "dlv": F.log(F.col("volume") + 1) - F.log(F.lag("volume", 1).over(w) + 1), "rng": (F.col("high") - F.col("low")) / F.col("close"), "next_r": F.lead("r1", 1).over(w), "next_a": F.abs(F.lead("r1", 1).over(w))})


def grid_rows(df: DataFrame, values: str = "u") -> DataFrame:
    """A dense field (t, array over x) as long rows (t, x, value)."""
    return df.select("t", F.posexplode(values).alias("x", values))


def dense_rows(df: DataFrame, value: str = "u") -> DataFrame:
    """Long rows (t, x, value) as a dense field (t, array over x in order)."""
    return df.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", value))), lambda s: s[value]).alias(value))
