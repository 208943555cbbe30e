"""Reading inputs and cutting lineage; every path goes through Spark's own readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where the setting is empty, one of this process on a local master, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later jobs restart from the files, not from the inputs.

    The shuffles that made it are deleted when it is written. Its own files go by forget(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # only queries that begin meanwhile see it, and none needs its shuffles once it has ended
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    hadoop, system = _files(spark, path)
    system.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop, system = _files(spark, path)
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return path


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(id(df), None):
            hadoop, system = _files(df.sparkSession, path)
            system.delete(hadoop, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession, size: int = 0, part: int = 64 << 20) -> int:
    """The session's number of shuffle partitions, or as many as `size` bytes of input need at `part` each, if that is more."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part))
