"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the source for each file of a table that is made from it, and files for each core at least; the same for light
#: tables, with a few numbers for each row of the source at most.
FILE_BYTES, FILES_PER_CORE = 32 << 20, 4
LIGHT_BYTES, LIGHT_PER_CORE = 64 << 20, 4


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; a cluster has no folder of its own
    that all executors see, so there it must be named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="voxelweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def most_files(source: DataFrame, light: bool = False) -> int:
    """In how many files at most to write what is made from ``source``, by the size of its files."""
    least, each = (LIGHT_PER_CORE, LIGHT_BYTES) if light else (FILES_PER_CORE, FILE_BYTES)
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least * source.sparkSession.sparkContext.defaultParallelism, min(size // each, (1 << 31) - 1))


def few_files(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, made from ``source``, with partitions joined so that it is written in as many files as its size asks for."""
    return df.coalesce(most_files(source))


def materialise(df: DataFrame, name: str, source: DataFrame | None = None, light: bool = False) -> DataFrame:
    """Writes df as Parquet and reads it back, so that a lost executor costs no recomputation of what came before.

    With ``source``, a table of known size that df is made from, partitions are joined into no more files than that size
    asks for.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df if source is None else df.coalesce(most_files(source, light))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of an equi-join that deals both sides out by the key. Sizes are estimated by compressed files, so Spark
    may else broadcast a table of many rows through the driver."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Deletes the table of a materialised df that nothing reads any more."""
    path = getattr(df, "scratch", None) if "scratch" in vars(df) else None
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
