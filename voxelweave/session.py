"""A session with the settings the engine expects. On a cluster the master and sizes come from spark-submit."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("voxelweave")
    if master:
        builder = builder.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if shuffle_partitions:
        own["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=own | settings).getOrCreate()
