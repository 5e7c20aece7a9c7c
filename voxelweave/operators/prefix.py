"""Global running sums of two levels: totals of ranges of the order, then rows within a range.

The ranges are partitions of equal size by a range partitioner, whatever the values of the order are, so no task holds more
than one partition's rows or one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.lineage import materialise


def running_sum(df: DataFrame, order: str, value: Column, out: str, then: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds out: the sum of value over the rows before, by ``order``, then the columns ``then``."""
    rows = df.withColumn("__v", value)
    rows = rows.repartitionByRange(ranges, order, *then) if ranges else rows.repartitionByRange(order, *then)
    # written once: a second run of the partitioner could draw other bounds
    rows = materialise(rows.withColumn("__range", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("__range").agg(F.sum("__v").alias("__t"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("__range", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return rows.join(totals, "__range").withColumn(out, (F.col("__base") + F.col("__in")).cast("long")).drop("__v", "__range", "__in", "__base")
