"""Spatial hashing into a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.config import PER_BUCKET
from voxelweave.functions.geometry import bucket, linear_bucket
from voxelweave.lineage import shuffled
from voxelweave.operators.prefix import running_sum

INDEXES = ("ci", "cj", "ck")


def grid_size(n_points: int, dim: int) -> int:
    return max(1, int((n_points / PER_BUCKET) ** (1.0 / dim) + 0.5))


def bins(points: DataFrame, axes: tuple[str, ...], n: int, low: float = 0.0, side: float = 1.0) -> DataFrame:
    """Adds ci, cj[, ck] and the linear bucket number cell, for the box [low, low + side]."""
    at = [(F.col(a) - low) / side if (low, side) != (0.0, 1.0) else F.col(a) for a in axes]
    rows = points.withColumns({i: bucket(c, n) for i, c in zip(INDEXES, at)})
    return rows.withColumn("cell", linear_bucket([F.col(i) for i in INDEXES[: len(axes)]], n))


def counts(binned: DataFrame) -> DataFrame:
    return binned.groupBy("cell").agg(F.count("*").alias("n_points"))


def offsets(binned: DataFrame) -> DataFrame:
    """cell, n_points, first: how many points lie in the non-empty buckets before."""
    return running_sum(counts(binned), "cell", F.col("n_points"), "first")


def sorted_positions(binned: DataFrame) -> DataFrame:
    """Adds sorted_pos: the place in the order by bucket, then id."""
    inside = Window.partitionBy("cell").orderBy("id")
    ranked = binned.withColumn("__k", F.row_number().over(inside) - 1)
    return ranked.join(shuffled(offsets(binned).select("cell", "first")), "cell").withColumn("sorted_pos", F.col("first") + F.col("__k")).drop("__k", "first")


def unpermuted(rows: DataFrame, placed: DataFrame, *columns: str) -> DataFrame:
    """rows with their columns of sorted positions turned back into ids. placed: sorted_positions' result."""
    for c in columns:
        back = placed.select(F.col("sorted_pos").alias(c), F.col("id").alias("__id"))
        rows = rows.join(shuffled(back), c).drop(c).withColumnRenamed("__id", c)
    return rows
