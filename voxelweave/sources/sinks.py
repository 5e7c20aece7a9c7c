"""Mesh, state and neighbour tables as Parquet folders."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.config import MAX_RING, MeshConfig
from voxelweave.lineage import shuffled
from voxelweave.operators import grid, voronoi

log = logging.getLogger(__name__)


def write_mesh(path: str, cells: DataFrame, images: DataFrame, state: DataFrame, config: MeshConfig, store_edge_coords: bool = False) -> None:
    """header (one row), cells, faces and hydro below path; what is there is replaced.

    Rows are range-partitioned by cell, so readers of a cell range open few files. cells and faces are those of the points
    themselves. If ``cells`` has cells of images too (periodic_mesh with cut_images), faces_all has the faces of all.
    """
    spark, axes = cells.sparkSession, config.axes
    own = cells.join(shuffled(images.select(F.col("ghost_id").alias("cell_id"))), "cell_id", "left_anti")
    n, n_all = own.count(), cells.count()
    header = spark.range(1).select(F.lit(config.dim).alias("dimension"), F.lit(1.0).alias("extent"), F.lit(n).alias("n"), F.lit(config.k).alias("k"), F.lit(MAX_RING + 1).alias("nmax"), F.lit(0).alias("seed"), F.lit(store_edge_coords).alias("store_edge_coords"))
    header.coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    out = own.select("cell_id", *(f"seed_{a}" for a in axes), "volume", F.size("faces").alias("face_count"), "status")
    out.repartitionByRange("cell_id").sortWithinPartitions("cell_id").write.mode("overwrite").parquet(f"{path}/cells")
    log.info("wrote %d cells to %s", n, path)
    names = ["cell_id", "face_no", "neighbor_cell", "src_id", *("nx", "ny", "nz")[: config.dim], "area"] + ["verts"] * store_edge_coords
    for name, some in [("faces", own)] + [("faces_all", cells)] * (n_all > n):
        adj = voronoi.adjacency(some, images).select(*names)
        adj.repartitionByRange("cell_id").sortWithinPartitions("cell_id", "face_no").write.mode("overwrite").parquet(f"{path}/{name}")
        log.info("wrote %s to %s", name, path)
    state.select("id", "rho", *config.velocities, "E").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/hydro")


def read_mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("header", "cells", "faces", "hydro")}


def write_knn(path: str, points: DataFrame, found: DataFrame, k: int, config: MeshConfig) -> None:
    """header, points (in grid order, with the permutation) and neighbours as sorted positions below path."""
    n = points.count()
    binned = grid.bins(points, config.axes, grid.grid_size(n, config.dim))
    placed = grid.sorted_positions(binned).select("id", *config.axes, "sorted_pos")
    spark = points.sparkSession
    spark.range(1).select(F.lit(config.dim).alias("dimension"), F.lit(n).alias("num_points"), F.lit(k).alias("k")).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    placed.repartitionByRange("sorted_pos").sortWithinPartitions("sorted_pos").write.mode("overwrite").parquet(f"{path}/points")
    own, other = placed.select("id", "sorted_pos"), placed.select(F.col("id").alias("nb_id"), F.col("sorted_pos").alias("nb_pos"))
    rows = found.select("id", "rank", "nb_id", "d2").join(shuffled(own), "id").join(shuffled(other), "nb_id").select("sorted_pos", "rank", "nb_pos", "d2")
    rows.repartitionByRange("sorted_pos").sortWithinPartitions("sorted_pos", "rank").write.mode("overwrite").parquet(f"{path}/nearest")
    log.info("wrote the neighbours of %d points to %s", n, path)
