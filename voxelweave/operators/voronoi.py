"""Voronoi meshes: cells and faces as DataFrames.

Each cell's nearest points are gathered (k of them, a fixed bound) and an Arrow kernel cuts the cell. Cells whose
security radius isn't reached search again with twice as many neighbours, up to k_max; then they keep their status.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.config import STATUS, MeshConfig
from voxelweave.functions.geometry import rescale_down, rescale_up
from voxelweave.lineage import discard, materialise, shuffled
from voxelweave.operators import cellkernel, ghosts
from voxelweave.operators.knn import knn
from voxelweave.operators.prefix import running_sum

log = logging.getLogger(__name__)

FACE = "struct<face_no: int, neighbor_cell: long, nx: double, ny: double, nz: double, area: double, verts: array<struct<x: double, y: double, z: double>>>"


def _kernel(config: MeshConfig, low: float, high: float):
    dim, axes = config.dim, config.axes
    cut = cellkernel.cut_polygons if dim == 2 else cellkernel.cut_polyhedra
    rows = 2048 if dim == 2 else 256
    limits = (config.max_planes, config.max_vertices) if config.strict else None

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                near = part.column(part.num_columns - 1)
                count = np.diff(near.offsets.to_numpy())
                flat = near.flatten()
                place = np.arange(max(1, int(count.max(initial=0)))) < count[:, None]

                def padded(name, flat=flat, place=place):
                    out = np.zeros(place.shape, np.int64 if name == "nb_id" else float)
                    out[place] = flat.field(name).to_numpy(zero_copy_only=False)
                    return out

                seed = np.stack([part.column(1 + k).to_numpy() for k in range(dim)], axis=1)
                ids, d2 = padded("nb_id"), padded("d2")
                c = cut(seed, np.stack([padded(f"nb_{a}") for a in axes], axis=2), d2, count, low, high, limits)
                other = np.where(c.label < 0, c.label, ids[c.cell, c.label.clip(min=0)])
                faces = np.bincount(c.cell, minlength=part.num_rows)
                ends = np.append(0, np.cumsum(faces))
                number = np.arange(len(c.cell)) - ends[c.cell]
                corners = pa.StructArray.from_arrays([pa.array(c.verts[:, k]) for k in range(3)], names=["x", "y", "z"])
                verts = pa.ListArray.from_arrays(pa.array(c.first, pa.int32()), corners)
                columns = [pa.array(number, pa.int32()), pa.array(other, pa.int64()), *(pa.array(c.normal[:, k]) for k in range(3)), pa.array(c.area), verts]
                face = pa.StructArray.from_arrays(columns, names=["face_no", "neighbor_cell", "nx", "ny", "nz", "area", "verts"])
                kth = pa.array(d2[np.arange(len(count)), np.maximum(count - 1, 0)], mask=count == 0)
                status = pa.array(np.array(STATUS, object)[c.status], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(1 + k) for k in range(dim)), pa.array(c.volume), pa.array(c.far2), status, kth, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), face)], names=["cell_id", *(f"seed_{a}" for a in axes), "volume", "far2", "status", "kth_d2", "faces"])

    return run, "cell_id long, " + ", ".join(f"seed_{a} double" for a in axes) + f", volume double, far2 double, status string, kth_d2 double, faces array<{FACE}>"


def cut_cells(neighbours: DataFrame, config: MeshConfig, low: float, high: float) -> DataFrame:
    """cell_id, seed, volume, far2, status, kth_d2, faces (array): one row for each id of a knn table."""
    axes = config.axes
    near = F.array_sort(F.collect_list(F.struct("d2", "nb_id", *(f"nb_{a}" for a in axes))))
    rows = neighbours.groupBy("id").agg(*(F.first(a).alias(a) for a in axes), near.alias("near"))
    run, schema = _kernel(config, low, high)
    return rows.mapInArrow(run, schema)


def mesh(points: DataFrame, config: MeshConfig, asked: DataFrame | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Cells of ``asked`` (default all points) among ``points`` in the box [low, high]: cut_cells' columns."""
    k, open_rows, done = config.k, points if asked is None else asked, []
    while True:
        found = materialise(cut_cells(knn(points, k, config.dim, open_rows, low, high - low, config.strict), config, low, high), "cells")
        short = found.where("status = 'security_radius_not_reached'").select(F.col("cell_id").alias("id"))
        if k >= config.k_max or short.isEmpty():
            done.append(found)
            break
        done.append(found.where("status != 'security_radius_not_reached'"))
        open_rows = materialise(open_rows.join(shuffled(short), "id", "left_semi"), "cells-open")
        log.info("cells: %d need more than %d neighbours", open_rows.count(), k)
        k = min(2 * k, config.k_max)
    return reduce(DataFrame.unionByName, done)


def periodic_mesh(points: DataFrame, config: MeshConfig, through_unit_box: bool = False, cut_images: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, ghosts) of the points in the periodic unit box. Cells of images are cut on
    request only: nothing here needs them, and those next to the outer box may fail, which their status tells.

    through_unit_box scales the extended box into [0, 1] for cutting and back, as some bit patterns depend on it.
    """
    images = materialise(ghosts.ghosts(points, config.buff, config.dim), "ghosts")
    everything = ghosts.extended(points, images, config.dim)
    if not through_unit_box:
        cells = mesh(everything, config, None if cut_images else everything.where("not is_ghost"), -config.buff, 1.0 + config.buff)
        return check_failed(cells, config, images if cut_images else None), images
    scale = 1.0 / (1.0 + 2.0 * config.buff)
    small = everything.withColumns({a: rescale_down(F.col(a), scale) for a in config.axes})
    cells = mesh(small, config, None if cut_images else small.where("not is_ghost"))
    d, up = config.dim, 1.0 / scale
    vertex = lambda v: F.struct(*((rescale_up(v[a], scale) if a in config.axes else v[a]).alias(a) for a in ("x", "y", "z")))
    face = lambda f: F.struct(f["face_no"].alias("face_no"), f["neighbor_cell"].alias("neighbor_cell"), f["nx"].alias("nx"), f["ny"].alias("ny"), f["nz"].alias("nz"), (f["area"] * up ** (d - 1)).alias("area"), F.transform(f["verts"], vertex).alias("verts"))
    cells = cells.withColumns({**{f"seed_{a}": rescale_up(F.col(f"seed_{a}"), scale) for a in config.axes}, "volume": F.col("volume") * up**d, "far2": F.col("far2") * up**2, "kth_d2": F.col("kth_d2") * up**2, "faces": F.transform("faces", face)})
    return check_failed(cells, config, images if cut_images else None), images


def check_failed(cells: DataFrame, config: MeshConfig, images: DataFrame | None = None) -> DataFrame:
    """Raises, or leaves failed cells out, as the config says. Cells of images don't count."""
    if images is not None:
        ids = shuffled(images.select(F.col("ghost_id").alias("cell_id")))
        own = cells.join(ids, "cell_id", "left_anti")
        return check_failed(own, config).unionByName(cells.join(ids, "cell_id", "left_semi"))
    if config.on_failed_cell == "skip":
        return cells.where("status = 'success'")
    failed = {r["status"]: r["n"] for r in cells.where("status != 'success'").groupBy("status").agg(F.count("*").alias("n")).collect()}
    if failed:
        raise RuntimeError(f"cells failed: {failed}; raise k_max or buff")
    return cells


def faces(cells: DataFrame) -> DataFrame:
    """One row for each directed half-face: cell_id, face_no, neighbor_cell, normal (inward), area, verts."""
    return cells.select("cell_id", F.explode("faces").alias("f")).select("cell_id", "f.*")


def adjacency(cells: DataFrame, images: DataFrame) -> DataFrame:
    """faces with src_id: the neighbour, or the owner of the image that it is. Walls keep their negative number."""
    owner = images.select(F.col("ghost_id").alias("neighbor_cell"), "orig_id")
    return faces(cells).join(shuffled(owner), "neighbor_cell", "left").withColumn("src_id", F.coalesce("orig_id", "neighbor_cell")).drop("orig_id")


def csr(cells: DataFrame) -> DataFrame:
    """cell_id, face_count, face_ptr: how many faces the cells before have."""
    rows = cells.select("cell_id", F.size("faces").cast("long").alias("face_count"))
    return running_sum(rows, "cell_id", F.col("face_count"), "face_ptr")


def symmetry(adj: DataFrame, digits: int = 9) -> DataFrame:
    """n_faces, n_unmatched, n_walls: half-faces without a partner of equal size and opposite normal."""
    key = lambda sign: [F.round(sign * F.col(c), 6).alias(f"k{c}") for c in ("nx", "ny", "nz")]
    walls = adj.agg(F.count("*").alias("n_faces"), F.count_if(F.col("src_id") < 0).alias("n_walls"))
    a = adj.where("src_id >= 0").groupBy(F.col("cell_id").alias("a"), F.col("src_id").alias("b")).agg(F.count("*").alias("n"), F.sum("area").alias("s"), *(F.sum(F.col(c) * F.col("area")).alias(c) for c in ("nx", "ny", "nz")))
    b = a.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n2"), F.col("s").alias("s2"), *(F.col(c).alias(f"{c}2") for c in ("nx", "ny", "nz")))
    both = a.join(shuffled(b), ["a", "b"], "left")
    tolerance = 10.0**-digits
    same = (F.col("n") == F.col("n2")) & (F.abs(F.col("s") - F.col("s2")) < tolerance)
    for c in ("nx", "ny", "nz"):
        same = same & (F.abs(F.col(c) + F.col(f"{c}2")) < tolerance)
    return both.agg(F.sum(F.when(same, 0).otherwise(F.col("n"))).alias("n_unmatched")).crossJoin(walls).select("n_faces", F.coalesce("n_unmatched", F.lit(0)).alias("n_unmatched"), "n_walls")


def lloyd(points: DataFrame, config: MeshConfig, iterations: int = 1, extent: float = 1.0) -> DataFrame:
    """Moves each bounded cell's seed to the mean of its vertices, clipped to the box; others stay."""
    points = points.select("*")  # a frame of its own: the caller's table stays
    for _ in range(iterations):
        cells = mesh(points, config)
        rows = faces(cells)
        bounded = rows.groupBy("cell_id").agg(F.min("neighbor_cell").alias("least")).where("least >= 0").select("cell_id")
        if config.dim == 2:  # each vertex ends two edges: the edges' first points are all vertices once
            corner = rows.select("cell_id", F.col("verts")[0].alias("v"))
        else:
            corner = rows.select("cell_id", F.explode("verts").alias("v")).select("cell_id", F.struct(*(F.round(F.col(f"v.{a}"), 12).alias(a) for a in ("x", "y", "z"))).alias("v")).distinct()
        means = corner.join(shuffled(bounded), "cell_id", "left_semi").groupBy("cell_id").agg(*(F.avg(f"v.{a}").alias(f"m{a}") for a in config.axes))
        moved = points.join(shuffled(means), F.col("id") == F.col("cell_id"), "left")
        moved = moved.withColumns({a: F.least(F.lit(extent), F.greatest(F.lit(0.0), F.coalesce(F.col(f"m{a}"), F.col(a)))) for a in config.axes})
        before, points = points, materialise(moved.select(*points.columns), "lloyd")
        discard(before)
    return points
