"""The whole run: initial conditions, periodic mesh, time steps, mesh file."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from voxelweave.config import MeshConfig
from voxelweave.lineage import materialise
from voxelweave.operators import hydro, voronoi
from voxelweave.sources import sinks
from voxelweave.sources.params import Params
from voxelweave.sources.points import checked, scan


log = logging.getLogger(__name__)


@dataclass
class Run:
    cells: DataFrame
    images: DataFrame
    faces: hydro.Faces
    state: DataFrame
    steps: int
    time: float


def start(points: DataFrame, config: MeshConfig, keep: bool = True) -> Run:
    """Mesh and prepared faces for points with state, at time 0."""
    points = materialise(checked(points, config), "points")
    cells, images = voronoi.periodic_mesh(points, config)
    log.info("the mesh has %d cells", cells.count())
    faces = hydro.prepared(voronoi.adjacency(cells, images), cells, config, keep=keep)
    state = points.select("id", "rho", *config.velocities, "E")
    return Run(cells, images, faces, state, 0, 0.0)


def report(steps: int, time: float, dt: float) -> None:
    """A line for each third step."""
    if steps % 3 == 0:
        log.info("step %d, t = %g, dt = %g", steps, time, dt)


def simulate(points: DataFrame, config: MeshConfig, max_steps: int = 10_000) -> Run:
    run = start(points, config)
    state, steps, time = hydro.evolve(run.faces, run.cells, run.state, config, max_steps, report)
    run.faces.unpersist()
    return Run(run.cells, run.images, run.faces, state, steps, time)


def run_params(spark: SparkSession, params: Params, config: MeshConfig, file_format: str = "parquet") -> Run:
    """ic_file, output_directory and output_mesh_file name the input and the output."""
    run = simulate(scan(spark, params.get("ic_file"), config, file_format), config)
    sinks.write_mesh(f"{params.get('output_directory')}/{params.get('output_mesh_file')}", run.cells, run.images, run.state, config)
    return run
