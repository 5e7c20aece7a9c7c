"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds.

Each query runs once after a warm-up on a small table and is timed up to its last row (written to the noop sink).
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from dataclasses import replace

from voxelweave.lineage import materialise
from voxelweave.operators import grid, hydro, knn, voronoi
from voxelweave.plans import catalogue, simulation
from voxelweave.session import get_spark
from voxelweave.sources import points


def events(spark, sf_dir):
    return points.from_keys(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")


def knn_events(spark, sf_dir):
    return knn.knn(events(spark, sf_dir), 8).select("id", "rank", "nb_id", "d2")


def grid_events(spark, sf_dir):
    p = events(spark, sf_dir)
    return grid.sorted_positions(grid.bins(p, ("x", "y"), grid.grid_size(p.count(), 2)))


def mesh_3d(spark, sf_dir):
    p = materialise(catalogue.customers(spark, sf_dir, 3), "solid")
    cells, _ = voronoi.periodic_mesh(p, replace(catalogue.SOLID, buff=0.1))
    return cells.select("cell_id", "volume")


def ten_steps(spark, sf_dir):
    """Ten steps on a finished mesh; making the mesh isn't timed."""
    run = simulation.start(points.sod(catalogue.customers(spark, sf_dir), catalogue.FLAT), catalogue.FLAT)
    run.faces.own.count(), run.faces.edges.count()

    def steps():
        state = run.state
        for _ in range(10):
            state = materialise(hydro.step(run.faces, state.select("id", "rho", "vx", "vy", "E"), 1e-5, catalogue.FLAT), "state")
        run.faces.unpersist()
        return state

    return steps


QUERIES = {
    "grid_sort_events": grid_events,
    "knn_2d_customers": catalogue.q06_knn_2d,
    "knn_2d_events": knn_events,
    "knn_3d_customers": catalogue.q07_knn_3d,
    "mesh_2d_customers": catalogue.q14_cell_area_2d,
    "hll_flux": catalogue.q23_hll_flux,
    "hydro_step_with_mesh": catalogue.q25_hydro_step,
    "mesh_3d_customers": mesh_3d,
    "hydro_ten_steps": ten_steps,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    settings = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="voxelweave-bench-")}
    spark = get_spark(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **settings)
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(small):
        for name in ("mesh_2d_customers", "knn_2d_events"):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    took = {}
    for name, query in QUERIES.items():
        began = time.time()
        df = query(spark, sf_dir)
        if callable(df):  # what came before isn't timed
            began = time.time()
            df = df()
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
