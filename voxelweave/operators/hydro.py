"""First-order finite volumes for the compressible Euler equations on a fixed mesh.

The faces of a cell are one row, and stay where they are for all steps. A step sends each state along the mesh's edges (a
lean table, dealt out by the sending cell once) to the cells that need it; that is all that moves besides the states
themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.config import MeshConfig
from voxelweave.functions import gas
from voxelweave.functions.geometry import face_frame
from voxelweave.lineage import discard, materialise, shuffled

FLUX = gas.FLUX
FRAME = [f"{e}{a}" for e in "nmp" for a in "xyz"]


@dataclass
class Faces:
    """own: cell_id, volume, faces (array by face_no: src_id, area and the frame), dealt out by cell_id. edges: src_id,
    cell_id, face_no, dealt out by src_id. Both are kept; a lost part is made again from the mesh's tables."""

    own: DataFrame
    edges: DataFrame

    def unpersist(self) -> None:
        self.own.unpersist()
        self.edges.unpersist()


def state_columns(config: MeshConfig, prefix: str = ""):
    v = [F.col(prefix + c) for c in config.velocities] + [F.lit(0.0)] * (3 - config.dim)
    return [F.col(f"{prefix}rho"), *v, F.col(f"{prefix}E")]


def prepared(adj: DataFrame, cells: DataFrame, config: MeshConfig, parts: int | None = None, keep: bool = True) -> Faces:
    """Faces with their frames, made once for all steps. Normals point inward, or outward if the config says so. For a
    single step there is no need to keep them."""
    if adj.where("src_id < 0").limit(1).count():
        raise RuntimeError("a cell touches the outer box: the ghost layer is too thin (raise buff)")
    parts = parts or int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sign = 1.0 if config.normal_convention == "inward" else -1.0
    frame = face_frame([F.col(c) * F.lit(sign) for c in ("nx", "ny", "nz")])
    faces = adj.select("cell_id", "face_no", "src_id", "area", *(c.alias(name) for name, c in frame.items())).repartition(parts, "cell_id")
    faces = faces.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("face_no", "src_id", "area", *FRAME))).alias("faces"))
    own = faces.join(shuffled(cells.select("cell_id", "volume").repartition(parts, "cell_id")), "cell_id")
    edges = adj.select("src_id", "cell_id", "face_no").repartition(parts, "src_id")
    if keep:
        own, edges = (df.persist(StorageLevel.MEMORY_AND_DISK) for df in (own, edges))
        own.count(), edges.count()  # only a finished cache tells the planner how it is dealt out
    return Faces(own, edges)


def face_states(faces: Faces, state: DataFrame, config: MeshConfig) -> DataFrame:
    """A row for each half-face: cell_id, volume, area, the frame, and the states l_... of the cell and r_... beyond it."""
    names = ["rho", *config.velocities, "E"]
    sent = faces.edges.join(shuffled(state.select(F.col("id").alias("src_id"), *names)), "src_id", "left")
    beyond = sent.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("face_no", *names))).alias("beyond"))
    left = state.select(F.col("id").alias("cell_id"), *(F.col(c).alias(f"l_{c}") for c in names))
    rows = faces.own.join(shuffled(left), "cell_id").join(shuffled(beyond), "cell_id")
    rows = rows.select("cell_id", "volume", *(f"l_{c}" for c in names), F.explode(F.arrays_zip("faces", "beyond")).alias("f"))
    rows = rows.select("cell_id", "volume", F.col("f.faces.face_no").alias("face_no"), F.col("f.faces.area").alias("area"), *(F.col(f"f.faces.{c}").alias(c) for c in FRAME), *(f"l_{c}" for c in names), *(F.col(f"f.beyond.{c}").alias(f"r_{c}") for c in names))
    return rows.withColumns({"l_vz": F.lit(0.0), "r_vz": F.lit(0.0)}) if config.dim == 2 else rows


def step(faces: Faces, state: DataFrame, dt: float, config: MeshConfig) -> DataFrame:
    """The state after dt, with volume and the longest time step that each cell allows (dt) from there. Sums over a cell's
    faces run in face order, so they don't depend on the shuffle."""
    names = ["rho", *config.velocities, "E"]
    flux = gas.hll(face_states(faces, state, config), config.gamma, F.col("area")).select("cell_id", "volume", "face_no", *(f"l_{c}" for c in names), *FLUX)
    own = [F.first(c).alias(c) for c in ("volume", *(f"l_{c}" for c in names))]
    rows = flux.groupBy("cell_id").agg(*own, F.array_sort(F.collect_list(F.struct("face_no", *FLUX))).alias("fs"))
    total = lambda name: F.aggregate("fs", F.lit(0.0), lambda acc, f: acc + f[name])
    rows = rows.select(F.col("cell_id").alias("id"), "volume", *(F.col(f"l_{c}").alias(c) for c in names), *(total(name).alias(name) for name in FLUX))
    ratio = F.lit(dt) / F.nullif(F.col("volume"), F.lit(0.0))
    rho = F.col("rho") - ratio * F.col("f_rho")
    moved = {v: F.try_divide(F.col("rho") * F.col(v) - ratio * F.col(f), rho) for v, f in zip(config.velocities, ("f_x", "f_y", "f_z"))}
    rows = rows.select("id", rho.alias("rho"), *(c.alias(v) for v, c in moved.items()), (F.col("E") - ratio * F.col("f_E")).alias("E"), "volume")
    return rows.withColumn("dt", cell_step(config))


def cell_step(config: MeshConfig):
    return gas.time_step(state_columns(config), F.col("volume"), config.dim, config.gamma, config.cfl)


def time_steps(cells: DataFrame, state: DataFrame, config: MeshConfig) -> DataFrame:
    """id, dt for each cell."""
    rows = state.join(shuffled(cells.select(F.col("cell_id").alias("id"), "volume")), "id")
    return rows.select("id", cell_step(config).alias("dt"))


def global_step(steps: DataFrame) -> float:
    """The smallest of the cells' steps (column dt); NaN never wins."""
    least = steps.agg(F.min(F.when(~F.isnan("dt"), F.col("dt"))).alias("dt")).first()["dt"]
    return min(1e100, least) if least is not None else 1e100


def totals(cells: DataFrame, state: DataFrame, config: MeshConfig) -> DataFrame:
    """volume, mass, momentum and energy of all cells."""
    rows = state.join(shuffled(cells.select(F.col("cell_id").alias("id"), "volume")), "id")
    sums = {"volume": F.col("volume"), "mass": F.col("rho") * F.col("volume"), **{f"p_{v}": F.col("rho") * F.col(v) * F.col("volume") for v in config.velocities}, "energy": F.col("E") * F.col("volume")}
    return rows.agg(*(F.sum(c).alias(name) for name, c in sums.items()))


def evolve(faces: Faces, cells: DataFrame, state: DataFrame, config: MeshConfig, max_steps: int = 10_000, report=None) -> tuple[DataFrame, int, float]:
    """(state, steps, time) at t_end; the last step is cut to end there. Each step's state is a table of its own, which the
    next one replaces; its cells' time steps are made along with it. report(steps, time, dt), if given, is called after
    each step."""
    t, n, columns = 0.0, 0, ["id", "rho", *config.velocities, "E"]
    least = global_step(time_steps(cells, state, config)) if t < config.t_end else 0.0
    while t < config.t_end and n < max_steps:
        dt = min(least, config.t_end - t)
        if dt <= 0:
            raise RuntimeError(f"the time step is {dt}")
        before, table = state, materialise(step(faces, state.select(*columns), dt, config), "state")
        if n:
            discard(before)
        state, least = table, global_step(table)
        t, n = t + dt, n + 1
        if report:
            report(n, t, dt)
    if t < config.t_end:
        raise RuntimeError(f"t is {t}, below t_end {config.t_end}, after {n} steps")
    return state.select(*columns), n, t
