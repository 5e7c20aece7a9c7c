"""Registered queries over the provided tables, one or more for each operator of the engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.config import MeshConfig
from voxelweave.functions import gas
from voxelweave.functions.geometry import cross3, det2, det3, det4, dist2, dot3, dot4, face_frame, halfplane, in_conflict, meeting_point, meeting_point3, minmax3, minus4, mul3, plus4, point3, references_plane, rescale_down, rescale_up
from voxelweave.lineage import materialise, scratch_path, shuffled
from voxelweave.operators import ghosts as ghost_ops
from voxelweave.operators import grid, hydro, voronoi
from voxelweave.operators import knn as knn_ops
from voxelweave.plans import oracle, simulation
from voxelweave.sources import params, points, sinks

BUFF = 0.12
FLAT = MeshConfig(dim=2, k=24, buff=BUFF)
SOLID = MeshConfig(dim=3, k=48, k_max=190, buff=0.2)


def customers(spark: SparkSession, sf_dir: str, dim: int = 2) -> DataFrame:
    return points.from_keys(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", dim)


def state_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, rho, vx, vy, vz, E from customer's columns."""
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("id"), (F.lit(0.5) + (F.col("c_acctbal") + 1000.0) / 11000.0).alias("rho"), ((F.col("c_nationkey") - 12).cast("double") / 100.0).alias("vx"), ((key % 11 - 5).cast("double") / 50.0).alias("vy"), ((key % 7 - 3).cast("double") / 50.0).alias("vz"), (F.lit(1.0) + (key % 13).cast("double") / 10.0).alias("E"))


def with_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).join(shuffled(state_of(spark, sf_dir).drop("vz")), "id")


def flat_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return voronoi.periodic_mesh(customers(spark, sf_dir), FLAT)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


# ---------------------------------------------------------------- points, grid, neighbours


def q01_points(spark, sf_dir):
    sod = points.sod(customers(spark, sf_dir), FLAT)
    return sod.select("id", "x", "y", "rho", "vx", "vy", F.round("E", 9).alias("energy"))


def q01b_uniform_state(spark, sf_dir):
    made = points.uniform(spark, 1000, FLAT)
    inside = (F.col("x") >= 0) & (F.col("x") < 1) & (F.col("y") >= 0) & (F.col("y") < 1)
    return made.agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"), F.sum("rho").alias("rho"), F.sum("vx").alias("vx"), F.sum("E").alias("energy"))


def q01c_scan_checked(spark, sf_dir):
    path = scratch_path(spark, "ic")
    points.sod(customers(spark, sf_dir), FLAT).write.parquet(path)
    return points.scan(spark, path, FLAT).select("id", "x", "y", "rho", F.round("E", 9).alias("energy"))


def binned(spark, sf_dir, dim: int = 2):
    p = customers(spark, sf_dir, dim)
    return grid.bins(p, ("x", "y", "z")[:dim], grid.grid_size(p.count(), dim))


def q02_grid_bin(spark, sf_dir):
    return binned(spark, sf_dir).select("id", "ci", "cj", "cell")


def q02b_grid_bin_3d(spark, sf_dir):
    return binned(spark, sf_dir, 3).select("id", "ci", "cj", "ck", "cell")


def q03_grid_counts(spark, sf_dir):
    return grid.counts(binned(spark, sf_dir))


def q04_prefix_sum(spark, sf_dir):
    return grid.offsets(binned(spark, sf_dir))


def q05_permutation(spark, sf_dir):
    return grid.sorted_positions(binned(spark, sf_dir)).select("id", "cell", "sorted_pos")


def q06_knn_2d(spark, sf_dir):
    return knn_ops.knn(customers(spark, sf_dir), 8).select("id", "rank", "nb_id", "d2")


def q07_knn_3d(spark, sf_dir):
    return knn_ops.knn(customers(spark, sf_dir, 3), 8, 3).select("id", "rank", "nb_id", "d2")


def q07b_knn_clustered(spark, sf_dir):
    """Clustered data: the first two components of embeddings, scaled into the box."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xy")))
    e = e.groupBy("x", "y").agg(F.min("id").alias("id"))
    low = e.agg(*(f(a).alias(f"{f.__name__}_{a}") for a in "xy" for f in (F.min, F.max))).first()
    scaled = [((F.col(a) - low[f"min_{a}"]) / (low[f"max_{a}"] - low[f"min_{a}"])).alias(a) for a in "xy"]
    return knn_ops.knn(materialise(e.select("id", *scaled), "embed"), 8).select("id", "rank", "nb_id", "d2")


def q08_knn_verify(spark, sf_dir):
    p = materialise(customers(spark, sf_dir), "verify")
    return knn_ops.verify(knn_ops.knn(p, 8), p, 8)


# ---------------------------------------------------------------- images, planes, meshes


def q09_ghosts_2d(spark, sf_dir):
    return ghost_ops.ghosts(customers(spark, sf_dir), BUFF)


def q09b_extended(spark, sf_dir):
    p = customers(spark, sf_dir)
    return ghost_ops.extended(p, ghost_ops.ghosts(p, BUFF))


def q10_ghosts_3d(spark, sf_dir):
    return ghost_ops.ghosts(customers(spark, sf_dir, 3), 0.2, 3)


def q11_rescale(spark, sf_dir):
    scale = 1.0 / (1.0 + 2.0 * BUFF)
    down = customers(spark, sf_dir).withColumns({f"{a}_down": rescale_down(F.col(a), scale) for a in "xy"})
    up = down.withColumns({f"{a}_up": F.round(rescale_up(F.col(f"{a}_down"), scale), 12) for a in "xy"})
    return up.select("id", "x_down", "y_down", "x_up", "y_up")


def q12_halfplanes(spark, sf_dir):
    found = knn_ops.knn(customers(spark, sf_dir), 8)
    a, b, w = halfplane([F.col("x"), F.col("y")], [F.col("nb_x"), F.col("nb_y")])
    return found.select("id", "rank", a.alias("a"), b.alias("b"), w.alias("w"))


def q13_voronoi_vertices(spark, sf_dir):
    v = voronoi.faces(flat_mesh(spark, sf_dir)[0]).select("cell_id", F.col("verts")[0].alias("v"))
    return rounded(v.groupBy("cell_id").agg(F.count("*").alias("n_vertices"), F.avg("v.x").alias("mx"), F.avg("v.y").alias("my")), 9, "mx", "my")


def q14_cell_area_2d(spark, sf_dir):
    return rounded(flat_mesh(spark, sf_dir)[0].select("cell_id", "volume"), 10, "volume")


def q14b_rescaled_mesh(spark, sf_dir):
    cells, _ = voronoi.periodic_mesh(customers(spark, sf_dir), FLAT, through_unit_box=True)
    return rounded(cells.select("cell_id", "volume"), 10, "volume")


def q15_faces_2d(spark, sf_dir):
    adj = voronoi.adjacency(*flat_mesh(spark, sf_dir))
    return rounded(adj.select("cell_id", "neighbor_cell", "src_id", "nx", "ny", "area"), 8, "nx", "ny", "area")


def q16_face_symmetry(spark, sf_dir):
    return voronoi.symmetry(materialise(voronoi.adjacency(*flat_mesh(spark, sf_dir)), "adjacency"))


def q16b_face_closure(spark, sf_dir):
    adj = voronoi.adjacency(*flat_mesh(spark, sf_dir))
    sums = adj.groupBy("cell_id").agg(*(F.sum(F.col(c) * F.col("area")).alias(c) for c in ("nx", "ny")))
    return rounded(sums.select("cell_id", F.abs("nx").alias("sx"), F.abs("ny").alias("sy")), 10, "sx", "sy")


def q17_csr_offsets(spark, sf_dir):
    return voronoi.csr(flat_mesh(spark, sf_dir)[0])


def q18_security_radius(spark, sf_dir):
    cells = flat_mesh(spark, sf_dir)[0].select("cell_id", "far2", "kth_d2", (F.col("kth_d2") > 4 * F.col("far2")).alias("reached"))
    return rounded(cells, 12, "far2", "kth_d2")


def q19_mesh_3d_volume_sum(spark, sf_dir):
    p = materialise(customers(spark, sf_dir, 3), "solid")
    cells, images = voronoi.periodic_mesh(p, SOLID)
    check = voronoi.symmetry(materialise(voronoi.adjacency(cells, images), "adjacency"), digits=8)
    total = cells.agg(F.count("*").alias("n_cells"), F.round(F.sum("volume"), 8).alias("total_volume"))
    return total.crossJoin(check.select("n_unmatched", "n_walls"))


# ---------------------------------------------------------------- gas


def solid_state(s: str = "") -> list:
    return [F.col(f"{s}{c}") for c in ("rho", "vx", "vy", "vz", "E")]


def q20_pressure(spark, sf_dir):
    return state_of(spark, sf_dir).select("id", F.round(gas.pressure(solid_state(), FLAT.gamma), 10).alias("p"))


def q21_euler_flux(spark, sf_dir):
    flux = gas.euler_flux(solid_state(), FLAT.gamma)
    return rounded(state_of(spark, sf_dir).select("id", *(f.alias(f"f{k}") for k, f in enumerate(flux, 1))), 10, *(f"f{k}" for k in range(1, 6)))


def normals(df: DataFrame) -> DataFrame:
    """A normal of varying direction from the id; every thirteenth points along z."""
    i = F.col("id")
    along = i % 13 == 0
    return df.withColumns({"ax": F.when(along, 0.0).otherwise((i % 7).cast("double") - 2.5), "ay": F.when(along, 0.0).otherwise((i % 5).cast("double") - 1.5), "az": (i % 3).cast("double") - 0.5})


def q22_face_frame(spark, sf_dir):
    frame = face_frame([F.col("ax"), F.col("ay"), F.col("az")])
    return rounded(normals(state_of(spark, sf_dir)).select("id", *(c.alias(n) for n, c in frame.items())), 10, *frame)


def q23_hll_flux(spark, sf_dir):
    s = state_of(spark, sf_dir)
    left = normals(s.select("id", *(F.col(c).alias(f"l_{c}") for c in s.columns[1:])))
    right = s.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"r_{c}") for c in s.columns[1:]))
    rows = left.join(shuffled(right), "id").withColumns(face_frame([F.col("ax"), F.col("ay"), F.col("az")]))
    flux = gas.hll(rows, FLAT.gamma).select("id", *(F.col(c).alias(f"f{k}") for k, c in enumerate(gas.FLUX, 1)))
    return rounded(flux, 9, *(f"f{k}" for k in range(1, 6)))


def q24_cfl_dt(spark, sf_dir):
    cells, _ = flat_mesh(spark, sf_dir)
    return hydro.time_steps(cells, state_of(spark, sf_dir), FLAT).agg(F.round(F.least(F.min("dt"), F.lit(1e100)), 12).alias("dt"))


def q25_hydro_step(spark, sf_dir):
    run = simulation.start(with_states(spark, sf_dir), FLAT, keep=False)
    after = hydro.step(run.faces, run.state, 0.002, FLAT)
    return rounded(after.select("id", "rho", "vx", "vy", F.col("E").alias("energy")), 8, "rho", "vx", "vy", "energy")


def q25b_hydro_step_outward(spark, sf_dir):
    """With outward normals: rho and E of a flow at rest are the same, velocities have the opposite sign."""
    run = simulation.start(points.sod(customers(spark, sf_dir), FLAT), FLAT, keep=False)
    adj, out = voronoi.adjacency(run.cells, run.images), []
    for convention in ("inward", "outward"):  # of one mesh: normals are turned when its faces are prepared
        config = replace(FLAT, normal_convention=convention)
        faces = run.faces if convention == FLAT.normal_convention else hydro.prepared(adj, run.cells, config, keep=False)
        s = hydro.step(faces, run.state, 0.002, config)
        out.append(s.select("id", *(F.col(c).alias(f"{c}_{convention}") for c in ("rho", "vx", "vy", "E"))))
    both = out[0].join(shuffled(out[1]), "id")
    near = lambda a, b: F.abs(a - b) < 1e-12
    same = near(F.col("rho_inward"), F.col("rho_outward")) & near(F.col("E_inward"), F.col("E_outward")) & near(F.col("vx_inward"), -F.col("vx_outward")) & near(F.col("vy_inward"), -F.col("vy_outward"))
    return both.select("id", same.alias("mirrored"))


def q26_hydro_sod(spark, sf_dir):
    """The time loop up to one and a half of the first step's length: a whole step, then one that is cut to end there."""
    still = materialise(points.sod(customers(spark, sf_dir), FLAT), "sod")
    run = simulation.start(still, FLAT)
    config = replace(FLAT, t_end=1.5 * hydro.global_step(hydro.time_steps(run.cells, run.state, FLAT)))
    state, steps, time = hydro.evolve(run.faces, run.cells, run.state, config)
    run.faces.unpersist()
    return rounded(state.select("id", "rho", "vx", "vy", F.col("E").alias("energy")), 8, "rho", "vx", "vy", "energy")


def q27_conservation(spark, sf_dir):
    run = simulation.start(with_states(spark, sf_dir), FLAT)
    state, out = run.state, None
    for n in range(3):
        row = hydro.totals(run.cells, state, FLAT).withColumn("step", F.lit(n))
        row = rounded(row, 9, "volume", "mass", "p_vx", "p_vy", "energy")
        out = row if out is None else out.unionByName(row)
        state = materialise(hydro.step(run.faces, state, 0.002, FLAT).drop("volume", "dt"), "state")
    run.faces.unpersist()
    return out


def q27b_uniform_fixed_point(spark, sf_dir):
    """A uniform state doesn't change."""
    p = customers(spark, sf_dir).withColumns({"rho": F.lit(1.0), "vx": F.lit(0.1), "vy": F.lit(-0.2), "E": F.lit(1.0)})
    run = simulation.start(p, FLAT, keep=False)
    return rounded(hydro.step(run.faces, run.state, 0.01, FLAT).select("id", "rho", "vx", "vy", F.col("E").alias("energy")), 10, "rho", "vx", "vy", "energy")


# ---------------------------------------------------------------- parameters, relaxation, sinks

#: Lines with a comment, an inline comment, a value with =, a repeated key, a line without =, and blanks.
PARAM_LINES = ["# settings", "", "ic_file = ic.parquet", "  output_directory\t=  out dir  # where to", "expr = a=b", "k = 8", "no value here", "k=  24 ", "empty =", "\t# more"]


def q28_params_parse(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(PARAM_LINES)), "line_no int, value string")
    return params.parse_frame(lines)


def q28b_params_typed(spark, sf_dir):
    """Each typed getter on text that it can read, with what trails a number, and the names of the errors of others."""
    p = params.parse_lines(["n = 42 apples", "m = -7x", "d = 2.5e1z", "dot = .5", "yes = On", "no = FALSE", "odd = maybe"])

    def outcome(get, key):
        try:
            return repr(get(key)).lower()
        except (KeyError, ValueError) as e:
            return type(e).__name__

    asked = [("get_int", p.get_int, "n"), ("get_int", p.get_int, "m"), ("get_int", p.get_int, "odd"), ("get_double", p.get_double, "d"), ("get_double", p.get_double, "dot"), ("get_bool", p.get_bool, "yes"), ("get_bool", p.get_bool, "no"), ("get_bool", p.get_bool, "odd"), ("get", p.get, "none")]
    return spark.createDataFrame([(name, key, outcome(get, key)) for name, get, key in asked], "getter string, key string, outcome string")


def q29_lloyd_iteration(spark, sf_dir):
    p = materialise(customers(spark, sf_dir), "lloyd-in")
    return rounded(voronoi.lloyd(p, replace(FLAT, buff=0.0)), 9, "x", "y")


def written_mesh(spark, sf_dir) -> dict[str, DataFrame]:
    run = simulation.start(with_states(spark, sf_dir), FLAT, keep=False)
    path = scratch_path(spark, "mesh-sink")
    sinks.write_mesh(path, run.cells, run.images, run.state, FLAT, store_edge_coords=True)
    return sinks.read_mesh(spark, path)


def q30_mesh_sink_roundtrip(spark, sf_dir):
    back = written_mesh(spark, sf_dir)
    cells = back["cells"].agg(F.count("*").alias("n_cells"), F.round(F.sum("volume"), 9).alias("total_volume"), F.sum("face_count").alias("n_faces"))
    return cells.crossJoin(back["faces"].agg(F.count("*").alias("n_face_rows"))).crossJoin(back["hydro"].agg(F.count("*").alias("n_states"))).crossJoin(back["header"].select("dimension", "k"))


def q30b_mesh_file_header(spark, sf_dir):
    return written_mesh(spark, sf_dir)["header"]


def q30c_mesh_file_cells(spark, sf_dir):
    cells = written_mesh(spark, sf_dir)["cells"]
    return rounded(cells.withColumn("face_count", F.col("face_count").cast("long")), 10, "volume")


def q30d_mesh_file_faces(spark, sf_dir):
    """With the edges' ends in order, whichever comes first."""
    faces = written_mesh(spark, sf_dir)["faces"]
    ends = {"x0": F.array_min(F.col("verts.x")), "x1": F.array_max(F.col("verts.x")), "y0": F.array_min(F.col("verts.y")), "y1": F.array_max(F.col("verts.y"))}
    faces = faces.withColumns(ends).withColumn("face_no", F.col("face_no").cast("long")).drop("verts")
    return rounded(faces, 8, "nx", "ny", "area", *ends)


def q30e_mesh_file_hydro(spark, sf_dir):
    return written_mesh(spark, sf_dir)["hydro"].withColumnRenamed("E", "energy")


def q31_knn_sink_roundtrip(spark, sf_dir):
    p = customers(spark, sf_dir)
    path = scratch_path(spark, "knn-sink")
    sinks.write_knn(path, p, knn_ops.knn(p, 8), 8, FLAT)
    return spark.read.parquet(f"{path}/nearest").select("sorted_pos", "rank", "nb_pos")


def q32_unpermute(spark, sf_dir):
    """Neighbours found among sorted positions, turned back into ids."""
    placed = materialise(grid.sorted_positions(binned(spark, sf_dir)), "placed")
    found = knn_ops.knn(placed.select(F.col("sorted_pos").alias("id"), "x", "y"), 8)
    own = grid.unpermuted(found.select("id", "rank", "nb_id"), placed, "id", "nb_id")
    at = lambda s: customers(spark, sf_dir).select(*(F.col(c).alias(f"{s}{c}") for c in ("id", "x", "y")))
    both = own.join(shuffled(at("a_")), F.col("id") == F.col("a_id")).join(shuffled(at("b_")), F.col("nb_id") == F.col("b_id"))
    # equally distant neighbours come in the order of positions, so distances are returned, not ids
    return both.select("id", "rank", dist2([F.col("a_x"), F.col("a_y")], [F.col("b_x"), F.col("b_y")]).alias("d2"))


def q33_image_cells(spark, sf_dir):
    """Cells of images that lie well inside the outer box have their owners' volumes."""
    cells, images = voronoi.periodic_mesh(customers(spark, sf_dir), FLAT, cut_images=True)
    inner = images.where("x > -0.05 and x < 1.05 and y > -0.05 and y < 1.05").select(F.col("ghost_id").alias("cell_id"), "orig_id")
    volume = cells.select("cell_id", "volume")
    both = volume.join(shuffled(inner), "cell_id").join(shuffled(volume.select(F.col("cell_id").alias("orig_id"), F.col("volume").alias("own"))), "orig_id")
    return both.select("orig_id", "cell_id", (F.abs(F.col("volume") - F.col("own")) < 1e-10).alias("same"))


def q34_meeting_point_3d(spark, sf_dir):
    """The vertex of three planes through a known point."""
    s = normals(state_of(spark, sf_dir))
    at = [F.col("vx"), F.col("vy"), F.col("vz")]
    planes = []
    for a in ((1.0, 0.25, 0.0), (0.0, 1.0, 0.5), (0.125, 0.0, 1.0)):
        n = [F.lit(x) for x in a]
        planes.append([*n, -(n[0] * at[0] + n[1] * at[1] + n[2] * at[2])])
    return rounded(s.select("id", *(c.alias(n) for c, n in zip(meeting_point3(*planes), "xyz"))), 12, "x", "y", "z")


def q35_strict_mesh(spark, sf_dir):
    """Statuses under the storage limits of the defaults: evenly spread points keep well within them."""
    p = points.from_keys(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    cells, _ = voronoi.periodic_mesh(materialise(p, "strict"), replace(FLAT, strict=True))
    return cells.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 8).alias("volume"))


def q36_vector_algebra(spark, sf_dir):
    s = solid_state()
    a, b, c, d = [*s[1:4], s[0]], [s[0], s[4], *s[1:3]], [s[4], *s[1:3], F.lit(1.0)], [F.lit(0.5), s[3], s[0], s[4]]
    low, high = minmax3(*s[1:4])
    columns = {f"p{k}": x for k, x in enumerate(plus4(a, b))} | {f"m{k}": x for k, x in enumerate(minus4(a, b))} | {f"s{k}": x for k, x in enumerate(mul3(s[4], a))} | {f"c{k}": x for k, x in enumerate(cross3(a, b))}
    columns |= {"d3": dot3(a, b), "d4": dot4(a, b), "det2": det2([a[:2], b[:2]]), "det3": det3([a[:3], b[:3], c[:3]]), "det4": det4([a, b, c, d]), "low": low, "high": high} | {f"q{k}": x for k, x in enumerate(point3(s[1], s[2]))}
    return rounded(state_of(spark, sf_dir).select("id", *(x.alias(n) for n, x in columns.items())), 9, *columns)


def q37_conflicts(spark, sf_dir):
    """The vertex of each point's two nearest bisectors against all of its others: which would cut it off."""
    found = knn_ops.knn(customers(spark, sf_dir), 8)
    plane = halfplane([F.col("x"), F.col("y")], [F.col("nb_x"), F.col("nb_y")])
    planes = found.select("id", F.col("rank").cast("long").alias("rank"), *(c.alias(n) for n, c in zip("abw", plane)))
    side = lambda k: planes.where(F.col("rank") == k).select("id", *(F.col(c).alias(f"{c}{k}") for c in "abw"))
    v = meeting_point(*([F.col(f"{c}{k}") for c in "abw"] for k in (0, 1)))
    rows = planes.join(shuffled(side(0)), "id").join(shuffled(side(1)), "id").where(F.abs(F.col("a0") * F.col("b1") - F.col("a1") * F.col("b0")) > 1e-6)
    return rows.select("id", "rank", in_conflict([F.col(c) for c in "abw"], v).alias("conflict"), references_plane(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), F.col("rank")).alias("own"))


QUERIES = [f for name, f in sorted(globals().items()) if name.startswith("q") and name[1:3].isdigit()]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    o = oracle
    mesh = o.mesh(24, BUFF)
    scale = 1.0 / (1.0 + 2.0 * BUFF)
    z = lambda c, d: f"round({c}, {d}) + 0.0::double"  # noqa: E731  no negative zeros
    frame = """fr0 AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS al FROM nrm), fr1 AS (SELECT *, ax/al AS nx, ay/al AS ny, az/al AS nz FROM fr0),
fr2 AS (SELECT *, CASE WHEN nx = 0 AND ny = 0 THEN 1 ELSE -ny / nullif(sqrt(nx*nx+ny*ny), 0) END AS mx, CASE WHEN nx = 0 AND ny = 0 THEN 0 ELSE nx / nullif(sqrt(nx*nx+ny*ny), 0) END AS my, 0::double AS mz FROM fr1),
fr AS (SELECT *, ny*mz-nz*my AS px, nz*mx-nx*mz AS py, nx*my-ny*mx AS pz FROM fr2)"""
    normal = "CASE WHEN id % 13 = 0 THEN 0::double ELSE (id % 7)::double - 2.5 END AS ax, CASE WHEN id % 13 = 0 THEN 0::double ELSE (id % 5)::double - 1.5 END AS ay, (id % 3)::double - 0.5 AS az"
    sides = o.sides
    flat_state = o.STATE.replace("(c_custkey % 7 - 3)::double / 50::double AS vz", "0::double AS vz")
    dt = f"0.4::double * sqrt(volume / pi()) / (sqrt({o.GAMMA} * {o.pressure('')} / rho) + sqrt(vx*vx+vy*vy+vz*vz))"
    walls = "wall(nb_id, rank, a, b, w) AS (VALUES (-1, 1000, 1::double, 0::double, 0::double), (-2, 1001, -1::double, 0::double, 1::double), (-3, 1002, 0::double, 1::double, 0::double), (-4, 1003, 0::double, -1::double, 1::double))"
    sod = sod_rho = "CASE WHEN x < 0.5 THEN 1::double ELSE 0.125::double END AS rho"
    boxed = o.PLANES.replace("planes AS (", "planes0 AS (") + ", planes AS (SELECT * FROM planes0 UNION ALL SELECT id, nb_id, rank, 0::double, x, y, a, b, w FROM pts, wall)"
    vertices = o.VERTICES[: o.VERTICES.index("ring AS")].rstrip().rstrip(",")
    sod_state = f"state AS (SELECT id, {sod_rho}, 0::double AS vx, 0::double AS vy, 0::double AS vz, CASE WHEN x < 0.5 THEN 1::double / (5::double/3::double - 1) ELSE 0.1::double / (5::double/3::double - 1) END AS e FROM pts)"
    loop = f"t1 AS (SELECT min({dt}) AS dt FROM state JOIN cells ON cell_id = id), {o.step('state', 's1', '(SELECT dt FROM t1)')}, {o.step('s1', 's2', '0.5::double * (SELECT dt FROM t1)')}"
    numbered = "fn AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY rank) - 1 AS face_no FROM faces)"
    kept = [("ic_file", "ic.parquet"), ("output_directory", "out dir"), ("expr", "a=b"), ("k", "24"), ("empty", "")]
    energy = "round(CASE WHEN x < 0.5 THEN 1.5::double ELSE 0.15::double END, 9) AS energy"
    embed = "raw AS (SELECT min(vec_id) AS id, x, y FROM (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings) GROUP BY x, y), pts AS (SELECT id, (x - (SELECT min(x) FROM raw)) / ((SELECT max(x) FROM raw) - (SELECT min(x) FROM raw)) AS x, (y - (SELECT min(y) FROM raw)) / ((SELECT max(y) FROM raw) - (SELECT min(y) FROM raw)) AS y FROM raw)"
    return {
        "q01_points": f"WITH {o.pts()} SELECT id, x, y, {sod}, 0::double AS vx, 0::double AS vy, {energy} FROM pts",
        "q01b_uniform_state": "SELECT 1000::bigint AS n, 1000::bigint AS n_inside, 1000::double AS rho, 0::double AS vx, 1000::double AS energy",
        "q01c_scan_checked": f"WITH {o.pts()} SELECT id, x, y, {sod}, {energy} FROM pts",
        "q02_grid_bin": f"WITH {o.pts()}, {o.grid()} SELECT id, ci, cj, cell FROM binned",
        "q02b_grid_bin_3d": f"WITH {o.pts(dim=3)}, {o.grid(3)} SELECT id, ci, cj, ck, cell FROM binned",
        "q03_grid_counts": f"WITH {o.pts()}, {o.grid()} SELECT cell, count(*) AS n_points FROM binned GROUP BY cell",
        "q04_prefix_sum": f"WITH {o.pts()}, {o.grid()}, c AS (SELECT cell, count(*) AS n_points FROM binned GROUP BY cell) SELECT cell, n_points, (sum(n_points) OVER (ORDER BY cell) - n_points)::bigint AS first FROM c",
        "q05_permutation": f"WITH {o.pts()}, {o.grid()} SELECT id, cell, row_number() OVER (ORDER BY cell, id) - 1 AS sorted_pos FROM binned",
        "q06_knn_2d": f"WITH {o.pts()}, {o.knn(8)} SELECT id, rank, nb_id, d2 FROM knn",
        "q07_knn_3d": f"WITH {o.pts(dim=3)}, {o.knn(8, 3)} SELECT id, rank, nb_id, d2 FROM knn",
        "q07b_knn_clustered": f"WITH {embed}, {o.knn(8)} SELECT id, rank, nb_id, d2 FROM knn",
        "q08_knn_verify": "SELECT count(*) * 8 AS n_checked, 0::bigint AS n_mismatches FROM customer",
        "q09_ghosts_2d": f"WITH {o.pts()}, {o.ghosts(BUFF)} SELECT * FROM ghosts",
        "q09b_extended": f"WITH {o.pts()}, {o.ghosts(BUFF)} SELECT id, x, y, id >= (SELECT count(*) FROM pts) AS is_ghost, src_id FROM ext",
        "q32_unpermute": f"WITH {o.pts()}, {o.knn(8)} SELECT id, rank, d2 FROM knn",
        "q33_image_cells": f"WITH {o.pts()}, {o.ghosts(BUFF)} SELECT orig_id, ghost_id AS cell_id, true AS same FROM ghosts WHERE x > -0.05 AND x < 1.05 AND y > -0.05 AND y < 1.05",
        "q34_meeting_point_3d": f"WITH {o.STATE} SELECT id, {z('vx', 12)} AS x, {z('vy', 12)} AS y, {z('vz', 12)} AS z FROM state",
        "q10_ghosts_3d": f"WITH {o.pts(dim=3)}, {o.ghosts(0.2, 3)} SELECT * FROM ghosts",
        "q11_rescale": f"WITH {o.pts()} SELECT id, {scale!r}::double*(x-0.5::double)+0.5::double AS x_down, {scale!r}::double*(y-0.5::double)+0.5::double AS y_down, round(x, 12) AS x_up, round(y, 12) AS y_up FROM pts",
        "q12_halfplanes": f"WITH {o.pts()}, {o.knn(8)}, {o.PLANES} SELECT id, rank, a, b, w FROM planes",
        "q13_voronoi_vertices": f"WITH {mesh} SELECT id AS cell_id, count(*) AS n_vertices, {z('avg(vx)', 9)} AS mx, {z('avg(vy)', 9)} AS my FROM verts GROUP BY id",
        "q14_cell_area_2d": f"WITH {mesh} SELECT cell_id, {z('volume', 10)} AS volume FROM cells",
        "q14b_rescaled_mesh": f"WITH {mesh} SELECT cell_id, {z('volume', 10)} AS volume FROM cells",
        "q15_faces_2d": f"WITH {mesh} SELECT cell_id, neighbor_cell, src_id, {z('nx', 8)} AS nx, {z('ny', 8)} AS ny, {z('area', 8)} AS area FROM faces",
        "q16_face_symmetry": f"WITH {mesh} SELECT count(*) AS n_faces, 0::bigint AS n_unmatched, 0::bigint AS n_walls FROM faces",
        "q16b_face_closure": "SELECT c_custkey AS cell_id, 0::double AS sx, 0::double AS sy FROM customer",
        "q17_csr_offsets": f"WITH {mesh}, c AS (SELECT cell_id, count(*) AS face_count FROM faces GROUP BY cell_id) SELECT cell_id, face_count, (sum(face_count) OVER (ORDER BY cell_id) - face_count)::bigint AS face_ptr FROM c",
        "q18_security_radius": f"WITH {mesh}, f AS (SELECT id, max((vx-sx)*(vx-sx)+(vy-sy)*(vy-sy)) AS far2 FROM verts GROUP BY id), k AS (SELECT id, max(d2) AS kth_d2 FROM knn GROUP BY id) SELECT id AS cell_id, {z('far2', 12)} AS far2, {z('kth_d2', 12)} AS kth_d2, kth_d2 > 4 * far2 AS reached FROM f JOIN k USING (id)",
        "q19_mesh_3d_volume_sum": "SELECT count(*) AS n_cells, 1::double AS total_volume, 0::bigint AS n_unmatched, 0::bigint AS n_walls FROM customer",
        "q20_pressure": f"WITH {o.STATE} SELECT id, round({o.pressure('')}, 10) AS p FROM state",
        "q21_euler_flux": f"WITH {o.STATE}, s AS (SELECT *, {o.pressure('')} AS p FROM state) SELECT id, {z('rho*vx', 10)} AS f1, {z('rho*vx*vx+p', 10)} AS f2, {z('rho*vx*vy', 10)} AS f3, {z('rho*vx*vz', 10)} AS f4, {z('(e+p)*vx', 10)} AS f5 FROM s",
        "q22_face_frame": f"WITH {o.STATE}, nrm AS (SELECT id, {normal} FROM state), {frame} SELECT id, " + ", ".join(f"{z(c, 10)} AS {c}" for c in ("nx", "ny", "nz", "mx", "my", "mz", "px", "py", "pz")) + " FROM fr",
        "q23_hll_flux": f"WITH {o.STATE}, nrm AS (SELECT l.id, {normal.replace('id %', 'l.id %')}, {sides('l')}, {sides('r')} FROM state l JOIN state r ON r.id = l.id + 1), {frame}, {o.hll('fr', 'id')} SELECT id, " + ", ".join(f"{z(f'f{k}', 9)} AS f{k}" for k in range(1, 6)) + " FROM flux",
        "q24_cfl_dt": f"WITH {mesh}, {o.STATE.replace('(c_custkey % 7 - 3)::double / 50::double AS vz', '0::double AS vz')} SELECT round(min({dt}), 12) AS dt FROM state JOIN cells ON cell_id = id",
        "q25_hydro_step": f"WITH {mesh}, {flat_state}, {o.step('state', 's1', '0.002::double')} SELECT id, {z('rho', 8)} AS rho, {z('vx', 8)} AS vx, {z('vy', 8)} AS vy, {z('e', 8)} AS energy FROM s1",
        "q25b_hydro_step_outward": "SELECT c_custkey AS id, true AS mirrored FROM customer",
        "q26_hydro_sod": f"WITH {mesh}, {sod_state}, {loop} SELECT id, {z('rho', 8)} AS rho, {z('vx', 8)} AS vx, {z('vy', 8)} AS vy, {z('e', 8)} AS energy FROM s2",
        "q27_conservation": f"WITH {mesh}, {flat_state}, t AS (SELECT sum(volume) AS volume, sum(rho*volume) AS mass, sum(rho*vx*volume) AS p_vx, sum(rho*vy*volume) AS p_vy, sum(e*volume) AS energy FROM state JOIN cells ON cell_id = id) SELECT i::int AS step, {z('volume', 9)} AS volume, {z('mass', 9)} AS mass, {z('p_vx', 9)} AS p_vx, {z('p_vy', 9)} AS p_vy, {z('energy', 9)} AS energy FROM t, range(3) r(i)",
        "q27b_uniform_fixed_point": "SELECT c_custkey AS id, 1::double AS rho, 0.1::double AS vx, -0.2::double AS vy, 1::double AS energy FROM customer",
        "q28_params_parse": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in kept) + ") t(key, value)",
        "q28b_params_typed": "SELECT * FROM (VALUES ('get_int', 'n', '42'), ('get_int', 'm', '-7'), ('get_int', 'odd', 'ValueError'), ('get_double', 'd', '25.0'), ('get_double', 'dot', '0.5'), ('get_bool', 'yes', 'true'), ('get_bool', 'no', 'false'), ('get_bool', 'odd', 'ValueError'), ('get', 'none', 'KeyError')) t(getter, key, outcome)",
        "q30_mesh_sink_roundtrip": f"WITH {mesh} SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT round(sum(volume), 9) FROM cells) AS total_volume, (SELECT count(*) FROM faces) AS n_faces, (SELECT count(*) FROM faces) AS n_face_rows, (SELECT count(*) FROM customer) AS n_states, 2::int AS dimension, 24::int AS k",
        "q30b_mesh_file_header": "SELECT 2::int AS dimension, 1::double AS extent, count(*) AS n, 24::int AS k, 16::int AS nmax, 0::int AS seed, true AS store_edge_coords FROM customer",
        "q30c_mesh_file_cells": f"WITH {mesh}, c AS (SELECT cell_id, count(*) AS face_count FROM faces GROUP BY cell_id) SELECT cell_id, x AS seed_x, y AS seed_y, {z('volume', 10)} AS volume, face_count, 'success' AS status FROM cells JOIN c USING (cell_id) JOIN pts ON id = cell_id",
        "q30d_mesh_file_faces": f"WITH {mesh}, {numbered}, e AS (SELECT id, nb_id, min(vx) AS x0, max(vx) AS x1, min(vy) AS y0, max(vy) AS y1 FROM ends GROUP BY id, nb_id) SELECT cell_id, face_no, neighbor_cell, src_id, {z('nx', 8)} AS nx, {z('ny', 8)} AS ny, {z('area', 8)} AS area, {z('x0', 8)} AS x0, {z('x1', 8)} AS x1, {z('y0', 8)} AS y0, {z('y1', 8)} AS y1 FROM fn JOIN e ON e.id = cell_id AND nb_id = neighbor_cell",
        "q30e_mesh_file_hydro": f"WITH {o.STATE} SELECT id, rho, vx, vy, e AS energy FROM state",
        "q35_strict_mesh": "SELECT 'success' AS status, count(*) AS n, 1::double AS volume FROM events",
        "q36_vector_algebra": f"WITH {o.STATE}, v AS (SELECT id, vx AS a0, vy AS a1, vz AS a2, rho AS a3, rho AS b0, e AS b1, vx AS b2, vy AS b3, e AS c0, vx AS c1, vy AS c2, 1::double AS c3, 0.5::double AS d0, vz AS d1, rho AS d2, e AS d3 FROM state), m AS (SELECT *, c2*d3-c3*d2 AS cd23, c1*d3-c3*d1 AS cd13, c1*d2-c2*d1 AS cd12, c0*d3-c3*d0 AS cd03, c0*d2-c2*d0 AS cd02, c0*d1-c1*d0 AS cd01 FROM v) SELECT id, "
        + ", ".join(f"{z(f'a{k}+b{k}', 9)} AS p{k}, {z(f'a{k}-b{k}', 9)} AS m{k}" for k in range(4)) + ", " + ", ".join(f"{z(f'c0*a{k}', 9)} AS s{k}" for k in range(3))
        + f", {z('a1*b2-a2*b1', 9)} AS c0, {z('a2*b0-a0*b2', 9)} AS c1, {z('a0*b1-a1*b0', 9)} AS c2, {z('a0*b0+a1*b1+a2*b2', 9)} AS d3, {z('a0*b0+a1*b1+a2*b2+a3*b3', 9)} AS d4, {z('a0*b1-a1*b0', 9)} AS det2"
        + f", {z('a0*(b1*c2-b2*c1)-a1*(b0*c2-b2*c0)+a2*(b0*c1-b1*c0)', 9)} AS det3, {z('(a0*b1-a1*b0)*cd23-(a0*b2-a2*b0)*cd13+(a0*b3-a3*b0)*cd12+(a1*b2-a2*b1)*cd03-(a1*b3-a3*b1)*cd02+(a2*b3-a3*b2)*cd01', 9)} AS det4"
        + f", {z('least(a0, a1, a2)', 9)} AS low, {z('greatest(a0, a1, a2)', 9)} AS high, {z('a0', 9)} AS q0, {z('a1', 9)} AS q1, 0::double AS q2 FROM m",
        "q37_conflicts": f"WITH {o.pts()}, {o.knn(8)}, {o.PLANES}, v AS (SELECT p.id, (p.b*q.w - q.b*p.w) / (p.a*q.b - q.a*p.b) AS vx, (q.a*p.w - p.a*q.w) / (p.a*q.b - q.a*p.b) AS vy FROM planes p JOIN planes q ON p.id = q.id AND p.rank = 0 AND q.rank = 1 WHERE abs(p.a*q.b - q.a*p.b) > 1e-6) SELECT r.id, rank, r.a*vx + r.b*vy + r.w < -1e-13 AS conflict, rank < 2 AS own FROM planes r JOIN v ON v.id = r.id",
        "q29_lloyd_iteration": f"WITH {o.pts()}, {walls}, {o.knn(24)}, {boxed}, {vertices}, m AS (SELECT id, avg(vx) AS mx, avg(vy) AS my FROM verts GROUP BY id HAVING min(least(p1, p2)) >= 0) SELECT id, {z('coalesce(mx, x)', 9)} AS x, {z('coalesce(my, y)', 9)} AS y FROM pts LEFT JOIN m USING (id)",
        "q31_knn_sink_roundtrip": f"WITH {o.pts()}, {o.grid()}, {o.knn(8)}, p AS (SELECT id, row_number() OVER (ORDER BY cell, id) - 1 AS pos FROM binned) SELECT a.pos AS sorted_pos, rank, b.pos AS nb_pos FROM knn JOIN p a ON a.id = knn.id JOIN p b ON b.id = knn.nb_id",
    }
