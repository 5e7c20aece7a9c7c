"""Independent SQL for the registered queries: brute-force neighbours, vertex enumeration, window functions."""

from __future__ import annotations

import re

#: Fixed values of the semantics, written out anew: steps of the points' sequence, points per bucket, and the regions of
#: images in the order of their ids, as the range of each axis (near the low side, anywhere, near the high side) and its shift.
AXES = ("x", "y", "z")
STEPS = {2: (0.7548776662466927, 0.5698402909980532), 3: (0.8191725133961645, 0.6710436067037893, 0.5497004779019703)}
PER_BUCKET = 3.0999999046325684
LOW, ANY, HIGH = ("low", 1.0), ("any", 0.0), ("high", -1.0)
REGIONS = {
    2: [(LOW, ANY), (ANY, HIGH), (HIGH, ANY), (ANY, LOW), (LOW, LOW), (LOW, HIGH), (HIGH, HIGH), (HIGH, LOW)],
    3: [
        (ANY, ANY, LOW), (LOW, ANY, ANY), (ANY, HIGH, ANY), (HIGH, ANY, ANY), (ANY, LOW, ANY), (ANY, ANY, HIGH),
        (ANY, LOW, LOW), (LOW, ANY, LOW), (ANY, HIGH, LOW), (HIGH, ANY, LOW), (LOW, LOW, ANY), (LOW, HIGH, ANY), (HIGH, HIGH, ANY), (HIGH, LOW, ANY), (LOW, ANY, HIGH), (ANY, HIGH, HIGH), (HIGH, ANY, HIGH), (ANY, LOW, HIGH),
        (LOW, LOW, LOW), (LOW, HIGH, LOW), (HIGH, HIGH, LOW), (HIGH, LOW, LOW), (LOW, LOW, HIGH), (LOW, HIGH, HIGH), (HIGH, HIGH, HIGH), (HIGH, LOW, HIGH),
    ],
}

GAMMA = "(5::double/3::double)"


def pts(table: str = "customer", key: str = "c_custkey", dim: int = 2) -> str:
    cols = ", ".join(f"(({key} + 1)::double * {s!r}::double) % 1::double AS {a}" for a, s in zip(AXES, STEPS[dim]))
    return f"pts AS (SELECT {key} AS id, {cols} FROM {table})"


def grid(dim: int = 2) -> str:
    i = ", ".join(f"least(n - 1, greatest(0, floor({a} * n::double)::int)) AS {b}" for a, b in zip(AXES[:dim], ("ci", "cj", "ck")))
    cell = " + ".join(f"{b}::bigint * n{'*n' * (k - 1)}" if k else b for k, b in enumerate(("ci", "cj", "ck")[:dim]))
    return f"g AS (SELECT greatest(1, floor(pow(count(*) / {PER_BUCKET!r}::double, 1 / {dim}::double) + 0.5))::int AS n FROM pts), b0 AS (SELECT id, {', '.join(AXES[:dim])}, n, {i} FROM pts, g), binned AS (SELECT *, ({cell})::bigint AS cell FROM b0)"


def knn(k: int, dim: int = 2, asked: str = "pts", points: str = "pts", name: str = "knn") -> str:
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in AXES[:dim])
    own = ", ".join(f"a.{c}, b.{c} AS nb_{c}" for c in AXES[:dim])
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nb_id) - 1 AS rank FROM (SELECT a.id, b.id AS nb_id, {own}, {d2} AS d2 FROM {asked} a, {points} b WHERE a.id <> b.id)) WHERE rank < {k})"


def ghosts(buff: float, dim: int = 2) -> str:
    low, high = {"low": "0::double", "high": f"(1::double - {buff}::double)", "any": "0::double"}, {"low": f"{buff}::double", "high": "1::double", "any": "1::double"}
    parts = []
    for k, region in enumerate(REGIONS[dim]):
        where = " AND ".join(f"{a} > {low[c]} AND {a} < {high[c]}" for a, (c, _) in zip(AXES, region))
        cols = ", ".join(f"{a} + {shift}::double AS {a}" for a, (_, shift) in zip(AXES, region))
        parts.append(f"SELECT id AS orig_id, {k} AS region, {cols} FROM pts WHERE {where}")
    xyz = ", ".join(AXES[:dim])
    return f"gh0 AS ({' UNION ALL '.join(parts)}), ghosts AS (SELECT (SELECT count(*) FROM pts) + row_number() OVER (ORDER BY orig_id, region) - 1 AS ghost_id, orig_id, region, {xyz} FROM gh0), ext AS (SELECT id, {xyz}, id AS src_id FROM pts UNION ALL SELECT ghost_id, {xyz}, orig_id FROM ghosts)"


PLANES = "planes AS (SELECT id, nb_id, rank, d2, x, y, x - nb_x AS a, y - nb_y AS b, ((x + nb_x) * (x - nb_x) + (y + nb_y) * (y - nb_y)) * -0.5::double AS w FROM knn)"

VERTICES = """
v0 AS (SELECT p.id, p.nb_id AS p1, q.nb_id AS p2, p.x AS sx, p.y AS sy, (p.b * q.w - q.b * p.w) / (p.a * q.b - p.b * q.a) AS vx, (q.a * p.w - p.a * q.w) / (p.a * q.b - p.b * q.a) AS vy
       FROM planes p JOIN planes q ON p.id = q.id AND p.rank < q.rank WHERE abs(p.a * q.b - p.b * q.a) > 1e-14),
verts AS (SELECT * FROM v0 WHERE NOT EXISTS (SELECT 1 FROM planes r WHERE r.id = v0.id AND r.a * vx + r.b * vy + r.w < -1e-13)),
ring AS (SELECT id, vx, vy, row_number() OVER w AS r, lead(vx) OVER w AS nx, lead(vy) OVER w AS ny, first_value(vx) OVER w AS fx, first_value(vy) OVER w AS fy
         FROM verts WINDOW w AS (PARTITION BY id ORDER BY atan2(vy - sy, vx - sx) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cells AS (SELECT id AS cell_id, 0.5 * abs(sum(vx * coalesce(ny, fy) - coalesce(nx, fx) * vy)) AS volume, count(*) AS n_vertices FROM ring GROUP BY id),
ends AS (SELECT id, p1 AS nb_id, vx, vy FROM verts UNION ALL SELECT id, p2, vx, vy FROM verts),
f0 AS (SELECT id, nb_id, count(*) AS c, sqrt((max(vx) - min(vx)) * (max(vx) - min(vx)) + (max(vy) - min(vy)) * (max(vy) - min(vy))) AS area FROM ends GROUP BY id, nb_id HAVING count(*) >= 2),
faces AS (SELECT f0.id AS cell_id, f0.nb_id AS neighbor_cell, e.src_id, p.a / sqrt(p.a * p.a + p.b * p.b) AS nx, p.b / sqrt(p.a * p.a + p.b * p.b) AS ny, area, p.rank FROM f0 JOIN planes p ON p.id = f0.id AND p.nb_id = f0.nb_id JOIN ext e ON e.id = f0.nb_id WHERE area > 1e-13)
"""


def mesh(k: int, buff: float) -> str:
    return ", ".join([pts(), ghosts(buff), knn(k, 2, "pts", "ext"), PLANES, VERTICES])


def pressure(p: str) -> str:
    return f"({GAMMA} - 1) * ({p}e - 0.5 * {p}rho * ({p}vx * {p}vx + {p}vy * {p}vy + {p}vz * {p}vz))"


#: rows: key, l/r states (rho, vx, vy, vz, e) and the frame's columns nx..pz. Gives the flux f1..f5 in the box's axes.
def hll(rows: str, key: str) -> str:
    turned = ", ".join(f"{s}rho, {s}e, {s}vx*nx+{s}vy*ny+{s}vz*nz AS {s}u, {s}vx*mx+{s}vy*my+{s}vz*mz AS {s}v, {s}vx*px+{s}vy*py+{s}vz*pz AS {s}w, {pressure(s)} AS {s}p" for s in ("l_", "r_"))
    def parts(s):
        return [f"{s}rho*{s}u", f"({s}rho*{s}u*{s}u+{s}p)", f"{s}rho*{s}u*{s}v", f"{s}rho*{s}u*{s}w", f"({s}e+{s}p)*{s}u"]
    def kept(s):
        return [f"{s}rho", f"{s}rho*{s}u", f"{s}rho*{s}v", f"{s}rho*{s}w", f"{s}e"]
    cases = ", ".join(f"CASE WHEN sl >= 0 THEN {fl} WHEN sl < 0 AND sr > 0 THEN (sr*{fl} - sl*{fr} + sl*sr*({ur} - {ul})) / (sr - sl) WHEN sr <= 0 THEN {fr} ELSE 0 END AS g{k}" for k, (fl, fr, ul, ur) in enumerate(zip(parts("l_"), parts("r_"), kept("l_"), kept("r_")), 1))
    frame = "nx, ny, nz, mx, my, mz, px, py, pz"
    return f"""h1 AS (SELECT {key}, {frame}, {turned} FROM {rows}),
h2 AS (SELECT *, least(l_u - sqrt({GAMMA}*l_p/l_rho), r_u - sqrt({GAMMA}*r_p/r_rho)) AS sl, greatest(l_u + sqrt({GAMMA}*l_p/l_rho), r_u + sqrt({GAMMA}*r_p/r_rho)) AS sr FROM h1),
h3 AS (SELECT {key}, {frame}, {cases} FROM h2),
flux AS (SELECT {key}, g1 AS f1, g2*nx+g3*mx+g4*px AS f2, g2*ny+g3*my+g4*py AS f3, g2*nz+g3*mz+g4*pz AS f4, g5 AS f5 FROM h3)"""


STATE = "state AS (SELECT c_custkey AS id, 0.5::double + (c_acctbal + 1000::double) / 11000::double AS rho, (c_nationkey - 12)::double / 100::double AS vx, (c_custkey % 11 - 5)::double / 50::double AS vy, (c_custkey % 7 - 3)::double / 50::double AS vz, 1::double + (c_custkey % 13)::double / 10::double AS e FROM customer)"


def sides(s: str) -> str:
    return ", ".join(f"{s}.{c} AS {s}_{c}" for c in ("rho", "vx", "vy", "vz", "e"))


def step(before: str, after: str, dt: str) -> str:
    """The state ``after`` made from ``before`` in 2D; CTEs cells and faces have the mesh."""
    rows = f"rows AS (SELECT f.cell_id, f.area, f.nx, f.ny, 0::double AS nz, -f.ny AS mx, f.nx AS my, 0::double AS mz, 0::double AS px, 0::double AS py, 1::double AS pz, {sides('l')}, {sides('r')} FROM faces f JOIN {before} l ON l.id = f.cell_id JOIN {before} r ON r.id = f.src_id)"
    sums = "sums AS (SELECT cell_id, sum(f1*area) AS s1, sum(f2*area) AS s2, sum(f3*area) AS s3, sum(f5*area) AS s5 FROM flux GROUP BY cell_id)"
    moved = f"moved AS (SELECT s.id, rho - ({dt}/volume)*sums.s1 AS rho, rho*vx - ({dt}/volume)*sums.s2 AS mx, rho*vy - ({dt}/volume)*sums.s3 AS my, e - ({dt}/volume)*sums.s5 AS e FROM {before} s JOIN sums ON sums.cell_id = s.id JOIN cells c ON c.cell_id = s.id)"
    text = f"{rows}, {hll('rows', 'cell_id, area')}, {sums}, {moved}"
    for name in ("rows", "h1", "h2", "h3", "flux", "sums", "moved"):
        text = re.sub(rf"\b{name}\b", f"{name}_{after}", text)
    return f"{text}, {after} AS (SELECT id, rho, mx/rho AS vx, my/rho AS vy, 0::double AS vz, e FROM moved_{after})"
