"""Column functions of geometry. 2D rows have no z; its place is a literal 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def open_box(axes: list[Column], low: list, high: list) -> Column:
    """Strictly inside on each axis."""
    return reduce(lambda a, b: a & b, [(c > lo) & (c < hi) for c, lo, hi in zip(axes, low, high)])


def bucket(c: Column, n: int) -> Column:
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(c * F.lit(float(n))).cast("int")))


def linear_bucket(buckets: list[Column], n: int) -> Column:
    """i + j n + k n^2."""
    return sum((b.cast("long") * F.lit(n**k) for k, b in enumerate(buckets)), F.lit(0).cast("long"))


def dist2(a: list[Column], b: list[Column]) -> Column:
    """Squares as products, summed from the first axis on."""
    parts = [(p - q) * (p - q) for p, q in zip(a, b)]
    return reduce(lambda x, y: x + y, parts)


def rescale_down(c: Column, scale: float) -> Column:
    return F.lit(scale) * (c - 0.5) + 0.5


def rescale_up(c: Column, scale: float) -> Column:
    return F.lit(1.0 / scale) * (c - 0.5) + 0.5


def halfplane(seed: list[Column], other: list[Column]) -> list[Column]:
    """Bisector coefficients and offset: a . x + w > 0 on the seed's side."""
    a = [s - o for s, o in zip(seed, other)]
    w = reduce(lambda x, y: x + y, [(s + o) * d for s, o, d in zip(seed, other, a)]) * F.lit(-0.5)
    return [*a, w]


def plus4(a, b):
    return [x + y for x, y in zip(a, b)]


def minus4(a, b):
    return [x - y for x, y in zip(a, b)]


def mul3(s, a):
    return [s * x for x in a[:3]]


def dot3(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def dot4(a, b):
    return dot3(a, b) + a[3] * b[3]


def cross3(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def det2(m):
    return m[0][0] * m[1][1] - m[0][1] * m[1][0]


def det3(m):
    return dot3(m[0], cross3(m[1], m[2]))


def det4(m):
    """By the first column's minors."""
    minor = lambda r: det3([row[1:] for k, row in enumerate(m) if k != r])
    return m[0][0] * minor(0) - m[1][0] * minor(1) + m[2][0] * minor(2) - m[3][0] * minor(3)


def minmax3(a, b, c) -> tuple[Column, Column]:
    return F.least(a, b, c), F.greatest(a, b, c)


def meeting_point(p: list[Column], q: list[Column]) -> list[Column]:
    """Where two lines a x + b y + w = 0 meet; null if they are parallel."""
    det = F.nullif(det2([p[:2], q[:2]]), F.lit(0.0))
    return [(p[1] * q[2] - q[1] * p[2]) / det, (q[0] * p[2] - p[0] * q[2]) / det]


def meeting_point3(p: list[Column], q: list[Column], r: list[Column]) -> list[Column]:
    """Where three planes a x + b y + c z + w = 0 meet, by Cramer's rule; null if they don't in one point."""
    det = F.nullif(det3([p[:3], q[:3], r[:3]]), F.lit(0.0))
    swap = lambda k: [[-plane[3] if j == k else plane[j] for j in range(3)] for plane in (p, q, r)]
    return [det3(swap(k)) / det for k in range(3)]


def references_plane(planes: Column, plane) -> Column:
    """Whether a vertex, given by the array of its planes, lies on this one."""
    return F.array_contains(planes, plane)


def point3(x: Column, y: Column, z: Column | None = None) -> list[Column]:
    """A point of either dimension as three coordinates; the missing one is 0."""
    return [x, y, F.lit(0.0) if z is None else F.coalesce(z, F.lit(0.0))]


def in_conflict(plane: list[Column], point: list[Column], tolerance: float = 1e-13) -> Column:
    return reduce(lambda a, b: a + b, [c * x for c, x in zip(plane, point)]) + plane[-1] < F.lit(-tolerance)


def face_frame(n: list[Column]) -> dict[str, Column]:
    """Unit normal n, tangent m = (-ny, nx, 0), or (1, 0, 0) where that vanishes, and p = n x m."""
    length = F.sqrt(dot3(n, n))
    nx, ny, nz = (F.try_divide(c, length) for c in n)
    flat = F.sqrt(nx * nx + ny * ny)
    along = (nx == 0.0) & (ny == 0.0)
    m = [F.when(along, 1.0).otherwise(F.try_divide(-ny, flat)), F.when(along, 0.0).otherwise(F.try_divide(nx, flat)), F.lit(0.0)]
    p = cross3([nx, ny, nz], m)
    return {name: c for name, c in zip(("nx", "ny", "nz", "mx", "my", "mz", "px", "py", "pz"), (nx, ny, nz, *m, *p))}


def to_face(v: list[Column], frame: dict[str, Column]) -> list[Column]:
    return [dot3(v, [frame[f"{e}x"], frame[f"{e}y"], frame[f"{e}z"]]) for e in "nmp"]


def from_face(v: list[Column], frame: dict[str, Column]) -> list[Column]:
    return [v[0] * frame[f"n{a}"] + v[1] * frame[f"m{a}"] + v[2] * frame[f"p{a}"] for a in "xyz"]
