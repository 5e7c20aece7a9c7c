"""Cutting Voronoi cells out of the box, many at a time: convex polygons or polyhedra in padded arrays, clipped by the
bisectors of their neighbours from the nearest on. Step j cuts all open cells by their j-th neighbours at once.

A cell is done when the next neighbour is more than twice as far as the cell's farthest vertex: no further bisector can
reach it. If the neighbours run out before that, the status says so.

With ``limits`` (planes, vertices) a cell fails as one with storage of that size would: when a bisector comes after that
many planes are held (the box's sides and all bisectors that cut), when a vertex has no place left, or, in 2D, when a
vertex lies so near to a bisector that double precision can't tell its side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from voxelweave.config import STATUS

TINY = 1e-13
#: Relative size of a determinant below which its sign isn't trusted.
UNSURE = 1e-14
TRIANGLES, PLANES, BOUNDARY, RADIUS, SUCCESS, EXACT = (STATUS.index(s) for s in ("triangle_overflow", "vertex_overflow", "inconsistent_boundary", "security_radius_not_reached", "success", "needs_exact_predicates"))


@dataclass
class Cut:
    """status (a number of STATUS), volume and far2 of each cell; its faces in order of cell, then label: the number of
    the neighbour in the cell's list, or -1, -2, ... for the sides of the box. first: where a face's vertices begin."""

    status: np.ndarray
    volume: np.ndarray
    far2: np.ndarray
    cell: np.ndarray
    label: np.ndarray
    normal: np.ndarray
    area: np.ndarray
    first: np.ndarray
    verts: np.ndarray


def pack(mask: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """The number of marked places in each row, then the arrays with each row's marked places moved to its front."""
    size = mask.sum(axis=1)
    width = max(1, int(size.max(initial=0)))
    row, at = np.nonzero(mask)
    to = (np.cumsum(mask, axis=1) - 1)[row, at]
    out = [size]
    for a in arrays:
        moved = np.zeros((len(mask), width, *a.shape[2:]), a.dtype)
        moved[row, to] = a[row, at]
        out.append(moved)
    return out


def widened(a: np.ndarray, axis: int, width: int) -> np.ndarray:
    if a.shape[axis] >= width:
        return a
    pad = [(0, 0)] * a.ndim
    pad[axis] = (0, width - a.shape[axis])
    return np.pad(a, pad)


def put(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """into, widened where need be, with these rows replaced."""
    for axis in range(1, into.ndim):
        width = max(into.shape[axis], values.shape[axis])
        into, values = widened(into, axis, width), widened(values, axis, width)
    into[rows] = values
    return into


def following(size: np.ndarray, width: int) -> np.ndarray:
    """For each place of rings of these sizes: the place of the next vertex."""
    at = np.arange(width)
    return np.where(at == size[..., None] - 1, 0, np.minimum(at + 1, width - 1))


class Progress:
    """Which cells are open, and why the others are closed."""

    def __init__(self, d2: np.ndarray, count: np.ndarray):
        self.d2, self.count = d2, count
        self.open = np.ones(len(count), bool)
        self.status = np.full(len(count), SUCCESS)

    def rows(self, j: int, far: np.ndarray) -> np.ndarray:
        """Open cells whose j-th neighbour can reach them; cells that it can't reach are done."""
        rows = np.flatnonzero(self.open & (self.count > j))
        done = self.d2[rows, j] > 4.0 * far[rows]
        self.open[rows[done]] = False
        return rows[~done]

    def fail(self, rows: np.ndarray, why: int) -> None:
        self.status[rows], self.open[rows] = why, False

    def end(self, far: np.ndarray) -> None:
        """Cells whose last neighbour could still reach them aren't sure, whatever else befell them."""
        some = np.flatnonzero(self.count > 0)
        last = np.zeros(len(self.count))
        last[some] = self.d2[some, self.count[some] - 1]
        unsure = ~(last > 4.0 * far) & (self.status != BOUNDARY)
        self.status[unsure] = RADIUS


def cut_polygons(seed: np.ndarray, near: np.ndarray, d2: np.ndarray, count: np.ndarray, low: float, high: float, limits: tuple[int, int] | None = None) -> Cut:
    """seed: n x 2; near: n x k x 2 and d2: n x k, each row's first ``count`` places from the nearest on."""
    n, k = d2.shape
    x = np.tile(np.array([(low, low), (high, low), (high, high), (low, high)]), (n, 1, 1))
    label = np.tile(np.array([-3, -2, -4, -1]), (n, 1))  # of the edge from a vertex to the next
    size, held = np.full(n, 4), np.full(n, 4)
    far = ((x - seed[:, None]) ** 2).sum(axis=2).max(axis=1)
    progress = Progress(d2, count)
    for j in range(k):
        rows = progress.rows(j, far)
        if not len(rows) and not (progress.open & (count > j)).any():
            break
        if limits:
            full = held[rows] >= limits[0]
            progress.fail(rows[full], PLANES)
            rows = rows[~full]
        a = seed[rows] - near[rows, j]
        w = -0.5 * ((seed[rows] + near[rows, j]) * a).sum(axis=1)
        valid = np.arange(x.shape[1]) < size[rows, None]
        side = np.where(valid, x[rows, :, 0] * a[:, :1] + x[rows, :, 1] * a[:, 1:] + w[:, None], np.inf)
        if limits:
            unsure = (valid & uncertain(label[rows], size[rows], seed[rows], near[rows], a, w, low, high)).any(axis=1)
            progress.fail(rows[unsure], EXACT)
            rows, side, valid = rows[~unsure], side[~unsure], valid[~unsure]
        cut = side.min(axis=1) < -TINY
        rows, side, valid = rows[cut], side[cut], valid[cut]
        if not len(rows):
            continue
        held[rows] += 1
        nxt = following(size[rows], x.shape[1])
        here, names = x[rows], label[rows]
        there, other = np.take_along_axis(here, nxt[..., None], 1), np.take_along_axis(side, nxt, 1)
        keep = valid & (side >= 0)
        leave, enter = keep & (other < 0), valid & (side < 0) & (other >= 0)
        crossing = leave | enter
        t = np.where(crossing, side, 0.0) / np.subtract(side, other, out=np.ones(side.shape), where=crossing)
        met = here + t[..., None] * (there - here)
        both = lambda p, q: np.stack([p, q], axis=2).reshape(len(rows), -1, *p.shape[2:])
        new, points, labels = pack(both(keep, crossing), both(here, met), both(names, np.where(leave, j, names)))
        x, label = put(x, rows, points), put(label, rows, labels)
        size[rows] = new
        progress.fail(rows[new < 3], BOUNDARY)
        if limits:
            progress.fail(rows[new >= limits[1]], TRIANGLES)
        inside = np.arange(points.shape[1]) < new[:, None]
        far[rows] = np.where(inside, ((points - seed[rows, None]) ** 2).sum(axis=2), 0.0).max(axis=1)
    progress.end(far)
    far[progress.status == BOUNDARY] = 0.0
    size[progress.status == BOUNDARY] = 0

    valid = np.arange(x.shape[1]) < size[:, None]
    end = np.take_along_axis(x, following(size, x.shape[1])[..., None], 1)
    p, q = x - seed[:, None], end - seed[:, None]
    area = 0.5 * np.abs(np.where(valid, p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1], 0.0).sum(axis=1))
    length = np.hypot(*(end - x).transpose(2, 0, 1))
    cell, at = np.nonzero(valid & (length > TINY))
    order = np.lexsort((label[cell, at], cell))
    cell, at = cell[order], at[order]
    names = label[cell, at]
    normal = np.zeros((len(cell), 3))
    normal[:, :2] = np.where(names[:, None] < 0, np.array([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)])[-names.clip(max=-1) - 1], seed[cell] - near[cell, names.clip(min=0)])
    normal /= np.sqrt((normal**2).sum(axis=1, keepdims=True))
    verts = np.zeros((len(cell), 2, 3))
    verts[:, 0, :2], verts[:, 1, :2] = x[cell, at], end[cell, at]
    return Cut(progress.status, area, far, cell, names, normal, length[cell, at], np.arange(len(cell) + 1) * 2, verts.reshape(-1, 3))


def uncertain(label, size, seed, near, a, w, low: float, high: float) -> np.ndarray:
    """Which vertices of polygons lie too near to the lines a x + w for their side to be sure. A vertex is where its own
    edge's line meets that of the edge before."""
    m, width = label.shape
    own = np.where(label[..., None] >= 0, seed[:, None] - np.take_along_axis(near, label.clip(min=0)[..., None], 1), np.array([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)])[-label.clip(max=-1) - 1])
    offset = np.where(label >= 0, -0.5 * ((seed[:, None] + np.take_along_axis(near, label.clip(min=0)[..., None], 1)) * own).sum(axis=2), np.array([-low, high, -low, high])[-label.clip(max=-1) - 1])
    before = np.where(np.arange(width) == 0, np.maximum(size[:, None] - 1, 0), np.arange(width) - 1)
    prev, off = np.take_along_axis(own, before[..., None], 1), np.take_along_axis(offset, before, 1)
    ax, ay, aw = a[:, None, 0], a[:, None, 1], w[:, None]
    det = prev[..., 0] * (own[..., 1] * aw - ay * offset) - own[..., 0] * (prev[..., 1] * aw - ay * off) + ax * (prev[..., 1] * offset - own[..., 1] * off)
    most = [np.maximum(np.maximum(abs(p), abs(q)), abs(r)) for p, q, r in ((prev[..., 0], own[..., 0], ax), (prev[..., 1], own[..., 1], ay), (off, offset, aw))]
    return abs(det) < UNSURE * most[0] * most[1] * most[2] * np.maximum(np.maximum(most[0], most[1]), most[2])


def cut_polyhedra(seed: np.ndarray, near: np.ndarray, d2: np.ndarray, count: np.ndarray, low: float, high: float, limits: tuple[int, int] | None = None) -> Cut:
    """As cut_polygons, with three coordinates. A face is a ring of vertices; each is clipped like a polygon, and the points
    where the plane meets them, turned about their mean, are the new face."""
    n, k = d2.shape
    corner = lambda *at: [(low, high)[i] for i in at]
    box = [[corner(0, 0, 0), corner(0, 1, 0), corner(0, 1, 1), corner(0, 0, 1)], [corner(1, 0, 0), corner(1, 1, 0), corner(1, 1, 1), corner(1, 0, 1)], [corner(0, 0, 0), corner(1, 0, 0), corner(1, 0, 1), corner(0, 0, 1)], [corner(0, 1, 0), corner(1, 1, 0), corner(1, 1, 1), corner(0, 1, 1)], [corner(0, 0, 0), corner(1, 0, 0), corner(1, 1, 0), corner(0, 1, 0)], [corner(0, 0, 1), corner(1, 0, 1), corner(1, 1, 1), corner(0, 1, 1)]]
    x = np.tile(np.array(box), (n, 1, 1, 1))
    label, size, held = np.tile(-1 - np.arange(6), (n, 1)), np.full((n, 6), 4), np.full(n, 6)
    normal = np.tile(np.array([(1.0, 0, 0), (-1.0, 0, 0), (0, 1.0, 0), (0, -1.0, 0), (0, 0, 1.0), (0, 0, -1.0)]), (n, 1, 1))
    far = ((x - seed[:, None, None]) ** 2).sum(axis=3).max(axis=(1, 2))
    progress = Progress(d2, count)
    for j in range(k):
        rows = progress.rows(j, far)
        if not len(rows) and not (progress.open & (count > j)).any():
            break
        if limits:
            full = held[rows] >= limits[0]
            progress.fail(rows[full], PLANES)
            rows = rows[~full]
        a = seed[rows] - near[rows, j]
        w = -0.5 * ((seed[rows] + near[rows, j]) * a).sum(axis=1)
        valid = np.arange(x.shape[2]) < size[rows][..., None]
        side = np.where(valid, np.einsum("mfvd,md->mfv", x[rows], a) + w[:, None, None], np.inf)
        cut = side.min(axis=(1, 2)) < -TINY
        rows, a, side, valid = rows[cut], a[cut], side[cut], valid[cut]
        if not len(rows):
            continue
        held[rows] += 1
        m, f, v = side.shape
        nxt = following(size[rows], v)
        here = x[rows]
        there, other = np.take_along_axis(here, nxt[..., None], 2), np.take_along_axis(side, nxt, 2)
        keep = valid & (side >= 0)
        crossing = valid & ((side > 0) & (other < 0) | (side < 0) & (other > 0))
        # from the kept end, so that both faces of an edge get the same point
        kept = side > 0
        start, end = np.where(kept[..., None], here, there), np.where(kept[..., None], there, here)
        s, e = np.where(kept, side, other), np.where(kept, other, side)
        t = np.where(crossing, s, 0.0) / np.subtract(s, e, out=np.ones(s.shape), where=crossing)
        met = start + t[..., None] * (end - start)
        both = lambda p, q: np.stack([p, q], axis=3).reshape(m * f, 2 * v, *p.shape[3:])
        points = both(here, met)
        new, rings = pack(both(keep, crossing), points)
        new = np.where(new < 3, 0, new).reshape(m, f)
        rim = both(keep & (side == 0), crossing).reshape(m, -1)
        many, rim = pack(rim, points.reshape(m, -1, 3))
        ring, verts, unit = turned(many, rim, a)

        width = max(rings.shape[1], verts.shape[1])
        x_new = np.concatenate([widened(rings.reshape(m, f, -1, 3), 2, width), widened(verts, 1, width)[:, None]], axis=1)
        size_new = np.concatenate([new, np.where(ring < 3, 0, ring)[:, None]], axis=1)
        label_new = np.concatenate([label[rows], np.full((m, 1), j)], axis=1)
        normal_new = np.concatenate([normal[rows], unit[:, None]], axis=1)
        faces, size_new, x_new, label_new, normal_new = pack(size_new > 0, size_new, x_new, label_new, normal_new)
        x, size, label, normal = put(x, rows, x_new), put(size, rows, size_new), put(label, rows, label_new), put(normal, rows, normal_new)
        progress.fail(rows[faces < 4], BOUNDARY)
        if limits:  # by Euler's formula, as each edge is in two rings
            progress.fail(rows[2 + size_new.sum(axis=1) // 2 - faces >= limits[1]], TRIANGLES)
        inside = np.arange(x_new.shape[2]) < size_new[..., None]
        far[rows] = np.where(inside, ((x_new - seed[rows, None, None]) ** 2).sum(axis=3), 0.0).max(axis=(1, 2))
    progress.end(far)
    broken = progress.status == BOUNDARY
    far[broken], size[broken] = 0.0, 0

    valid = np.arange(x.shape[2]) < size[..., None]
    arm = np.where(valid[..., None], x - x[:, :, :1], 0.0)
    fan = np.where((valid[:, :, 1:])[..., None], np.cross(arm[:, :, :-1], arm[:, :, 1:]), 0.0).sum(axis=2)
    area = 0.5 * np.sqrt((fan**2).sum(axis=2))
    height = np.abs(((x[:, :, 0] - seed[:, None]) * normal).sum(axis=2))
    volume = np.where(size > 0, area * height / 3.0, 0.0).sum(axis=1)
    cell, at = np.nonzero((size > 0) & (area > TINY * TINY))
    order = np.lexsort((label[cell, at], cell))
    cell, at = cell[order], at[order]
    row, place = np.nonzero(valid[cell, at])
    return Cut(progress.status, volume, far, cell, label[cell, at], normal[cell, at], area[cell, at], np.append(0, np.cumsum(size[cell, at])), x[cell[row], at[row], place])


def turned(size: np.ndarray, points: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings of the different points of each plane with normal a, by their angle about the mean: sizes, points, normals."""
    n = a / np.sqrt((a**2).sum(axis=1, keepdims=True))
    zero = np.zeros(len(n))
    u = np.where((np.abs(n[:, 2]) < 0.9)[:, None], np.stack([-n[:, 1], n[:, 0], zero], 1), np.stack([zero, -n[:, 2], n[:, 1]], 1))
    valid = np.arange(points.shape[1]) < size[:, None]
    mean = points.sum(axis=1) / np.maximum(size, 1)[:, None]
    arm = points - mean[:, None]
    angle = np.where(valid, np.arctan2((arm * np.cross(n, u)[:, None]).sum(axis=2), (arm * u[:, None]).sum(axis=2)), np.inf)
    order = np.argsort(angle, axis=1, kind="stable")
    points = np.take_along_axis(points, order[..., None], 1)
    fresh = valid.copy()
    fresh[:, 1:] &= (points[:, 1:] != points[:, :-1]).any(axis=2)
    return *pack(fresh, points), n
