"""Settings of a mesh and its solver, with the defaults that are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass

#: Points per grid bucket aimed at; single precision, as the grid size is rounded from it.
PER_BUCKET = 3.0999999046325684
#: In strict mode: the largest ring of buckets that a search visits, and the fewest buckets a side.
MAX_RING, LEAST_GRID = 15, 16
STATUS = ("triangle_overflow", "vertex_overflow", "inconsistent_boundary", "security_radius_not_reached", "success", "needs_exact_predicates")


@dataclass(frozen=True)
class MeshConfig:
    dim: int = 2
    k: int = 24
    k_max: int = 190
    buff: float = 0.04
    gamma: float = 5.0 / 3.0
    cfl: float = 0.4
    t_end: float = 0.1
    max_planes: int = 64
    max_vertices: int = 96
    strict: bool = False
    normal_convention: str = "inward"
    on_failed_cell: str = "raise"

    def __post_init__(self):
        if self.dim not in (2, 3):
            raise ValueError("dim must be 2 or 3")
        if self.normal_convention not in ("inward", "outward"):
            raise ValueError("normal_convention must be inward or outward")
        if self.on_failed_cell not in ("raise", "skip"):
            raise ValueError("on_failed_cell must be raise or skip")

    @property
    def axes(self) -> tuple[str, ...]:
        return ("x", "y", "z")[: self.dim]

    @property
    def velocities(self) -> tuple[str, ...]:
        return ("vx", "vy", "vz")[: self.dim]
