"""Column functions of an ideal gas. A state is (rho, vx, vy, vz, E); E is total energy per volume."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.functions.geometry import dot3, from_face, to_face

FLUX = ("f_rho", "f_x", "f_y", "f_z", "f_E")


def pressure(state: list[Column], gamma: float) -> Column:
    rho, v, energy = state[0], state[1:4], state[4]
    return F.lit(gamma - 1) * (energy - F.lit(0.5) * rho * dot3(v, v))


def sound_speed(rho: Column, p: Column, gamma: float) -> Column:
    return F.sqrt(F.try_divide(F.lit(gamma) * p, rho))


def euler_flux(state: list[Column], gamma: float) -> list[Column]:
    """Along the first velocity component."""
    rho, u, v, w, energy = state
    p = pressure(state, gamma)
    return [rho * u, rho * u * u + p, rho * u * v, rho * u * w, (energy + p) * u]


def hll(rows: DataFrame, gamma: float, area: Column | None = None) -> DataFrame:
    """Adds f_rho, f_x, f_y, f_z, f_E: the flux through each face in the box's axes, times area if given.

    rows: both states as l_rho, l_vx, ..., r_E and the frame nx ... pz. Each stage is a projection of its own, whose
    columns later stages use several times, so no expression is evaluated twice. Where a wave speed isn't a number the
    flux is zero.
    """
    frame = {f"{e}{a}": F.col(f"{e}{a}") for e in "nmp" for a in "xyz"}
    sides = ("l", "r")
    out = rows.withColumns({f"__{s}{c}": v for s in sides for c, v in zip("uvw", to_face([F.col(f"{s}_v{a}") for a in "xyz"], frame))})
    own = lambda s: [F.col(f"{s}_rho"), F.col(f"__{s}u"), F.col(f"__{s}v"), F.col(f"__{s}w"), F.col(f"{s}_E")]
    out = out.withColumns({f"__{s}p": pressure(own(s), gamma) for s in sides})
    out = out.withColumns({f"__{s}c": F.sqrt(F.try_divide(F.lit(gamma) * F.col(f"__{s}p"), F.col(f"{s}_rho"))) for s in sides})
    low, high = [F.col(f"__{s}u") - F.col(f"__{s}c") for s in sides], [F.col(f"__{s}u") + F.col(f"__{s}c") for s in sides]
    broken = F.isnan(low[0]) | F.isnan(low[1]) | low[0].isNull() | low[1].isNull()
    out = out.withColumns({"__slow": F.least(*low), "__fast": F.greatest(*high), "__broken": broken})
    slow, fast = F.col("__slow"), F.col("__fast")

    def flux(s: str) -> list[Column]:
        rho, u, v, w, energy = own(s)
        p = F.col(f"__{s}p")
        return [rho * u, rho * u * u + p, rho * u * v, rho * u * w, (energy + p) * u]

    def conserved(s: str) -> list[Column]:
        rho, u, v, w, energy = own(s)
        return [rho, rho * u, rho * v, rho * w, energy]

    made = {}
    for k, (fl, fr, ul, ur) in enumerate(zip(flux("l"), flux("r"), conserved("l"), conserved("r"))):
        middle = F.try_divide(fast * fl - slow * fr + slow * fast * (ur - ul), fast - slow)
        made[f"__g{k}"] = F.when(F.col("__broken"), 0.0).when(slow >= 0, fl).when((slow < 0) & (fast > 0), middle).when(fast <= 0, fr).otherwise(0.0)
    out = out.withColumns(made)
    back = [F.col("__g0"), *from_face([F.col(f"__g{k}") for k in (1, 2, 3)], frame), F.col("__g4")]
    out = out.withColumns({name: c if area is None else c * area for name, c in zip(FLUX, back)})
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def radius(volume: Column, dim: int) -> Column:
    return F.sqrt(volume / math.pi) if dim == 2 else F.cbrt(volume * (3.0 / (4.0 * math.pi)))


def time_step(state: list[Column], volume: Column, dim: int, gamma: float, cfl: float) -> Column:
    """CFL R / (c + |v|)."""
    c = sound_speed(state[0], pressure(state, gamma), gamma)
    return F.try_divide(F.lit(cfl) * radius(volume, dim), c + F.sqrt(dot3(state[1:4], state[1:4])))
