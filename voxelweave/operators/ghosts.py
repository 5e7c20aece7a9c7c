"""Periodic images of the points near the box's sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions.geometry import open_box
from voxelweave.operators.prefix import running_sum

#: Regions in the order in which images get their ids. L: near the low side, shifted by +1; H: near the
#: high side, shifted by -1; A: anywhere, not shifted.
REGIONS = {
    2: "LA AH HA AL LL LH HH HL".split(),
    3: "AAL LAA AHA HAA ALA AAH ALL LAL AHL HAL LLA LHA HHA HLA LAH AHH HAH ALH LLL LHL HHL HLL LLH LHH HHH HLH".split(),
}
SHIFT = {"L": 1.0, "H": -1.0, "A": 0.0}


def ghosts(points: DataFrame, buff: float, dim: int = 2) -> DataFrame:
    """ghost_id, orig_id, region, position. Ids go on from the number of points, by original id, then region.

    A point's images come from one array that is exploded, so there is neither a join nor a global sort.
    """
    axes = ("x", "y", "z")[:dim]
    bounds = {"L": (0.0, buff), "H": (1.0 - buff, 1.0), "A": (0.0, 1.0)}
    images = []
    for k, region in enumerate(REGIONS[dim]):
        inside = open_box([F.col(a) for a in axes], [bounds[c][0] for c in region], [bounds[c][1] for c in region])
        images.append(F.when(inside, F.struct(F.lit(k).alias("region"), *((F.col(a) + SHIFT[c]).alias(a) for a, c in zip(axes, region)))))
    n_hydro = points.count()
    rows = points.select("id", F.filter(F.array(*images), lambda g: g.isNotNull()).alias("images"))
    rows = running_sum(rows, "id", F.size("images"), "first")
    out = rows.select(F.col("id").alias("orig_id"), "first", F.posexplode("images").alias("k", "g"))
    return out.select((F.lit(n_hydro) + F.col("first") + F.col("k")).cast("long").alias("ghost_id"), "orig_id", F.col("g.region").alias("region"), *(F.col(f"g.{a}").alias(a) for a in axes))


def extended(points: DataFrame, images: DataFrame, dim: int = 2) -> DataFrame:
    """id, position, is_ghost, src_id (the owner) of points and images."""
    axes = ("x", "y", "z")[:dim]
    own = points.select("id", *axes, F.lit(False).alias("is_ghost"), F.col("id").alias("src_id"))
    return own.unionByName(images.select(F.col("ghost_id").alias("id"), *axes, F.lit(True).alias("is_ghost"), F.col("orig_id").alias("src_id")))
