"""Initial conditions: tables, generators and checks. Columns: id, x, y[, z], rho, vx, vy[, vz], E."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.config import MeshConfig

#: Steps of the low-discrepancy sequence along each axis.
STEPS = {2: (0.7548776662466927, 0.5698402909980532), 3: (0.8191725133961645, 0.6710436067037893, 0.5497004779019703)}
AXES = ("x", "y", "z")


def sequence_columns(key: Column, dim: int) -> list[Column]:
    """Key numbers start at 0, so the sequence uses key + 1."""
    return [((key + 1).cast("double") * F.lit(s) % F.lit(1.0)).alias(a) for a, s in zip(AXES, STEPS[dim])]


def from_keys(df: DataFrame, key: str, dim: int = 2) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), *sequence_columns(F.col(key), dim))


def with_state(points: DataFrame, rho: Column, pressure: Column, config: MeshConfig, **velocity: Column) -> DataFrame:
    """Adds rho, velocities (0 where not given) and total energy per volume."""
    v = {name: velocity.get(name, F.lit(0.0)) for name in config.velocities}
    out = points.withColumns({"rho": rho, **v, "__p": pressure})
    speed2 = sum((F.col(name) * F.col(name) for name in config.velocities), F.lit(0.0))
    return out.withColumn("E", F.col("__p") / (config.gamma - 1) + F.lit(0.5) * F.col("rho") * speed2).drop("__p")


def uniform(spark: SparkSession, n: int, config: MeshConfig, seed: int = 42, extent: float = 1.0) -> DataFrame:
    """Uniform random seeds with rho 1, no velocity and E 1."""
    axes = [(F.rand(seed + k) * extent).alias(a) for k, a in enumerate(config.axes)]
    return spark.range(n).select("id", *axes, F.lit(1.0).alias("rho"), *(F.lit(0.0).alias(v) for v in config.velocities), F.lit(1.0).alias("E"))


def sod(points: DataFrame, config: MeshConfig, extent: float = 1.0) -> DataFrame:
    """Left half: rho 1, p 1; right half: rho 0.125, p 0.1."""
    left = F.col("x") < 0.5 * extent
    return with_state(points, F.when(left, 1.0).otherwise(0.125), F.when(left, 1.0).otherwise(0.1), config)


def scan(spark: SparkSession, path: str, config: MeshConfig, file_format: str = "parquet") -> DataFrame:
    """Reads and checks an initial-condition table. hdf5 goes through sources.hdf5 if h5py can be imported."""
    if file_format == "hdf5":
        from voxelweave.sources import hdf5

        return hdf5.scan(spark, path, config)
    return checked(spark.read.format(file_format).load(path), config)


def checked(df: DataFrame, config: MeshConfig) -> DataFrame:
    """Columns must be there and numeric; ids unique and not null, positions strictly finite and in [0, 1]."""
    need = ["id", *config.axes, "rho", *config.velocities, "E"]
    kinds = dict(df.dtypes)
    missing = [c for c in need if c not in kinds]
    if missing:
        raise ValueError(f"initial conditions of dimension {config.dim} lack {', '.join(missing)}")
    if config.dim == 2 and "z" in kinds:
        raise ValueError("initial conditions have a z column, but dim is 2")
    out = df.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in need[1:]))
    bad = F.lit(False)
    for a in config.axes:
        bad = bad | F.col(a).isNull() | F.isnan(a) | ~F.col(a).between(0.0, 1.0)
    found = out.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("no_id"), F.count_if(bad).alias("bad"), F.count_if(F.col("rho").isNull() | (F.col("rho") <= 0)).alias("no_rho")).first()
    if found["no_id"] or found["bad"] or found["no_rho"]:
        raise ValueError(f"of {found['n']} rows {found['no_id']} have no id, {found['bad']} lie outside the box, {found['no_rho']} have no positive density")
    if out.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("ids repeat")
    return out
