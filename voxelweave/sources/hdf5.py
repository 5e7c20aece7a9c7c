"""HDF5 initial conditions and mesh files, where h5py can be imported.

A file is one object that only a whole reader can open, so it is read by one task in slices of rows; large inputs belong
into Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelweave.config import MeshConfig

ROWS = 1 << 16


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py, which is not installed; use Parquet") from e
    return h5py


def scan(spark: SparkSession, path: str, config: MeshConfig) -> DataFrame:
    _h5py()
    from voxelweave.sources.points import checked

    dim, axes, velocities = config.dim, config.axes, config.velocities

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for _ in batches:
            with _h5py().File(path, "r") as f:
                if int(f["header"].attrs["dimension"]) != dim:
                    raise ValueError(f"the file's dimension is not {dim}")
                if f["seedpos"].ndim != 2 or f["vel"].ndim != 2:
                    raise ValueError("seedpos and vel must have two axes")
                n = len(f["seedpos"])
                for at in range(0, n, ROWS):
                    part = slice(at, min(n, at + ROWS))
                    pos, vel = f["seedpos"][part], f["vel"][part]
                    cols = [np.arange(part.start, part.stop), *(pos[:, k] for k in range(dim)), f["rho"][part], *(vel[:, k] for k in range(dim)), f["Energy"][part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", *axes, "rho", *velocities, "E"])

    schema = "id long, " + ", ".join(f"{c} double" for c in (*axes, "rho", *velocities, "E"))
    return checked(spark.range(0, 1, 1, 1).mapInArrow(read, schema), config)
