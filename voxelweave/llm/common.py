"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.lineage import discard, few_files, materialise, most_files, scratch_dir

__all__ = ["FEW_IDS", "SLICE", "WS", "WS_BYTES", "discard", "few_files", "fresh", "hash_fraction", "kernel", "materialise", "scratch_dir", "slices", "table", "train_rows", "words"]

#: Characters that separate words: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WS_BYTES = WS.encode()
#: Rows held at once by the Python kernels.
SLICE = 256
#: Up to this many short rows are broadcast; more meet their table in a shuffle.
FEW_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+` as UTF-8: bytes.split() separates at just these six characters."""
    return text.encode("utf-8", "replace").split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Returns what this process has freed to the system. Workers outlive their tasks, so else their peaks add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def kernel(df: DataFrame, run: Callable, schema, source: DataFrame | None = None, light: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema); each partition ends with its worker's free memory given back.

    With ``source``, df's partitions are joined first into no more than the files that a table made from it gets. Joined
    afterwards, each would keep its Arrow buffers up to the task's end.
    """
    if source is not None:
        df = df.coalesce(most_files(source, light))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df is called so."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def train_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds held_out: crc32 of the id's text mod 3 is 1. A null id counts as the empty text."""
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1)


def hash_fraction(col, fraction):
    """True for about this share of the values, the same ones on each run."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 30)) < F.lit(1 << 30) * fraction
