"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators.durable import ship
from glosswork.operators.durable import written as materialise  # noqa: F401  tables in the shared folder

#: Splits that the files of a table make at least.
SPLITS = "spark.sql.files.minPartitionNum"
#: Most bytes of one Arrow batch handed to Python; a row longer than this travels alone.
BATCH_BYTES = 16 << 20
#: Most bytes that a side may have before it is joined by shuffle instead of broadcast.
BROADCAST_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Before Python functions run: bound Arrow batches by bytes, as texts differ in length by orders of magnitude, and ship the package.

    Files are split by a number that is set once, not by the executors there happen to be, so that a table read
    again has its rows in the same places even if executors were lost in between.
    """
    ship(spark)
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(max(8, spark.sparkContext.defaultParallelism)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def small_or_shuffled(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows stay within BROADCAST_BYTES; else leave the join to a shuffle."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shrink(values: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def grow(data: bytes, dtype) -> np.ndarray:
    """What ``shrink`` compressed."""
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 34), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
