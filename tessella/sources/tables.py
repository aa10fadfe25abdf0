"""Arrays on Parquet tables. The index column must be dense and unique from 0; only the columns used are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.arrays import Array
from ..plans.runtime import Runtime


def read_array(runtime: Runtime, path: str, index: str, value, shape: tuple[int, ...], dtype: str | None = None) -> Array:
    return runtime.from_frame(runtime.spark.read.parquet(path), index, value, shape, dtype)


def read_vectors(runtime: Runtime, path: str, index: str, vectors: str, width: int, rows: int) -> Array:
    """A matrix from a column of arrays of one width."""
    frame = runtime.spark.read.parquet(path).select(index, F.posexplode(vectors).alias("j", "v"))
    return runtime.from_frame(frame, F.col(index) * width + F.col("j"), "v", (rows, width))


def write_array(array: Array, path: str) -> None:
    """The frame (i, v) as Parquet, in ranges of i."""
    frame: DataFrame = array.frame()
    frame.repartitionByRange("i").sortWithinPartitions("i").write.parquet(path)
