"""Handles of dense arrays: a shape and a block whose frame has a row (i, v) for each element, i row-major from 0."""

from __future__ import annotations

import math
import weakref
from decimal import Decimal
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.views import View
from ..plans.events import BlockId, EventId
from ..plans.runtime import Batches, Frames, Runtime, write

#: Spark's type for each element type, and the bytes of one element.
ELEMENTS = {
    "bool": ("boolean", 1), "int32": ("int", 4), "int64": ("bigint", 8), "uint32": ("bigint", 4), "uint64": ("decimal(20,0)", 8),
    "float32": ("float", 4), "float64": ("double", 8), "int": ("int", 4), "bigint": ("bigint", 8), "float": ("float", 4), "double": ("double", 8),
}
NUMPY = {"int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}
MOST = (1 << 31) - 1


def spark_type(dtype: str) -> str:
    return ELEMENTS[dtype][0] if dtype in ELEMENTS else dtype


def checked_size(shape: tuple[int, ...]) -> int:
    size = math.prod(shape)
    if size > MOST:
        raise OverflowError("an array's size must fit 32 bits")
    return size


class Array:
    def __init__(self, runtime: Runtime, shape: tuple[int, ...], dtype: str, block: BlockId | None):
        if any(n < 0 for n in shape):
            raise ValueError("sizes can't be negative")
        self.runtime, self.shape, self.dtype, self.block_id = runtime, tuple(shape), dtype, None
        self._finalizer = None
        if block is not None:
            self._rebind(block)

    def _rebind(self, block: BlockId) -> None:
        self.release()
        self.block_id = block
        self.runtime.block(block).handles += 1
        self._finalizer = weakref.finalize(self, _drop, self.runtime, block)
        self._finalizer.atexit = False

    def release(self) -> None:
        """Give the block up; it goes when the last handle has and its readers have ended."""
        if self._finalizer is not None:
            self._finalizer()
        self._finalizer = self.block_id = None

    # ---- shape and identity ------------------------------------------------------------------

    def rank(self) -> int:
        return len(self.shape)

    def size(self, axis: int | None = None) -> int:
        if axis is None:
            return checked_size(self.shape)
        return self.shape[axis] if axis < len(self.shape) else 1

    def sizes(self) -> tuple[int, ...]:
        return self.shape

    def is_empty(self) -> bool:
        return 0 in self.shape

    def header(self) -> dict[str, Any]:
        return {"dtype": self.dtype, "size": self.size(), "type": spark_type(self.dtype), "bytes": self.size() * ELEMENTS.get(spark_type(self.dtype), ("", 0))[1]}

    def read_header(self) -> dict[str, Any]:
        """Waits for the task that makes the array; raises its error."""
        self.frame()
        return self.header()

    def has_block(self) -> bool:
        return self.block_id is not None

    def block(self) -> BlockId:
        assert self.block_id is not None, "the array has no data"
        return self.block_id

    id = block

    def reshape(self, *shape: int) -> Array:
        """The same data under another shape of the same size."""
        if math.prod(shape) != self.size():
            raise RuntimeError(f"{self.size()} elements do not make a shape of {shape}")
        return Array(self.runtime, shape, self.dtype, self.block_id)

    def flatten(self) -> Array:
        return self.reshape(self.size())

    # ---- data --------------------------------------------------------------------------------

    def frame(self) -> DataFrame:
        """The frame (i, v), not in order."""
        return self.runtime.frame(self.block())

    def with_coordinates(self, *names: str) -> DataFrame:
        """A frame with a column for each axis, and v."""
        columns, _ = View.of(self.shape, self.frame()).coordinates()
        return self.frame().select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], "v")

    def view(self, mapping: str = "right_to_left", strides: tuple[int, ...] | None = None) -> View:
        return View.of(self.shape, self.frame(), mapping, strides)

    def read(self) -> list:
        """All elements in order, on the driver."""
        if self.is_empty():
            return []
        return [int(x) if isinstance(x, Decimal) else x for x in self._column().to_pylist()]

    def _column(self) -> pa.ChunkedArray:
        """All elements in order, as they come from Spark in Arrow batches."""
        column = self.frame().orderBy("i").select("v").toArrow().column(0)
        if len(column) != self.size():
            raise ValueError(f"the array has {len(column)} elements, not {self.size()}")
        return column

    def read_numpy(self) -> np.ndarray:
        kind = NUMPY.get(self.dtype, self.dtype)
        if self.is_empty() or kind == "uint64":
            return np.array(self.read(), dtype=kind).reshape(self.shape)
        return self._column().to_numpy().astype(kind, copy=False).reshape(self.shape)

    def read_into(self, target: np.ndarray) -> None:
        """Each axis must match."""
        if target.shape != self.shape:
            raise ValueError(f"shapes differ: {target.shape} and {self.shape}")
        target[...] = self.read_numpy()

    def read_bytes(self, n: int) -> bytes:
        data = self.read_numpy().tobytes()
        if len(data) != n:
            raise ValueError(f"the array has {len(data)} bytes, not {n}")
        return data

    def prefetch(self, after: tuple[EventId, ...] = ()) -> EventId | None:
        """Start to compute and keep the data; nothing without data."""
        return self.runtime.prefetch(self.block_id, after) if self.block_id is not None else None

    def synchronize(self) -> None:
        """Until all that was asked of this array has ended."""
        if self.block_id is not None:
            self.runtime.wait(self.runtime.block_barrier(self.block_id))


def _drop(runtime: Runtime, block: BlockId) -> None:
    found = runtime._blocks.get(block)
    if found is not None:
        found.handles -= 1
        if found.handles == 0:
            try:
                runtime.delete(block)
            except RuntimeError:  # shut down: everything has gone
                pass


# ---- kernels -------------------------------------------------------------------------------------


def run_kernel(launcher: Any, kernel: Callable, args: tuple, held: tuple, frames: dict[BlockId, DataFrame]) -> list[DataFrame]:
    """Frames of the outputs. held: (block, shape) at the time of submission in place of each array."""
    outputs = [a.array for a in args if isinstance(a, write)]
    if isinstance(launcher, Frames):
        done = kernel(*[frames[h[0]] if isinstance(a, Array) else a for a, h in zip(args, held, strict=True) if not isinstance(a, write)])
        return list(done) if isinstance(done, tuple) else [done]
    blocks = list(dict.fromkeys(h[0] for a, h in zip(args, held, strict=True) if isinstance(a, Array)))
    sizes = {math.prod(h[1]) for a, h in zip(args, held, strict=True) if isinstance(a, Array)} | {a.size() for a in outputs}
    if len(sizes) > 1:
        raise ValueError(f"arrays of different sizes: {sorted(sizes)}")
    names = {b: f"v{k}" for k, b in enumerate(blocks)}
    if blocks:
        joined = frames[blocks[0]].select("i", F.col("v").alias("v0"))
        for b in blocks[1:]:
            joined = joined.join(frames[b].select("i", F.col("v").alias(names[b])), "i")
    else:
        joined = outputs[0].runtime.spark.range(sizes.pop()).select(F.col("id").alias("i"))
    given = [F.col(names[h[0]]) if isinstance(a, Array) else a for a, h in zip(args, held, strict=True) if not isinstance(a, write)]
    if isinstance(launcher, Batches):
        columns = [g for g in given if isinstance(g, Column)]
        kind = spark_type(outputs[0].dtype)

        scalars = [_MARK if isinstance(g, Column) else g for g in given]

        def call(*series: pd.Series) -> pd.Series:
            it = iter(series)
            return kernel(*[next(it) if isinstance(s, _Mark) else s for s in scalars])

        done = (F.pandas_udf(call, kind)(*columns),)
    else:
        done = kernel(*given)
        done = done if isinstance(done, tuple) else (done,)
    columns = [c if isinstance(c, Column) else F.lit(c) for c in done]
    return [joined.select("i", c.cast(spark_type(a.dtype)).alias("v")) for c, a in zip(columns, outputs, strict=True)]


class _Mark:
    """Stands for a column among a kernel's arguments."""


_MARK = _Mark()


# ---- kernels that come with the library ------------------------------------------------------------


def vector_add(a: Column, b: Column) -> Column:
    return a + b


def copy_array(runtime: Runtime, source: Array, target: Array) -> EventId:
    if source.shape != target.shape:
        raise ValueError("shapes differ")
    from ..plans.runtime import Host

    return runtime.submit(Host(), lambda v: v, source, write(target))


def fill_value(runtime: Runtime, target: Array, value: Any) -> EventId:
    from ..plans.runtime import Host

    return runtime.submit(Host(), lambda: F.lit(value), write(target))


def verify_all(array: Array, expected: float, tolerance: float = 1e-9) -> DataFrame:
    """One row: whether all elements are within tolerance of expected; so it is without elements."""
    return array.frame().select(F.coalesce(F.bool_and(F.abs(F.col("v") - expected) <= tolerance), F.lit(True)).alias("ok"))
