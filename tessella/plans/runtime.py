"""The runtime: arrays are made by tasks, tasks read arrays, and errors travel along with the data.

A task turns the frames of its inputs into frames of its outputs, which is planning only; with eager=True outputs are
also computed and kept at once, so that `wait` means that the data is there and failures poison the outputs. Without
it (the default) nothing runs until data is read or prefetched, and Catalyst sees the plan of all tasks together.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.results import ErrorValue
from .events import BlockId, EventId, Scheduler


@dataclass(frozen=True)
class Host:
    """Runs a kernel on the elements (a function of columns), by default."""


@dataclass(frozen=True)
class Cuda:
    """Accepted for programs that name a device; placement is Spark's."""

    device: int = 0


@dataclass(frozen=True)
class CudaKernel:
    grid: Any = 1
    block: Any = 1
    device: int = 0


@dataclass(frozen=True)
class Frames:
    """Runs a function of whole frames: gets a frame (i, v) for each array, returns one for each output."""


@dataclass(frozen=True)
class Batches:
    """Runs a function of pandas series, element by element, in Arrow batches: for what columns cannot express."""


@dataclass(frozen=True)
class write:  # noqa: N801  reads as a mark on an argument
    """Marks an array argument as an output."""

    array: Any


#: Adapters for arguments of other types: type -> function from the argument to a scalar, an array or a write().
ARGUMENTS: dict[type, Callable[[Any], Any]] = {}


@dataclass
class Block:
    frame: DataFrame | None
    error: ErrorValue
    ready: EventId
    users: set[EventId]
    handles: int = 0
    kept: bool = False


class Submission:
    """What a task needs, put together piece by piece; callbacks get its event before submit() returns."""

    def __init__(self, runtime: Runtime, after: Iterable[EventId] = ()):
        self.runtime, self.after = runtime, list(after)
        self.inputs: list[BlockId] = []
        self.outputs = 0
        self._callbacks: list[Callable[[EventId], None]] = []

    def add_input(self, block: BlockId) -> int:
        """The input's number; a block that comes again keeps its own."""
        if block not in self.inputs:
            self.inputs.append(block)
        return self.inputs.index(block)

    def add_output(self) -> int:
        self.outputs += 1
        return self.outputs - 1

    def after_submission(self, callback: Callable[[EventId], None]) -> None:
        self._callbacks.append(callback)

    def submit(self, task: Callable[[dict[BlockId, DataFrame]], Iterable[DataFrame]]) -> EventId:
        with self.runtime._lock:
            event = self.runtime.submit_task(task, self.inputs, self.outputs, self.after)
            for callback in self._callbacks:
                callback(event)
        return event


class Runtime:
    def __init__(self, spark: SparkSession | None = None, eager: bool = False, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.eager, self.level = eager, level
        self.scheduler = Scheduler()
        self._blocks: dict[BlockId, Block] = {}
        self._lock = threading.RLock()

    def __enter__(self) -> Runtime:
        return self

    def __exit__(self, *_: Any) -> None:
        self.shutdown()

    # ---- arrays ------------------------------------------------------------------------------

    def allocate(self, data: Any, shape: tuple[int, ...] | None = None, dtype: str | None = None) -> Any:
        """An array with a copy of driver data: a sequence or NumPy array of any rank."""
        from ..operators.arrays import Array, spark_type

        values = np.asarray(data)
        if values.dtype.kind in "iu" and values.dtype.itemsize < 4:
            values = values.astype("int32")
        shape = tuple(values.shape) if shape is None else tuple(shape)
        if math.prod(shape) != values.size:
            raise ValueError("the shape does not fit the data")
        dtype = dtype or str(values.dtype)
        flat = pa.array(values.reshape(-1))
        flat = flat.cast(pa.decimal128(20, 0)) if dtype == "uint64" else flat
        table = pa.table({"i": pa.array(np.arange(values.size)), "v": flat})
        schema = f"i bigint, v {spark_type(dtype)}"
        frame = self.spark.createDataFrame(table).select("i", F.col("v").cast(spark_type(dtype)).alias("v")) if values.size else self.spark.createDataFrame([], schema)
        return Array(self, shape, dtype, self._insert(frame))

    def from_frame(self, frame: DataFrame, index: str | Column, value: str | Column, shape: tuple[int, ...], dtype: str | None = None) -> Any:
        """An array on a table: index must be its dense row-major position, unique from 0."""
        from ..operators.arrays import Array

        index, value = (F.col(c) if isinstance(c, str) else c for c in (index, value))
        made = frame.select(index.cast("bigint").alias("i"), value.alias("v"))
        return Array(self, tuple(shape), dtype or made.schema["v"].dataType.simpleString(), self._insert(made))

    def declare(self, *shape: int, dtype: str = "float64") -> Any:
        """An array without data; a task must write it before it is read."""
        from ..operators.arrays import Array

        return Array(self, tuple(shape), dtype, None)

    def fill(self, shape: tuple[int, ...], pattern: list, dtype: str) -> Any:
        """An array that repeats a pattern; the last repetition may be part of it."""
        from ..operators.arrays import Array, spark_type

        cells = F.array(*[F.lit(p).cast(spark_type(dtype)) for p in pattern])
        frame = self.spark.range(math.prod(shape)).select(F.col("id").alias("i"), F.element_at(cells, (F.col("id") % len(pattern) + 1).cast("int")).alias("v"))
        return Array(self, tuple(shape), dtype, self._insert(frame))

    def _insert(self, frame: DataFrame) -> BlockId:
        block = BlockId(self.scheduler.new_event())  # never enters the scheduler: it has ended
        self._blocks[block] = Block(frame, ErrorValue(), block.event, set())
        return block

    def block(self, block: BlockId) -> Block:
        return self._blocks[block]

    def frame(self, block: BlockId) -> DataFrame:
        """Waits for the block's task; raises its error."""
        found = self._blocks[block]
        self.scheduler.wait(found.ready)
        if found.error:
            found.error.rethrow()
        return found.frame

    # ---- tasks -------------------------------------------------------------------------------

    def submit(self, launcher: Any, kernel: Callable, *args: Any, after: Iterable[EventId] = ()) -> EventId:
        """Run kernel on args: arrays are read, write(array) is written, anything else is passed on."""
        from ..operators.arrays import Array, run_kernel

        args = tuple(ARGUMENTS[type(a)](a) if type(a) in ARGUMENTS else a for a in args)
        outputs = [a.array for a in args if isinstance(a, write)]
        inputs = [a for a in args if isinstance(a, Array)]
        for a in inputs:
            if a.block_id is None:
                raise RuntimeError("an array is read that no task has written")
        held = tuple((a.block_id, a.shape) if isinstance(a, Array) else a for a in args)
        task = Submission(self, after)
        for a in inputs:
            task.add_input(a.block_id)
        for a in outputs:
            block = task.add_output()
            task.after_submission(lambda event, a=a, block=block: a._rebind(BlockId(event, block)))
        return task.submit(lambda frames: run_kernel(launcher, kernel, args, held, frames))

    def submit_task(self, task: Callable[[dict[BlockId, DataFrame]], Iterable[DataFrame]], inputs: Iterable[BlockId] = (), outputs: int = 0, after: Iterable[EventId] = ()) -> EventId:
        """The explicit form: task gets the frames of the input blocks and returns one for each output.

        The outputs are the blocks (event, 0), (event, 1), ...; inputs are waited for, and after as well.
        """
        with self._lock:
            event = self.scheduler.new_event()
            sources = {b: self._blocks[b] for b in inputs}  # a block that comes twice is one input
            made = [BlockId(event, k) for k in range(outputs)]
            before = [*after, *(s.ready for s in sources.values())]
            for s in sources.values():
                s.users.add(event)
            for b in made:
                self._blocks[b] = Block(None, ErrorValue(), event, set())

            def work() -> None:
                try:
                    done = list(task({b: self.frame(b) for b in sources}))
                    if len(done) != len(made):
                        raise TypeError(f"the kernel gave {len(done)} outputs, {len(made)} were asked for")
                    for b, frame in zip(made, done, strict=True):
                        self._blocks[b].frame = frame
                        if self.eager:
                            self._keep(b)
                except Exception as e:
                    error = e
                    for b in made:
                        self._blocks[b].error = ErrorValue(error)

            return self.scheduler.insert(work, before, event)

    def _keep(self, block: BlockId) -> None:
        found = self._blocks[block]
        if not found.kept:
            found.kept = True
            found.frame = found.frame.persist(self.level)
            found.frame.count()

    def prefetch(self, block: BlockId, after: Iterable[EventId] = ()) -> EventId:
        """Compute and keep the block in the background; failures stay silent until it is read."""
        found = self._blocks[block]

        def work() -> None:
            if not found.error:
                try:
                    self._keep(block)
                except Exception as e:
                    found.error = ErrorValue(e)

        event = self.scheduler.insert(work, [*after, found.ready])
        found.users.add(event)
        return event

    def delete(self, block: BlockId, after: Iterable[EventId] = ()) -> EventId:
        """Drop the block once everything that was asked of it has ended; harmless if it is an error."""
        found = self._blocks[block]

        def work() -> None:
            self._blocks.pop(block, None)
            if found.kept and found.frame is not None:
                found.frame.unpersist()

        return self.scheduler.insert(work, [*after, found.ready, *found.users])

    # ---- events ------------------------------------------------------------------------------

    def join(self, *events: EventId | Iterable[EventId]) -> EventId:
        flat = [e for x in events for e in ([x] if isinstance(x, EventId) else x)]
        return flat[0] if len(set(flat)) == 1 else self.scheduler.insert(None, flat)

    def is_done(self, event: EventId) -> bool:
        return self.scheduler.is_done(event)

    def wait(self, event: EventId) -> None:
        """Until the event has ended; says nothing of errors."""
        self.scheduler.wait(event)

    def wait_until(self, event: EventId, deadline: float) -> bool:
        """deadline: on time.monotonic()'s clock."""
        return self.scheduler.wait(event, deadline)

    def wait_for(self, event: EventId, seconds: float) -> bool:
        return self.scheduler.wait(event, time.monotonic() + seconds)

    def submit_barrier(self) -> EventId:
        return self.scheduler.insert(None, self.scheduler.active())

    def block_barrier(self, block: BlockId) -> EventId:
        found = self._blocks[block]
        return self.scheduler.insert(None, [found.ready, *found.users])

    def rounds(self, n: int, task: Callable[[int], EventId], in_flight: int = 5) -> list[EventId]:
        """task(0), task(1), ...: each gives its event; no more than in_flight of them are open at a time."""
        events: list[EventId] = []
        for k in range(n):
            events.append(task(k))
            if len(events) >= in_flight:
                self.wait(events[-in_flight])
        self.synchronize()
        return events

    def synchronize(self) -> None:
        self.wait(self.submit_barrier())

    def shutdown(self) -> None:
        self.scheduler.shutdown()
        for found in self._blocks.values():
            if found.kept and found.frame is not None:
                found.frame.unpersist()
        self._blocks.clear()

    def num_devices(self) -> int:
        return 1

    def device_info(self, device: int = 0) -> dict[str, Any]:
        if device:
            raise LookupError(f"no device {device}")
        return {"name": "CPU", "memory": 0, "cores": self.spark.sparkContext.defaultParallelism}
