"""Index algebra: domains, layouts and views over dense arrays.

Points may hold integers or columns; formulas are the same, so a view's index arithmetic can be evaluated on the
driver or become part of a query plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FixedArray(tuple):
    """A tuple of one element type; of length 1 it converts to its element."""

    def __new__(cls, *items: Any) -> FixedArray:
        return super().__new__(cls, items)

    def __int__(self) -> int:
        if len(self) != 1:
            raise TypeError("only one element converts to a number")
        return int(self[0])

    __index__ = __int__

    def size(self) -> int:
        return len(self)


@dataclass(frozen=True)
class Subbounds:
    """Axes that begin at offsets and have sizes."""

    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def rank(self) -> int:
        return len(self.sizes)

    def size(self, axis: int) -> int:
        return self.sizes[axis] if axis < self.rank else 1

    def offset(self, axis: int) -> int:
        return self.offsets[axis] if axis < self.rank else 0

    def remove_axis(self, axis: int) -> Subbounds:
        return Subbounds(_without(self.offsets, axis), _without(self.sizes, axis))

    def to_subbounds(self) -> Subbounds:
        return Subbounds(self.offsets, self.sizes)


class Bounds(Subbounds):
    """Axes that begin at 0."""

    def __init__(self, *sizes: int):
        super().__init__((0,) * len(sizes), tuple(sizes))

    def remove_axis(self, axis: int) -> Bounds:
        return Bounds(*_without(self.sizes, axis))


class StaticBounds(Bounds):
    """Bounds that are constants of the program; converts to Bounds."""

    def to_bounds(self) -> Bounds:
        return Bounds(*self.sizes)


def _without(items: tuple, axis: int) -> tuple:
    return items[:axis] + items[axis + 1 :]


@dataclass(frozen=True)
class Strided:
    """Elements at the sum of (coordinate - offset) * stride."""

    domain: Subbounds
    strides: tuple[int, ...]

    def stride(self, axis: int) -> int:
        return self.strides[axis]

    def is_empty(self) -> bool:
        return 0 in self.domain.sizes

    def linearize(self, point: tuple) -> Any:
        steps = [(p - o) * s for p, o, s in zip(point, self.domain.offsets, self.strides, strict=True)]
        return reduce(lambda a, b: a + b, steps, 0)

    def required_span(self) -> int:
        """Elements from the first to the last one reached."""
        return 0 if self.is_empty() else 1 + sum((n - 1) * s for n, s in zip(self.domain.sizes, self.strides, strict=True))

    def remove_axis(self, axis: int) -> Strided:
        return Strided(self.domain.remove_axis(axis), _without(self.strides, axis))

    def to_strided(self) -> Strided:
        return Strided(self.domain, self.strides)


class StaticStrided(Strided):
    """A strided layout whose strides are constants of the program."""


class RightToLeft(Strided):
    """Row-major: the last axis is contiguous."""

    def __init__(self, domain: Subbounds):
        super().__init__(domain, tuple(math.prod(domain.sizes[k + 1 :]) for k in range(domain.rank)))

    def remove_axis(self, axis: int) -> Strided:
        return RightToLeft(self.domain.remove_axis(0)) if axis == 0 else super().remove_axis(axis)


class LeftToRight(Strided):
    """Column-major: the first axis is contiguous."""

    def __init__(self, domain: Subbounds):
        super().__init__(domain, tuple(math.prod(domain.sizes[:k]) for k in range(domain.rank)))

    def remove_axis(self, axis: int) -> Strided:
        last = self.domain.rank - 1
        return LeftToRight(self.domain.remove_axis(last)) if axis == last else super().remove_axis(axis)


def convert_domain(domain: Subbounds, to: type[Subbounds]) -> Subbounds:
    """To the same kind, from constants to Bounds, from any to Subbounds; else an error, as offsets would be lost."""
    if type(domain) is to:
        return domain
    if to is Subbounds:
        return domain.to_subbounds()
    if to is Bounds and isinstance(domain, Bounds):
        return Bounds(*domain.sizes)
    raise TypeError(f"{type(domain).__name__} does not convert to {to.__name__}")


def convert_layout(layout: Strided, to: type[Strided], domain: type[Subbounds] | None = None) -> Strided:
    """To a strided layout from any, to an order of axes from the same order only; the domain is converted with it."""
    new = layout.domain if domain is None else convert_domain(layout.domain, domain)
    if to is Strided:
        return Strided(new, layout.strides)
    if type(layout) is to and to in (RightToLeft, LeftToRight):
        return to(new)
    raise TypeError(f"{type(layout).__name__} does not convert to {to.__name__}")


MAPPINGS = {"right_to_left": RightToLeft, "left_to_right": LeftToRight, "strided": Strided}


@dataclass(frozen=True)
class View:
    """A window on the elements of a frame (i, v): base is the index of the domain's first point."""

    layout: Strided
    frame: DataFrame | None = None
    base: int = 0
    writable: bool = False

    @classmethod
    def of(cls, shape: tuple[int, ...], frame: DataFrame | None = None, mapping: str = "right_to_left", strides: tuple[int, ...] | None = None) -> View:
        domain = Bounds(*shape)
        return cls(Strided(domain, strides) if mapping == "strided" else MAPPINGS[mapping](domain), frame)

    @property
    def rank(self) -> int:
        return self.layout.domain.rank

    def size(self, axis: int | None = None) -> int:
        return math.prod(self.sizes()) if axis is None else self.layout.domain.size(axis)

    def sizes(self) -> tuple[int, ...]:
        return self.layout.domain.sizes

    def size_in_bytes(self, item: int) -> int:
        return self.size() * item

    def is_empty(self) -> bool:
        return self.layout.is_empty()

    def stride(self, axis: int) -> int:
        return self.layout.stride(axis)

    def strides(self) -> tuple[int, ...]:
        return self.layout.strides

    def offset(self, axis: int) -> int:
        return self.layout.domain.offset(axis)

    begin = offset

    def end(self, axis: int) -> int:
        return self.offset(axis) + self.size(axis)

    def in_bounds(self, point: tuple) -> Any:
        tests = [(p >= self.begin(k)) & (p < self.end(k)) for k, p in enumerate(point)]
        return reduce(lambda a, b: a & b, tests, True)

    def linearize_index(self, point: tuple) -> Any:
        return self.layout.linearize(point)

    def data_at(self, point: tuple) -> Any:
        """The element's index in the frame."""
        return self.base + self.linearize_index(point)

    def access(self, *point: int) -> Any:
        if len(point) != self.rank:
            raise TypeError(f"{self.rank} coordinates expected")
        row = self.frame.where(F.col("i") == self.data_at(point)).select("v").first()  # pushed down to the scan
        if row is None:
            raise IndexError(point)
        return row["v"]

    __call__ = access

    def value(self) -> Any:
        """The element of a view without axes."""
        return self.access()

    def __getitem__(self, index: int) -> Any:
        """v[i][j]...: the first axis at index; the element itself after the last."""
        left = self.drop_axis(0, index)
        return left.value() if left.rank == 0 else left

    def drop_axis(self, axis: int, index: int | None = None) -> View:
        """The axis fixed at a coordinate, its begin if none is given."""
        index = self.begin(axis) if index is None else index
        return View(self.layout.remove_axis(axis), self.frame, self.base + (index - self.begin(axis)) * self.stride(axis), self.writable)

    def sub(self, offsets: tuple[int, ...], sizes: tuple[int, ...]) -> View:
        """A part that keeps its coordinates."""
        domain = Subbounds(tuple(offsets), tuple(sizes))
        moved = sum((o - b) * s for o, b, s in zip(offsets, self.layout.domain.offsets, self.strides(), strict=True))
        return View(Strided(domain, self.strides()), self.frame, self.base + moved, self.writable)

    def read_only(self) -> View:
        return View(self.layout, self.frame, self.base, False)

    def put(self, value: Any) -> DataFrame:
        """The whole frame with this view's elements replaced: value may be a column of i and v. For writable views."""
        if not self.writable:
            raise TypeError("the view is read-only")
        _, inside = self.coordinates()
        span = self.layout.required_span()
        here = inside & F.col("i").between(self.base, self.base + span - 1) if span else F.lit(False)
        value = value if isinstance(value, Column) else F.lit(value)
        return self.frame.select("i", F.when(here, value.cast(self.frame.schema["v"].dataType)).otherwise(F.col("v")).alias("v"))

    def coordinates(self) -> tuple[list[Column], Column]:
        """(a column for each axis, whether the element belongs to the view) from the frame's i."""
        rest = F.col("i") - self.base
        found: dict[int, Column] = {}
        inside = rest >= 0
        for axis in sorted(range(self.rank), key=lambda k: (-self.stride(k), k)):
            if self.size(axis) == 1:
                found[axis] = F.lit(0).cast("bigint")
                continue
            found[axis] = F.call_function("div", rest, F.lit(self.stride(axis)))
            inside = inside & (found[axis] < self.size(axis))
            rest = rest % self.stride(axis)
        return [found[k] + self.offset(k) for k in range(self.rank)], inside & (rest == 0)

    def frame_of(self) -> DataFrame:
        """The view's elements as a frame of their own: i is the row-major position in the view."""
        span = self.layout.required_span()
        columns, inside = self.coordinates()
        at = RightToLeft(self.layout.domain).linearize(tuple(columns)) if columns else F.lit(0)
        near = self.frame.where(F.col("i").between(self.base, self.base + span - 1)) if span else self.frame.limit(0)
        return near.where(inside).select(F.lit(at).cast("bigint").alias("i") if isinstance(at, int) else at.cast("bigint").alias("i"), "v")


def _factory(name: str, device: bool, strided: bool, part: bool, writable: bool):
    def make(frame: DataFrame | None, shape: tuple[int, ...], mapping: str = "right_to_left", strides: tuple[int, ...] | None = None, offsets: tuple[int, ...] | None = None) -> View:
        layout = View.of(shape, frame, "strided" if strides is not None else mapping, strides).layout
        domain = Subbounds(tuple(offsets or (0,) * len(shape)), tuple(shape)) if part else layout.domain
        if strided or part:
            layout = Strided(domain, layout.strides)
        return View(layout, frame, 0, writable)

    make.__name__ = make.__qualname__ = name
    kind = f"{'strided ' if strided else ''}view{' with offsets' if part else ''}"
    make.__doc__ = f"A {'writable' if writable else 'read-only'} {kind}{'; the device is accepted, placement is Spark' + chr(39) + 's' if device else ''}."
    return make


#: view, view_mut, subview, strided_view, cuda_view, ...: every combination of device, strides, offsets and writing.
FACTORIES = {
    name: _factory(name, bool(device), bool(strided), bool(part), bool(mut))
    for device in ("", "cuda_") for strided in ("", "strided_") for part in ("", "sub") for mut in ("", "_mut")
    for name in [f"{device}{strided}{part}view{mut}"]
}
globals().update(FACTORIES)
