"""Values that may be errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class EmptyError(Exception):
    """An error was asked for where there is none."""


@dataclass(frozen=True, eq=False)
class ErrorValue:
    """A held exception; equal only to itself."""

    error: BaseException | None = None

    def rethrow(self) -> None:
        raise self.error if self.error is not None else EmptyError("no error")

    def what(self) -> str:
        return str(self.error) if self.error is not None else "no error"

    def get_if(self, kind: type) -> BaseException | None:
        return self.error if isinstance(self.error, kind) else None

    def holds(self, kind: type) -> bool:
        return isinstance(self.error, kind)

    @property
    def type(self) -> type:
        return type(self.error)

    def map(self, change: Callable[[BaseException], BaseException]) -> ErrorValue:
        return self if self.error is None else ErrorValue(change(self.error))

    def __bool__(self) -> bool:
        return self.error is not None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ErrorValue) and self.error is other.error

    def __hash__(self) -> int:
        return id(self.error)


@dataclass(frozen=True)
class Result:
    """A value, or the error that came instead."""

    _value: Any = None
    error: ErrorValue = ErrorValue()

    @property
    def has_value(self) -> bool:
        return not self.error

    def value(self) -> Any:
        if self.error:
            self.error.rethrow()
        return self._value

    def value_or(self, other: Any) -> Any:
        return self._value if self.has_value else other

    def map(self, f: Callable[[Any], Any]) -> Result:
        return try_catch(lambda: f(self._value)) if self.has_value else self

    def get_error(self) -> ErrorValue:
        if not self.error:
            raise EmptyError("the result holds a value")
        return self.error


def try_catch(f: Callable[[], Any]) -> Result:
    try:
        return Result(f())
    except Exception as e:
        return Result(error=ErrorValue(e))


class Completion:
    """A callback that must be used exactly once."""

    def __init__(self, then: Callable[[Result], None]):
        self._then: Callable[[Result], None] | None = then

    def complete(self, result: Result) -> None:
        assert self._then is not None, "completed twice"
        then, self._then = self._then, None
        then(result)

    def close(self) -> None:
        assert self._then is None, "dropped without being completed"
