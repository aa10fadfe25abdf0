"""Integer functions on columns with the widths of machine integers.

Spark has no unsigned types: uint32 is held as BIGINT and uint64 as DECIMAL(20,0). Results outside a width raise, as
ANSI arithmetic does for INT and BIGINT. All functions are built-in expressions and stay in generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (least, greatest, type that holds it, type to compute in)
WIDTHS = {
    "int32": (-(1 << 31), (1 << 31) - 1, "int", "bigint"),
    "int64": (-(1 << 63), (1 << 63) - 1, "bigint", "decimal(38,0)"),
    "uint32": (0, (1 << 32) - 1, "bigint", "bigint"),
    "uint64": (0, (1 << 64) - 1, "decimal(20,0)", "decimal(38,0)"),
}


def _lit(value: int, dtype: str) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)") if dtype == "uint64" else F.lit(value).cast(WIDTHS[dtype][2])


def _whole(a: Column, b: Column, dtype: str) -> Column:
    """Quotient, truncated toward zero."""
    return ((a - a % b) / b).cast("decimal(20,0)") if dtype == "uint64" else F.call_function("div", a, b)


def fits(value: Column, dtype: str) -> Column:
    """value as dtype; raises where it is out of range."""
    low, high, kind, _ = WIDTHS[dtype]
    exact = value.cast("decimal(38,0)")
    ok = exact.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
    return F.when(value.isNull() | ok, value.cast(kind)).otherwise(F.raise_error(F.lit(f"integer overflow: not a {dtype}")).cast(kind))


def round_up_to_multiple(x: Column, m: Column, dtype: str = "int64") -> Column:
    """The least multiple of |m| that is >= x; x itself if m is 0."""
    step = F.abs(F.nullif(m, _lit(0, dtype)))
    rest = x % step
    up = F.when(rest == 0, x).when(x < 0, x - rest).otherwise(x + (step - rest))
    return F.when(m == 0, x).otherwise(up).cast(WIDTHS[dtype][2])


def round_up_to_power_of_two(x: Column, dtype: str = "int64") -> Column:
    """The least power of two >= x, 1 at least; 0 if it does not fit dtype."""
    high = WIDTHS[dtype][1]
    powers = [1 << k for k in range(high.bit_length()) if 1 << k <= high]
    larger = reduce(lambda a, b: a + b, [(x > _lit(p, dtype)).cast("int") for p in powers])
    return F.element_at(F.array(*[_lit(p, dtype) for p in [*powers, 0]]), larger + 1)


def div_ceil(a: Column, b: Column, dtype: str = "int64") -> Column:
    """a / |b| rounded up (toward zero below zero); 0 if b is 0."""
    by = F.abs(F.nullif(b, _lit(0, dtype)))
    more = ((a >= 0) & (a % by != 0)).cast("int")
    return F.when(b == 0, _lit(0, dtype)).otherwise(_whole(a, by, dtype) + more).cast(WIDTHS[dtype][2])


def is_power_of_two(x: Column, dtype: str = "int64") -> Column:
    return (x > 0) & (round_up_to_power_of_two(x, dtype) == x)


def checked_add(a: Column, b: Column, dtype: str = "int64") -> Column:
    if dtype in ("int32", "int64"):
        return a.cast(WIDTHS[dtype][2]) + b.cast(WIDTHS[dtype][2])
    wide = WIDTHS[dtype][3]
    return fits(a.cast(wide) + b.cast(wide), dtype)


def checked_mul(a: Column, b: Column, dtype: str = "int64") -> Column:
    if dtype in ("int32", "int64"):
        return a.cast(WIDTHS[dtype][2]) * b.cast(WIDTHS[dtype][2])
    if dtype == "uint32":
        return fits(a.cast("decimal(19,0)") * b.cast("decimal(18,0)"), dtype)
    half = F.lit(1 << 32).cast("decimal(20,0)")  # a 128-bit product does not fit a decimal: the high part must be 0
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    high_a, high_b = _whole(a, half, dtype), _whole(b, half, dtype)
    rough = a.cast("double") * b.cast("double")
    exact = (high_a * (b % half) + high_b * (a % half)).cast("decimal(38,0)") * half + ((a % half) * (b % half)).cast("decimal(38,0)")
    return F.when(((high_a > 0) & (high_b > 0)) | (rough > 2.0**66), fits(F.lit(-1), dtype)).otherwise(fits(exact, dtype))


def checked_sum(values: Column, dtype: str = "int64") -> Column:
    """Sum of an array's elements; any step that overflows raises; 0 if empty."""
    return F.aggregate(values, _lit(0, dtype), lambda acc, x: checked_add(acc, x, dtype))


def checked_product(values: Column, dtype: str = "int64") -> Column:
    """Product of an array's elements; any step that overflows raises; 1 if empty."""
    return F.aggregate(values, _lit(1, dtype), lambda acc, x: checked_mul(acc, x, dtype))


def cmp_equal(a: Column, b: Column) -> Column:
    """Equality by value, whatever the widths and signs."""
    return a.cast("decimal(38,0)") == b.cast("decimal(38,0)")


def cmp_less(a: Column, b: Column) -> Column:
    return a.cast("decimal(38,0)") < b.cast("decimal(38,0)")


def checked_cast(x: Column, dtype: str) -> Column:
    return fits(x, dtype)


def checked_index(x: Column, length: Column, dtype: str = "int32") -> Column:
    """x as dtype; raises unless x < length."""
    kind = WIDTHS[dtype][2]
    return F.when(cmp_less(x, length), fits(x, dtype)).otherwise(F.raise_error(F.lit("index out of range")).cast(kind))


def align_pad(address: Column, alignment: Column) -> Column:
    """Bytes from address to the next multiple of alignment."""
    return (alignment - address % alignment) % alignment
