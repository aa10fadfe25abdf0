from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessella.functions import integers as I  # noqa: E741

MAX = {k: v[1] for k, v in I.WIDTHS.items()}
MIN = {k: v[0] for k, v in I.WIDTHS.items()}
SIGNED, ALL = ("int32", "int64"), tuple(I.WIDTHS)


def value(spark, column):
    v = spark.range(1).select(column.alias("v")).first()["v"]
    return int(v) if isinstance(v, Decimal) else v


def lit(x, dtype):
    return F.lit(str(x)).cast(I.WIDTHS[dtype][2])


@pytest.mark.parametrize("dtype", ALL)
def test_round_up_to_multiple(spark, dtype):
    cases = [(5, 2, 6), (103, 5, 105), (0, 5, 0), (7, 0, 7)]
    cases += [(5, -2, 6), (-5, 2, -4), (-5, -2, -4), (-6, 2, -6), (-6, -2, -6)] if dtype in SIGNED else []
    for x, m, want in cases:
        assert value(spark, I.round_up_to_multiple(lit(x, dtype), lit(m, dtype), dtype)) == want


@pytest.mark.parametrize("dtype", ALL)
def test_round_up_to_power_of_two(spark, dtype):
    cases = [(0, 1), (1, 1), (5, 8), (1024, 1024), (10000, 16384), (MAX[dtype], 0)] + ([(-5, 1), (MIN[dtype], 1)] if dtype in SIGNED else [])
    for x, want in cases:
        assert value(spark, I.round_up_to_power_of_two(lit(x, dtype), dtype)) == want
        assert value(spark, I.is_power_of_two(lit(x, dtype), dtype)) == (want == x)


@pytest.mark.parametrize("dtype", ALL)
def test_div_ceil(spark, dtype):
    cases = [(5, 2, 3), (103, 5, 21), (0, 5, 0), (5, 0, 0)]
    cases += [(5, -2, 3), (-5, 2, -2), (-5, -2, -2), (6, -2, 3), (-6, 2, -3), (-6, -2, -3)] if dtype in SIGNED else []
    for a, b, want in cases:
        assert value(spark, I.div_ceil(lit(a, dtype), lit(b, dtype), dtype)) == want


@pytest.mark.parametrize("dtype", ALL)
def test_overflow_raises(spark, dtype):
    one, top = lit(1, dtype), lit(MAX[dtype], dtype)
    assert value(spark, I.checked_add(top, lit(0, dtype), dtype)) == MAX[dtype]
    assert value(spark, I.checked_mul(top, one, dtype)) == MAX[dtype]
    for bad in (I.checked_add(top, one, dtype), I.checked_mul(top, lit(2, dtype), dtype), I.checked_sum(F.array(top, one), dtype), I.checked_product(F.array(top, lit(3, dtype)), dtype)):
        with pytest.raises(Exception, match="(?i)overflow"):
            value(spark, bad)


def test_folds_compare_and_casts(spark):
    empty = F.array().cast("array<bigint>")
    assert value(spark, I.checked_sum(empty)) == 0 and value(spark, I.checked_product(empty)) == 1
    assert value(spark, I.cmp_less(F.lit(-1), lit(MAX["uint64"], "uint64"))) and not value(spark, I.cmp_equal(F.lit(-1), lit(MAX["uint64"], "uint64")))
    assert value(spark, I.checked_cast(F.lit(7), "uint32")) == 7 and value(spark, I.checked_index(F.lit(-3), F.lit(2))) == -3
    for bad in (I.checked_cast(F.lit(-1), "uint32"), I.checked_cast(F.lit(1 << 40), "int32"), I.checked_index(F.lit(2), F.lit(2))):
        with pytest.raises(Exception):
            value(spark, bad)
    assert [value(spark, I.align_pad(F.lit(a), F.lit(8))) for a in (0, 1, 8, 15)] == [0, 7, 0, 1]
