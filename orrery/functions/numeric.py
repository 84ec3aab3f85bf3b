"""Numeric expressions that keep the element type and the IEEE corner cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.types import FLOATS, INTEGERS


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, FLOATS)


def quotient(a: Column, b: Column, kind: T.DataType) -> Column:
    """Integers truncate toward zero and a zero divisor raises; floats give infinities and NaN."""
    if isinstance(kind, INTEGERS):
        safe = F.when(b != 0, b).when(b.isNotNull() & a.isNotNull(), F.raise_error(F.lit("integer division by zero")).cast(kind))
        return F.call_function("div", a, safe).cast(kind)
    a, b = a.cast("double"), b.cast("double")
    minus = (a < 0) != F.startswith(b.cast("string"), F.lit("-"))
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(minus, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, zero).otherwise(a / F.when(b != 0, b)).cast(kind)


def wrapped(e: Column, bits: int) -> Column:
    """An exact decimal result reduced to two's complement."""
    half = F.lit(str(1 << (bits - 1))).cast("decimal(38,0)")
    return (F.pmod(e.cast("decimal(38,0)") + half, F.lit(str(1 << bits)).cast("decimal(38,0)")) - half).cast({8: "byte", 16: "short", 32: "int", 64: "long"}[bits])


def natural_log(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(F.log(c))


def power(c: Column, exponent: float) -> Column:
    c = c.cast("double")
    if exponent == 0:
        return F.when(c.isNotNull(), F.lit(1.0))
    if exponent in (float("inf"), float("-inf")):
        return F.when(F.abs(c) == 1, F.lit(1.0)).otherwise(F.pow(c, F.lit(exponent)))
    if exponent != exponent:
        return F.when(c == 1, F.lit(1.0)).otherwise(F.when(c.isNotNull(), F.lit(float("nan"))))
    return F.pow(c, F.lit(exponent))


def total(c: Column, kind: T.DataType, wrap: bool = False) -> Column:
    """Sum of the present values in their own type; none at all: null."""
    if wrap and isinstance(kind, INTEGERS):
        return wrapped(F.sum(c.cast("decimal(20,0)")), {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)])
    return F.sum(c).cast(kind)


def least(c: Column, kind: T.DataType) -> Column:
    """Minimum; any NaN makes it NaN."""
    return F.when(F.bool_or(F.isnan(c)), F.lit(float("nan")).cast(kind)).otherwise(F.min(c)) if is_float(kind) else F.min(c)


def greatest(c: Column, kind: T.DataType) -> Column:
    """Maximum; Spark orders NaN above all numbers, so any NaN makes it NaN."""
    return F.max(c)


def quantile(c: Column, q: float, kind: T.DataType) -> Column:
    """Linear interpolation between order statistics (type 7); any NaN makes it NaN."""
    value = F.percentile(c, F.lit(q))
    return F.when(F.bool_or(F.isnan(c)), F.lit(float("nan"))).otherwise(value) if is_float(kind) else value


def place_of_least(c: Column, row: Column, kind: T.DataType) -> Column:
    """The first row of the minimum; the first NaN wins."""
    odd = F.when(F.isnan(c), 0).otherwise(1) if is_float(kind) else F.lit(0)
    return F.min_by(row, F.when(c.isNotNull(), F.struct(odd, c, row)))


def place_of_greatest(c: Column, row: Column, kind: T.DataType) -> Column:
    return F.max_by(row, F.when(c.isNotNull(), F.struct(c, -row)))
