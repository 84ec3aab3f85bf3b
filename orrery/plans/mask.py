"""Row masks: two-valued predicates over nullable columns.

A mask carries two plain conditions, one that is TRUE on just the selected
rows and one that is TRUE on just the others. Both are NULL or FALSE elsewhere,
so a filter takes them as they are and Catalyst pushes them into the scan;
negation swaps them, and De Morgan's laws build them up. Only a mask that
becomes a column is wrapped in coalesce().
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import ContractError


class Mask:
    def __init__(self, yes: Column, no: Column):
        self.yes, self.no = yes, no

    def __and__(self, other: Mask) -> Mask:
        return Mask(self.yes & other.yes, self.no | other.no)

    def __or__(self, other: Mask) -> Mask:
        return Mask(self.yes | other.yes, self.no & other.no)

    def __invert__(self) -> Mask:
        return Mask(self.no, self.yes)

    def column(self) -> Column:
        """The mask as a boolean column without nulls."""
        return F.coalesce(self.yes, F.lit(False))

    def count(self) -> Column:
        return F.count_if(self.yes)

    def any(self) -> Column:
        return F.coalesce(F.bool_or(self.column()), F.lit(False))

    def all(self) -> Column:
        """True over no rows at all."""
        return F.coalesce(F.bool_and(self.column()), F.lit(True))


def every() -> Mask:
    return Mask(F.lit(True), F.lit(False))


def none() -> Mask:
    return ~every()


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def compare(op: Callable[[Column, Column], Column], a: Column, b: Column, floats: tuple[bool, bool] = (False, False), unequal: bool = False) -> Mask:
    """``op`` on two columns. A null on either side never matches; NaN matches nothing but ``!=``."""
    null = a.isNull() | b.isNull()
    odd = [F.isnan(c) for c, is_float in ((a, floats[0]), (b, floats[1])) if is_float]
    if not odd:
        return Mask(op(a, b), null | ~op(a, b))
    nan = _either(odd)
    if unequal:
        return Mask((a.isNotNull() & b.isNotNull() & nan) | op(a, b), null | (~nan & ~op(a, b)))
    return Mask(reduce(lambda x, y: x & ~y, odd, op(a, b)), null | nan | ~op(a, b))


def between(c: Column, low, high, is_float: bool = False) -> Mask:
    if low == low and high == high and high < low:
        raise ContractError("the upper bound is below the lower one")
    if low != low or high != high:
        return none()
    within = c.between(F.lit(low), F.lit(high))
    return Mask(within & ~F.isnan(c), c.isNull() | F.isnan(c) | ~within) if is_float else Mask(within, c.isNull() | ~within)


def within(c: Column, values: list) -> Mask:
    values = [v for v in values if v is not None and v == v]
    return Mask(c.isin(values), c.isNull() | ~c.isin(values)) if values else none()


def truth(c: Column) -> Mask:
    """A nullable boolean column: null is not selected."""
    return Mask(c, c.isNull() | ~c)


def is_null(c: Column) -> Mask:
    return Mask(c.isNull(), c.isNotNull())


def is_nan(c: Column) -> Mask:
    return Mask(c.isNotNull() & F.isnan(c), c.isNull() | ~F.isnan(c))
