"""Sort keys: nulls last either way unless said otherwise, NaN below all numbers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import ColumnTypeError
from orrery.functions.numeric import is_float
from orrery.operators.series import Series


@dataclass(frozen=True)
class SortKey:
    expr: Column
    floats: bool = False
    falling: bool = False
    nulls_at_start: bool = False

    def reverse(self) -> SortKey:
        return replace(self, falling=not self.falling)

    def nulls_first(self) -> SortKey:
        return replace(self, nulls_at_start=True)

    def nulls_last(self) -> SortKey:
        return replace(self, nulls_at_start=False)

    def lower(self) -> list[Column]:
        def way(c: Column) -> Column:
            if self.falling:
                return c.desc_nulls_first() if self.nulls_at_start else c.desc_nulls_last()
            return c.asc_nulls_first() if self.nulls_at_start else c.asc_nulls_last()

        odd = [way(F.when(self.expr.isNotNull(), ~F.isnan(self.expr)))] if self.floats else []
        return [*odd, way(self.expr)]


def asc(s: Series) -> SortKey:
    if isinstance(s.dtype, (T.BooleanType, T.MapType)):
        raise ColumnTypeError(f"{s.dtype.simpleString()} has no order")
    return SortKey(s.expr, is_float(s.dtype))


def desc(s: Series) -> SortKey:
    return asc(s).reverse()


def by(expr: Column) -> SortKey:
    """Sort by any expression, which takes the place of a comparison function."""
    return SortKey(expr)
