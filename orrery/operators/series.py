"""A typed column expression of a frame: kernels, masks, reductions, maps."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import ColumnTypeError, ContractError, InvalidRowError
from orrery.functions import numeric as N
from orrery.plans import mask as M
from orrery.types import FLOATS, INTEGERS

_CASTABLE = (*INTEGERS, *FLOATS, T.DecimalType)
#: The column of a frame of one series.
VALUE = "value"


def _udf(fn: Callable, kind: T.DataType, skip_null: bool) -> Callable:
    """An Arrow UDF. Nulls are skipped inside it: Spark does not skip them for a Python function."""
    if not callable(fn):
        raise ContractError("a callback is needed")
    call = (lambda *a: None if any(x is None for x in a) else fn(*a)) if skip_null else fn
    return F.udf(call, kind, useArrow=True)


class Series:
    """``prefix``: (aggregate, merge, value) of a running aggregate over all rows, by which a frame computes it in ranges of rows."""

    def __init__(self, expr: Column, dtype: T.DataType, nullable: bool = True, frame=None, prefix: tuple | None = None):
        self.expr, self.dtype, self.nullable, self.frame, self.prefix = expr, dtype, nullable, frame, prefix

    def _new(self, expr: Column, dtype: T.DataType | None = None, nullable: bool | None = None) -> Series:
        return Series(expr, dtype or self.dtype, self.nullable if nullable is None else nullable, self.frame)

    # construction
    @staticmethod
    def of(spark: SparkSession, values: list, dtype: T.DataType | None = None) -> Series:
        """A series of its own from local values; None is null. Without a value, ``dtype`` tells the type (else string)."""
        from orrery.operators.frame import Frame, _kind

        field = T.StructField(VALUE, dtype or _kind(values), any(v is None for v in values))
        return Frame._local(spark, [(v,) for v in values], T.StructType([field]))[VALUE]

    @staticmethod
    def from_optionals(spark: SparkSession, cells: list[tuple], dtype: T.DataType | None = None) -> Series:
        """A series of its own from (value, whether it is present)."""
        return Series.of(spark, [v if ok else None for v, ok in cells], dtype)

    def to_frame(self, name: str = VALUE):
        """A frame of this column alone, its rows in the order of the column's frame."""
        if self.prefix is not None:
            return self.frame.with_column("__scanned", self)["__scanned"].to_frame(name)
        from orrery.operators.frame import value_frame

        whole = self.frame.ordered()
        out = value_frame(whole.base, self, whole.order)
        return out if name == VALUE else out.rename(VALUE, name)

    # local access
    def len(self) -> int:
        return self.frame.len()

    def cells(self) -> Iterator:
        """The values in order, None for null, partition by partition."""
        return (r[0] for r in self.to_frame().rows())

    def values(self) -> list:
        return list(self.cells())

    def validity(self) -> list[bool]:
        return [v is not None for v in self.cells()]

    def optionals(self) -> list[tuple]:
        """(value, whether it is present)."""
        return [(v, v is not None) for v in self.cells()]

    def present(self) -> Iterator[tuple[int, object]]:
        """(row number, value) of the values that are present."""
        return ((i, v) for i, v in enumerate(self.cells()) if v is not None)

    def at(self, i: int) -> tuple[object, bool]:
        """(value, whether it is present) of a row."""
        if i < 0:
            raise InvalidRowError(str(i))
        value = self.to_frame().row(i)[0]
        return value, value is not None

    def is_valid(self, i: int) -> bool:
        return self.at(i)[1]

    def value_or(self, i: int, default: object) -> object:
        value, ok = self.at(i)
        return value if ok else default

    # selection, order, concatenation: a series of a frame of its own
    def take(self, rows: list[int]) -> Series:
        return self.to_frame().taken(list(rows))[VALUE]

    def take_nullable(self, rows: list[int | None]) -> Series:
        """Values by row number; None gives null."""
        out = self.to_frame().taken(list(rows))[VALUE]
        return Series(out.expr, out.dtype, True, out.frame)

    def head(self, n: int) -> Series:
        return self.to_frame().head(n)[VALUE]

    def tail(self, n: int) -> Series:
        return self.to_frame().tail(n)[VALUE]

    def slice(self, start: int, end: int) -> Series:
        return self.to_frame().slice(start, end)[VALUE]

    def filter(self, mask: M.Mask) -> Series:
        """The rows that a mask over the same frame selects."""
        return Series(self.expr, self.dtype, self.nullable, self.frame.filter(mask)).to_frame()[VALUE]

    def drop_null(self) -> Series:
        return self.filter(self.is_not_null())

    def _sorted(self, key: Callable[[Column], Column] | None, falling: bool) -> Series:
        from orrery.operators.frame import Frame
        from orrery.operators.sort import asc, by
        from orrery.plans.ordinal import HIDDEN

        own = self.to_frame()
        k = by(key(own[VALUE].expr)) if key else asc(own[VALUE])
        # Nulls are last either way, also where the key of a value is null.
        places = [own[VALUE].expr.isNull(), *(k.reverse() if falling else k).lower(), *own.order_columns()]
        rows = Frame(own.base.orderBy(*places).select(VALUE)).numbered().base
        return Frame(rows.withColumnRenamed("__row", f"{HIDDEN}0"), f"{HIDDEN}0")[VALUE]

    def sorted(self) -> Series:
        """Rising, stable, NaN first, nulls last."""
        return self._sorted(None, False)

    def sorted_descending(self) -> Series:
        """Falling, stable, NaN last of the values, nulls behind them."""
        return self._sorted(None, True)

    def sorted_by(self, key: Callable[[Column], Column]) -> Series:
        """Rising by an expression of the value, which takes the place of a comparison function; nulls last."""
        return self._sorted(key, False)

    def concat(self, *others: Series) -> Series:
        for o in others:
            if o.dtype != self.dtype:
                raise ColumnTypeError(f"{o.dtype.simpleString()} behind {self.dtype.simpleString()}")
        out = self.to_frame().concat(*[o.to_frame() for o in others])[VALUE]
        return Series(out.expr, out.dtype, self.nullable or any(o.nullable for o in others), out.frame)

    def equal_by(self, other: Series, same: Callable[[Column, Column], Column]) -> bool:
        """Whether both have as many rows, nulls in the same places, and ``same`` holds for all values beside each other."""
        a, b = self.to_frame("a").numbered().base, other.to_frame("b").numbered().base
        both = a.withColumn("x", F.lit(True)).join(b.withColumn("y", F.lit(True)), "__row", "full")
        odd = F.col("x").isNull() | F.col("y").isNull() | (F.col("a").isNull() != F.col("b").isNull())
        differ = F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.coalesce(same(F.col("a"), F.col("b")), F.lit(False))
        return not both.where(odd | differ).head(1)

    def equal(self, other: Series) -> bool:
        """The same by ``==``: NaN is unequal to itself."""
        if other.dtype != self.dtype:
            raise ColumnTypeError(f"{other.dtype.simpleString()} beside {self.dtype.simpleString()}")
        plain = (lambda a, b: (a == b) & ~F.isnan(a)) if N.is_float(self.dtype) else (lambda a, b: a == b)
        return self.equal_by(other, plain)

    def _operand(self, other) -> tuple[Column, T.DataType, bool]:
        if isinstance(other, Series):
            if other.dtype != self.dtype:
                raise ColumnTypeError(f"{other.dtype.simpleString()} beside {self.dtype.simpleString()}")
            return other.expr, other.dtype, other.nullable
        if other is None:
            raise ContractError("None is no value; use is_null()")
        return F.lit(other).cast(self.dtype), self.dtype, False

    # masks
    def _compare(self, op, other, unequal: bool = False) -> M.Mask:
        b, kind, _ = self._operand(other)
        # A literal that is a number needs no NaN test.
        odd = N.is_float(self.dtype), N.is_float(kind) and (isinstance(other, Series) or other != other)
        return M.compare(op, self.expr, b, odd, unequal)

    def eq(self, other) -> M.Mask:
        return self._compare(operator.eq, other)

    def ne(self, other) -> M.Mask:
        return self._compare(operator.ne, other, unequal=True)

    def lt(self, other) -> M.Mask:
        return self._compare(operator.lt, other)

    def le(self, other) -> M.Mask:
        return self._compare(operator.le, other)

    def gt(self, other) -> M.Mask:
        return self._compare(operator.gt, other)

    def ge(self, other) -> M.Mask:
        return self._compare(operator.ge, other)

    def between(self, low, high) -> M.Mask:
        return M.between(self.expr, low, high, N.is_float(self.dtype))

    def isin(self, values: list) -> M.Mask:
        return M.within(self.expr, list(values))

    def isin_using(self, canon: Callable[[Column], Column], values: list) -> M.Mask:
        """Membership under the equivalence canon(a) = canon(b)."""
        mine, wanted = canon(self.expr), [canon(F.lit(v).cast(self.dtype)) for v in values]
        return M.Mask(mine.isin(wanted), mine.isNull() | ~mine.isin(wanted)) if wanted else M.none()

    def is_null(self) -> M.Mask:
        return M.is_null(self.expr)

    def is_not_null(self) -> M.Mask:
        return ~M.is_null(self.expr)

    def is_nan(self) -> M.Mask:
        if not N.is_float(self.dtype):
            raise ColumnTypeError("only floats can be NaN")
        return M.is_nan(self.expr)

    def as_mask(self) -> M.Mask:
        if not isinstance(self.dtype, T.BooleanType):
            raise ColumnTypeError("only booleans make a mask")
        return M.truth(self.expr)

    # arithmetic
    def _binary(self, op, other, swap_null: bool = True) -> Series:
        if not isinstance(self.dtype, _CASTABLE):
            raise ColumnTypeError(f"no arithmetic on {self.dtype.simpleString()}")
        b, _, nullable = self._operand(other)
        return self._new(op(self.expr, b).cast(self.dtype), nullable=self.nullable or nullable)

    def add(self, other) -> Series:
        return self._binary(operator.add, other)

    def sub(self, other) -> Series:
        return self._binary(operator.sub, other)

    def mul(self, other) -> Series:
        return self._binary(operator.mul, other)

    def div(self, other) -> Series:
        return self._binary(lambda a, b: N.quotient(a, b, self.dtype), other)

    def neg(self) -> Series:
        return self._binary(lambda a, _: -a, 0)

    def abs(self) -> Series:
        return self._binary(lambda a, _: F.abs(a), 0)

    def _math(self, fn) -> Series:
        if not isinstance(self.dtype, FLOATS):
            raise ColumnTypeError("a float column is needed")
        return self._new(fn(self.expr.cast("double")).cast(self.dtype))

    def sqrt(self) -> Series:
        return self._math(F.sqrt)

    def exp(self) -> Series:
        return self._math(F.exp)

    def log(self) -> Series:
        return self._math(N.natural_log)

    def pow(self, exponent: float) -> Series:
        return self._math(lambda c: N.power(c, float(exponent)))

    def fill_null(self, value) -> Series:
        return self._new(F.coalesce(self.expr, F.lit(value).cast(self.dtype)), nullable=False)

    # maps
    def map(self, fn: Callable, kind: T.DataType) -> Series:
        """fn never sees a null; nulls stay."""
        return self._new(_udf(fn, kind, True)(self.expr), kind)

    def map_cells(self, fn: Callable, kind: T.DataType) -> Series:
        """fn sees None for a null."""
        return self._new(_udf(fn, kind, False)(self.expr), kind, True)

    def map_optional(self, fn: Callable, kind: T.DataType) -> Series:
        """fn never sees a null, and may return None."""
        return self._new(_udf(fn, kind, True)(self.expr), kind, True)

    def map2(self, other: Series, fn: Callable, kind: T.DataType) -> Series:
        return self._new(_udf(fn, kind, True)(self.expr, other.expr), kind, self.nullable or other.nullable)

    def map2_cells(self, other: Series, fn: Callable, kind: T.DataType) -> Series:
        return self._new(_udf(fn, kind, False)(self.expr, other.expr), kind, True)

    def _tried(self, fn: Callable, kind: T.DataType, skip_null: bool, others: tuple[Series, ...] = ()) -> Series:
        """A callback that raises ends the query; the error names the row by its order columns."""
        if not callable(fn):
            raise ContractError("a callback is needed")
        n = 1 + len(others)

        def call(*cells):
            if skip_null and any(x is None for x in cells[:n]):
                return None
            try:
                return fn(*cells[:n])
            except Exception as e:
                raise RuntimeError(f"row {', '.join(map(str, cells[n:]))}: {e}") from e

        args = [self.expr, *[o.expr for o in others], *self.frame.order_columns()]
        nullable = not skip_null or self.nullable or any(o.nullable for o in others)
        return self._new(F.udf(call, kind, useArrow=True)(*args), kind, nullable)

    def try_map(self, fn: Callable, kind: T.DataType) -> Series:
        return self._tried(fn, kind, True)

    def try_map_cells(self, fn: Callable, kind: T.DataType) -> Series:
        return self._tried(fn, kind, False)

    def try_map2(self, other: Series, fn: Callable, kind: T.DataType) -> Series:
        return self._tried(fn, kind, True, (other,))

    def try_map2_cells(self, other: Series, fn: Callable, kind: T.DataType) -> Series:
        return self._tried(fn, kind, False, (other,))

    # aggregates (for Frame.aggregate and Grouped.result)
    def sum(self, wrap: bool = False) -> Column:
        if not isinstance(self.dtype, _CASTABLE):
            raise ColumnTypeError(f"no sum of {self.dtype.simpleString()}")
        return N.total(self.expr, self.dtype, wrap)

    def mean(self) -> Column:
        return F.avg(self.expr.cast("double"))

    def _ordered(self) -> None:
        if isinstance(self.dtype, (T.BooleanType, T.StructType, T.ArrayType, T.MapType)):
            raise ColumnTypeError(f"{self.dtype.simpleString()} has no order")

    def min(self) -> Column:
        self._ordered()
        return N.least(self.expr, self.dtype)

    def max(self) -> Column:
        self._ordered()
        return N.greatest(self.expr, self.dtype)

    def count(self) -> Column:
        return F.count(self.expr)

    def null_count(self) -> Column:
        return F.count_if(self.expr.isNull())

    def variance(self) -> Column:
        """Sample variance; fewer than two values: null."""
        return F.var_samp(self.expr)

    def stddev(self) -> Column:
        return F.stddev_samp(self.expr)

    def quantile(self, q: float) -> Column:
        if not 0 <= q <= 1:
            raise ContractError("a quantile lies in [0, 1]")
        return N.quantile(self.expr, q, self.dtype)

    def median(self) -> Column:
        return self.quantile(0.5)

    def arg_min(self, row: Column) -> Column:
        self._ordered()
        return N.place_of_least(self.expr, row, self.dtype)

    def arg_max(self, row: Column) -> Column:
        self._ordered()
        return N.place_of_greatest(self.expr, row, self.dtype)

    def first_present(self) -> Column:
        return F.min_by(self.expr, F.when(self.expr.isNotNull(), F.struct(*self.frame.order_columns())))

    def last_present(self) -> Column:
        return F.max_by(self.expr, F.when(self.expr.isNotNull(), F.struct(*self.frame.order_columns())))

    def reduce(self, initial, fn: Callable[[Column, Column], Column], kind: T.DataType | None = None) -> Column:
        """Left fold of the present values in row order; fn joins two expressions; ``kind`` is the result's type (else this column's).

        The values of a group are gathered for it: what can be merged from
        parts is better an aggregate, or a scan with a merge.
        """
        kind = kind or self.dtype
        rows = F.array_sort(F.collect_list(F.when(self.expr.isNotNull(), F.struct(*self.frame.order_columns(), self.expr.alias("__v")))))
        return F.aggregate(rows, F.lit(initial).cast(kind), lambda a, x: fn(a, x["__v"]).cast(kind))

    # cumulative
    def _window(self, by: list[str]) -> Window:
        return Window.partitionBy(*by).orderBy(*self.frame.order_columns()).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def scan(self, aggregate: Callable[[Column], Column], by: list[str] = [], merge: Callable[[Column, Column], Column] | None = None) -> Series:  # noqa: B006
        """A running aggregate in row order, each group of ``by`` on its own; a null stays null and changes nothing.

        Over all rows, ``merge`` joins the aggregates of two stretches of rows:
        with it, ``Frame.with_column`` aggregates ranges of rows in parallel;
        without it, and where the expression is used by itself, one task goes
        through all rows.
        """
        running = F.when(self.expr.isNotNull(), aggregate(self.expr).over(self._window(by))).cast(self.dtype)
        return Series(running, self.dtype, True, self.frame, None if by or merge is None else (aggregate, merge, self.expr))

    def cum_sum(self, by: list[str] = []) -> Series:  # noqa: B006
        return self.scan(F.sum, by, operator.add)
