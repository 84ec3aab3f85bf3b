"""An ordered table: a DataFrame plan and the columns that order its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery import types as R
from orrery.errors import (
    ColumnConflictError,
    ColumnNotFoundError,
    ColumnTypeError,
    ContractError,
    InvalidNameError,
    InvalidRecordError,
    InvalidRowError,
    RowCountError,
    SchemaMismatchError,
    UnsupportedError,
)
from orrery.functions.numeric import is_float
from orrery.operators import join as J
from orrery.operators.group import Grouped
from orrery.operators.series import VALUE, Series
from orrery.operators.sort import SortKey
from orrery.plans.mask import Mask
from orrery.plans.ordinal import HIDDEN, ROW, STORED, numbered, prefixed
from orrery.streaming import require_static


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Frame:
    """``order`` names columns that together are unique.

    An order column that is projected away or replaced stays as a hidden one.
    Without an order, rows come as they are stored: what needs an order takes
    the place of each row in the partitions of the plan so far.
    """

    def __init__(self, df: DataFrame, order: list[str] | str = ()):
        names = [n for n in df.columns if not n.startswith(HIDDEN)]
        if "" in names:
            raise InvalidNameError("a column's name is empty")
        if twice := next((n for n in names if names.count(n) > 1), None):
            raise ColumnConflictError(f"two columns are called {twice!r}")
        self.base, self.order = df, [order] if isinstance(order, str) else list(order)
        hidden = [n for n in df.columns if n.startswith(HIDDEN)]
        #: What users see: without the hidden columns.
        self.df = df.drop(*hidden) if hidden else df

    # construction
    @classmethod
    def new(cls, spark: SparkSession, **columns: list) -> Frame:
        """From lists of equal length, in their order; None makes a column nullable."""
        if not columns:
            return cls(spark.createDataFrame([], T.StructType([])))
        if len({len(v) for v in columns.values()}) > 1:
            raise RowCountError("columns differ in length")
        if "" in columns:
            raise InvalidNameError("a column's name is empty")
        fields = [T.StructField(n, _kind(v), any(x is None for x in v)) for n, v in columns.items()]
        return cls._local(spark, list(zip(*columns.values(), strict=True)), T.StructType(fields))

    @classmethod
    def from_series(cls, spark: SparkSession, **columns: Series) -> Frame:
        """From series of equal length, joined by position."""
        out, n = None, None
        for name, series in columns.items():
            one = series.to_frame(name).numbered()
            if n is not None and one.base.count() != n:
                raise RowCountError("columns differ in length")
            n = one.base.count() if n is None else n
            out = one.base if out is None else out.join(one.base, ROW)
        if out is None:
            return cls.new(spark)
        return cls(out.withColumnRenamed(ROW, f"{HIDDEN}0"), f"{HIDDEN}0").select(*columns)

    @classmethod
    def from_records(cls, spark: SparkSession, record: type, rows: list) -> Frame:
        paths, schema = R.describe(record)

        def get(row, path):
            for name in path:
                row = getattr(row, name)
            return row

        return cls._local(spark, [tuple(get(r, p) for p, _ in paths) for r in rows], schema)

    @classmethod
    def _local(cls, spark: SparkSession, rows: list[tuple], schema: T.StructType) -> Frame:
        place = T.StructField(f"{HIDDEN}0", T.LongType(), False)
        return cls(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([*schema.fields, place])).coalesce(1), place.name)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, order: list[str] | str = ()) -> Frame:
        return cls(spark.read.parquet(path), order)

    # schema
    def names(self) -> list[str]:
        return self.df.columns

    def width(self) -> int:
        return len(self.df.columns)

    def len(self) -> int:
        return self.base.count()

    def schema(self) -> list[T.StructField]:
        return self.df.schema.fields

    def has(self, name: str) -> bool:
        return name in self.df.columns

    def __repr__(self) -> str:
        return "Frame{" + ", ".join(f"{f.name}:{f.dataType.simpleString()}{'?' * f.nullable}" for f in self.schema()) + "}"

    def column(self, name: str, dtype: T.DataType | None = None) -> Series:
        if name not in self.df.columns:
            raise ColumnNotFoundError(name)
        field = self.df.schema[name]
        if dtype is not None and field.dataType != dtype:
            raise ColumnTypeError(f"{name!r} is {field.dataType.simpleString()}, not {dtype.simpleString()}")
        return Series(F.col(_q(name)), field.dataType, field.nullable, self)

    __getitem__ = column

    def columns(self) -> Iterator[tuple[str, Series]]:
        """(name, column) in schema order."""
        return ((n, self.column(n)) for n in self.names())

    def series(self, expr: Column) -> Series:
        """A computed column of this frame."""
        field = self.placed().select(expr.alias("x")).schema[0]
        return Series(expr, field.dataType, field.nullable, self)

    def _need(self, *names: str) -> None:
        for n in names:
            if n not in self.df.columns:
                raise ColumnNotFoundError(n)

    # order
    def order_names(self) -> list[str]:
        return self.order or [STORED]

    def order_columns(self) -> list[Column]:
        return [F.col(_q(n)) for n in self.order_names()]

    def placed(self) -> DataFrame:
        """The rows with their order columns; where the frame has none, with the places of rows as stored (pruned if unused)."""
        if self.order or self.base.isStreaming or STORED in self.base.columns:
            return self.base
        return self.base.withColumn(STORED, F.monotonically_increasing_id())

    def ordered(self) -> Frame:
        """This frame, its rows' places as hidden order if it has none."""
        return self if self.order else Frame(self.placed(), STORED)

    def sorted_rows(self) -> DataFrame:
        return self.base.orderBy(*self.order_columns()) if self.order else self.base

    def _project(self, columns: list[tuple[str, Column, str | None]], rows: DataFrame | None = None) -> Frame:
        """(name, expression, name of the column that it is or None); order columns that are not among them go along hidden."""
        out, order, free = [c.alias(n) for n, c, _ in columns], [], 0
        for name in self.order:
            kept = next((n for n, _, of in columns if of == name), None)
            if kept is None:
                while f"{HIDDEN}{free}" in self.order:
                    free += 1
                kept = name if name.startswith(HIDDEN) else f"{HIDDEN}{free}"
                free += kept != name
                out.append(F.col(_q(name)).alias(kept))
            order.append(kept)
        return Frame((self.base if rows is None else rows).select(*out), order)

    # projection
    def select(self, *names: str) -> Frame:
        self._need(*names)
        if len(set(names)) < len(names):
            raise ColumnConflictError("a column is selected twice")
        return self._project([(n, F.col(_q(n)), n) for n in names])

    def drop(self, *names: str) -> Frame:
        self._need(*names)
        return self._project([(n, F.col(_q(n)), n) for n in self.names() if n not in names])

    def rename(self, old: str, new: str) -> Frame:
        self._need(old)
        if not new:
            raise InvalidNameError("the new name is empty")
        if new != old and new in self.df.columns:
            raise ColumnConflictError(new)
        return self._project([(new if n == old else n, F.col(_q(n)), n) for n in self.names()])

    def with_column(self, name: str, series: Series) -> Frame:
        """Append a column, or put it in place of the one of that name."""
        if not name:
            raise InvalidNameError("the name is empty")
        if series.prefix is not None:
            return self._with_prefix(name, series)
        columns = [(n, F.col(_q(n)), n) for n in self.names() if n != name]
        at = self.names().index(name) if name in self.names() else len(columns)
        columns.insert(at, (name, series.expr, None))
        return self._project(columns, self.placed())

    def _with_prefix(self, name: str, series: Series) -> Frame:
        """A running aggregate over all rows, by ranges of them and their sums."""
        require_static(self)
        whole = self.ordered()
        rows = prefixed(whole.base, whole.order_columns(), *series.prefix, series.dtype)
        return Frame(rows, whole.order).with_column(name, Series(F.col("__prefix"), series.dtype, True)).drop("__prefix")

    def with_values(self, name: str, values: list) -> Frame:
        """Local values by position."""
        rows = self.numbered()
        if rows.base.count() != len(values) and self.width():
            raise RowCountError(f"{len(values)} values")
        local = self.base.sparkSession.createDataFrame(list(enumerate(values)), T.StructType([T.StructField(ROW, T.LongType(), False), T.StructField("__v", _kind(values))]))
        out = rows.base.join(local, ROW)
        return Frame(out, [ROW]).with_column(name, Series(F.col("__v"), _kind(values))).drop("__v")

    # rows
    def numbered(self) -> Frame:
        """With the row number ``__row``, which orders the rows from then on."""
        require_static(self)
        return self if ROW in self.df.columns else Frame(numbered(self.base, self.order_columns() if self.order else []).drop(*[n for n in self.order if n.startswith(HIDDEN)]), [ROW])

    def filter(self, mask: Mask) -> Frame:
        return Frame(self.base.where(mask.yes), self.order)

    def filter_func(self, series: Series, fn: Callable) -> Frame:
        """Rows whose value is present and for which fn is true."""
        keep = series.map(fn, T.BooleanType())
        return Frame(self.base.where(series.expr.isNotNull()).where(keep.expr), self.order)

    def filter_rows(self, chosen: list[bool]) -> Frame:
        """The rows whose place in a local list is true."""
        marked = self.with_values("__chosen", list(chosen))
        return marked.filter(marked["__chosen"].as_mask()).drop("__chosen")

    def mask_rows(self, mask: Mask) -> DataFrame:
        """The numbers of the rows that a mask selects, in order."""
        return self.numbered().base.where(mask.yes).select(F.col(ROW).alias("row")).orderBy("row")

    def mask_at(self, mask: Mask, i: int) -> bool:
        found = self.numbered().base.where(F.col(ROW) == i).select(mask.column().alias("at")).head(1)
        if not found:
            raise InvalidRowError(str(i))
        return found[0]["at"]

    def head(self, n: int) -> Frame:
        if n < 0:
            raise ContractError("a count below 0")
        return Frame(self.sorted_rows().limit(n), self.order)

    def tail(self, n: int) -> Frame:
        if n < 0:
            raise ContractError("a count below 0")
        rows = self.ordered()
        last = rows.base.orderBy(*[c.desc() for c in rows.order_columns()]).limit(n)
        return Frame(last.orderBy(*rows.order_columns()), rows.order)

    def slice(self, start: int, end: int) -> Frame:
        if not 0 <= start <= end:
            raise ContractError(f"no slice [{start}, {end})")
        return Frame(self.sorted_rows().offset(start).limit(end - start), self.order)

    def taken(self, rows: list[int | None]) -> Frame:
        """Rows by number, repeats allowed, in the order asked for; None gives a row of nulls."""
        whole = self.numbered()
        n = whole.base.count()
        if any(r is not None and not 0 <= r < n for r in rows):
            raise ContractError("a row number is out of range")
        place = f"{HIDDEN}0"
        wanted = self.base.sparkSession.createDataFrame(list(enumerate(rows)), f"{place} long, {ROW} long")
        return Frame(wanted.join(whole.base, ROW, "left" if None in rows else "inner").drop(ROW), place)

    def take(self, rows: list[int]) -> DataFrame:
        """Rows by number, repeats allowed, in the order asked for."""
        found = self.taken(rows)
        return found.base.orderBy(*found.order_columns()).drop(*found.order)

    def row(self, i: int) -> Row:
        found = self.numbered().base.where(F.col(ROW) == i).drop(ROW).head(1)
        if not found:
            raise InvalidRowError(str(i))
        return found[0]

    def get(self, i: int, name: str, dtype: T.DataType | None = None) -> object:
        """The value of a cell; its column must have the type."""
        self.column(name, dtype)
        return self.row(i)[name]

    def rows(self) -> Iterator[Row]:
        return self.sorted_rows().select(*map(_q, self.names())).toLocalIterator()

    def records(self, record: type) -> list:
        """All rows as records; extra columns are ignored, types must be equal."""
        paths, schema = R.describe(record)
        for f in schema.fields:
            self.column(f.name, f.dataType)
        plain, out = [f.name for f in schema.fields if not f.nullable], []
        for i, r in enumerate(self.sorted_rows().select(*[_q(n) for _, n in paths]).collect()):
            values = r.asDict()
            if missing := next((n for n in plain if values[n] is None), None):
                raise InvalidRecordError(f"row {i}: {missing!r} is null")
            out.append(R.build(record, values))
        return out

    # sort, distinct, concatenation
    def sorted_by(self, *keys: SortKey) -> DataFrame:
        """Stable by the frame's own order."""
        if not keys:
            raise ContractError("no sort key")
        require_static(self)
        rows = self.ordered()
        return rows.base.orderBy(*[c for k in keys for c in k.lower()], *rows.order_columns()).select(*map(_q, self.names()))

    def top(self, n: int, *keys: SortKey) -> DataFrame:
        return self.sorted_by(*keys).limit(n)

    def distinct(self) -> Frame:
        """Rows without repeats, in the order of their first ones if the frame has an order; null equals null, NaN nothing."""
        for f in self.df.schema.fields:
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.BinaryType)):
                raise UnsupportedError(f"{f.name!r} can't be compared")
        names, rows = self.names(), self.base
        floats = [F.isnan(_q(f.name)) for f in self.df.schema.fields if is_float(f.dataType)]
        by = list(map(_q, names))
        if floats:
            odd = floats[0]
            for x in floats[1:]:
                odd = odd | x
            rows = rows.withColumn("__nan", F.when(odd, F.monotonically_increasing_id()))
            by.append("__nan")
        if not any(n.startswith(HIDDEN) for n in self.order):
            return Frame(rows.select(*by).distinct().select(*by[: len(names)]), [n for n in self.order if n in names])
        first = F.min(F.struct(*[F.col(_q(n)).alias(f"o{i}") for i, n in enumerate(self.order)])).alias("__first")
        places = [F.col("__first")[f"o{i}"].alias(f"{HIDDEN}{i}") for i in range(len(self.order))]
        return Frame(rows.groupBy(*by).agg(first).select(*by[: len(names)], *places), [f"{HIDDEN}{i}" for i in range(len(places))])

    def distinct_by(self, key: Series, canon: Callable[[Column], Column] | None = None) -> Frame:
        """The first row of each key, by a partial aggregate."""
        rows = self.placed().withColumn("__k", canon(key.expr) if canon else key.expr)
        by = ["__k"]
        if is_float(key.dtype) and not canon:
            rows = rows.withColumn("__nan", F.when(F.isnan("__k"), F.monotonically_increasing_id()))
            by.append("__nan")
        whole = list(dict.fromkeys([*self.names(), *self.order_names()]))
        first = F.min_by(F.struct(*[F.col(_q(n)) for n in whole]), F.struct(*self.order_columns()))
        return Frame(rows.groupBy(*by).agg(first.alias("__f")).select("__f.*"), self.order_names())

    def distinct_by_using(self, key: Series, canon: Callable[[Column], Column]) -> Frame:
        return self.distinct_by(key, canon)

    def concat(self, *others: Frame) -> Frame:
        """Rows of all, this frame's first; names, their order and types must be equal."""
        if not others:
            return self
        for o in others:
            if o.names() != self.names():
                raise SchemaMismatchError(f"{o.names()} beside {self.names()}")
            for a, b in zip(self.df.schema, o.df.schema, strict=True):
                if a.dataType != b.dataType:
                    raise SchemaMismatchError(f"{a.name!r} is {a.dataType.simpleString()} and {b.dataType.simpleString()}")
        if any(f.base.isStreaming for f in (self, *others)):
            out = self.df
            for o in others:
                out = out.union(o.df)
            return Frame(out)
        parts, kinds = [f.ordered() for f in (self, *others)], []
        for f in parts:
            kinds.append([f.base.schema[n].dataType for n in f.order])
        if any(k != kinds[0] for k in kinds):
            parts = [Frame(p.numbered().base, ROW) for p in parts]
        out = None
        for i, p in enumerate(parts):
            places = [F.lit(i).alias(f"{HIDDEN}0"), *[F.col(_q(n)).alias(f"{HIDDEN}{j + 1}") for j, n in enumerate(p.order)]]
            some = p.base.select(*map(_q, self.names()), *places)
            out = some if out is None else out.union(some)
        return Frame(out, [n for n in out.columns if n.startswith(HIDDEN)])

    # joins
    def join(self, right: Frame, key: J.JoinKey, kind: str = "inner") -> Frame:
        return J.join(self, right, key, kind)

    def inner_join(self, right: Frame, key: J.JoinKey) -> Frame:
        return J.join(self, right, key, "inner")

    def left_join(self, right: Frame, key: J.JoinKey) -> Frame:
        return J.join(self, right, key, "left")

    def right_join(self, right: Frame, key: J.JoinKey) -> Frame:
        return J.join(self, right, key, "right")

    def full_join(self, right: Frame, key: J.JoinKey) -> Frame:
        return J.join(self, right, key, "full")

    def semi_join(self, right: Frame, key: J.JoinKey) -> Frame:
        return J.join(self, right, key, "semi")

    def anti_join(self, right: Frame, key: J.JoinKey) -> Frame:
        return J.join(self, right, key, "anti")

    def cross_join(self, right: Frame) -> Frame:
        return J.cross(self, right)

    # aggregation
    def group_by(self, key: Series) -> Grouped:
        return Grouped(self, key)

    def group_by_using(self, key: Series, canon: Callable[[Column], Column]) -> Grouped:
        return Grouped(self, key, canon)

    def aggregate(self, **columns: Column) -> DataFrame:
        """Whole-column aggregates in one pass."""
        return self.placed().agg(*[c.alias(n) for n, c in columns.items()])

    def quantiles(self, **wanted: tuple[Series, float]) -> DataFrame:
        """One row of exact quantiles (type 7), each of (series, q): values are range-sorted and numbered, and the two beside the place taken.

        Unlike the aggregate ``Series.quantile``, no task holds all values.
        """
        require_static(self)
        by: dict[str, list[tuple[str, Series, float]]] = {}
        for name, (series, q) in wanted.items():
            series.quantile(q)
            by.setdefault(str(series.expr), []).append((name, series, q))
        parts = None
        for asked in by.values():
            series = asked[0][1]
            rows = numbered(self.base.select(series.expr.cast("double").alias("v")).where("v IS NOT NULL"), [F.col("v")])
            last = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.isnan("v")), F.lit(False)).alias("odd")).head()
            for name, _, q in asked:
                h = q * max(0, last["n"] - 1)
                low, rest = int(h), h - int(h)
                at = lambda i, row=F.col(ROW): F.max(F.when(row == i, F.col("v")))
                value = F.lit(float("nan")) if last["odd"] else at(low) + rest * (at(low + 1) - at(low)) if rest else at(low)
                one = rows.where(F.col(ROW).between(low, low + 1)).agg(value.alias("v")).select(F.lit(name).alias("name"), "v")
                parts = one if parts is None else parts.union(one)
        if parts is None:
            raise ContractError("no quantile is asked for")
        return parts.agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in wanted])


def value_frame(rows: DataFrame, series: Series, order: list[str]) -> Frame:
    """One column ``value``, the rows' order hidden beside it."""
    places = [F.col(_q(n)).alias(f"{HIDDEN}{i}") for i, n in enumerate(order)]
    return Frame(rows.select(series.expr.alias(VALUE), *places), [f"{HIDDEN}{i}" for i in range(len(order))])


def _kind(values: list) -> T.DataType:
    present = next((v for v in values if v is not None), None)
    if isinstance(present, list):
        return T.ArrayType(_kind(present))
    return R.SCALARS.get(type(present), T.StringType())

