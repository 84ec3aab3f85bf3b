"""Grouping by one key; null is a group, each NaN one of its own, equal keys under a canonical form one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import ColumnConflictError, InvalidNameError
from orrery.functions.numeric import is_float
from orrery.operators.series import Series
from orrery.plans.ordinal import HIDDEN


class Grouped:
    def __init__(self, frame, key: Series, canon: Callable[[Column], Column] | None = None):
        self.frame, self.key, self.canon = frame, key, canon

    def _rows(self) -> tuple[DataFrame, list[str]]:
        rows = self.frame.placed().withColumn("__key", self.canon(self.key.expr) if self.canon else self.key.expr)
        if is_float(self.key.dtype) and not self.canon:
            # Each NaN row gets a mark of its own; all others share null.
            rows = rows.withColumn("__nan", F.when(F.isnan("__key"), F.monotonically_increasing_id()))
            return rows, ["__key", "__nan"]
        return rows, ["__key"]

    def result(self, key_name: str, **columns: Column) -> DataFrame:
        """One row a group: the key (that of the group's first row under a canonical form) and the aggregates, all in one pass."""
        if not key_name:
            raise InvalidNameError("the key's name is empty")
        if key_name in columns:
            raise ColumnConflictError(key_name)
        rows, by = self._rows()
        first = F.min_by(self.key.expr, F.struct(*self.frame.order_columns())) if self.canon else None
        aggregates = [c.alias(n) for n, c in columns.items()]
        if first is not None:
            aggregates.insert(0, first.alias("__first"))
        out = rows.groupBy(*by).agg(*(aggregates or [F.count(F.lit(1)).alias("__n")]))
        name = "__first" if first is not None else "__key"
        return out.select(F.col(name).alias(key_name), *columns)

    def in_first_seen_order(self, key_name: str, **columns: Column) -> DataFrame:
        seen = F.min(F.struct(*self.frame.order_columns()))
        return self.result(key_name, **columns, __seen=seen).orderBy("__seen").drop("__seen")

    def sizes(self) -> Column:
        return F.count(F.lit(1))

    def count(self) -> DataFrame:
        rows, by = self._rows()
        return rows.select(*by).distinct().agg(F.count(F.lit(1)).alias("n"))

    def map(self, values: Series, fn: Callable[[list], object], kind: T.DataType) -> Column:
        """fn of each group's present and missing values in row order, as a list (grouped Arrow UDF)."""

        def call(v: pd.Series, *order: pd.Series) -> object:
            rows = pd.concat(order, axis=1).reset_index(drop=True)
            rows.columns = range(rows.shape[1])
            at = rows.sort_values(list(rows.columns), kind="stable").index
            return fn([None if pd.isna(x) else x for x in v.reset_index(drop=True).loc[at]])

        return F.pandas_udf(call, kind, F.PandasUDFType.GROUPED_AGG)(values.expr, *self.frame.order_columns())

    def try_map(self, values: Series, fn: Callable[[list], object], kind: T.DataType) -> Column:
        """The same; a callback that raises ends the query, and the error names the group by the order of its first row."""

        def call(v: pd.Series, *order: pd.Series) -> object:
            rows = pd.concat(order, axis=1).reset_index(drop=True)
            rows.columns = range(rows.shape[1])
            rows = rows.sort_values(list(rows.columns), kind="stable")
            try:
                return fn([None if pd.isna(x) else x for x in v.reset_index(drop=True).loc[rows.index]])
            except Exception as e:
                raise RuntimeError(f"group of row {', '.join(map(str, rows.iloc[0]))}: {e}") from e

        return F.pandas_udf(call, kind, F.PandasUDFType.GROUPED_AGG)(values.expr, *self.frame.order_columns())

    def groups(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """fn of each group's rows, distributed."""
        rows, by = self._rows()
        return rows.groupBy(*by).applyInPandas(lambda p: fn(p.drop(columns=[c for c in p.columns if c in by or c.startswith(HIDDEN)])), schema)
