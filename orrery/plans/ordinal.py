"""Row numbers and running aggregates without a window over everything."""

from __future__ import annotations

from collections.abc import Callable

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"
#: How hidden order columns are called, and the one that holds the places of rows as stored.
HIDDEN = "__order_"
STORED = f"{HIDDEN}stored"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``__row`` from 0 in the given order (as stored, if none).

    Rows are range-sorted and cut; each partition's share of the numbers
    follows from the sizes of the partitions before it, one row a partition.
    """
    rows = cut(df.orderBy(*order) if order else df)
    rows = rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    rows = rows.join(F.broadcast(sizes), "__part")
    return rows.withColumn(ROW, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")


def prefixed(df: DataFrame, order: list[Column], aggregate: Callable[[Column], Column], merge: Callable[[Column, Column], Column], value: Column, kind: T.DataType) -> DataFrame:
    """``df`` with ``__prefix``: ``aggregate`` of the values up to each row in the given order, null where the value is.

    Rows are range-sorted and cut; each range is aggregated by itself, and
    ``merge`` puts before it what the ranges before it come to, one row a range.
    """
    rows = cut(df.withColumn("__value", value).orderBy(*order)).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("__part").agg(aggregate(F.col("__value")).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", aggregate(F.col("__sum")).over(before).alias("__before"))
    rows = rows.withColumn("__own", aggregate(F.col("__value")).over(inside)).join(F.broadcast(sums), "__part")
    whole = F.when(F.col("__before").isNull(), F.col("__own")).otherwise(merge(F.col("__before"), F.col("__own")))
    return rows.withColumn("__prefix", F.when(F.col("__value").isNotNull(), whole).cast(kind)).drop("__value", "__part", "__own", "__before")
