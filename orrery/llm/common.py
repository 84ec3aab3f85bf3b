"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) is a temporary folder used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever the session's file systems have it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as no column of ``df`` is called."""
    while name in df.columns:
        name = "_" + name
    return name


def packed(df: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and ``__own``: a struct of all columns, which no operator touches."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__own"), *[df[f"`{c}`"] for c in dict.fromkeys(used)])


def unpacked(rows: DataFrame, df: DataFrame, **new) -> DataFrame:
    """The columns of ``df`` out of ``__own``, those named in ``new`` put in place."""
    return rows.select(*[(new[c] if c in new else F.col("__own")[c]).alias(c) for c in df.columns])


def spaced(text: Column) -> Column:
    """A text (null: empty) with a space for each white-space character."""
    flat = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return flat


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null: empty)."""
    return F.array_remove(F.split(spaced(text), " "), "")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0) as long."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_SPACE + "+")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    Meant for frames of ids already cut or cheap to count: the check is one job.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
