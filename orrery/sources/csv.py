"""CSV with its own type inference: boolean, then 64-bit integer, then float, then string.

Spark parses the file into strings; one aggregate decides the types, and typed
projections follow. Null tokens take no part in the decision.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery import types as R
from orrery.errors import ColumnConflictError, ColumnNotFoundError, ContractError, InvalidNameError, RowCountError, UnsupportedError
from orrery.operators.frame import Frame
from orrery.plans.ordinal import cut, numbered

INT = r"^[+-]?[0-9]+$"
FLOAT = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
WORD = r"(?i)^([+-]?(inf|infinity)|nan)$"


@dataclass
class Options:
    """infer_rows: how many rows decide the types (0: all). fields_per_record: 0 wants as many fields as
    the first record has, a positive number just so many, a negative one any number."""

    comma: str = ","
    comment: str = ""
    lazy_quotes: bool = False
    trim_leading_space: bool = False
    header: bool = True
    null_values: tuple[str, ...] = ("",)
    infer_rows: int = 0
    fields_per_record: int = 0


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/csv-{uuid.uuid4().hex}"


def _delimiter(c: str) -> None:
    if len(c) != 1 or c in '"\r\n�':
        raise ContractError(f"{c!r} can't delimit fields")


def _boolean(c: Column) -> Column:
    return F.lower(c).isin("true", "false")


def _integer(c: Column) -> Column:
    return c.rlike(INT) & c.try_cast("long").isNotNull()


def _floating(c: Column) -> Column:
    finite = c.rlike(FLOAT) & (F.abs(c.try_cast("double")) != float("inf"))
    return F.coalesce(finite, F.lit(False)) | c.rlike(WORD)


def _parsed(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.lower(c) == "true"
    if R.FLOATS and isinstance(kind, R.FLOATS):
        low = F.lower(c)
        word = F.when(low == "nan", F.lit(float("nan"))).when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        return F.when(c.rlike(WORD), word).otherwise(c.try_cast("double")).cast(kind)
    return c if isinstance(kind, T.StringType) else c.try_cast(kind)


def _raw(spark: SparkSession, path: str, o: Options) -> DataFrame:
    """All fields as strings, blank ones as ''."""
    _delimiter(o.comma)
    reader = spark.read.options(
        sep=o.comma, multiLine=True, escape='"', nullValue="\x01", emptyValue="", ignoreLeadingWhiteSpace=o.trim_leading_space, unescapedQuoteHandling="STOP_AT_DELIMITER" if o.lazy_quotes else "RAISE_ERROR"
    )
    if o.comment:
        reader = reader.option("comment", o.comment)
    first = reader.option("header", False).csv(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    cells = ["" if v is None else v for v in first[0]]
    if 0 < o.fields_per_record != len(cells):
        raise RowCountError(f"a record has {len(cells)} fields, not {o.fields_per_record}")
    names = cells if o.header else [f"column{i}" for i in range(1, len(cells) + 1)]
    if "" in names:
        raise InvalidNameError("a column has no name")
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise ColumnConflictError(twice)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("__bad", T.StringType())])
    rows = cut(reader.option("header", o.header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").schema(schema).csv(path))
    if o.fields_per_record >= 0 and (bad := rows.where(F.col("__bad").isNotNull()).head(1)):
        raise RowCountError(f"a record has another number of fields: {bad[0]['__bad']!r}")
    return rows.select(*[F.coalesce(f"c{i}", F.lit("")).alias(n) for i, n in enumerate(names)])


def _q(n: str) -> str:
    return "`" + n.replace("`", "``") + "`"


def read(spark: SparkSession, path: str, options: Options | None = None) -> Frame:
    """A frame with inferred types; a column of nothing but nulls is a string, and so is one without rows."""
    o = options or Options()
    rows = _raw(spark, path, o)
    if not rows.columns:
        return Frame(rows)
    null = list(o.null_values)
    cells = {n: F.when(~F.col(_q(n)).isin(null), F.col(_q(n))) if null else F.col(_q(n)) for n in rows.columns}
    sample = numbered(rows, []).where(F.col("__row") < o.infer_rows) if o.infer_rows else rows
    tests = []
    for i, c in enumerate(cells.values()):
        tests += [F.count(c).alias(f"n{i}"), *[F.bool_and(F.when(c.isNotNull(), t(c))).alias(f"{k}{i}") for k, t in (("b", _boolean), ("i", _integer), ("f", _floating))]]
    seen = sample.agg(*tests).head()
    out = []
    for i, (n, c) in enumerate(cells.items()):
        kind, test = T.StringType(), None
        if seen[f"n{i}"]:
            for k, t, fits in (("b", T.BooleanType(), _boolean), ("i", T.LongType(), _integer), ("f", T.DoubleType(), _floating)):
                if seen[f"{k}{i}"]:
                    kind, test = t, fits
                    break
        value = _parsed(c, kind)
        if test is not None and o.infer_rows:
            value = F.when(c.isNotNull() & ~test(c), F.raise_error(F.concat(F.lit(f"csv: column {n!r}: "), c)).cast(kind)).otherwise(value)
        out.append(value.alias(n))
    return Frame(rows.select(*out))


def read_records(spark: SparkSession, path: str, record: type, options: Options | None = None) -> list:
    """Records by declared types, without inference."""
    o = options or Options()
    rows, (_, schema) = _raw(spark, path, o), R.describe(record)
    out = []
    for f in schema.fields:
        if f.name not in rows.columns:
            raise ColumnNotFoundError(f.name)
        c = F.when(~F.col(_q(f.name)).isin(list(o.null_values)), F.col(_q(f.name))) if o.null_values and f.nullable else F.col(_q(f.name))
        fits = _boolean(c) if isinstance(f.dataType, T.BooleanType) else _floating(c) if isinstance(f.dataType, R.FLOATS) else F.lit(True) if isinstance(f.dataType, T.StringType) else c.rlike(INT) & c.try_cast(f.dataType).isNotNull()
        bad = F.raise_error(F.concat(F.lit(f"csv: column {f.name!r}: "), c)).cast(f.dataType)
        out.append(F.when(c.isNotNull() & ~fits, bad).otherwise(_parsed(c, f.dataType)).alias(f.name))
    return Frame(rows.select(*out)).records(record)


def format_float(x: float) -> str:
    """Shortest text that reads back as x: plain digits for exponents -4 to 20, else with an exponent of two digits at least."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    sign, digits, exp = _digits(x)
    point = len(digits) + exp
    if -4 <= point - 1 < 21:
        body = "0." + "0" * -point + digits if point <= 0 else digits + "0" * (point - len(digits)) if point >= len(digits) else f"{digits[:point]}.{digits[point:]}"
    else:
        e = point - 1
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'-' if e < 0 else '+'}{abs(e):02d}"
    return sign + body


def _digits(x: float) -> tuple[str, str, int]:
    import decimal

    sign, digits, exp = decimal.Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0") or "0"
    bare = text.rstrip("0") or "0"
    return "-" * sign, bare, 0 if bare == "0" else exp + len(text) - len(bare)


def _text(f: T.StructField) -> Column:
    c = F.col(_q(f.name))
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise UnsupportedError(f"{f.name!r} has no text form")
    if isinstance(f.dataType, R.FLOATS):
        return F.udf(lambda x: None if x is None else format_float(x), T.StringType(), useArrow=True)(c.cast("double"))
    return c.cast("string")


def write(frame: Frame, path: str, comma: str = ",", crlf: bool = False, header: bool = True, null: str = "") -> None:
    """A folder of part files, rows in the frame's order within each."""
    _delimiter(comma)
    if not frame.df.columns:
        raise UnsupportedError("rows without columns can't be written")
    rows = frame.df.select(*[_text(f).alias(f.name) for f in frame.schema()])
    rows.write.options(sep=comma, header=header, nullValue=null, emptyValue="", escape='"', lineSep="\r\n" if crlf else "\n").csv(path)


def write_records(spark: SparkSession, path: str, record: type, rows: list, **options) -> None:
    write(Frame.from_records(spark, record, rows), path, **options)


__all__ = ["Options", "format_float", "read", "read_records", "scratch", "write", "write_records"]
