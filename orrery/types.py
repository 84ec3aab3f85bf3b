"""Python records and Spark schemas."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing

from pyspark.sql import types as T

from orrery.errors import ColumnConflictError, InvalidRecordError

SCALARS = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    datetime.datetime: T.TimestampType(),
    datetime.date: T.DateType(),
    decimal.Decimal: T.DecimalType(38, 18),
}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


def spark_type(kind) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of a Python annotation; a Spark type stands for itself."""
    if isinstance(kind, T.DataType):
        return kind, False
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1 and len(args) == 2:
            return spark_type(rest[0])[0], True
    elif origin is typing.Annotated:
        return spark_type(next((a for a in args if isinstance(a, T.DataType)), args[0]))[0], spark_type(args[0])[1]
    elif origin is list:
        inner, null = spark_type(args[0])
        return T.ArrayType(inner, null), False
    elif origin is dict:
        inner, null = spark_type(args[1])
        return T.MapType(spark_type(args[0])[0], inner, null), False
    elif dataclasses.is_dataclass(kind):
        return describe(kind)[1], False
    elif kind in SCALARS:
        return SCALARS[kind], False
    raise InvalidRecordError(f"no column type for {kind!r}")


def describe(record: type) -> tuple[list[tuple[tuple[str, ...], str]], T.StructType]:
    """([(attribute path, column name)], schema) of a record class.

    ``field(metadata={"df": name})`` renames a column, ``"-"`` leaves it out,
    and a nested record marked ``{"df": ""}`` adds its own columns in place.
    Names that start with an underscore are private and left out.
    """
    if not (isinstance(record, type) and dataclasses.is_dataclass(record)):
        raise InvalidRecordError(f"{record!r} is not a dataclass")
    hints, paths, fields = typing.get_type_hints(record, include_extras=True), [], []
    for f in dataclasses.fields(record):
        tag = f.metadata.get("df")
        if f.name.startswith("_") or tag == "-":
            continue
        if tag == "" and dataclasses.is_dataclass(hints[f.name]):
            inner, schema = describe(hints[f.name])
            paths += [((f.name, *p), n) for p, n in inner]
            fields += schema.fields
            continue
        kind, nullable = spark_type(hints[f.name])
        paths.append(((f.name,), tag or f.name))
        fields.append(T.StructField(tag or f.name, kind, nullable))
    names = [n for _, n in paths]
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise ColumnConflictError(f"two fields make the column {twice!r}")
    return paths, T.StructType(fields)


def build(record: type, values: dict):
    """A record from column values."""
    hints, out = typing.get_type_hints(record), {}
    for f in dataclasses.fields(record):
        tag = f.metadata.get("df")
        if f.name.startswith("_") or tag == "-":
            continue
        out[f.name] = build(hints[f.name], values) if tag == "" and dataclasses.is_dataclass(hints[f.name]) else values[tag or f.name]
    return record(**out)
