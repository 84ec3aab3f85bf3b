"""Databases with a Python DB-API driver, as a Spark data source.

``connect`` is a picklable function without arguments that opens a connection;
it is called on the driver for the schema and on an executor for the rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from orrery import types as R
from orrery.errors import ColumnConflictError, ColumnTypeError, InvalidNameError, SchemaMismatchError, UnsupportedError
from orrery.operators.frame import Frame

KINDS = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType()), (datetime.datetime, T.TimestampType()))


def _kind(value) -> T.DataType:
    for kind, found in KINDS:
        if isinstance(value, kind):
            return found
    raise UnsupportedError(f"no column type for {type(value).__name__}")


def probe(connect: Callable, query: str, args: tuple = (), declared: dict[str, T.DataType] | None = None) -> T.StructType:
    """Each column's type is that of its first value that isn't null; without one, what is declared, else string."""
    db = connect()
    try:
        cursor = db.cursor()
        cursor.execute(query, args)
        names = [d[0] for d in cursor.description]
        if "" in names:
            raise InvalidNameError("a column has no name")
        if len(set(names)) < len(names):
            raise ColumnConflictError("two columns share a name")
        kinds: list[T.DataType | None] = [None] * len(names)
        for row in cursor:
            kinds = [k if k or v is None else _kind(v) for k, v in zip(kinds, row, strict=True)]
            if all(kinds):
                break
        return T.StructType([T.StructField(n, k or (declared or {}).get(n, T.StringType()), True) for n, k in zip(names, kinds, strict=True)])
    finally:
        db.close()


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, connect: Callable, query: str, args: tuple):
        self.schema, self.connect, self.query, self.args = schema, connect, query, args

    def read(self, partition) -> Iterator[tuple]:
        db = self.connect()
        try:
            cursor = db.cursor()
            cursor.execute(self.query, self.args)
            for i, row in enumerate(cursor):
                for f, v in zip(self.schema.fields, row, strict=True):
                    if v is not None and _kind(v) != f.dataType:
                        raise ColumnTypeError(f"row {i}: {f.name!r} turns from {f.dataType.simpleString()} to {_kind(v).simpleString()}")
                yield tuple(row)
        finally:
            db.close()


class DbApiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_dbapi"

    def _given(self):
        return cloudpickle.loads(bytes.fromhex(self.options["call"]))

    def schema(self) -> T.StructType:
        return probe(*self._given())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, *self._given()[:3])


def query(spark: SparkSession, connect: Callable, sql: str, args: tuple = (), declared: dict[str, T.DataType] | None = None) -> Frame:
    """The rows of a query in another database."""
    spark.dataSource.register(DbApiSource)
    call = cloudpickle.dumps((connect, sql, tuple(args), declared)).hex()
    return Frame(spark.read.format("orrery_dbapi").option("call", call).load())


def query_records(spark: SparkSession, connect: Callable, sql: str, record: type, args: tuple = ()) -> list:
    _, schema = R.describe(record)
    return query(spark, connect, sql, args, {f.name: f.dataType for f in schema.fields}).records(record)


def write(frame: Frame, connect: Callable, statement: str) -> int:
    """Run a statement once a row, in order, in one connection; the first failure stops it and names its row.

    Rows before it stay as far as the connection commits by itself.
    """
    if not frame.df.columns:
        raise SchemaMismatchError("rows without columns can't be bound")
    db, n = connect(), 0
    try:
        cursor = db.cursor()
        for row in frame.rows():
            try:
                cursor.execute(statement, tuple(row))
            except Exception as e:
                raise RuntimeError(f"row {n}: {e}") from e
            n += 1
        db.commit()
    finally:
        db.close()
    return n


def write_distributed(frame: Frame, connect: Callable, statement: str, batch: int = 1000) -> None:
    """The same without order: every partition in its own connection and transaction."""

    def send(rows: Iterator) -> None:
        db = connect()
        try:
            cursor, held = db.cursor(), []
            for row in rows:
                held.append(tuple(row))
                if len(held) == batch:
                    cursor.executemany(statement, held)
                    held = []
            if held:
                cursor.executemany(statement, held)
            db.commit()
        finally:
            db.close()

    frame.df.foreachPartition(send)


def write_records(spark: SparkSession, connect: Callable, statement: str, record: type, rows: list) -> int:
    return write(Frame.from_records(spark, record, rows), connect, statement)
