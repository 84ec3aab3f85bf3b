"""Every library query against its SQL."""

import duckdb
import pytest

from orrery import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents labels".split():
        con.sql(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, db, name):
    got = Q.QUERIES[name](spark, DIR)
    want = db.sql(Q.ORACLES[name])
    at = [want.columns.index(c) for c in got.columns]
    assert len(at) == len(want.columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
