"""Every catalogue query against its SQL in DuckDB, on the small tables."""

import datetime
import os

import duckdb
import pytest

from guide_engine.catalogue import ORACLE_SQL, QUERIES

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.isoformat() if isinstance(value, (datetime.datetime, datetime.date)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    done = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(got.columns) == sorted(names)
    want = rows_of(names, done.fetchall())
    assert rows_of(got.columns, rows) == want and (want or name == "new_channels")  # in the small tables every customer has an order
