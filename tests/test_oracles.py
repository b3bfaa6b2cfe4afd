"""Every query with SQL against DuckDB on the same tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return int(value) if hasattr(value, "__int__") and not isinstance(value, (bool, str, float)) else value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_query_is_registered_once():
    names = list(entry.queries())
    assert len(names) == len(set(names)) and set(entry.oracle_sql()) <= set(names)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
