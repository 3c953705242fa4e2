"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chronoweave.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = entry.queries()[name](spark, FOLDER)
    got = [tuple(x) for x in found.collect()]
    if name not in ORACLES:
        return
    cursor = db.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, got) == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_id", "ts", "event_type", "value"]
