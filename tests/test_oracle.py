"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(n for n in SQL if n in QUERIES and not (n.startswith("p") and n[1:2].isdigit() and n[:3] != "p7_")))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    ours = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES)
