"""The training-data queries on the smallest tables, against SQL where there is SQL."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from brinewell.llm.queries import QUERIES
from brinewell.llm.sql import SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    ours = Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert ours == Counter(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    if name.endswith("_found") and name not in ("p1_found", "p5_found"):
        assert all(n == 1 for n in ours.values())
