import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brinewell.operators.orphans import Bitmap, Reference, orphans, site_orphans

T = dt.datetime


@given(st.sets(st.integers(0, 20_000)), st.sets(st.integers(0, 20_000)))
@settings(max_examples=60, deadline=None)
def test_bitmaps(a, b):
    x, y = Bitmap(np.array(sorted(a), np.int64)), Bitmap(np.array(sorted(b), np.int64))
    assert set(x.and_not(y).decode()) == a - b and set(x.both(y).decode()) == a & b
    x.add(y)
    assert set(x.decode()) == a | b


def tables(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.x/p", "a.x", T(2024, 1, 10)), (2, "https://a.x/", "a.x", T(2024, 3, 1)), (3, "https://b.x/q", "B.x", T(2024, 1, 1)), (4, None, None, None)],
        "id long, normalized_url string, source_site string, created_at timestamp_ntz",
    ).withColumn("period", F.lit("clash"))
    links = spark.createDataFrame(
        [
            (1, "https://a.x/p/#t", T(2024, 1, 20)),  # there
            (1, "https://a.x/p/#t", T(2024, 1, 20)),
            (2, "https://a.x", T(2024, 1, 20)),  # comes in a later month
            (3, "https://a.x/p", T(2024, 1, 5)),  # comes later in this month
            (4, "https://a.x/none", T(2024, 2, 1)),
            (4, "https://a.x/none", T(2024, 2, 1)),
            (5, "https://other.x/none", T(2024, 2, 1)),  # host not registered
            (6, None, T(2024, 2, 1)),
            (7, "https://b.x/none", None),
            (8, "https://b.x/q", None),
            (None, "https://a.x/none", T(2024, 2, 1)),
        ],
        "id long, to_url string, created_at timestamp_ntz",
    )
    logs = spark.createDataFrame([(10, T(2024, 1, 1)), (10, T(2024, 1, 1)), (11, T(2024, 5, 1))], "id long, created_at timestamp_ntz")
    clicks = spark.createDataFrame([(1, 10, T(2024, 2, 1)), (2, 11, T(2024, 2, 1)), (3, 12, T(2024, 2, 1)), (4, None, T(2024, 2, 1))], "id long, query_log_id long, created_at timestamp_ntz")
    att = spark.createDataFrame([(1, 1, T(2024, 2, 1)), (2, 99, T(2024, 2, 1)), (3, 2, T(2024, 2, 1))], "id long, parent_page_id long, created_at timestamp_ntz")
    return pages, links, logs, clicks, att


WANT = {
    ("page_links", 2, "2024-01", "late"),
    ("page_links", 3, "2024-01", "late"),
    ("page_links", 4, "2024-02", "missing"),
    ("page_links", 7, None, "missing"),
    ("click_logs", 2, "2024-02", "late"),
    ("click_logs", 3, "2024-02", "missing"),
    ("attachments", 2, "2024-02", "missing"),
    ("attachments", 3, "2024-02", "late"),
}


def test_orphans(spark):
    rows = [tuple(r) for r in site_orphans(*tables(spark)).collect()]
    assert set(rows) == WANT and len(rows) == len(WANT)


def test_one_range_and_empty_tables(spark):
    pages, links, logs, clicks, att = tables(spark)
    ref = Reference("click_logs", clicks, F.col("id"), F.col("query_log_id"), F.col("created_at"), logs, F.col("id"), F.col("created_at"))
    assert {tuple(r) for r in orphans([ref], ranges=1).collect()} == {w for w in WANT if w[0] == "click_logs"}
    none = [t.where("false") for t in (pages, links, logs, clicks, att)]
    assert site_orphans(*none).collect() == []
    assert {r["kind"] for r in site_orphans(pages.where("false"), links, logs.where("false"), clicks, att).collect()} == {"missing"}


def test_hot_key(spark):
    logs = spark.range(10).select("id", F.lit(T(2024, 6, 1)).cast("timestamp_ntz").alias("created_at"))
    clicks = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 999).otherwise(F.col("id") % 10).alias("k"), F.lit(T(2024, 7, 1)).cast("timestamp_ntz").alias("created_at"))
    ref = Reference("c", clicks, F.col("id"), F.col("k"), F.col("created_at"), logs, F.col("id"), F.col("created_at"))
    assert orphans([ref]).count() == 1667
