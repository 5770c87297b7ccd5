import random
from collections import Counter

from pyspark.sql import functions as F

from brinewell.llm import heavy_hitters as hh
from brinewell.llm import site_lines as sl


def test_frequent_values_bounds(spark):
    rnd = random.Random(3)
    values = ["hot"] * 4000 + ["warm"] * 300 + [f"v{rnd.randint(0, 10_000)}" for _ in range(20_000)] + [None] * 50 + [""] * 50
    rnd.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(5)
    truth = Counter(values)
    rows = hh.frequent_values(df, F.col("value"), 0.01, epsilon=0.002).collect()
    assert {"hot", "warm"} <= {r["value"] for r in rows} and {r["rows"] for r in rows} == {len(values)}
    for r in rows:
        assert r["low"] <= truth[r["value"]] <= r["high"] and r["high"] - r["low"] <= 0.002 * len(values) + 5
    exact = {r["value"]: r["count"] for r in hh.frequent_values_exact(df, F.col("value"), 0.01, epsilon=0.002).collect()}
    assert exact == {v: n for v, n in truth.items() if v and n >= 0.01 * len(values)}


def test_intervals_hold_on_the_query_logs(spark):
    from brinewell.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    logs = spark.read.parquet(f"{d}/query_logs.parquet").select(hh.normal_query(F.col("query_text")).alias("v"))
    truth = Counter(r["v"] for r in logs.collect())
    rows = QUERIES["p2_summary"](spark, d).collect()
    n = sum(truth.values())
    assert all(r["low"] <= truth[r["query_text"]] <= r["high"] and r["rows"] == n for r in rows)
    assert {v for v, c in truth.items() if v and c >= 5 and c >= 0.002 * n} <= {r["query_text"] for r in rows}


def test_frequent_values_ties_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5 + [("c",)] * 4, "value string")
    assert {r["value"] for r in hh.frequent_values_exact(df, F.col("value"), 0.002, 5).collect()} == {"a", "b"}
    assert hh.frequent_values_exact(df.where("false"), F.col("value"), 0.002, 5).collect() == []


def test_normal_query(spark):
    df = spark.createDataFrame([(" VPN\t　使用 说明　",), (None,), ("　",)], "q string")
    assert [r[0] for r in df.select(hh.normal_query(F.col("q"))).collect()] == ["vpn 使用 说明", None, ""]


def _site_tables(spark):
    items, pages = [], []
    for i in range(20):
        pages.append((f"u{i}", "s" if i < 15 else "t"))
        items.append((i, f"u{i}", f"　Footer {i}　\r\nline {chr(97 + i)}\n\n{'Rare' if i < 5 else 'x' + chr(97 + i)}"))
    items += [(100, "u0", "Footer 7\nagain"), (101, "unknown", "Footer 1"), (102, None, "Footer 1"), (103, "u1", None), (104, "u16", "")]
    pages += [("u50", ""), ("u51", None)]
    return spark.createDataFrame(items, "item_id long, normalized_url string, content string").withColumn("site", F.lit("clash")), spark.createDataFrame(pages, "normalized_url string, source_site string").withColumn("content", F.lit("clash"))


def test_site_lines(spark):
    items, pages = _site_tables(spark)
    got = {(r["source_site"], r["line"]): (r["docs"], r["site_docs"]) for r in sl.frequent_site_lines(items, pages, 5, 0.3).collect()}
    assert got == {("s", "Footer #"): (15, 15), ("s", "Rare"): (5, 15), ("t", "Footer #"): (5, 5)}


def test_without_site_lines(spark):
    items, pages = _site_tables(spark)
    got = {r["item_id"]: (r["content"], r["removed"]) for r in sl.without_site_lines(items, pages, 5, 0.3).collect()}
    twice = items.unionByName(items.where("item_id = 0")).unionByName(items.where("item_id = 1").withColumn("item_id", F.lit(None).cast("long")))
    again = [(r["item_id"], r["content"], r["removed"]) for r in sl.without_site_lines(twice, pages, 5, 0.3).collect()]
    assert again.count((0, "line a\n", 2)) == 2 and (None, "line b\n", 2) in again and len(again) == 27
    assert got[0] == ("line a\n", 2) and got[101] == ("Footer 1", 0) and got[103] == (None, 0) and got[104] == ("", 0) and len(got) == 25


def test_site_lines_of_empty_tables(spark):
    items, pages = _site_tables(spark)
    assert sl.frequent_site_lines(items.where("false"), pages).collect() == []
    assert sl.frequent_site_lines(items, pages.where("false")).collect() == []
