import datetime as dt

import pytest
from pyspark.sql import functions as F

from brinewell.operators import crawl, graph, ingest, log_analytics

AS_OF = dt.datetime(2024, 1, 31)


def batch(spark, rows):
    return spark.createDataFrame(rows, "line_no long, normalized_url string, content_hash string").withColumn("action2", F.lit(1))


def decided(spark, rows, stored, force=False):
    s = spark.createDataFrame(stored, "normalized_url string, content_hash string")
    return {r["line_no"]: r["action"] for r in ingest.decide(batch(spark, rows), s, force=force).collect()}


ROWS = [(1, "u", "h0"), (2, "u", "h1"), (3, "u", "h1"), (4, "v", "h2"), (5, "", "h3"), (6, None, "h3"), (7, "  ", "h3")]


def test_decide(spark):
    assert decided(spark, ROWS, [("u", "h0")]) == {1: "skip", 2: "update", 3: "skip", 4: "insert", 5: "skip_invalid", 6: "skip_invalid", 7: "skip_invalid"}
    assert decided(spark, ROWS, [("u", "h0")], force=True) == {1: "update", 2: "update", 3: "update", 4: "insert", 5: "skip_invalid", 6: "skip_invalid", 7: "skip_invalid"}
    assert decided(spark, ROWS, []) == {1: "insert", 2: "update", 3: "skip", 4: "insert", 5: "skip_invalid", 6: "skip_invalid", 7: "skip_invalid"}
    assert decided(spark, [], [("u", "h0")]) == {}


def test_heavy_keys_are_cut(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", f"h{(i * 7) % 5 // 2}") for i in range(400)] + [(500, "", "h"), (501, None, None)]
    stored = spark.createDataFrame([("hot", "h0"), ("k3", "h1")], "normalized_url string, content_hash string")
    plain = ingest.decide(batch(spark, rows), stored)
    cut = ingest.decide(batch(spark, rows).repartition(4), stored, heavy_rows=50)
    assert {(r["line_no"], r["action"]) for r in plain.collect()} == {(r["line_no"], r["action"]) for r in cut.collect()} and cut.count() == 402


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([("u", "old", "h0"), ("w", "kept", "h9")], "normalized_url string, title string, content_hash string")
    rows = spark.createDataFrame([(1, "u", None, "h1"), (2, "v", None, "h2"), (3, "u", "new", "h3")], "line_no long, normalized_url string, title string, content_hash string")
    once = ingest.upsert(stored, ingest.decide(rows, stored), ["title", "content_hash"])
    table = {r["normalized_url"]: (r["title"], r["content_hash"], r["action"]) for r in once.collect()}
    assert table == {"u": ("new", "h3", "update"), "v": ("", "h2", "insert"), "w": ("kept", "h9", "keep")}
    last = rows.where("line_no > 1")
    again = ingest.decide(last, once.select("normalized_url", "content_hash"))
    assert {r["action"] for r in again.collect()} == {"skip"}


def test_missing_key_is_not_null(spark):
    stored = spark.createDataFrame([("u", "t", "c", "h0", dt.datetime(2024, 1, 1))], "normalized_url string, title string, category string, content_hash string, crawl_time timestamp_ntz")
    rows = spark.createDataFrame([(1, "u", None, None, "h1", None, ["normalized_url", "title", "content_hash", "crawl_time"])], "line_no long, normalized_url string, title string, category string, content_hash string, crawl_time timestamp_ntz, present array<string>")
    row = ingest.upsert(stored, ingest.decide(rows, stored), ["title", "category", "content_hash", "crawl_time"], F.col("present")).first()
    assert (row["title"], row["category"], row["content_hash"], row["crawl_time"]) == (None, "c", "h1", dt.datetime(2024, 1, 1))


def test_new_ids(spark):
    new = spark.range(0, 100).select(F.concat(F.lit("u"), "id").alias("normalized_url"), (100 - F.col("id")).alias("first_line"))
    stored = spark.createDataFrame([(41,)], "id long")
    rows = ingest.assign_ids(new, stored).orderBy("first_line").collect()
    assert [r["id"] for r in rows] == list(range(42, 142))


def test_new_ids_of_many_partitions(spark):
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "65536"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        new = spark.range(200_000, numPartitions=13).select(F.pmod(F.col("id") * 7919, F.lit(200_000)).alias("first_line"), F.concat(F.lit("u"), "id").alias("normalized_url")).repartition("normalized_url")
        out = ingest.assign_ids(new, spark.createDataFrame([(100,)], "id long"))
        wrong = out.where(F.col("id") != F.col("first_line") + 101).count()
        assert wrong == 0 and out.count() == out.select("id").distinct().count() == 200_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_attachment_rows(spark):
    items = spark.createDataFrame([(1, ["https://a.x/f.pdf#p", None, "https://a.x/f.pdf"]), (2, None)], "item_id long, attachment_links array<string>")
    rows = [(r["item_id"], r["line_no"]["pos"], r["normalized_file_url"]) for r in ingest.attachment_rows(items).orderBy("line_no").collect()]
    assert rows == [(1, 0, "https://a.x/f.pdf"), (1, 2, "https://a.x/f.pdf")]
    decided = ingest.decide(ingest.attachment_rows(items).withColumn("content_hash", F.lit("h")), spark.createDataFrame([], "normalized_file_url string, content_hash string"), key="normalized_file_url")
    assert sorted(r["action"] for r in decided.collect()) == ["insert", "skip"]


def test_frontier_resolves_what_is_relative(spark):
    links = spark.createDataFrame([("https://a.x/d/p.htm", h) for h in ("n.htm", "/r", "../u.htm", "//b.x/s", "https://a.x/d/../e?", "#t", None, "mailto:x", " https://a.x/q?a=1#f ", "https://a.x/wp-content/uploads/i", "https://a.x/wp-content/t", "https://c.x/no")] + [(None, "/z")], "url string, href string")
    visited = spark.createDataFrame([("https://a.x/r",)], "url string")
    got = sorted(r["url"] for r in crawl.expand_frontier(links, visited, ["a.x", "b.x"]).collect())
    assert got == ["https://a.x/d/../e", "https://a.x/d/n.htm", "https://a.x/q?a=1", "https://a.x/u.htm", "https://a.x/wp-content/uploads/i", "https://b.x/s"]


def test_first_lines(spark):
    df = spark.range(50).select(F.col("id").alias("line_no"))
    assert sorted(r[0] for r in ingest.first_lines(df, 3).collect()) == [0, 1, 2] and ingest.first_lines(df, 0).count() == 50
    with pytest.raises(ValueError):
        ingest.first_lines(df, -1)


def test_query_log(spark, tmp_path):
    row = log_analytics.query_log_row(spark, "q", "fulltext", dt.datetime(2025, 1, 1, 8), 3, site="a", category="", field=None)
    assert log_analytics.append_query_log(str(tmp_path / "l"), row) and log_analytics.append_query_log(str(tmp_path / "l"), log_analytics.query_log_row(spark, "r", "phrase", dt.datetime(2025, 1, 1), 0, 7))
    assert {(r["query_text"], r["filters"], r["user_id"]) for r in spark.read.parquet(str(tmp_path / "l")).collect()} == {("q", '{"site": "a"}', None), ("r", None, 7)}
    (tmp_path / "file").write_text("")
    assert log_analytics.append_query_log(str(tmp_path / "file" / "l"), row, required=False) is False
    with pytest.raises(Exception):
        log_analytics.append_query_log(str(tmp_path / "file" / "l"), row)


def test_attachment_states(spark):
    found = spark.createDataFrame(
        [(1, "k1", "https://x/a.pdf", True, "t"), (2, "k2", "https://x/b.DOCX", True, " "), (3, "k3", "https://x/c.zip", True, "t"), (4, "k4", "ftp://x/d.pdf", True, "t"), (5, "k5", "https://x/e.xlsx", False, None), (6, "k6", "https://x/f.pdf", False, None), (7, None, None, None, None)],
        "n long, normalized_file_url string, file_url string, downloaded boolean, text string",
    )
    stored = spark.createDataFrame([("k1", "indexed"), ("k5", "pending")], "normalized_file_url string, parse_status string")
    steps = {r["n"]: r["step"] for r in ingest.attachment_states(found, stored).collect()}
    assert steps == {1: "skip", 2: "parse_failed", 3: "ignored", 4: "ignored", 5: "download_failed", 6: "failed_new", 7: "ignored"}
    assert {r["n"]: r["step"] for r in ingest.attachment_states(found, stored, force=True).collect()}[1] == "indexed"
    stats = ingest.attachment_stats(ingest.attachment_states(found, stored)).first()
    assert (stats["found"], stats["skipped"], stats["download_failed"], stats["indexed"]) == (4, 1, 2, 0)


def test_small_helpers(spark):
    df = spark.createDataFrame([(None, "c"), ("", None), ("t", "c")], "file_text string, content string")
    assert [r[0] for r in df.select(ingest.attachment_text(F.col("file_text"), F.col("content"))).collect()] == ["c", "", "t"]
    items = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id long, attachment_links array<string>")
    assert ingest.explode_attachments(items).count() == 4
    assert {tuple(r) for r in ingest.dry_run(batch(spark, ROWS)).collect()} == {("insert", 4), ("fail", 3)}
    key = spark.createDataFrame([(" ", "f"), ("n", "f"), (None, None)], "n string, f string").select(ingest.attachment_key(F.col("n"), F.col("f")))
    assert [r[0] for r in key.collect()] == ["f", "n", None]


def logs(spark):
    rows = [
        (1, "q", "fulltext", dt.datetime(2024, 1, 29, 23, 59)),
        (2, "q", "fulltext", dt.datetime(2024, 1, 30, 0, 0)),
        (3, "Q", "phrase", dt.datetime(2024, 1, 30, 12, 0)),
        (4, "e", "error", dt.datetime(2024, 1, 30, 12, 0)),
        (5, None, None, None),
    ]
    return spark.createDataFrame(rows, "id long, query_text string, query_type string, created_at timestamp_ntz").withColumn("result_count", F.lit(1))


def test_log_analytics(spark):
    q = logs(spark)
    assert {r["d"]: (r["cnt"], r["bar"]) for r in log_analytics.daily_trend(q, AS_OF, 1).collect()} == {"2024-01-30": (3, 100.0)}
    assert {r["query_type"]: (r["cnt"], r["pct"]) for r in log_analytics.type_distribution(q).collect()} == {"fulltext": (2, 67.0), "phrase": (1, 33.0), "wildcard": (0, 0.0), "document": (0, 0.0)}
    assert {r["pct"] for r in log_analytics.type_distribution(q.where("false")).collect()} == {0.0}
    assert [tuple(r) for r in log_analytics.hot_queries(q).collect()] == [("q", 2), ("Q", 1)]
    assert [tuple(r) for r in log_analytics.hot_queries(q, ci=True).collect()] == [("q", 3)]
    assert [tuple(r) for r in log_analytics.hot_queries(q, as_of=AS_OF, hours=24).collect()] == [("Q", 1), ("q", 1)]
    assert log_analytics.suggest(q, "  ").collect() == [] and [r[0] for r in log_analytics.suggest(q, " q").collect()] == ["q"]
    assert [r["id"] for r in log_analytics.recent_queries(q, 2).collect()] == [4, 3]
    for bad in (lambda: log_analytics.daily_trend(q, AS_OF, 0), lambda: log_analytics.hot_queries(q, 101), lambda: log_analytics.recent_queries(q, 0)):
        with pytest.raises(ValueError):
            bad()
    users = spark.createDataFrame([(1,)], "id long")
    stats = log_analytics.log_stats(q, users, AS_OF).first()
    assert (stats["total_queries"], stats["today_queries"], stats["fulltext_queries"], stats["document_queries"], stats["total_users"]) == (5, 0, 2, 0, 1)


def test_filter_usage_and_clicks(spark):
    f = spark.createDataFrame([('{"a": "x"}',), ('{"a": "x"}',), ('{"a":',), ("{}",), (None,)], "filters string")
    assert {tuple(r) for r in log_analytics.filter_usage(f).collect()} == {("a", "x", 2), (None, None, 2)}
    clicks = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, None), (4, 99)], "id long, query_log_id long")
    got = {r["query_type"]: (r["queries"], r["clicked"], r["clicks"]) for r in log_analytics.click_through(logs(spark), clicks).collect()}
    assert got["fulltext"] == (2, 1, 2) and got["error"] == (1, 0, 0)


def test_crawl(spark):
    pages = spark.createDataFrame(
        [("https://a.x/", ["/p1", "p2.css", "javascript:x", "https://b.x/q", "https://www.a.x/w/"]), ("https://a.x/p1", ["/p3/", "/p1#f", "/login"]), ("https://a.x/p3", ["/p4"])], "url string, hrefs array<string>"
    )
    start = spark.createDataFrame([("https://a.x",)], "url string")
    got = {r["url"]: r["depth"] for r in crawl.crawl(start, pages, ["a.x"], 2).collect()}
    assert got == {"https://a.x/": 0, "https://a.x/p1": 1, "https://www.a.x/w": 1, "https://a.x/p3": 2}
    sites = spark.createDataFrame([("s", ["a.x"], ["https://a.x/", "https://a.x/n"]), ("r", ["x"], [])], "site string, domains array<string>, start_urls array<string>")
    assert {tuple(r) for r in crawl.seeds(sites).collect()} == {("s", "https://a.x/"), ("s", "https://a.x/n")}
    assert [r["site"] for r in crawl.site_of_url(start, sites).collect()] == ["r"]
    kinds = spark.createDataFrame([("https://a/info/1.htm",), ("https://a/list/",), ("https://a/",), (None,)], "u string").select(crawl.classify_url(F.col("u"), ["info/\\d+"], ["list/"]))
    assert [r[0] for r in kinds.collect()] == ["detail", "list", "other", "other"]


def test_caps_and_stats(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else "t", "é" * i, ["f"] if i == 4 else None) for i in range(9)], "n long, source_site string, content string, attachment_links array<string>")
    assert sorted(r["n"] for r in crawl.page_cap(df, "source_site", "n", 2).collect()) == [0, 1, 2, 3]
    assert [r["n"] for r in crawl.page_cap(df, "source_site", "n", 2, 3).collect()] == [0, 1, 2]
    s = crawl.crawl_stats(df, 0).first()
    assert (s["pages"], s["pages_per_minute"], s["mean_bytes"], s["attachments"], s["empty_pages"]) == (9, 900.0, 8.0, 1, 1)
    assert crawl.crawl_stats(df.where("false"), 1).first()["mean_bytes"] == 0.0
    assert [tuple(r) for r in crawl.site_yield(df).collect()] == [("s", 6, 100.0), ("t", 3, 50.0)]
    plan = crawl.plan_batches(spark.createDataFrame([("a", "s", 100), ("b", "s", 50)], "name string, source_site string, max_pages int")).first()
    assert tuple(plan) == (2, 1, 150)


def test_graph(spark):
    links = spark.createDataFrame([("https://a/", "https://b/"), ("https://a/", "https://b/#x"), ("https://b/", "https://a"), ("https://a/", "https://c/"), ("https://c/", "https://c/"), (None, "https://a/")], "from_url string, to_url string")
    edges = graph.link_edges(links)
    assert {tuple(r) for r in edges.collect()} == {("https://a/", "https://b/"), ("https://b/", "https://a/"), ("https://a/", "https://c/")}
    assert {r["url"]: (r["out_degree"], r["in_degree"]) for r in graph.link_degrees(edges).collect()} == {"https://a/": (2, 1), "https://b/": (1, 1), "https://c/": (0, 1)}
    ranks = {r["url"]: r["pagerank"] for r in graph.pagerank(edges, 40).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["https://a/"] > ranks["https://b/"] == pytest.approx(ranks["https://c/"])
    assert graph.pagerank(edges.where("false"), 3).collect() == []
