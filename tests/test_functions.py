import datetime as dt

import pytest
from pyspark.sql import functions as F

from brinewell.functions import dates, text, urls


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,want", [
    ("南开大学 Spark毕 The", ["南开", "开大", "大学", "毕", "spark"]),
    ("élan of the day", ["lan", "day"]),
    ("", []),
    (None, []),
    ("的 a", []),
])
def test_tokenize(spark, value, want):
    assert one(spark, value, text.tokenize) == want
    if value is not None:
        assert text.query_terms(value) == want


def test_tokens_in_order(spark):
    assert one(spark, "Spark 大学生 in 2024 学", text.tokenize_in_order) == ["spark", "大学", "学生", "2024", "学"]
    assert text.query_terms("Spark 大学生 in 2024 学", in_order=True) == ["spark", "大学", "学生", "2024", "学"]


@pytest.mark.parametrize("value,want", [
    ("https://a.x/p/q/#f", "https://a.x/p/q"),
    ("https://a.x", "https://a.x/"),
    ("https://a.x/p//?b=1", "https://a.x/p?b=1"),
    ("https://a.x/?b=1", "https://a.x/?b=1"),
    ("https://a.x/p?b=1#c?d", "https://a.x/p?b=1"),
    ("https://a.x///", "https://a.x/"),
    (None, None),
])
def test_normalize_url(spark, value, want):
    assert one(spark, value, urls.normalize_url) == want


def test_hosts(spark):
    assert one(spark, "https://www.A.x:80/p", urls.host_of) == "www.A.x:80"
    assert one(spark, "https://www.a.x/p", lambda c: urls.in_hosts(c, ["a.x"])) is True
    assert one(spark, "https://www.a.x/p", lambda c: urls.in_hosts(c, ["www.a.x"])) is False
    assert one(spark, "https://www.a.x/p", lambda c: urls.in_hosts(c, ["www.a.x"], strip_www=False)) is True
    assert one(spark, "https://b.a.x/p", lambda c: urls.in_domains(c, ["a.x"])) is True
    assert one(spark, "https://ba.x/p", lambda c: urls.in_domains(c, ["a.x"])) is False


@pytest.mark.parametrize("value,want", [("a.css", True), ("a.WOFF2", True), ("a.pdf", True), ("a.htm", False), ("a.css?x", False)])
def test_skip_extension(spark, value, want):
    assert one(spark, value, lambda c: urls.has_extension(c, urls.SKIP_EXTENSIONS)) is want


@pytest.mark.parametrize("value,want", [("https://x/search", True), ("https://x/page/12", True), ("https://x/a?nextcid=3", True), ("https://x/$[id]", True), ("https://x/researching", False), ("https://x/info/1.htm", False)])
def test_skip_path(spark, value, want):
    assert one(spark, value, urls.skipped_path) is want


@pytest.mark.parametrize("value,want", [("/a", True), ("javascript:x()", False), ("mailto:a@b", False), ("TEL:1", False), ("中文", False), (" ", False), ("#top", False), (None, False)])
def test_crawlable(spark, value, want):
    assert one(spark, value, urls.crawlable_href) is want


@pytest.mark.parametrize("value,want", [("a/b.html", True), ("../x", False), ("a\\..\\..\\x", False), ("a\x00b", False), ("/etc", False), (None, False)])
def test_safe_path(spark, value, want):
    assert bool(one(spark, value, urls.safe_path)) is want


def test_resolve_and_names(spark):
    df = spark.createDataFrame([("https://x.y/a/b.htm", "../c.htm"), ("https://x.y/", None), ("https://x.y/", "http://[bad")], "b string, h string")
    assert [r[0] for r in df.select(urls.resolve_url("b", "h")).collect()] == ["https://x.y/c.htm", None, None]
    name = one(spark, "https://x/F.PDF?x=1", urls.safe_file_name)
    assert name.endswith(".pdf") and len(name) == 16
    assert one(spark, "https://x/a.xlsx", urls.attachment_extension) == ".xlsx" and one(spark, "https://x/a", urls.attachment_extension) == ".pdf"
    path = one(spark, "https://x/", urls.snapshot_path)
    h = path.split("/")[-1].removesuffix(".html")
    assert path == f"snapshots/{h[:2]}/{h[2:4]}/{h}.html" and len(h) == 16


@pytest.mark.parametrize("value,want", [
    ("2024-06-15T10:30:00", dt.datetime(2024, 6, 15, 10, 30)),
    ("2024-06-15T10:30:00.123", dt.datetime(2024, 6, 15, 10, 30, 0, 123000)),
    ("2024-06-15 10:30:00", dt.datetime(2024, 6, 15, 10, 30)),
    ("2024-6-5", dt.datetime(2024, 6, 5)),
    ("2024-06-15T10:30:00+08:00", None),
    ("2024-13-15", None),
    ("soon", None),
    (None, None),
])
def test_parse_datetime(spark, value, want):
    assert one(spark, value, dates.parse_datetime) == want


@pytest.mark.parametrize("value,want", [
    ("on 2024-06-15  10:30:05 it", dt.datetime(2024, 6, 15, 10, 30, 5)),
    ("2024/6/5 1:02", dt.datetime(2024, 6, 5, 1, 2)),
    ("发布 2024年6月5日 10:30 来源", dt.datetime(2024, 6, 5, 10, 30)),
    ("2024年6月5日10:30", dt.datetime(2024, 6, 5, 10, 30)),
    ("2024-99-99 then 2024/01/02", dt.datetime(2024, 1, 2)),
    ("none", None),
])
def test_scan_date(spark, value, want):
    assert one(spark, value, dates.scan_date) == want


def test_other_dates(spark):
    assert one(spark, "https://x/2026/06/09/a.html", dates.url_date) == dt.date(2026, 6, 9)
    assert one(spark, "https://x/2026/13/09/a.html", dates.url_date) is None
    assert one(spark, "2024-06-15T10:30:00.123", dates.index_date) == "2024-06-15 10:30:00"
    assert one(spark, dt.datetime(2024, 1, 2, 3, 4, 5), dates.iso, "timestamp_ntz") == "2024-01-02T03:04:05"


def test_highlight_and_snippet(spark):
    assert one(spark, "<b>x</b> <em>k</em>", text.sanitize) == "x <em>k</em>"
    assert one(spark, "A kit (a.b) Kit", lambda c: text.highlight(c, ["kit", "a.b"])) == "A <em>kit</em> (<em>a.b</em>) <em>Kit</em>"
    long = "x" * 140 + " river " + "y" * 200 + " river river "
    got = one(spark, long, lambda c: text.snippet(c, ["river"]))
    assert got.count("<em>") >= 2 and " ... " in got
    assert one(spark, long, lambda c: text.snippet(c, ["none"])) == long[:100]
    assert one(spark, None, lambda c: text.snippet(c, ["none"])) == ""


def test_clean_text(spark):
    assert one(spark, " a \t b \r\n\n 　c\rd ", text.clean_text) == "a b\nc\nd"
    assert one(spark, None, text.join_anchors, "array<string>") == "" and one(spark, ["a", "b"], text.join_anchors, "array<string>") == "a b"


@pytest.mark.parametrize("values,want", [([2.0, 2.0], [0, 0]), ([1.0, 3.0, 2.0], [0, 1, 0.5]), ([5.0], [0])])
def test_min_max(spark, values, want):
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert sorted(r[0] for r in df.select(text.min_max(F.col("v"), F.min("v").over(w), F.max("v").over(w))).collect()) == sorted(want)


def test_json_list(spark):
    for value, want in (('["a", "b"]', ["a", "b"]), ("{}", []), ("[", []), (None, []), ("x", [])):
        assert one(spark, value, text.json_list) == want
    assert one(spark, ["a", "b", "a"], text.first_occurrences, "array<string>") == ["a", "b"]
