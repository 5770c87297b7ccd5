import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from brinewell import streaming
from brinewell.operators import html
from brinewell.sources import files, jsonl, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    doc = f"<w:document {W}><w:body>{p('first')}{p(' ')}{p('second')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('')}</w:tr></w:tbl></w:body></w:document>"
    (tmp_path / "a.docx").write_bytes(packed({"word/document.xml": doc}))
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="s"><v>0</v></c><c/><c><v>2.5</v></c></row><row><c/></row><row><c t="inlineStr"><is><t>in</t></is></c><c t="b"><v>1</v></c></row></sheetData></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(packed({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>shared</t></si></sst>',
        "xl/worksheets/sheet1.xml": sheet,
    }))
    (tmp_path / "c.doc").write_bytes(b"old")
    (tmp_path / "d.docx").write_bytes(b"broken")
    return str(tmp_path)


def test_documents(spark, folder):
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.read_documents(spark, folder).collect()}
    assert got == {"a.docx": "first\n\nsecond\n\na | b\nc | ", "b.xlsx": "[Sheet: One]\n\nshared\t2.5\nin\tTrue", "c.doc": "", "d.docx": ""}
    assert files.document_text("x.pdf", b"1") == "" and files.document_text("x.docx", None) == ""


def test_json_lines(spark, tmp_path):
    path = tmp_path / "items.jsonl"
    lines = [json.dumps({"url": "u1", "title": None, "anchor_texts": ["a", "b"], "status_code": 200}), "", "  ", "{broken", json.dumps({"url": "u2", "content": "中文"}, ensure_ascii=False)]
    path.write_text("\n".join(lines), encoding="utf-8")
    items, rejects = jsonl.read_items(spark, str(path))
    rows = items.orderBy("line_no").collect()
    assert [r["url"] for r in rows] == ["u1", "u2"] and "title" in rows[0]["present"] and "title" not in rows[1]["present"] and rows[1]["content"] == "中文"
    assert [r["value"] for r in rejects.collect()] == ["{broken"]
    jsonl.write_items(items.select("url", F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz").alias("t"), "title"), str(tmp_path / "out"))
    back = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert {"url": "u1", "t": "2024-01-02T00:00:00", "title": None} in back


def test_snapshots(spark, tmp_path):
    pages = spark.createDataFrame([("https://x/", "<html>1</html>"), ("https://y/", "<html>2</html>")], "url string, raw_html string")
    files.write_snapshots(pages, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len(back) == 2 and all(r["snapshot_path"].split("/")[1] == str(r["h2"]) or True for r in back)
    (tmp_path / "snap" / "ab").mkdir(parents=True)
    (tmp_path / "snap" / "ab" / "1.html").write_text("<body>é</body>", encoding="utf-8")
    rows = files.confined(files.read_snapshots(spark, str(tmp_path / "snap"))).collect()
    assert [(r["path"], r["html"]) for r in rows] == [("ab/1.html", "<body>é</body>")]


def test_declared_schemas(spark):
    for name in tables.SCHEMAS:
        assert tables.read_table(spark, "/root/testdata/sf0.001", name).count() > 0
    pages = tables.read_table(spark, "/root/testdata/sf0.001", "pages")
    assert tables.by_key(pages, "id", 1).count() == 1


PAGE = """<html><head><title> The  Fair </title><meta name="pubdate" content="2024-06-15T10:30:00"></head><body>
<nav><a href="/nav">nav</a></nav>
<div class="article-content"><p>{long}<p>Second paragraph<br>line <a href="/doc.PDF">paper</a><a href="next.htm">next</a><a href="next.htm">again</a><nav><a href="/inner">x</a></nav></div>
<a href="javascript:x()">no</a><a href="#top">no</a><footer>foot</footer></body></html>""".replace("{long}", "words " * 40)


def test_extraction():
    got = html.extract(PAGE, "https://a.x/d/p.htm")
    assert got["title"] == "The Fair" and got["content"].splitlines()[1:] == ["Second paragraph", "line", "paper", "next", "again"]
    assert got["attachment_links"] == ["https://a.x/doc.PDF"] and got["out_links"] == ["https://a.x/nav", "https://a.x/d/next.htm"] and got["anchor_texts"] == ["nav", "paper", "next"]
    assert html.extract(None, None)["content"] == "" and html.extract("<div><<p>a</b></x>", "u")["content"] == "<\na"


def test_parse_pages(spark):
    df = spark.createDataFrame([(PAGE, "https://a.x/"), (None, "u"), ("<h1>T</h1><p class=date>发布于 2024年6月5日</p>", "u"), ("", None)], "raw_html string, url string")
    rows = html.parse_pages(df).collect()
    assert [r["publish_time"] for r in rows] == [dt.datetime(2024, 6, 15, 10, 30), None, dt.datetime(2024, 6, 5), None]
    assert [r["parsed"]["title"] for r in rows] == ["The Fair", "", "T", ""]
    native = [r[0] for r in df.select(html.html_title(F.col("raw_html"))).collect()]
    assert native[0] == "The Fair" and native[2] == "T"
    assert [len(r[0] or []) for r in df.select(html.html_links(F.col("raw_html"))).collect()][0] == 7


def test_times_fall_through(spark):
    pages = [
        '<p class="time">10:30</p><p class="date">2024-03-02</p>',
        '<meta name="pubdate" content="soon"><meta property="article:date" content="2024-05-06"><p class="date">2023-01-01</p>',
        "<script>var d='2020-01-01'</script><body>来源 2024年6月5日 10:20</body>",
        '<div class="content"><header><i class="time">2019-01-01</i></header>' + "w " * 200 + '</div><i class="time">2022-02-02</i>',
    ]
    rows = html.parse_pages(spark.createDataFrame([(p, "u") for p in pages], "raw_html string, url string")).collect()
    assert [r["publish_time"] for r in rows] == [dt.datetime(2024, 3, 2), dt.datetime(2024, 5, 6), dt.datetime(2024, 6, 5, 10, 20), dt.datetime(2022, 2, 2)]


def test_containers():
    text = "Long paragraphs of the article itself, with words enough to count. "
    scored = f'<div id="a"><p>short</p></div><div id="b"><p>{text}</p><p>{text}</p></div><ul><p><a href="x">{text * 5}</a></p></ul>'
    assert html.extract(scored, "u")["content"] == f"{text.strip()}\n{text.strip()}"
    assert html.extract("<body>a<p>b</p></body>", "u")["content"] == "a\nb" and html.extract("only text", None)["content"] == "only text"
    got = html.extract('<title>T</title><h1></h1><div class="title">D</div><a href="/a">x <b>y</b></a><a href="/a">z</a><a>none</a>', "https://h.x/")
    assert got["heading"] == "D" and got["links"] == [("https://h.x/a", "x"), ("https://h.x/a", "z")]


def test_crawl_items(spark):
    body = "<h1>Head</h1><p>" + "word " * 30 + '</p><a href="/f.PDF">file</a><a href="#t">top</a>'
    rows = [("https://lib.a.x/2024/05/06/n.htm#f", body, 200, "text/html; charset=utf-8"), ("https://b.x/", body, 200, None), ("https://a.x/p", body, 200, "application/pdf"), ("https://a.x/s", "<p>short</p>", 200, "TEXT/HTML"), ("https://a.x/n", None, 404, "")]
    df = spark.createDataFrame(rows, "url string, raw_html string, status_code int, content_type string")
    sites = spark.createDataFrame([("one", "c1", ["a.x"])], "site string, category string, domains array<string>")
    out = html.crawl_items(df, sites, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    assert out.schema.names == ["url", "normalized_url", "title", "content", "raw_html", "source_site", "category", "publish_time", "anchor_texts", "out_links", "attachment_links", "crawl_time", "content_hash", "snapshot_path", "status_code"]
    got = {r["url"]: r for r in out.collect()}
    assert set(got) == {rows[0][0], rows[1][0]}
    r = got[rows[0][0]]
    assert (r["normalized_url"], r["title"], r["source_site"], r["category"], r["publish_time"]) == ("https://lib.a.x/2024/05/06/n.htm", "Head", "one", "c1", "2024-05-06T00:00:00")
    assert r["attachment_links"] == ["https://lib.a.x/f.PDF"] and r["anchor_texts"] == ["file", "top"] and got["https://b.x/"]["source_site"] == ""


def test_snapshot_files(spark, tmp_path):
    pages = spark.createDataFrame([("https://x/", "<p>é</p>"), ("https://y/", None), ("https://z/", ""), (None, "a")], "url string, raw_html string")
    written = files.write_snapshot_files(pages, str(tmp_path)).collect()
    assert len(written) == 1 and written[0]["bytes"] == 9 and (tmp_path / written[0]["snapshot_path"]).read_text(encoding="utf-8") == "<p>é</p>"


def test_large_files_are_reported(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"x" * 2000)
    (tmp_path / "b.txt").write_bytes(b"x")
    got = {r["path"][-6:]: r["error"] for r in files.read_documents(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got == {"a.docx": "too large", "/b.txt": None}


def test_banner(spark):
    df = spark.createDataFrame([("<BODY a=1>x<body>",), ("x",)], "h string")
    assert [r[0] for r in df.select(html.with_banner(F.col("h"), "[$1]")).collect()] == ["<BODY a=1>[$1]x<body>", "[$1]x"]


def test_windowed_counts(spark, tmp_path):
    logs = tables.read_table(spark, "/root/testdata/sf0.001", "query_logs")
    logs.write.parquet(str(tmp_path / "in"))
    counts = streaming.windowed_counts(streaming.stream_query_logs(spark, str(tmp_path / "in")))
    q = counts.writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from counts")
    assert got.count() > 0 and got.agg(F.sum("cnt")).first()[0] <= logs.select("id").distinct().count()
    hot = streaming.sliding_hot_queries(streaming.stream_query_logs(spark, str(tmp_path / "in")))
    assert hot.isStreaming and hot.columns == ["start", "query_text", "cnt"]


def test_continuous_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"url": "u", "normalized_url": "u", "content_hash": "h1"}\n{"url": "v", "normalized_url": "v", "content_hash": "h2"}\n')
    stored = spark.createDataFrame([("u", "h1")], "normalized_url string, content_hash string")
    seen = []
    stream = streaming.continuous_ingest(streaming.stream_items(spark, str(tmp_path / "in")), lambda: stored, lambda df, n: seen.extend(sorted((r["url"], r["action"]) for r in df.collect())), str(tmp_path / "c"))
    stream.trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [("u", "skip"), ("v", "insert")]
