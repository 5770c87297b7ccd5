from pyspark.sql import functions as F

from brinewell.llm import boilerplate as b

PARAGRAPHS = ["The river survey of the northern valley went on until the frost came.", "Nobody had counted the mills before, and the parish books were lost.", "A second party walked the southern bank with two surveyors and a clerk."]


def page(i, box, article):
    body = "".join(f"<p>{x}</p>" for x in article)
    return f"""<!DOCTYPE html><html><head><title>Story {i}</title><script>if (a < b) document.write("</p>")</script></head><body>
<nav class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li></nav>
<div class="{box}"><h1>Story {i}</h1>{body}</div>
<div class="info"><span>Page views: {i * 7}</span></div><aside class="side"><a>Most read</a><a>Story {i + 1}</a></aside>
<footer>© Valley Portal<br>12 Mill Lane &amp; Weir</footer></body></html>"""


def rows():
    out = []
    for i in range(40):
        article = [f"{p} ({chr(97 + i % 26)}{i})" for p in PARAGRAPHS]
        content = ["Home", "News", "", f"Story {i}", *article, f"Page views: {i * 7}", "Most read", f"Story {i + 1}", "© Valley Portal", "12 Mill Lane & Weir"]
        html = page(i, "main-box" if i % 2 else "text", article)
        out.append((i, f"https://h{i % 2}.example/{i}", f"Story {i}", "\n".join(content), html))
    for i, cut in ((30, None), (31, ""), (32, 420), (33, 700)):
        r = out[i]
        out[i] = (*r[:4], r[4][:cut] if isinstance(cut, int) else cut)
    out += [(100, "https://h0.example/x", None, None, None), (101, "https://h0.example/y", "t", "", page(1, "text", [])), (102, None, None, "A lone text without any page.", None), out[3]]
    return out


def frame(spark, data):
    df = spark.createDataFrame(data, "item_id long, normalized_url string, title string, content string, raw_html string")
    return df.withColumn("url", F.col("normalized_url")).withColumn("host", F.lit("clash")).withColumn("main", F.lit(1))


def truth(data):
    out = set()
    for i, _, title, content, _ in data:
        for no, line in enumerate((content or "").split("\n"), 1):
            if i < 100 and line and line != title and not any(line.startswith(p) for p in PARAGRAPHS):
                out.add((i, no))
    return out


def test_furniture_of_whole_cut_and_missing_pages(spark):
    data = rows()
    got = {tuple(r) for r in b.furniture_lines(frame(spark, data)).collect()}
    assert got == truth(data)


def test_joined_slots_are_the_same(spark):
    data = rows()
    got = {tuple(r) for r in b.furniture_lines(frame(spark, data), broadcast_bytes=0).collect()}
    assert got == truth(data)


def test_main_slots(spark):
    df = frame(spark, rows()).select(F.lit("one").alias("host"), F.col("item_id").alias("key"), "raw_html")
    assert {tuple(sorted(x for x in r["main"] if x[0] != "=")) for r in b.main_slots(df).collect()} == {("div.main-box", "div.text")}


def test_articles(spark):
    data = rows()
    out = {r["item_id"]: r["content"] for r in b.articles(frame(spark, data)).collect()}
    assert out[5] == "\nStory 5\n" + "\n".join(f"{p} (f5)" for p in PARAGRAPHS) and out[100] is None and out[101] == "" and out[102] == "A lone text without any page."


def test_empty_table(spark):
    df = frame(spark, rows()).where("false")
    assert b.furniture_lines(df).collect() == [] and b.articles(df).collect() == []


def test_labels_are_kept_together():
    assert b.furniture_states([3.0, -0.5, 3.0, -4.0, -4.0, 1.0, -4.0]) == [True, True, True, False, False, False, False]
    assert b.furniture_states([]) == []


def test_broken_markup():
    lines, _, whole = b.parse("<div class=a><p>one<br>two<div>three</p></div></div>four<script>x")
    assert lines == [("div.a", "one"), ("div.a", "two"), ("div.a", "three"), ("", "four")] and not whole
    assert b.parse("") == ([], [], False)


def nested_rows():
    """Articles most of whose text is in a table or list of the main slot; bylines, shares and links are nested there too."""
    out = []
    for i in range(40):
        own = f"The {chr(97 + i % 26)}{i} party set out from the upper mill before dawn."
        steps = [f"Step {chr(97 + k)}{chr(97 + i % 26)} of survey {i}: measure the wheel, note the fall and ask the miller, then go on." for k in range(3)]
        inner = f"<ul class=steps>{''.join(f'<li>{x}</li>' for x in steps)}</ul>" if i % 2 else f"<table class=t>{''.join(f'<tr><td>{x}</td></tr>' for x in steps)}</table>"
        side, box = "<div class=side><a>Most read</a></div>", f"<div class=article><h1>Story {i}</h1><p>{own}</p>{inner}<div class=by>By the desk, {i} views</div><div class=more><a>Read {chr(97 + i % 26)}{i} next</a></div></div>"
        page = f"<html><body><div class=wrap><p>Valley Portal</p>{side + box if i % 4 < 2 else box + side}</div></body></html>"
        lines = ["Valley Portal", "Most read", f"Story {i}", own, *steps, f"By the desk, {i} views", f"Read {chr(97 + i % 26)}{i} next"]
        out.append((i, f"https://h.example/{i}", f"Story {i}", "\n".join(lines), page))
    return out


def test_text_nested_in_the_main_slot(spark):
    got = {tuple(r) for r in b.furniture_lines(frame(spark, nested_rows())).collect()}
    assert got == {(i, no) for i in range(40) for no in (1, 2, 8, 9)}


def test_unmarked_containers_are_tokens_of_their_own():
    assert b.parse("<div class=a><div>x</div></div>")[1] == ["div.a", "div.a>div", "/div.a>div", "/div.a"]


def test_cut_pages_teach_no_vectors():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["h", "h"]), pa.array([1, 2]), pa.array(["<body><div class=a>x</div></body>", "<body><div class=a>x"])], names=["host", "key", "raw_html"])
    (out,) = b._learn_batches(iter([batch]))
    assert {r["token"]: r["pages"] for r in out.to_pylist() if r["token"][0] != "="} == {"body": 1, "div.a": 1, "/div.a": 1}
    assert [r["pages"] for r in out.to_pylist() if r["token"][0] == "="] == [1]


def test_order_of_a_class_is_tested():
    import pyarrow as pa

    pages = [f"<body>{x}</body>" for x in ("<div class=a>x</div><div class=b>y</div>", "<div class=b>y</div><div class=a>x</div>")]
    order = [["div.a", "/div.a", "div.b", "/div.b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(["h", "h"]), pa.array(pages), pa.array([order] * 2), pa.array([None] * 2, pa.list_(pa.string()))], names=["host", "raw_html", "classes", "texts"])
    (out,) = b._measure_batches(iter([batch]))
    assert {r["token"]: r["wrong"] for r in out.to_pylist()} == {"div.a": 1, "div.b": 1}


def test_furniture_inside_the_main_container(spark):
    """Share prompts and notices that the template prints among the paragraphs; lines that only some pages have are text."""
    out, want = [], set()
    for i in range(40):
        own = [f"{p} ({chr(97 + i % 26)}{i})" for p in PARAGRAPHS]
        some = ["A list of mills follows."] if i % 3 == 0 else []
        lines = [own[0], "Share this story: mail, print", own[1], *some, f"Read {i * 3} times", own[2], "All rights reserved by the portal"]
        page = f"<html><body><div class=nav><a>Home</a></div><div class=story><h1>Story {i}</h1>{''.join(f'<p>{x}</p>' for x in lines)}</div></body></html>"
        content = ["Home", f"Story {i}", *lines]
        out.append((i, f"https://h.example/{i}", f"Story {i}", "\n".join(content), page))
        want |= {(i, no) for no, x in enumerate(content, 1) if x == "Home" or x.startswith(("Share this", "Read ", "All rights"))}
    assert {tuple(r) for r in b.furniture_lines(frame(spark, out)).collect()} == want


def test_answers_are_left_to_residue(spark):
    data = rows() + [(200 + i, "https://h0.example/e", "Oops", "Internal Server Error.\nHome", None) for i in range(2)]
    got = {tuple(r) for r in b.furniture_lines(frame(spark, data)).collect()}
    assert got == truth(rows())


def test_held_cells_are_handed_on(spark, monkeypatch):
    import pyarrow as pa

    data = rows()
    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * 30), pa.array(list(range(30))), pa.array([r[4] for r in data[:30]])], names=["host", "key", "raw_html"])
    whole = _sum(list(b._learn_batches(iter([batch]))))
    monkeypatch.setattr(b, "_HELD", 5)
    parts = list(b._learn_batches(iter([batch])))
    assert len(parts) > 5 and _sum(parts) == whole


def _sum(parts):
    out = {}
    for p in parts:
        for r in p.to_pylist():
            k = (r["token"], r["parent"], r["line"])
            out[k] = out.get(k, 0) + (r["times"] or 0)
    return out
