import pytest
from pyspark.sql import functions as F

from brinewell.llm import mojibake as m

ZH = ["档案整理按计划推进，登记册已送往阅览区。", "如有疑问，请在下午联系教研室，也可到展厅咨询。", "参加人员请携带申请表和合同文本，在礼堂门前集合。", "统计显示，新生对课程设计的满意度比上一轮提高。"]
EN = ["The café’s “open table” – a résumé clinic – starts soon.", "It’s a façade – or so the hall’s “porters” say."]


def sloppy(raw: bytes) -> str:
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode("cp1252"))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


WAYS = {
    "utf8_as_cp1252": lambda s: sloppy(s.encode()),
    "utf8_as_cp1252_twice": lambda s: sloppy(sloppy(s.encode()).encode()),
    "utf8_as_cp1251": lambda s: s.encode().decode("cp1251", "replace"),
    "gbk_as_cp1252": lambda s: sloppy(s.encode("gbk")),
    "utf8_as_gbk": lambda s: s.encode().decode("gbk", "replace"),
    "gbk_as_big5": lambda s: s.encode("gbk").decode("big5hkscs", "replace"),
}


@pytest.fixture(scope="module")
def frequencies():
    counts = {}
    for t in (ZH + EN) * 500:
        for c in t:
            counts[ord(c)] = counts.get(ord(c), 0) + 1
    return m.Frequencies(counts)


@pytest.mark.parametrize("way", WAYS)
def test_chains_are_undone(way, frequencies):
    for text in ZH:
        assert m.evidence(WAYS[way](text), frequencies, -8.5)
        if way not in ("utf8_as_cp1251", "utf8_as_gbk", "gbk_as_big5"):
            assert m.restore(WAYS[way](text), way, frequencies) == text


@pytest.mark.parametrize("text", ZH + EN + ["plain ASCII", "Äpfel, jalapeño, crème brûlée", "他用俄语写了 привет，又写「お茶をどうぞ」。", "古籍里的生僻字“龘”“犇”“燚”", "23 µm ± 4 nm at 5 °C, α≈2"])
def test_correct_text_has_no_evidence(text, frequencies):
    assert m.evidence(text, frequencies, -8.5) is None


def items(spark, rows):
    df = spark.createDataFrame(rows, "item_id long, normalized_url string, url string, title string, content string")
    return df.withColumn("id", F.lit("clash")).withColumn("source", F.lit(1))


def test_fields_are_found_and_restored(spark):
    rows = [(i, f"https://h{i % 3}.example/{i}", None, ZH[i % 4][:12], "\n".join(ZH[i % 4 :] + EN)) for i in range(200)]
    want = {}
    for k, way in enumerate(WAYS):
        i = 300 + k
        rows.append((i, f"https://h{k % 3}.example/{i}", None, ZH[0], ZH[1] + "\n" + WAYS[way](ZH[2] + ZH[3])))
        want[i, "content"] = ZH[1] + "\n" + ZH[2] + ZH[3]
    rows += [(400, None, None, None, None), (401, "x", "x", "", ""), (402, "https://h1.example/", None, "标题�损坏", "ok"), (300, *rows[200][1:])]
    df = items(spark, rows)
    out = {(r["item_id"], r["field_name"]): r for r in m.restored_fields(df).collect()}
    assert set(out) == set(want) | {(402, "title")}
    for key, text in want.items():
        if out[key]["whole"]:
            assert out[key]["text"] == text
    assert sum(out[k]["whole"] for k in want) >= 3 and out[402, "title"]["chain"] == "lost" and not out[402, "title"]["whole"]


def test_weak_evidence_is_pooled(spark, monkeypatch):
    """One record's 4 nats are no proof; where most records of a source have as much, they are."""
    monkeypatch.setattr(m, "_evidence_batches", lambda shared, rare: _four_nats())
    rows = [(i, f"https://bad.example/{i}", None, "é" if i % 10 < 7 else "中", "中") for i in range(400)]
    rows += [(1000 + i, f"https://good.example/{i}", None, "é" if i % 200 == 0 else "中", "中") for i in range(1000)]
    got = {tuple(r)[:3] for r in m.garbled_fields(items(spark, rows), weight=20.0)[0].select("item_id", "field_name", "chain").collect()}
    assert got == {(i, "title", "utf8_as_cp1252") for i in range(400) if i % 10 < 7}


def _four_nats():
    """Evidence of 4 nats for every title with an accent."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, sources, gains = [], [], []
            for i, source, title in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if "é" in title:
                    ids.append(i)
                    sources.append(source)
                    gains.append([4.0] + [0.0] * 10)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sources), pa.array(["title"] * len(ids), pa.string()), pa.array(gains, pa.list_(pa.float64()))], names=["id", "source", "field_name", "gains"]
            )

    return run


@pytest.mark.parametrize("way", ["utf8_as_gbk", "gbk_as_big5"])
def test_one_clause_of_a_long_line(way, frequencies):
    clause = "统计显示，新生对课程设计的满意度比上一轮提高".split("，")[1]
    bad = WAYS[way](clause)
    line = "，".join([ZH[0][:-1], ZH[1][:-1], bad, ZH[2][:-1], ZH[0][:-1], ZH[1][:-1]] * 1) + "。"
    assert m.evidence(line, frequencies, -8.5)
    back = m.restore(line, way, frequencies)
    assert back.startswith(ZH[0][:-1]) and back.endswith(ZH[1]) and back != line


def test_empty_table(spark):
    df = items(spark, [(1, "u", "u", "t", "c")]).where("false")
    assert m.garbled_fields(df)[0].collect() == [] and m.restored_fields(df).collect() == []
