import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brinewell.llm import byte_bpe as bb
from brinewell.llm import splitting as sp

VOCABULARY = open(bb.DEFAULT_VOCABULARY, "rb").read()
ENCODER = bb.Encoder(VOCABULARY)
RANKS = {base64.b64decode(t): int(r) for t, r in (x.split() for x in VOCABULARY.splitlines())}
OTHER = tiktoken.Encoding("other", pat_str=bb.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encode(*texts):
    ids, counts = ENCODER.encode(list(texts))
    return [list(map(int, x)) for x in np.split(ids, np.cumsum(counts)[:-1])]


@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_same_as_the_public_encoder(texts):
    assert encode(*texts) == [OTHER.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, "哈" * 3000, " " * 4000, "ab" * 2000 + "!" * 3000, "<|endoftext|>", "1" * 1025, "\r\n\t \u0000 é ☃ 𝔘", "中文English混排123"])
def test_long_and_odd_texts(text):
    assert encode(text) == [OTHER.encode_ordinary(text)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bb, "_MOST", 3)
    e = bb.Encoder(VOCABULARY)
    for t in ("one two three four", "five six seven", "one two"):
        assert list(e.encode([t])[0]) == OTHER.encode_ordinary(t)


def test_encode_texts(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (1, "hello world"), (4, "中文 <|endoftext|>"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r["doc_id"], r["ids"]) for r in bb.encode_texts(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((i, OTHER.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert bb.encode_texts(df.where("false"), "doc_id", "text").collect() == []


def long_texts():
    para = "The archive opened at nine. It closed at five! Was it full? " * 12
    zh = "档案整理按计划推进。编号四三的登记册已送往阅览区！是否完成？" * 20
    return {
        1: "\n\n".join(f"Chapter {i}\n{para}" for i in range(1, 12)),
        2: "\n".join(zh for _ in range(12)),
        3: "中" * 9000,
        4: "short",
        5: None,
        6: "",
        7: "x" * 30000,
        8: para * 3,
        9: "第一章 总则\r\n" + zh * 4 + "\r\n第二章 细则\r\n" + zh * 5,
    }


def test_pieces(spark):
    texts = long_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sp.split_long_texts(df, "doc_id", "text", 512, 32).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {i for i, t in texts.items() if t and len(OTHER.encode_ordinary(t)) > 512}
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r["piece_no"])
        n = len(OTHER.encode_ordinary(texts[i]))
        assert [p["piece_no"] for p in pieces] == list(range(1, len(pieces) + 1)) and {p["n_pieces"] for p in pieces} == {len(pieces)}
        assert pieces[0]["start_token"] == 0 and pieces[-1]["end_token"] == n and pieces[-1]["boundary"] == "end"
        for a, b in zip(pieces, pieces[1:]):
            assert b["start_token"] == a["end_token"] - 32
        for p in pieces:
            assert 0 < p["n_tokens"] <= 512 and p["n_tokens"] == p["end_token"] - p["start_token"]
            assert len(OTHER.encode_ordinary(p["text"])) <= 512 and p["text"] in texts[i]
    assert all(p["boundary"] == "none" for p in by[3][:-1])
    for i in (1, 2, 9):  # texts with boundaries everywhere are cut nowhere else
        assert all(p["boundary"] != "none" for p in by[i])
    assert any(p["boundary"] == "chapter" for p in by[1])


def test_plan_takes_more_pieces_when_a_limit_fails():
    strength = np.zeros(1001, int)
    strength[[300, 310]] = sp.PARAGRAPH
    pieces = sp.plan(strength, 400, 20)
    assert pieces[-1][1] == 1000 and all(b - a <= 400 for a, b, _ in pieces) and all(y[0] == x[1] - 20 for x, y in zip(pieces, pieces[1:]))
    assert sp.plan(np.zeros(11, int), 400, 20) == [(0, 10, sp.END)]


def test_pieces_of_all_documents(spark):
    """Limit, overlap, coverage and boundaries of every piece, by the public encoder."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = {}
    for r in sp.split_long_texts(docs, "doc_id", "text", 2048, 64).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    sizes = {i: len(OTHER.encode_ordinary(t)) for i, t in texts.items() if t}
    assert set(pieces) == {i for i, n in sizes.items() if n > 2048}
    for i, rows in pieces.items():
        rows.sort(key=lambda r: r["piece_no"])
        ids = OTHER.encode_ordinary(texts[i])
        assert rows[0]["start_token"] == 0 and rows[-1]["end_token"] == len(ids) and [r["piece_no"] for r in rows] == list(range(1, rows[0]["n_pieces"] + 1))
        assert len(rows) >= -(-(len(ids) - 64) // (2048 - 64))
        for r in rows:
            raw = b"".join(OTHER.decode_single_token_bytes(t) for t in ids[r["start_token"] : r["end_token"]])
            assert r["n_tokens"] == r["end_token"] - r["start_token"] <= 2048 and len(OTHER.encode_ordinary(r["text"])) <= 2048
            assert raw.decode("utf-8", "ignore") in r["text"] and len(r["text"].encode()) - len(raw) <= 6
            if r["boundary"] == "sentence":
                assert r["text"].rstrip(" \t\u3000")[-1] in ".!?…；。！？”’」』）)\"'"
        assert all(b["start_token"] == a["end_token"] - 64 for a, b in zip(rows, rows[1:]))
