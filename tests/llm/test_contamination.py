import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewell.llm import contamination as c


def plain(t):
    return "".join(x for x in t.lower() if x.isalnum())


def brute(docs, items, run=40):
    out = set()
    for d, t in docs:
        for i, u in items:
            if d is not None and i is not None and t and u:
                a, b = plain(t), plain(u)
                if any(b[k : k + run] in a for k in range(len(b) - run + 1)):
                    out.add((d, i))
    return out


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(11)
    make = lambda n: "".join(rnd.choice("abcdefghij 中文字符测试，。\n") for _ in range(n))
    items = [(i, make(150)) for i in range(8)] + [(8, None), (9, ""), (10, "short"), (None, make(100)), (0, None)]
    docs = []
    for d in range(60):
        t = make(rnd.randint(0, 400))
        if d % 2:
            u = items[rnd.randrange(8)][1]
            a = rnd.randrange(0, 60)
            part = u[a : a + rnd.randint(40, 75)]
            t = t[:100] + "  ".join(part.upper() if d % 3 else part) + t[100:]
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, items[1][1] * 40), (None, items[0][1])]
    return docs, items


@pytest.mark.parametrize("chars", [20_000_000, 0])
def test_every_shared_run_is_found(spark, data, chars):
    docs, items = data
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    rows = c.leaked_items(a, b, broadcast_chars=chars).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items) and len(rows) == len(brute(docs, items))
    assert all(r["run"] >= 40 for r in rows)


def test_empty_tables(spark, data):
    docs = spark.createDataFrame(data[0], "doc_id long, text string")
    items = spark.createDataFrame(data[1], "item_id long, text string")
    assert c.leaked_items(docs, items.where("false")).collect() == []
    assert c.leaked_items(docs.where("false"), items).collect() == []


def test_winnow_keeps_one_of_every_window():
    rnd = np.random.default_rng(5)
    h = rnd.integers(0, 2**63, 500, dtype=np.uint64)
    p = c.winnow(h, 21)
    assert all(((p >= i) & (p < i + 21)).any() for i in range(480)) and len(p) < 100


def test_long_texts_are_read_in_chunks(monkeypatch):
    codes = c.fold("".join(chr(97 + (i * i) % 26) + str(i) for i in range(3000)))
    whole = set(zip(*map(tuple, c._kept(codes, 20, 21))))
    monkeypatch.setattr(c, "_CHUNK", 700)
    assert {h for h, _ in whole} <= {h for h in c._kept(codes, 20, 21)[0]}


def test_lower_case_that_depends_on_the_place(spark):
    u = "ΟΔΟΣ ΤΟΥ ΠΟΤΑΜΟΥ ΚΑΙ Ο ΜΙΚΡΟΣ ΜΥΛΟΣ ΣΤΟΝ ΛΟΦΟ ΤΟΥ ΧΩΡΙΟΥ İstanbul"
    docs = [(1, "πριν. " + u.lower() + " μετά"), (2, u), (3, u.replace(" ", "")), (4, u.replace("Σ ", "σ "))]
    items = [(1, u), (2, u.lower())]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (20_000_000, 0):
        rows = c.leaked_items(a, b, broadcast_chars=chars).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items)
