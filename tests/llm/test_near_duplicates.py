import random

import pytest
from pyspark.sql import functions as F

from brinewell.llm import near_duplicates as nd


def tokens(t, q=5):
    s = nd.squeeze(t)
    return {s[i : i + q] for i in range(len(s) - q + 1)}


def brute(rows, similarity, least=200):
    rows = [(i, t) for i, t in rows if t and len(t) >= least]
    out = set()
    for k, (a, x) in enumerate(rows):
        for b, y in rows[k + 1 :]:
            p, q = tokens(x), tokens(y)
            if p | q and len(p & q) / len(p | q) >= similarity and a != b:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7)))
    rows, n = [], 0
    for _ in range(30):
        base = [word() for _ in range(rnd.randint(50, 300))]
        for _ in range(rnd.randint(1, 4)):
            n += 1
            edited = [w if rnd.random() > rnd.choice((0.0, 0.02, 0.05, 0.08)) else word() for w in base]
            rows.append((n, " ".join(edited)))
        if rnd.random() < 0.5:  # reordered halves, other white space and case
            n += 1
            rows.append((n, ("\n".join(base[len(base) // 2 :] + base[: len(base) // 2])).upper()))
    rows += [(900, "spam " * 60), (901, "spam  " * 70), (902, "spam " * 60), (903, None), (904, ""), (905, "x" * 199), (906, "中文" * 150), (907, "中文" * 151)]
    return rows


@pytest.mark.parametrize("similarity", [0.7, 0.9])
def test_all_pairs_are_found(spark, texts, similarity):
    df = spark.createDataFrame(texts, "item_id long, content string").withColumn("id", F.lit("clash")).withColumn("fp", F.lit(1))
    got = {tuple(r) for r in nd.near_duplicate_pairs(df, "item_id", "content", similarity).collect()}
    assert got == brute(texts, similarity)


def links(spark, texts, similarity, per_block):
    df = spark.createDataFrame(texts, "item_id long, content string")
    members, found = nd._classes(df, "item_id", "content", similarity, 5, 200, per_block)
    ids = {}
    for r in members.collect():
        ids.setdefault(r["fp"], []).append(r["id"])
    out = {(min(a, b), max(a, b)) for same in ids.values() for a in same for b in same if a != b}
    return out | {(min(a, b), max(a, b)) for r in found.collect() for a in ids[r["fp_a"]] for b in ids[r["fp_b"]]}


@pytest.mark.parametrize("per_block", [4, 5])
def test_all_pairs_are_found_with_more_tokens_a_block(spark, texts, per_block):
    assert links(spark, texts, 0.7, per_block) == brute(texts, 0.7)


@pytest.mark.parametrize("hot, levels", [(2, 3), (2, 1), (5, 2)])
def test_hot_keys_lose_no_pair(spark, texts, monkeypatch, hot, levels):
    monkeypatch.setattr(nd, "HOT", hot)
    monkeypatch.setattr(nd, "LEVELS", levels)
    furniture = " " + "all rights reserved by the department of quiet rivers and slow trains, mail to the office" * 2
    rows = [(i, t + furniture) for i, t in texts if t]
    assert links(spark, rows, 0.7, 3) == brute(rows, 0.7)


def test_edited_texts_at_the_threshold_are_found(spark):
    """Recall on pairs made to lie just above the similarity, at every level of tokens a block."""
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(400):
        n = rnd.randint(210, 1500)
        base = [rnd.choice(letters) for _ in range(n)]
        edited = list(base)
        while True:
            last = list(edited)
            edited[rnd.randrange(n)] = rnd.choice(letters)
            a, b = tokens("".join(base)), tokens("".join(edited))
            if len(a & b) / len(a | b) < 0.7:
                break
        rows += [(2 * k, "".join(base)), (2 * k + 1, "".join(last))]
    wanted = {(2 * k, 2 * k + 1) for k in range(400)}
    for per_block in (3, 4, 5):
        assert len(links(spark, rows, 0.7, per_block) & wanted) >= 0.99 * len(wanted)


def test_the_sieve_bounds_the_distance():
    rnd = random.Random(5)
    import numpy as np

    for n in (40, 150, 700, 5000):
        h = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        band = len(h).bit_length() - 1
        other = np.unique(np.concatenate([h[: int(0.85 * n)], np.array([rnd.getrandbits(64) for _ in range(int(0.1 * n))], np.uint64)]))
        far = np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64)
        word = lambda x: np.array([nd.sieve(np.unique(x), band if n >= 64 else 0)], np.uint64)
        assert nd.sifted(word(h), word(other), 0.7).all() and not nd.sifted(word(h), word(far), 0.7).any()
        assert not nd.sifted(word(h), word(h[: n // 2]), 0.7).any()


def test_repeated_rows_and_null_ids(spark, texts):
    rows = texts[:10] + texts[:10] + [(None, texts[0][1])]
    df = spark.createDataFrame(rows, "item_id long, content string")
    pairs = nd.near_duplicate_pairs(df, "item_id", "content", 0.7).collect()
    assert len(pairs) == len(set(pairs)) and {tuple(p) for p in pairs} == brute(texts[:10], 0.7)


def test_groups(spark, texts):
    df = spark.createDataFrame(texts, "item_id long, content string")
    rows = {r["id"]: r for r in nd.near_duplicate_groups(df, "item_id", "content", 0.7).collect()}
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(texts, 0.7):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {i: r["group_id"] for i, r in rows.items()} == {i: root(i) for i in rows}
    assert rows[900]["n_copies"] == 3 and rows[900]["n_links"] == 0
    assert set(rows) == {i for i, _ in texts} and rows[903]["n_copies"] == rows[904]["n_copies"] == 1


def test_groups_of_short_and_null_texts(spark):
    df = spark.createDataFrame([(1, "short"), (2, "short"), (3, ""), (4, ""), (5, None), (6, None), (7, "other"), (None, "short")], "item_id long, content string")
    got = {tuple(r) for r in nd.near_duplicate_groups(df, "item_id", "content", 0.7).collect()}
    assert got == {(1, 1, 0, 2), (2, 1, 0, 2), (3, 3, 0, 2), (4, 3, 0, 2), (5, 5, 0, 1), (6, 6, 0, 1), (7, 7, 0, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "item_id long, content string")
    assert nd.near_duplicate_pairs(df, "item_id", "content", 0.7).collect() == []
    assert nd.near_duplicate_groups(df, "item_id", "content", 0.7).collect() == []


def test_sliced_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "COPIES_A_SLICE", 7)
    df = spark.range(40).select(F.col("id").alias("item_id"), F.lit("the same text again " * 20).alias("content"))
    assert nd.near_duplicate_pairs(df, "item_id", "content", 0.7).count() == 40 * 39 // 2


def test_blocks_grow_with_the_threshold():
    assert nd.plan_blocks(0.9, 3) < nd.plan_blocks(0.8, 3) < nd.plan_blocks(0.7, 3) < nd.plan_blocks(0.7, 4)
