"""Evaluation texts in training documents, by winnowing (problem 9).

Both sides are lower-cased and reduced to letters and digits. Of every window of w
consecutive k-gram hashes the least is kept (the leftmost of equals), so any shared run
of at least k + w - 1 characters has a fingerprint in common. Fingerprints are joined,
every hit is extended character by character to its whole run and kept if the run has at
least ``min_run`` characters. k + w - 1 = min_run: no such run is missed.

The evaluation side is the bounded one: its size is checked. Up to ``broadcast_chars``
characters it goes to the workers as one sorted array; beyond that both sides'
fingerprints are joined by Spark and the texts follow the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.session import cut_lineage

_BASE = 0x9E3779B97F4A7C15
_FOLD: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point whether it is a letter or a digit."""
    if not _FOLD:
        _FOLD.append(np.array([not 0xD800 <= c < 0xE000 and chr(c).isalnum() for c in range(0x110000)]))
    return _FOLD[0]


def fold(text: str) -> np.ndarray:
    """Code points of the text's letters and digits, the whole text lower-cased first: some letters' lower case depends on their place."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return a[_letters()[a]]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, by prefix sums of a polynomial modulo 2**64."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.full(len(codes), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inverse = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    mixed = codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mixed * powers)])
    h = (sums[k:] - sums[:-k]) * inverse
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xFF51AFD7ED558CCD)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: of every window of w hashes the leftmost least (by its upper 40 bits)."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    if n >= 1 << 24:
        raise ValueError("windows are taken over at most 2**24 hashes at once")
    v = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    if n < w:
        return np.array([int(v.min()) & 0xFFFFFF], np.int64)
    span, least = 1, v
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: n - w + 1], least[w - span : w - span + n - w + 1])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def _run(a: np.ndarray, i: int, b: np.ndarray, j: int, k: int) -> int:
    """Length of the whole shared run around a k-gram hit; 0 if the hit is a hash collision."""
    if not np.array_equal(a[i : i + k], b[j : j + k]):
        return 0
    left = min(i, j)
    back = np.flatnonzero(a[i - left : i][::-1] != b[j - left : j][::-1])
    left = int(back[0]) if len(back) else left
    right = min(len(a) - i, len(b) - j) - k
    ahead = np.flatnonzero(a[i + k : i + k + right] != b[j + k : j + k + right])
    right = int(ahead[0]) if len(ahead) else right
    return left + k + right


_CHUNK = 1 << 22


def _kept(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's fingerprints; long texts in overlapping chunks, none cut."""
    hs, ps = [], []
    for at in range(0, max(1, len(codes) - k + 1), _CHUNK):
        h = gram_hashes(codes[at : at + _CHUNK + w + k - 2], k)
        p = winnow(h, w)
        hs.append(h[p])
        ps.append(p + at)
    return np.concatenate(hs), np.concatenate(ps)


def _index(items: list[tuple[int, str]], k: int, w: int):
    """Sorted fingerprints of the evaluation side with item and position, and the folded texts."""
    texts, hs, who, ps = {}, [], [], []
    for i, text in items:
        codes = fold(text)
        if len(codes) < k + w - 1:
            continue
        n = len(texts)
        texts[n] = (i, codes)
        h, p = _kept(codes, k, w)
        hs.append(h)
        who.append(np.full(len(h), n))
        ps.append(p)
    if not hs:
        return None
    h, who, p = np.concatenate(hs), np.concatenate(who), np.concatenate(ps)
    order = np.argsort(h, kind="stable")
    seen = np.zeros(1 << 20, bool)
    seen[(h >> np.uint64(44)).astype(np.int64)] = True
    return h[order], who[order], p[order], texts, seen


def _match_batches(index, k: int, w: int, min_run: int):
    hashes, who, places, texts, seen = index.value if hasattr(index, "value") else index

    def hits_of(doc: int, codes: np.ndarray, h: np.ndarray, p: np.ndarray, out: dict) -> None:
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for a, b, at in zip(lo, hi, p):
            for x in range(a, b):
                item, other = texts[int(who[x])]
                key = (doc, item)
                if key not in out:
                    run = _run(codes, int(at), other, int(places[x]), k)
                    if run >= min_run:
                        out[key] = run

    def flush(docs: list[int], parts: list[np.ndarray], out: dict) -> None:
        """Texts between gaps of k zeros, winnowed as one array: windows across a gap only add fingerprints."""
        if not parts:
            return
        gap = np.zeros(k, np.uint32)
        joined, starts, at = [], [], 0
        for c in parts:
            starts.append(at)
            joined += [c, gap]
            at += len(c) + k
        h = gram_hashes(np.concatenate(joined), k)
        p = winnow(h, w)
        p = p[seen[(h[p] >> np.uint64(44)).astype(np.int64)]]
        if not len(p):
            return
        found = hashes[np.minimum(np.searchsorted(hashes, h[p]), len(hashes) - 1)] == h[p]
        p = p[found]
        if not len(p):
            return
        of = np.searchsorted(np.array(starts), p, "right") - 1
        for d in np.unique(of):
            mine = p[of == d]
            local = mine - starts[d]
            inside = local <= len(parts[d]) - k
            hits_of(docs[d], parts[d], h[mine[inside]], local[inside], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], int] = {}
            docs, parts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = fold(text)
                if len(codes) < min_run:
                    continue
                if len(codes) > _CHUNK:
                    h, p = _kept(codes, k, w)
                    hits_of(doc, codes, h, p, out)
                    continue
                docs.append(doc)
                parts.append(codes)
                size += len(codes) + k
                if size > 1 << 20:
                    flush(docs, parts, out)
                    docs, parts, size = [], [], 0
            flush(docs, parts, out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in out], pa.int64()),
                    pa.array([i for _, i in out], pa.int64()),
                    pa.array(list(out.values()), pa.int32()),
                ],
                names=["doc_id", "item_id", "run"],
            )

    return run


def _fingerprints(k: int, w: int, min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = fold(text)
                if len(codes) < min_run:
                    continue
                h, _ = _kept(codes, k, w)
                h = np.unique(h).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int64)), pa.array(h)], names=["id", "h"])

    return run


def _pair_runs(k: int, w: int, min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], int] = {}
            for doc, item, text, other in zip(*(batch.column(i).to_pylist() for i in range(4))):
                index = _index([(item, other)], k, w)
                if index:
                    part: dict[tuple[int, int], int] = {}
                    table = pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([text], pa.string())], names=["id", "text"])
                    for b in _match_batches(index, k, w, min_run)(iter([table])):
                        for d, i, n in zip(*(b.column(x).to_pylist() for x in range(3))):
                            part[d, i] = n
                    out |= part
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.int64()), pa.array(list(out.values()), pa.int32())],
                names=["doc_id", "item_id", "run"],
            )

    return run


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_run: int = 40, k: int = 20, broadcast_chars: int = 20_000_000
) -> DataFrame:
    """(doc_id, item_id, run): documents sharing a run of at least min_run letters and digits with an item.

    ``run`` is the length of a shared run found, at least min_run. Null ids and texts, and texts
    of fewer than min_run letters and digits, have no cases; repeated rows give one. Extra columns
    are ignored.
    """
    if not 1 < k <= min_run:
        raise ValueError("1 < k <= min_run")
    w = min_run - k + 1
    corpus = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and length(text) >= %d" % min_run)
    tests = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and length(text) >= %d" % min_run)
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    schema = "doc_id long, item_id long, run int"
    if size <= broadcast_chars:
        index = _index([(r["id"], r["text"]) for r in tests.collect()], k, w)
        if index is None:
            return docs.sparkSession.createDataFrame([], schema)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            return _match_batches(shared, k, w, min_run)(batches)

        found = corpus.mapInArrow(run, schema)
    else:
        prints = _fingerprints(k, w, min_run)
        a = corpus.mapInArrow(prints, "id long, h long").withColumnRenamed("id", "doc_id")
        b = tests.mapInArrow(prints, "id long, h long").withColumnRenamed("id", "item_id")
        pairs = cut_lineage(a.join(b, "h").select("doc_id", "item_id").distinct())
        with_texts = (
            pairs.join(corpus.select(F.col("id").alias("doc_id"), "text"), "doc_id")
            .join(tests.select(F.col("id").alias("item_id"), F.col("text").alias("other")), "item_id")
            .select("doc_id", "item_id", "text", "other")
        )
        found = with_texts.mapInArrow(_pair_runs(k, w, min_run), schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
