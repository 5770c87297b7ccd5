"""Byte-level BPE encoding of a corpus (problem 8).

A text is cut by the vocabulary's pattern into pieces; every piece is merged over a
segment tree of its adjacent pairs. A leaf holds ``rank << b | position`` of the pair
that starts there, an inner node the least of its two children: the root is the leftmost
lowest-rank merge, and a merge changes three leaves and their ancestors. Pieces of like
length are merged side by side, one merge of every piece a round, on NumPy arrays; very
long pieces have a tree of their own. Distinct pieces are merged once in each worker
(a bounded table that is started anew when full).

The vocabulary file (base64 token and rank a line) is read on the driver and broadcast:
its size is fixed, whatever the corpus.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern of the 50k vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**31 - 1)
_LONG = 1024  # bytes; longer pieces are merged one by one
_CELLS = 1 << 18  # leaves merged side by side
_MOST = 300_000  # distinct pieces kept in a worker


class Encoder:
    """Encodes texts to token ids by a rank table; ids are the ranks."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        if len(ranks) > 1 << 16:
            raise ValueError("at most 65,536 tokens")
        self.pattern = regex.compile(pattern)
        self.size = np.zeros(max(ranks.values()) + 1, np.int32)
        self.bytes = {r: t for t, r in ranks.items()}
        for t, r in ranks.items():
            self.size[r] = len(t)
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = r
        self.pairs = pairs
        self._table(pairs)
        self.forget()

    def _table(self, pairs: dict[int, int]) -> None:
        """Open addressing, so that pairs are looked up by whole arrays."""
        self.bits = 21
        keys, values = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32), np.full(1 << self.bits, _NONE, np.int32)
        k, v = np.fromiter(pairs, np.uint32, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(k)
        while len(k):
            free = keys[at] == 0xFFFFFFFF
            # of several that want one free slot the first gets it
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            keys[at[first]], values[at[first]] = k[first], v[first]
            left = np.ones(len(k), bool)
            left[first] = False
            k, v, at = k[left], v[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.keys, self.values = keys, values

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def forget(self) -> None:
        """Start the table of merged pieces anew."""
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.ids, self.total = [], [], [], 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, _NONE if there is none."""
        k = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = self._slot(k)
        found = self.keys[at]
        out = np.where(found == k, self.values[at], _NONE)
        open_ = np.flatnonzero((found != k) & (found != 0xFFFFFFFF))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == k[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != 0xFFFFFFFF)]
        return out

    def _merge_many(self, raw: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts of pieces (rows of bytes, padded to width, a power of two)."""
        n, bits = len(lens), width.bit_length() - 1
        col = np.arange(width, dtype=np.int32)
        inside = col < lens[:, None]
        tok = np.where(inside, self.first[raw], 0).astype(np.int32)
        leaves = np.full((n, width), _NONE, np.int32)
        has = inside[:, 1:]
        r = self.rank(tok[:, :-1][has], tok[:, 1:][has])
        leaves[:, :-1][has] = np.where(r == _NONE, _NONE, (r << bits) | np.broadcast_to(col[:-1], has.shape)[has])
        tree = np.full((n, 2 * width), _NONE, np.int32)
        tree[:, width:] = leaves
        low = width
        while low > 1:
            np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2], out=tree[:, low // 2 : low])
            low //= 2
        tree = tree.reshape(-1)
        tok = tok.reshape(-1)
        # neighbours of live positions; slot 0 and slot width + 1 of a row stand for its ends
        nxt = np.broadcast_to(col + 1, (n, width)).astype(np.int32).copy()
        nxt[np.arange(n), lens - 1] = width
        nxt, prv = nxt.reshape(-1), np.broadcast_to(col - 1, (n, width)).astype(np.int32).reshape(-1).copy()
        live = inside.reshape(-1).copy()
        rows = np.flatnonzero(tree[1 :: 2 * width] != _NONE)
        mask = width - 1
        while len(rows):
            root = tree[rows * (2 * width) + 1]
            base, up = rows * width, rows * (2 * width)
            pos, new = (root & mask).astype(np.int64), root >> bits
            here = base + pos
            gone = nxt[here].astype(np.int64)
            after = nxt[base + gone].astype(np.int64)
            before = prv[here].astype(np.int64)
            tok[here] = new
            nxt[here] = after
            live[base + gone] = False
            leaf = up + width
            tree[leaf + gone] = _NONE
            tree[leaf + pos] = _NONE
            more = np.flatnonzero(after < width)
            if len(more):
                b, p = base[more], pos[more]
                prv[b + after[more]] = p
                r = self.rank(new[more], tok[b + after[more]])
                tree[leaf[more] + p] = np.where(r == _NONE, _NONE, (r << bits) | p.astype(np.int32))
            less = np.flatnonzero(before >= 0)
            if len(less):
                b, p = base[less], before[less]
                r = self.rank(tok[b + p], new[less])
                tree[leaf[less] + p] = np.where(r == _NONE, _NONE, (r << bits) | p.astype(np.int32))
            # logarithmic updates of the ancestors of the changed leaves
            node = np.concatenate([pos, gone, before[less]]) + width
            tops = np.concatenate([up, up, up[less]])
            for _ in range(bits):
                node >>= 1
                at = tops + node
                pair = at + node
                tree[at] = np.minimum(tree[pair], tree[pair + 1])
            rows = rows[tree[up + 1] != _NONE]
        return tok[live], live.reshape(n, width).sum(axis=1)

    def _merge_one(self, raw: bytes) -> list[int]:
        """The same merges for one long piece."""
        tok = self.first[np.frombuffer(raw, np.uint8)].tolist()
        n = len(tok)
        width = 1 << (n - 1).bit_length()
        bits, none, pairs = width.bit_length(), 1 << 62, self.pairs
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get(tok[i] << 16 | tok[i + 1])
            if r is not None:
                tree[width + i] = r << bits | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv, mask = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << bits) - 1
        live = bytearray(b"\1") * n
        while tree[1] != none:
            i, new = tree[1] & mask, tree[1] >> bits
            j = nxt[i]
            k, p = nxt[j] if j < n else n, prv[i]
            tok[i], nxt[i], live[j] = new, k, 0
            tree[width + j] = none
            r = None
            if k < n:
                prv[k] = i
                r = pairs.get(new << 16 | tok[k])
            tree[width + i] = none if r is None else r << bits | i
            changed = [j, i]
            if p >= 0:
                r = pairs.get(tok[p] << 16 | new)
                tree[width + p] = none if r is None else r << bits | p
                changed.append(p)
            for x in changed:
                x = (x + width) >> 1
                while x:
                    a, b = tree[2 * x], tree[2 * x + 1]
                    a = a if a < b else b
                    if tree[x] == a:
                        break
                    tree[x] = a
                    x >>= 1
        return [t for t, alive in zip(tok, live) if alive]

    def _learn(self, pieces: list[str]) -> None:
        """Merge pieces that aren't known yet and add them to the table."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        starts, lengths = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        chunks = []

        def add(which, ids, counts):
            ends = np.cumsum(counts) + self.total
            starts[which], lengths[which] = ends - counts, counts
            chunks.append(ids)
            self.total += len(ids)

        lone = np.flatnonzero(lens == 1)
        if len(lone):
            add(lone, self.first[np.frombuffer(b"".join(raw[i] for i in lone), np.uint8)], np.ones(len(lone), np.int64))
        width = 2
        while width <= _LONG:
            group = np.flatnonzero((lens > width // 2) & (lens <= width)) if width > 2 else np.flatnonzero(lens == 2)
            step = max(1, _CELLS // width)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                cells = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                add(part, *self._merge_many(cells, lens[part], width))
            width *= 2
        for i in np.flatnonzero(lens > _LONG):
            ids = np.array(self._merge_one(raw[i]), np.int32)
            add([i], ids, np.array([len(ids)]))
        n = len(self.known)
        self.known.update((p, n + i) for i, p in enumerate(pieces))
        self.starts.append(starts)
        self.lengths.append(lengths)
        self.ids += chunks

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and their counts; none for empty and null texts."""
        if len(self.known) > _MOST:
            self.forget()
        find, pieces, per = self.pattern.findall, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = find(t)
                per[i] = len(own)
                pieces += own
        if not pieces:
            return np.zeros(0, np.int32), per
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            self._learn(new)
        for name in ("starts", "lengths", "ids"):
            if len(parts := getattr(self, name)) > 1:
                setattr(self, name, [np.concatenate(parts)])
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        starts, lengths = self.starts[0][which], self.lengths[0][which]
        ends = np.cumsum(lengths)
        flat = self.ids[0][np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(per)]]
        return flat.astype(np.int32), np.diff(bounds)


def worker_encoder(shared: Broadcast) -> Encoder:
    """The encoder of this worker process, kept between tasks."""
    kept = sys.modules.setdefault("_brinewell_encoders", type(sys)("_brinewell_encoders")).__dict__
    vocabulary, pattern = shared.value
    key = (hash(vocabulary), pattern)
    if kept.get("key") != key:
        kept["encoder"], kept["key"] = Encoder(vocabulary, pattern), key
    return kept["encoder"]


def share_vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> Broadcast:
    """The vocabulary file for the workers; at most 65,536 tokens, so its size is bounded."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN, rows_at_once: int = 1000) -> DataFrame:
    """(id, ids array<int>): token ids of every row's whole text, without special tokens.

    Null and empty texts have an empty list; every row comes out, repeated ones too; strings
    of special tokens are ordinary text. Other columns are ignored. No shuffle.
    """
    shared = share_vocabulary(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                ids, counts = encoder.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["id", "ids"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)
