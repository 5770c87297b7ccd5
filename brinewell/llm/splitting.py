"""Splitting long texts at natural boundaries (problem 10).

Sizes are tokens of a public tokenizer. The least number of pieces p is computed, p
equally long targets are placed, and every target is moved to the strongest boundary
nearby: a chapter's start, a paragraph's end, a sentence's end; only a piece that has none
of these ends at a clause or, failing that, at a character. A piece holds at most
``limit`` tokens and begins ``overlap`` tokens before the end of the one before. If some
piece would break the limit, p grows by one and the targets are placed anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm.byte_bpe import DEFAULT_VOCABULARY, PATTERN, Encoder, share_vocabulary, worker_encoder

NOWHERE, CLAUSE, SENTENCE, PARAGRAPH, CHAPTER, END = range(6)
NAMES = {CHAPTER: "chapter", PARAGRAPH: "paragraph", SENTENCE: "sentence", CLAUSE: "clause", NOWHERE: "none", END: "end"}

#: A heading: its line's start is a chapter's boundary.
_HEADING = regex.compile(
    r"(?m)^[ \t　]*(?:第[0-9０-９一二三四五六七八九十百千零〇两]+[章节節篇部回卷讲]|(?:chapter|section|part)\s+(?:\d+|[ivxlc]+)\b|#{1,6}\s|[一二三四五六七八九十]+、)",
    regex.IGNORECASE,
)
_PARAGRAPH = regex.compile(r"(?:\r\n|\r|\n| | |\u0085)\s*")
_SENTENCE = regex.compile(r"(?:[。！？!?…；]+[”’」』）)\"']*|\.(?=[\s”’\"')])[”’\"')]*)[ \t　]*")


_CLAUSE = regex.compile(r"[;,:，、：](?=\D)[ \t　]*")


def boundaries(text: str) -> dict[int, int]:
    """Character offset -> strength of the boundaries inside a text."""
    out: dict[int, int] = dict.fromkeys((m.end() for m in _CLAUSE.finditer(text)), CLAUSE)
    for m in _SENTENCE.finditer(text):
        out[m.end()] = SENTENCE
        if m.end() != (e := len(text[m.start() : m.end()].rstrip(" \t　")) + m.start()):
            out[e] = SENTENCE
    for m in _PARAGRAPH.finditer(text):
        out[m.end()] = PARAGRAPH
        out.setdefault(m.start(), PARAGRAPH)
        out[m.start()] = max(out[m.start()], PARAGRAPH)
        line = m.start() + len(m.group().split("\n")[0]) + 1
        if line <= m.end():
            out[line] = max(out.get(line, 0), PARAGRAPH)
    for m in _HEADING.finditer(text):
        out[m.start()] = CHAPTER
        for at in (m.start() - 1, m.start() - 2):  # the line end before the heading
            if at > 0 and text[at] in "\r\n":
                out[at] = CHAPTER
        lead = m.start() + len(m.group()) - len(m.group().lstrip())
        out[lead] = CHAPTER
    out.pop(0, None)
    out.pop(len(text), None)
    return out


def token_boundaries(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token index 0..n: strength of a cut before it (-1 inside a character), and its character."""
    if text.isascii():
        char_at = np.arange(len(text) + 1)
    else:
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        char_at = np.zeros(len(code) + 1, np.int64)
        np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), out=char_at[1:])
    byte_at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=byte_at[1:])
    char = np.searchsorted(char_at, byte_at, "right") - 1
    strength = np.where(char_at[char] == byte_at, NOWHERE, -1)
    found = boundaries(text)
    if found:
        offset = char_at[np.fromiter(found, np.int64, len(found))]
        value = np.fromiter(found.values(), np.int64, len(found))
        t = np.searchsorted(byte_at, offset)
        there = byte_at[np.minimum(t, len(sizes))] == offset
        np.maximum.at(strength, t[there], value[there])
    return strength, char


def plan(strength: np.ndarray, limit: int, overlap: int, extra: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) in tokens of the pieces of a text of len(strength) - 1 tokens."""
    n = len(strength) - 1
    if n <= limit:
        return [(0, n, END)]
    p = -(-(n - overlap) // (limit - overlap)) + extra
    while True:
        length = (n + (p - 1) * overlap) / p
        slack = max(1, int(length / 4))
        out, start = [], 0
        for i in range(p - 1):
            target = round((i + 1) * (length - overlap)) + overlap
            top = min(start + limit, n - 1)
            low = start + overlap + 1
            # what is left must fit into the pieces that are left
            need = n - (p - 1 - i) * (limit - overlap)
            low = max(low, need)
            if low > top:
                break
            cut = None
            # a strong boundary nearby, else one anywhere in reach, else a clause's end, else a character's
            for reach, least in ((slack, SENTENCE), (n, SENTENCE), (slack, CLAUSE), (n, CLAUSE)):
                a, b = max(low, target - reach), min(top, target + reach)
                if a > b:
                    continue
                window = strength[a : b + 1]
                best = int(window.max())
                if best >= least:
                    at = np.flatnonzero(window == best) + a
                    cut = int(at[np.argmin(np.abs(at - target))])
                    break
            if cut is None:
                at = np.flatnonzero(strength[low : top + 1] >= NOWHERE) + low
                cut = int(at[np.argmin(np.abs(at - target))]) if len(at) else min(max(target, low), top)
                best = NOWHERE
            out.append((start, cut, best))
            start = cut - overlap
        if len(out) == p - 1 and n - start <= limit:
            return [*out, (start, n, END)]
        p += 1


Piece = tuple[int, int, int, int, int, int, int]


def split_texts(texts: list[str], encoder: Encoder, limit: int, overlap: int) -> list[list[Piece]]:
    """For each text its pieces: (piece, pieces, start, end, strength, first character, character after the last)."""
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    out: list[list[Piece]] = [[] for _ in texts]
    marks = {}
    for i in np.flatnonzero(counts > limit):
        marks[i] = token_boundaries(texts[i], encoder.size[ids[ends[i] - counts[i] : ends[i]]])
    todo = {i: 0 for i in marks}
    while todo:
        spans, of = {}, []
        for i, extra in todo.items():
            strength, char = marks[i]
            pieces = plan(strength, limit, overlap, extra)
            spans[i] = (pieces, [(int(char[a]), int(char[b]) + int(strength[b] < 0)) for a, b, _ in pieces])
            of += [i] * len(pieces)
        # a piece that starts inside a character holds the whole character; read by itself it must keep the limit
        _, sizes = encoder.encode([texts[i][x:y] for i, (_, where) in spans.items() for x, y in where])
        over = {of[k] for k in np.flatnonzero(sizes > limit)}
        for i, (pieces, where) in spans.items():
            if i not in over:
                out[i] = [(k + 1, len(pieces), a, b, s, x, y) for k, ((a, b, s), (x, y)) in enumerate(zip(pieces, where))]
        todo = {i: todo[i] + 1 for i in over}
    return out


def split_long_texts(
    df: DataFrame, id_col: str, text_col: str, limit: int = 2048, overlap: int = 64, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN, rows_at_once: int = 500
) -> DataFrame:
    """Pieces of the texts longer than limit tokens.

    (id, piece_no, n_pieces, start_token, end_token, n_tokens, boundary, text): piece_no counts
    from 1; tokens are those of the whole text, start included, end excluded; ``boundary`` names
    where the piece ends (chapter, paragraph, sentence; clause or none if the piece has no such place; end).
    A start within a character's bytes gives the text from that character on. Null, empty and
    shorter texts have no pieces; repeated rows repeat theirs. A text of at most ``limit`` bytes
    can't be longer and isn't encoded.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("0 <= overlap < limit / 2")
    shared = share_vocabulary(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                texts = part.column(1).to_pylist()
                rows = []
                for i, text, pieces in zip(part.column(0).to_pylist(), texts, split_texts(texts, encoder, limit, overlap)):
                    rows += [(i, no, of, a, b, b - a, NAMES[s], text[x:y]) for no, of, a, b, s, x, y in pieces]
                yield _pieces(rows)

    out = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .where(F.octet_length("text") > limit)
        .mapInArrow(run, "id long, piece_no int, n_pieces int, start_token int, end_token int, n_tokens int, boundary string, text string")
    )
    return out.withColumnRenamed("id", id_col)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string()]
    names = ["id", "piece_no", "n_pieces", "start_token", "end_token", "n_tokens", "boundary", "text"]
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
