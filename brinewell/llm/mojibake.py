"""Garbled text from wrong character encodings (problem 5).

A latent variable z names the chain of encodings a field went through: none, or one of
``CHAINS``. Undoing a chain where it can be undone gives a text; its likelihood is that of
its characters under the corpus' own character frequencies, which are counted over all
rows. Expectation-maximization per source and field pools the weak evidence of single
records: E, the posterior of every record's chain from its likelihoods and the source's
mixture; M, the mixture from the posteriors, smoothed by the mixture of all sources. All
evidence is pooled, however weak; what chance gives is taken off before: a stretch counts for
what it gains beyond the logarithm of the number of stretches and chains tried in its field.
A field is garbled if its posterior of no chain is below a half, and is restored by the
chain of the highest posterior. Characters lost in decoding (U+FFFD) are evidence by
themselves; what they stood for isn't restored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions.urls import host_of
from brinewell.session import cut_lineage

_LOST = "�"
#: A stretch between marks, with a character beyond ASCII.
_CLAUSE = re.compile(r"[^\n。，！？；]*[^\x00-\x7f\n。，！？；][^\n。，！？；]*")


def _byte_table(codec: str) -> dict[str, int]:
    """Character -> byte of a single-byte code; bytes it leaves undefined stand for themselves, as browsers do."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_CP1252, _CP1251 = _byte_table("cp1252"), _byte_table("cp1251")


def _utf8_pattern(table: dict[str, int]) -> re.Pattern:
    """Stretches of characters whose bytes are UTF-8 sequences of two to four bytes."""
    cls = lambda a, b: "[" + "".join(re.escape(c) for c, x in table.items() if a <= x <= b) + "]"
    tail = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")


_UTF8_1252, _UTF8_1251 = _utf8_pattern(_CP1252), _utf8_pattern(_CP1251)


def _cp1252_class(a: int, b: int) -> str:
    return "".join(re.escape(c) for c, x in _CP1252.items() if a <= x <= b)


#: Stretches that may be GBK: two or more of its characters, or one of its level-1 and level-2 letters.
_GBK_1252 = re.compile(f"(?:[{_cp1252_class(0x81, 0xFE)}][{_cp1252_class(0x80, 0xFE)}@-~]){{2,}}|[{_cp1252_class(0xB0, 0xF7)}][{_cp1252_class(0xA1, 0xFE)}]")


def _undo_bytes(pattern: re.Pattern, table: dict[str, int], codec: str):
    def one(m: re.Match) -> str:
        raw = bytes(table[c] if c in table else ord(c) for c in m.group())
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            return m.group()

    return lambda s: pattern.sub(one, s)


_undo_utf8_1252 = _undo_bytes(_UTF8_1252, _CP1252, "utf-8")
_undo_utf8_1251 = _undo_bytes(_UTF8_1251, _CP1251, "utf-8")
_undo_gbk_1252 = _undo_bytes(_GBK_1252, _CP1252, "gb18030")


def _undo_double(s: str) -> str:
    once = _undo_utf8_1252(s)
    twice = _undo_utf8_1252(once)
    return twice if twice != once else s


def _undo_codec(wrong: str, right: str):
    """For wrong codes of several bytes: encode a clause back and decode it; what was lost stays lost."""

    def one(s: str) -> str:
        raw = bytearray()
        for c in s:
            try:
                raw += c.encode(wrong)
            except UnicodeEncodeError:
                if c == _LOST or "\ue000" <= c <= "\uf8ff":
                    raw += b"\xff"
                else:
                    return s
        return bytes(raw).decode(right, "replace")

    return lambda s: _CLAUSE.sub(lambda m: one(m.group()), s)


#: The chains: what was written -> what it was read as. Each undoes what it can and leaves the rest.
CHAINS = {
    "utf8_as_cp1252": _undo_utf8_1252,
    "utf8_as_cp1252_twice": _undo_double,
    "utf8_as_cp1251": _undo_utf8_1251,
    "gbk_as_cp1252": _undo_gbk_1252,
    "utf8_as_gbk": _undo_codec("gbk", "utf-8"),
    "utf8_as_big5": _undo_codec("big5hkscs", "utf-8"),
    "gbk_as_big5": _undo_codec("big5hkscs", "gb18030"),
    "big5_as_gbk": _undo_codec("gbk", "big5hkscs"),
    "utf8_as_sjis": _undo_codec("cp932", "utf-8"),
    "utf8_as_euckr": _undo_codec("cp949", "utf-8"),
}
_NAMES = list(CHAINS)
#: Replacement characters of UTF-8 read as GBK once more (fixed value): nothing is left to restore.
_TWICE_LOST = ("锟斤", "斤拷")


class Frequencies:
    """Log-probabilities of characters from corpus counts, with add-one smoothing."""

    def __init__(self, counts: dict[int, int]):
        total = sum(counts.values()) + 0x30000
        self.table = np.full(0x110000, math.log(0.5 / total), np.float32)
        for c, n in counts.items():
            self.table[c] = math.log((n + 0.5) / total)
        self.table[:128] = np.maximum(self.table[:128], -7.0)
        # marks of lost or broken text are never good text, however many the corpus has
        for lo, hi in ((0x80, 0xA0), (0xE000, 0xF900), (0xFFFD, 0xFFFE), (0x10000, 0x110000)):
            self.table[lo:hi] = np.minimum(self.table[lo:hi], -16.0)

    def score(self, text: str) -> float:
        """Log-likelihood of the characters beyond ASCII."""
        if text.isascii():
            return 0.0
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return float(self.table[a[a > 127]].sum())


#: Characters that may be a wrong decoding's: C1, Latin, Cyrillic, lost ones and private use, half-width kana.
_ODD = re.compile("[\x80-\x9f\xa0-ɏˆ˜Ѐ-ӿ-�｡-ﾟ]")
_CJK = re.compile("[㐀-鿿豈-﫿㄀-ㄯ︰-﹯]")


def _stretches(text: str) -> list[str]:
    return [m.group() for m in _CLAUSE.finditer(text)]


def evidence(text: str, frequencies: Frequencies, rare: float) -> list[float] | None:
    """Log-likelihood ratio of every chain to no chain, or None if the field shows nothing odd.

    Chains are judged stretch by stretch, a stretch being a clause; one that a chain makes no likelier
    counts as untouched by it. With n stretches and chains tried, one gains log(n) by chance, which is
    taken off each. The last value is the evidence of characters that are lost for good.
    """
    common = _ODD.search(text) is None and _TWICE_LOST[0] not in text
    if common and _rarest(text, frequencies) >= rare + 0.01:
        return None
    parts = _stretches(text)
    toll = math.log(max(1, len(parts)) * len(_NAMES))
    # characters of the wrong code may all be common letters of the right one: look at rarity
    parts = [x for x in parts if (not common and (_ODD.search(x) or _TWICE_LOST[0] in x)) or _mean(x, frequencies) < rare]
    if not parts:
        return None
    gains = [0.0] * (len(_NAMES) + 1)
    for part in parts:
        was = None
        for k, name in enumerate(_NAMES):
            now = CHAINS[name](part)
            if now == part:
                continue
            if was is None:
                was = frequencies.score(part)
            gains[k] += max(0.0, frequencies.score(now) - was - toll)
        lost = part.count(_LOST) + sum(map(part.count, _TWICE_LOST))
        gains[-1] += 12.0 * lost
    return gains if any(gains) else None


_MARKS = np.zeros(0x110000, bool)
_MARKS[[ord(c) for c in "\n。，！？；"]] = True


def _rarest(text: str, frequencies: Frequencies) -> float:
    """The least mean log-probability of a stretch's characters beyond ASCII, of all stretches at once."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = _MARKS[a]
    start = np.r_[0, np.flatnonzero(cut) + 1]
    start = start[start < len(a)]
    beyond = (a > 127) & ~cut
    n = np.add.reduceat(beyond.astype(np.int32), start)
    score = np.add.reduceat(np.where(beyond, frequencies.table[a], 0.0), start)
    return float((score[n > 0] / n[n > 0]).min()) if (n > 0).any() else 0.0


def _mean(part: str, frequencies: Frequencies) -> float:
    a = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = a[a > 127]
    return float(frequencies.table[a].mean()) if len(a) else 0.0


def restore(text: str, chain: str, frequencies: Frequencies) -> str:
    """The text with every stretch undone by the chain where that makes the stretch likelier."""
    if chain not in CHAINS:
        return text
    undo = CHAINS[chain]

    def one(m: re.Match) -> str:
        now = undo(m.group())
        return now if now != m.group() and frequencies.score(now) > frequencies.score(m.group()) else m.group()

    return _CLAUSE.sub(one, text)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0x110000, np.int64)
    for batch in batches:
        for column in batch.columns:
            joined = "".join(x for x in column.to_pylist() if x)
            if joined:
                counts += np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x110000)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["c", "n"])


def character_frequencies(df: DataFrame, columns: list[str]) -> Frequencies:
    """Counts over all rows; at most one entry for each code point comes to the driver."""
    rows = df.select(*columns).mapInArrow(_count_batches, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return Frequencies({r["c"]: r["n"] for r in rows})


def _evidence_batches(shared, rare: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = shared.value
        for batch in batches:
            ids, sources, fields, gains = [], [], [], []
            for i, source, title, content in zip(*(batch.column(c).to_pylist() for c in range(4))):
                for name, text in (("title", title), ("content", content)):
                    if text and not text.isascii():
                        g = evidence(text, frequencies, rare)
                        if g is not None:
                            ids.append(i)
                            sources.append(source)
                            fields.append(name)
                            gains.append(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(fields, pa.string()), pa.array(gains, pa.list_(pa.float64()))],
                names=["id", "source", "field_name", "gains"],
            )

    return run


def garbled_fields(items: DataFrame, id_col: str = "item_id", rounds: int = 4, prior: float = 0.01, weight: float = 200.0, rare: float = -8.5) -> tuple[DataFrame, Frequencies]:
    """((id, source, field_name, chain, posterior) of the garbled fields, the corpus' frequencies).

    ``prior`` is the starting share of every chain, ``weight`` the number of rows that the mixture
    of all sources counts for in one source's. Null, empty and pure ASCII fields are clean. The
    source is the host of the address. ``rare`` is the mean log-probability below which a stretch of
    ordinary letters is examined. A repeated row gives one case.
    """
    rows = items.select(
        F.col(id_col).cast("long").alias("id"), F.lower(host_of(F.coalesce("normalized_url", "url", F.lit("")))).alias("source"), "title", "content"
    ).where("id is not null")
    frequencies = character_frequencies(rows, ["title", "content"])
    shared = items.sparkSession.sparkContext.broadcast(frequencies)
    odd = cut_lineage(rows.mapInArrow(_evidence_batches(shared, rare), "id long, source string, field_name string, gains array<double>"))
    total = cut_lineage(rows.groupBy("source").agg(F.count("*").alias("n")))
    n_chains = len(_NAMES) + 1
    every = range(n_chains)

    mass = None
    for _ in range(rounds):
        # E, in the row: weights of no chain and of each, from the greatest to keep the exponents small
        posterior = _posteriors(odd, _mixture(mass, total, n_chains, prior, weight), n_chains, prior)
        # M: every field without evidence is clean for certain
        mass = cut_lineage(posterior.groupBy("source", "field_name").agg(*[F.sum(F.col("p")[z]).alias(f"m{z}") for z in every]))
    posterior = _posteriors(odd, _mixture(mass, total, n_chains, prior, weight), n_chains, prior)
    names = F.array(*[F.lit(x) for x in [*_NAMES, "lost"]])
    best = F.array_position("p", F.array_max("p")).cast("int")
    found = posterior.where("clean < 0.5").select("id", "source", "field_name", F.element_at(names, best).alias("chain"), (1 - F.col("clean")).alias("posterior"))
    return found.withColumnRenamed("id", id_col).distinct(), frequencies


def _mixture(mass: DataFrame | None, total: DataFrame, n_chains: int, prior: float, weight: float) -> DataFrame | None:
    """(source, field_name, log_prior): logarithms of the shares of no chain and of each, a source's smoothed by all sources'."""
    if mass is None:
        return None
    every = range(n_chains)
    rows = F.broadcast(total.agg(F.sum("n").alias("rows")))  # one row
    overall = mass.groupBy("field_name").agg(*[F.sum(f"m{z}").alias(f"a{z}") for z in every]).crossJoin(rows)  # at most two rows
    joined = mass.join(F.broadcast(overall), "field_name").join(total, "source")
    share = [(F.col(f"m{z}") + weight * (F.col(f"a{z}") + prior) / (F.col("rows") + n_chains * prior + 1)) / (F.col("n") + weight) for z in every]
    none = F.lit(1.0)
    for x in share:
        none = none - x
    return joined.select("source", "field_name", F.transform(F.array(none, *share), lambda x: F.log(F.greatest(x, F.lit(1e-6)))).alias("log_prior"))


def _posteriors(odd: DataFrame, mixture: DataFrame | None, n_chains: int, prior: float) -> DataFrame:
    """odd with ``clean``, the probability of no chain, and ``p``, that of each chain."""
    if mixture is None:
        first = [math.log(1 - n_chains * prior), *[math.log(prior)] * n_chains]
        rows = odd.withColumn("log_prior", F.array(*[F.lit(x) for x in first]))
    else:
        rows = odd.join(mixture, ["source", "field_name"])
    rows = rows.withColumn("w", F.zip_with(F.concat(F.array(F.lit(0.0)), "gains"), "log_prior", lambda g, q: g + q))
    rows = rows.withColumn("w", F.transform("w", lambda x: F.exp(x - F.array_max("w"))))
    rows = rows.withColumn("sum", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    p = F.transform("w", lambda x: x / F.col("sum"))
    return rows.select("id", "source", "field_name", (F.col("w")[0] / F.col("sum")).alias("clean"), F.slice(p, 2, n_chains).alias("p"))


def restored_fields(items: DataFrame, id_col: str = "item_id", **options) -> DataFrame:
    """(id, field_name, chain, posterior, text, whole): garbled fields with their text restored.

    ``whole`` is false if characters are lost. A field whose best chain is 'lost' keeps its text.
    """
    found, frequencies = garbled_fields(items, id_col, **options)
    shared = items.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(t, c, shared.value) for t, c in zip(batch.column("text").to_pylist(), batch.column("chain").to_pylist())]
            whole = [_LOST not in t and _TWICE_LOST[0] not in t for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in (id_col, "field_name", "chain", "posterior")] + [pa.array(texts, pa.string()), pa.array(whole)],
                names=[id_col, "field_name", "chain", "posterior", "text", "whole"],
            )

    texts = items.select(id_col, "title", "content").join(found, id_col).select(
        F.col(id_col).cast("long").alias(id_col), "field_name", "chain", "posterior", F.when(F.col("field_name") == "title", F.col("title")).otherwise(F.col("content")).alias("text")
    ).where("text is not null")
    return texts.mapInArrow(run, f"{id_col} long, field_name string, chain string, posterior double, text string, whole boolean").distinct()
