"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are not terms (fixed values).
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一",
    "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着",
    "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "那", "些",
    "为", "所以", "因为", "但是", "然而", "可以", "这个", "那个", "什么",
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for",
    "on", "with", "at", "by", "from", "as", "into", "through", "during",
    "before", "after", "above", "below", "between", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "just", "about", "and", "but", "or", "if", "while",
)

_CJK = "[\\x{4e00}-\\x{9fff}]"
#: A character with another after it becomes the pair and a space; the last of a run of two or more vanishes.
_STEP = f"({_CJK})(?=({_CJK}))|(?<={_CJK}){_CJK}(?!{_CJK})"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _kept(tokens: Column) -> Column:
    # a list this long is looked up in a hash set
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))


def _stepped(text: Column) -> Column:
    """The text in ASCII lower case, Chinese runs as space-separated steps of two characters."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _STEP, "$1$2 ")


def tokenize(text: Column) -> Column:
    """Terms of a text: character pairs of Chinese runs, then ASCII words in lower case; stop words left out.

    Null and blank texts have an empty array.
    """
    t = _stepped(text)
    return _kept(F.concat(F.regexp_extract_all(t, F.lit(f"({_CJK}+)"), 1), F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), 1)))


def tokenize_in_order(text: Column) -> Column:
    """The same terms in the order of the text, as phrases need them."""
    return _kept(F.regexp_extract_all(_stepped(text), F.lit(f"({_CJK}+|[a-z0-9]+)"), 1))


def query_terms(text: str, in_order: bool = False) -> list[str]:
    """``tokenize`` of one query string, on the driver."""
    pairs = lambda run: [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    if in_order:
        parts = re.findall(r"[一-鿿]+|[a-zA-Z0-9]+", text)
        out = [t for p in parts for t in ([p.lower()] if p[0].isascii() else pairs(p))]
    else:
        out = [t for run in re.findall(r"[一-鿿]+", text) for t in pairs(run)]
        out += [w.lower() for w in re.findall(r"[a-zA-Z0-9]+", text)]
    return [t for t in out if t not in STOP_WORDS]


def clean_text(text: Column) -> Column:
    """White-space runs of each line become one space, lines are trimmed, empty ones dropped."""
    lines = F.transform(F.split(text, "\r\n|\r|\n", -1), lambda x: F.trim(F.regexp_replace(x, "(?U)\\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def join_anchors(anchors: Column) -> Column:
    """Anchor texts joined by a space; '' for null or none."""
    return F.array_join(F.coalesce(anchors, F.array().cast("array<string>")), " ")


def preview(text: Column, chars: int = 2000) -> Column:
    """The first characters of a text."""
    return F.substring(text, 1, chars)


def quoted(terms: list[str]) -> str:
    """A regular expression of literal alternatives, longest first."""
    return "|".join(f"\\Q{t}\\E" for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def highlight(text: Column, terms: list[str]) -> Column:
    """Every term, in any case, in <em> tags; the whole field comes back."""
    return F.regexp_replace(text, f"(?i)({quoted(terms)})", "<em>$1</em>") if terms else text


def snippet(text: Column, terms: list[str], size: int = 150, most: int = 3, no_match: int = 100) -> Column:
    """Up to ``most`` fragments of ``size`` characters with the most hits, highlighted, joined by ' ... '.

    Without a hit the first ``no_match`` characters. Fragments are fixed windows, equal counts in
    text order.
    """
    t = F.coalesce(text, F.lit(""))
    if not terms:
        return F.substring(t, 1, no_match)
    pattern = f"(?i)({quoted(terms)})"
    starts = F.sequence(F.lit(0), F.greatest((F.length(t) - 1) / size, F.lit(0)).cast("int"))
    parts = F.transform(starts, lambda i: F.struct((-F.regexp_count(F.substring(t, i * size + 1, F.lit(size)), F.lit(pattern))).alias("hits"), i.alias("i"), F.substring(t, i * size + 1, F.lit(size)).alias("part")))
    best = F.slice(F.array_sort(F.filter(parts, lambda p: p["hits"] < 0)), 1, most)
    shown = F.array_join(F.transform(best, lambda p: F.regexp_replace(p["part"], pattern, "<em>$1</em>")), " ... ")
    return F.when(F.size(best) > 0, shown).otherwise(F.substring(t, 1, no_match))


def sanitize(text: Column) -> Column:
    """Every tag but <em> and </em> removed."""
    return F.regexp_replace(text, "<(?!/?em\\b)[^>]*>", "")


def min_max(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), 0 where all are equal."""
    return F.coalesce((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))


def json_list(c: Column) -> Column:
    """A JSON array of texts as an array; anything else, null and broken JSON are an empty one."""
    read = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.when(F.trim(c).startswith("["), read), F.array().cast("array<string>"))


def first_occurrences(items: Column) -> Column:
    """An array without later repetitions, in order; empty for null."""
    return F.array_distinct(F.coalesce(items, F.array().cast("array<string>")))
