"""Full-text retrieval: over a stored index, and straight from documents that have none.

``indexed`` and ``indexed_phrase`` read the postings of the query's terms, ``result_page`` the
stored fields of one page of results. ``multi_match`` and ``phrase_match`` scan documents in two
passes: corpus statistics (one row, partial aggregation) and scoring. Token arrays are made in
the row, so neither pass shuffles the corpus; the statistics row is broadcast, a page of results
is a top-k. Filters are applied after the statistics: they don't score.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.text import highlight, query_terms, sanitize, snippet, tokenize_in_order
from brinewell.operators.index import Index, _idf, _tf_part, search_index, search_index_phrase

PAGE_BOOSTS = {"title": 4.0, "anchor_text": 2.0, "content": 1.0}
RELATED_BOOSTS = {"title": 3.0, "content": 1.0, "anchor_text": 2.0}
DOCUMENT_BOOSTS = {"file_name": 3.0, "file_text": 1.0, "parent_title": 2.0}
PHRASE_BOOSTS = {"title": 4.0, "content": 1.0}


def check_page(q: str, page: int, page_size: int) -> None:
    """Arguments of a search request: a query, page from 1, page_size from 1 to 100."""
    if not q:
        raise ValueError("q must not be empty")
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page >= 1 and 1 <= page_size <= 100")


def _fields_of(index: Index, hits: DataFrame, id_col: str, equal: dict[str, str | None]) -> DataFrame:
    """The hits whose stored fields fit exact, non-scoring filters; only the filtered columns are read."""
    wanted = {c: v for c, v in equal.items() if v}
    if wanted:
        hits = hits.join(filtered(index.docs, **wanted).select("doc_id"), "doc_id", "left_semi")
    return hits.withColumnRenamed("doc_id", id_col)


def indexed(index: Index, q: str, boosts: dict[str, float], id_col: str, **equal: str | None) -> DataFrame:
    """(id, score) of the documents that hold a term of the query, of a stored index; none for a query without terms."""
    return _fields_of(index, search_index(index, query_terms(q, in_order=True) or [""], boosts), id_col, equal)


def indexed_phrase(index: Index, q: str, id_col: str, boosts: dict[str, float] | None = None, **equal: str | None) -> DataFrame:
    """(id, score) of the documents with the query's terms in a row in a field, of a stored index."""
    return _fields_of(index, search_index_phrase(index, query_terms(q, in_order=True) or [""], boosts or PHRASE_BOOSTS), id_col, equal)


def result_page(index: Index, hits: DataFrame, id_col: str, q: str, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of hits, best score first, with the stored fields of its at most 100 documents."""
    check_page(q, page, page_size)
    rows = page_of(hits, id_col, page, page_size).select(id_col, "score").collect()  # at most page_size rows
    found = hits.sparkSession.createDataFrame([tuple(r) for r in rows], hits.select(id_col, "score").schema)
    # by their ids the page's documents are found in few row groups
    stored = index.docs.where(F.col("doc_id").isin(*[r[0] for r in rows])) if rows else index.docs.where(F.lit(False))
    return stored.withColumnRenamed("doc_id", id_col).join(F.broadcast(found), id_col)


def _clauses(docs: DataFrame, fields: list[str], terms: list[str], count: Callable[[Column, Column, list[str]], list[Column]]) -> tuple[DataFrame, DataFrame]:
    """Documents that hold a term, with dl and per-clause tf of each field, and the one-row statistics (n, avg, df) of all.

    ``count`` gets a field's tokens and those of them that are query terms.
    """
    # generators keep the optimizer from copying the tokenization into every use of its result
    tokens = docs.select("*", F.explode(F.array(F.struct(*[tokenize_in_order(F.col(f)).alias(f) for f in fields]))).alias("__t"))
    held = F.struct(*[F.filter(F.col(f"__t.{f}"), lambda x: x.isin(*terms)).alias(f) for f in fields])
    with_tokens = tokens.select("*", F.explode(F.array(held)).alias("__h"))
    some = F.lit(False)
    for f in fields:
        some = some | (F.size(f"__h.{f}") > 0)
    counted = with_tokens.where(some).select(
        *docs.columns,
        *[F.size(f"__t.{f}").cast("double").alias(f"__dl_{f}") for f in fields],
        *[c.cast("double").alias(f"__tf_{f}_{i}") for f in fields for i, c in enumerate(count(F.col(f"__t.{f}"), F.col(f"__h.{f}"), terms))],
    )
    singles = with_tokens.select(
        *[F.size(f"__t.{f}").cast("double").alias(f"__dl_{f}") for f in fields],
        *[F.array_contains(f"__h.{f}", t).alias(f"__has_{f}_{i}") for f in fields for i, t in enumerate(terms)],
    )
    stats = singles.agg(
        *[F.count_if(F.col(f"__dl_{f}") > 0).cast("double").alias(f"__n_{f}") for f in fields],
        *[(F.sum(f"__dl_{f}") / F.count_if(F.col(f"__dl_{f}") > 0)).alias(f"__avg_{f}") for f in fields],
        *[F.count_if(F.col(f"__has_{f}_{i}")).cast("double").alias(f"__df_{f}_{i}") for f in fields for i in range(len(terms))],
    )
    return counted, stats


def _count(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(term)))


def multi_match(docs: DataFrame, q: str, boosts: dict[str, float]) -> DataFrame:
    """The documents that hold a term of the query in a field, with ``score``: their best field's boosted BM25."""
    terms, fields = list(dict.fromkeys(query_terms(q, in_order=True))), list(boosts)
    if not terms:
        return docs.where(F.lit(False)).withColumn("score", F.lit(0.0))
    hits, stats = _clauses(docs, fields, terms, lambda _, held, ts: [_count(held, t) for t in ts])
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    per_field = []
    for f in fields:
        s = F.lit(0.0)
        for i in range(len(terms)):
            s = s + F.when(F.col(f"__tf_{f}_{i}") > 0, _idf(F.col(f"__n_{f}"), F.col(f"__df_{f}_{i}")) * _tf_part(F.col(f"__tf_{f}_{i}"), F.col(f"__dl_{f}"), F.col(f"__avg_{f}"))).otherwise(0.0)
        per_field.append(F.lit(boosts[f]) * s)
    score = F.greatest(*per_field) if len(per_field) > 1 else per_field[0]
    return joined.select(*docs.columns, score.alias("score"))


def _phrase_count(tokens: Column, held: Column, terms: list[str]) -> Column:
    """Places where the terms stand in a row; looked for only where every term is held."""
    q, m = F.array(*[F.lit(t) for t in terms]), len(terms)
    every = F.size(tokens) >= m
    for t in dict.fromkeys(terms):
        every = every & F.array_contains(held, t)
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - m, F.lit(0)))
    return F.when(every, F.size(F.filter(starts, lambda i: (F.get(tokens, i) == F.lit(terms[0])) & (F.slice(tokens, i + 1, m) == q)))).otherwise(0)


def phrase_match(docs: DataFrame, q: str, boosts: dict[str, float] | None = None) -> DataFrame:
    """Documents with the query's terms in a row in a field; ``score`` sums the matching fields' boosted BM25."""
    boosts = boosts or PHRASE_BOOSTS
    terms, fields = query_terms(q, in_order=True), list(boosts)
    if not terms:
        return docs.where(F.lit(False)).withColumn("score", F.lit(0.0))
    hits, stats = _clauses(docs, fields, terms, lambda tokens, held, ts: [_phrase_count(tokens, held, ts)])
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    score, any_hit = F.lit(0.0), F.lit(False)
    for f in fields:
        idf = F.lit(0.0)
        for i in range(len(terms)):
            idf = idf + _idf(F.col(f"__n_{f}"), F.col(f"__df_{f}_{i}"))
        any_hit = any_hit | (F.col(f"__tf_{f}_0") > 0)
        score = score + F.when(F.col(f"__tf_{f}_0") > 0, F.lit(boosts[f]) * idf * _tf_part(F.col(f"__tf_{f}_0"), F.col(f"__dl_{f}"), F.col(f"__avg_{f}"))).otherwise(0.0)
    return joined.where(any_hit).select(*docs.columns, score.alias("score"))


def like_pattern(pattern: str) -> str:
    """A wildcard pattern (* any run, ? one character) as a LIKE pattern with backslash escapes."""
    out = re.sub(r"([\\%_])", r"\\\1", pattern)
    return out.replace("*", "%").replace("?", "_")


def wildcard_match(docs: DataFrame, pattern: str, field: str = "title") -> DataFrame:
    """Documents whose whole address (field 'url') or any one title term (every other field name) fits; ``score`` is 1."""
    p = like_pattern(pattern)
    if field == "url":
        hit = F.col("url").like(p)
    else:
        hit = F.exists(tokenize_in_order(F.col("title")), lambda t: t.like(p.lower()))
    return docs.where(hit).withColumn("score", F.lit(1.0))


def java_pattern(pattern: str) -> str | None:
    """A Python regular expression in Java's spelling; None if it is none, or one that Java has no spelling for.

    Named groups and references back to them are rewritten, underscores of their names left out. Whether
    Java takes the rest is told by compiling it, on the driver.
    """
    try:
        names = re.compile(pattern).groupindex
    except re.error:
        return None
    java_name = {n: f"g{i}{re.sub('[^A-Za-z0-9]', '', n)}" for n, i in names.items()}
    out, at, in_class = [], 0, False
    while at < len(pattern):
        m = re.compile(r"\\(?s:.)|\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?\((\w+)\)|[\[\]&]").match(pattern, at)
        piece = m.group() if m else pattern[at]
        at += len(piece)
        if m and in_class and piece[0] == "(":  # an ordinary character there
            at -= len(piece) - 1
            piece = "("
        elif m and m.group(1):
            piece = f"(?<{java_name[m.group(1)]}>"
        elif m and m.group(2):
            piece = f"\\k<{java_name[m.group(2)]}>"
        elif m and m.group(3):
            return None  # a conditional
        elif piece == "[":
            # Java nests classes, Python doesn't; a class may begin with a bracket
            piece = "\\[" if in_class else "["
            if not in_class:
                in_class = True
                lead = re.compile(r"\^?\]?").match(pattern, at).group()
                piece += lead.replace("]", "\\]")
                at += len(lead)
        elif piece == "]":
            piece, in_class = ("]", False) if in_class else ("\\]", False)
        elif piece == "&" and in_class:
            piece = "\\&"
        elif piece == "\\Z":
            piece = "\\z"
        out.append(piece)
    # \\w, \\d and \\s of Unicode, and \\n as the only line end, as in Python
    return "(?dU)" + "".join(out)


def regex_filter(docs: DataFrame, pattern: str, field: str = "title") -> DataFrame:
    """Rows whose field holds a match; a pattern that is no regular expression, in Python or in Java, is searched as text."""
    java = java_pattern(pattern)
    if java is not None:
        jvm = docs.sparkSession.sparkContext._jvm
        try:
            jvm.java.util.regex.Pattern.compile(java)
        except Exception:  # noqa: BLE001 - any refusal of Java's
            java = None
    if java is None:
        java = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return docs.where(F.col(field).rlike(java))


def filtered(docs: DataFrame, **equal: str | None) -> DataFrame:
    """Exact, non-scoring filters; empty and null values filter nothing."""
    for column, value in equal.items():
        if value:
            docs = docs.where(F.col(column) == value)
    return docs


def page_of(hits: DataFrame, id_col: str, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of the hits, best score first, equal scores by id: a distributed top-k."""
    return hits.orderBy(F.desc("score"), F.col(id_col)).offset((page - 1) * page_size).limit(page_size)


def total_hits(hits: DataFrame, cap: int | None = 10_000) -> DataFrame:
    """One row: the number of hits, at most ``cap``."""
    n = F.count("*")
    return hits.agg((F.least(n, F.lit(cap)) if cap else n).alias("total"))


def get_many(docs: DataFrame, candidates: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Candidates with columns of their documents, '' where a document or value is missing."""
    found = docs.select(id_col, *columns)
    return candidates.join(found, id_col, "left").select(*candidates.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def page_result(hits: DataFrame, q: str) -> DataFrame:
    """Result rows of pages: highlighted title, snippet, address, site, category, score; the text itself is left out."""
    terms = query_terms(q, in_order=True)
    return hits.select(
        "page_id", sanitize(highlight(F.col("title"), terms)).alias("title"), "url", sanitize(snippet(F.col("content"), terms)).alias("snippet"), "source_site", "category", "score"
    )


def document_result(hits: DataFrame, q: str) -> DataFrame:
    """Result rows of attachments: highlighted file name, snippet of the text, place and kind, score."""
    terms = query_terms(q, in_order=True)
    return hits.select(
        "attachment_id", sanitize(highlight(F.col("file_name"), terms)).alias("file_name"), "file_url", "file_type", sanitize(snippet(F.col("file_text"), terms)).alias("snippet"), "parent_page_id", "parent_title", "score"
    )
