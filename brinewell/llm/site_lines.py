"""Lines repeated across the documents of one site (problem 6).

Lines are normalised and hashed on the JVM; only 64-bit hashes of (site, line) and of
the address are shuffled for the counts. The text of a frequent line is fetched in a
second pass over the few hashes that passed the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.session import cut_lineage

_BLANK = "[ \\t\\u00a0\\u3000]+"


def normal_lines(text: Column) -> Column:
    """Array of the normalised non-empty lines: blanks run to one space, trimmed, digit runs to '#'."""
    t = F.regexp_replace(F.regexp_replace(text, _BLANK, " "), "[0-9]+", "#")
    return F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, "^[ \\r\\f\\x0B]+|[ \\r\\f\\x0B]+$", "")), lambda x: x != "")


def _sited(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(item_id, url, content) with the register's site; one row for each item whose address is registered."""
    site = pages.select(F.col("normalized_url").alias("url"), F.col("source_site").alias("site")).where(
        F.col("url").isNotNull() & F.col("site").isNotNull() & (F.col("site") != "")
    )
    return items.select(F.col("item_id"), F.col("normalized_url").alias("url"), F.col("content")).join(site, "url")


def _frequent(items: DataFrame, pages: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(site, h, docs, site_docs) of the frequent lines, h the hash of site and line."""
    hashed = items.select(
        F.col("normalized_url").alias("url"),
        F.array_distinct(F.transform(normal_lines(F.coalesce("content", F.lit(""))), lambda x: F.xxhash64(x))).alias("hs"),
    )
    site = pages.select(F.col("normalized_url").alias("url"), F.col("source_site").alias("site")).where("url is not null and site is not null and site <> ''")
    rows = hashed.join(site, "url").select(F.xxhash64("url").alias("u"), "site", "hs")
    rows = cut_lineage(rows)
    per_site = rows.select("site", "u").distinct().groupBy("site").agg(F.count("*").alias("site_docs"))
    per_line = rows.select("site", "u", F.explode("hs").alias("h")).distinct().groupBy("site", "h").agg(F.count("*").alias("docs"))
    return (
        per_line.where(F.col("docs") >= min_docs)
        .join(per_site, "site")
        .where(F.col("docs") >= F.lit(min_share) * F.col("site_docs"))
        .select("site", "h", "docs", "site_docs")
    )


def frequent_site_lines(items: DataFrame, pages: DataFrame, min_docs: int = 5, min_share: float = 0.03) -> DataFrame:
    """(source_site, line, docs, site_docs): lines on at least min_docs and min_share of a site's addresses.

    Items are joined to the register on normalized_url; null or empty sites and addresses that
    aren't registered take no part. Addresses count once, however often they were visited. Null
    and empty contents count as addresses of the site but have no lines.
    """
    frequent = cut_lineage(_frequent(items, pages, min_docs, min_share))
    lines = _sited(items, pages).select("site", F.explode(F.array_distinct(normal_lines(F.col("content")))).alias("line"))
    lines = lines.withColumn("h", F.xxhash64("line"))
    return (
        lines.join(frequent, ["site", "h"])
        .groupBy("site", "h", "line")
        .agg(F.first("docs").alias("docs"), F.first("site_docs").alias("site_docs"))
        .select(F.col("site").alias("source_site"), "line", "docs", "site_docs")
    )


def without_site_lines(items: DataFrame, pages: DataFrame, min_docs: int = 5, min_share: float = 0.03) -> DataFrame:
    """(item_id, content, removed): every item, its content without the frequent lines of its site.

    Kept lines stay as stored and in order. Items of no registered site come back unchanged;
    null contents stay null; a repeated item_id gives a row for each repetition.
    """
    frequent = cut_lineage(_frequent(items, pages, min_docs, min_share).select("site", "h"))
    hashes = F.array_distinct(F.transform(normal_lines(F.col("content")), lambda x: F.xxhash64(x)))
    # hashes move to the frequent lines, by site and line, so a large site is many keys; the texts move once, by item
    lines = _sited(items, pages).select("item_id", "url", "site", F.explode(hashes).alias("h"))
    bad = lines.join(frequent, ["site", "h"]).groupBy("item_id", "url").agg(F.collect_set("h").alias("bad"))
    rows = items.select("item_id", F.col("normalized_url").alias("url"), "content")
    rows = rows.join(bad.select(F.col("item_id").alias("__i"), F.col("url").alias("__u"), "bad"), F.col("item_id").eqNullSafe(F.col("__i")) & (F.col("url") == F.col("__u")), "left")
    raw = F.split("content", "\n", -1)
    norm = F.transform(
        F.split(F.regexp_replace(F.regexp_replace("content", _BLANK, " "), "[0-9]+", "#"), "\n", -1),
        lambda x: F.regexp_replace(x, "^[ \\r\\f\\x0B]+|[ \\r\\f\\x0B]+$", ""),
    )
    keep = F.filter(
        F.zip_with(raw, norm, lambda r, n: F.struct(r.alias("r"), ((n == "") | ~F.array_contains("bad", F.xxhash64(n))).alias("keep"))),
        lambda s: s["keep"],
    )
    kept = F.array_join(F.transform(keep, lambda s: s["r"]), "\n")
    return rows.select(
        "item_id",
        F.when(F.col("bad").isNull(), F.col("content")).otherwise(kept).alias("content"),
        F.when(F.col("bad").isNull(), F.lit(0)).otherwise(F.size(raw) - F.size(keep)).alias("removed"),
    )
