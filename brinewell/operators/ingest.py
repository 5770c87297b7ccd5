"""Incremental maintenance of the page and attachment tables.

A batch of crawl rows is compared with the stored table in one join. Within a batch the
rows of one address follow each other in line order: a row is compared with the row before
it, the first with the stored hash. The result of an upsert is a whole new table version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewell.functions.urls import normalize_url
from brinewell.session import cut_lineage

SKIP_INVALID, INSERT, UPDATE, SKIP = "skip_invalid", "insert", "update", "skip"


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _previous_in_key(rows: DataFrame, order: str, hash_col: str, heavy_rows: int) -> DataFrame:
    """rows (with __key) and __before, the hash of the row before of the same key, and __first.

    A key with more than ``heavy_rows`` rows is cut into ranges of its order: inside a range the row
    before is a window's, at a range's start it is the last row of the range before. So no task holds
    such a key, however large it is.
    """
    h = F.coalesce(hash_col, F.lit(""))
    # rows without a key are spread: they follow none
    group = F.coalesce("__key", F.concat(F.lit("\u0000"), F.col(order).cast("string")))
    heavy = rows.where("__key is not null").groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") > heavy_rows).select("__key")
    heavy = cut_lineage(heavy)

    def plain(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(group).orderBy(order, hash_col)
        return df.withColumn("__before", F.lag(h).over(w)).withColumn("__first", F.row_number().over(w) == 1)

    if heavy.isEmpty():
        return plain(rows)
    light = plain(rows.join(heavy, "__key", "left_anti"))
    large = rows.join(heavy, "__key", "left_semi").repartitionByRange("__key", order).withColumn("__part", F.spark_partition_id())
    large = cut_lineage(large)
    w = Window.partitionBy("__key", "__part").orderBy(order, hash_col)
    inner = large.withColumn("__lag", F.lag(h).over(w)).withColumn("__start", F.row_number().over(w) == 1)
    # one row for each key and range
    ends = large.groupBy("__key", "__part").agg(F.max_by(h, F.struct(order, hash_col)).alias("__last"))
    ends = ends.withColumn("__carry", F.lag("__last").over(Window.partitionBy("__key").orderBy("__part"))).drop("__last")
    joined = inner.join(ends, ["__key", "__part"])
    large = joined.withColumn("__before", F.when(F.col("__start"), F.col("__carry")).otherwise(F.col("__lag"))).withColumn("__first", F.col("__start") & F.col("__carry").isNull())
    return light.unionByName(large.select(*light.columns))


def decide(incoming: DataFrame, stored: DataFrame, key: str = "normalized_url", hash_col: str = "content_hash", order: str = "line_no", force: bool = False, heavy_rows: int = 1_000_000) -> DataFrame:
    """incoming with ``action``: skip_invalid for a blank key, insert for a new key, skip for an unchanged hash, else update.

    Equal order values are taken by hash. ``force`` updates unchanged rows too. A null hash counts as ''.
    """
    known = stored.where(~_blank(F.col(key))).groupBy(F.col(key).alias("__k")).agg(F.max(F.struct(F.coalesce(hash_col, F.lit("")).alias("h"))).alias("__stored"))
    rows = incoming.withColumn("__key", F.when(~_blank(F.col(key)), F.col(key)))
    ordered = _previous_in_key(rows, order, hash_col, heavy_rows)
    # only a key's first row looks at the store, so the join meets every key once
    first = ordered.where("__first").join(known, F.col("__key") == F.col("__k"), "left")
    later = ordered.where("not __first")
    same = lambda previous: (F.coalesce(hash_col, F.lit("")) == previous) & F.lit(not force)
    return first.select(
        *incoming.columns,
        F.when(F.col("__key").isNull(), SKIP_INVALID).when(F.col("__k").isNull(), INSERT).when(same(F.col("__stored.h")), SKIP).otherwise(UPDATE).alias("action"),
    ).unionByName(later.select(*incoming.columns, F.when(same(F.col("__before")), SKIP).otherwise(UPDATE).alias("action")))


def last_write(decided: DataFrame, key: str = "normalized_url", order: str = "line_no", hash_col: str = "content_hash") -> DataFrame:
    """The last row of each key that isn't skipped: an aggregation, combined before the shuffle."""
    whole = F.struct(*[F.col(c) for c in decided.columns])
    return decided.where(F.col("action").isin(INSERT, UPDATE)).groupBy(F.col(key).alias("__g")).agg(F.max_by(whole, F.struct(order, hash_col)).alias("x")).select("x.*")


def assign_ids(new_rows: DataFrame, stored: DataFrame, id_col: str = "id", order: str = "first_line") -> DataFrame:
    """New rows with ids after the stored maximum, in arrival order.

    Rows are range-partitioned by arrival and numbered inside partitions; a partition's offset is the
    count of those before it, so no single task holds all rows. The numbering is stored: made anew, the
    ranges might be cut elsewhere.
    """
    ranged = new_rows.repartitionByRange(order).sortWithinPartitions(order)
    sorted_ = cut_lineage(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    counts = sorted_.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__low"))
    # one row for each partition
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("__max"))
    return (
        sorted_.join(F.broadcast(offsets.drop("__n")), "__p")
        .crossJoin(F.broadcast(top))
        .select((F.col("__max") + F.col("__before") + F.col("__m") - F.col("__low") + 1).alias(id_col), *new_rows.columns)
    )


def upsert(stored: DataFrame, decided: DataFrame, columns: list[str], present: Column | None = None, key: str = "normalized_url", order: str = "line_no", times: tuple[str, ...] = ("publish_time", "crawl_time"), as_of: Column | None = None) -> DataFrame:
    """The table after a batch: (key, columns, action), stored rows that nothing touches with action 'keep'.

    ``present`` is an array of the column names that the incoming row has at all (a JSON object's
    keys): a missing column keeps the stored value, an explicit null replaces it, except for
    ``times``, which keep the stored value. New rows have '' for missing texts; a missing crawl_time
    of a new row is as_of.
    """
    last = last_write(decided, key, order)
    has = (lambda c: F.array_contains(present, c)) if present is not None else (lambda c: F.lit(True))
    new = last.select(F.col(key).alias("__k"), F.col("action"), *[F.struct(F.col(c).alias("v"), has(c).alias("has")).alias(f"__{c}") for c in columns])
    joined = stored.select(key, *columns, F.lit(True).alias("__old")).join(new, F.col(key) == F.col("__k"), "full")

    def merged(c: str) -> Column:
        n, there = F.col(f"__{c}.v"), F.col(f"__{c}.has")
        text = dict(stored.dtypes)[c] == "string"
        fresh = F.coalesce(n, F.lit("")) if text and c not in times else n
        if c == "crawl_time" and as_of is not None:
            fresh = F.coalesce(n, as_of.cast(dict(stored.dtypes)[c]))
        update = F.coalesce(n, F.col(c)) if c in times else F.when(there, n).otherwise(F.col(c))
        return F.when(F.col("__k").isNull(), F.col(c)).when(F.col("__old").isNull(), fresh).otherwise(update).alias(c)

    return joined.select(F.coalesce(key, "__k").alias(key), *[merged(c) for c in columns], F.coalesce("action", F.lit("keep")).alias("action"))


def attachment_key(normalized: Column, file_url: Column) -> Column:
    """normalized_file_url, or file_url where it is blank."""
    return F.coalesce(F.when(~_blank(normalized), normalized), file_url)


def explode_attachments(items: DataFrame, column: str = "attachment_links") -> DataFrame:
    """One row for each attachment link of an item; items without one have a row with a null link."""
    return items.select(*[c for c in items.columns if c != column], F.posexplode_outer(column).alias("pos", "file_url"))


def attachment_text(file_text: Column, content: Column) -> Column:
    """file_text, else content, else ''."""
    return F.coalesce(F.nullif(file_text, F.lit("")), content, F.lit(""))


def first_lines(items: DataFrame, limit: int, order: str = "line_no") -> DataFrame:
    """The first rows of an import in line order, a distributed top-k; 0 takes all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return items.orderBy(order).limit(limit) if limit else items


def attachment_rows(items: DataFrame, order: str = "item_id", column: str = "attachment_links") -> DataFrame:
    """One row for each attachment link, in the order of items and links: line_no, item_id, file_url, normalized_file_url.

    line_no is a struct of the item's order and the link's place.
    """
    links = explode_attachments(items, column).where("file_url is not null")
    return links.select(F.struct(order, "pos").alias("line_no"), *[c for c in items.columns if c != column], "file_url", attachment_key(normalize_url(F.col("file_url")), F.col("file_url")).alias("normalized_file_url"))


def reindexed(decided: DataFrame) -> DataFrame:
    """The rows whose postings must be rebuilt."""
    return decided.where(F.col("action").isin(INSERT, UPDATE))


def action_stats(decided: DataFrame, entity: str = "page") -> DataFrame:
    """(entity, action, cnt)."""
    return decided.groupBy(F.lit(entity).alias("entity"), "action").agg(F.count("*").alias("cnt"))


def dry_run(items: DataFrame, key: str = "normalized_url") -> DataFrame:
    """(action, cnt) without comparing or writing: valid rows would be inserted, invalid ones fail."""
    return items.groupBy(F.when(_blank(F.col(key)), "fail").otherwise("insert").alias("action")).agg(F.count("*").alias("cnt"))


def attachment_dry_run(states: DataFrame) -> DataFrame:
    """One row of counts without fetching or parsing: every new attachment would be downloaded and indexed."""
    new = F.count_if(~F.col("step").isin("ignored", "skip"))
    return states.agg(F.count_if(F.col("step") != "ignored").alias("found"), new.alias("new"), F.count_if(F.col("step") == "skip").alias("skipped"), new.alias("downloaded"), new.alias("indexed"))


def attachment_states(found: DataFrame, stored: DataFrame, extensions: tuple[str, ...] = ("pdf", "docx", "xlsx"), force: bool = False, key: str = "normalized_file_url") -> DataFrame:
    """found with ``step``: what the attachment pipeline does with each row.

    ignored (other ending or scheme), skip (stored as indexed, unless forced), download_failed (no bytes, known row)
    or failed_new (no bytes, unknown row), parse_failed (no text), indexed. found: key, file_url, downloaded, text.
    """
    known = stored.groupBy(F.col(key).alias("__k")).agg(F.max(F.when(F.col("parse_status") == "indexed", 1).otherwise(0)).alias("__indexed"))
    wanted = F.col("file_url").rlike("(?i)^https?://") & F.col("file_url").rlike("(?i)\\.(" + "|".join(extensions) + ")$")
    text = F.coalesce(F.trim("text"), F.lit(""))
    step = (
        F.when(~F.coalesce(wanted, F.lit(False)), "ignored")
        .when((F.col("__indexed") == 1) & F.lit(not force), "skip")
        .when(~F.coalesce("downloaded", F.lit(False)), F.when(F.col("__k").isNotNull(), "download_failed").otherwise("failed_new"))
        .when(text == "", "parse_failed")
        .otherwise("indexed")
    )
    return found.join(known, found[key] == known["__k"], "left").select(*found.columns, step.alias("step"))


def attachment_stats(states: DataFrame) -> DataFrame:
    """One row of counts: found, new, skipped, downloaded, failed downloads, parsed, failed parses, indexed."""
    is_ = lambda *s: F.count_if(F.col("step").isin(*s))
    return states.agg(
        F.count_if(F.col("step") != "ignored").alias("found"),
        is_("download_failed", "failed_new", "parse_failed", "indexed").alias("new"),
        is_("skip").alias("skipped"),
        is_("parse_failed", "indexed").alias("downloaded"),
        is_("download_failed", "failed_new").alias("download_failed"),
        is_("parse_failed").alias("parse_failed"),
        is_("indexed").alias("indexed"),
    )
