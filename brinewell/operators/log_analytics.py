"""Query-log analytics. Every operator is one partial aggregation and one small final one; ``as_of`` is explicit."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.dates import day

#: Kinds of queries that reports list (fixed values).
QUERY_TYPES = ("fulltext", "phrase", "wildcard", "document")


def _between(name: str, low: int, high: int, value: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def since(ts: Column, as_of: datetime, **delta: float) -> Column:
    """The time is at or after as_of minus the delta."""
    return ts >= F.lit((as_of - timedelta(**delta)).isoformat(sep=" ")).cast("timestamp_ntz")


def log_stats(query_logs: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """One row: all queries, those of the UTC day of as_of, users, and queries of each known type."""
    midnight = F.lit(as_of.replace(hour=0, minute=0, second=0, microsecond=0).isoformat(sep=" ")).cast("timestamp_ntz")
    counts = query_logs.agg(
        F.count("*").alias("total_queries"),
        F.count_if(F.col("created_at") >= midnight).alias("today_queries"),
        *[F.count_if(F.col("query_type") == t).alias(f"{t}_queries") for t in QUERY_TYPES],
    )
    return counts.crossJoin(users.agg(F.count("*").alias("total_users")))  # one row each


def hot_queries(query_logs: DataFrame, limit: int = 10, as_of: datetime | None = None, hours: float | None = None, types: tuple[str, ...] = ("fulltext", "phrase"), ci: bool = False) -> DataFrame:
    """(query_text, cnt): most frequent queries of the given types, of the last hours if given; ties by text."""
    _between("limit", 1, 100, limit)
    logs = query_logs.where(F.col("query_type").isin(*types))
    if hours is not None:
        logs = logs.where(since(F.col("created_at"), as_of, hours=hours))
    text = F.lower("query_text") if ci else F.col("query_text")
    return logs.groupBy(text.alias("query_text")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "query_text").limit(limit)


def suggest(query_logs: DataFrame, prefix: str, limit: int = 10, wildcards: bool = False) -> DataFrame:
    """(query_text, cnt) of the most frequent queries that start with the trimmed prefix; none for a blank one.

    With ``wildcards`` the prefix's % and _ match as in LIKE.
    """
    p = prefix.strip()
    logs = query_logs.where(F.lit(False)) if not p else query_logs.where(F.col("query_text").like(p + "%") if wildcards else F.col("query_text").startswith(p))
    return logs.groupBy("query_text").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "query_text").limit(limit)


def recent_queries(query_logs: DataFrame, limit: int = 20) -> DataFrame:
    """The latest queries; equal times by id, latest first."""
    _between("limit", 1, 100, limit)
    return query_logs.orderBy(F.desc("created_at"), F.desc("id")).select("id", "query_text", "query_type", "result_count", "created_at").limit(limit)


def recent_with_total(query_logs: DataFrame, limit: int = 20) -> DataFrame:
    """``recent_queries`` with ``total``, the number of all queries."""
    return recent_queries(query_logs, limit).crossJoin(F.broadcast(query_logs.agg(F.count("*").alias("total"))))  # one row


def type_distribution(query_logs: DataFrame) -> DataFrame:
    """(query_type, cnt, pct) of the known types, zero-filled; pct is rounded, 0 without queries. Others vanish."""
    counts = query_logs.agg(*[F.count_if(F.col("query_type") == t).alias(t) for t in QUERY_TYPES])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("query_type"), F.col(t).alias("cnt")) for t in QUERY_TYPES])).alias("x"), sum(F.col(t) for t in QUERY_TYPES).alias("total"))
    pct = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * F.col("x.cnt") / F.col("total")))
    return rows.select("x.query_type", "x.cnt", pct.alias("pct"))


def daily_trend(query_logs: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """(d, cnt, bar): queries per day since as_of minus the days, not aligned to midnight; bar is the rounded
    percentage of the largest day. Days without queries are absent."""
    _between("days", 1, 90, days)
    per_day = query_logs.where(since(F.col("created_at"), as_of, days=days)).groupBy(day(F.col("created_at")).alias("d")).agg(F.count("*").alias("cnt"))
    most = per_day.agg(F.greatest(F.max("cnt"), F.lit(1)).alias("most"))
    return per_day.crossJoin(F.broadcast(most)).select("d", "cnt", F.round(F.lit(100.0) * F.col("cnt") / F.col("most")).alias("bar")).orderBy("d")


def filter_usage(query_logs: DataFrame) -> DataFrame:
    """(filter_key, filter_value, cnt) of the filters column; broken JSON and non-objects count under a null key."""
    kv = F.from_json("filters", "map<string,string>", {"mode": "PERMISSIVE"})
    rows = query_logs.where("filters is not null").select(F.explode_outer(kv).alias("filter_key", "filter_value"))
    return rows.groupBy("filter_key", "filter_value").agg(F.count("*").alias("cnt"))


def click_through(query_logs: DataFrame, click_logs: DataFrame) -> DataFrame:
    """(query_type, queries, clicked, clicks): distinct logged queries, those clicked, and clicks, repeated rows once."""
    logs = query_logs.groupBy("id").agg(F.min("query_type").alias("query_type"))
    clicks = click_logs.where("query_log_id is not null").groupBy("query_log_id").agg(F.count_distinct("id").alias("n"))
    joined = logs.join(clicks, logs["id"] == clicks["query_log_id"], "left")
    return joined.groupBy("query_type").agg(F.count("*").alias("queries"), F.count("n").alias("clicked"), F.coalesce(F.sum("n"), F.lit(0)).alias("clicks"))


def query_log_row(spark: SparkSession, q: str, query_type: str, as_of: datetime, result_count: int, user_id: int | None = None, **filters: str | None) -> DataFrame:
    """The log row of one search. ``filters`` is a JSON object of the filters that were used, null without any."""
    used = {k: v for k, v in filters.items() if v}
    row = (user_id, q, query_type, json.dumps(used, ensure_ascii=False) if used else None, result_count, as_of.isoformat(sep=" "))
    out = spark.createDataFrame([row], "user_id long, query_text string, query_type string, filters string, result_count int, created_at string")
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def append_query_log(query_logs_path: str, rows: DataFrame, required: bool = True) -> bool:
    """Append log rows to a Parquet table; where the log isn't ``required`` a failure is reported, not raised: the search goes on."""
    try:
        rows.write.mode("append").parquet(query_logs_path)
    except Exception:  # noqa: BLE001 - a search doesn't fail for its log
        if required:
            raise
        return False
    return True
