"""Continuous versions of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brinewell.operators.html import ITEM_TYPE
from brinewell.operators.ingest import decide
from brinewell.sources.tables import SCHEMAS


def stream_items(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Crawl items from a folder of JSON lines, as files arrive."""
    return spark.readStream.schema(ITEM_TYPE).option("maxFilesPerTrigger", max_files).json(path)


def stream_query_logs(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Query-log rows from a folder of Parquet files, as files arrive."""
    rows = spark.readStream.schema(SCHEMAS["query_logs"]).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp"))


def windowed_counts(logs: DataFrame, window: str = "1 day", late: str = "2 days", by: str | None = "query_type") -> DataFrame:
    """Queries per event-time window (and per ``by``); rows later than the watermark are dropped, repeated ids count once."""
    unique = logs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    keys = [F.window("created_at", window).alias("w")] + ([F.col(by)] if by else [])
    return unique.groupBy(*keys).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), *([by] if by else []), "cnt")


def sliding_hot_queries(logs: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, query_text, cnt) of full-text and phrase queries per sliding window."""
    kept = logs.where(F.col("query_type").isin("fulltext", "phrase")).withWatermark("created_at", late)
    return kept.groupBy(F.window("created_at", window, slide).alias("w"), "query_text").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "query_text", "cnt")


def continuous_ingest(items: DataFrame, load_stored: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Each micro-batch decided against the stored table and handed to ``store`` (decided rows, batch id).

    ``store`` must be idempotent by batch id: a batch is repeated after a failure.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("line_no", F.monotonically_increasing_id())
        store(decide(rows, load_stored()), batch_id)

    return items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
