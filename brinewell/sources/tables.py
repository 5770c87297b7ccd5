"""Declared schemas of the data model and reading of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "pages": "id bigint, url string, normalized_url string, title string, source_site string, category string, publish_time timestamp_ntz, crawl_time timestamp_ntz, content_hash string, snapshot_path string, status_code int, es_doc_id string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "attachments": "id bigint, file_url string, normalized_file_url string, file_name string, file_type string, file_size bigint, local_path string, parent_page_id bigint, parent_title string, parent_url string, source_site string, category string, content_hash string, parse_status string, parse_error string, text_length int, es_doc_id string, crawl_time timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "page_links": "id bigint, from_url string, to_url string, anchor_text string, created_at timestamp_ntz",
    "users": "id bigint, username string, password_hash string, role string, college string, interests array<string>, created_at timestamp_ntz",
    "query_logs": "id bigint, user_id bigint, query_text string, query_type string, filters string, result_count int, created_at timestamp_ntz",
    "click_logs": "id bigint, user_id bigint, query_log_id bigint, target_type string, target_url string, rank_position int, created_at timestamp_ntz",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by its declared schema (columns by name, absent ones null)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def by_key(table: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return table.where(table[column] == value)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational database; give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
