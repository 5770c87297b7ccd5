"""The training-data queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.llm import boilerplate, byte_bpe, contamination, heavy_hitters, mojibake, near_duplicates, residue, site_lines, splitting
from brinewell.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(load(spark, d, "page_items"), "item_id", "content", 0.7)
    return pairs.select(F.col("id_a").alias("item_id_a"), F.col("id_b").alias("item_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(load(spark, d, "page_items"), "item_id", "content", 0.7)
    return groups.withColumnRenamed("id", "item_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    logs = load(spark, d, "query_logs")
    found = heavy_hitters.frequent_values_exact(logs, heavy_hitters.normal_query(F.col("query_text")), 0.002, 5)
    return found.select(F.col("value").alias("query_text"))


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    logs = load(spark, d, "query_logs")
    found = heavy_hitters.frequent_values_exact(logs, heavy_hitters.normal_query(F.col("query_text")), 0.002, 5)
    return found.select(F.col("value").alias("query_text"), "count", ((F.col("low") <= F.col("count")) & (F.col("count") <= F.col("high"))).alias("held"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """The one pass's values with the intervals that hold their counts, no second look at the table."""
    logs = load(spark, d, "query_logs")
    return heavy_hitters.frequent_values(logs, heavy_hitters.normal_query(F.col("query_text")), 0.002, 5).select(F.col("value").alias("query_text"), "low", "high", "rows")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(load(spark, d, "page_items"))


def p3_articles(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.articles(load(spark, d, "page_items"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(load(spark, d, "page_items"))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(load(spark, d, "page_items").select("item_id", "url", "normalized_url", "title", "content")).select("item_id", "title", "content")


def p4_arms(spark: SparkSession, d: str) -> DataFrame:
    """What problem 4's fields are found by."""
    found = residue.residue_by_arm(load(spark, d, "page_items"))
    return found.groupBy("field_name", "arm").agg(F.count("*").alias("cnt"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_fields(load(spark, d, "page_items"))[0].select("item_id", "field_name").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_fields(load(spark, d, "page_items")).select("item_id", "field_name", "chain", "text", "whole")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.frequent_site_lines(load(spark, d, "page_items"), load(spark, d, "pages")).select("source_site", "line")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_site_lines(load(spark, d, "page_items"), load(spark, d, "pages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.encode_texts(load(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_long_texts(load(spark, d, "documents"), "doc_id", "text", 2048, 64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_intervals, p2_summary, p3_found, p3_articles, p4_found, p4_cleaned, p4_arms, p5_found, p5_restored, p6_found, p6_cleaned, p8_ids, p9_found, p10_pieces)
}
