"""Views of the stored tables that the queries share."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.text import join_anchors
from brinewell.operators.index import Index, build_index, index_exists, read_index, write_index
from brinewell.operators.search import DOCUMENT_BOOSTS, PAGE_BOOSTS
from brinewell.session import cut_lineage, load, shared_dir

#: The time that stands for now.
AS_OF = datetime(2025, 12, 31, 12, 0, 0)
#: Example keyword weights by role; they are data, the operators take any.
KEYWORDS = [
    ("graduate", "评审", 1.5),
    ("graduate", "数据", 1.0),
    ("undergraduate", "课程", 1.0),
    ("undergraduate", "奖学金", 1.5),
    ("teacher", "教学", 1.2),
    ("job_seeker", "招聘", 2.0),
]


def keyword_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "role string, keyword string, weight double")


def latest_items(spark: SparkSession, d: str) -> DataFrame:
    """The latest crawl item of each address: normalized_url, content, anchor_text, attachment_links.

    The greatest id wins, by an aggregation rather than a window: partial results are combined before the shuffle.
    """
    items = load(spark, d, "page_items").where("normalized_url is not null and normalized_url <> ''")
    packed = F.struct("item_id", F.coalesce("content", F.lit("")).alias("content"), join_anchors(F.col("anchor_texts")).alias("anchor_text"))
    return items.groupBy("normalized_url").agg(F.max_by(packed, "item_id").alias("x")).select("normalized_url", "x.content", "x.anchor_text")


def page_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the page index: registered pages with the text of their latest item, '' without one."""
    pages = load(spark, d, "pages").select(F.col("id").alias("page_id"), "url", "normalized_url", F.coalesce("title", F.lit("")).alias("title"), "source_site", "category")
    # texts are never broadcast: the latest items already lie by address, only the register moves
    joined = pages.join(latest_items(spark, d).hint("shuffle_hash"), "normalized_url", "left")
    return joined.select("page_id", "url", "title", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("anchor_text", F.lit("")).alias("anchor_text"), "source_site", "category")


def attachment_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the attachment index: the text comes from the documents table by id."""
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("file_text"))
    a = load(spark, d, "attachments").select("id", "file_url", "file_name", "file_type", "parent_page_id", "parent_title", "source_site", "category", "parse_status")
    return a.join(texts.hint("shuffle_hash"), "id", "left").select(
        F.col("id").alias("attachment_id"), "file_url", F.coalesce("file_name", F.lit("")).alias("file_name"), "file_type", F.coalesce("file_text", F.lit("")).alias("file_text"),
        "parent_page_id", F.coalesce("parent_title", F.lit("")).alias("parent_title"), "source_site", "category", "parse_status",
    )


def _stored(spark: SparkSession, d: str, kind: str, docs: Callable[[], tuple[DataFrame, str, list[str]]]) -> Index:
    """The index of a data folder, built by the first query of a session that needs it and read by all."""
    whole = f"{spark.sparkContext.applicationId} {os.path.abspath(d)}"
    path = f"{shared_dir(spark).rstrip('/')}/index-{hashlib.sha256(whole.encode()).hexdigest()[:16]}/{kind}"
    if not index_exists(spark, path):
        frame, id_col, fields = docs()
        frame = cut_lineage(frame)  # read for the postings and for the stored fields
        write_index(build_index(frame, id_col, fields, [c for c in frame.columns if c != id_col]), path, "overwrite")
    return read_index(spark, path)


def page_index(spark: SparkSession, d: str) -> Index:
    return _stored(spark, d, "pages", lambda: (page_docs(spark, d), "page_id", list(PAGE_BOOSTS)))


def document_index(spark: SparkSession, d: str) -> Index:
    return _stored(spark, d, "documents", lambda: (attachment_docs(spark, d), "attachment_id", list(DOCUMENT_BOOSTS)))


def recrawl(spark: SparkSession, d: str) -> DataFrame:
    """The crawl items as one incoming batch in id order."""
    return load(spark, d, "page_items").select(F.col("item_id").alias("line_no"), "normalized_url", "url", "title", "content_hash", "category")


#: An example crawl configuration: site, category, domains, start addresses, page cap.
SITES = [
    ("library", "lib", ["lib.yunheng.example"], ["https://lib.yunheng.example/", "https://lib.yunheng.example/notice/"], 500),
    ("news", "news", ["news.yunheng.example", "media.yunheng.example"], ["https://news.yunheng.example/"], 1500),
    ("whole", "other", ["yunheng.example"], ["https://www.yunheng.example/"], 8000),
]


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, "site string, category string, domains array<string>, start_urls array<string>, max_pages int")
