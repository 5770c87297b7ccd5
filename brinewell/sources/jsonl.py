"""JSON lines: crawl items in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewell.operators.html import ITEM_TYPE


def read_items(spark: SparkSession, path: str, schema: T.StructType = ITEM_TYPE) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of JSON lines. Blank lines vanish, malformed ones go to rejects (line_no, value).

    items have ``line_no``, which grows with file name and position, and ``present``, the keys that
    a line has at all: a missing key isn't an explicit null.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    lines = lines.where(F.trim("value") != "")
    rows = lines.select("value", F.concat_ws(":", F.col("file"), F.lpad(F.col("block").cast("string"), 15, "0"), F.lpad(F.col("seq").cast("string"), 20, "0")).alias("line_no"), F.json_object_keys("value").alias("present"))
    good = rows.where("present is not null").withColumn("item", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return good.select("line_no", "present", "item.*"), rows.where("present is null").select("line_no", "value")


def write_items(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, UTF-8, times as ISO texts, null fields kept."""
    iso = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in items.dtypes]
    items.select(*iso).write.mode(mode).option("ignoreNullFields", "false").json(path)
