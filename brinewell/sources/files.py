"""Files: attachment texts (DOCX, XLSX by the standard library), page snapshots."""

from __future__ import annotations

import io
import os
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.urls import safe_path, snapshot_path
from brinewell.session import cut_lineage

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_CHARS = 5_000_000


def docx_text(raw: bytes) -> str:
    """Paragraphs, then tables (cells joined by ' | ', rows by newlines), blocks joined by an empty line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    parts = [t for p in body.findall(f"{_W}p") if (t := text(p))]
    for table in body.findall(f"{_W}tbl"):
        rows = [" | ".join(text(c) for c in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")]
        if rows:
            parts.append("\n".join(rows))
    return "\n\n".join(parts)


def xlsx_text(raw: bytes) -> str:
    """For every sheet '[Sheet: name]' and its rows, cells joined by tabs, empty cells and rows left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = rels[sheet.get(f"{_R}id")].lstrip("/")
            target = target if target.startswith("xl/") else "xl/" + target
            rows = []
            for row in ET.fromstring(z.read(target)).iter(f"{_S}row"):
                cells = []
                for c in row.findall(f"{_S}c"):
                    value, kind = c.findtext(f"{_S}v"), c.get("t")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif kind == "b" and value is not None:
                        value = "True" if value == "1" else "False"
                    if value is not None:
                        cells.append(value)
                if cells:
                    rows.append("\t".join(cells))
            out += [f"[Sheet: {sheet.get('name')}]", "\n".join(rows)]
    return "\n\n".join(out)


def document_text(path: str, raw: bytes | None) -> str:
    """The text of a DOCX or XLSX file, at most 5 million characters; '' for other kinds, missing and broken files.

    PDF needs a library that isn't a dependency: a PDF's text is '' here.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if not raw or kind not in ("docx", "xlsx"):
        return ""
    try:
        return (docx_text if kind == "docx" else xlsx_text)(raw)[:MAX_CHARS]
    except Exception:  # noqa: BLE001 - a broken file is an empty one
        return ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        texts = [document_text(p, r) for p, r in zip(paths, batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32())], names=["path", "text", "text_length"])


def read_documents(spark: SparkSession, path: str, max_bytes: int = 50_000_000) -> DataFrame:
    """(path, text, text_length, error) of the files below a folder.

    Files over max_bytes aren't read: their text is '' and their error 'too large'; else the error is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = files.where(F.col("length") <= max_bytes).select("path", "content").mapInArrow(_texts, "path string, text string, text_length int")
    large = files.where(F.col("length") > max_bytes).select("path", F.lit("").alias("text"), F.lit(0).alias("text_length"), F.lit("too large").alias("error"))
    return read.withColumn("error", F.lit(None).cast("string")).unionByName(large)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(path, html): HTML snapshots below a folder, path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    relative = F.regexp_extract("path", re.escape(root.rstrip("/").split("/")[-1]) + "/(.*)$", 1)
    return files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("html"))


def confined(snapshots: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows whose path stays below its root."""
    return snapshots.where(safe_path(F.col(path_col)))


def write_snapshots(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(url, raw_html) as a table with the snapshot path, partitioned by its first two steps."""
    rows = pages.select("url", "raw_html", snapshot_path(F.col("url")).alias("snapshot_path"))
    rows = rows.withColumn("h2", F.element_at(F.split("snapshot_path", "/"), -3)).withColumn("h4", F.element_at(F.split("snapshot_path", "/"), -2))
    rows.write.mode(mode).partitionBy("h2", "h4").parquet(path)


def write_snapshot_files(pages: DataFrame, root: str) -> DataFrame:
    """(url, snapshot_path, bytes): one HTML file for each page below ``root``, a folder that all executors share.

    A page with a null address, or with null or empty HTML, has none. A file appears whole or not at all, so a repeated task does no harm.
    """
    base = root.removeprefix("file://").removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = page.encode("utf-8", "surrogatepass")
                full = os.path.join(base, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                part = f"{full}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(raw)
                os.replace(part, full)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["url", "snapshot_path", "bytes"])

    rows = pages.where("url is not null and raw_html <> ''").select("url", snapshot_path(F.col("url")).alias("snapshot_path"), "raw_html")
    return cut_lineage(rows.mapInArrow(run, "url string, snapshot_path string, bytes long"))
