"""The inverted index as DataFrames: postings, field statistics, document lengths, stored fields.

Built once and stored sorted by term, so that a query's term filter prunes row groups: a search
reads the postings of its terms and, for the page of results, the stored fields of that page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.text import tokenize_in_order
from brinewell.session import cut_lineage

K1, B = 1.2, 0.75
#: Tokens that are grouped at once.
_TOKENS = 1 << 20


@dataclass
class Index:
    """postings (term, field, doc_id, positions, tf, dl), lengths (field, doc_id, dl), stats (field, doc_count, sum_dl), terms (term, field, df), docs (stored fields)."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame
    docs: DataFrame | None = None


def _group(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of (doc_id, field, tokens): each row's tokens by term, positions in order."""
    tokens = batch.column(2)
    sizes = np.diff(tokens.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = tokens.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((code, row))
    r, c = row[order], code[order]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])]) if len(r) else np.zeros(0, np.int64)
    ends = np.r_[first, len(order)].astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
    at = pa.array(r[first])
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(c[first])), batch.column(1).take(at), batch.column(0).take(at), positions, pa.array(np.diff(ends)), pa.array(sizes[r[first]].astype(np.int32))],
        names=["term", "field", "doc_id", "positions", "tf", "dl"],
    )


def _posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _TOKENS, "right")) - 1)
            yield _group(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, to - at).columns], names=batch.schema.names))
            at = to


def build_index(docs: DataFrame, id_col: str, fields: list[str], stored: list[str] | None = None) -> Index:
    """Tokens with positions of each field; a document without tokens in a field isn't in that field's statistics.

    A document's terms are grouped inside its row, in time in proportion to its tokens, so nothing is
    shuffled. ``stored`` names the columns that the index keeps beside the id.
    """
    per_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokenize_in_order(F.col(f)).alias("tokens")) for f in fields]))
    rows = docs.select(F.col(id_col).alias("doc_id"), per_field.alias("x")).select("doc_id", "x.field", "x.tokens").where(F.size("tokens") > 0)
    lengths = rows.select("field", "doc_id", F.size("tokens").alias("dl"))
    kind = docs.schema[id_col].dataType.simpleString()
    postings = rows.mapInArrow(_posting_batches, f"term string, field string, doc_id {kind}, positions array<int>, tf int, dl int")
    stats = lengths.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("dl").alias("sum_dl"))
    terms = postings.groupBy("term", "field").agg(F.count("*").alias("df"))
    kept = docs.select(F.col(id_col).alias("doc_id"), *stored) if stored is not None else None
    return Index(postings, lengths, stats, terms, kept)


def write_index(index: Index, path: str, mode: str = "errorifexists") -> None:
    """Store an index; ``mode`` 'overwrite' recreates it, 'ignore' leaves one that exists.

    Postings lie by term and document: a term that most documents hold fills several files.
    """
    # finding the ranges reads its input once more: the documents are tokenized once, into a table
    cut_lineage(index.postings).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "field", "doc_id").write.mode(mode).parquet(f"{path}/postings")
    spark = index.postings.sparkSession
    # statistics follow from what was stored
    stored = spark.read.parquet(f"{path}/postings")
    stored.select("field", "doc_id", "dl").distinct().write.mode(mode).parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    lengths.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("dl").alias("sum_dl")).write.mode(mode).parquet(f"{path}/stats")
    if index.docs is not None:
        index.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode(mode).parquet(f"{path}/docs")
    # the last table: an index is there once it is
    stored.groupBy("term", "field").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether an index is stored there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/terms/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_index(spark: SparkSession, path: str) -> Index:
    """A stored index, with its stored fields if it has them."""
    tables = [spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "stats", "terms")]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/docs")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return Index(*tables, spark.read.parquet(f"{path}/docs") if there else None)


def refresh_index(index: Index, changed: DataFrame, docs: DataFrame, id_col: str, fields: list[str]) -> Index:
    """The index after documents changed: their old postings are replaced; statistics follow from the lengths.

    changed: the ids that changed, vanished or came; docs: the documents now.
    """
    ids = changed.select(F.col(id_col).alias("doc_id")).distinct()
    stored = [c for c in index.docs.columns if c != "doc_id"] if index.docs is not None else None
    new = build_index(docs.join(ids, docs[id_col] == ids["doc_id"], "left_semi"), id_col, fields, stored)
    fresh = cut_lineage(new.postings)
    postings = cut_lineage(index.postings.join(ids, "doc_id", "left_anti").select(*fresh.columns).unionByName(fresh))
    lengths = cut_lineage(index.lengths.join(ids, "doc_id", "left_anti").select("field", "doc_id", "dl").unionByName(fresh.select("field", "doc_id", "dl").distinct()))
    stats = lengths.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("dl").alias("sum_dl"))
    kept = cut_lineage(index.docs.join(ids, "doc_id", "left_anti").unionByName(new.docs)) if index.docs is not None else None
    return Index(postings, lengths, stats, postings.groupBy("term", "field").agg(F.count("*").alias("df")), kept)


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _tf_part(tf: Column, dl: Column, avg: Column) -> Column:
    return tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avg))


def _boost(boosts: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[x for f, b in boosts.items() for x in (F.lit(f), F.lit(float(b)))]), F.col("field"))


def _weights(index: Index, wanted: list[str], boosts: dict[str, float]) -> DataFrame:
    """(term, field, idf, avg): a row for each of the query's terms and fields."""
    df = index.terms.where(F.col("term").isin(*wanted) & F.col("field").isin(*boosts))
    n = F.col("doc_count").cast("double")
    return df.join(F.broadcast(index.stats), "field").select("term", "field", _idf(n, F.col("df")).alias("idf"), (F.col("sum_dl") / F.col("doc_count")).alias("avg"))


def search_index(index: Index, terms: list[str], boosts: dict[str, float]) -> DataFrame:
    """(doc_id, score): best field's boosted BM25 of the documents that hold a term.

    Only the postings of the terms are read; documents meet in one aggregation.
    """
    wanted = list(dict.fromkeys(terms))
    hit = index.postings.where(F.col("term").isin(*wanted) & F.col("field").isin(*boosts)).select("term", "field", "doc_id", "tf", "dl")
    scored = hit.join(F.broadcast(_weights(index, wanted, boosts)), ["term", "field"])
    part = _boost(boosts) * F.col("idf") * _tf_part(F.col("tf"), F.col("dl"), F.col("avg"))
    sums = [F.sum(F.when(F.col("field") == f, part)) for f in boosts]
    return scored.groupBy("doc_id").agg((F.greatest(*sums) if len(sums) > 1 else sums[0]).alias("score"))


def search_index_phrase(index: Index, terms: list[str], boosts: dict[str, float]) -> DataFrame:
    """(doc_id, score): documents with the terms in a row in a field, by their positions; matching fields' boosted BM25 summed."""
    wanted = list(dict.fromkeys(terms))
    hit = index.postings.where(F.col("term").isin(*wanted) & F.col("field").isin(*boosts))
    held = hit.groupBy("doc_id", "field").agg(F.first("dl").alias("dl"), *[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"__p{i}") for i, t in enumerate(wanted)])
    # where the phrase would start if its k-th term stood at a position
    back = lambda k: F.transform(f"__p{wanted.index(terms[k])}", lambda x: x - F.lit(k))
    starts = back(0)
    for k in range(1, len(terms)):
        starts = F.array_intersect(starts, back(k))
    found = held.dropna(subset=[f"__p{i}" for i in range(len(wanted))]).select("doc_id", "field", "dl", F.size(starts).alias("tf")).where("tf > 0")
    repeated = index.postings.sparkSession.createDataFrame([(t, terms.count(t)) for t in wanted], "term string, times int")
    weight = _weights(index, wanted, boosts).join(F.broadcast(repeated), "term").groupBy("field").agg(F.sum(F.col("idf") * F.col("times")).alias("idf"), F.first("avg").alias("avg"))
    scored = found.join(F.broadcast(weight), "field")
    return scored.groupBy("doc_id").agg(F.sum(_boost(boosts) * F.col("idf") * _tf_part(F.col("tf"), F.col("dl"), F.col("avg"))).alias("score"))
