"""References to records that do not exist (problem 7).

Keys become 64-bit codes: integer keys as they are, addresses by xxhash64. Codes are
spread over key ranges by their hash; within a range the codes that occur are numbered
0..n-1 (the dictionary), and for each period two compressed bitmaps over these numbers
are built, of the codes referenced in the period and of the codes of parents that exist
by its end. Reference AND-NOT parent leaves the codes that are missing or come in a later
period; reference AND parents-of-this-period leaves those that must be compared row by
row. Surviving bits are decoded to codes and joined back to the rows.

References are reduced to distinct (code, period) before they are shuffled, so a key
that a third of all rows name is one entry a period.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.urls import host_of, normalize_url
from brinewell.session import cut_lineage

_BLOCK = 1 << 12  # bits of a bitmap's block; empty blocks aren't stored


class Bitmap:
    """A bitmap over 0..n-1 that stores only its non-empty blocks."""

    __slots__ = ("blocks",)

    def __init__(self, numbers: np.ndarray | None = None):
        self.blocks: dict[int, np.ndarray] = {}
        if numbers is not None and len(numbers):
            which = numbers // _BLOCK
            for b in np.unique(which):
                bits = np.zeros(_BLOCK, np.uint8)
                bits[numbers[which == b] % _BLOCK] = 1
                self.blocks[int(b)] = np.packbits(bits)

    def add(self, other: Bitmap) -> None:
        for b, bits in other.blocks.items():
            mine = self.blocks.get(b)
            self.blocks[b] = bits if mine is None else mine | bits

    def and_not(self, other: Bitmap) -> Bitmap:
        out = Bitmap()
        for b, bits in self.blocks.items():
            theirs = other.blocks.get(b)
            left = bits if theirs is None else bits & ~theirs
            if left.any():
                out.blocks[b] = left
        return out

    def both(self, other: Bitmap) -> Bitmap:
        out = Bitmap()
        for b, bits in self.blocks.items():
            theirs = other.blocks.get(b)
            if theirs is not None and (left := bits & theirs).any():
                out.blocks[b] = left
        return out

    def decode(self) -> np.ndarray:
        parts = [np.flatnonzero(np.unpackbits(bits)) + b * _BLOCK for b, bits in sorted(self.blocks.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (range, role, code, period, at), sorted by range: (role, code, period, parent_at, sure)."""
    held: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        role, code, period = (table.column(i).to_numpy() for i in (1, 2, 3))
        at = table.column(4).to_numpy()
        for pair in np.unique(role // 2):  # 2r: references r, 2r + 1: their parents
            mine = role // 2 == pair
            refs = mine & (role % 2 == 0)
            codes, number = np.unique(code[mine], return_inverse=True)
            is_parent = role[mine] % 2 == 1
            p, when = period[mine], at[mine]
            born = np.full(len(codes), np.iinfo(np.int64).max)
            np.minimum.at(born, number[is_parent], when[is_parent])
            if not refs.any():
                continue
            exist = Bitmap()
            for month in np.unique(p):
                now = Bitmap(number[is_parent & (p == month)])
                exist.add(now)
                named = Bitmap(number[~is_parent & (p == month)])
                for found, sure in ((named.and_not(exist), True), (named.both(now), False)):
                    bits = found.decode()
                    if len(bits):
                        there = born[bits] != np.iinfo(np.int64).max
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(bits), pair, np.int32)),
                                pa.array(codes[bits]),
                                pa.array(np.full(len(bits), month, np.int32)),
                                pa.array(born[bits], pa.int64(), mask=~there),
                                pa.array(np.full(len(bits), sure)),
                            ],
                            names=["ref", "code", "period", "parent_at", "sure"],
                        )

    last = None
    for batch in batches:
        ranges = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ranges) else []
        for a, b in zip(cuts, [*cuts[1:], len(ranges)]):
            if last is not None and ranges[a] != last:
                yield from close()
            last = ranges[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from close()


@dataclass
class Reference:
    """One kind of reference: rows (row_id, key, created_at) and parents (key, created_at)."""

    table_name: str
    rows: DataFrame
    row_id: Column
    key: Column
    created_at: Column
    parents: DataFrame
    parent_key: Column
    parent_created_at: Column

    def codes(self) -> tuple[DataFrame, DataFrame]:
        def code(c: Column, df: DataFrame) -> Column:
            kind = df.select(c.alias("k")).schema["k"].dataType.simpleString()
            return c.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(c)

        def micros(c: Column) -> Column:
            return F.unix_micros(c.cast("timestamp"))

        def month(c: Column) -> Column:
            return (F.year(c) * 12 + F.month(c) - 1).cast("int")

        refs = self.rows.select(
            self.row_id.cast("long").alias("row_id"), code(self.key, self.rows).alias("code"), month(self.created_at).alias("period"), micros(self.created_at).alias("at"), self.key.isNotNull().alias("has")
        ).where("has and row_id is not null").drop("has")
        parents = self.parents.select(
            code(self.parent_key, self.parents).alias("code"), month(self.parent_created_at).alias("period"), micros(self.parent_created_at).alias("at"), self.parent_key.isNotNull().alias("has")
        ).where("has").drop("has")
        return refs, parents


def orphans(references: list[Reference], ranges: int = 4096) -> DataFrame:
    """(table_name, row_id, period, kind): 'missing' has no parent, 'late' one created after the row.

    Null keys are no references. A repeated row gives one case. A parent that occurs several
    times counts by its first creation; a parent without a creation time always existed. A row
    without a creation time has a null period and can only be 'missing'. ``ranges`` is the
    number of key ranges; a range's distinct keys are held by one task, so it should grow with
    the keys (a thousand million keys: 4096 ranges of 250,000).
    """
    parts, all_refs = [], []
    for i, r in enumerate(references):
        refs, parents = r.codes()
        refs = refs.select(F.lit(i).alias("ref"), "*")
        all_refs.append(refs)
        period = F.coalesce("period", F.lit(1 << 30))
        parts.append(refs.select((F.col("ref") * 2).alias("role"), "code", period.alias("period")).distinct().select("*", F.lit(0).cast("long").alias("at")))
        first = parents.groupBy("code").agg(F.min(F.coalesce("at", F.lit(-(1 << 62)))).alias("at"), F.min(F.coalesce("period", F.lit(-1))).alias("period"))
        parts.append(first.select(F.lit(2 * i + 1).alias("role"), "code", "period", "at"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    ranged = both.select(F.pmod(F.xxhash64("code"), F.lit(ranges)).cast("int").alias("rng"), "role", "code", "period", "at")
    # rows of one key range stay together and in one run; the small ranges are merged to partitions
    sorted_ = ranged.repartition("rng").sortWithinPartitions("rng")
    left = cut_lineage(sorted_.mapInArrow(_survivors, "ref int, code long, period int, parent_at long, sure boolean"))
    rows = all_refs[0]
    for r in all_refs[1:]:
        rows = rows.unionByName(r)
    rows = rows.select("ref", "row_id", "code", F.coalesce("period", F.lit(1 << 30)).alias("period"), "at")
    kind = F.when(F.col("parent_at").isNull(), "missing").when(F.col("at") < F.col("parent_at"), "late")
    names = F.array(*[F.lit(r.table_name) for r in references])
    month = F.when(F.col("period") < 1 << 30, F.format_string("%04d-%02d", F.floor(F.col("period") / 12), F.col("period") % 12 + 1))
    return (
        rows.join(left, ["ref", "code", "period"])
        .select(F.element_at(names, F.col("ref") + 1).alias("table_name"), "row_id", month.alias("period"), kind.alias("kind"))
        .where("kind is not null")
        .distinct()
    )


def site_orphans(pages: DataFrame, page_links: DataFrame, query_logs: DataFrame, click_logs: DataFrame, attachments: DataFrame) -> DataFrame:
    """The orphans of this data model's three references; links only to hosts of the page register."""
    hosts = pages.where("source_site is not null and source_site <> ''").select(F.lower("source_site").alias("host")).distinct()
    links = page_links.select("id", "created_at", normalize_url(F.col("to_url")).alias("target"), F.lower(host_of(F.col("to_url"))).alias("host"))
    # the registered hosts are far fewer than the pages; Spark broadcasts them only below its size threshold
    links = links.join(hosts, "host", "left_semi")
    # Parquet footers tell the rows; some 50,000 rows a range keep its dictionary small and its bitmaps few
    rows = sum(t.count() for t in (pages, page_links, query_logs, click_logs, attachments))
    return orphans(
        ranges=max(64, rows // 50_000),
        references=[
            Reference("page_links", links, F.col("id"), F.col("target"), F.col("created_at"), pages, F.col("normalized_url"), F.col("created_at")),
            Reference("click_logs", click_logs, F.col("id"), F.col("query_log_id"), F.col("created_at"), query_logs, F.col("id"), F.col("created_at")),
            Reference("attachments", attachments, F.col("id"), F.col("parent_page_id"), F.col("created_at"), pages, F.col("id"), F.col("created_at")),
        ]
    )
