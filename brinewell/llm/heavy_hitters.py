"""Most frequent values by lossy counting (problem 2).

Each partition keeps entries (value, count, delta) in bucketed passes: after every
1/epsilon rows the entries whose count + delta is at most the number of passed buckets
are pruned. A partition of n rows undercounts any value by at most epsilon * n; its
summary has at most (1/epsilon) * log(epsilon * n) entries. Summaries are merged by
value: counts add up, the upper bound adds an entry's delta, or for a partition without
the entry that partition's last bucket. The interval [count, upper] holds the true count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.session import cut_lineage

#: White space of Unicode and the four separators that Python counts as such.
SPACE = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def normal_query(c: Column) -> Column:
    """White-space runs become one space, ends are trimmed, letters lower-cased."""
    return F.lower(F.trim(F.regexp_replace(c, SPACE, " ")))


def _summaries(epsilon: float):
    width = math.ceil(1 / epsilon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[str, list[int]] = {}
        bucket, filled, rows = 1, 0, 0
        for batch in batches:
            column = batch.column(0)
            at = 0
            rows += len(column)
            while at < len(column):
                part = column.slice(at, width - filled)
                counts = pc.value_counts(part)
                for value, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
                    if value is None:
                        continue
                    entry = entries.get(value)
                    if entry:
                        entry[0] += n
                    else:
                        entries[value] = [n, bucket - 1]
                at += len(part)
                filled += len(part)
                if filled == width:
                    entries = {v: e for v, e in entries.items() if e[0] + e[1] > bucket}
                    bucket, filled = bucket + 1, 0
        if rows:
            # the row without a value tells this partition's rows and its largest undercount
            values, counts, deltas = [None], [rows], [bucket - 1]
            for v, (n, d) in entries.items():
                values.append(v)
                counts.append(n)
                deltas.append(d - (bucket - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.string()), pa.array(counts, pa.int64()), pa.array(deltas, pa.int64())], names=["value", "low", "delta"]
            )

    return run


def frequent_values(df: DataFrame, value: Column, support: float, min_count: int = 1, epsilon: float | None = None) -> DataFrame:
    """(value, low, high, rows): values that may hold at least support of all rows and min_count rows.

    ``low <= true count <= high`` is guaranteed, ``high - low <= epsilon * rows``. epsilon is a
    tenth of support unless given. Null and empty values are rows but never results. An empty
    table gives no rows. No value that reaches the support is missed.
    """
    epsilon = epsilon or support / 10
    if not 0 < epsilon < support <= 1:
        raise ValueError("0 < epsilon < support <= 1")
    source = df.select(value.alias("value"))
    cleaned = source.select(F.when(F.col("value") != "", F.col("value")).alias("value"))
    summary = cut_lineage(cleaned.mapInArrow(_summaries(epsilon), "value string, low long, delta long"))
    merged = summary.groupBy("value").agg(F.sum("low").alias("low"), F.sum("delta").alias("delta"))
    # one row; a partition without an entry for a value adds its last bucket to the bound
    worst = summary.where("value is null").agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("worst"), F.coalesce(F.sum("low"), F.lit(0)).alias("rows"))
    both = merged.where("value is not null").crossJoin(F.broadcast(worst))
    return both.select("value", "low", (F.col("low") + F.col("delta") + F.col("worst")).alias("high"), "rows").where(
        (F.col("high") >= F.lit(support) * F.col("rows")) & (F.col("high") >= min_count)
    )


def frequent_values_exact(df: DataFrame, value: Column, support: float, min_count: int = 1, epsilon: float | None = None) -> DataFrame:
    """(value, count, low, high): the candidates of ``frequent_values`` counted exactly in a second pass.

    There are at most 1 / (support - epsilon) candidates, whatever the input's size: that bound
    allows the broadcast.
    """
    candidates = cut_lineage(frequent_values(df, value, support, min_count, epsilon))
    counted = df.select(value.alias("value")).join(F.broadcast(candidates.select("value")), "value").groupBy("value").agg(F.count("*").alias("count"))
    return (
        counted.join(F.broadcast(candidates), "value")
        .where((F.col("count") >= F.lit(support) * F.col("rows")) & (F.col("count") >= min_count))
        .select("value", "count", "low", "high")
    )
