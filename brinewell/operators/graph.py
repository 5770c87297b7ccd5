"""Link graph: extraction, degrees, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions.urls import normalize_url
from brinewell.session import cut_lineage


def link_edges(page_links: DataFrame) -> DataFrame:
    """(src, dst): distinct normalised edges without loops; null ends are no edges."""
    e = page_links.select(normalize_url(F.col("from_url")).alias("src"), normalize_url(F.col("to_url")).alias("dst"))
    return e.where("src is not null and dst is not null and src <> dst").distinct()


def link_degrees(edges: DataFrame) -> DataFrame:
    """(url, out_degree, in_degree) of every end of an edge."""
    both = edges.select(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("url").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, cut_every: int = 3) -> DataFrame:
    """(url, pagerank): rank by power iteration, dangling mass spread evenly; ranks sum to 1.

    Contributions are summed before the shuffle, so a page that a third of all links name is one
    row a map task. Addresses are coded as 64-bit hashes while ranks go round.
    """
    coded = edges.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("t"))
    nodes = cut_lineage(edges.select(F.col("src").alias("url")).unionByName(edges.select(F.col("dst").alias("url"))).distinct().select(F.xxhash64("url").alias("v"), "url"))
    degree = coded.groupBy("s").agg(F.count("*").alias("deg"))
    links = cut_lineage(coded.join(degree, "s"))
    n = nodes.count()
    if not n:
        return nodes.select("url", F.lit(0.0).alias("pagerank"))
    dangling = nodes.select("v").join(links.select(F.col("s").alias("v")).distinct(), "v", "left_anti").withColumn("dangling", F.lit(True))
    ranks = cut_lineage(nodes.select("v").join(dangling, "v", "left").select("v", F.coalesce("dangling", F.lit(False)).alias("dangling"), F.lit(1.0 / n).alias("r")))
    for k in range(rounds):
        given = links.join(ranks.select(F.col("v").alias("s"), "r"), "s").groupBy(F.col("t").alias("v")).agg(F.sum(F.col("r") / F.col("deg")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0)).alias("lost"))
        ranks = ranks.join(given, "v", "left").crossJoin(F.broadcast(lost)).select(
            "v", "dangling", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("r")
        )
        if (k + 1) % cut_every == 0:
            ranks = cut_lineage(ranks)
    return nodes.join(ranks, "v").select("url", F.col("r").alias("pagerank"))
