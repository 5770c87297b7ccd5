"""The crawl as DataFrame operators over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewell.functions.urls import SKIP_EXTENSIONS, crawlable_href, has_extension, host_of, in_hosts, normalize_url, resolve_url, skipped_path
from brinewell.session import cut_lineage


def seeds(sites: DataFrame) -> DataFrame:
    """(site, url): every start address of every site. sites: site, start_urls."""
    return sites.select("site", F.explode("start_urls").alias("url"))


def classify_url(url: Column, detail: list[str], lists: list[str]) -> Column:
    """'detail' if a detail pattern matches, else 'list' if a list pattern does, else 'other'."""
    matches = lambda patterns: F.coalesce(url.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)
    return F.when(matches(detail), "detail").when(matches(lists), "list").otherwise("other")


def site_of_url(pages: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """pages with ``site``: the first site, by name, of whose domains one is contained in the host; null for none.

    sites (site, domains) is the crawl's configuration, a list of tens of sites.
    """
    domains = sites.select("site", F.explode("domains").alias("domain"))
    hosts = pages.select(F.lower(host_of(F.col(url))).alias("__host")).distinct()
    found = hosts.join(F.broadcast(domains), F.contains(F.col("__host"), F.col("domain")), "left").groupBy("__host").agg(F.min("site").alias("site"))
    return pages.withColumn("__host", F.lower(host_of(F.col(url)))).join(found, "__host", "left").drop("__host")


def page_cap(pages: DataFrame, site: str, order: str, per_site: int, overall: int = 0) -> DataFrame:
    """The first pages of each site in crawl order, and of all; 0 is no overall cap.

    A site's first pages are found per partition before the shuffle, so a site with a third of all rows is no burden.
    """
    w = Window.partitionBy(site).orderBy(order)
    kept = pages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_site).drop("__n")
    return kept.orderBy(order).limit(overall) if overall else kept


def expand_frontier(links: DataFrame, visited: DataFrame, hosts: list[str]) -> DataFrame:
    """(url): new addresses from rows (url, href): sane, resolved, allowed, not skipped, normalised, not visited.

    Rows with a null address or href give none. Absolute hrefs need no resolving, so Python sees the others only.
    """
    links = links.select("url", F.trim("href").alias("href")).where(crawlable_href(F.col("href")) & F.col("url").isNotNull())
    ready = F.col("href").rlike("^https?://[^/\\s\\x00-\\x1f][^\\s\\x00-\\x1f]*$") & ~F.col("href").rlike("[?;](#|$)")
    absolute = links.where(ready).select(F.col("href").alias("u")).unionByName(links.where(~ready).select(resolve_url(F.col("url"), F.col("href")).alias("u")).where(F.col("u").rlike("(?i)^https?://")))
    fit = absolute.where(in_hosts(F.col("u"), hosts) & ~has_extension(F.col("u"), SKIP_EXTENSIONS) & ~skipped_path(F.col("u")))
    return fit.select(normalize_url(F.col("u")).alias("url")).distinct().join(visited.select("url"), "url", "left_anti")


def crawl(start: DataFrame, pages: DataFrame, hosts: list[str], depth: int = 3) -> DataFrame:
    """(url, depth): breadth-first walk over stored pages (url, hrefs) from start (url), to a depth."""
    seen = cut_lineage(start.select(normalize_url(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        here = pages.join(frontier.select("url"), "url", "left_semi").select("url", F.explode("hrefs").alias("href"))
        frontier = cut_lineage(expand_frontier(here, seen, hosts).withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def crawl_stats(items: DataFrame, minutes: float, skipped: Column | None = None) -> DataFrame:
    """One row: pages, pages per minute, mean content bytes, attachment links, empty contents, skipped rows.

    Rows for which ``skipped`` is true (addresses that the crawl passed over) count as such only.
    """
    passed = F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)
    pages = F.count_if(~passed)
    return items.agg(
        pages.alias("pages"),
        F.round(pages / F.lit(max(minutes, 0.01)), 1).alias("pages_per_minute"),
        F.round(F.coalesce(F.sum(F.when(~passed, F.octet_length("content"))), F.lit(0)) / F.greatest(pages, F.lit(1)), 1).alias("mean_bytes"),
        F.coalesce(F.sum(F.when(~passed, F.size(F.coalesce("attachment_links", F.array().cast("array<string>"))))), F.lit(0)).alias("attachments"),
        F.count_if(~passed & (F.coalesce(F.trim("content"), F.lit("")) == "")).alias("empty_pages"),
        F.count_if(passed).alias("skipped"),
    )


def site_yield(items: DataFrame, site: str = "source_site") -> DataFrame:
    """(site, cnt, pct): items of each site, largest first, and their rounded percentage of the largest."""
    counts = items.groupBy(F.col(site).alias("site")).agg(F.count("*").alias("cnt"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("cnt").alias("most")))).select("site", "cnt", F.round(F.lit(100.0) * F.col("cnt") / F.col("most")).alias("pct")).orderBy(F.desc("cnt"), "site")


def plan_batches(batches: DataFrame) -> DataFrame:
    """One row: number of crawl batches, distinct sites, sum of page caps. batches: name, source_site, max_pages."""
    return batches.agg(F.count("*").alias("batches"), F.count_distinct("source_site").alias("sites"), F.coalesce(F.sum("max_pages"), F.lit(0)).alias("max_pages"))


def write_stats(stats: DataFrame, path: str) -> None:
    """The one row of statistics as a JSON file."""
    stats.coalesce(1).write.mode("overwrite").json(path)
