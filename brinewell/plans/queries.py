"""The engine's own queries, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions import dates, text, urls
from brinewell.operators import crawl, graph, html, index, ingest, log_analytics, ranking, search
from brinewell.operators.orphans import site_orphans
from brinewell.plans.bindings import AS_OF, attachment_docs, document_index, keyword_weights, page_docs, page_index, recrawl, sites
from brinewell.session import cut_lineage, load, shared_dir
from brinewell.sources import files, jsonl

Q = "样本标注 workshop 风险评估"
PHRASE = "风险评估"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _score6(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


# --- references -----------------------------------------------------------------------------


@query
def p7_found(spark, d):
    return site_orphans(*(load(spark, d, t) for t in ("pages", "page_links", "query_logs", "click_logs", "attachments")))


@query
def p7_report(spark, d):
    return p7_found(spark, d).groupBy("table_name", "period", "kind").agg(F.count("*").alias("cnt"))


# --- query-log analytics --------------------------------------------------------------------


@query
def log_stats(spark, d):
    return log_analytics.log_stats(load(spark, d, "query_logs"), load(spark, d, "users"), AS_OF)


@query
def hot_queries_24h(spark, d):
    return log_analytics.hot_queries(load(spark, d, "query_logs"), 10, AS_OF, hours=24)


@query
def hot_queries_all(spark, d):
    return log_analytics.hot_queries(load(spark, d, "query_logs"), 20)


@query
def hot_queries_ci(spark, d):
    return log_analytics.hot_queries(load(spark, d, "query_logs"), 50, ci=True)


@query
def suggest_prefix(spark, d):
    return log_analytics.suggest(load(spark, d, "query_logs"), " 校 ")


@query
def suggest_like(spark, d):
    return log_analytics.suggest(load(spark, d, "query_logs"), "_历", wildcards=True)


@query
def recent_queries(spark, d):
    return log_analytics.recent_queries(load(spark, d, "query_logs").distinct(), 20)


@query
def recent_with_total(spark, d):
    return log_analytics.recent_with_total(load(spark, d, "query_logs").distinct(), 10)


@query
def type_distribution(spark, d):
    return log_analytics.type_distribution(load(spark, d, "query_logs"))


@query
def daily_trend(spark, d):
    return log_analytics.daily_trend(load(spark, d, "query_logs"), AS_OF, 30)


@query
def click_through(spark, d):
    return log_analytics.click_through(load(spark, d, "query_logs"), load(spark, d, "click_logs"))


@query
def filter_usage(spark, d):
    return log_analytics.filter_usage(load(spark, d, "query_logs"))


@query
def username_taken(spark, d):
    return load(spark, d, "users").where("username = 'yh_2'").agg(F.count("*").alias("cnt"))


# --- text and index -------------------------------------------------------------------------


@query
def term_frequencies(spark, d):
    tokens = text.tokenize(F.col("content"))
    rows = page_docs(spark, d).select("page_id", tokens.alias("t")).select("page_id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return rows.groupBy("page_id", "term", "len").agg(F.count("*").alias("n")).select("page_id", "term", "n", F.round(F.col("n") / F.col("len"), 6).alias("tf"))


@query
def document_frequencies(spark, d):
    idx = index.build_index(page_docs(spark, d), "page_id", ["title", "content"])
    return idx.terms


@query
def field_statistics(spark, d):
    return index.build_index(page_docs(spark, d), "page_id", ["title", "content", "anchor_text"]).stats


@query
def postings(spark, d):
    return index.build_index(page_docs(spark, d), "page_id", ["title"]).postings.select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


@query
def refreshed_index(spark, d):
    """The index of pages whose every fifth title was another one, after these came in."""
    docs = page_docs(spark, d)
    late = F.col("page_id") % 5 == 0
    before = docs.withColumn("title", F.when(late, F.lit("an earlier title")).otherwise(F.col("title"))).where("page_id % 10 <> 0")
    changed = docs.where(late).select("page_id")
    return index.refresh_index(index.build_index(before, "page_id", ["title", "content"]), changed, docs, "page_id", ["title", "content"]).terms


# --- retrieval ------------------------------------------------------------------------------


def _page_hits(spark, d, q=Q, boosts=search.PAGE_BOOSTS, **equal):
    idx = page_index(spark, d)
    return idx, search.indexed(idx, q, boosts, "page_id", **equal)


@query
def search_pages(spark, d):
    idx, hits = _page_hits(spark, d)
    return _score6(search.result_page(idx, hits, "page_id", Q, 1, 20), "page_id", "title")


@query
def search_pages_all(spark, d):
    return _score6(_page_hits(spark, d)[1], "page_id")


@query
def search_unindexed(spark, d):
    return _score6(search.multi_match(page_docs(spark, d), Q, search.PAGE_BOOSTS), "page_id")


@query
def search_pages_filtered(spark, d):
    return _score6(_page_hits(spark, d, source_site="news.yunheng.example", category="")[1], "page_id")


@query
def search_page_two(spark, d):
    idx, hits = _page_hits(spark, d)
    return _score6(search.result_page(idx, hits, "page_id", Q, 2, 10), "page_id")


@query
def search_total(spark, d):
    return search.total_hits(_page_hits(spark, d)[1])


@query
def search_documents(spark, d):
    return _score6(search.indexed(document_index(spark, d), Q, search.DOCUMENT_BOOSTS, "attachment_id", file_type="pdf"), "attachment_id")


@query
def search_phrase(spark, d):
    return _score6(search.indexed_phrase(page_index(spark, d), PHRASE, "page_id"), "page_id")


@query
def search_phrase_unindexed(spark, d):
    return _score6(search.phrase_match(page_docs(spark, d), PHRASE), "page_id")


@query
def search_wildcard_url(spark, d):
    return search.wildcard_match(page_docs(spark, d), "https://news.*/info/*1?.htm", "url").select("page_id", "score")


@query
def search_wildcard_title(spark, d):
    return search.wildcard_match(page_docs(spark, d), "work*p", "title").select("page_id", "score")


@query
def search_regex(spark, d):
    return search.regex_filter(page_docs(spark, d), "第(?P<n>[0-9]+)届", "title").select("page_id", "title")


@query
def highlight_titles(spark, d):
    hits = page_docs(spark, d)
    return hits.select("page_id", text.sanitize(text.highlight(F.col("title"), ["风险", "workshop"])).alias("title"))


@query
def snippets(spark, d):
    return page_docs(spark, d).select("page_id", text.snippet(F.col("content"), ["风险评估", "workshop"]).alias("snippet"))


@query
def page_results(spark, d):
    idx, hits = _page_hits(spark, d)
    return search.page_result(search.result_page(idx, hits, "page_id", Q, 1, 10), Q).withColumn("score", F.round("score", 6))


@query
def document_results(spark, d):
    idx = document_index(spark, d)
    hits = search.indexed(idx, Q, search.DOCUMENT_BOOSTS, "attachment_id")
    return search.document_result(search.result_page(idx, hits, "attachment_id", Q, 1, 10), Q).withColumn("score", F.round("score", 6))


# --- ranking --------------------------------------------------------------------------------


def _candidates(spark, d, size=20):
    idx, hits = _page_hits(spark, d)
    return cut_lineage(search.result_page(idx, hits, "page_id", Q, 1, size))


@query
def vsm_scores(spark, d):
    return ranking.vsm_scores(_candidates(spark, d), "page_id", Q).select("page_id", F.round("vsm", 6).alias("vsm"))


@query
def preference_scores(spark, d):
    users = load(spark, d, "users").select("id", "role", "college", "interests")
    kw = keyword_weights(spark).groupBy("role").agg(F.collect_list(F.struct("keyword", "weight")).alias("keywords"))
    pages = _candidates(spark, d, 10).select("page_id", "title", "category", "source_site", text.snippet(F.col("content"), []).alias("snippet"))
    rows = users.join(F.broadcast(kw), "role", "left").crossJoin(F.broadcast(pages))  # one page of ten results
    score = ranking.preference_score(F.col("title"), F.col("snippet"), F.col("category"), F.col("source_site"), F.col("keywords"), F.col("college"), F.col("interests"))
    return rows.select(F.col("id").alias("user_id"), "page_id", score.alias("preference"))


@query
def ranked_search(spark, d):
    found = _candidates(spark, d).withColumnRenamed("score", "bm25")
    vsm = ranking.vsm_scores(found, "page_id", Q)
    ranks = _ranks(spark, d).select(F.col("url").alias("normalized_url"), "pagerank")
    shown = found.join(vsm, "page_id").withColumn("snippet", text.snippet(F.col("content"), []))
    shown = shown.withColumn("normalized_url", urls.normalize_url(F.col("url"))).join(ranks, "normalized_url", "left")
    scored = ranking.with_profile(shown, load(spark, d, "users"), 12, keyword_weights(spark))
    return ranking.blend(scored, "page_id").select("page_id", F.round("bm25", 6).alias("bm25"), F.round("vsm", 4).alias("vsm"), F.round(F.coalesce("pagerank", F.lit(0.0)), 9).alias("pagerank"), "preference", "final_score")


@query
def related_pages(spark, d):
    idx, found = _page_hits(spark, d, "学位授予", search.RELATED_BOOSTS)
    hits = search.result_page(idx, found, "page_id", "学位授予", 1, 5)
    scored = ranking.with_profile(hits.withColumn("snippet", F.lit("")), load(spark, d, "users"), 12, keyword_weights(spark))
    return ranking.related_rank(scored, "page_id").select("page_id", "final_score")


@query
def role_profiles(spark, d):
    kw = keyword_weights(spark)
    return load(spark, d, "users").join(F.broadcast(kw), "role", "left").groupBy("role").agg(F.count_distinct("id").alias("users"), F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 3).alias("weight"))


@query
def anonymous_profile(spark, d):
    hits = _candidates(spark, d, 10).withColumn("snippet", F.lit(""))
    return ranking.with_profile(hits, load(spark, d, "users"), None, keyword_weights(spark)).select("page_id", "preference")


# --- URLs, dates, HTML ----------------------------------------------------------------------


@query
def url_normalize(spark, d):
    return load(spark, d, "page_links").select("id", urls.normalize_url(F.col("to_url")).alias("u"), urls.host_of(F.col("to_url")).alias("host")).distinct()


@query
def url_filters(spark, d):
    u = F.col("to_url")
    return load(spark, d, "page_links").select(
        "id", urls.in_domains(u, ["yunheng.example"]).alias("below"), urls.in_hosts(u, ["news.yunheng.example", "lib.yunheng.example"]).alias("exact"),
        urls.has_extension(u, urls.SKIP_EXTENSIONS).alias("skip_ext"), urls.crawlable_href(u).alias("href_ok"), crawl.classify_url(u, ["/info/\\d+/\\d+\\.htm"], ["/notice/"]).alias("kind"),
    ).distinct()


@query
def url_hashes(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").select("id", urls.content_hash(u).alias("hash"), urls.snapshot_path(u).alias("snapshot"), urls.safe_file_name(u).alias("file_name"), urls.safe_path(F.col("snapshot_path")).alias("safe"))


@query
def url_dates(spark, d):
    return load(spark, d, "pages").select("id", dates.url_date(F.regexp_replace("url", "/(\\d{4})/(\\d{2})(\\d{2})/", "/$1/$2/$3/")).cast("string").alias("d"))


@query
def parse_dates(spark, d):
    p = load(spark, d, "page_items")
    return p.select("item_id", F.date_format(dates.parse_datetime(F.col("publish_time")), "yyyy-MM-dd HH:mm:ss").alias("published"), dates.index_date(F.col("crawl_time")).alias("crawled"))


@query
def stale_hashes(spark, d):
    items = load(spark, d, "page_items").where("content is not null")
    return items.select("item_id", (urls.content_hash(F.col("content")) == F.col("content_hash")).alias("fresh"), F.octet_length("content").alias("bytes"), F.length(text.preview(F.col("content"))).alias("shown"))


@query
def html_titles(spark, d):
    return load(spark, d, "page_items").where("raw_html is not null").select("item_id", html.html_title(F.col("raw_html")).alias("title"))


@query
def html_links(spark, d):
    rows = load(spark, d, "page_items").where("raw_html is not null").select("item_id", F.posexplode(html.html_links(F.col("raw_html"))).alias("pos", "a"))
    return rows.select("item_id", "pos", F.col("a.href").alias("href"), html.classify_link(F.col("a.href")).alias("kind"))


@query
def parsed_pages(spark, d):
    rows = html.parse_pages(load(spark, d, "page_items").select("item_id", "url", "raw_html"))
    return rows.select("item_id", "parsed.title", F.size("parsed.links").alias("links"), F.date_format("publish_time", "yyyy-MM-dd HH:mm").alias("published"))


@query
def parsed_texts(spark, d):
    rows = html.parse_pages(load(spark, d, "page_items").select("item_id", "url", "raw_html"))
    return rows.select("item_id", F.length("parsed.content").alias("chars"), F.size("parsed.out_links").alias("links"), F.size("parsed.attachment_links").alias("attachments"))


@query
def crawled_items(spark, d):
    fetched = load(spark, d, "page_items").select("url", "raw_html", "status_code", F.when(F.col("item_id") % 9 == 0, "application/pdf").when(F.col("item_id") % 2 == 0, "text/html; charset=utf-8").alias("content_type"))
    items = html.crawl_items(fetched, sites(spark), F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp_ntz"))
    return items.select("url", "normalized_url", "title", "source_site", "category", "crawl_time", "snapshot_path", "status_code", F.size("anchor_texts").alias("anchors"), F.size("attachment_links").alias("attachments"))


@query
def scanned_dates(spark, d):
    c = F.col("content")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return load(spark, d, "page_items").select("item_id", F.date_format(dates.scan_date(c), fmt).alias("any"), F.date_format(dates.scan_date(c, dates.SCAN_CRAWL), fmt).alias("crawl"))


@query
def cleaned_texts(spark, d):
    return load(spark, d, "page_items").select("item_id", text.clean_text(F.col("content")).alias("content"), text.join_anchors(F.col("anchor_texts")).alias("anchor_text"))


# --- link graph -----------------------------------------------------------------------------


@query
def link_degrees(spark, d):
    return graph.link_degrees(graph.link_edges(load(spark, d, "page_links")))


def _ranks(spark, d):
    return graph.pagerank(graph.link_edges(load(spark, d, "page_links")), rounds=5)


@query
def pagerank(spark, d):
    return _ranks(spark, d).select("url", F.round("pagerank", 9).alias("pagerank"))


@query
def frontier(spark, d):
    found = load(spark, d, "page_links").select(F.col("from_url").alias("url"), F.col("to_url").alias("href"))
    visited = load(spark, d, "pages").select(F.col("normalized_url").alias("url"))
    return crawl.expand_frontier(found, visited, ["news.yunheng.example", "lib.yunheng.example", "jwc.yunheng.example"])


@query
def frontier_html(spark, d):
    items = load(spark, d, "page_items").where("raw_html is not null")
    found = items.select("url", F.explode(html.html_links(F.col("raw_html"))).alias("a")).select("url", F.col("a.href").alias("href"))
    visited = load(spark, d, "pages").select(F.col("normalized_url").alias("url"))
    return crawl.expand_frontier(found, visited, ["news.yunheng.example", "lib.yunheng.example", "jwc.yunheng.example"])


@query
def crawl_depths(spark, d):
    items = load(spark, d, "page_items").where("raw_html is not null")
    pages = items.select(urls.normalize_url(F.col("url")).alias("url"), html.html_links(F.col("raw_html"))["href"].alias("hrefs"))
    start = load(spark, d, "pages").where("id % 50 = 0").select("url")
    return crawl.crawl(start, pages, ["news.yunheng.example", "lib.yunheng.example", "jwc.yunheng.example"], 2)


@query
def crawl_seeds(spark, d):
    return crawl.seeds(sites(spark))


@query
def crawl_plan(spark, d):
    return crawl.plan_batches(sites(spark).select(F.col("site").alias("name"), F.col("site").alias("source_site"), "max_pages"))


@query
def sites_of_urls(spark, d):
    return crawl.site_of_url(load(spark, d, "pages").select("id", "url"), sites(spark)).select("id", "site")


# --- crawl and ingest -----------------------------------------------------------------------


@query
def items_roundtrip(spark, d):
    """The crawl items written as JSON lines and read again."""
    items = load(spark, d, "page_items")
    path = f"{shared_dir(spark).rstrip('/')}/items-{uuid.uuid4().hex}"
    jsonl.write_items(items.select(*html.ITEM_TYPE.names), path)
    good, rejects = jsonl.read_items(spark, path)
    rows = good.select("url", "title", F.length("content").alias("chars"), "content_hash", F.size("out_links").alias("links"), "publish_time", "status_code", F.size("present").alias("keys"), F.lit("item").alias("kind"))
    return rows.unionByName(rejects.select(F.col("value").alias("url"), F.lit("reject").alias("kind")), allowMissingColumns=True)


@query
def snapshot_files(spark, d):
    """One page of each address as a file, read again below its folder."""
    pages = load(spark, d, "page_items").where("raw_html <> '' and url is not null").groupBy("url").agg(F.max_by("raw_html", "item_id").alias("raw_html"))
    root = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    written = files.write_snapshot_files(pages, root)
    back = files.confined(files.read_snapshots(spark, root)).select(F.col("path").alias("snapshot_path"), F.sha2("html", 256).alias("hash"))
    return written.join(back, "snapshot_path").select("url", "snapshot_path", "bytes", "hash")


@query
def distinct_links(spark, d):
    links = text.first_occurrences(F.col("out_links"))
    return load(spark, d, "page_items").select("item_id", F.size(links).alias("links"), F.get(links, 0).alias("first"))


@query
def site_page_caps(spark, d):
    return crawl.page_cap(load(spark, d, "pages").select("id", "source_site"), "source_site", "id", 5)


@query
def crawl_stats(spark, d):
    return crawl.crawl_stats(load(spark, d, "page_items"), 12.5, urls.skipped_path(F.col("url")) | (F.col("status_code") >= 400))


@query
def site_yield(spark, d):
    return crawl.site_yield(load(spark, d, "page_items"))


@query
def ingest_decide(spark, d):
    return ingest.decide(recrawl(spark, d), load(spark, d, "pages").select("normalized_url", "content_hash")).select("line_no", "action")


@query
def ingest_force(spark, d):
    return ingest.action_stats(ingest.decide(recrawl(spark, d), load(spark, d, "pages").select("normalized_url", "content_hash"), force=True))


@query
def ingest_upsert(spark, d):
    stored = load(spark, d, "pages").select("normalized_url", "title", "content_hash", "category")
    decided = ingest.decide(recrawl(spark, d), stored.select("normalized_url", "content_hash"))
    return ingest.upsert(stored, decided, ["title", "content_hash", "category"])


@query
def ingest_new_ids(spark, d):
    stored = load(spark, d, "pages")
    decided = ingest.decide(recrawl(spark, d), stored.select("normalized_url", "content_hash"))
    new = decided.where("action = 'insert'").groupBy("normalized_url").agg(F.min("line_no").alias("first_line"))
    return ingest.assign_ids(new, stored)


@query
def ingest_stats(spark, d):
    return ingest.action_stats(ingest.decide(recrawl(spark, d), load(spark, d, "pages").select("normalized_url", "content_hash")))


@query
def ingest_first_lines(spark, d):
    first = ingest.first_lines(recrawl(spark, d), 200)
    return ingest.decide(first, load(spark, d, "pages").select("normalized_url", "content_hash")).select("line_no", "action")


@query
def ingest_reindexed(spark, d):
    decided = ingest.decide(recrawl(spark, d), load(spark, d, "pages").select("normalized_url", "content_hash"))
    return ingest.reindexed(decided).groupBy("normalized_url").agg(F.max("line_no").alias("last_line"))


@query
def ingest_dry_run(spark, d):
    return ingest.dry_run(load(spark, d, "page_items"))


@query
def dedupe_content(spark, d):
    items = load(spark, d, "page_items").where("content is not null and content <> ''")
    return items.groupBy(urls.content_hash(F.col("content")).alias("hash")).agg(F.count("*").alias("cnt"), F.min("item_id").alias("first_id")).where("cnt > 1")


def _found_attachments(spark, d):
    items = load(spark, d, "page_items").select("item_id", "attachment_links")
    links = ingest.explode_attachments(items).where("file_url is not null")
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return links.join(texts, "item_id", "left").select("item_id", "pos", "file_url", urls.normalize_url(F.col("file_url")).alias("normalized_file_url"), (F.col("item_id") % 7 != 0).alias("downloaded"), "text")


@query
def attachment_states(spark, d):
    states = ingest.attachment_states(_found_attachments(spark, d), load(spark, d, "attachments").select("normalized_file_url", "parse_status"))
    return states.select("item_id", "pos", "step")


@query
def attachment_stats(spark, d):
    return ingest.attachment_stats(ingest.attachment_states(_found_attachments(spark, d), load(spark, d, "attachments").select("normalized_file_url", "parse_status")))


@query
def attachment_dry_run(spark, d):
    return ingest.attachment_dry_run(ingest.attachment_states(_found_attachments(spark, d), load(spark, d, "attachments").select("normalized_file_url", "parse_status")))


def _decided_attachments(spark, d):
    rows = ingest.attachment_rows(load(spark, d, "page_items").select("item_id", "title", "attachment_links"))
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("item_id"), urls.content_hash(F.col("text")).alias("content_hash"))
    stored = load(spark, d, "attachments").select("normalized_file_url", "content_hash")
    return ingest.decide(rows.join(texts, "item_id", "left"), stored, key="normalized_file_url")


@query
def attachment_decide(spark, d):
    return _decided_attachments(spark, d).select("item_id", F.col("line_no.pos").alias("pos"), "action")


@query
def attachment_upsert(spark, d):
    stored = load(spark, d, "attachments").select("normalized_file_url", F.col("parent_title").alias("title"), "content_hash").where("normalized_file_url <> ''")
    return ingest.upsert(stored, _decided_attachments(spark, d), ["title", "content_hash"], key="normalized_file_url")


@query
def document_details(spark, d):
    a = attachment_docs(spark, d)
    parents = load(spark, d, "pages").select(F.col("id").alias("parent_page_id"), F.col("title").alias("page_title"))
    return a.join(parents, "parent_page_id", "left").select("attachment_id", F.coalesce("page_title", "parent_title").alias("parent"), F.length("file_text").alias("text_length"), F.length(text.preview(F.col("file_text"))).alias("preview_length"))


@query
def get_many(spark, d):
    candidates = load(spark, d, "page_links").select(F.col("id").alias("page_id")).distinct()
    return search.get_many(page_docs(spark, d), candidates, "page_id", ["title", "anchor_text"])
