"""Queries: links, fetch metadata, page sink, breadth-first reach, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.urls import authority, extract_links, normalize_url, url_key
from tidewrack.operators import term_frequency
from tidewrack.runtime import spread, table
from tidewrack.sources.corpus import SAVED_PAGES, saved_pages
from tidewrack.streaming import crawl, state


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "save_html_handler").where("html is not null and url is not null").select("page_id", "url", "html"))


def page_links(spark, d):
    pages = _pages(spark, d)
    return pages.select("page_id", F.explode(extract_links(F.col("html"), F.col("url"))).alias("link"))


def normalized_urls(spark, d):
    f = table(spark, d, "fetch_info").where("url is not null and parent_url is not null").select("fetch_id", "url", "parent_url")
    return spread(f).select("fetch_id", normalize_url(F.col("url"), F.col("parent_url")).alias("normalized"))


def url_domains(spark, d):
    f = table(spark, d, "fetch_info").where("url is not null")
    return f.groupBy(authority(F.col("url")).alias("domain")).agg(F.count("*").alias("fetches"))


def html_fetches(spark, d):
    f = table(spark, d, "fetch_info")
    return f.where(crawl.is_html(F.col("content_type"))).groupBy("http_status").agg(F.count("*").alias("fetches"))


def fetch_metadata(spark, d):
    pages = _pages(spark, d).select("page_id", F.col("url"), F.col("url").alias("final_url"), F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("depth"), F.lit(0.0).alias("discover_timestamp"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.length("html").cast("bigint").alias("content_length"), F.lit(0).cast("bigint").alias("response_time_ms"), extract_links(F.col("html"), F.col("url")).alias("links"))
    out = crawl.fetch_info(pages)
    return out.select("url", "content_length", F.col("out_links_count").cast("bigint").alias("out_links_count"), F.array_join("out_links", " ").alias("out_links"))


def save_manifest(spark, d):
    return saved_pages(table(spark, d, "save_html_handler").where("html is not null"), ["page_id"]).select("page_id", "file_id", "url")


def crawl_bfs(spark, d):
    """All URLs without a parent are seeds; ends when nothing new is reached."""
    f = table(spark, d, "fetch_info").where("url is not null")
    edges = f.select(url_key(F.col("url")).alias("src"), F.explode("out_links").alias("link")).select("src", url_key(F.col("link")).alias("dst"))
    seeds = f.where("coalesce(parent_url, '') = ''").select(url_key(F.col("url")).alias("url"))
    return crawl.reach(edges, seeds, None)


def crawl_bfs_all(spark, d):
    """The name that the whole walk had beside a limited one."""
    return crawl_bfs(spark, d)


def crawl_saved_pages(spark, d):
    """A crawl whose network is the table of saved pages."""
    pages = table(spark, d, "save_html_handler").where("url is not null and html is not null").select("url", "html")
    seeds = pages.select("url").distinct().select("url", F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("depth"), F.lit(0.0).alias("discover_timestamp"))
    out = crawl.crawl(seeds, crawl.table_fetcher(pages))
    return out.select("requested_url", "url", "depth", "http_status", "out_links_count")


def stream_dedupe_events(spark, d):
    source = table(spark, d, "events")
    stream = state.read_stream(spark, f"{d}/events.parquet*", source.schema).select("user_id", "event_type")
    kept = state.run_to_table(state.dedupe(stream, ["user_id", "event_type"]), f"dedupe-{_tag()}")
    return kept.groupBy("event_type").agg(F.count("*").alias("users"))


def stream_term_frequencies(spark, d):
    source = table(spark, d, "documents").select("doc_id", "text")
    stream = state.read_stream(spark, f"{d}/documents.parquet*", source.schema)
    return term_frequency.top_k(state.run_to_table(state.term_frequencies(stream), f"tf-{_tag()}", "complete"), 100)


def _tag() -> str:
    return uuid.uuid4().hex


def queries() -> dict:
    named = [page_links, normalized_urls, url_domains, html_fetches, fetch_metadata, save_manifest, crawl_bfs, crawl_saved_pages, stream_dedupe_events, stream_term_frequencies]
    return {f.__name__: f for f in named}


def _key(x: str) -> str:
    return f"regexp_replace(split_part({x}, '#', 1), '/+$', '')"


_RESOLVED = r"CASE WHEN h LIKE '#%' OR h = '' THEN split_part(url, '#', 1) ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || split_part(h, '#', 1) END"
_LINKS = f"""SELECT DISTINCT page_id, url, regexp_replace({_RESOLVED}, '/+$', '') AS link
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href=["'']([^"'']*)["'']', 1)) AS h FROM save_html_handler WHERE html IS NOT NULL AND url IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    from tidewrack.plans.text import TF

    return {
        "page_links": f"SELECT page_id, link FROM ({_LINKS})",
        "url_domains": "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS domain, count(*) AS fetches FROM fetch_info WHERE url IS NOT NULL GROUP BY 1",
        "html_fetches": "SELECT http_status, count(*) AS fetches FROM fetch_info WHERE contains(lower(content_type), 'text/html') GROUP BY 1",
        "fetch_metadata": f"""WITH l AS (SELECT page_id, count(*) AS n, array_to_string(list(link ORDER BY link)[1:50], ' ') AS links FROM ({_LINKS}) GROUP BY page_id)
            SELECT url, length(html) AS content_length, coalesce(n, 0) AS out_links_count, coalesce(links, '') AS out_links FROM save_html_handler s LEFT JOIN l USING (page_id) WHERE html IS NOT NULL AND url IS NOT NULL""",
        "save_manifest": f"SELECT page_id, md5(url) AS file_id, url FROM save_html_handler WHERE html IS NOT NULL AND url IS NOT NULL ORDER BY page_id LIMIT {SAVED_PAGES}",
        "crawl_bfs": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT {_key('url')} AS src, {_key('link')} AS dst FROM (SELECT url, unnest(out_links) AS link FROM fetch_info WHERE url IS NOT NULL) WHERE link IS NOT NULL),
            r(url, depth) USING KEY (url) AS (SELECT DISTINCT {_key('url')} AS url, 0 AS depth FROM fetch_info WHERE coalesce(parent_url, '') = '' AND url IS NOT NULL
              UNION SELECT e.dst, min(r.depth) + 1 FROM r JOIN e ON r.url = e.src WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS known WHERE known.url = e.dst) GROUP BY e.dst)
            SELECT url, depth::INT AS depth FROM r""",
        "stream_dedupe_events": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
        "stream_term_frequencies": f"SELECT term, tf FROM ({TF}) ORDER BY tf DESC, term LIMIT 100",
    }
