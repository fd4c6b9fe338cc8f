"""The crawl frontier: level-synchronous breadth-first search, and streams.

A crawl feeds its output back into its input, which one streaming query can't
express; each level is a batch (or a micro-batch) over the frontier, and the
seen-set is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.urls import authority, extract_links
from tidewrack.runtime import stage, stage_counted

MAX_OUT_LINKS = 50
#: Levels after which those found so far are written as one table, so that a deep walk's plan stays short.
MERGE_EVERY = 16
ITEM = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("parent_url", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("discover_timestamp", T.DoubleType()),
    ]
)
#: A fetcher adds ``final_url``, ``html``, ``http_status``, ``content_type``, ``content_length`` and ``response_time_ms`` to rows with ``url``.
Fetcher = Callable[[DataFrame], DataFrame]


def frontier(spark: SparkSession, urls: list[str], now: float = 0.0) -> DataFrame:
    """Seed items: depth 0, no parent. An empty URL is an error."""
    if any(not u for u in urls):
        raise ValueError("seeds must be URLs")
    return spark.createDataFrame([(u, None, 0, now) for u in urls], ITEM)


def decode_items(queue: DataFrame, value: str = "value", now: float = 0.0) -> DataFrame:
    """Frontier items of JSON strings; missing fields get defaults, and a string that is no JSON object is a bare URL."""
    item = F.from_json(F.col(value), ITEM, {"mode": "PERMISSIVE"})
    parsed = queue.select(F.col(value).alias("_raw"), item.alias("i"))
    # Text that is JSON but no object (a number, a quoted string, a list) is taken as it stands too.
    is_object = F.startswith(F.ltrim("_raw"), F.lit("{")) & F.get_json_object("_raw", "$").isNotNull()
    url = F.coalesce("i.url", F.when(~is_object, F.col("_raw")))
    return parsed.select(url.alias("url"), F.col("i.parent_url").alias("parent_url"), F.coalesce("i.depth", F.lit(0)).alias("depth"), F.coalesce("i.discover_timestamp", F.lit(now)).alias("discover_timestamp")).where("url is not null")


def encode_items(items: DataFrame) -> DataFrame:
    return items.select(F.to_json(F.struct("url", "parent_url", "depth", "discover_timestamp")).alias("value"))


def seeded(queue: DataFrame, seeds: DataFrame) -> DataFrame:
    """The queue's items, or the seeds if it has none."""
    first = queue.limit(1).select(F.lit(1).alias("_any"))
    return queue.unionByName(seeds.join(first, how="left_anti"))


def table_fetcher(pages: DataFrame) -> Fetcher:
    """A fetcher over a table (``url``, ``html``): what isn't there failed with status -1."""
    known = pages.where("url is not null").groupBy("url").agg(F.min("html").alias("html"))

    def fetch(items: DataFrame) -> DataFrame:
        return items.join(known, "url", "left").select(
            items["*"],
            F.col("url").alias("final_url"),
            "html",
            F.when(F.col("html").isNull(), -1).otherwise(200).alias("http_status"),
            F.when(F.col("html").isNull(), "").otherwise("text/html").alias("content_type"),
            F.length("html").cast("bigint").alias("content_length"),
            F.lit(0).cast("bigint").alias("response_time_ms"),
        )

    return fetch


def is_html(content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))


def fetch_info(fetched: DataFrame, links: str = "links", now: float = 0.0, most: int = MAX_OUT_LINKS) -> DataFrame:
    """The metadata of fetched pages: 12 columns; ``out_links`` holds the first 50, ``out_links_count`` counts all."""
    return fetched.select(
        F.col("url").alias("requested_url"),
        F.col("final_url").alias("url"),
        "parent_url",
        "depth",
        "discover_timestamp",
        F.lit(now).alias("fetch_timestamp"),
        "http_status",
        "content_type",
        "content_length",
        "response_time_ms",
        F.size(links).alias("out_links_count"),
        F.slice(F.array_sort(links), 1, most).alias("out_links"),
    )


def crawl(seeds: DataFrame, fetch: Fetcher, allowed_domain: str | None = None, max_depth: int | None = None, strict_final_dedupe: bool = False, now: float = 0.0, handler: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Breadth-first crawl; returns the fetch metadata of all pages with html.

    It ends when a level finds nothing new, or after ``max_depth`` levels if given.
    A URL is fetched once, at its least depth (then by its least parent). The
    final URL is tested as well where it differs from the requested one; with
    ``strict_final_dedupe`` it is tested in any case, which drops every page that
    wasn't redirected. Error pages in html count as pages. ``handler`` gets each
    level's pages; an error in it doesn't end the crawl.
    """
    level = stage(seeds.select("url", "parent_url", "depth", "discover_timestamp"), "frontier")
    seen, done, depth = None, None, 0
    while max_depth is None or depth <= max_depth:
        depth += 1
        fresh = level.where("url is not null").groupBy("url").agg(F.min(F.struct("depth", F.coalesce("parent_url", F.lit("")).alias("p"), "parent_url", "discover_timestamp")).alias("m")).select("url", "m.parent_url", "m.depth", "m.discover_timestamp")
        if seen is not None:
            fresh = fresh.join(seen, "url", "left_anti")
        fetched, n = stage_counted(fetch(fresh), "fetched", rows=F.lit(1))
        if not n["rows"]:
            break
        asked = fetched.select("url") if seen is None else seen.unionAll(fetched.select("url"))
        if strict_final_dedupe:
            kept = fetched.join(asked.select(F.col("url").alias("final_url")), "final_url", "left_anti")
        else:
            moved = fetched.where("final_url <> url").join(asked.select(F.col("url").alias("final_url")), "final_url", "left_anti")
            first = moved.groupBy("final_url").agg(F.min("url").alias("url"))
            kept = fetched.where("final_url = url").unionByName(moved.join(first, ["final_url", "url"], "left_semi").select(*fetched.columns))
        seen = stage(asked.unionAll(fetched.select(F.col("final_url").alias("url"))).distinct(), "seen")
        pages = kept.where(F.col("html").isNotNull() & is_html(F.col("content_type"))).withColumn("links", extract_links(F.col("html"), F.col("final_url"), allowed_domain))
        pages = stage(pages, "pages")
        if handler is not None:
            try:
                handler(pages)
            except Exception as e:  # noqa: BLE001 - a sink's failure is reported and the crawl goes on
                print(f"page handler failed: {e}")
        info = fetch_info(pages, now=now)
        done = info if done is None else done.unionAll(info)
        level = pages.select(F.explode("links").alias("url"), F.col("final_url").alias("parent_url"), (F.col("depth") + 1).alias("depth"), F.lit(now).alias("discover_timestamp"))
    return done if done is not None else fetch_info(fetch(seeds.limit(0)).withColumn("links", F.array().cast("array<string>")), now=now)


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(``url``, ``depth``): nodes of a link graph within ``max_depth`` steps of the seeds (column ``url``); all that can be reached for None."""
    links = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("url"), F.col(dst).alias("to")).distinct()
    level = stage(seeds.where("url is not null").select("url").distinct().withColumn("depth", F.lit(0)), "level")
    all_ = level
    if max_depth is None:
        links = stage(links, "links")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = level.join(links, "url").select(F.col("to").alias("url")).distinct().join(all_.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        level, n = stage_counted(nxt, "level", rows=F.lit(1))
        if not n["rows"]:
            break
        all_ = all_.unionAll(level)
        if depth % MERGE_EVERY == 0:
            all_ = stage(all_, "reached")
    return all_


def default_domain(seed: str, spark: SparkSession) -> str | None:
    """Host and port of the seed, the crawl's domain where none is given."""
    return spark.range(1).select(authority(F.lit(seed)).alias("a")).first()["a"]
