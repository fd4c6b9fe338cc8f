"""Queries: count-min sketches and Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.urls import url_key
from tidewrack.operators import bloom, count_min
from tidewrack.operators import term_frequency as tf
from tidewrack.plans.text import TF, TERMS
from tidewrack.runtime import spread, stage, table
from tidewrack.sources.synthetic import absent_urls, random_urls

# The experiments' parameters.
WIDTHS = [(w, 7) for w in range(5_000, 30_001, 5_000)]
DEPTHS = [(20_000, d) for d in range(5, 11)]
ERROR_RATES = [(100_000, round(0.01 * p, 2), 2) for p in range(10, 0, -1)]
CAPACITIES = [(c, 0.001, 2) for c in range(25_000, 200_001, 25_000)]
EXPANSIONS = [(50_000, 0.001, x) for x in range(1, 6)]
K = count_min.EVALUATED_TERMS
URL_BLOOM = (2_000, 0.01, 2)


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return stage(tf.term_frequencies(spread(table(spark, d, "documents").where("text is not null").select("text"))), "tf")


def cms_cells(spark, d):
    return count_min.CountMin.build(_tf(spark, d)).cells


def cms_top_k_errors(spark, d):
    counts = _tf(spark, d)
    sketch = count_min.CountMin.build(counts)
    return sketch.estimate(tf.top_k(counts, K)).select("term", "tf", "estimate", (F.col("estimate") - F.col("tf")).alias("error"))


def cms_lookup(spark, d):
    return count_min.CountMin.build(_tf(spark, d)).lookup(TERMS)


def cms_total_updates(spark, d):
    return count_min.CountMin.build(_tf(spark, d)).total_updates()


def cms_stream_terms(spark, d):
    """The sketch of the stream of term updates, reference hash family: estimates of its most frequent terms."""
    terms = table(spark, d, "count_min_sketch").where("term is not null").groupBy("term").agg(F.sum(F.coalesce("cnt", F.lit(1))).alias("tf"))
    terms = stage(terms, "stream")
    sketch = count_min.CountMin.build(terms, family="xxh64")
    return sketch.estimate(tf.top_k(terms, 100))


def cms_stream_estimates(spark, d):
    """As ``cms_stream_terms`` with the other hash family."""
    updates = table(spark, d, "count_min_sketch").where("term is not null")
    terms = stage(updates.groupBy("term").agg(F.sum(F.coalesce("cnt", F.lit(1).cast("bigint"))).alias("tf")), "stream")
    return count_min.CountMin.build(terms).estimate(tf.top_k(terms, 100))


def _sweep(spark, d, configs):
    counts = _tf(spark, d)
    return count_min.error_summary(count_min.estimates_by_config(counts, tf.top_k(counts, K), configs))


def cms_width_sweep(spark, d):
    return _sweep(spark, d, WIDTHS)


def cms_depth_sweep(spark, d):
    return _sweep(spark, d, DEPTHS)


def cms_error_hist(spark, d):
    counts = _tf(spark, d)
    errors = count_min.estimates_by_config(counts, tf.top_k(counts, K), [(5_000, 7)]).where("error > 0")
    return count_min.error_histogram(stage(errors, "errors"))


def _inserts(spark, d):
    return table(spark, d, "fetch_info").where("url is not null").select("fetch_id", url_key(F.col("url")).alias("url"))


def bloom_bits(spark, d):
    return bloom.Bloom.build(_inserts(spark, d), "url", "fetch_id", [URL_BLOOM]).set_bits.select("layer", "bit")


def bloom_membership(spark, d):
    filter_ = bloom.Bloom.build(_inserts(spark, d), "url", "fetch_id", [URL_BLOOM])
    return filter_.contains(table(spark, d, "save_html_handler").select(url_key(F.col("url")).alias("url")), "url").select(F.col("key").alias("url"))


def bloom_fpr_sweep(spark, d):
    return bloom.measure(random_urls(spark, 60_000), absent_urls(spark, 50_000), ERROR_RATES)


def bloom_capacity_sweep(spark, d):
    return bloom.measure(random_urls(spark, 50_000), absent_urls(spark, 50_000), CAPACITIES)


def bloom_expansion_sweep(spark, d):
    return bloom.measure(random_urls(spark, 150_000), absent_urls(spark, 50_000), EXPANSIONS)


def url_dedupe_anti_join(spark, d):
    fetched = table(spark, d, "fetch_info").where("url is not null").select("url").distinct()
    return bloom.unseen(fetched, table(spark, d, "save_html_handler"), "url")


def url_dedupe_bloom(spark, d):
    filter_ = bloom.Bloom.build(table(spark, d, "save_html_handler").select("page_id", "url"), "url", "page_id", [(100_000, 0.001, 2)])
    fetched = table(spark, d, "fetch_info").where("url is not null").select("url").distinct()
    return bloom.maybe_unseen(fetched, filter_, "url")


def queries() -> dict:
    named = [cms_cells, cms_top_k_errors, cms_lookup, cms_total_updates, cms_stream_terms, cms_stream_estimates, cms_width_sweep, cms_depth_sweep, cms_error_hist, bloom_bits, bloom_membership, bloom_fpr_sweep, bloom_capacity_sweep, bloom_expansion_sweep, url_dedupe_anti_join, url_dedupe_bloom]
    return {f.__name__: f for f in named}


def _cells(width: int | str = 20_000, depth: int | str = 7) -> str:
    return f"""
        tf AS MATERIALIZED ({TF}),
        h AS MATERIALIZED (SELECT term, tf, i AS row, ('0x' || substr(md5(i::VARCHAR || term), 1, 15))::BIGINT AS h FROM tf, range(10) r(i)),
        cells AS (SELECT row, h % {width} AS cell, sum(tf)::BIGINT AS cnt FROM h WHERE row < {depth} GROUP BY 1, 2)"""


def _estimates(configs) -> str:
    values = ", ".join(f"({w}, {d})" for w, d in configs)
    return f"""
        {_cells()},
        c(width, depth) AS (VALUES {values}),
        top AS (SELECT term, tf FROM tf ORDER BY tf DESC, term LIMIT {K}),
        located AS MATERIALIZED (SELECT width, depth, row, h % width AS cell, term, tf FROM h, c WHERE row < depth),
        all_cells AS MATERIALIZED (SELECT width, depth, row, cell, sum(tf)::BIGINT AS cnt FROM located GROUP BY ALL),
        e AS (SELECT l.width, l.depth, l.term, l.tf, min(a.cnt) AS estimate, min(a.cnt) - l.tf AS error
          FROM located l JOIN top USING (term) JOIN all_cells a ON l.width = a.width AND l.depth = a.depth AND l.row = a.row AND l.cell = a.cell GROUP BY l.width, l.depth, l.term, l.tf)"""


def _summary(configs) -> str:
    return f"WITH {_estimates(configs)} SELECT width::INT AS width, depth::INT AS depth, round(avg(error), 6) AS avg_error, max(error) AS max_error, sum((error > 0)::INT)::BIGINT AS wrong_terms FROM e GROUP BY width, depth"


_KEY = "regexp_replace(split_part(url, '#', 1), '/+$', '')"


def _half(key: str, part: int = 0) -> str:
    return f"('0x' || substr(md5({key}), {1 + 16 * part}, 15))::BIGINT"


def _layer_values(configs, n_max: int) -> str:
    rows = [(i, x.number, x.first, x.last, x.bits, x.hashes) for i, c in enumerate(configs) for x in bloom.layers(n_max, *c)]
    return "(VALUES " + ", ".join(map(str, rows)) + ") l(config, layer, first, last, bits, hashes)"


def _bloom(inserts: str, configs, n_max: int) -> str:
    return f"""
        keys AS (SELECT key, row_number() OVER (ORDER BY min(born), key) - 1 AS rank FROM ({inserts}) GROUP BY key),
        layers AS (SELECT * FROM {_layer_values(configs, n_max)} WHERE first < greatest((SELECT count(*) FROM keys), 1)),
        bits AS MATERIALIZED (SELECT DISTINCT config, layer, ({_half('key')} % bits + i * ({_half('key', 1)} % bits)) % bits AS bit
          FROM keys JOIN layers ON rank >= first AND rank < last, range(64) r(i) WHERE i < hashes)"""


def _claimed(probes: str) -> str:
    return f"""
        asked AS (SELECT DISTINCT key FROM ({probes}) WHERE key IS NOT NULL),
        wanted AS MATERIALIZED (SELECT DISTINCT config, layer, key, ({_half('key')} % bits + i * ({_half('key', 1)} % bits)) % bits AS bit FROM asked, layers, range(64) r(i) WHERE i < hashes),
        claimed AS (SELECT DISTINCT w.config, w.key FROM (SELECT config, layer, key, count(*) AS need FROM wanted GROUP BY ALL) w
          JOIN (SELECT w.config, w.layer, w.key, count(*) AS hit FROM wanted w JOIN bits b ON w.config = b.config AND w.layer = b.layer AND w.bit = b.bit GROUP BY ALL) h
          ON w.config = h.config AND w.layer = h.layer AND w.key = h.key AND need = hit)"""


def _measured(n_insert: int, n_absent: int, configs) -> str:
    earlier = f"{_half("'ref' || i::VARCHAR")} % greatest(i, 1)"
    inserts = f"SELECT 'https://example.com/' || substr(md5('path' || (CASE WHEN i > 0 AND {_half("'dup' || i::VARCHAR")} % 1000 < 300 THEN {earlier} ELSE i END)::VARCHAR), 1, 12) AS key, i AS born FROM range({n_insert}) r(i)"
    probes = f"SELECT 'https://nonexistent.com/' || substr(md5('absent' || i::VARCHAR), 1, 12) AS key FROM range({n_absent}) r(i)"
    given = ", ".join(f"({i}, {c}, {p}::DOUBLE, {x})" for i, (c, p, x) in enumerate(configs))
    return f"""
        WITH {_bloom(inserts, configs, n_insert)}, {_claimed(probes)},
        c(config, capacity, error_rate, expansion) AS (VALUES {given})
        SELECT capacity::BIGINT AS capacity, error_rate, expansion::INT AS expansion, (SELECT count(*) FROM layers WHERE config = c.config)::INT AS layers,
          (SELECT sum((bits + 7) // 8) FROM layers WHERE config = c.config)::BIGINT AS memory_bytes,
          round((SELECT count(*) FROM claimed WHERE config = c.config) / {n_absent}.0::DOUBLE, 6) AS fpr FROM c"""


def oracle_sql() -> dict[str, str]:
    fetched = f"SELECT {_KEY} AS key, fetch_id AS born FROM fetch_info WHERE url IS NOT NULL"
    values = ", ".join(f"('{t.lower()}')" for t in TERMS)
    return {
        "cms_cells": f"WITH {_cells()} SELECT row::INT AS row, cell, cnt FROM cells",
        "cms_top_k_errors": f"WITH {_estimates([(20_000, 7)])} SELECT term, tf, estimate, error FROM e",
        "cms_lookup": f"""WITH {_cells()}, v AS (SELECT term, i AS row, ('0x' || substr(md5(i::VARCHAR || term), 1, 15))::BIGINT % 20000 AS cell FROM (VALUES {values}) x(term), range(7) r(i))
            SELECT v.term, min(coalesce(c.cnt, 0)) AS estimate FROM v LEFT JOIN cells c ON v.row = c.row AND v.cell = c.cell GROUP BY v.term""",
        "cms_total_updates": f"SELECT sum(tf)::BIGINT AS total_updates FROM ({TF})",
        "cms_stream_estimates": """
            WITH tf AS MATERIALIZED (SELECT term, sum(coalesce(cnt, 1))::BIGINT AS tf FROM count_min_sketch WHERE term IS NOT NULL GROUP BY term),
            h AS MATERIALIZED (SELECT term, tf, i AS row, ('0x' || substr(md5(i::VARCHAR || term), 1, 15))::BIGINT % 20000 AS cell FROM tf, range(7) r(i)),
            cells AS (SELECT row, cell, sum(tf)::BIGINT AS cnt FROM h GROUP BY 1, 2),
            top AS (SELECT term FROM tf ORDER BY tf DESC, term LIMIT 100)
            SELECT h.term, h.tf, min(c.cnt) AS estimate FROM h JOIN top USING (term) JOIN cells c ON h.row = c.row AND h.cell = c.cell GROUP BY h.term, h.tf""",
        "url_dedupe_bloom": f"""
            WITH {_bloom("SELECT url AS key, page_id AS born FROM save_html_handler WHERE url IS NOT NULL", [(100_000, 0.001, 2)], 10**7)},
            {_claimed("SELECT url AS key FROM fetch_info")}
            SELECT DISTINCT url FROM fetch_info WHERE url IS NOT NULL AND url NOT IN (SELECT key FROM claimed)""",
        "cms_width_sweep": _summary(WIDTHS),
        "cms_depth_sweep": _summary(DEPTHS),
        "cms_error_hist": f"""WITH {_estimates([(5_000, 7)])}, p AS (SELECT error FROM e WHERE error > 0),
            r AS (SELECT CASE WHEN min(error) = max(error) THEN min(error) - 0.5 ELSE min(error) END::DOUBLE AS a, CASE WHEN min(error) = max(error) THEN max(error) + 0.5 ELSE max(error) END::DOUBLE AS b FROM p)
            SELECT least(floor((error - a) * 60 / (b - a)), 59)::BIGINT AS bin, count(*) AS n FROM p, r GROUP BY 1""",
        "bloom_bits": f"WITH {_bloom(fetched, [URL_BLOOM], 10**7)} SELECT layer::INT AS layer, bit FROM bits",
        "bloom_membership": f"WITH {_bloom(fetched, [URL_BLOOM], 10**7)}, {_claimed(f'SELECT {_KEY} AS key FROM save_html_handler')} SELECT key AS url FROM claimed",
        "bloom_fpr_sweep": _measured(60_000, 50_000, ERROR_RATES),
        "bloom_capacity_sweep": _measured(50_000, 50_000, CAPACITIES),
        "bloom_expansion_sweep": _measured(150_000, 50_000, EXPANSIONS),
        "url_dedupe_anti_join": "SELECT DISTINCT url FROM fetch_info f WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM save_html_handler s WHERE s.url = f.url)",
    }
