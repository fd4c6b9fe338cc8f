"""Queries of the operators for training data: callables of (session, directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import encoding_repair, heavy_hitters, leakage, main_content, near_duplicates, neighbors, packing, quality, seen_keys
from tidewrack.runtime import table

SHARE = 1 / 500


def _duplicates(spark: SparkSession, d: str) -> near_duplicates.Duplicates:
    return near_duplicates.Duplicates(table(spark, d, "warc_document_texts"), "record_id", "text", similarity=0.7, shingle=3, min_words=30)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _duplicates(spark, d).record_pairs()


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    out = near_duplicates.Duplicates(table(spark, d, "warc_document_texts"), "record_id", "text").groups()
    return out.withColumnRenamed("id", "record_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(table(spark, d, "build_indices"), "vec_id", "emb_bt").select("vec_id_a", "vec_id_b")


def p3_knn(spark: SparkSession, d: str) -> DataFrame:
    out = neighbors.nearest(table(spark, d, "build_indices"), "vec_id", "emb_bt", k=5, query_every=100)
    return out.select("query_id", F.col("id").alias("vec_id"), "cosine", "rank")


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.recall_report(table(spark, d, "build_indices"), "vec_id", "emb_bt")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    count = F.coalesce("cnt", F.lit(1).cast("bigint"))
    return heavy_hitters.heavy_hitters(table(spark, d, "count_min_sketch"), heavy_hitters.term_item(), count, SHARE).withColumnRenamed("item", "term")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", "total", "estimate")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.seen_before(table(spark, d, "fetch_info"), "fetch_id", seen_keys.fetch_keys())


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.error_report(table(spark, d, "fetch_info"), "fetch_id", seen_keys.fetch_keys())


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return main_content.pages_of(table(spark, d, "save_html_handler"), table(spark, d, "warc_document_texts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.main_blocks(_pages(spark, d)).select("src", "rec_id", "block_md5").distinct()


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    return main_content.body_texts(_pages(spark, d))


def _repair(spark: SparkSession, d: str) -> encoding_repair.Repair:
    return encoding_repair.Repair(table(spark, d, "warc_document_texts").where("rec_type = 'response'"), "record_id", "payload")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _repair(spark, d).found().select("record_id")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return _repair(spark, d).restored()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _repair(spark, d).report()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents")).where("piece > 0").select("doc_id").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(packing.pack_documents(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _quality(spark: SparkSession, d: str, repetition: bool) -> DataFrame:
    return quality.quality_stats(table(spark, d, "documents"), table(spark, d, "common_words"), repetition=repetition)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d, False).where(quality.faults() >= 2).select("doc_id")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    out = _quality(spark, d, True)
    return out.withColumn("faults", quality.faults()).withColumn("kind", quality.text_kind())


def queries() -> dict:
    named = [p2_found, p2_groups, p3_found, p3_knn, p3_recall, p4_found, p4_counts, p5_found, p5_report, p6_found, p6_bodies, p7_found, p7_restored, p7_report, p8_found, p8_packed, p8_report, p9_found, p9_cleaned, p10_found, p10_stats]
    return {f.__name__: f for f in named}


_TERM_TOTALS = "SELECT trim(lower(term), ' ') AS term, sum(coalesce(cnt, 1)) AS total FROM count_min_sketch WHERE trim(lower(term), ' ') <> '' GROUP BY 1"
_WORDS = r"regexp_extract_all(text, '[^ \t\n]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"WITH t AS ({_TERM_TOTALS}) SELECT term FROM t WHERE total >= (SELECT sum(total) FROM t) / 500.0",
        "p5_found": r"""
            WITH k AS (
              SELECT fetch_id, regexp_replace(split_part(requested_url, '#', 1), '/+$', '') AS key FROM fetch_info
              UNION ALL SELECT fetch_id, regexp_replace(split_part(url, '#', 1), '/+$', '') FROM fetch_info
            ), m AS (SELECT key, min(fetch_id) AS first FROM k WHERE key IS NOT NULL GROUP BY key)
            SELECT DISTINCT k.fetch_id FROM k JOIN m ON k.key = m.key WHERE k.fetch_id > m.first""",
        "p8_found": "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[a-zA-Z0-9]+')) > 1024",
        "p9_found": r"""
            WITH d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(regexp_replace(text, '\p{Cf}', '', 'g'), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents),
            b AS (SELECT item_id AS id, list_transform(regexp_extract_all(regexp_replace(text, '\p{Cf}', '', 'g'), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM benchmark),
            dg AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
            bg AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM b WHERE len(w) >= 12)
            SELECT DISTINCT dg.id AS doc_id, bg.id AS item_id FROM dg JOIN bg USING (g)""",
        "p10_found": rf"""
            WITH c AS (SELECT list(DISTINCT word) AS words FROM common_words),
            a AS (SELECT doc_id, text, {_WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents WHERE text IS NOT NULL),
            s AS (
              SELECT doc_id, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS letters,
                length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS symbols, length(regexp_replace(text, '\s', '', 'g')) AS solid,
                len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?…”»]\s*$'))) AS ended,
                len(list_filter(w, lambda x: list_contains(c.words, regexp_replace(regexp_replace(lower(x), '^\P{{L}}+', ''), '\P{{L}}+$', '')))) AS common
              FROM a, c)
            SELECT doc_id FROM s
            WHERE n = 0 OR (n < 20)::INT + (letters * 1.0 / n < 3 OR letters * 1.0 / n > 9)::INT + (coalesce(symbols * 1.0 / nullif(solid, 0), 0) > 0.15)::INT
              + (coalesce(ended * 1.0 / nullif(n_lines, 0), 0) < 0.3)::INT + (common * 1.0 / n < 0.15)::INT >= 2""",
    }
