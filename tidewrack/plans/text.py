"""Queries: preprocessing, tokens, term frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import html, text
from tidewrack.functions.text import MIN_TOKEN_LENGTH, STOPWORDS
from tidewrack.operators import term_frequency as tf
from tidewrack.runtime import spread, table
from tidewrack.sources.corpus import document_texts

TERMS = ["index", "Query", "bucket", "href", "no-such-term"]
TOP = 100


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))


def tf_top_k(spark, d):
    return tf.top_k(tf.term_frequencies(_docs(spark, d)), TOP)


def tf_first_seen(spark, d):
    return tf.top_k(tf.first_seen_frequencies(_docs(spark, d)), TOP)


def tf_stats(spark, d):
    return tf.statistics(tf.term_frequencies(_docs(spark, d)))


def tf_lookup(spark, d):
    return tf.lookup(tf.term_frequencies(_docs(spark, d)), TERMS)


def tf_stopword_filter(spark, d):
    tokens = _docs(spark, d).select("doc_id", text.raw_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("before"), F.size(F.filter("t", lambda t: text.keep_token(t))).cast("bigint").alias("after"))


def word_tokens(spark, d):
    return _docs(spark, d).select("doc_id", text.word_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def char_ngrams_count(spark, d):
    grams = _docs(spark, d).select("doc_id", text.char_ngrams(F.col("text")).alias("g"))
    return grams.select("doc_id", F.size("g").cast("bigint").alias("ngrams"), F.size(F.array_distinct("g")).cast("bigint").alias("distinct_ngrams"))


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


def truncate_text(spark, d):
    return _docs(spark, d).select("doc_id", F.length(text.truncate(F.col("text"))).cast("bigint").alias("n"), F.md5(text.truncate(F.col("text"))).alias("text_md5"))


def snippet(spark, d):
    return _docs(spark, d).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def warc_documents(spark, d):
    return document_texts(spread(table(spark, d, "warc_document_texts").select("record_id", "rec_type", "payload")), only_markup=True).select("record_id", "text")


def clean_html(spark, d):
    pages = spread(table(spark, d, "save_html_handler").select("page_id", "html"))
    return pages.select("page_id", html.clean_html(F.col("html")).alias("cleaned"))


def preprocess_pages(spark, d):
    pages = spread(table(spark, d, "save_html_handler").select("page_id", "html"))
    return pages.select("page_id", html.preprocess_html(F.col("html")).alias("text"))


def queries() -> dict:
    named = [tf_top_k, tf_first_seen, tf_stats, tf_lookup, tf_stopword_filter, word_tokens, char_ngrams_count, normalize_text, truncate_text, snippet, warc_documents, clean_html, preprocess_pages]
    return {f.__name__: f for f in named}


_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
RAW_TOKENS = "regexp_extract_all(lower(text), '[a-zA-Z0-9]+')"
KEPT_TOKENS = f"list_filter({RAW_TOKENS}, lambda x: x NOT IN {_STOP} AND length(x) >= {MIN_TOKEN_LENGTH})"
TF = f"SELECT term, count(*) AS tf FROM (SELECT unnest({KEPT_TOKENS}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term"
PADDED = "' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9 ]+', '', 'g'), ' +', ' ', 'g'), ' ') || ' '"
GRAMS = "list_concat(regexp_extract_all(p, '.{3}'), list_concat(regexp_extract_all(p[2:], '.{3}'), regexp_extract_all(p[3:], '.{3}')))"
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"('{t.lower()}')" for t in TERMS)
    return {
        "tf_top_k": f"SELECT term, tf FROM ({TF}) ORDER BY tf DESC, term LIMIT {TOP}",
        "tf_first_seen": f"""
            WITH t AS (SELECT doc_id AS d, {KEPT_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
            x AS (SELECT d, unnest(w) AS term, unnest(range(len(w))) AS p FROM t)
            SELECT term, count(*) AS tf, min(struct_pack(d := d, p := p)).d AS first_doc, min(struct_pack(d := d, p := p)).p::INT AS first_pos
            FROM x GROUP BY term ORDER BY tf DESC, first_doc, first_pos LIMIT {TOP}""",
        "tf_stats": f"SELECT count(*) AS vocabulary_size, sum(tf)::BIGINT AS total_tokens FROM ({TF})",
        "tf_lookup": f"SELECT v.term, coalesce(t.tf, 0) AS tf FROM (VALUES {values}) v(term) LEFT JOIN ({TF}) t ON v.term = t.term",
        "tf_stopword_filter": f"SELECT doc_id, len({RAW_TOKENS}) AS before, len({KEPT_TOKENS}) AS after FROM documents WHERE text IS NOT NULL",
        "word_tokens": f"SELECT doc_id, len({KEPT_TOKENS}) AS tokens, md5(array_to_string({KEPT_TOKENS}, ' ')) AS tokens_md5 FROM documents WHERE text IS NOT NULL",
        "char_ngrams_count": f"SELECT doc_id, len({GRAMS}) AS ngrams, len(list_distinct({GRAMS})) AS distinct_ngrams FROM (SELECT doc_id, {PADDED} AS p FROM documents WHERE text IS NOT NULL)",
        "normalize_text": r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '(http|www)\S+', ' ', 'g'), '[^a-zA-Z]+', ' ', 'g'), ' ') AS normalized FROM documents WHERE text IS NOT NULL",
        "truncate_text": "SELECT doc_id, length(substr(text, 1, 20000)) AS n, md5(substr(text, 1, 20000)) AS text_md5 FROM documents WHERE text IS NOT NULL",
        "snippet": f"SELECT doc_id, CASE WHEN length({_FLAT}) > 350 THEN substr({_FLAT}, 1, 350) || '...' ELSE {_FLAT} END AS snippet FROM documents WHERE text IS NOT NULL",
        "warc_documents": "SELECT record_id, text FROM warc_document_texts WHERE rec_type = 'response' AND payload <> '' AND NOT starts_with(payload, '%PDF-')",
    }
