"""Exact global term frequencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import word_tokens

Tokenizer = Callable[[Column], Column]


def term_frequencies(docs: DataFrame, text: str = "text", tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """(``term``, ``tf``): occurrences of each token over all documents; null texts have none.

    Tokens are counted where they are read (partial aggregate), so frequent terms
    don't skew the shuffle.
    """
    tokens = docs.where(F.col(text).isNotNull()).select(F.explode(tokenizer(F.col(text))).alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("tf"))


def first_seen_frequencies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """(``term``, ``tf``, ``first_doc``, ``first_pos``) with the place where a term first occurs."""
    tokens = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.posexplode(tokenizer(F.col(text))).alias("p", "term"))
    seen = tokens.groupBy("term", "d").agg(F.count("*").alias("n"), F.min("p").alias("p")).groupBy("term").agg(F.sum("n").alias("tf"), F.min(F.struct("d", "p")).alias("at"))
    return seen.select("term", "tf", F.col("at.d").alias("first_doc"), F.col("at.p").alias("first_pos"))


def top_k(tf: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms; ties by first occurrence where it is known, else by term."""
    ties = ["first_doc", "first_pos"] if "first_doc" in tf.columns else ["term"]
    return tf.orderBy(F.desc("tf"), *ties).limit(k)


def lookup(tf: DataFrame, terms: list[str]) -> DataFrame:
    """(``term``, ``tf``) of the given terms, lower-cased; unknown ones have 0."""
    asked = tf.sparkSession.createDataFrame([(t.lower(),) for t in terms], "term string").distinct()
    return asked.join(tf.select("term", "tf"), "term", "left").select("term", F.coalesce("tf", F.lit(0)).alias("tf"))


def statistics(tf: DataFrame) -> DataFrame:
    """One row: ``vocabulary_size``, ``total_tokens``."""
    return tf.agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total_tokens"))
