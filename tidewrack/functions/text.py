"""Text functions: Column to Column, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markup and boilerplate words that are no terms, and the limits of the corpus.
STOPWORDS = """
    ajax amp br charset col com const csrf css div doctype gif gt hr href html http https iframe img jpeg jpg jquery js
    json let lt meta nav nbsp net noscript org params png quot rel rss src svg td th tr utf var webp www xml
""".split()
WORD_PATTERN = "[a-zA-Z0-9]+"
MIN_TOKEN_LENGTH = 2
MAX_TEXT_CHARS = 20_000
NGRAM = 3
SNIPPET_CHARS = 350


def collapse(text: Column) -> Column:
    """Runs of Unicode whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\x85]+", " "))


def normalize_text(text: Column) -> Column:
    """Lower-case words of ASCII letters: URLs, digits and all other characters become spaces."""
    plain = F.regexp_replace(F.lower(text), r"(?U)(?:http|www)[^\s\x1c-\x1f]+", " ")
    return F.trim(F.regexp_replace(plain, "[^a-zA-Z]+", " "))


def truncate(text: Column, limit: int = MAX_TEXT_CHARS) -> Column:
    return F.substring(text, 1, limit)


def snippet(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    """The beginning of a text on one line, with ``...`` where something was cut off."""
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def raw_tokens(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """All matches of ``pattern`` in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def keep_token(token: Column, min_length: int = MIN_TOKEN_LENGTH) -> Column:
    return ~token.isin(STOPWORDS) & (F.length(token) >= min_length)


def word_tokens(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """Tokens without stopwords and without single characters."""
    return F.filter(raw_tokens(text, pattern), lambda t: keep_token(t))


def padded(text: Column, normalize_whitespace: bool = True) -> Column:
    """Lower-cased letters, digits and spaces only, with a space at both ends."""
    kept = F.regexp_replace(F.lower(text), "[^a-zA-Z0-9 ]+", "")
    if normalize_whitespace:
        kept = F.trim(F.regexp_replace(kept, " +", " "))
    return F.concat(F.lit(" "), kept, F.lit(" "))


def char_ngrams(text: Column, n: int = NGRAM, normalize_whitespace: bool = True) -> Column:
    """Character n-grams with repetitions; characters that don't count are deleted, not replaced.

    A look-ahead finds the overlapping windows in one linear pass.
    """
    if n < 2:
        raise ValueError("n must be at least 2")
    return F.regexp_extract_all(padded(text, normalize_whitespace), F.lit(f"(?=(.{{{n}}}))"), F.lit(1))


def ngram_set(text: Column, n: int = NGRAM) -> Column:
    return F.array_distinct(char_ngrams(text, n))
