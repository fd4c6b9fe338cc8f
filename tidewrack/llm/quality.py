"""Per-document text quality statistics, repetition included, and rules to tell prose from the rest.

One pass over whole texts in Arrow batches; the only broadcast is the table of
common words, which must hold at most ``MAX_COMMON`` of them.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.runtime import spread

MAX_COMMON = 1_000_000
ENDINGS = frozenset(".!?…”»")
_SYMBOL = regex.compile(r"[^\p{L}\p{N}\s]")
_SPLIT = re.compile(r"[^ \t\n]+")
_EDGE = regex.compile(r"^\P{L}+|\P{L}+$")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_BULLET = re.compile(r"(?:[-*•–·]|\d{1,3}[.)])\s")

#: The first five are the basic statistics, the others tell lists and repetition.
BASIC = 5
FIELDS = [
    ("n_words", "bigint", pa.int64()),
    ("mean_word_length", "double", pa.float64()),
    ("symbol_share", "double", pa.float64()),
    ("ending_share", "double", pa.float64()),
    ("common_share", "double", pa.float64()),
    ("n_lines", "bigint", pa.int64()),
    ("bullet_share", "double", pa.float64()),
    ("short_line_share", "double", pa.float64()),
    ("duplicate_line_share", "double", pa.float64()),
    ("duplicate_paragraph_share", "double", pa.float64()),
    ("top_2gram_share", "double", pa.float64()),
    ("top_3gram_share", "double", pa.float64()),
    ("top_4gram_share", "double", pa.float64()),
]


def bare(word: str) -> str:
    """Lower-cased word without non-letters at both ends."""
    word = word.lower()
    return word if word.isalpha() else _EDGE.sub("", word)


def statistics(text: str, common: frozenset[str], repetition: bool = True) -> tuple:
    """The values of ``FIELDS`` for one text, the basic ones only without ``repetition``; shares of nothing are 0."""
    words = _SPLIT.findall(text)
    n = len(words)
    letters = sum(map(len, words))
    lines = [s for x in text.split("\n") if (s := x.strip())]
    solid = sum(len(x) for x in text.split())
    if n:
        known: dict[str, bool] = {}
        hits = 0
        for w in words:
            hit = known.get(w)
            if hit is None:
                hit = known[w] = bare(w) in common
            hits += hit
    else:
        hits = 0
    m = len(lines)
    basic = (
        n,
        letters / n if n else 0.0,
        len(_SYMBOL.findall(text)) / solid if solid else 0.0,
        sum(x[-1] in ENDINGS for x in lines) / m if m else 0.0,
        hits / n if n else 0.0,
    )
    if not repetition:
        return basic
    grams = []
    for k in (2, 3, 4):
        if n <= k:
            grams.append(0.0)
            continue
        (top, times), = Counter(zip(*(words[i:] for i in range(k)))).most_common(1)
        grams.append(min(1.0, times * sum(map(len, top)) / letters) if times > 1 else 0.0)
    paragraphs = [p for x in _PARAGRAPH.split(text) if (p := x.strip())]
    return (
        *basic,
        m,
        sum(_BULLET.match(x) is not None for x in lines) / m if m else 0.0,
        sum(len(x) < 40 for x in lines) / m if m else 0.0,
        1 - len(set(lines)) / m if m else 0.0,
        1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
        *grams,
    )


def common_set(words: DataFrame) -> frozenset[str]:
    """The distinct words of a table with a ``word`` column; more than ``MAX_COMMON`` are an error."""
    rows = words.where("word is not null").select("word").distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return frozenset(r.word for r in rows)


def quality_stats(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", repetition: bool = True) -> DataFrame:
    """(id, the values of ``FIELDS``, or of the basic ones) of each row with a non-null text; null texts are left out."""
    fields = FIELDS if repetition else FIELDS[:BASIC]
    vocabulary = docs.sparkSession.sparkContext.broadcast(common_set(common))

    def run(batches):
        for b in batches:
            rows = [statistics(t, vocabulary.value, repetition) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, (_, _, kind) in zip(cols, fields))], names=[id_col, *(f[0] for f in fields)])

    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, " + ", ".join(f"{name} {sql}" for name, sql, _ in fields)
    return spread(docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)).mapInArrow(run, schema)


def faults() -> Column:
    """How many of the five basic rules a document breaks (a text without words breaks all)."""
    rules = [
        F.col("n_words") < 20,
        (F.col("mean_word_length") < 3) | (F.col("mean_word_length") > 9),
        F.col("symbol_share") > 0.15,
        F.col("ending_share") < 0.3,
        F.col("common_share") < 0.15,
    ]
    total = F.lit(0)
    for r in rules:
        total = total + r.cast("int")
    return F.when(F.col("n_words") == 0, 5).otherwise(total)


def text_kind() -> Column:
    """``junk``, ``list``, ``repetitive`` or ``prose`` by the basic and the repetition rules together."""
    repeats = (F.col("duplicate_line_share") > 0.3) | (F.col("duplicate_paragraph_share") > 0.3) | (F.col("top_2gram_share") > 0.2) | (F.col("top_3gram_share") > 0.18) | (F.col("top_4gram_share") > 0.16)
    listed = (F.col("n_lines") > 2) & ((F.col("bullet_share") > 0.5) | ((F.col("short_line_share") > 0.8) & (F.col("ending_share") < 0.5)))
    return F.when((F.col("n_words") == 0) | ((faults() >= 2) & ~listed), "junk").when(listed, "list").when(repeats, "repetitive").otherwise("prose")
