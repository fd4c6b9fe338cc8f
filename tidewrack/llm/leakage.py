"""Evaluation texts leaking into training text.

The n-grams of the (small) evaluation set go to all executors as a hash set; each
document is scanned once by a rolling window over its words. Words outside the
evaluation vocabulary break a window, so most documents are done after one
dictionary look-up a word. Hash hits are verified word by word.

The evaluation set is broadcast in blocks of at most ``MAX_WORDS`` words, so what
is sent has a bound however large the set is; a larger set takes more passes.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.runtime import spread

WORDS = 12
MAX_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_FORMAT = regex.compile(r"\p{Cf}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters or digits, lower-cased, after format characters are dropped."""
    if not text.isascii():
        text = _FORMAT.sub("", text)
        if "İ" in text:  # its lower case holds a mark, which would split a word
            return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * _BASE + ids[j : len(ids) - n + 1 + j]
            h ^= h >> np.uint64(29)
    return h


class Index:
    """Hash set of the n-grams of evaluation items."""

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        grams: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.uint64)
            if len(ids) >= n:
                for i, h in enumerate(_windows(ids, n).tolist()):
                    grams[h].append((item, tuple(ids[i : i + n].tolist())))
        self.grams = dict(grams)
        self.keys = np.array(sorted(self.grams), np.uint64)

    def find(self, text: str | None) -> dict[int, list[tuple[int, int]]]:
        """Items found, each with the spans (first word, one past the last) of ``text`` that it covers."""
        if not text or not len(self.keys):
            return {}
        known = self.vocabulary.get
        ids = np.array([known(w, 0) for w in words(text)], np.uint64)
        n = self.n
        if len(ids) < n:
            return {}
        gaps = np.cumsum(np.r_[0, ids == 0])
        whole = np.flatnonzero(gaps[n:] == gaps[:-n])
        if not len(whole):
            return {}
        h = _windows(ids, n)[whole]
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        found: dict[int, list[tuple[int, int]]] = {}
        for i, key in zip(whole[self.keys[at] == h].tolist(), h[self.keys[at] == h].tolist()):
            gram = tuple(ids[i : i + n].tolist())
            for item, own in self.grams[key]:
                if own == gram:
                    spans = found.setdefault(item, [])
                    if spans and spans[-1][1] >= i:
                        spans[-1] = (spans[-1][0], i + n)
                    else:
                        spans.append((i, i + n))
        return found


def _blocks(items: DataFrame, item_id: str, item_text: str, limit: int):
    """Lists of items of at most ``limit`` characters (a longer item stands alone)."""
    held, size = [], 0
    for r in items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(item_id, item_text).toLocalIterator():
        if held and size + len(r[1]) > limit:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc id, item id, ``words``, ``spans``): documents that hold ``n`` consecutive words of an item.

    ``words`` counts the document's words that belong to such passages. Null or
    short texts on either side match nothing; repeated rows are matched each;
    without items the result is empty.
    """
    spark = docs.sparkSession
    dk, ik = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"{doc_id} {dk}, {item_id} {ik}, words int, spans array<struct<first:int,last:int>>"
    base = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t")))
    out = None
    for block in _blocks(items, item_id, item_text, 2 * max_words):
        index = spark.sparkContext.broadcast(Index(block, n))

        def run(batches, index=index):
            kind = None
            for b in batches:
                ids, rows = b.column(0), []
                for k, t in zip(ids, b.column(1)):
                    for item, spans in index.value.find(t.as_py()).items():
                        rows.append((k.as_py(), item, sum(y - x for x, y in spans), [{"first": x, "last": y} for x, y in spans]))
                kind = kind or pa.schema([(doc_id, ids.type), (item_id, pa.int64() if ik == "bigint" else pa.string() if ik == "string" else pa.int32()), ("words", pa.int32()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of the given spans (and what lies between them)."""
    if text is None or not spans:
        return text
    clean = _FORMAT.sub("", text)
    at = [m.span() for m in _WORD.finditer(clean)]
    out, last = [], 0
    for first, end in sorted(spans):
        a, b = at[first][0], at[min(end, len(at)) - 1][1]
        if a >= last:
            out.append(clean[last:a])
        last = max(last, b)
    out.append(clean[last:])
    return "".join(out)


def decontaminate(docs: DataFrame, items: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """(``doc_id``, ``action``, ``removed_words``, ``text``) for the documents that hold passages of items.

    Passages are cut out; a document that consists of them by ``drop_share`` or
    more is to be dropped (``text`` null).
    """
    found = leaks(docs, items).select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.collect_set("s").alias("spans"))
    schema = "doc_id bigint, action string, removed_words int, text string"

    def run(frames):
        for f in frames:
            rows = []
            for d, t, spans in zip(f.doc_id, f.text, f.spans):
                merged = []
                for a, b in sorted((s["first"], s["last"]) for s in spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                    else:
                        merged.append((a, b))
                gone = sum(b - a for a, b in merged)
                drop = gone >= drop_share * len(words(t))
                rows.append((d, "drop" if drop else "cut", gone, None if drop else without_spans(t, merged)))
            yield pd.DataFrame(rows, columns=["doc_id", "action", "removed_words", "text"])

    return docs.select("doc_id", "text").join(found, "doc_id").mapInPandas(run, schema)
