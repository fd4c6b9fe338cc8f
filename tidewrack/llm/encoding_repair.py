"""Garbled text from wrong character encoding: find it and restore it.

The unit is the word that holds a character beyond ASCII; a record is garbled as
soon as one of its words is. Each distinct word is scored once, however often it
occurs:

1. character trigram models (interpolated, smoothed) are trained on the words of
   clean records. A first model learns from the records none of whose words is
   decodable by chance or otherwise; what it flags is left out as well, and a
   second one is trained on the rest;
2. every chain - encode the word as some codec, decode the bytes as another, up
   to ``ROUNDS`` times for text garbled repeatedly - that is defined for a word gives a candidate,
   and the gain is the log-likelihood of the likeliest candidate over the word's own;
3. the margin that a gain must pass is validated on all words of the clean records, each
   held out in its turn (its own counts are taken off the model), as they are (no alarm
   wanted) and garbled by a chain each (alarm wanted, ``recall``): it is the least
   gain at which no more than ``FALSE_RATE`` of the clean words would be changed.
   A held-out word whose likeliest candidate is itself a word of the clean
   records is no example of a clean word, but a garbled one that was missed before;
   if the candidate occurs more often, its gain is the one it has when held out.

U+FFFD stands for bytes that could not be decoded: such records are garbled, and
those characters can't be restored.

A model is a count-min table of ``ROWS`` x ``CELLS`` counters over all n-grams,
so what goes to the executors has a fixed size and no n-gram is dropped. Each model
is sent once, packed, and its copies are given up when its last words are scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ranking import global_rank
from tidewrack.runtime import spread, stage

ROWS = 2
CELLS = 1 << 21
FALSE_RATE = 5e-4
ROUNDS = 3
#: Codecs that bytes of UTF-8 text are often decoded with by mistake.
SINGLE = ("latin_1", "cp1252", "iso8859_15", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "iso8859_2", "cp1250", "cp1254")
#: (wrongly decoded with, really in) for single-byte text.
_CYRILLIC_CODECS = ("koi8_r", "cp1251", "cp866", "iso8859_5", "mac_cyrillic")
_EUROPEAN = ("cp1250", "iso8859_2", "cp1253", "iso8859_7", "cp1254", "cp1257", "cp1251", "koi8_r", "iso8859_5", "cp866")
SWAPS = (
    *((wrong, right) for wrong in _CYRILLIC_CODECS for right in _CYRILLIC_CODECS if wrong != right),
    *((wrong, right) for right in _EUROPEAN for wrong in ("cp1252", "latin_1")),
    *((wrong, "cp1252") for wrong in ("cp1251", "koi8_r", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_2")),
    ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"),
)
_WORD = re.compile(r"[^ \t\r\n<>\"]*[^\x00-\x7f][^ \t\r\n<>\"]*")
_CYRILLIC = re.compile(r"[\x00-\x7f\u0400-\u045f«»–—]+")
_START, _END = "\x02", "\x03"


@lru_cache(maxsize=None)
def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes a codec leaves open stand for the control of that number."""
    out = {}
    for b in range(256):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def _encode(word: str, codec: str) -> bytes | None:
    table = _table(codec)
    try:
        return bytes([table[c] for c in word])
    except KeyError:
        return None


def candidates(word: str) -> list[tuple[str, str]]:
    """(chain, text) of each defined chain that changes the word."""
    out: dict[str, str] = {}
    todo = [("", word)]
    for _ in range(ROUNDS):
        further = []
        for path, text in todo:
            for codec in SINGLE:
                raw = _encode(text, codec)
                if raw is None:
                    continue
                try:
                    fixed = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if fixed != text and fixed != word and fixed not in out:
                    out[fixed] = f"{path}{codec}>utf_8 "
                    if not fixed.isascii():
                        further.append((out[fixed], fixed))
        todo = further
    for wrong, right in SWAPS:
        raw = _encode(word, wrong)
        if raw is None:
            continue
        try:
            fixed = raw.decode(right)
        except UnicodeDecodeError:
            continue
        # A letter may not become a sign: signs are so rare that any model would like them.
        if fixed != word and fixed not in out and sum(map(str.isalpha, fixed)) >= sum(map(str.isalpha, word)):
            out[fixed] = f"{wrong}>{right}"
    return [(chain.strip(), text) for text, chain in out.items()]


@lru_cache(maxsize=1 << 17)
def decodable(word: str) -> bool:
    """Whether the bytes of a word happen to be UTF-8 under some codec (common among Cyrillic letters, which don't count)."""
    if _CYRILLIC.fullmatch(word):
        return False
    for codec in SINGLE:
        raw = _encode(word, codec)
        if raw is not None:
            try:
                if raw.decode("utf-8") != word:
                    return True
            except UnicodeDecodeError:
                pass
    return False


def grams(word: str) -> list[str]:
    """The trigrams, bigrams and characters a word is predicted from."""
    w = _START + _START + word + _END
    return [w[i - 2 : i + 1] for i in range(2, len(w))]


def parts(g: str) -> tuple[tuple[str, str], ...]:
    """What is counted of a trigram: itself, its bigram and character, and the contexts of both."""
    return ("t", g), ("b", g[1:]), ("u", g[2]), ("2", g[:2]), ("1", g[1])


def weighed(word: str, n: int) -> list[tuple[str, int]]:
    """(trigram, count) of a word that occurs ``n`` times; a share of it counts in capitals, which are too rare to be learnt from headings alone."""
    return [(g, weight * n) for form, weight in ((word, 20), (word.upper(), 1)) for g in grams(form)]


def _cells(kind: str, gram: str) -> tuple[int, ...]:
    h = xxhash.xxh64_intdigest(kind + gram)
    return tuple((h >> 32 * row) % CELLS for row in range(ROWS))


class Model:
    """Interpolated character trigram model over a count-min table of trigrams, bigrams, characters and contexts."""

    def __init__(self, counts: np.ndarray, total: int):
        self.counts, self.total = counts, max(1, total)
        self.memo: dict[str, float] = {}
        self.met: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"packed": zlib.compress(self.counts.tobytes(), 1), "kind": self.counts.dtype.str, "total": self.total}

    def __setstate__(self, state):
        self.__init__(np.frombuffer(zlib.decompress(state["packed"]), state["kind"]).reshape(ROWS, -1), state["total"])

    def count(self, kind: str, gram: str) -> int:
        return int(min(self.counts[row, c] for row, c in enumerate(_cells(kind, gram))))

    def seen(self, g: str) -> tuple[int, ...]:
        """The counts of a trigram's parts."""
        known = self.met.get(g)
        if known is None:
            known = tuple(self.count(*x) for x in parts(g))
            if len(self.met) < 1 << 18:
                self.met[g] = known
        return known

    def without(self, word: str, n: int) -> Model:
        """This model as if it had been trained without the ``n`` occurrences of a word."""
        return _Without(self, word, n)

    def score(self, word: str) -> float:
        """Natural log-likelihood of a word."""
        out = 0.0
        for g in grams(word):
            known = self.memo.get(g)
            if known is None:
                known = self._log(g)
                if len(self.memo) < 1 << 20:
                    self.memo[g] = known
            out += known
        return out

    def _log(self, g: str) -> float:
        t, b, u, two, one = self.seen(g)
        p = 1e-7 + 0.05 * u / self.total
        if one:
            p += 0.25 * min(1.0, b / one)
        if two:
            p += 0.7 * min(1.0, t / two)
        return math.log(p)

    def best(self, word: str) -> dict[bool, tuple[float, str, str]]:
        """(gain, chain, text) of the likeliest candidate of each family: over UTF-8 (True) or not."""
        own, top = self.score(word), {}
        for chain, text in candidates(word):
            gain, family = self.score(text) - own, chain.endswith("utf_8")
            if family not in top or gain > top[family][0]:
                top[family] = (gain, chain, text)
        return top


class _Without(Model):
    def __init__(self, model: Model, word: str, n: int):
        self.model, self.own, total = model, Counter(), model.total
        for g, k in weighed(word, n):
            total -= k
            for x in parts(g):
                self.own[x] += k
        super().__init__(model.counts, total)

    def seen(self, g: str) -> tuple[int, ...]:
        return tuple(max(0, n - self.own[x]) for n, x in zip(self.model.seen(g), parts(g)))


def words_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``words``, ``lost``, ``open``): distinct words beyond ASCII of each record that has any."""

    def run(frames):
        for f in frames:
            keep = []
            for i, t in zip(f.id.values, f.t):
                if not t.isascii():
                    words = list(dict.fromkeys(_WORD.findall(t)))
                    lost = "�" in t
                    keep.append((i, words, lost, lost or any(map(decodable, words))))
            yield pd.DataFrame(keep, columns=["id", "words", "lost", "open"])

    picked = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return stage(spread(picked).mapInPandas(run, "id bigint, words array<string>, lost boolean, open boolean"), "words")


def train(vocabulary: DataFrame) -> Model:
    """Model of a (``word``, ``n``) table."""
    pack = 1 << 12

    def run(frames):
        for f in frames:
            sums: Counter = Counter()
            for w, n in zip(f.word, f.n.values):
                if "�" not in w:
                    for g, k in weighed(w, int(n)):
                        sums[g] += k
            cells: Counter = Counter()
            for g, n in sums.items():
                cells[-1] += n
                for kind, gram in parts(g):
                    for row, c in enumerate(_cells(kind, gram)):
                        cells[row * CELLS + c] += n
            yield pd.DataFrame({"cell": list(cells), "n": list(cells.values())}).astype("int64")

    sums = vocabulary.mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))

    def packed(frames):
        for f in frames:
            for block, g in f.groupby(f.cell // pack):
                yield pd.DataFrame({"block": [block], "cells": [g.cell.to_numpy().tobytes()], "n": [g.n.to_numpy().tobytes()]})

    counts, total = np.zeros(ROWS * CELLS, np.int64), 0
    for r in sums.mapInPandas(packed, "block bigint, cells binary, n binary").collect():
        at, n = np.frombuffer(r.cells, np.int64), np.frombuffer(r.n, np.int64)
        if r.block < 0:
            total = int(n.sum())
        else:
            counts[at] = n
    return Model(counts.reshape(ROWS, CELLS), total)


def garble(i: int, w: str) -> str:
    """The word garbled by the chain of a number; the word itself where its chain isn't defined."""
    wrong, right = SWAPS[i // 2 % len(SWAPS)] if i % 2 else (SINGLE[i // 2 % 6], "utf_8")
    try:
        return w.encode(right).decode(wrong)
    except UnicodeError:
        return w


_GAINS = ", ".join(["word string, n bigint", *(f"gain_{x} double, chain_{x} string, fixed_{x} string" for x in ("utf8", "single", "held_utf8", "held_single"))])


def scored(words: DataFrame, shared: Broadcast[Model]) -> DataFrame:
    """The likeliest candidate of each family for the words that have one likelier than themselves, written as a table.

    ``n`` is how often the model was trained on the word, or on the word ``clean`` if
    there is such a column; columns of ``held`` are by the model without these counts.
    """
    words = words if "clean" in words.columns else words.withColumn("clean", F.col("word"))
    none = (None, None, None)

    def run(frames):
        for f in frames:
            got = []
            for w, n, clean in zip(f.word, f.n.values, f.clean):
                best = shared.value.best(w)
                held = shared.value.without(clean, int(n)).best(w) if n else {}
                if any(t[0] > 0 for x in (best, held) for t in x.values()):
                    got.append((w, n, *(v for x in (best, held) for family in (True, False) for v in x.get(family, none))))
            yield pd.DataFrame(got, columns=[x.split()[0] for x in _GAINS.split(", ")])

    return stage(spread(words.select("word", "n", "clean")).mapInPandas(run, _GAINS), "gains")


def judged(gains: DataFrame, words: DataFrame) -> DataFrame:
    """Gains with those of missed words put right, and ``missed``, written as a table; ``words`` (``word``, ``n``) are those of the model."""
    out = gains.withColumn("missed", F.lit(False))
    for x in ("utf8", "single"):
        known = words.where("n > 0").select(F.col("word").alias(f"fixed_held_{x}"), F.col("n").alias("m"))
        out = out.join(known, f"fixed_held_{x}", "left").withColumn("hit", F.coalesce((F.col(f"gain_held_{x}") > 0) & F.col("m").isNotNull(), F.lit(False)))
        rarer = F.col("hit") & (F.col("m") > F.col("n"))
        out = out.withColumns({f"{c}_{x}": F.when(rarer, F.col(f"{c}_held_{x}")).otherwise(F.col(f"{c}_{x}")) for c in ("gain", "chain", "fixed")})
        out = out.withColumn("missed", F.col("missed") | F.col("hit")).drop("m", "hit")
    return stage(out, "judged")


def beyond(margins: dict[bool, float]) -> Column:
    return F.coalesce(F.col("gain_utf8") > margins[True], F.lit(False)) | F.coalesce(F.col("gain_single") > margins[False], F.lit(False))


def validate(gains: DataFrame, words: DataFrame) -> tuple[dict[bool, float], float]:
    """(margins, share of false alarms) on all words (``word``, ``n``) of a model, by their judged gains when held out."""
    total = words.where("n > 0").count()
    own = gains.where("n > 0 and not missed").select("word", F.col("gain_held_utf8").alias("gain_utf8"), F.col("gain_held_single").alias("gain_single"))
    margins = {}
    for utf8, gain in ((True, "gain_utf8"), (False, "gain_single")):
        ranked = global_rank(own.where(F.col(gain) > 0).select((-F.col(gain)).alias("less"), "word"), ["less", "word"])
        at = ranked.where(F.col("rank") == int(FALSE_RATE * total)).first()
        margins[utf8] = -at.less if at else 0.0
    return margins, own.where(beyond(margins)).count() / max(1, total)


def recall(model: Broadcast[Model], words: DataFrame, margins: dict[bool, float]) -> float:
    """Share of garbled words found, of the words (``word``, ``n``) a model was trained on, garbled by a chain each where it is defined."""

    def run(frames):
        for f in frames:
            spoilt = [(garble(zlib.crc32(w.encode()), w), n, w) for w, n in zip(f.word, f.n.values)]
            yield pd.DataFrame([x for x in spoilt if x[0] != x[2]], columns=["word", "n", "clean"])

    spoilt = stage(words.where("n > 0").select("word", "n").mapInPandas(run, "word string, n bigint, clean string"), "spoilt")
    gains = scored(spoilt, model).select(F.col("gain_held_utf8").alias("gain_utf8"), F.col("gain_held_single").alias("gain_single"))
    return gains.where(beyond(margins)).count() / max(1, spoilt.count())


class Repair:
    """Garbled records of a table of texts."""

    def __init__(self, rows: DataFrame, id_col: str, text_col: str):
        self.rows, self.id_col, self.text_col = rows, id_col, text_col
        self.words = words_of(rows, id_col, text_col)
        self.long = long = self.words.select("id", F.explode("words").alias("word"))
        closed = self.words.select(F.explode("words").alias("word"), F.col("open").cast("bigint").alias("open"))
        closed = stage(closed.groupBy("word").agg(F.sum(1 - F.col("open")).alias("n")), "closed")
        _, first = self._gains(closed)
        first = first.where(beyond(validate(first, closed)[0]))
        suspect = long.join(first.select("word"), "word", "left_semi").select("id").unionAll(self.words.where("lost").select("id")).distinct()
        marked = long.join(suspect.withColumn("suspect", F.lit(1)), "id", "left")
        self.clean = stage(marked.groupBy("word").agg(F.sum(1 - F.coalesce("suspect", F.lit(0))).alias("n")), "clean")
        self.model, gains = self._gains(self.clean)
        self.margins, self.false_rate = validate(gains, self.clean)
        over = F.coalesce(F.col("gain_utf8") > self.margins[True], F.lit(False))
        both = F.struct(*[F.when(over & (F.col("gain_utf8") >= F.coalesce("gain_single", F.lit(0.0))), F.col(f"{c}_utf8")).otherwise(F.when(F.col("gain_single") > self.margins[False], F.col(f"{c}_single")).otherwise(F.col(f"{c}_utf8"))).alias(c) for c in ("gain", "chain", "fixed")])
        self.fixes = gains.where(beyond(self.margins)).select("word", both.alias("b")).select("word", "b.chain", "b.fixed", "b.gain")

    def _gains(self, vocabulary: DataFrame) -> tuple[Model, DataFrame]:
        """Model of the words of a vocabulary (``word``, ``n``) with ``n`` > 0, and what all of its words gain."""
        model = train(vocabulary.where("n > 0"))
        shared = vocabulary.sparkSession.sparkContext.broadcast(model)
        gains = judged(scored(vocabulary, shared), vocabulary)
        shared.destroy()
        return model, gains

    def recall(self) -> float:
        """Share of the clean words, garbled by one chain each, that would be found."""
        model = self.rows.sparkSession.sparkContext.broadcast(self.model)
        share = recall(model, self.clean, self.margins)
        model.destroy()
        return share

    def found(self) -> DataFrame:
        """(id, ``words``, ``restorable``) of garbled records."""
        hits = self.long.join(self.fixes.select("word"), "word").groupBy("id").agg(F.count("*").alias("words"))
        lost = self.words.where("lost").select("id", F.lit(True).alias("lost"))
        both = hits.join(lost, "id", "full_outer")
        return both.select(F.col("id").alias(self.id_col), F.coalesce("words", F.lit(0)).alias("words"), F.col("lost").isNull().alias("restorable"))

    def restored(self) -> DataFrame:
        """(id, ``text``, ``restored_words``): garbled records with their words restored."""
        fixes = self.long.join(self.fixes.select("word", "fixed"), "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("m"))
        texts = self.rows.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("t"))

        def run(frames):
            for f in frames:
                out = []
                for i, t, m in zip(f.id.values, f.t, f.m):
                    m = dict(m)
                    out.append((i, _WORD.sub(lambda x: m.get(x[0], x[0]), t), len(m)))
                yield pd.DataFrame(out, columns=["id", "text", "restored_words"])

        return texts.join(fixes, "id").mapInPandas(run, "id bigint, text string, restored_words bigint").withColumnRenamed("id", self.id_col)

    def report(self) -> DataFrame:
        """One row: garbled records, restorable ones, margin and its validation."""
        return self.found().agg(F.count("*").alias("garbled"), F.coalesce(F.sum(F.col("restorable").cast("bigint")), F.lit(0)).alias("restorable")).select("garbled", "restorable", F.lit(float(self.margins[True])).alias("margin_utf8"), F.lit(float(self.margins[False])).alias("margin_single_byte"), F.lit(float(self.false_rate)).alias("held_out_false_rate"), F.lit(float(self.recall())).alias("held_out_recall"))

