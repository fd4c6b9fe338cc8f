"""Near-duplicate records: one-permutation hashing, banded buckets, star edges.

1. ``sketches``: a text's set of word shingles as sorted 64-bit hashes, and its
   one-permutation sketch: one hash a shingle, its low part chooses one of
   ``BINS`` bins, the least value of each bin stays. Empty bins copy a full one
   found along a fixed pseudo-random walk of the bin (optimal densification).
   Equal sets are one class from here on.
2. ``star_edges``: bands of the sketch are bucket keys; in each bucket every
   member is linked to the member with the least mixed hash only, so n members
   give n - 1 candidate links.
3. connected components of the links: whoever shared a bucket is in one.
4. within a component, the pairs are completed exactly: a pair at the threshold
   must share a shingle among the rarest (1 - t) * n + 1 of either side (prefix
   filter, sizes within t of each other), so no group is expanded into all its
   pairs; each candidate is verified on the whole sets.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators.components import components
from tidewrack.runtime import spread, stage

SHINGLE = 5
SIMILARITY = 0.8
BINS = 240
BANDS = 48
SEED = 11
ATTEMPTS = 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


def _walks() -> np.ndarray:
    """For each bin and attempt the bin to copy from."""
    grid = np.arange(BINS * ATTEMPTS, dtype=np.uint64) + np.uint64(SEED << 32)
    return (_mix(grid * _M3) % np.uint64(BINS)).astype(np.int64).reshape(BINS, ATTEMPTS).T


class Shingler:
    """Word hashes are kept in a table of bounded size."""

    def __init__(self, n: int, room: int = 1 << 20):
        self.n, self.room, self.known = n, room, {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the runs of ``n`` words (split at spaces); a shorter text is one run, the empty one too."""
        words = [w for w in text.split(" ") if w]
        run = min(self.n, len(words))
        if len(self.known) > self.room:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        ids = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            ids.append(h)
        a = np.array(ids, np.uint64)
        h = np.zeros(len(a) - run + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(run):
                h = _mix(h * _M3 + a[j : len(a) - run + 1 + j])
        return np.unique(h)


def sketch(shingles: np.ndarray, walks: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a non-empty shingle set (32-bit values)."""
    h = _mix(shingles + np.uint64(SEED))
    bins = (h % np.uint64(BINS)).astype(np.int64)
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, bins, h // np.uint64(BINS))
    full = np.zeros(BINS, bool)
    full[bins] = True
    values = (out >> np.uint64(20)).astype(np.uint32)
    empty = np.flatnonzero(~full)
    for attempt in range(ATTEMPTS):
        if not len(empty):
            break
        source = walks[attempt, empty]
        ok = full[source]
        values[empty[ok]] = values[source[ok]]
        empty = empty[~ok]
    if len(empty):  # the walk of a bin met no full one: the next full bin in a circle
        where = np.flatnonzero(full)
        values[empty] = values[where[np.searchsorted(where, empty) % len(where)]]
    return values


def sketches(rows: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, min_words: int = 0) -> DataFrame:
    """(``id``, ``digest1``, ``digest2``, ``n``, ``shingles``, ``bands``), written as a table.

    Rows with a null id or text or fewer than ``min_words`` words are left out. ``digest`` tells equal shingle sets.
    """
    per_band = BINS // BANDS

    def run(frames):
        maker, walks = Shingler(shingle), _walks()
        for f in frames:
            out = []
            for i, t in zip(f.id.values, f.t):
                if min_words and len([w for w in t.split(" ") if w]) < min_words:
                    continue
                s = maker.shingles(t)
                v = sketch(s, walks)
                band = np.arange(BANDS, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(per_band):
                        band = _mix(band * _M3 + v[j::per_band].astype(np.uint64))
                d = s.tobytes()
                out.append((i, xxhash.xxh64_intdigest(d) - (1 << 63), xxhash.xxh64_intdigest(d, 5) - (1 << 63), len(s), d, band.tobytes()))
            yield pd.DataFrame(out, columns=["id", "digest1", "digest2", "n", "shingles", "bands"])

    picked = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return stage(spread(picked).mapInPandas(run, "id bigint, digest1 bigint, digest2 bigint, n int, shingles binary, bands binary"), "sketches")


def classes(sketched: DataFrame) -> DataFrame:
    """(``id``, ``rep``): the lowest id with an equal shingle set."""
    reps = sketched.groupBy("digest1", "digest2").agg(F.min("id").alias("rep"))
    return stage(sketched.select("id", "digest1", "digest2").join(reps, ["digest1", "digest2"]).select("id", "rep"), "classes")


def star_edges(reps: DataFrame) -> DataFrame:
    """(``a``, ``b``): candidate links between representatives."""

    def explode(frames):
        for f in frames:
            if len(f):
                keys = np.frombuffer(b"".join(f.bands), np.int64)
                yield pd.DataFrame({"key": keys, "id": np.repeat(f.id.values, BANDS)})

    members = reps.select("id", "bands").mapInPandas(explode, "key bigint, id bigint")
    # The key holds the band number; the centre is the member with the least hash of (key, id).
    members = stage(members, "members")
    centres = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.xxhash64("key", "id")).alias("h")).where("n > 1").select("key", "h")
    crowded = members.join(centres, "key")
    heads = crowded.where(F.xxhash64("key", "id") == F.col("h")).groupBy("key").agg(F.min("id").alias("c"))
    edges = members.join(heads, "key").where("id <> c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    return stage(edges, "edges")


def complete_pairs(reps: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """(``a``, ``b``, ``similarity``): all pairs of at least ``similarity`` within components."""
    comp = stage(components(edges), "comp")
    inside = stage(reps.select("id", "n", "shingles").join(comp, "id"), "inside")

    def tokens(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"component": np.repeat(f.component.values, f.n.values), "token": np.frombuffer(b"".join(f.shingles), np.int64)})

    often = inside.select("component", "n", "shingles").mapInPandas(tokens, "component bigint, token bigint").groupBy("component", "token").agg(F.count("*").alias("df")).where("df > 1")

    # The prefix needs a text's tokens in ascending frequency; tokens of frequency 1 can't match.
    def long(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"component": np.repeat(f.component.values, f.n.values), "token": np.frombuffer(b"".join(f.shingles), np.int64), "id": np.repeat(f.id.values, f.n.values), "n": np.repeat(f.n.values, f.n.values)})

    shared = inside.select("component", "id", "n", "shingles").mapInPandas(long, "component bigint, token bigint, id bigint, n int").join(often, ["component", "token"])
    per = Window.partitionBy("id").orderBy("df", "token")
    n_shared = F.count("*").over(Window.partitionBy("id"))
    # Rank among all tokens: those of frequency 1 come first and are n - n_shared many.
    prefix = shared.withColumn("rank", F.row_number().over(per) + F.col("n") - n_shared).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("component", "token", "id", "n")
    prefix = stage(prefix, "prefix")
    x, y = prefix.alias("x"), prefix.alias("y")
    meet = (F.col("x.component") == F.col("y.component")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id"))
    size = (F.col("x.n") >= F.col("y.n") * similarity - 1e-9) & (F.col("y.n") >= F.col("x.n") * similarity - 1e-9)
    pairs = x.join(y, meet & size).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    sets = inside.select("id", "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def verify(frames):
        for f in frames:
            got = []
            for a, b, x, y in zip(f.a.values, f.b.values, f.x, f.y):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                s = common / (len(x) + len(y) - common)
                if s >= similarity:
                    got.append((a, b, s))
            yield pd.DataFrame(got, columns=["a", "b", "similarity"])

    return stage(both.mapInPandas(verify, "a bigint, b bigint, similarity double"), "pairs")


class Duplicates:
    """Near-duplicates of a table of texts; ``pairs`` link class representatives."""

    def __init__(self, rows: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, shingle: int = SHINGLE, min_words: int = 0):
        sketched = sketches(rows, id_col, text_col, shingle, min_words)
        textless = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNull()).select(F.col(id_col).cast("bigint").alias("id"))
        self.textless = None if min_words else textless
        self.classes = classes(sketched)
        reps = sketched.join(self.classes.where("id = rep").select("id"), "id", "left_semi")
        self.pairs = complete_pairs(reps, star_edges(reps), similarity)

    def groups(self) -> DataFrame:
        """(``id``, ``class_id``, ``group_id``, ``links``) of each record that took part.

        ``class_id``: lowest id with the same shingle set; ``group_id``: lowest id
        among the classes linked over any number of steps; ``links``: classes that
        the record's class is similar to. Without ``min_words`` a record with a
        null text has a row too, of null class and group.
        """
        ends = self.pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionAll(self.pairs.select(F.col("b"), F.col("a")))
        links = ends.groupBy("rep").agg(F.count("*").alias("links"))
        comp = components(self.pairs.select("a", "b")).withColumnRenamed("id", "rep")
        c = self.classes.join(links, "rep", "left").join(comp, "rep", "left")
        out = c.select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        if self.textless is None:
            return out
        none = F.lit(None).cast("bigint")
        return out.unionByName(self.textless.select("id", none.alias("class_id"), none.alias("group_id"), F.lit(0).cast("bigint").alias("links")))

    def record_pairs(self) -> DataFrame:
        """(``record_id_a``, ``record_id_b``): the pairs of records, equal sets included.

        This form is as large as its result: a class of c equal texts has
        c * (c - 1) / 2 pairs. ``groups`` says the same in one row a record.
        """
        c = self.classes
        x = c.select(F.col("rep").alias("a"), F.col("id").alias("i"))
        y = c.select(F.col("rep").alias("b"), F.col("id").alias("j"))
        across = self.pairs.select("a", "b").join(x, "a").join(y, "b").select("i", "j")
        copied = c.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
        own = c.join(copied, "rep")
        within = own.select("rep", F.col("id").alias("i")).join(own.select("rep", F.col("id").alias("j")), "rep").where("i < j").select("i", "j")
        return across.unionAll(within).select(F.least("i", "j").alias("record_id_a"), F.greatest("i", "j").alias("record_id_b"))
