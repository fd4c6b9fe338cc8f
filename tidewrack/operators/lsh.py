"""Banded locality-sensitive hashing: index, probe, exact search, rerank, evaluation.

The index is the relation (``band``, ``band_key``, ``doc_id``); a probe is an
equi-join on band and key. Exact searches take a stated set of queries: Jaccard
by an inverted join on shared items, cosine by blocks of queries against all rows.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.vectors import cosine


@dataclass(frozen=True)
class LshConfig:
    """Shape and seed, one object for the index and the query side."""

    bands: int = 32
    rows: int = 4
    seed: int = 47

    @property
    def num_hashes(self) -> int:
        return self.bands * self.rows


# Shapes of the two indices.
NGRAM_LSH = LshConfig(32, 4)
EMBEDDING_LSH = LshConfig(32, 16)
#: Items of query sets that are sent to every task at most.
HELD_ITEMS = 4_000_000
#: Scores of query and document that a task of an exact search holds at once, besides its best.
CELLS = 1 << 20


def bands_of(signature: Column, config: LshConfig) -> Column:
    """Array of band keys of a signature (array of strings, or a string of bits); another length is an error."""
    return _bands(signature, config, is_bits=False)


def bit_bands_of(signature: Column, config: LshConfig) -> Column:
    return _bands(signature, config, is_bits=True)


def _bands(signature: Column, config: LshConfig, is_bits: bool) -> Column:
    n, r = config.num_hashes, config.rows
    size = F.length(signature) if is_bits else F.size(signature)
    cut = (lambda b: F.substring(signature, b * r + 1, r)) if is_bits else (lambda b: F.sha1(F.concat_ws(",", F.slice(signature, b * r + 1, r))))
    keys = F.array(*[cut(b) for b in range(config.bands)])
    return F.when(size == n, keys).otherwise(F.raise_error(F.lit(f"signatures must have {n} values")))


def index(signatures: DataFrame, config: LshConfig, id_col: str = "doc_id", bits: bool = False) -> DataFrame:
    """(``band``, ``band_key``, id) of each signature; null signatures are left out."""
    return keyed(signatures, config, id_col, bits).select(id_col, F.posexplode("keys").alias("band", "band_key")).select("band", "band_key", id_col)


def keyed(signatures: DataFrame, config: LshConfig, id_col: str = "doc_id", bits: bool = False) -> DataFrame:
    """(id, ``keys``): a row of band keys for each signature; null signatures are left out."""
    s = F.col("signature")
    return signatures.where(s.isNotNull()).select(id_col, (bit_bands_of(s, config) if bits else bands_of(s, config)).alias("keys"))


def buckets(idx: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``band``, ``bucket_size``, ``buckets``): how many buckets of each size a band has."""
    sizes = idx.groupBy("band", "band_key").agg(F.count(id_col).alias("bucket_size"))
    return sizes.groupBy("band", "bucket_size").agg(F.count("*").alias("buckets"))


def index_size(idx: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: ``added`` signatures and ``distinct_docs``."""
    return idx.where("band = 0").agg(F.count("*").alias("added"), F.countDistinct(id_col).alias("distinct_docs"))


def removed(idx: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The index without the documents in ``ids``; without all of them it is clear."""
    return idx.join(ids.select(id_col).distinct(), id_col, "left_anti")


def sampled(rows: DataFrame, size: int, seed: int = 47, id_col: str = "doc_id") -> DataFrame:
    """``size`` rows (all, if there are fewer) drawn without replacement: those whose id has the least seeded hash.

    The draw depends on seed and ids alone, not on how rows are laid out; null ids are left out.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return rows.where(F.col(id_col).isNotNull()).orderBy(key, id_col).limit(size)


def candidates(queries: DataFrame, idx: DataFrame, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """(query id, id): documents that share a band with the query; ``queries`` is an index over queries."""
    return queries.join(idx, ["band", "band_key"]).select(query_id, id_col).distinct()


def cap(found: DataFrame, limit: int | None, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """The first ``limit`` candidates of each query by id (all for a falsy limit).

    This is the search's own parameter: recall depends on it.
    """
    if not limit:
        return found
    w = Window.partitionBy(query_id).orderBy(id_col)
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def top(scored: DataFrame, k: int, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Adds ``rank`` and keeps the k best of each query; equal scores by ascending id."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def exact_jaccard(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", id_col: str = "doc_id", items: str = "items") -> DataFrame:
    """(query id, id, ``score``, ``rank``): the k most similar sets of each query, the query's own included.

    While the queries' sets hold at most ``HELD_ITEMS`` items, every task has them
    as an inverted index, counts its documents against all queries in one pass
    and sends its k best of each; more queries are joined on shared items, with
    the same answers: only pairs that share an item are scored. A query with fewer than k of them is
    filled up with score 0 by the lowest ids: the k + (its hits) lowest ids of all
    documents are enough to choose from. Null sets are left out.
    """
    q = queries.where(F.col(items).isNotNull()).select(F.col(query_id).alias("q"), F.array_distinct(items).alias("qi"))
    d = docs.where(F.col(items).isNotNull()).select(F.col(id_col).alias("d"), F.array_distinct(items).alias("di"))
    if q.agg(F.coalesce(F.sum(F.size("qi")), F.lit(0)).alias("n")).first()["n"] <= HELD_ITEMS:
        return _jaccard_in_memory(q, d, k).select(F.col("q").alias(query_id), F.col("d").alias(id_col), "score", "rank")
    shared = q.select("q", F.size("qi").alias("qn"), F.explode("qi").alias("item")).join(d.select("d", F.size("di").alias("dn"), F.explode("di").alias("item")), "item")
    scored = shared.groupBy("q", "d").agg(F.count("*").alias("n"), F.first("qn").alias("qn"), F.first("dn").alias("dn")).select("q", "d", F.round(F.col("n") / (F.col("qn") + F.col("dn") - F.col("n")), 9).alias("score"))
    best = top(scored, k, "q", "d").drop("rank")
    # At most k hits are kept a query, so 2k lowest ids hold k ids that are no hit.
    lowest = [F.lit(r["d"]) for r in d.select("d").orderBy("d").limit(2 * k).collect()]
    kind = dict(d.dtypes)["d"]
    pads = q.select("q", F.explode(F.array(*lowest).cast(f"array<{kind}>")).alias("d")).join(scored.select("q", "d"), ["q", "d"], "left_anti").withColumn("score", F.lit(0.0))
    both = top(best.unionByName(pads), k, "q", "d")
    return both.select(F.col("q").alias(query_id), F.col("d").alias(id_col), "score", "rank")


def _jaccard_in_memory(q: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """(``q``, ``d``, ``score``, ``rank``) for query sets (``q``, ``qi``) that fit in memory."""
    held: list[tuple] = []
    # An item's text is kept once, not once for each query that has it.
    postings: dict[str, array] = {}
    for i, r in enumerate(q.toLocalIterator()):
        held.append((r["q"], len(r["qi"])))
        for x in r["qi"]:
            postings.setdefault(x, array("i")).append(i)
    index = q.sparkSession.sparkContext.broadcast(({x: np.array(p, np.int32) for x, p in postings.items()}, np.array([size for _, size in held], np.int64)))
    del postings
    n = len(held)
    kind = dict(d.dtypes)["d"]

    def run(frames):
        known, sizes = index.value
        none = np.zeros(0, np.int32)
        best: list[tuple[np.ndarray, ...]] | None = None
        step = max(k, CELLS // max(1, n))
        for f in frames:
            for at in range(0, len(f), step):
                part = f.iloc[at : at + step]
                ids = part.d.to_numpy()
                inter = np.stack([np.bincount(np.concatenate([none, *(known[x] for x in own if x in known)]), minlength=n) for own in part.di])
                union = sizes[None, :] + np.array([len(own) for own in part.di])[:, None] - inter
                found = [np.broadcast_to(ids[:, None], inter.shape), inter, union]
                best = found if best is None else [np.concatenate(x) for x in zip(best, found)]
                score = np.floor(best[1] / np.maximum(best[2], 1) * 1e9 + 0.5)
                order = np.lexsort((best[0], -score), axis=0)[:k]
                best = [np.take_along_axis(x, order, axis=0) for x in best]
        if best is not None:
            rows = len(best[0])
            yield pd.DataFrame({"i": np.tile(np.arange(n), rows), "d": best[0].ravel(), "inter": best[1].ravel(), "total": best[2].ravel()})

    names = q.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], f"i bigint, q {dict(q.dtypes)['q']}")
    found = d.mapInPandas(run, f"i bigint, d {kind}, inter bigint, total bigint").join(F.broadcast(names), "i")
    scored = found.select("q", "d", F.round(F.col("inter") / F.greatest("total", F.lit(1)), 9).alias("score"))
    return top(scored, k, "q", "d")


def exact_cosine(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", id_col: str = "doc_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(query id, id, ``score``, ``rank``): the k most similar vectors of a stated query set, in blocks against all rows.

    A block of queries (``block`` vectors) is broadcast; each task keeps its own k
    best of a query, so a query's candidates are few by the time they meet. All
    vectors must have one length; null ones are left out.
    """
    spark = docs.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).alias("v"))
    d = docs.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("d"), F.col(vector).alias("v"))
    schema = "q bigint, d bigint, score double"
    out = None

    def unit(x):
        x = np.array(x, np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    held: list = []

    def flush():
        nonlocal out, held
        if not held:
            return
        ids = np.array([r[0] for r in held], np.int64)
        shared = spark.sparkContext.broadcast((ids, unit([r[1] for r in held])))

        def run(frames):
            qid, qv = shared.value
            best: list[np.ndarray] | None = None
            step = max(k, CELLS // len(qid))
            for f in frames:
                for at in range(0, len(f), step):
                    part = f.iloc[at : at + step]
                    s = np.round(qv @ unit(part.v.tolist()).T, 9)
                    found = [np.broadcast_to(part.d.to_numpy(), s.shape), s]
                    best = found if best is None else [np.concatenate(x, axis=1) for x in zip(best, found)]
                    order = np.lexsort((best[0], -best[1]), axis=1)[:, :k]
                    best = [np.take_along_axis(x, order, axis=1) for x in best]
            if best is not None:
                yield pd.DataFrame({"q": np.repeat(qid, best[0].shape[1]), "d": best[0].ravel(), "score": best[1].ravel()})

        part = d.mapInPandas(run, schema)
        out = part if out is None else out.unionAll(part)
        held = []

    for r in q.toLocalIterator():
        held.append((r["q"], r["v"]))
        if len(held) == block:
            flush()
    flush()
    out = spark.createDataFrame([], schema) if out is None else out
    return top(out, k, "q", "d").select(F.col("q").alias(query_id), F.col("d").alias(id_col), "score", "rank")


def rerank_jaccard(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int, limit: int | None, query_id: str = "query_id", id_col: str = "doc_id", items: str = "items") -> DataFrame:
    """Candidates scored exactly: (query id, ``candidate_size``, ``rank``, id, ``score``)."""
    return _rerank(found, queries, docs, k, limit, query_id, id_col, items, jaccard)


def rerank_cosine(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int, limit: int | None, query_id: str = "query_id", id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    return _rerank(found, queries, docs, k, limit, query_id, id_col, vector, cosine)


def _rerank(found, queries, docs, k, limit, query_id, id_col, col, score):
    sizes = found.groupBy(query_id).agg(F.count("*").alias("candidate_size"))
    kept = cap(found, limit, query_id, id_col)
    q = queries.select(query_id, F.col(col).alias("_q"))
    d = docs.select(id_col, F.col(col).alias("_d"))
    if limit:
        pairs = kept.join(d, id_col).join(q, query_id)
    else:
        # All candidates: a document meets its queries once, so its value isn't sent once a pair.
        pairs = kept.groupBy(id_col).agg(F.collect_list(query_id).alias("_asked")).join(d, id_col).select(id_col, "_d", F.explode("_asked").alias(query_id)).join(q, query_id)
    scored = pairs.select(query_id, id_col, F.round(score(F.col("_q"), F.col("_d")), 9).alias("score"))
    return top(scored, k, query_id, id_col).join(sizes, query_id).select(query_id, "candidate_size", "rank", id_col, "score")


def evaluate(found: DataFrame, truth: DataFrame, queries: DataFrame, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """By query: ``candidate_size``, ``hits`` and ``recall`` = hits / max(size of the truth, 1)."""
    sizes = found.groupBy(query_id).agg(F.count("*").alias("candidate_size"))
    wanted = truth.groupBy(query_id).agg(F.count("*").alias("wanted"))
    hits = truth.select(query_id, id_col).join(found.select(query_id, id_col), [query_id, id_col], "left_semi").groupBy(query_id).agg(F.count("*").alias("hits"))
    out = queries.select(query_id).distinct().join(sizes, query_id, "left").join(wanted, query_id, "left").join(hits, query_id, "left")
    zero = F.lit(0).cast("bigint")
    h = F.coalesce("hits", zero)
    return out.select(query_id, F.coalesce("candidate_size", zero).alias("candidate_size"), h.alias("hits"), (h / F.greatest(F.coalesce("wanted", zero), F.lit(1))).alias("recall"))


def evaluate_counted(keys: DataFrame, asked: DataFrame, bands: int, truths: dict[str, DataFrame], query_id: str = "query_id", id_col: str = "doc_id", block: int = 4096) -> DataFrame:
    """As :func:`evaluate` for several truths at once, with a row for each query and ``truth``, but no candidate pair leaves its task.

    ``keys`` is the index by documents (:func:`keyed`), ``asked`` its rows that are
    queries, with ``query_id``; both are read more than once. The keys and truths of
    a block of queries are sent to every task, which counts its documents against
    them; the rows of an id that comes more than once are gathered first.
    """
    spark, names = keys.sparkSession, list(truths)

    def by_id(df: DataFrame, name: str) -> DataFrame:
        if not df.groupBy(name).count().where("count > 1").limit(1).count():
            return df.select(name, "keys")
        return df.groupBy(name).agg(F.flatten(F.collect_list("keys")).alias("keys"))  # the band is still the place modulo ``bands``

    docs = by_id(keys, id_col).select(F.col(id_col).cast("string").alias("d"), "keys")
    q = by_id(asked.where(F.col(query_id).isNotNull()), query_id)
    for k, name in enumerate(names):
        own = truths[name].groupBy(query_id).agg(F.collect_list(F.col(id_col).cast("string")).alias(f"t{k}"), F.count("*").alias(f"w{k}"))
        q = q.join(own, query_id, "left")
    schema = "i bigint, n bigint, " + ", ".join(f"h{k} bigint" for k in range(len(names)))
    kind = dict(q.dtypes)[query_id]
    out, held = None, []
    places: list[dict[str, array]] = [{} for _ in range(bands)]
    wanted: list[dict[str, array]] = [{} for _ in names]

    def flush():
        nonlocal out, held, places, wanted
        n = len(held)
        shared = spark.sparkContext.broadcast(tuple([{x: np.array(p, np.int32) for x, p in part.items()} for part in parts] for parts in (places, wanted)))

        def run(frames):
            known, truth = shared.value
            met, total, hits = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros((len(truth), n), np.int64)
            for f in frames:
                for d, own in zip(f.d, f["keys"]):
                    met[:] = False
                    for at, x in enumerate(own):
                        if (p := known[at % bands].get(x)) is not None:
                            met[p] = True
                    total += met
                    for h, t in zip(hits, truth):
                        if (p := t.get(d)) is not None:
                            np.add.at(h, p[met[p]], 1)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"i": some, "n": total[some]} | {f"h{k}": h[some] for k, h in enumerate(hits)})

        sums = docs.mapInPandas(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", *[f"h{k}" for k in range(len(names))])])
        rows = spark.createDataFrame([(i, *x) for i, x in enumerate(held)], f"i bigint, q {kind}, " + ", ".join(f"w{k} bigint" for k in range(len(names))))
        part = rows.join(sums, "i", "left")
        out = part if out is None else out.unionAll(part)
        held, places, wanted = [], [{} for _ in range(bands)], [{} for _ in names]

    for r in q.toLocalIterator():
        i = len(held)
        held.append((r[query_id], *[r[f"w{k}"] or 0 for k in range(len(names))]))
        for at, x in enumerate(r["keys"]):
            places[at % bands].setdefault(x, array("i")).append(i)
        for k, own in enumerate(wanted):
            for d in r[f"t{k}"] or []:
                own.setdefault(d, array("i")).append(i)
        if len(held) == block:
            flush()
    if held or out is None:
        flush()
    zero = F.lit(0).cast("bigint")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("truth"), F.coalesce(f"h{k}", zero).alias("hits"), F.col(f"w{k}").alias("wanted")) for k, name in enumerate(names)]))
    out = out.select(F.col("q").alias(query_id), F.coalesce("n", zero).alias("candidate_size"), each.alias("e"))
    return out.select(query_id, "candidate_size", "e.truth", "e.hits", (F.col("e.hits") / F.greatest("e.wanted", F.lit(1))).alias("recall"))


def summary(evaluated: DataFrame, *by: str) -> DataFrame:
    """Means over queries: ``queries``, ``candidate_size``, ``recall``."""
    aggs = [F.count("*").alias("queries"), F.round(F.avg("candidate_size"), 6).alias("candidate_size"), F.round(F.avg("recall"), 6).alias("recall")]
    return evaluated.groupBy(*by).agg(*aggs) if by else evaluated.agg(*aggs)
