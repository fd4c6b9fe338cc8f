"""Queries: signatures, banded hashing, exact and reranked search, evaluation."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.text import ngram_set
from tidewrack.functions.vectors import encode, hyperplane_bits, hyperplanes, mean_pool
from tidewrack.operators import lsh, minhash
from tidewrack.operators.lsh import EMBEDDING_LSH, NGRAM_LSH, LshConfig
from tidewrack.operators.search import RERANK_K, TOP_K, EmbeddingIndex, NgramIndex
from tidewrack.plans.text import GRAMS, PADDED
from tidewrack.runtime import spread, stage, table

#: Queries are the rows whose id is divisible by this, against all rows.
EVERY = 100
JACCARD_K = 20
COSINE_K = 50
DIM = 64
SAMPLED = 200
# The band shapes that are compared.
SWEEP = [LshConfig(64, 8), LshConfig(32, 16), LshConfig(16, 32), LshConfig(8, 64)]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))


def _sets(spark, d) -> DataFrame:
    return stage(_docs(spark, d).select("doc_id", ngram_set(F.col("text")).alias("items")), "sets")


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("doc_id") % EVERY == 0).withColumnRenamed("doc_id", "query_id")


def minhash_signatures(spark, d):
    s = minhash.signatures(_sets(spark, d), "doc_id", "items")
    return s.select("doc_id", F.md5(F.array_join("signature", "")).alias("signature_md5"))


def _ngram_index(spark, d) -> DataFrame:
    return stage(lsh.index(minhash.signatures(_sets(spark, d), "doc_id", "items"), NGRAM_LSH), "bands")


def lsh_index_buckets(spark, d):
    return lsh.buckets(_ngram_index(spark, d))


def lsh_index_size(spark, d):
    return lsh.index_size(_ngram_index(spark, d))


def _probe(idx: DataFrame) -> DataFrame:
    return lsh.candidates(_asked(idx), idx)


def lsh_ngram_candidates(spark, d):
    return _probe(_ngram_index(spark, d))


def jaccard_topk_exact(spark, d):
    sets = _sets(spark, d)
    return lsh.exact_jaccard(_asked(sets), sets, JACCARD_K)


def lsh_ngram_recall(spark, d):
    sets = _sets(spark, d)
    idx = stage(lsh.index(minhash.signatures(sets, "doc_id", "items"), NGRAM_LSH), "bands")
    truth = lsh.exact_jaccard(_asked(sets), sets, JACCARD_K)
    return lsh.evaluate(_probe(idx), truth, _asked(sets)).withColumn("recall", F.round("recall", 6))


def ngram_search_rerank(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return NgramIndex(_docs(spark, d)).search(queries, TOP_K, RERANK_K)


def ngram_search_all(spark, d):
    """As ``ngram_search_rerank``, but every candidate is scored."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return NgramIndex(_docs(spark, d)).search(queries, TOP_K, None)


def hyperplane_signatures(spark, d):
    bits = hyperplane_bits(F.col("embedding"), EMBEDDING_LSH.num_hashes, DIM, EMBEDDING_LSH.seed)
    return _vectors(spark, d).select(F.col("doc_id").alias("vec_id"), bits.alias("signature"))


def lsh_embedding_candidates(spark, d):
    index = EmbeddingIndex(_vectors(spark, d), DIM)
    return index.candidates(_asked(_vectors(spark, d)))[1]


def cosine_topk_exact(spark, d):
    return lsh.exact_cosine(_asked(_vectors(spark, d)), _vectors(spark, d), COSINE_K)


def embedding_search_rerank(spark, d):
    return EmbeddingIndex(_vectors(spark, d), DIM, SWEEP[0]).search(_asked(_vectors(spark, d)), TOP_K, RERANK_K)


def embedding_search_all(spark, d):
    """As ``embedding_search_rerank``, but every candidate is scored."""
    return EmbeddingIndex(_vectors(spark, d), DIM, SWEEP[0]).search(_asked(_vectors(spark, d)), TOP_K, None)


def _evaluated(vectors: DataFrame, truth: DataFrame, configs) -> DataFrame:
    """All configurations share one signature of the same length and one query sample."""
    c = configs[0]
    signed = stage(vectors.select("doc_id", hyperplane_bits(F.col("embedding"), c.num_hashes, DIM, c.seed).alias("signature")), "signed")
    out = None
    for c in configs:
        idx = lsh.index(signed, c, bits=True)
        e = lsh.evaluate(lsh.candidates(_asked(idx), idx), truth, _asked(signed)).withColumn("bands", F.lit(c.bands)).withColumn("rows", F.lit(c.rows))
        out = e if out is None else out.unionAll(e)
    return out


def embedding_band_sweep(spark, d):
    vectors = _vectors(spark, d)
    truth = stage(lsh.exact_cosine(_asked(vectors), vectors, COSINE_K), "truth")
    return lsh.summary(_evaluated(vectors, truth, SWEEP), "bands", "rows")


def gram_vectors(texts: list[str]) -> np.ndarray:
    """Stand-in encoder: signed counts of hashed words; no model is at hand."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(out, texts):
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            row[h % DIM] += 1.0 if h >> 16 & 1 else -1.0
    return out


def lsh_contrast_report(spark, d):
    docs = _docs(spark, d)
    sets = _sets(spark, d)
    vectors = stage(encode(docs, "doc_id", "text", gram_vectors, DIM), "encoded")
    truths = {
        "jaccard": stage(lsh.exact_jaccard(_asked(sets), sets, JACCARD_K), "truth"),
        "cosine": stage(lsh.exact_cosine(_asked(vectors), vectors, JACCARD_K), "truth"),
    }
    keys = {
        "ngram": lsh.keyed(minhash.signatures(sets, "doc_id", "items"), NGRAM_LSH),
        "embedding": lsh.keyed(EmbeddingIndex(vectors, DIM).signatures, EMBEDDING_LSH, bits=True),
    }
    out = None
    for name, k in keys.items():
        k = stage(k, "bands")
        e = lsh.evaluate_counted(k, _asked(k), NGRAM_LSH.bands if name == "ngram" else EMBEDDING_LSH.bands, truths)
        s = lsh.summary(e, "truth").select(F.lit(name).alias("index"), "truth", "queries", "candidate_size", F.col("recall").alias("recall_at_k"))
        out = s if out is None else out.unionAll(s)
    return out


def sampled_queries(spark, d):
    """The experiments' draw of queries without replacement."""
    return lsh.sampled(table(spark, d, "documents").where("text is not null").select("doc_id"), SAMPLED)


def mean_pooled(spark, d):
    pooled = mean_pool(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "mean")).select("label", "dim", F.round("mean", 6).alias("mean"))


def queries() -> dict:
    named = [minhash_signatures, lsh_index_buckets, lsh_index_size, lsh_ngram_candidates, jaccard_topk_exact, lsh_ngram_recall, ngram_search_rerank, ngram_search_all, hyperplane_signatures, lsh_embedding_candidates, cosine_topk_exact, embedding_search_rerank, embedding_search_all, embedding_band_sweep, lsh_contrast_report, sampled_queries, mean_pooled]
    return {f.__name__: f for f in named}


_SALTS = ", ".join(f"({k}, '{minhash.salt_hex(s)}')" for k, s in enumerate(minhash.salts()))
_ZEROS = "0" * 40


def _signed(source: str, id_col: str) -> str:
    """CTEs g (id, gram), s (id, k, h): distinct grams and signatures of texts (id, text)."""
    return f"""
        p AS (SELECT {id_col} AS id, {PADDED} AS p FROM {source} WHERE text IS NOT NULL),
        g AS MATERIALIZED (SELECT DISTINCT id, unnest({GRAMS}) AS gram FROM p),
        salts(k, salt) AS (VALUES {_SALTS}),
        v AS MATERIALIZED (SELECT gram, k, sha1(encode(gram) || unhex(salt)) AS h FROM (SELECT DISTINCT gram FROM g), salts),
        s AS MATERIALIZED (SELECT p.id, salts.k, coalesce(m.h, '{_ZEROS}') AS h FROM p CROSS JOIN salts
          LEFT JOIN (SELECT g.id, v.k, min(v.h) AS h FROM g JOIN v USING (gram) GROUP BY ALL) m ON m.id = p.id AND m.k = salts.k)"""


def _banded(rows: int = 4) -> str:
    return f"b AS MATERIALIZED (SELECT id, k // {rows} AS band, sha1(string_agg(h, ',' ORDER BY k)) AS band_key FROM s GROUP BY ALL)"


_NGRAM = f"WITH {_signed('documents', 'doc_id')}, {_banded()}"
_CANDIDATES = f"f AS MATERIALIZED (SELECT DISTINCT q.id AS q, b.id AS d FROM b q JOIN b ON q.band = b.band AND q.band_key = b.band_key WHERE q.id % {EVERY} = 0)"
_SIZES = "n AS (SELECT p.id, count(g.gram) AS n FROM p LEFT JOIN g ON p.id = g.id GROUP BY p.id)"
_EXACT = f"""
    {_SIZES},
    i AS (SELECT a.id AS q, b.id AS d, count(*) AS n FROM g a JOIN g b USING (gram) WHERE a.id % {EVERY} = 0 GROUP BY ALL),
    j AS (SELECT x.id AS q, y.id AS d, round(coalesce(i.n / (x.n + y.n - i.n)::DOUBLE, 0.0), 9) AS score FROM n x CROSS JOIN n y LEFT JOIN i ON i.q = x.id AND i.d = y.id WHERE x.id % {EVERY} = 0),
    t AS MATERIALIZED (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM j QUALIFY rank <= {JACCARD_K})"""


def _planes(config: LshConfig) -> str:
    rows = ", ".join(f"({i}, [{', '.join(repr(float(x)) for x in p)}]::DOUBLE[])" for i, p in enumerate(hyperplanes(config.num_hashes, DIM, config.seed)))
    return f"planes(k, plane) AS (VALUES {rows})"


def _bits(config: LshConfig) -> str:
    return f"{_planes(config)}, e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), s AS MATERIALIZED (SELECT id, string_agg(CASE WHEN list_inner_product(v, plane) >= 0 THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM e, planes GROUP BY id)"


def _bit_bands(c: LshConfig, name: str = "b") -> str:
    return f"{name} AS MATERIALIZED (SELECT id, j AS band, substr(bits, j * {c.rows} + 1, {c.rows}) AS band_key FROM s, range({c.bands}) r(j))"


_COSINE = "list_inner_product(x.v, y.v) / nullif(sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v)), 0)"
_VEC = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    sweeps = " UNION ALL ".join(
        f"SELECT {c.bands} AS bands, {c.rows} AS rows, q.id AS q, (SELECT count(DISTINCT y.id) FROM b{n} x JOIN b{n} y ON x.band = y.band AND x.band_key = y.band_key WHERE x.id = q.id) AS cand, (SELECT count(DISTINCT y.id) FROM b{n} x JOIN b{n} y ON x.band = y.band AND x.band_key = y.band_key JOIN t ON t.q = x.id AND t.d = y.id WHERE x.id = q.id) AS hits FROM q"
        for n, c in enumerate(SWEEP)
    )
    return {
        "minhash_signatures": f"WITH {_signed('documents', 'doc_id')} SELECT id AS doc_id, md5(string_agg(h, '' ORDER BY k)) AS signature_md5 FROM s GROUP BY id",
        "lsh_index_buckets": f"{_NGRAM} SELECT band::INT AS band, n AS bucket_size, count(*) AS buckets FROM (SELECT band, band_key, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL",
        "lsh_index_size": "SELECT count(*) AS added, count(DISTINCT doc_id) AS distinct_docs FROM documents WHERE text IS NOT NULL",
        "lsh_ngram_candidates": f"{_NGRAM}, {_CANDIDATES} SELECT q AS query_id, d AS doc_id FROM f",
        "jaccard_topk_exact": f"WITH p AS (SELECT doc_id AS id, {PADDED} AS p FROM documents WHERE text IS NOT NULL), g AS MATERIALIZED (SELECT DISTINCT id, unnest({GRAMS}) AS gram FROM p), {_EXACT} SELECT q AS query_id, d AS doc_id, score, rank::INT AS rank FROM t",
        "lsh_ngram_recall": f"""{_NGRAM}, {_CANDIDATES}, {_EXACT}
            SELECT p.id AS query_id, (SELECT count(*) FROM f WHERE f.q = p.id) AS candidate_size, (SELECT count(*) FROM f JOIN t ON f.q = t.q AND f.d = t.d WHERE f.q = p.id) AS hits,
              round((SELECT count(*) FROM f JOIN t ON f.q = t.q AND f.d = t.d WHERE f.q = p.id) / greatest((SELECT count(*) FROM t WHERE t.q = p.id), 1)::DOUBLE, 6) AS recall
            FROM p WHERE p.id % {EVERY} = 0""",
        "ngram_search_rerank": f"""
            WITH mixed AS (SELECT doc_id * 2 AS id, text FROM documents UNION ALL SELECT item_id * 2 + 1, text FROM benchmark),
            {_signed('mixed', 'id')}, {_banded()}, {_SIZES},
            f AS MATERIALIZED (SELECT DISTINCT q.id AS q, b.id AS d FROM b q JOIN b ON q.band = b.band AND q.band_key = b.band_key WHERE q.id % 2 = 1 AND b.id % 2 = 0),
            capped AS MATERIALIZED (SELECT q, d, count(*) OVER (PARTITION BY q) AS candidate_size FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY d) <= {RERANK_K}),
            i AS (SELECT c.q, c.d, count(*) AS n FROM capped c JOIN g a ON a.id = c.q JOIN g b ON b.id = c.d AND a.gram = b.gram GROUP BY ALL),
            j AS (SELECT c.q, c.d, c.candidate_size, round(coalesce(i.n / (x.n + y.n - i.n)::DOUBLE, 0.0), 9) AS score FROM capped c LEFT JOIN i ON i.q = c.q AND i.d = c.d JOIN n x ON x.id = c.q JOIN n y ON y.id = c.d)
            SELECT (q - 1) // 2 AS query_id, candidate_size, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INT AS rank, d // 2 AS doc_id, score FROM j QUALIFY rank <= {TOP_K}""",
        "ngram_search_all": f"""
            WITH mixed AS (SELECT doc_id * 2 AS id, text FROM documents UNION ALL SELECT item_id * 2 + 1, text FROM benchmark),
            {_signed('mixed', 'id')}, {_banded()}, {_SIZES},
            f AS MATERIALIZED (SELECT DISTINCT q.id AS q, b.id AS d FROM b q JOIN b ON q.band = b.band AND q.band_key = b.band_key WHERE q.id % 2 = 1 AND b.id % 2 = 0),
            c AS MATERIALIZED (SELECT q, d, count(*) OVER (PARTITION BY q) AS candidate_size FROM f),
            i AS (SELECT c.q, c.d, count(*) AS n FROM c JOIN g a ON a.id = c.q JOIN g b ON b.id = c.d AND a.gram = b.gram GROUP BY ALL),
            j AS (SELECT c.q, c.d, c.candidate_size, round(coalesce(i.n / (x.n + y.n - i.n)::DOUBLE, 0.0), 9) AS score FROM c LEFT JOIN i ON i.q = c.q AND i.d = c.d JOIN n x ON x.id = c.q JOIN n y ON y.id = c.d)
            SELECT (q - 1) // 2 AS query_id, candidate_size, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INT AS rank, d // 2 AS doc_id, score FROM j QUALIFY rank <= {TOP_K}""",
        "hyperplane_signatures": f"WITH {_bits(EMBEDDING_LSH)} SELECT id AS vec_id, bits AS signature FROM s",
        "lsh_embedding_candidates": f"WITH {_bits(EMBEDDING_LSH)}, {_bit_bands(EMBEDDING_LSH)} SELECT DISTINCT x.id AS query_id, y.id AS doc_id FROM b x JOIN b y ON x.band = y.band AND x.band_key = y.band_key WHERE x.id % {EVERY} = 0",
        "cosine_topk_exact": f"WITH e AS ({_VEC}) SELECT x.id AS query_id, y.id AS doc_id, round(coalesce({_COSINE}, 0.0), 9) AS score, row_number() OVER (PARTITION BY x.id ORDER BY round(coalesce({_COSINE}, 0.0), 9) DESC, y.id)::INT AS rank FROM e x, e y WHERE x.id % {EVERY} = 0 QUALIFY rank <= {COSINE_K}",
        "embedding_search_rerank": f"""WITH {_bits(SWEEP[0])}, {_bit_bands(SWEEP[0])},
            f AS MATERIALIZED (SELECT DISTINCT x.id AS q, y.id AS d FROM b x JOIN b y ON x.band = y.band AND x.band_key = y.band_key WHERE x.id % {EVERY} = 0),
            capped AS (SELECT q, d, count(*) OVER (PARTITION BY q) AS candidate_size FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY d) <= {RERANK_K}),
            j AS (SELECT q, d, candidate_size, round(coalesce({_COSINE}, 0.0), 9) AS score FROM capped JOIN e x ON x.id = q JOIN e y ON y.id = d)
            SELECT q AS query_id, candidate_size, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INT AS rank, d AS doc_id, score FROM j QUALIFY rank <= {TOP_K}""",
        "embedding_search_all": f"""WITH {_bits(SWEEP[0])}, {_bit_bands(SWEEP[0])},
            f AS MATERIALIZED (SELECT DISTINCT x.id AS q, y.id AS d FROM b x JOIN b y ON x.band = y.band AND x.band_key = y.band_key WHERE x.id % {EVERY} = 0),
            j AS (SELECT q, d, count(*) OVER (PARTITION BY q) AS candidate_size, round(coalesce({_COSINE}, 0.0), 9) AS score FROM f JOIN e x ON x.id = q JOIN e y ON y.id = d)
            SELECT q AS query_id, candidate_size, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INT AS rank, d AS doc_id, score FROM j QUALIFY rank <= {TOP_K}""",
        "embedding_band_sweep": f"""WITH {_bits(EMBEDDING_LSH)}, {', '.join(_bit_bands(c, f'b{n}') for n, c in enumerate(SWEEP))},
            t AS MATERIALIZED (SELECT x.id AS q, y.id AS d, row_number() OVER (PARTITION BY x.id ORDER BY round(coalesce({_COSINE}, 0.0), 9) DESC, y.id) AS rank FROM e x, e y WHERE x.id % {EVERY} = 0 QUALIFY rank <= {COSINE_K}),
            q AS (SELECT id, (SELECT count(*) FROM t WHERE t.q = e.id) AS wanted FROM e WHERE id % {EVERY} = 0),
            r AS ({sweeps})
            SELECT bands::INT AS bands, rows::INT AS rows, count(*) AS queries, round(avg(cand), 6) AS candidate_size, round(avg(hits / greatest(wanted, 1)::DOUBLE), 6) AS recall FROM r JOIN q ON r.q = q.id GROUP BY ALL""",
        "sampled_queries": f"SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY md5('47:' || doc_id::VARCHAR), doc_id LIMIT {SAMPLED}",
        "mean_pooled": "SELECT label, (i - 1)::INT AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) r(i) WHERE embedding IS NOT NULL GROUP BY ALL",
    }
