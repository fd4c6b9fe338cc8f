"""End-to-end similarity search over texts and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import NGRAM, ngram_set, snippet
from tidewrack.functions.vectors import hyperplane_bits
from tidewrack.operators import lsh, minhash
from tidewrack.operators.lsh import EMBEDDING_LSH, NGRAM_LSH, LshConfig

# Size of an answer and of the reranked list.
TOP_K = 5
RERANK_K = 50


class NgramIndex:
    """MinHash LSH over character n-gram sets of (``doc_id``, ``text``) rows; null texts are left out."""

    def __init__(self, docs: DataFrame, config: LshConfig = NGRAM_LSH, n: int = NGRAM):
        self.config, self.n = config, n
        self.sets = docs.where(F.col("text").isNotNull()).select("doc_id", ngram_set(F.col("text"), n).alias("items")).persist()
        self.signatures = minhash.signatures(self.sets, "doc_id", "items", config.num_hashes, config.seed)
        self.index = lsh.index(self.signatures, config)

    def candidates(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Query sets, and (``query_id``, ``doc_id``) of candidates, for (``query_id``, ``text``) rows."""
        q = queries.where(F.col("text").isNotNull()).select("query_id", ngram_set(F.col("text"), self.n).alias("items"))
        signed = minhash.signatures(q, "query_id", "items", self.config.num_hashes, self.config.seed)
        return q, lsh.candidates(lsh.index(signed, self.config, "query_id"), self.index)

    def search(self, queries: DataFrame, top_k: int = TOP_K, rerank_k: int | None = RERANK_K) -> DataFrame:
        """(``query_id``, ``candidate_size``, ``rank``, ``doc_id``, ``score``)."""
        q, found = self.candidates(queries)
        return lsh.rerank_jaccard(found, q, self.sets, top_k, rerank_k)


class EmbeddingIndex:
    """Hyperplane LSH over (``doc_id``, ``embedding``) rows of one length; null vectors are left out."""

    def __init__(self, vectors: DataFrame, dim: int, config: LshConfig = EMBEDDING_LSH):
        self.config, self.dim = config, dim
        self.vectors = vectors.where(F.col("embedding").isNotNull()).select("doc_id", "embedding")
        self.signatures = self.vectors.select("doc_id", self._bits())
        self.index = lsh.index(self.signatures, config, bits=True)

    def _bits(self):
        return hyperplane_bits(F.col("embedding"), self.config.num_hashes, self.dim, self.config.seed).alias("signature")

    def candidates(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        q = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
        return q, lsh.candidates(lsh.index(q.select("query_id", self._bits()), self.config, "query_id", bits=True), self.index)

    def search(self, queries: DataFrame, top_k: int = TOP_K, rerank_k: int | None = RERANK_K) -> DataFrame:
        q, found = self.candidates(queries)
        return lsh.rerank_cosine(found, q, self.vectors, top_k, rerank_k)


def with_snippets(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Answers with the beginning of each document's text."""
    return answers.join(docs.select("doc_id", snippet(F.col("text")).alias("snippet")), "doc_id")
