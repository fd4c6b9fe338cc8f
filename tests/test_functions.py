import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.functions import hashing, html, text, urls, vectors
from tidewrack.operators import lsh, minhash


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def normalize(t):
    t = re.sub(r"http\S+|www\S+", " ", t.lower())
    return " ".join(re.sub(r"[^a-zA-Z]+", " ", t).split())


TEXTS = ["", "...", "a\nb é c", "see http://x.y/z now WWW.a b", "Ab12 cd  e", "nbsp org the TD", None, "x" * 30_000, "K İ ΑΣ", "a\tb c"]


def test_normalize(spark):
    assert column(spark, TEXTS, text.normalize_text) == [None if t is None else normalize(t) for t in TEXTS]


def test_tokens(spark):
    expected = [None if t is None else [w for w in re.findall("[a-zA-Z0-9]+", t.lower()) if w not in text.STOPWORDS and len(w) > 1] for t in TEXTS]
    assert column(spark, TEXTS, text.word_tokens) == expected
    assert len(text.STOPWORDS) == len(set(text.STOPWORDS)) == 48


@pytest.mark.parametrize("n", [2, 3, 5])
def test_ngrams(spark, n):
    def grams(t):
        p = f" {' '.join(re.sub('[^a-zA-Z0-9 ]+', '', t.lower()).split())} "
        return [p[i : i + n] for i in range(len(p) - n + 1)]

    assert column(spark, TEXTS, lambda c: text.char_ngrams(c, n)) == [None if t is None else grams(t) for t in TEXTS]
    with pytest.raises(ValueError):
        text.char_ngrams(F.col("x"), 1)


def test_snippet(spark):
    long = "word \n " * 200
    flat = " ".join(long.split())
    assert column(spark, [long, " a  b ", None], text.snippet) == [flat[:350] + "...", "a b", None]


def test_page_text():
    assert html.page_text("<li>a</li><li>b</li>") == "ab"
    assert html.page_text("x<br>y<p>  z &amp; &eacute;</p>") == "xy z & é"
    assert html.page_text("<head><title>t </title><style>s</style></head><header>h<nav>n</nav></header><nav>m</nav><script>q<p></script><!-- c --><footer>f</footer><noscript>o</noscript> e") == "t m e"
    assert html.page_text("<header>a<p>b</header>c") == "c"
    assert html.page_text("") == "" and html.page_text(None) is None


def test_urls():
    r = urls.resolve_url
    assert r("../b/?q=/#x", "http://h/a/c") == "http://h/b/?q="
    assert r("//o.example/x/", "https://h/a") == "https://o.example/x"
    assert r("mailto:a@b", "http://h") is None and r("http://[::1", "http://h") is None and r(None, "http://h") is None
    assert r("/x", "http://h:8080/a", "h:8080") == "http://h:8080/x" and r("/x", "http://h:8080/a", "h") is None
    assert urls.page_links('<a href="/x/">1</a><a href="/x#f">2</a><a>3</a><a href="ftp://q">4</a>', "http://h/") == ["http://h/x"]


def test_hashes(spark):
    df = spark.createDataFrame([(0, "term"), (11, "ünï")], "row int, term string")
    got = df.select(hashing.sketch_cell(F.col("row"), F.col("term"), 997, "xxh64").alias("x"), hashing.sketch_cell(F.col("row"), F.col("term"), 997).alias("m"), hashing.item_hash(F.col("term"), F.lit("01020304")).alias("s")).collect()
    for r, (row, term) in zip(got, [(0, "term"), (11, "ünï")]):
        assert r.x == xxhash.xxh64(f"{row}{term}").intdigest() % 997
        assert r.m == int(hashlib.md5(f"{row}{term}".encode()).hexdigest()[:15], 16) % 997
        assert r.s == hashlib.sha1(term.encode() + bytes([1, 2, 3, 4])).hexdigest()
    assert minhash.salts(4) == [1511168161, 1475191316, 2200931793, 440044526]


def test_vectors(spark):
    v = [[3.0, 4.0], [0.0, 0.0], None, [-1.0, 2.0]]
    assert column(spark, v, vectors.l2_normalize, "array<double>")[:3] == [[0.6, 0.8], [0.0, 0.0], None]
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    bits = column(spark, v, lambda c: vectors.hyperplane_bits(c, 16, 2), "array<double>")
    planes = vectors.hyperplanes(16, 2).astype(float)
    assert bits == ["".join(str(int(p @ np.array(x) >= 0)) for p in planes) if x else None for x in v]
    assert bits[1] == "1" * 16
    with pytest.raises(ValueError):
        vectors.hyperplanes(0, 3)


def test_mean_pool(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 6.0], 1), (1, 2, [9.0, 9.0], 0), (2, 0, None, 1)], "g int, p int, v array<double>, m int")
    assert [tuple(r) for r in vectors.mean_pool(rows, "g", "p", "v", "m").collect()] == [(1, [2.0, 4.0])]


def test_encoder_hook(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string")
    out = vectors.encode(docs, "doc_id", "text", lambda t: np.array([[len(x), 1.0] for x in t]), 2)
    assert {r.doc_id: r.embedding for r in out.collect()} == {1: [2.0, 1.0], 2: None}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sets(st.text("abcdef", min_size=1, max_size=3), max_size=20), min_size=1, max_size=5))
def test_minhash(spark, sets):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "doc_id bigint, items array<string>")
    salts = minhash.salts(8)
    expected = {i: [min((hashlib.sha1(x.encode() + t.to_bytes(4, "little")).hexdigest() for x in s), default="0" * 40) for t in salts] for i, s in enumerate(sets)}
    for most in (100, 0):
        got = minhash.signatures(df, "doc_id", "items", 8, max_vocabulary=most)
        assert {r.doc_id: r.signature for r in got.collect()} == expected


def test_lsh_wrong_length(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "doc_id bigint, signature array<string>")
    with pytest.raises(Exception, match="must have 4 values"):
        lsh.index(df, lsh.LshConfig(2, 2)).collect()


def test_exact_searches(spark):
    r = random.Random(3)
    sets = [(i, [str(r.randrange(12)) for _ in range(r.randrange(6))]) for i in range(40)]
    df = spark.createDataFrame(sets, "doc_id bigint, items array<string>")
    q = df.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    got = {(x.query_id, x["rank"]): x.doc_id for x in lsh.exact_jaccard(q, df, 30).collect()}

    def jac(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a and b else 0.0

    for i in range(0, 40, 10):
        best = sorted(range(40), key=lambda j: (-round(jac(sets[i][1], sets[j][1]), 9), j))[:30]
        assert [got[i, k + 1] for k in range(30)] == best


def test_embedding_search_scores_all(spark):
    """The best answer has the highest id of many candidates."""
    from tidewrack.operators.search import EmbeddingIndex

    r = np.random.default_rng(5)
    base = r.normal(size=8)
    rows = [(i, [float(x) for x in base + r.normal(size=8) * 0.3]) for i in range(80)] + [(900, [float(x) for x in base])]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>")
    q = spark.createDataFrame([(1, rows[-1][1])], "query_id bigint, embedding array<float>")
    index = EmbeddingIndex(df, 8, lsh.LshConfig(16, 1))
    best = index.search(q, 5, None).orderBy("rank").collect()
    found = [x.doc_id for x in index.candidates(q)[1].collect()]
    v = {i: np.array(x, np.float32).astype(float) for i, x in rows}
    cos = {i: v[i] @ v[900] / np.linalg.norm(v[i]) / np.linalg.norm(v[900]) for i in found}
    assert len(found) > 50 and best[0].candidate_size == len(found)
    assert [x.doc_id for x in best] == sorted(found, key=lambda i: -cos[i])[:5] and best[0].doc_id == 900


def test_ngram_search_scores_all(spark):
    """The best answer has the highest id of many candidates."""
    from tidewrack.operators.search import NgramIndex

    rows = [(i, f"the same words in every text but for {i} and {i * 7}") for i in range(70)] + [(900, "the same words in every text but for none"), (901, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    q = spark.createDataFrame([(1, rows[70][1]), (2, None)], "query_id bigint, text string")
    best = NgramIndex(df).search(q, 5, None).orderBy("rank").collect()
    assert best[0].candidate_size > 50 and (best[0].doc_id, best[0].score) == (900, 1.0) and len(best) == 5


@pytest.mark.parametrize("block", [2, 4096])
def test_counted_evaluation(spark, block):
    """Counting without pairs agrees with the join: queries with and without hits, ids that come twice, null ids, several blocks."""
    r = random.Random(7)
    signed = [(i, [str(r.randrange(3)) for _ in range(4)]) for i in [*range(30), 0, 5, None, None]] + [(40, ["x"] * 4), (41, None)]
    df = spark.createDataFrame(signed, "doc_id bigint, signature array<string>")
    shape = lsh.LshConfig(2, 2)
    keys, idx = lsh.keyed(df, shape), lsh.index(df, shape)
    asked = F.col("doc_id") % 5 == 0
    pairs = spark.createDataFrame([(q, d) for q in range(0, 30, 5) for d in range(q, q + 12)] + [(0, 3), (0, None)], "query_id bigint, doc_id bigint")
    truths = {"all": pairs, "some": pairs.where("query_id < 12 and doc_id % 3 = 0"), "none": pairs.where("false")}
    got = lsh.evaluate_counted(keys, keys.where(asked).withColumnRenamed("doc_id", "query_id"), 2, truths, block=block)
    queries = idx.where(asked).withColumnRenamed("doc_id", "query_id")
    found = lsh.candidates(queries, idx)
    for name, truth in truths.items():
        expected = lsh.evaluate(found, truth, queries)
        assert sorted(got.where(F.col("truth") == name).drop("truth").collect()) == sorted(expected.select("query_id", "candidate_size", "hits", "recall").collect())


def test_contrast_report(spark, small):
    """Sizes and recall from the pairs themselves, and no staged pairs."""
    from tidewrack import runtime
    from tidewrack.operators.search import EmbeddingIndex
    from tidewrack.plans import similarity as s

    before = len(runtime._staged)
    got = {(x["index"], x.truth): (x.queries, x.candidate_size, x.recall_at_k) for x in s.lsh_contrast_report(spark, small).collect()}
    assert not [p for p in runtime._staged[before:] if "/found-" in p]
    docs, sets = s._docs(spark, small), s._sets(spark, small)
    coded = vectors.encode(docs, "doc_id", "text", s.gram_vectors, s.DIM)
    truths = {"jaccard": lsh.exact_jaccard(s._asked(sets), sets, s.JACCARD_K), "cosine": lsh.exact_cosine(s._asked(coded), coded, s.JACCARD_K)}
    found = {"ngram": s.lsh_ngram_candidates(spark, small), "embedding": EmbeddingIndex(coded, s.DIM).candidates(s._asked(coded))[1]}
    for (name, f), (truth, t) in [(x, y) for x in found.items() for y in truths.items()]:
        assert got[name, truth] == tuple(lsh.summary(lsh.evaluate(f, t, s._asked(sets))).first())
    assert len(got) == 4


def test_jaccard_keeps_items_once(spark):
    """The driver's memory follows the distinct items, not the items of all queries."""
    import tracemalloc

    df = spark.range(600).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda x: F.concat(F.lit("item-"), x)).alias("items"))
    q = df.withColumnRenamed("doc_id", "query_id")
    tracemalloc.start()
    best = lsh.exact_jaccard(q, df.where("doc_id < 2"), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6 and {(x.doc_id, x.score) for x in best.collect()} == {(0, 1.0)}


def test_exact_cosine_in_parts(spark, monkeypatch):
    """The best of a task over many parts, with ties by id."""
    monkeypatch.setattr(lsh, "CELLS", 7)
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>").coalesce(2)
    got = lsh.exact_cosine(df.where("doc_id % 30 = 0").withColumnRenamed("doc_id", "query_id"), df, 4, block=2)
    v = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in rows}
    best = {q: sorted(v, key=lambda i: (-np.round(v[q] @ v[i], 9), i))[:4] for q in range(0, 90, 30)}
    assert {(x.query_id, x["rank"]): x.doc_id for x in got.collect()} == {(q, n + 1): i for q, own in best.items() for n, i in enumerate(own)}


def test_reach_to_the_end(spark, tmp_path):
    """A chain of 20 links behind a loop, from a seed with a high id, without and with an empty parent."""
    from tidewrack.plans import crawl

    rows = [(1000 + i, f"http://h/{i}", "" if i == 0 else f"http://h/{i - 1}", [f"http://h/{i + 1}", "http://h/0"]) for i in range(20)]
    rows += [(2000, "http://h/alone/", None, [])]
    spark.createDataFrame(rows, "fetch_id bigint, url string, parent_url string, out_links array<string>").write.parquet(f"{tmp_path}/fetch_info.parquet")
    got = {r.url: r.depth for r in crawl.crawl_bfs_all(spark, str(tmp_path)).collect()}
    assert got == {f"http://h/{i}": i for i in range(21)} | {"http://h/alone": 0}
