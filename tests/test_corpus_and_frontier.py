"""WARC files, corpora, page sinks, frontier items, sketches on disk and stream handlers, against values worked out by hand."""

import hashlib
import json
import os

import pytest

from tidewrack.operators import bloom, count_min, lsh
from tidewrack.runtime import drop_stages, stage
from tidewrack.sources import corpus
from tidewrack.streaming import crawl, state


def http(body, kind="text/html"):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body


def test_warc_round_trip(spark, tmp_path):
    records = [("request", "http://a/", b"GET / HTTP/1.1\r\n\r\n"), ("response", "http://a/", http(b"<p>One <b>two</b> caf\xe9 \xff three</p>")), ("response", "http://b/", http(b"", "image/png")), ("response", "http://c/", http(b"%PDF-1.4 x"))]
    corpus.write_warc(str(tmp_path / "x.warc.gz"), records)
    got = corpus.read_warc(spark, str(tmp_path))
    rows = got.orderBy("record_no").collect()
    assert [(r.rec_type, r.target_uri, r.payload) for r in rows] == [("request", "http://a/", ""), ("response", "http://a/", "<p>One <b>two</b> caf  three</p>"), ("response", "http://b/", ""), ("response", "http://c/", "%PDF-1.4 x")]
    texts = {r.target_uri: r.text for r in corpus.document_texts(got).collect()}
    assert texts == {"http://a/": "one two caf three", "http://b/": "", "http://c/": "pdf x"}
    assert {r.target_uri for r in corpus.document_texts(got, only_markup=True).collect()} == {"http://a/"}
    first = corpus.first_documents(corpus.document_texts(got), ["record_no"], 2).orderBy("doc_id").collect()
    assert [(r.doc_id, r.target_uri) for r in first] == [(0, "http://a/"), (1, "http://b/")]


def test_page_sink(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}" if i else None, "<p>x</p>") for i in range(5)], "n bigint, url string, html string")
    manifest = corpus.save_pages(pages, str(tmp_path), ["n"], 3)
    assert [r.n for r in manifest.orderBy("n").collect()] == [1, 2, 3]
    assert spark.read.parquet(f"{tmp_path}/pages").count() == 3
    saved = spark.read.json(f"{tmp_path}/metadata").collect()
    assert {r.file_id for r in saved} == {hashlib.md5(f"http://a/{i}".encode()).hexdigest() for i in (1, 2, 3)}
    assert "html" not in saved[0].asDict()


def test_frontier_items(spark):
    raw = ['{"url": "http://a/", "parent_url": "http://p/", "depth": 3, "discover_timestamp": 1.5}', '{"url": "http://b/"}', "http://bare/", "12", '"quoted"', "[1]", '{"depth": 1}', "{broken", None]
    got = {r.url: (r.parent_url, r.depth, r.discover_timestamp) for r in crawl.decode_items(spark.createDataFrame([(x,) for x in raw], "value string"), now=9.0).collect()}
    assert got == {"http://a/": ("http://p/", 3, 1.5), "http://b/": (None, 0, 9.0), "http://bare/": (None, 0, 9.0), "12": (None, 0, 9.0), '"quoted"': (None, 0, 9.0), "[1]": (None, 0, 9.0), "{broken": (None, 0, 9.0)}
    items = crawl.frontier(spark, ["http://a/", "http://b/"], 2.0)
    again = crawl.decode_items(crawl.encode_items(items))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, items.collect()))
    with pytest.raises(ValueError):
        crawl.frontier(spark, [""])
    assert crawl.seeded(items.limit(0), items).count() == 2 and crawl.seeded(items.limit(1), items).count() == 1
    assert crawl.default_domain("https://h.example:8080/x", spark) == "h.example:8080"


def test_crawl_runs_until_nothing_is_new(spark):
    pages = spark.createDataFrame([(f"http://h/{i}", f"<a href='/{i + 1}'>n</a><a href='/0'>b</a>") for i in range(14)], "url string, html string")
    seen = []
    out = crawl.crawl(crawl.frontier(spark, ["http://h/0"]), crawl.table_fetcher(pages), handler=lambda df: seen.append(df.count()))
    assert {(r.url, r.depth) for r in out.collect()} == {(f"http://h/{i}", i) for i in range(14)}
    assert seen == [1] * 14 + [0]

    def broken(df):
        raise RuntimeError("sink")

    assert crawl.crawl(crawl.frontier(spark, ["http://h/0"]), crawl.table_fetcher(pages), max_depth=1, handler=broken).count() == 2


def test_count_min_on_disk(spark, tmp_path):
    tf = spark.createDataFrame([("a", 5), ("b", 2), (None, 9)], "term string, tf bigint")
    sketch = count_min.CountMin.build(tf, 50, 3, "xxh64")
    sketch.save(str(tmp_path / "cms"))
    for again in (count_min.CountMin.load(spark, str(tmp_path / "cms")), count_min.CountMin.from_json(spark, sketch.to_json())):
        assert {r.term: r.estimate for r in again.lookup(["A", "b", "none"]).collect()}["a"] >= 5
        more = again.update(spark.createDataFrame([("a", 1)], "term string, tf bigint"))
        assert more.total_updates().first()[0] == 8
    dense = json.loads(sketch.to_json())
    assert sorted(dense) == ["depth", "tables", "total_updates", "width"] and dense["total_updates"] == 7 and all(sum(row) == 7 for row in dense["tables"])
    with pytest.raises(ValueError):
        sketch.merge(count_min.CountMin.build(tf, 51, 3, "xxh64"))


def test_stream_handlers(spark, tmp_path):
    spark.createDataFrame([(i, f"k{i % 3}") for i in range(9)], "n bigint, k string").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    seen = []
    state.to_handler(state.read_stream(spark, str(tmp_path / "in"), schema), lambda df: seen.append(df.count()), f"h-{tmp_path.name}")
    assert sum(seen) == 9

    def broken(df):
        raise RuntimeError("sink")

    state.to_handler(state.read_stream(spark, str(tmp_path / "in"), schema), broken, f"b-{tmp_path.name}")


def test_sample_of_queries(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    one, two = (sorted(r.doc_id for r in lsh.sampled(df, 10, 47).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 10
    assert lsh.sampled(df, 10, 48).join(lsh.sampled(df, 10, 47), "doc_id").count() < 10 and lsh.sampled(df, 99).count() == 50


def test_index_without_documents(spark):
    idx = spark.createDataFrame([(0, "x", 1), (0, "x", 2), (1, "y", 1)], "band int, band_key string, doc_id bigint")
    assert {r.doc_id for r in lsh.removed(idx, spark.createDataFrame([(1,)], "doc_id bigint")).collect()} == {2}


def test_stages_are_dropped(spark):
    df = stage(spark.range(3).toDF("id"), "gone")
    path = df.inputFiles()[0].removeprefix("file://")
    drop_stages(spark)
    assert not os.path.exists(path)


def test_bloom_by_join_as_in_memory(spark, monkeypatch):
    keys = spark.range(3000).selectExpr("id AS n", "concat('k', id % 2500) AS u")
    filter_ = bloom.Bloom.build(keys, "u", "n", [(300, 0.05, 2), (5000, 0.2, 1)])
    probes = spark.range(2000, 6000).selectExpr("concat('k', id) AS u").unionAll(spark.sql("SELECT CAST(NULL AS string)"))
    local = sorted(map(tuple, filter_.contains(probes, "u").collect()))
    monkeypatch.setattr(bloom, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, filter_.contains(probes, "u").collect())) == local
    assert {c for c, _ in local} == {0, 1} and {k for c, k in local if c == 0} >= {f"k{i}" for i in range(2000, 2500)} and len(local) < 4000
    assert bloom.Bloom.build(keys.limit(0), "u", "n", [(10, 0.1, 2)]).contains(probes, "u").count() == 0


def test_exact_jaccard_by_join_as_in_memory(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"g{j}" for j in range(i % 7, i % 7 + i % 5)]) for i in range(60)] + [(99, None)], "doc_id bigint, items array<string>")
    queries = docs.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    local = sorted(map(tuple, lsh.exact_jaccard(queries, docs, 8).collect()))
    monkeypatch.setattr(lsh, "HELD_ITEMS", -1)
    assert sorted(map(tuple, lsh.exact_jaccard(queries, docs, 8).collect())) == local and len(local) == 8 * 7
    assert lsh.exact_jaccard(queries.limit(0), docs, 8).count() == 0
