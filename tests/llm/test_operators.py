import itertools
import os
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.llm import encoding_repair, heavy_hitters, leakage, main_content, near_duplicates, neighbors, packing, quality, seen_keys
from tidewrack.llm.arrow_text import count_tokens


# -- near-duplicates


def shingles(text, n):
    w = [x for x in text.split(" ") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def texts(r):
    base = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(r.randrange(50)) for _ in range(80)) for _ in range(12)]
    rows = []
    for b in base:
        rows.append(b)
        for _ in range(4):
            w = b.split()
            for _ in range(r.randrange(1, 5)):
                w[r.randrange(len(w))] = "new%d" % r.randrange(99)
            cut = r.randrange(len(w))
            rows.append(" ".join(w[cut:] + w[:cut]))
    rows += [base[0]] * 30  # a hot group of copies
    return rows + ["", "short text", None]


@pytest.mark.parametrize("n, similarity", [(3, 0.7), (5, 0.8)])
def test_near_duplicates_against_brute_force(spark, n, similarity):
    rows = list(enumerate(texts(random.Random(1))))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc bigint, body string, id string")
    d = near_duplicates.Duplicates(df, "doc", "body", similarity, n, 10)
    sets = {i: shingles(t, n) for i, t in rows if t and len(t.split()) >= 10}
    expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}
    assert {tuple(r) for r in d.record_pairs().collect()} == expected
    groups = {r.id: r for r in d.groups().collect()}
    assert set(groups) == set(sets)
    for a, b in expected:
        assert groups[a].group_id == groups[b].group_id
    assert all(groups[i].class_id == min(j for j in sets if sets[j] == sets[i]) for i in sets)


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "doc bigint, body string")
    d = near_duplicates.Duplicates(df, "doc", "body")
    assert d.record_pairs().count() == 0 and d.groups().count() == 0


def test_near_duplicate_groups_have_every_record(spark):
    rows = list(enumerate(["blog", "", "a b c d", "blog", None, "a  b c d", " ", "a b c d e", "b a", None]))
    df = spark.createDataFrame(rows, "doc bigint, body string")
    got = {r.id: (r.class_id, r.group_id, r.links) for r in near_duplicates.Duplicates(df, "doc", "body").groups().collect()}
    first = {0: 0, 1: 1, 2: 2, 3: 0, 5: 2, 6: 1, 7: 7, 8: 8}
    assert got == {i: (c, c, 0) for i, c in first.items()} | {i: (None, None, 0) for i in (4, 9)}


def test_sketch_estimates_similarity():
    walks = near_duplicates._walks()
    r = np.random.default_rng(0)
    for size in (3, 40, 2000):
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], r.integers(0, 2**63, size - size // 2).astype(np.uint64)]))
        x, y = near_duplicates.sketch(a, walks), near_duplicates.sketch(b, walks)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < (0.35 if size < 10 else 0.2)


# -- nearest vectors


def test_chi_square():
    assert abs(neighbors.chi2_cdf(21.026, 12) - 0.95) < 1e-4 and abs(neighbors.chi2_quantile(0.99, 2) - 9.2103) < 1e-3


@pytest.mark.parametrize("cell", [64, 100_000])
def test_neighbours_recall(spark, cell):
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 64))
    x = centres[r.integers(0, 40, 600)] + 0.2 * r.standard_normal((600, 64))
    x[5] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [1.0] * 3), (702, [0.0] * 64), (703, [float("nan")] * 64), (704, [None] + [1.0] * 63), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, emb array<float>")
    u = (x.astype(np.float32).astype(float).T / np.linalg.norm(x.astype(np.float32), axis=1)).T
    s = u @ u.T
    np.fill_diagonal(s, -2)
    expected = {(i, j) for i in range(600) for j in np.lexsort((np.arange(600), -s[i].round(7)))[:5]}
    got = {(q.query_id, q.id) for q in neighbors.nearest(df, "vec_id", "emb", 5, cell=cell).collect()}
    assert len(got) == 3000 and len(got & expected) / len(expected) > 0.95
    pairs = {(q.vec_id_a, q.vec_id_b) for q in neighbors.similar_pairs(df, "vec_id", "emb").collect()}
    wanted = {(min(i, j), max(i, j)) for i, j in expected if s[i, j] >= 0.85}
    assert len(pairs & wanted) / len(wanted) > 0.97 and (5, 6) in pairs
    report = neighbors.recall_report(df, "vec_id", "emb").first()
    assert report.recall >= 0.9


def test_neighbours_of_copies(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((60, 64))
    x[20:50] = x[20]
    df = spark.createDataFrame([(i * 100, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, emb array<float>")
    got = {}
    for q in neighbors.nearest(df, "vec_id", "emb", 5, query_every=100).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id // 100, []).append(q.id // 100)
    assert sorted(got) == list(range(60)) and all(len(v) == 5 for v in got.values())
    for i in range(20, 50):
        assert got[i] == [j for j in range(20, 26) if j != i][:5]
    s = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    np.fill_diagonal(s, -2)
    exact = {i: np.lexsort((np.arange(60), -s[i].round(7)))[:5].tolist() for i in range(60)}
    assert sum(len(set(got[i]) & set(exact[i])) for i in exact) / 300 > 0.95


def test_neighbours_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, emb array<float>")
    assert neighbors.nearest(df, "vec_id", "emb").count() == 0
    assert neighbors.similar_pairs(df, "vec_id", "emb").count() == 0


# -- heavy hitters


def test_heavy_hitters_exact(spark):
    r = random.Random(4)
    rows = [("Hot " if r.random() < 0.3 else f"w{int(r.paretovariate(0.4)) % 5000}", r.choice([1, 2, None])) for _ in range(8000)] + [(None, 5), ("  ", 99_999)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "term string, cnt bigint, h int")
    got = heavy_hitters.heavy_hitters(df, heavy_hitters.term_item(), F.coalesce("cnt", F.lit(1)), 1 / 100)
    sums = Counter()
    for t, n in rows:
        if t and t.strip(" "):
            sums[t.lower().strip(" ")] += 1 if n is None else n
    floor = sum(sums.values()) / 100
    found = got.collect()
    assert {x["item"]: x.total for x in found} == {t: n for t, n in sums.items() if n >= floor}
    assert all(x.estimate >= x.total for x in found)


def test_heavy_hitters_empty(spark):
    df = spark.createDataFrame([], "term string, cnt bigint")
    assert heavy_hitters.heavy_hitters(df, heavy_hitters.term_item(), F.col("cnt"), 0.1).count() == 0


# -- seen keys


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefg") | st.none(), st.sampled_from("abchij") | st.none()), max_size=60))
def test_seen_keys(spark, rows):
    df = spark.createDataFrame([(i, a, b, "clash") for i, (a, b) in enumerate(rows)], "n bigint, a string, b string, id string")
    seen, expected = set(), set()
    for i, row in enumerate(rows):
        keys = {k for k in row if k is not None}
        if keys & seen:
            expected.add(i)
        seen |= keys
    assert {r.n for r in seen_keys.seen_before(df, "n", [F.col("a"), F.col("b")], block=4, capacity=2).collect()} == expected


def test_seen_keys_in_batches(spark, tmp_path):
    r = random.Random(8)
    rows = [(i * 977, f"k{r.randrange(400)}" if i % 3 else "hot") for i in range(1200)]
    df = spark.createDataFrame(rows, "n bigint, a string")
    shape = {"block": 8, "capacity": 4, "error": 0.05}
    whole = {x.n for x in seen_keys.seen_before(df, "n", [F.col("a")], **shape).collect()}
    history, parts = seen_keys.History(spark, f"file://{tmp_path}/seen"), set()
    for lo, hi in ((0, 300_000), (300_000, 700_000), (700_000, 2_000_000)):
        batch = df.where((F.col("n") >= lo) & (F.col("n") < hi))
        parts |= {x.n for x in seen_keys.seen_before(batch, "n", [F.col("a")], history=history, **shape).collect()}
    first = {}
    for i, k in rows:
        first.setdefault(k, i)
    assert whole == parts == {i for i, k in rows if first[k] != i}
    assert history.keys().count() == history.keys().distinct().count() == len(first)


def test_chain_bound():
    chain = seen_keys.Chain(capacity=100, error=0.01)
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 2**64, 3000, dtype=np.uint64) for _ in range(2))
    chain.add(a, b)
    assert chain.contains(a, b).all() and len(chain.layers) == 5 and chain.bound < 0.02
    c, d = (r.integers(0, 2**64, 20000, dtype=np.uint64) for _ in range(2))
    assert chain.contains(c, d).mean() < 1.5 * chain.bound


def test_seen_report(spark):
    df = spark.createDataFrame([(i, f"k{i % 700}") for i in range(2000)], "n bigint, a string")
    report = seen_keys.error_report(df, "n", [F.col("a")], block=100, capacity=16, error=0.05).first()
    assert report.distinct_keys == 700 and report.layers > 1 and report.false_rate <= 2 * report.false_rate_bound


# -- main content


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>{title} – site</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/c'>Contact</a></li></ul></nav><p>We use cookies here.</p><article><h1>{title}</h1>{body}<div><span>Share</span> <span>Print</span></div><h3>Related</h3><ul><li><a href='/{title[-1]}'>Other {title}</a></li></ul></article>{extra}<footer><p>All rights reserved.</p><p>Imprint of the site</p></footer></body></html>"


def test_main_content(spark):
    rows = [("s", i, f"http://h.example/p{i}", page(f"Heading number {i}", [f"First <b>own</b> text {i} &eacute;.", f"Second text of page {i}."])) for i in range(12)]
    rows += [("s", 50, "http://h.example/home", page("Home", [], "").replace("<h1>Home</h1>", "")), ("s", 51, "http://h.example/x", None), ("s", 52, "http://h.example/y", ""), ("s", 53, "http://h.example/e", "<title>404</title><h1>Not found</h1><p>It is gone, quite gone.</p>"), ("s", 54, None, "plain")]
    df = spark.createDataFrame(rows, "src string, rec_id bigint, url string, html string")
    got = {}
    for r in main_content.main_blocks(df).orderBy("rec_id", "pos").collect():
        got.setdefault(r.rec_id, []).append(r.text)
    assert got == {i: [f"Heading number {i}", f"First own text {i} é.", f"Second text of page {i}."] for i in range(12)}


def test_blocks():
    title, blocks, elements = main_content.parse("<title>t</title><p>a <b>b</b>\n c<br>d<td>e<script>x<y</script><!-- z -->f<p><a href=q>l</a>")
    assert title == "t" and [b.text for b in blocks] == ["a b c", "d", "ef", "l"] or [b.text for b in blocks] == ["a b c", "d", "e", "f", "l"]
    assert blocks[-1].linked and all(e.lo < e.hi for e in elements)


def bodies(spark, rows):
    df = spark.createDataFrame(rows, "src string, rec_id bigint, url string, html string")
    got = {}
    for r in main_content.main_blocks(df).orderBy("rec_id", "pos").collect():
        got.setdefault(r.rec_id, []).append(r.text)
    return got


@pytest.mark.parametrize("titled", [True, False])
def test_main_content_without_titles_and_with_copies(spark, titled):
    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(12))
    own = {i: [f"Heading {line()}", line(), line()] for i in range(30)}
    copy = ["One story", line(), line()]
    own |= {i: copy for i in range(30, 50)}
    own[50] = ["500 words every crawler meets", line(), line()]
    rows = [("s", i, f"http://h.example/p{i}?a={i}", page(t, rest)) for i, (t, *rest) in own.items()]
    rows += [("s", 90 + i, f"http://h.example/gone{i}", f"<title>404</title><h1>Not found</h1><p>The page {i} is gone.</p>") for i in range(3)]
    if not titled:
        rows = [(*x[:3], re.sub("<title>.*?</title>", "", x[3])) for x in rows]
    assert bodies(spark, rows) == own


def test_nested_classes():
    places = {(-9, 1): [(0, 10), (9, 11)], (-5, 2): [(2, 20), (4, 21)], (-4, 3): [(3, 30), (6, 31)], (-3, 4): [(7, 40)]}
    found = {v: crossed for v, _, crossed in main_content.nested(places)}
    assert found == {1: False, 2: False, 3: True, 4: False}
    assert main_content.nested({(-1, 1): [(0, 5), (1, 6)]})[0][1] != main_content.nested({(-1, 1): [(0, 6), (1, 5)]})[0][1]


@pytest.mark.parametrize("n", [4, 24])
def test_main_content_with_headings_in_free_order(spark, n):
    r = random.Random(11)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(12))
    rows, own = [], {}
    for i in range(n):
        heads = ["Tools", "Steps", "Hints", "Costs"]
        heads = heads[i % 4 :] + heads[: i % 4]
        own[i] = [f"Title {line()}", *(x for h in heads for x in (h, line()))]
        text = "".join(f"<h2>{x}</h2>" if x in heads else f"<p>{x}</p>" for x in own[i][1:])
        rows.append(("s", i, f"http://h.example/p{i}", page(own[i][0], []).replace("</h1>", "</h1>" + text)))
    assert bodies(spark, rows) == own


@pytest.mark.parametrize("together", [True, False])
def test_main_content_with_a_notice_that_moves(spark, together):
    r = random.Random(12)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(12))
    rows, own = [], {}
    for i in range(24):
        heads = ["Tools", "Steps", "Hints"]
        heads = heads[i % 3 :] + heads[: i % 3] if together else []
        own[i] = [f"Title {line()}", line(), *(x for h in heads for x in (h, line()))]
        text = "".join(f"<h2>{x}</h2>" if x in heads else f"<p>{x}</p>" for x in own[i][1:])
        html = page(own[i][0], []).replace("</h1>", "</h1>" + text)
        notice = "<div>Our new letter comes out on each first Monday of the month.</div>"
        rows.append(("s", i, f"http://h.example/p{i}", html.replace("<nav>", notice + "<nav>") if i % 2 else html.replace("</footer>", "</footer>" + notice)))
    assert bodies(spark, rows) == own


def test_movers_and_places():
    assert main_content.movers([]) == (set(), set()) and main_content.movers([(1, 2)]) == ({1, 2}, set())
    assert main_content.movers([(1, 9), (2, 9), (3, 9)]) == (set(), {9})
    assert main_content.movers([(1, 2), (1, 3), (2, 3), (1, 9), (2, 9), (3, 9), (4, 9)]) == ({1, 2, 3}, {9})
    got = main_content.places({(-5, 2): [(21, 8), (20, 1)]}, {(-9, 1): [0, 5], (-3, 3): [2]})
    assert sorted(got) == [((2, False), 20, 1, 1), ((2, False), 21, 1, 2), ((2, True), 20, 21, 1)]


# -- encoding


def test_encoding_repair(spark):
    r = random.Random(7)
    words = ["größe", "straße", "für", "über", "können", "später", "wäsche", "ändern", "müssen", "schön", "grün", "zurück", "hören"]
    clean = [" ".join(r.choice(words) for _ in range(30)) for _ in range(80)]
    bad = {100: clean[0].encode().decode("cp1252", "ignore"), 101: "ok text " + "für".encode().decode("latin_1"), 102: clean[1].encode().decode("cp437"), 103: "verl�ren"}
    rows = list(enumerate(clean)) + list(bad.items()) + [(200, None), (201, ""), (202, "plain ascii")]
    df = spark.createDataFrame(rows, "record_id bigint, payload string")
    repair = encoding_repair.Repair(df, "record_id", "payload")
    found = {x.record_id: x.restorable for x in repair.found().collect()}
    assert found == {100: True, 101: True, 102: True, 103: False}
    restored = {x.record_id: x.text for x in repair.restored().collect()}
    assert restored[101] == "ok text für" and restored[102] == clean[1]


def test_encoding_models_are_sent_once_and_packed(spark, monkeypatch):
    sent, send = [], spark.sparkContext.broadcast

    def spy(value):
        sent.append(send(value))
        return sent[-1]

    monkeypatch.setattr(spark.sparkContext, "broadcast", spy)
    df = spark.createDataFrame([(i, f"für größe{i} über") for i in range(40)] + [(50, "fÃ¼r")], "record_id bigint, payload string")
    assert [r.record_id for r in encoding_repair.Repair(df, "record_id", "payload").found().collect()] == [50]
    assert len(sent) == 2 and not any(os.path.exists(b._path) for b in sent)
    model = encoding_repair.train(spark.createDataFrame([("für", 1 << 20), ("über", 3)], "word string, n bigint"))
    packed = pickle.dumps(model)
    assert len(packed) < 1 << 20 and pickle.loads(packed).score("für") == model.score("für")


def test_encoding_margins_come_from_all_words(spark):
    words = [(f"größe{i}ü", 1 + i % 3) for i in range(60)]
    model = encoding_repair.train(spark.createDataFrame(words, "word string, n bigint"))
    assert model.total == sum(k for w, n in words for _, k in encoding_repair.weighed(w, n))
    for w, n in words[:3]:
        rest = encoding_repair.train(spark.createDataFrame([x for x in words if x[0] != w], "word string, n bigint"))
        assert model.without(w, n).score(w) == pytest.approx(rest.score(w)) and model.score(w) > rest.score(w)
    trained = spark.range(50_000).select(F.col("id").cast("string").alias("word"), F.lit(1).alias("n"))
    gains = trained.select("word", "n", F.lit(False).alias("missed"), F.col("word").cast("double").alias("gain_held_utf8"), F.lit(None).cast("double").alias("gain_held_single"))
    margins, share = encoding_repair.validate(gains, trained)
    assert margins == {True: 49_999 - 25, False: 0.0} and share == encoding_repair.FALSE_RATE


def test_encoding_repair_of_garbled_words_among_clean_ones(spark):
    r = random.Random(5)
    words = ["любой", "индекс", "сервер", "память", "граница", "мастерская", "ошибка", "страница", "каждый", "зеркало"]
    clean = [" ".join(r.choice(words) for _ in range(12)) for _ in range(120)]
    bad = {1000 + i: f"ok {w.encode('cp1251').decode('cp1252')}" for i, w in enumerate(words) for _ in range(2)}
    df = spark.createDataFrame([*enumerate(clean), *bad.items()], "record_id bigint, payload string")
    restored = {x.record_id: x.text for x in encoding_repair.Repair(df, "record_id", "payload").restored().collect()}
    assert restored == {1000 + i: f"ok {w}" for i, w in enumerate(words)}


# -- packing


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 45) | st.none(), max_size=60))
def test_packing(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint")
    got = packing.pack(df, capacity=16, bucket=5).collect()
    total, room, pieces = Counter(), {}, Counter()
    for r in sorted(got, key=lambda r: (r.container_id is None, r.container_id, r.start)):
        total[r.doc_id] += r.tokens
        pieces[r.doc_id] += 1
        if r.container_id is not None:
            assert r.start == room.get(r.container_id, 0)
            room[r.container_id] = r.start + r.tokens
    assert all(v <= 16 for v in room.values()) and sorted(room) == list(range(len(room)))
    assert {i: total[i] for i in range(len(sizes))} == {i: n or 0 for i, n in enumerate(sizes)}
    assert all(pieces[i] == max(1, -(-(n or 0) // 16)) for i, n in enumerate(sizes))
    free, best = [], 0  # best fit in descending order
    for n in sorted((p for n in sizes if n for p in [16] * (n // 16) + [n % 16] if p), reverse=True):
        fits = [g for g in free if g >= n]
        g = min(fits) if fits else 16
        if fits:
            free.remove(g)
        else:
            best += 1
        free.append(g - n)
    assert len(room) == best


def test_count_tokens():
    import pyarrow as pa

    values = ["", None, "a b", "é1é2 x", "abc", "abc", "--", "A9-b\n"]
    for kind in (pa.string(), pa.large_string()):
        for cut in (0, 3):
            got = count_tokens(pa.array(values, kind)[cut:]).tolist()
            assert got == [len(re.findall("[a-zA-Z0-9]+", v or "")) for v in values[cut:]]


# -- leakage


def test_leaks(spark):
    r = random.Random(2)
    item = [f"W{r.randrange(30)}é" for _ in range(40)]
    rows = [(1, "intro " + ", ".join(item[5:17]).lower() + " end"), (2, " ".join(item[5:16])), (3, "x­y " + " ".join(w[:1] + "​" + w[1:] for w in item)), (4, None), (5, "")]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(9, " ".join(item)), (8, "too short"), (7, None)], "item_id bigint, text string")
    for most in (10**6, 1):
        assert {(x.doc_id, x.item_id, x.words) for x in leakage.leaks(docs, items, max_words=most).collect()} == {(1, 9, 12), (3, 9, 40)}
    cleaned = {x.doc_id: (x.action, x.text) for x in leakage.decontaminate(docs.drop("item_id"), items).collect()}
    assert cleaned[3] == ("drop", None)
    assert leakage.leaks(docs, items.limit(0)).count() == 0


# -- quality


def test_quality(spark):
    rows = [(1, "The cat sat on the mat. " * 10), (2, ""), (3, None), (4, "a\n\n b…\n— 12!"), (5, "- x\n- y\n- z\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    common = spark.createDataFrame([("en", "the"), ("en", "on"), ("en", None)], "lang string, word string")
    got = {r.doc_id: r for r in quality.quality_stats(docs, common).withColumn("faults", quality.faults()).withColumn("kind", quality.text_kind()).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1].n_words == 60 and abs(got[1].common_share - 0.5) < 1e-9 and got[1].ending_share == 1 and got[1].symbol_share == 10 / 180
    assert got[2].faults == 5 and got[2].kind == "junk"
    assert got[4].n_words == 4 and got[4].n_lines == 3 and got[4].ending_share == 2 / 3 and got[4].symbol_share == 3 / 7
    assert got[5].kind == "list" and got[5].bullet_share == 1
    assert got[1].top_3gram_share > 0.1


# -- empty tables and clashing columns


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "src string, rec_id bigint, url string, html string")
    assert main_content.main_blocks(pages).count() == 0 and main_content.body_texts(pages).count() == 0
    texts = spark.createDataFrame([], "record_id bigint, payload string")
    repair = encoding_repair.Repair(texts, "record_id", "payload")
    assert repair.found().count() == 0 and repair.restored().count() == 0 and repair.report().first().garbled == 0
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(docs).count() == 0
    assert packing.packing_report(packing.pack_documents(docs)).first().containers == 0
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id bigint, text string")
    assert leakage.leaks(docs, items).count() == 0 and leakage.decontaminate(docs, items).count() == 0
    common = spark.createDataFrame([], "lang string, word string")
    assert quality.quality_stats(docs, common).count() == 0
    keys = spark.createDataFrame([], "n bigint, a string")
    assert seen_keys.seen_before(keys, "n", [F.col("a")]).count() == 0
    assert seen_keys.error_report(keys, "n", [F.col("a")]).first().decisions == 0


def test_very_long_text(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long, "clash"), (2, None, "clash")], "doc_id bigint, text string, words string")
    packed = packing.pack_documents(docs)
    assert packed.where("doc_id = 1").agg(F.sum("tokens")).first()[0] == 400_000
    common = spark.createDataFrame([("en", "word")], "lang string, word string")
    assert quality.quality_stats(docs, common).first().n_words == 400_000
    pages = spark.createDataFrame([("s", 1, "http://h/", f"<title>Long</title><h1>Long</h1><p>{long}</p>")], "src string, rec_id bigint, url string, html string")
    assert main_content.main_blocks(pages).count() == 2
