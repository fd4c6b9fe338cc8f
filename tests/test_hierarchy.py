import random

import pytest

from tidewrack.operators import hierarchy as H


def solve(parents):
    out = {}
    for i in parents:
        seen, x = [], i
        while parents.get(x) in parents and x not in seen:
            seen.append(x)
            x = parents[x]
        if x in seen:
            loop, y = [], x
            while True:
                loop.append(y)
                y = parents[y]
                if y == x:
                    break
            out[i] = (min(loop), -1)
        else:
            out[i] = (x, len(seen))
    return out


def run(spark, links):
    forest = H.decompose(spark.createDataFrame(links, "id bigint, parent bigint"))
    found = {r.id: (r.root_id, r.depth) for r in H.roots_and_depths(forest).collect()}
    return forest, found


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_against_walks(spark, shape):
    r = random.Random(5)
    if shape == "random":
        links = [(i, r.randrange(i) if i and r.random() > 0.05 else None) for i in range(200)]
    elif shape == "chain":
        links = [(i, i - 1 if i else None) for i in range(150)]
    elif shape == "star":
        links = [(i, 0 if i else None) for i in range(150)]
    else:
        links = [(i, r.randrange(60)) for i in range(60)] + [(100, 100), (101, 100), (102, 999)]
    parents = dict(links)
    forest, found = run(spark, links)
    assert found == solve(parents)
    heads = {root for root, depth in found.values() if depth == -1}
    paths = {row.id: row.path for row in H.paths(forest).collect()}
    for i in parents:
        path, x = [i], i
        while x not in heads and parents.get(x) in parents:
            x = parents[x]
            path.append(x)
        assert paths[i] == path[::-1]
    spans = {row.id: (row.root_id, row.first, row.last) for row in H.descendant_intervals(forest).collect()}
    for i in parents:
        below = {j for j in parents if i in paths[j]}
        root, first, last = spans[i]
        assert below == {j for j, (q, a, _) in spans.items() if q == root and first <= a <= last}


def test_empty_and_dirty(spark):
    assert run(spark, [])[1] == {}
    assert run(spark, [(None, 1), (1, None), (1, None), (2, 1), (2, 1), (3, 77)])[1] == {1: (1, 0), 2: (1, 1), 3: (3, 0)}


def test_keys(spark):
    rows = [(3, "http://a/x#f", "http://a/"), (1, "http://a//", None), (2, "http://a/x/", ""), (4, None, "http://a"), (None, "http://b", None), (5, "http://a/y", "http://a/x#q")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "fetch_id bigint, url string, parent_url string, id string")
    got = {r.id: (r.root_id, r.depth) for r in H.roots_and_depths(H.crawl_forest(df)).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 5: (2, 1)}
