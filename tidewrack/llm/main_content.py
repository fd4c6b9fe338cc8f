"""Main body of web pages by equivalence-class template deduction.

1. ``parsed``: each page once into its elements and blocks (the character data
   between two tags that separate). Tokens are tags in their path and runs of
   words: all words of a block share its occurrences once a word's role is told
   by its neighbours in the block, so the run stands for them as one token.
2. ``distinct_pages``: template evidence comes from pages whose long blocks are
   mostly their own, one capture a URL. Copies of an article, however many, are
   no evidence against it.
3. ``template``: tokens of a host with the same occurrence vector over its pages
   form an equivalence class. A vector is an order-free 64-bit sum of hashes of
   (page, exact count): an aggregate with map-side combine, so no host is gathered
   anywhere. A class is valid if its tokens come in one order on every page and
   it nests with the other classes (its span never crosses theirs). An invalid class
   is split: tokens that only change places with each other, inside one gap of the
   rest, come in the page's own order and are no template (but links, which menus shuffle);
   one that moves across the template (a notice above or below) is a part of its own; the
   others are parts by the gaps of the valid stronger classes they stand in. A lone token needs twice the pages. What is
   template of several hosts (labels of a language or a site builder) is template
   of the collection, which serves hosts with few pages.
4. ``slots``: the template's gaps are elements. An element's role is its path and
   whether its first block is data, a link or template. On each page the element
   that covers most of the page's data with least template is its best slot, and a
   role that is best on its pages often enough - on its host, smoothed by all
   hosts - is the template's body slot. The page's title only decides where no
   role has that evidence.
5. ``body``: within the slot template tokens, links that stand alone and nested
   classes of template and links fall away.

Pages that hold no such slot (error messages, pages of template only) have no body.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.urls import host_key, url_key
from tidewrack.runtime import spread, stage

#: Pages that a class, and a lone token, must be on; and their share of the host's pages.
CLASS_PAGES = 3
LONE_PAGES = 6
SHARE = 0.04
#: A token on fewer pages than ``LONE_PAGES`` still is template if it is on so many of a small host's.
MOST = 0.3
#: Hosts that a token must be template of to be template of the collection.
MIN_HOSTS = 2
#: Words that make a block long: such blocks tell whether a page is its own and no copy (all blocks do where none is long).
LONG = 8
#: Share of a role's pages on which it must be the best slot, and the pages that the collection's share counts for.
SLOT_SHARE = 0.4
PRIOR = 8

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_INLINE = frozenset("a b i em strong code span".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SPACE = re.compile(r"[ \t\r\n]+")
_NEVER = frozenset("title noscript button nav option select textarea".split())


def clean(text: str) -> str:
    return _SPACE.sub(" ", html_lib.unescape(text)).strip(" ")


class Block:
    __slots__ = ("text", "linked", "tag", "lo", "hi", "never")

    def __init__(self, text, linked, tag, never):
        self.text, self.linked, self.tag, self.never = text, linked, tag, never
        self.lo = self.hi = 0


class Element:
    """An element that holds blocks ``lo`` to ``hi`` - 1; ``path`` is a hash of the tags down to it."""

    __slots__ = ("lo", "hi", "path")

    def __init__(self, lo, hi, path):
        self.lo, self.hi, self.path = lo, hi, path


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def parse(page: str) -> tuple[str, list[Block], list[Element]]:
    """Title, blocks and elements in document order; a block knows the range of blocks in the element around its own."""
    blocks: list[Block] = []
    owners: list[int] = []
    tags, parents, first, paths = ["#"], [-1], [0], ["#"]
    last = [0]
    stack = [0]
    title = ""
    parts: list[tuple[str, bool]] = []
    links = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            last[stack.pop()] = len(blocks)

    def flush() -> None:
        nonlocal parts, title
        if parts:
            text = clean("".join(p for p, _ in parts))
            if text:
                if tags[stack[-1]] == "title":
                    title = title or text
                else:
                    inked = any(linked and clean(p) for p, linked in parts)
                    plain = any(not linked and clean(p) for p, linked in parts)
                    never = any(tags[n] in _NEVER for n in stack)
                    blocks.append(Block(text, inked and not plain, tags[stack[-1]], never))
                    owners.append(stack[-1])
            parts = []

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                links = max(0, links - 1) if m[2] else links + 1
            continue
        flush()
        if name in _VOID:
            continue
        if m[2]:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == name:
                    close(depth)
                    break
            links = 0 if name not in ("li",) else links
            continue
        if name in _CLOSES and tags[stack[-1]] in _CLOSES[name]:
            close(len(stack) - 1)
            if name == "tr" and tags[stack[-1]] == "tr":
                close(len(stack) - 1)
        elif name in _ENDS_P and tags[stack[-1]] == "p":
            close(len(stack) - 1)
        tags.append(name)
        parents.append(stack[-1])
        first.append(len(blocks))
        last.append(0)
        paths.append(paths[stack[-1]] + ">" + name)
        stack.append(len(tags) - 1)
    if at < len(page):
        parts.append((page[at:], links > 0))
    flush()
    close(0)
    for b, node in zip(blocks, owners):
        around = parents[node] if parents[node] >= 0 else node
        b.lo, b.hi = first[around], last[around]
    return title, blocks, [Element(first[n], last[n], _hash(paths[n])) for n in range(len(tags)) if last[n] > first[n]]


_LINKED, _NO_BODY, _CELL, _HEADING = 1, 2, 4, 8


def flags_of(b: Block) -> int:
    return b.linked * _LINKED | b.never * _NO_BODY | (b.tag in ("td", "th", "li")) * _CELL | (b.tag in ("h2", "h3", "h4", "h5", "h6")) * _HEADING


def tokens_of(blocks: list[Block], elements: list[Element]) -> list[int]:
    """Tokens of a page: one of each block, in its role as cell or not, then one of each element's path."""
    return [_hash(("c>" if b.tag in ("td", "th", "li") else "t>") + b.text) for b in blocks] + [e.path for e in elements]


_PARSED = """src string, rec_id bigint, host string, unit bigint, title string, texts array<string>, words array<int>, flags array<int>, tokens array<bigint>,
    lo array<int>, hi array<int>, e_lo array<int>, e_hi array<int>, titled array<boolean>, long array<bigint>, long_words array<int>"""


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (``src``, ``rec_id``, ``url``, ``html``) as blocks and elements, written as a table; null html is left out."""
    names = [x.split()[0] for x in _PARSED.split(",")]

    def run(frames):
        for f in frames:
            out = []
            for src, rec, host, unit, page in zip(f.src, f.rec_id.values, f.host, f.unit.values, f.html):
                title, blocks, elements = parse(page)
                tokens = tokens_of(blocks, elements)
                words = [b.text.count(" ") + 1 for b in blocks]
                plain = [k for k, b in enumerate(blocks) if not b.linked and not b.never]
                own = [k for k in plain if words[k] >= LONG] or plain
                headed = [heads(title, b) for b in blocks]
                out.append((src, rec, host, unit, title, [b.text for b in blocks], words, [flags_of(b) for b in blocks], tokens, [b.lo for b in blocks], [b.hi for b in blocks],
                            [e.lo for e in elements], [e.hi for e in elements], [headed[e.lo] for e in elements], [tokens[k] for k in own], [words[k] for k in own]))
            yield pd.DataFrame(out, columns=names)

    unit = F.xxhash64(F.lower(F.regexp_replace(F.coalesce(url_key(F.col("url")), F.concat("src", F.lit(" "), F.col("rec_id").cast("string"))), "^[A-Za-z]+://", "")))
    picked = pages.where("html is not null and rec_id is not null").select("src", F.col("rec_id").cast("bigint").alias("rec_id"), host_key(F.col("url")).alias("host"), unit.alias("unit"), "html")
    return stage(spread(picked).mapInPandas(run, _PARSED), "parsed")


def heads(title: str, b: Block) -> bool:
    """Whether a block is the page's title, alone or with the site's name behind it."""
    return not b.linked and not b.never and len(b.text) > 3 and (b.text == title or title.startswith(b.text + " "))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(``src``, ``rec_id``, ``host``, ``unit``): one capture of each page whose long blocks are mostly on no other page (without long blocks: that has ``LONG`` words of its own)."""
    long = pages.select("src", "rec_id", "host", "unit", F.explode(F.arrays_zip("long", "long_words")).alias("x")).select("src", "rec_id", "host", "unit", F.col("x.long").alias("token"), F.col("x.long_words").alias("n"))
    # A hash of host and unit tells pages; a token of one page has one of them.
    page = F.xxhash64("host", "unit")
    shared = long.groupBy("token").agg(F.min(page).alias("a"), F.max(page).alias("b")).where("a <> b").select("token")
    marked = long.join(shared.withColumn("copied", F.lit(True)), "token", "left")
    weighed = marked.groupBy("src", "rec_id", "host", "unit").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("copied"), F.col("n")).otherwise(0)).alias("copied"), F.max("n").alias("longest"))
    own = weighed.where(f"n - copied >= {LONG} and (2 * copied <= n or longest < {LONG})").groupBy("host", "unit").agg(F.min(F.struct("src", "rec_id")).alias("m"))
    return stage(own.select("m.src", "m.rec_id", "host", "unit"), "distinct")


def _placed(pages: DataFrame, picked: DataFrame) -> DataFrame:
    """(``src``, ``rec_id``, ``host``, ``unit``, ``token``, ``pos``, ``n``, ``link``) of the picked pages: first place and count of each token, and whether it is a link there."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            counted = [np.unique(tokens, return_index=True, return_counts=True) for tokens in f.tokens]
            each = [len(values) for values, _, _ in counted]
            rows = {c: np.repeat(f[c].to_numpy(), each) for c in ("src", "rec_id", "host", "unit")}
            token, pos, n = (np.concatenate([x[i] for x in counted]) for i in range(3))
            link = np.concatenate([np.append(flags, np.zeros(len(tokens) - len(flags), flags.dtype))[x[1]] & _LINKED for flags, tokens, x in zip(f["flags"], f["tokens"], counted)])
            yield pd.DataFrame(rows | {"token": token, "pos": pos.astype(np.int32), "n": n.astype(np.int32), "link": link == _LINKED})

    both = pages.select("src", "rec_id", "tokens", "flags").join(picked, ["src", "rec_id"])
    return both.mapInPandas(run, "src string, rec_id bigint, host string, unit bigint, token bigint, pos int, n int, link boolean")


def template(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens (``host``, ``token``) of valid equivalence classes, host null for classes of the collection, and the pages they were learnt from; both written as tables."""
    picked = distinct_pages(pages)
    placed = stage(_placed(pages, picked), "placed")
    vector = F.sum(F.shiftright(F.xxhash64("unit", "n"), 16)).alias("vector")
    per_host = stage(placed.groupBy("host", "token").agg(F.count("*").alias("support"), F.max("link").alias("link"), vector), "vectors")
    sizes = picked.groupBy("host").agg(F.count("*").alias("pages"))
    share = F.col("support") / F.col("pages")
    often = per_host.where(F.col("support") >= CLASS_PAGES).join(sizes, "host").where(share >= SHARE)
    members = often.groupBy("host", "vector").agg(F.count("*").alias("members"))
    often = stage(often.join(members, ["host", "vector"]), "often")
    broken = stage(_broken(placed, often.where("members > 1")), "broken")
    whole = often.join(broken, ["host", "vector"], "left_anti").select("host", "token", "support", "pages", "members")
    judged = whole.unionAll(_parts(placed, often.where("members > 1"), broken).select("host", "token", "support", "pages", "members"))
    own = stage(judged.where(f"members > 1 or support >= {LONE_PAGES} or support >= {MOST} * pages").select("host", "token"), "classes")
    wide = own.groupBy("token").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= MIN_HOSTS).select(F.lit(None).cast("string").alias("host"), "token")
    return own.unionAll(wide), picked


def _broken(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """(``host``, ``vector``) of the classes that are out of order on some page, or whose span crosses a stronger class."""
    hits = placed.join(classes.select("host", "token", "vector", "support"), ["host", "token"])
    per_page = hits.groupBy("src", "rec_id", "host").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "vector", "support"))).alias("h"))

    def run(frames):
        for f in frames:
            out = []
            for host, found in zip(f.host, f.h):
                spots: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for r in found:
                    spots.setdefault((-int(r["support"]), int(r["vector"])), []).append((int(r["pos"]), int(r["token"])))
                out += [(host, vector, order, crossed) for vector, order, crossed in nested(spots)]
            yield pd.DataFrame(out, columns=["host", "vector", "order", "crossed"])

    judged = per_page.select("host", "h").mapInPandas(run, "host string, vector bigint, order bigint, crossed boolean")
    return judged.groupBy("host", "vector").agg(F.min("order").alias("a"), F.max("order").alias("b"), F.max(F.col("crossed").cast("int")).alias("c")).where("a <> b or c > 0").select("host", "vector")


def _parts(placed: DataFrame, classes: DataFrame, broken: DataFrame) -> DataFrame:
    """Tokens of the broken classes but data in free order, as ``classes`` has them, with the ``members`` of their part."""
    marked = classes.join(broken.withColumn("bad", F.lit(True)), ["host", "vector"], "left").join(broken.select("host").distinct(), "host", "left_semi")
    hits = placed.join(marked.select("host", "token", "vector", "support", F.col("bad").isNotNull().alias("bad")), ["host", "token"])
    per_page = hits.groupBy("src", "rec_id", "host").agg(F.collect_list(F.struct("pos", "token", "vector", "support", "bad")).alias("h")).where(F.exists("h", lambda x: x["bad"]))

    def run(frames):
        for f in frames:
            sums: dict[tuple, tuple[int, int]] = {}
            for host, found in zip(f.host, f.h):
                good: dict[tuple[int, int], list[int]] = {}
                bad: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for r in found:
                    key = (-int(r["support"]), int(r["vector"]))
                    if r["bad"]:
                        bad.setdefault(key, []).append((int(r["token"]), int(r["pos"])))
                    else:
                        good.setdefault(key, []).append(int(r["pos"]))
                for pair, a, b, n in places(bad, good):
                    lo, hi = sums.get(key := (host, *pair, a, b), (n, n))
                    sums[key] = min(lo, n), max(hi, n)
            yield pd.DataFrame([(*key, *n) for key, n in sums.items()], columns=["host", "vector", "paired", "a", "b", "lo", "hi"])

    seen = per_page.select("host", "h").mapInPandas(run, "host string, vector bigint, paired boolean, a bigint, b bigint, lo int, hi int")
    seen = stage(seen.groupBy("host", "vector", "paired", "a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "places")

    def move(f: pd.DataFrame) -> pd.DataFrame:
        across = set(f.a[~f.paired].tolist())
        free, loose = movers([p for p, paired in zip(zip(f.a.tolist(), f.b.tolist()), f.paired) if paired and not across.intersection(p)])
        across |= loose
        out = [(f.host.iloc[0], f.vector.iloc[0], x, x in free) for x in sorted(across | free)]
        return pd.DataFrame(out, columns=["host", "vector", "token", "free"])

    moved = seen.where("lo <> hi").groupBy("host", "vector").applyInPandas(move, "host string, vector bigint, token bigint, free boolean")
    gap = F.sum(F.shiftright(F.xxhash64("b", "lo"), 16)).alias("part")
    gaps = seen.where("not paired").groupBy("host", "vector", F.col("a").alias("token")).agg(gap)
    kept = classes.drop("members").join(broken, ["host", "vector"], "left_semi").join(moved, ["host", "vector", "token"], "left").where("free is null or not free or link")
    kept = kept.join(gaps, ["host", "vector", "token"], "left").withColumn("part", F.when(F.col("free").isNotNull(), F.col("token")).otherwise(F.coalesce("part", F.lit(0))))
    kept = stage(kept, "parts")
    return kept.join(kept.groupBy("host", "vector", "part").agg(F.count("*").alias("members")), ["host", "vector", "part"])


def places(bad: dict[tuple[int, int], list[tuple[int, int]]], good: dict[tuple[int, int], list[int]]) -> list[tuple[tuple[int, bool], int, int, int]]:
    """((class, whether a pair), a, b, n) of one page's broken classes {(-support, class): [(token, place)]} beside the valid ones {(-support, class): [place]}.

    A pair of tokens ``a`` < ``b`` of a class has n = 1 if ``a`` comes first; a token
    ``a`` and a stronger valid class ``b`` have the number of that class's tokens before it.
    """
    out = []
    for (strength, vector), found in bad.items():
        found = sorted(found)
        for k, (a, at) in enumerate(found):
            out += [((vector, True), a, b, int(at < other)) for b, other in found[k + 1 :]]
            out += [((vector, False), a, v, sum(p < at for p in others)) for (s, v), others in good.items() if (s, v) < (strength, vector)]
    return out


def movers(pairs: list[tuple[int, int]]) -> tuple[set[int], set[int]]:
    """Of tokens in pairs that change places, those that only do so with each other, and those that do so with tokens that stay.

    As long as there are pairs, the tokens in most of them are taken out, equals together; what is never taken out stays.
    """
    left, out = pairs, set()
    while left:
        n = Counter(x for p in left for x in p)
        most = max(n.values())
        out |= {x for x in n if n[x] == most}
        left = [p for p in left if not out.intersection(p)]
    loose = {x for p in pairs for x in p if x in out and not out.issuperset(p)}
    return out - loose, loose


def nested(spots: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple[int, int, bool]]:
    """(class, hash of its order, whether it crosses a stronger class) of one page's classes {(-support, class): [(place, token)]}.

    A class nests if all its tokens lie in one gap of each stronger class, outside
    of its span included.
    """
    out = []
    stronger: list[list[int]] = []
    for (_, vector), found in sorted(spots.items()):
        at = [p for p, _ in found]
        crossed = False
        for other in stronger:
            if at[0] < other[0] and at[-1] > other[-1] and len(other) > 1:
                # The other one lies inside: then it must be in one gap of this one.
                crossed |= sum(other[0] < p < other[-1] for p in at) > 0
            elif at[-1] > other[0] and at[0] < other[-1]:
                gaps = {sum(q < p for q in other) for p in at}
                crossed |= len(gaps) > 1
        stronger.append(at)
        out.append((vector, _hash(",".join(str(t) for _, t in found)), crossed))
    return out


def _known(pages: DataFrame, t: DataFrame) -> DataFrame:
    """(``src``, ``rec_id``, ``known``): which of its tokens are template, for each page that has any; no host is gathered."""
    own = pages.select("src", "rec_id", "host", F.explode(F.array_distinct("tokens")).alias("token"))
    of_host = own.join(t.where("host is not null"), ["host", "token"]).select("src", "rec_id", "token")
    of_all = own.join(t.where("host is null").select("token"), "token").select("src", "rec_id", "token")
    return of_host.unionAll(of_all).groupBy("src", "rec_id").agg(F.collect_set("token").alias("known"))


_CANDIDATES = "src string, rec_id bigint, host string, known array<bigint>, role array<bigint>, score array<double>, e_lo array<int>, e_hi array<int>, titled array<boolean>, best bigint"


def candidates(words, flags, tokens, e_lo, e_hi, known: set[int]) -> tuple[list[tuple[int, float, int]], int | None]:
    """(role, score, number) of each element with data, and the role of the best one (the innermost among equals).

    The score is the harmonic mean of two shares: data in the element, and the page's data that it covers.
    """
    n = len(words)
    data, total = [0], [0]
    kind = [2 if tokens[k] in known else flags[k] & _LINKED for k in range(n)]
    for k in range(n):
        data.append(data[-1] + (0 if kind[k] or flags[k] & _NO_BODY else words[k]))
        total.append(total[-1] + words[k])
    out, best = [], None
    for k, (lo, hi) in enumerate(zip(e_lo, e_hi)):
        mass = data[hi] - data[lo]
        if mass:
            score = 2 * mass / (total[hi] - total[lo] + data[n])
            role = hash((int(tokens[n + k]), int(kind[lo]), bool(hi - lo > 1)))
            out.append((role, score, k))
            if best is None or score >= best[0]:
                best = (score, role)
    return out, best and best[1]


def slots(pages: DataFrame, t: DataFrame, picked: DataFrame) -> DataFrame:
    """(``src``, ``rec_id``, ``known``, ``from``, ``to``): the body slot of each page that has one."""
    light = pages.select("src", "rec_id", "host", "words", "flags", "tokens", "e_lo", "e_hi", "titled").join(_known(pages, t), ["src", "rec_id"], "left")

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                known = set() if r.known is None else set(r.known.tolist())
                found, best = candidates(r.words.tolist(), r.flags.tolist(), r.tokens.tolist(), r.e_lo.tolist(), r.e_hi.tolist(), known)
                if found:
                    ks = [k for _, _, k in found]
                    out.append((r.src, r.rec_id, r.host, list(known), [x for x, _, _ in found], [x for _, x, _ in found], r.e_lo[ks], r.e_hi[ks], r.titled[ks], best))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _CANDIDATES.split(",")])

    found = stage(light.mapInPandas(run, _CANDIDATES), "candidates")
    votes = found.join(picked, ["src", "rec_id"], "left_semi").select("host", "best", F.explode(F.array_distinct("role")).alias("role"))
    here = votes.groupBy("host", "role").agg(F.count("*").alias("on"), F.sum((F.col("role") == F.col("best")).cast("bigint")).alias("won"))
    here = stage(here, "roles")
    overall = here.groupBy("role").agg((F.sum("won") / F.sum("on")).alias("share"))
    one = found.select("src", "rec_id", "host", F.explode(F.arrays_zip("role", "score", "e_lo", "e_hi", "titled")).alias("e")).select("src", "rec_id", "host", "e.*")
    weighed = one.join(here, ["host", "role"], "left").join(overall, "role", "left")
    zero = F.lit(0)
    chance = (F.coalesce("won", zero) + PRIOR * F.coalesce("share", F.lit(0.0))) / (F.coalesce("on", zero) + PRIOR)
    # Roles with the evidence come first; without any the title decides.
    rank = F.struct((chance >= SLOT_SHARE).alias("sure"), "score", (F.col("e_lo") - F.col("e_hi")).alias("tight"), "e_lo", "e_hi")
    chosen = weighed.where((chance >= SLOT_SHARE) | F.col("titled")).groupBy("src", "rec_id").agg(F.max(rank).alias("m"))
    return chosen.select("src", "rec_id", F.col("m.e_lo").alias("from"), F.col("m.e_hi").alias("to")).join(found.select("src", "rec_id", "known"), ["src", "rec_id"])


def body(start: int, end: int, flags, tokens, lo, hi, known: set[int]) -> list[int]:
    """Numbers of the blocks of the slot [start, end) that make up the body."""
    linked = [f & _LINKED for f in flags]
    cell = [f & _CELL for f in flags]
    fixed = [tokens[k] in known for k in range(len(flags))]
    keep = []
    for i in range(start, end):
        if i > start:
            # A template heading with links behind it opens a class of links, which ends the body.
            if fixed[i] and flags[i] & _HEADING and i + 1 < end and linked[i + 1]:
                break
            # Template tokens and links are no data where they stand alone; in lists and tables the whole element decides.
            if flags[i] & _NO_BODY or not cell[i] and (fixed[i] or linked[i]):
                continue
            # An inner element that is mostly template and links is a nested class with its own slots.
            inside = range(lo[i], hi[i])
            if (lo[i], hi[i]) != (lo[start], hi[start]) and lo[i] > start and 2 * sum(bool(fixed[j] or linked[j]) for j in inside) >= len(inside):
                continue
        keep.append(i)
    # The closing group of links: items that are all links, and their heading.
    last = len(keep)
    while last > 1 and linked[keep[last - 1]] and cell[keep[last - 1]]:
        last -= 1
    keep = keep[:last]
    if len(keep) > 1 and flags[keep[-1]] & _HEADING and keep[-1] + 1 < end and linked[keep[-1] + 1]:
        keep.pop()
    return keep


def main_blocks(pages: DataFrame) -> DataFrame:
    """(``src``, ``rec_id``, ``pos``, ``text``, ``block_md5``): the body's blocks of each page in order.

    Null html or ids give no rows; repeated rows are captures of one page; pages
    without a URL are pages of their own on a host without a name.
    """
    p = parsed(pages)
    t, picked = template(p)
    where = slots(p, t, picked)

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                for k, i in enumerate(body(r.start, r.end, r.flags.tolist(), r.tokens.tolist(), r.lo.tolist(), r.hi.tolist(), set(r.known.tolist()))):
                    out.append((r.src, r.rec_id, k, r.texts[i], hashlib.md5(r.texts[i].encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["src", "rec_id", "pos", "text", "block_md5"])

    full = p.select("src", "rec_id", "texts", "flags", "tokens", "lo", "hi").join(where.select("src", "rec_id", "known", F.col("from").alias("start"), F.col("to").alias("end")), ["src", "rec_id"])
    return full.mapInPandas(run, "src string, rec_id bigint, pos int, text string, block_md5 string")


def body_texts(pages: DataFrame) -> DataFrame:
    """(``src``, ``rec_id``, ``blocks``, ``text``): the body of each page that has one, blocks on lines of their own."""
    b = main_blocks(pages).groupBy("src", "rec_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return b.select("src", "rec_id", F.size("b").alias("blocks"), F.array_join("b.text", "\n").alias("text"))


def pages_of(saved: DataFrame, warc: DataFrame) -> DataFrame:
    """Saved pages and WARC responses as one table of pages."""
    a = saved.select(F.lit("save_html_handler").alias("src"), F.col("page_id").alias("rec_id"), "url", "html")
    b = warc.where("rec_type = 'response'").select(F.lit("warc_document_texts").alias("src"), F.col("record_id").alias("rec_id"), F.col("target_uri").alias("url"), F.col("payload").alias("html"))
    return a.unionAll(b)
