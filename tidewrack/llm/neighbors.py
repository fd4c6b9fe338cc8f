"""Most similar vectors for every vector: stable projections, kd-tree, chi-square stop.

Vectors are scaled to length 1 and projected by a Gaussian (2-stable) matrix to
``M`` dimensions. For a pair at distance d, the squared projected distance over
d**2 follows the chi-square law with M degrees of freedom. Projected neighbours
of a query are therefore met in ascending order and verified in full; once the
next projected distance exceeds ``d_k * sqrt(chi2_M^-1(p))``, d_k being the
distance of the k-th best so far (or the largest distance asked for), each
missing neighbour is missing with probability below 1 - p and the search stops.

Distribution: the top of the kd-tree, fitted on a bounded sample (``SAMPLE``
rows; every row is indexed), cuts the projected space into cells of about
``CELL`` vectors. A cell goes to ``replicas`` tasks, each of which answers its
share of the queries that can reach the cell, by a hash of the query's id. Equal
vectors are searched once: a class of copies is known by its lowest id and
answers with its ``k + 1`` lowest ids, which is all that any top k can hold of
it, so a vector that a third of all rows carry is one row of one cell. Within a
task a kd-tree of leaves is searched in blocks of queries that lie together, leaf by leaf in ascending
box distance, so the work is matrix products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.runtime import default_partitions, stage

M = 12
P_STOP = 0.98
SEED = 20240
CELL = 32_768
SAMPLE = 20_000
LEAF = 256
QUERY_BLOCK = 512


def chi2_cdf(x: float, m: int) -> float:
    """Distribution function of the chi-square law (series of the lower incomplete gamma)."""
    if x <= 0:
        return 0.0
    a, x = m / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(dim: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m)).astype(np.float32)


class Cells:
    """The top of the kd-tree: median splits along the widest axes of a sample."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        self.levels = max(0, math.ceil(math.log2(max(1, n_cells))))
        self.axis: dict[int, int] = {}
        self.cut: dict[int, float] = {}
        m = sample.shape[1]
        self.lo = np.full((2**self.levels, m), -np.inf, np.float32)
        self.hi = np.full((2**self.levels, m), np.inf, np.float32)
        self._split(1, sample, 0)

    def _split(self, node: int, pts: np.ndarray, level: int) -> None:
        if level == self.levels:
            return
        axis = int(np.argmax(pts.var(axis=0))) if len(pts) else 0
        cut = float(np.median(pts[:, axis])) if len(pts) else 0.0
        self.axis[node], self.cut[node] = axis, cut
        below = pts[:, axis] <= cut
        span = 2 ** (self.levels - level - 1)
        first = (node << (self.levels - level)) - 2**self.levels
        self.hi[first : first + span, axis] = np.minimum(self.hi[first : first + span, axis], cut)
        self.lo[first + span : first + 2 * span, axis] = np.maximum(self.lo[first + span : first + 2 * span, axis], cut)
        self._split(2 * node, pts[below], level + 1)
        self._split(2 * node + 1, pts[~below], level + 1)

    def home(self, pts: np.ndarray) -> np.ndarray:
        node = np.ones(len(pts), np.int64)
        for _ in range(self.levels):
            axis = np.array([self.axis[i] for i in node.tolist()], np.int64)
            cut = np.array([self.cut[i] for i in node.tolist()], np.float32)
            node = 2 * node + (pts[np.arange(len(pts)), axis] > cut)
        return node - 2**self.levels

    def reach(self, pts: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        out = np.empty((len(pts), len(self.lo)), np.float32)
        for c in range(len(self.lo)):
            gap = np.maximum(np.maximum(self.lo[c] - pts, pts - self.hi[c]), 0)
            out[:, c] = (gap * gap).sum(axis=1)
        return out


def kd_leaves(pts: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree with median splits along the widest axis."""
    out, todo = [], [np.arange(len(pts))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(pts[rows], axis=0)))
        order = rows[np.argpartition(pts[rows, axis], len(rows) // 2)]
        todo += [order[len(rows) // 2 :], order[: len(rows) // 2]]
    return out


def search(ids, vecs, proj, leaves, qids, qvecs, qproj, k, bound, quantile):
    """Best ``k`` of the cell for each query: (query number, id, cosine).

    ``bound``: squared distances no neighbour may exceed, one for each query.
    Ties go to the lower id.
    """
    # One product per pair of blocks: (-2q, 1, |q|^2 - limit) . (p, |p|^2, 1) is the projected distance less the limit.
    sides = np.column_stack([proj, (proj * proj).sum(axis=1), np.ones(len(proj), np.float32)])
    lo = np.stack([proj[r].min(axis=0) for r in leaves])
    hi = np.stack([proj[r].max(axis=0) for r in leaves])
    groups = kd_leaves(qproj, QUERY_BLOCK)
    out_q, out_i, out_s = [], [], []
    for g in groups:
        qp, qv, qi = qproj[g], qvecs[g], qids[g]
        glo, ghi = qp.min(axis=0), qp.max(axis=0)
        gap = np.maximum(np.maximum(lo - ghi, glo - hi), 0)
        box = (gap * gap).sum(axis=1)
        order = np.argsort(box, kind="stable")
        best_s = np.full((len(g), k), -2.0)
        best_i = np.full((len(g), k), np.iinfo(np.int64).max)
        far = bound[g].astype(np.float64)
        qn = (qp * qp).sum(axis=1)
        ask = np.column_stack([-2 * qp, np.ones(len(g), np.float32), qn]).astype(np.float32)
        at = 0
        while at < len(order):
            limit = far * quantile
            if box[order[at]] > limit.max():
                break
            take = order[at : at + 8]
            take = take[box[take] <= limit.max()]
            at += 8
            rows = np.concatenate([leaves[j] for j in take])
            ask[:, -1] = qn - limit
            a, b = np.divmod(np.flatnonzero(ask @ sides[rows].T <= 1e-5), len(rows))
            if not len(a):
                continue
            keep = ids[rows[b]] != qi[a]
            a, b = a[keep], rows[b[keep]]
            if not len(a):
                continue
            if len(a) > 0.2 * len(g) * len(rows):
                s = (qv.astype(np.float64) @ vecs[rows].astype(np.float64).T)[a, _places(rows, b)]
            else:
                s = np.concatenate([np.einsum("ij,ij->i", qv[a[i : i + 65536]].astype(np.float64), vecs[b[i : i + 65536]].astype(np.float64)) for i in range(0, len(a), 65536)])
            good = 2 - 2 * s <= far[a] + 1e-9
            a, b, s = a[good], b[good], s[good]
            if not len(a):
                continue
            # Merge with what the queries have; the rounding makes ties of repeated vectors exact.
            touched = np.unique(a)
            a = np.concatenate([a, np.repeat(touched, k)])
            i = np.concatenate([ids[b], best_i[touched].ravel()])
            s = np.concatenate([np.round(s, 9), best_s[touched].ravel()])
            o = np.lexsort((i, -s, a))
            a, i, s = a[o], i[o], s[o]
            starts = np.flatnonzero(np.r_[True, np.diff(a) > 0])
            rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
            top = rank < k
            best_s[a[top], rank[top]] = s[top]
            best_i[a[top], rank[top]] = i[top]
            far = np.minimum(bound[g], np.where(best_s[:, k - 1] > -2, 2 - 2 * best_s[:, k - 1] + 1e-9, np.inf))
        hit = best_s > -2
        q, c = np.nonzero(hit)
        out_q.append(g[q])
        out_i.append(best_i[q, c])
        out_s.append(best_s[q, c])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def _places(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(rows)
    return order[np.searchsorted(rows[order], wanted)]


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(``id``, ``v`` binary, ``p`` binary): unit vectors and their projections.

    Null ids and vectors that are null, of another length, all zero or not finite
    throughout take no part.
    """
    matrix = projection(dim)

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = np.array(f.v.tolist(), np.float64)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(x).all(axis=1) & (norm > 0) & np.isfinite(norm)
            x = (x[ok] / norm[ok, None]).astype(np.float32)
            yield pd.DataFrame({"id": f.id.values[ok], "v": [r.tobytes() for r in x], "p": [r.tobytes() for r in x @ matrix]})

    whole = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & ~F.exists(vec_col, lambda e: e.isNull())
    picked = rows.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return stage(picked.mapInPandas(run, "id bigint, v binary, p binary"), "unit")


def _matrix(raw, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, width)


def nearest(rows: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, min_cosine: float | None = None, query_every: int = 1, cell: int = CELL, p_stop: float = P_STOP) -> DataFrame:
    """(``query_id``, ``id``, ``cosine``, ``rank``): the ``k`` most similar others of each query.

    Queries are the rows whose id is divisible by ``query_every``, searched
    against all rows. With ``min_cosine`` only neighbours of at least that
    cosine are returned, and the search never reaches further. Without it a first
    pass over the home cells gives each query its distance bound. Of equal
    cosines the lower id comes first; ids must be unique.
    """
    spark = rows.sparkSession
    units, copies = _classes(unit_vectors(rows, id_col, vec_col, dim), k)
    every = _named(units, copies)
    queries = every.where(F.col("id") % query_every == 0) if query_every > 1 else every
    units = every.where("id = class").select("id", "v", "p")
    n = units.count()
    schema = "query_id bigint, id bigint, cosine double"
    quantile = chi2_quantile(p_stop, M)
    n_cells = max(1, math.ceil(n / cell))
    parallel = default_partitions(spark)
    replicas = max(1, math.ceil(parallel / n_cells))
    sample = units.orderBy(F.xxhash64("id")).limit(SAMPLE).select("p").collect() if n_cells > 1 else []
    cells = spark.sparkContext.broadcast(Cells(_matrix([r.p for r in sample], M) if sample else np.zeros((0, M), np.float32), n_cells))
    n_groups = 2 ** cells.value.levels * replicas

    def index_rows(frames):
        for f in frames:
            if len(f):
                home = cells.value.home(_matrix(f.p, M))
                for r in range(replicas):
                    yield f.assign(grp=home * replicas + r, q=False, far=0.0)[["grp", "q", "far", "id", "v", "p"]]

    def query_rows(home_only: bool):
        def run(frames):
            for f in frames:
                if not len(f):
                    continue
                pts = _matrix(f.p, M)
                share = f.share.values
                if home_only:
                    yield f.assign(grp=cells.value.home(pts) * replicas + share, q=True)[["grp", "q", "far", "id", "v", "p"]]
                    continue
                near = cells.value.reach(pts) <= (f.far.values * quantile)[:, None] + 1e-6
                for c in range(near.shape[1]):
                    g = f[near[:, c]]
                    if len(g):
                        yield g.assign(grp=c * replicas + share[near[:, c]], q=True)[["grp", "q", "far", "id", "v", "p"]]

        return run

    def answer(frames):
        # Rows come by group, the cell ahead of its queries: a task holds one cell and one batch of queries.
        grp, cell_parts, index = None, [], None
        for f in frames:
            for g in f.grp.unique():
                part = f[f.grp == g]
                if g != grp:
                    grp, cell_parts, index = g, [], None
                x, q = part[~part.q], part[part.q]
                if len(x):
                    cell_parts.append((x.id.values, _matrix(x.v, dim), _matrix(x.p, M)))
                if len(q) and cell_parts:
                    if index is None:
                        index = [np.concatenate(c) for c in zip(*cell_parts)]
                        tree = kd_leaves(index[2])
                    qids = q.id.values
                    a, i, s = search(*index, tree, qids, _matrix(q.v, dim), _matrix(q.p, M), k, q.far.values, quantile)
                    yield pd.DataFrame({"query_id": qids[a], "id": i, "cosine": s})

    layout = "grp bigint, q boolean, far double, id bigint, v binary, p binary"
    index = units.mapInPandas(index_rows, layout)
    asked = units.join(queries.select(F.col("class").alias("id")).distinct(), "id", "left_semi") if query_every > 1 else units
    asked = asked.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(replicas)))
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")

    def run(some, home_only):
        both = index.unionAll(some.mapInPandas(query_rows(home_only), layout))
        return both.repartition(max(parallel, 4 * n_groups), "grp").sortWithinPartitions("grp", "q").mapInPandas(answer, schema)

    if min_cosine is not None:
        got = run(asked.withColumn("far", F.lit(2 - 2 * min_cosine + 1e-7)), False)
    else:
        free = asked.withColumn("far", F.lit(4.0))
        home = stage(run(free, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "home")
        bound = home.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (2 - 2 * F.col("cosine") + 1e-7).alias("far"))
        bounded = asked.join(bound, "id", "left").withColumn("far", F.coalesce("far", F.lit(4.0)))
        # What the home cell gave stays, whatever its projected distance.
        got = run(bounded, False).unionAll(home.drop("rank")).distinct()
    near = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    return _answers(queries, near, copies, k)


def _classes(units: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Vectors with their digests, and (``d1``, ``d2``, ``ids``): the ``k + 1`` lowest ids of each vector that occurs more than once, written as a table."""
    marked = units.withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(3), "v")})
    # The rank's limit is applied ahead of the shuffle as well, so a hot vector sends k + 1 ids a task.
    low = marked.select("id", "d1", "d2").withColumn("n", F.row_number().over(Window.partitionBy("d1", "d2").orderBy("id"))).where(F.col("n") <= k + 1)
    copies = low.groupBy("d1", "d2").agg(F.sort_array(F.collect_list("id")).alias("ids")).where("size(ids) > 1")
    return marked, stage(copies, "copies")


def _named(marked: DataFrame, copies: DataFrame) -> DataFrame:
    """Vectors with their ``class``, the lowest id of an equal one, and its lowest ``ids``."""
    return marked.join(copies, ["d1", "d2"], "left").select("id", "v", "p", F.coalesce(F.col("ids")[0], "id").alias("class"), F.coalesce("ids", F.array("id")).alias("ids"))


def _answers(queries: DataFrame, near: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """(``query_id``, ``id``, ``cosine``, ``rank``) of all rows asked for, from the nearest classes of their classes."""
    by_class = copies.select(F.col("ids")[0].alias("id"), "ids")
    spread_out = near.join(by_class, "id", "left").select("query_id", "cosine", F.explode(F.coalesce("ids", F.array("id"))).alias("id"))
    pair = F.struct((-F.col("cosine")).alias("far"), "id")
    others = spread_out.groupBy(F.col("query_id").alias("class")).agg(F.collect_list(pair).alias("others"))
    own = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id")))
    kind = "array<struct<far:double,id:bigint>>"
    both = queries.select("id", "class", "ids").join(others, "class", "left").select(F.col("id").alias("query_id"), F.concat(own.cast(kind), F.coalesce(F.col("others").cast(kind), F.array().cast(kind))).alias("c"))
    first = F.slice(F.array_sort(F.filter("c", lambda x: x["id"] != F.col("query_id"))), 1, k)
    return both.select("query_id", F.posexplode(first).alias("rank", "x")).select("query_id", F.col("x.id").alias("id"), (-F.col("x.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def similar_pairs(rows: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, min_cosine: float = 0.85) -> DataFrame:
    """(``vec_id_a``, ``vec_id_b``, ``cosine``), smaller id first: pairs of at least ``min_cosine``
    of which one is among the ``k`` most similar of the other."""
    found = nearest(rows, id_col, vec_col, k, dim, min_cosine).where(F.col("cosine") >= min_cosine)
    return found.select(F.least("query_id", "id").alias("vec_id_a"), F.greatest("query_id", "id").alias("vec_id_b"), "cosine").groupBy("vec_id_a", "vec_id_b").agg(F.max("cosine").alias("cosine"))


def brute_force(rows: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, query_every: int = 100, block: int = 4096) -> DataFrame:
    """Exact answers for the stated query set, in blocks against all rows (to measure recall)."""
    spark = rows.sparkSession
    units = unit_vectors(rows, id_col, vec_col, dim).select("id", "v")
    schema = "query_id bigint, id bigint, cosine double"
    queries = units.where(F.col("id") % query_every == 0)
    n = queries.count()
    parts = max(1, math.ceil(n / block))
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    out = None
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()
        held = spark.sparkContext.broadcast((np.array([r.id for r in mine], np.int64), _matrix([r.v for r in mine], dim) if mine else None))

        def run(frames, held=held):
            qid, q = held.value
            for f in frames:
                if not len(f) or q is None:
                    continue
                ids = f.id.values
                s = np.round(q.astype(np.float64) @ _matrix(f.v, dim).astype(np.float64).T, 9)
                s[qid[:, None] == ids[None, :]] = -2
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                a = np.repeat(np.arange(len(qid)), order.shape[1])
                b = order.ravel()
                ok = s[a, b] > -2
                yield pd.DataFrame({"query_id": qid[a][ok], "id": ids[b][ok], "cosine": s[a, b][ok]})

        got = units.mapInPandas(run, schema)
        out = got if out is None else out.unionAll(got)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall_report(rows: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, query_every: int = 100) -> DataFrame:
    """One row: queries, exact neighbours, how many were found, recall."""
    exact = brute_force(rows, id_col, vec_col, k, dim, query_every).select("query_id", "id")
    found = nearest(rows, id_col, vec_col, k, dim, None, query_every).select("query_id", "id", F.lit(1).alias("hit"))
    joined = exact.join(found, ["query_id", "id"], "left")
    return joined.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("exact_neighbours"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.col("found") / F.greatest("exact_neighbours", F.lit(1)))
