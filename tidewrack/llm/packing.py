"""Filling fixed-capacity containers by bulk-synchronous best fit.

Sizes are whole numbers of at most ``capacity``, so documents and gaps, sorted by
size, fall into at most ``capacity`` classes, and all that a superstep has to
know of a class is how many members it has. The distributed part ranks documents
within their size class (a hot class is cut into hashed buckets and ranked by
bucket counts) and places each by its rank; the sweep itself runs over the class
counts:

* superstep: the largest class not yet placed meets the gaps in ascending order
  from its successor (the smallest gap that holds it) on;
* conflicts - more documents than gaps - are resolved by rank: ranks [a, b) take
  the gaps of this class, later ranks go on to the next larger one, and what is
  left opens new containers;
* gaps shrink by the size placed and the next superstep follows.

The sweep holds runs of containers with equal gaps and gives runs of ranks, so
its size follows the capacity and not the number of documents.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.arrow_text import count_tokens
from tidewrack.runtime import spread, stage

CAPACITY = 1024
RANK_BUCKET = 100_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``tokens``) by the word pattern ``[a-zA-Z0-9]+``; a null text has no tokens."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_tokens(b.column(1)))], names=[id_col, "tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, tokens bigint")


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (size, first rank, ranks, first container, offset) and the number of containers."""
    placed: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first container, containers)
    containers = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        # The successor sweep: gaps of at least this size, the smallest first. A
        # shrunken gap that still holds this size is the new smallest.
        queue = [g for g in gaps if g >= size and gaps[g]]
        heapq.heapify(queue)
        while left and queue:
            gap = heapq.heappop(queue)
            runs = gaps.pop(gap, [])
            while left and runs:
                first, n = runs.pop()
                take = min(n, left)
                placed.append((size, rank, take, first, capacity - gap))
                if take < n:
                    runs.append((first + take, n - take))
                rest = gap - size
                if rest:
                    if rest not in gaps or not gaps[rest]:
                        if rest >= size:
                            heapq.heappush(queue, rest)
                    gaps[rest].append((first, take))
                rank, left = rank + take, left - take
            if runs:
                gaps[gap].extend(runs)
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            for filled, n in ((each, full), (rest, int(rest > 0))):
                if n:
                    for k in range(filled):
                        placed.append((size, rank + k * n, n, containers, k * size))
                    rank += filled * n
                    gap = capacity - filled * size
                    if gap:
                        gaps[gap].append((containers, n))
                    containers += n
    return placed, containers


def ranked(items: DataFrame, id_col: str, total: int, bucket: int = RANK_BUCKET) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each size, dense, in no group larger than about ``bucket``."""
    n = max(1, total // bucket)
    items = items.withColumn("b", F.pmod(F.xxhash64(id_col, "piece"), F.lit(n)))
    per = items.groupBy("size", "b").agg(F.count("*").alias("n"))
    ahead = per.select("size", "b", (F.sum("n").over(Window.partitionBy("size").orderBy("b")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("size", "b").orderBy(id_col, "piece")) - 1
    return items.withColumn("own", own).join(ahead, ["size", "b"]).withColumn("rank", F.col("ahead") + F.col("own")).drop("b", "own", "ahead")


def pack(sizes: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, bucket: int = RANK_BUCKET) -> DataFrame:
    """(id, ``piece``, ``container_id``, ``start``, ``tokens``) for (id, ``tokens``) rows.

    Only an item above the capacity is split: into full pieces and a rest, which
    fits in like any other item. Items of size zero or null size take no space
    and have one piece without a container; repeated ids are items of their own.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = dict(sizes.dtypes)[id_col]
    c = F.lit(capacity).cast("bigint")
    t = F.coalesce(F.col("tokens"), F.lit(0).cast("bigint"))
    pieces = F.greatest(F.lit(1), F.ceil(t / c))
    items = sizes.select(F.col(id_col), t.alias("t"), F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    items = stage(items.select(id_col, "piece", F.least(c, F.col("t") - F.col("piece") * c).alias("size")), "items")
    counts = {int(r["size"]): int(r["n"]) for r in items.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    placed, _ = sweep(counts, capacity)
    spark = sizes.sparkSession
    plan = spark.createDataFrame(placed, "size bigint, lo bigint, n bigint, container bigint, start bigint")
    r = ranked(items.where("size > 0"), id_col, sum(counts.values()), bucket).alias("r")
    p = F.broadcast(plan).alias("p")
    hit = (F.col("r.size") == F.col("p.size")) & (F.col("r.rank") >= F.col("p.lo")) & (F.col("r.rank") < F.col("p.lo") + F.col("p.n"))
    out = r.join(p, hit).select(F.col(f"r.{id_col}").cast(kind).alias(id_col), F.col("r.piece").alias("piece"), (F.col("p.container") + F.col("r.rank") - F.col("p.lo")).alias("container_id"), F.col("p.start").alias("start"), F.col("r.size").alias("tokens"))
    empty = items.where("size = 0").select(id_col, "piece", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("bigint").alias("start"), F.col("size").alias("tokens"))
    return out.unionAll(empty)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(sized(docs.where("doc_id is not null")), "doc_id", capacity)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, pieces, tokens, containers, the least possible number of them, unused share."""
    agg = packed.agg(F.count("*").alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("containers"))
    space = F.col("containers") * capacity
    return agg.select("pieces", "tokens", "containers", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.when(space > 0, 1 - F.col("tokens") / space).otherwise(0.0).alias("unused_share"))
