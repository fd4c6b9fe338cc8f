"""Most frequent items by combinatorial group testing.

A sketch has ``depth`` rows of ``width`` buckets; a bucket keeps the total of its
updates and, for each bit of the items' 64-bit hashes, the total of updates that
have it set. An item that outweighs the rest of its bucket is read off the bits.
Sketches are sums, so each task builds one of fixed size over its rows and they
are added bucket by bucket. Every decoded candidate is verified: its hash must
fall into the bucket it came from, its least bucket total (never below the true
count where no count is negative) must reach the threshold, and a last pass counts the remaining few
hundred terms exactly.

The driver sees the totals and decoded hashes of ``depth * width`` buckets, a
number that doesn't depend on the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.runtime import default_partitions

WIDTH = 2048
DEPTH = 5
BITS = 64
CHUNK = 1 << 16
#: Tasks beyond which sketches are added in two levels.
LEVEL = 1000
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def bucket(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Bucket of 64-bit hashes in a sketch row."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * _SALTS[row]
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(width)).astype(np.int64)


def add_updates(cells: np.ndarray, h: np.ndarray, c: np.ndarray) -> None:
    """Adds updates to ``cells`` of shape (depth, width, 1 + 64)."""
    depth, width, _ = cells.shape
    h, back = np.unique(h, return_inverse=True)
    c = np.bincount(back, weights=c, minlength=len(h))
    bits = ((h[:, None] >> np.arange(BITS, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(bool)
    weighted = np.where(bits, c[:, None], 0.0)
    for row in range(depth):
        b = bucket(h, row, width)
        order = np.argsort(b, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(b[order]) > 0])
        at = b[order][starts]
        cells[row, at, 0] += np.add.reduceat(c[order], starts).astype(np.int64)
        cells[row, at, 1:] += np.add.reduceat(weighted[order], starts, axis=0).astype(np.int64)


def _sketch(width: int, depth: int):
    def run(batches):
        cells = np.zeros((depth, width, 1 + BITS), np.int64)
        held_h, held_c, n = [], [], 0
        for batch in batches:
            held_h.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held_c.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= CHUNK:
                add_updates(cells, np.concatenate(held_h), np.concatenate(held_c))
                held_h, held_c, n = [], [], 0
        if n:
            add_updates(cells, np.concatenate(held_h), np.concatenate(held_c))
        flat = cells.reshape(depth * width, 1 + BITS)
        used = np.flatnonzero(flat.any(axis=1))
        for at in range(0, len(used), 2048):
            part = used[at : at + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([x.tobytes() for x in flat[part]], pa.binary())], names=["cell", "counts"])

    return run


def _sums(batches) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(raw, np.int64)
            sums[cell] = sums[cell] + counts if cell in sums else counts.copy()
    return sums


def _add(batches):
    sums = _sums(batches)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["cell", "counts"])


def _merge(width: int):
    def run(batches):
        sums = _sums(batches)
        if not sums:
            return
        cells = np.fromiter(sums, np.int64, len(sums))
        table = np.stack([sums[c] for c in cells])
        totals = table[:, 0]
        ones = table[:, 1:] * 2 > totals[:, None]
        h = (ones.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
        home = np.array([bucket(h[i : i + 1], int(c // width), width)[0] == c % width for i, c in enumerate(cells)])
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(totals), pa.array(h.view(np.int64)), pa.array(home & (totals > 0))], names=["cell", "total", "h", "home"])

    return run


def heavy_hitters(rows: DataFrame, item: Column, count: Column, share: float, width: int | None = None, depth: int = DEPTH) -> DataFrame:
    """(``item``, ``total``, ``estimate``) of items with at least ``share`` of all counts.

    Null items take no part, nor do null counts. ``width`` is four times
    ``1 / share`` at least (``WIDTH`` or that if not given, a lower one is an error): then the rest of an item's bucket weighs a quarter of
    the threshold on average and an item is missed only if it is outweighed in
    all rows. An empty table, or counts that add up to zero or less, give an
    empty result.
    """
    if depth > len(_SALTS):
        raise ValueError(f"depth is at most {len(_SALTS)}")
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    least = 1 << math.ceil(math.log2(4 / share))
    width = max(WIDTH, least) if width is None else width
    if width < 4 / share:
        raise ValueError(f"a share of {share} needs a width of {least}")
    spark = rows.sparkSession
    updates = rows.select(item.alias("item"), count.cast("bigint").alias("c")).where("item is not null and c is not null")
    hashed = updates.select(F.xxhash64("item").alias("h"), "c")
    parts = hashed.mapInArrow(_sketch(width, depth), "cell bigint, counts binary")
    # Partial sums first, so that a bucket meets as many rows as there are groups of tasks, whatever their number.
    tasks = default_partitions(spark)
    parts = parts.repartition(tasks, "cell", F.spark_partition_id() % tasks).mapInArrow(_add, "cell bigint, counts binary") if parts._jdf.queryExecution().toRdd().getNumPartitions() > LEVEL else parts
    merged = parts.repartition(default_partitions(spark), "cell").mapInArrow(_merge(width), "cell bigint, total bigint, h bigint, home boolean").collect()
    totals = np.zeros((depth, width), np.int64)
    for r in merged:
        totals[r.cell // width, r.cell % width] = r.total
    everything = int(totals[0].sum())
    floor = share * everything
    found = np.unique(np.array([r.h for r in merged if r.home], np.int64).view(np.uint64))
    if everything > 0 and len(found):
        least = np.min([totals[row, bucket(found, row, width)] for row in range(depth)], axis=0)
        keep = least >= floor
        found, least = found[keep], least[keep]
    else:
        found, least = found[:0], np.zeros(0, np.int64)
    kept = spark.createDataFrame([(int(h), int(e)) for h, e in zip(found.view(np.int64), least)], "h bigint, estimate bigint")
    counted = updates.withColumn("h", F.xxhash64("item")).join(F.broadcast(kept), "h").groupBy("item").agg(F.sum("c").alias("total"), F.max("estimate").alias("estimate"))
    return counted.where(F.col("total") >= F.lit(floor))


def term_item() -> Column:
    """Terms lower-cased without spaces at both ends; empty ones become null."""
    t = F.trim(F.lower(F.col("term")))
    return F.when(t != "", t)
