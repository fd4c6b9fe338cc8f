"""Has this key been seen before? Scalable Bloom chains over shards of the key space.

The order of ids is kept without a sequential pass over all rows:

* ids are cut into blocks by hash; within (block, key) only the lowest id goes on (an
  aggregate with map-side combine, so a key that a third of all rows carry
  shrinks to ``block`` rows before any shuffle): all others have been seen;
* keys are hashed to shards; each shard streams its rows in id order past its own
  chain of Bloom layers and holds nothing else. Layer i has ``capacity * growth**i``
  keys and an error rate of ``error * tightening**i``, so the error of the whole
  chain stays below ``error / (1 - tightening)`` however long the history gets;
* ``History`` keeps the chains and the keys that were called new in a folder. A
  later batch is decided by the chains alone, without any row of earlier batches;
* "new" is always right. What is called seen is verified: it is a false alarm iff
  no row of its key was called new. The keys called new in the same batch answer
  nearly all of that; only the rest is looked up in the history's keys.

A stream that is recomputed after the loss of an executor meets its rows in the
same order and decides alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.urls import url_key
from tidewrack.runtime import default_partitions, key128, stage

BLOCK = 256
#: Shards of a history; more than there are tasks, so that later batches may use larger clusters.
SHARDS = 256
CAPACITY = 1 << 12
GROWTH = 2
ERROR = 0.001
TIGHTENING = 0.5
BATCH = 8192


class Chain:
    """A scalable Bloom filter over pairs of 64-bit hashes."""

    def __init__(self, capacity: int = CAPACITY, error: float = ERROR, growth: int = GROWTH, tightening: float = TIGHTENING):
        self.capacity, self.error, self.growth, self.tightening = capacity, error, growth, tightening
        self.layers: list[tuple[np.ndarray, int, int]] = []
        self.room = 0

    def _grow(self) -> None:
        i = len(self.layers)
        capacity = self.capacity * self.growth**i
        error = self.error * self.tightening**i
        bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
        self.layers.append((np.zeros((bits + 7) // 8, np.uint8), bits, max(1, round(bits / capacity * math.log(2)))))
        self.room = capacity

    @staticmethod
    def _spots(h1: np.ndarray, h2: np.ndarray, bits: int, k: int) -> np.ndarray:
        step = h2 | np.uint64(1)
        return (h1[:, None] + np.arange(k, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for array, bits, k in self.layers:
            open_ = np.flatnonzero(~found)
            if not len(open_):
                break
            spots = self._spots(h1[open_], h2[open_], bits, k)
            found[open_] = ((array[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        return found

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = 0
        while at < len(h1):
            if not self.room:
                self._grow()
            n = min(self.room, len(h1) - at)
            array, bits, k = self.layers[-1]
            spots = self._spots(h1[at : at + n], h2[at : at + n], bits, k).ravel()
            np.bitwise_or.at(array, spots >> np.uint64(3), (np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8)))
            self.room -= n
            at += n

    @property
    def bound(self) -> float:
        """Compounded false-positive bound of the layers so far."""
        miss = 1.0
        for i in range(len(self.layers)):
            miss *= 1 - self.error * self.tightening**i
        return 1 - miss

    @property
    def size_bits(self) -> int:
        return sum(bits for _, bits, _ in self.layers)


    def state(self) -> list[tuple[int, int, bytes]]:
        """(number, free places, bits) of each layer."""
        return [(i, self.room if i == len(self.layers) - 1 else 0, array.tobytes()) for i, (array, _, _) in enumerate(self.layers)]

    def restore(self, layers: list[tuple[int, int, bytes]]) -> "Chain":
        for _, room, raw in sorted(layers):
            self._grow()
            self.layers[-1] = (np.frombuffer(raw, np.uint8).copy(), *self.layers[-1][1:])
            self.room = room
        return self


_STATE = "shard int, layer int, room bigint, array binary"
_DECIDED = f"k1 bigint, k2 bigint, id bigint, seen boolean, layers int, bits bigint, bound double, {_STATE}"


def _rows(n: int, **columns) -> pa.RecordBatch:
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "id": pa.int64(), "seen": pa.bool_(), "layers": pa.int32(), "bits": pa.int64(), "bound": pa.float64(), "shard": pa.int32(), "layer": pa.int32(), "room": pa.int64(), "array": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))


def _decide(shape: tuple, keep: bool):
    """Rows (shard, id, k1, k2, layer, room, array) come by shard, a shard's old layers ahead of its events in id order."""

    def run(batches):
        at, chain, old = None, None, []
        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(shards)]):
                part = batch.slice(lo, hi - lo)
                if shards[lo] != at:
                    if keep and chain is not None:
                        yield from _kept(at, chain)
                    at, chain, old = shards[lo], Chain(*shape), []
                layers = part.filter(part.column(4).is_valid())
                if layers.num_rows:
                    old += zip(*(layers.column(i).to_pylist() for i in (4, 5, 6)))
                    chain = Chain(*shape).restore(old)
                events = part.filter(part.column(4).is_null())
                if events.num_rows:
                    yield _answered(chain, *(events.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 1)))
        if keep and chain is not None:
            yield from _kept(at, chain)

    return run


def _answered(chain: Chain, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    u1, u2 = k1.view(np.uint64), k2.view(np.uint64)
    seen = np.zeros(len(ids), bool)
    for at in range(0, len(ids), BATCH):
        a, b = u1[at : at + BATCH], u2[at : at + BATCH]
        # Of equal keys in one step the first decides and the rest have been seen.
        _, first = np.unique(a ^ (b * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        first.sort()
        part = np.ones(len(a), bool)
        part[first] = chain.contains(a[first], b[first])
        fresh = ~part
        chain.add(a[fresh], b[fresh])
        seen[at : at + BATCH] = part
    n = len(ids)
    return _rows(n, k1=k1, k2=k2, id=ids, seen=seen, layers=np.full(n, len(chain.layers)), bits=np.full(n, chain.size_bits), bound=np.full(n, chain.bound))


def _kept(shard: int, chain: Chain):
    for layer, room, raw in chain.state():
        yield _rows(1, shard=[shard], layer=[layer], room=[room], array=[raw])


@dataclass
class History:
    """Chains and keys of earlier batches in a folder that all executors share, one subfolder a batch; ``shards`` is the same in all batches."""

    spark: SparkSession
    path: str
    shards: int = SHARDS

    def _batches(self) -> list[str]:
        fs, root = self._at(self.path)
        return sorted(str(f.getPath()) for f in fs.listStatus(root) if f.isDirectory() and self._done(str(f.getPath()))) if fs.exists(root) else []

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _done(self, batch: str) -> bool:
        fs, p = self._at(f"{batch}/chains/_SUCCESS")
        return fs.exists(p)

    def chains(self) -> DataFrame:
        """The layers after the last batch."""
        done = self._batches()
        return self.spark.read.schema(_STATE).parquet(f"{done[-1]}/chains") if done else self.spark.createDataFrame([], _STATE)

    def keys(self) -> DataFrame:
        """(``k1``, ``k2``) of all keys that were called new."""
        done = self._batches()
        return self.spark.read.schema("k1 bigint, k2 bigint").parquet(*[f"{b}/keys" for b in done]) if done else self.spark.createDataFrame([], "k1 bigint, k2 bigint")

    def add(self, decided: DataFrame, alarms: DataFrame) -> None:
        """Saves a batch; its chains come last and make it count. Shards without events keep their old layers."""
        now = decided.where("shard is not null").selectExpr("shard", "layer", "room", "array")
        old = self.chains().join(now.select("shard").distinct(), "shard", "left_anti")
        batch = f"{self.path}/batch-{len(self._batches()):06d}"
        decided.where("not seen").select("k1", "k2").unionAll(alarms.select("k1", "k2")).write.mode("overwrite").parquet(f"{batch}/keys")
        now.unionAll(old.select(*now.columns)).write.mode("overwrite").parquet(f"{batch}/chains")


def key_events(rows: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(``id``, ``k1``, ``k2``) for each distinct non-null key of a row; null ids are left out."""
    pairs = [F.struct(k1.alias("k1"), k2.alias("k2")) for k1, k2 in map(key128, keys)]
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.array(*pairs))).alias("k")).where("k.k1 is not null").select("id", "k.k1", "k.k2")


def decisions(events: DataFrame, block: int = BLOCK, capacity: int = CAPACITY, error: float = ERROR, growth: int = GROWTH, tightening: float = TIGHTENING, history: History | None = None) -> DataFrame:
    """The chains' answers for the first row of each (block, key), and with a ``history`` their layers afterwards (``shard`` not null); written as a table."""
    tasks = default_partitions(events.sparkSession)
    shard = F.pmod(F.xxhash64("k1", "k2"), F.lit(history.shards if history is not None else tasks)).cast("int")
    firsts = events.groupBy(F.pmod(F.xxhash64("id"), F.lit(block)).alias("blk"), "k1", "k2").agg(F.min("id").alias("id"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("layer", "int"), ("room", "bigint"), ("array", "binary"))]
    rows = firsts.select(shard.alias("shard"), F.col("id").cast("bigint").alias("id"), "k1", "k2", *nothing)
    if history is not None:
        none = [F.lit(None).cast("bigint").alias(c) for c in ("id", "k1", "k2")]
        rows = rows.unionByName(history.chains().select("shard", *none, "layer", "room", "array"))
    # Null ids, those of old layers, come first.
    ordered = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "id", "k1", "k2")
    return stage(ordered.mapInArrow(_decide((capacity, error, growth, tightening), history is not None), _DECIDED), "decisions")


def false_alarms(decided: DataFrame, history: History | None = None) -> DataFrame:
    """(``k1``, ``k2``, ``id``): keys that were called seen though no row was called new, with their first row."""
    doubt = decided.where("seen").join(decided.where("not seen").select("k1", "k2"), ["k1", "k2"], "left_anti")
    if history is not None:
        doubt = doubt.join(history.keys(), ["k1", "k2"], "left_anti")
    return doubt.groupBy("k1", "k2").agg(F.min("id").alias("id"))


def seen_before(rows: DataFrame, id_col: str, keys: list[Column], history: History | None = None, **chain) -> DataFrame:
    """Ids of rows with a key that some row with a lower id, or an earlier batch of the ``history``, carries.

    Every row has its chain's decision: it is the row that its chain called new,
    or it has been seen. Seen ones are verified. Null keys never match; rows of
    one id count as one row; an empty table gives an empty result.
    """
    events = key_events(rows, id_col, keys)
    decided = decisions(events, history=history, **chain)
    alarms = false_alarms(decided, history)
    if history is not None:
        alarms = stage(alarms, "alarms")
    called_new = decided.where("not seen").select("k1", "k2", "id")
    seen = events.join(called_new, ["k1", "k2", "id"], "left_anti").join(alarms, ["k1", "k2", "id"], "left_anti")
    out = seen.select(F.col("id").alias(id_col)).distinct()
    if history is not None:
        out = stage(out, "seen")
        history.add(decided, alarms)
    return out


def error_report(rows: DataFrame, id_col: str, keys: list[Column], **chain) -> DataFrame:
    """One row: decisions, distinct keys, wrong answers of the chains before verification, their rate, its bound, layers and bits."""
    decided = decisions(key_events(rows, id_col, keys), **chain)
    false = false_alarms(decided).count()
    zero = F.lit(0).cast("bigint")
    new = F.coalesce(F.sum((~F.col("seen")).cast("bigint")), zero)
    out = decided.agg(
        F.count("*").alias("decisions"),
        (new + F.lit(false)).alias("distinct_keys"),
        F.lit(false).cast("bigint").alias("false_alarms"),
        F.coalesce(F.max("bound"), F.lit(0.0)).alias("false_rate_bound"),
        F.coalesce(F.max("layers"), F.lit(0)).alias("layers"),
        F.coalesce(F.max("bits"), zero).alias("bits_of_largest_shard"),
    )
    return out.withColumn("false_rate", F.col("false_alarms") / F.greatest("distinct_keys", F.lit(1)))


def fetch_keys() -> list[Column]:
    return [url_key(F.col("requested_url")), url_key(F.col("url"))]
