"""Scalable Bloom filters as bitmaps in blocks of fixed size.

Layer i takes ``capacity * expansion**i`` keys at an error rate of
``error_rate * tightening**i``; keys fill the layers in the order of their first
insertion. A key is a member if all its bits are set in one layer.

A task sets the bits of its keys in blocks of its own; blocks are or'ed by their
number, so what is shuffled is a bitmap and not a row for each bit. Probes meet
the blocks in memory while all filters together stay below ``MAX_BROADCAST``
bytes; larger ones are met block by block in a join, with the same answers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.hashing import md5_number
from tidewrack.operators.ranking import global_rank
from tidewrack.runtime import stage

# Defaults of the crawl's seen-set.
CAPACITY = 10_000_000
ERROR_RATE = 0.001
EXPANSION = 2
TIGHTENING = 0.5
#: Bytes of a block, and of all blocks that are sent to every task at most.
BLOCK = 1 << 12
MAX_BROADCAST = 64 << 20


@dataclass(frozen=True)
class Layer:
    number: int
    first: int  # rank of its first key
    last: int  # one past the rank of its last key
    bits: int
    hashes: int


def layers(n_keys: int, capacity: int, error_rate: float, expansion: int, tightening: float = TIGHTENING) -> list[Layer]:
    """The layers that ``n_keys`` distinct keys need (one for none)."""
    if capacity < 1 or expansion < 1 or not 0 < error_rate < 1:
        raise ValueError("capacity and expansion must be at least 1, the error rate between 0 and 1")
    out: list[Layer] = []
    first = 0
    while not out or first < n_keys:
        i = len(out)
        size, p = capacity * expansion**i, error_rate * tightening**i
        bits = math.ceil(-size * math.log(p) / math.log(2) ** 2)
        out.append(Layer(i, first, first + size, bits, max(1, math.ceil(-math.log2(p)))))
        first += size
    return out


def _hashed(keys: DataFrame, *more: str) -> DataFrame:
    """``more``, ``key`` and its two independent hashes ``h1``, ``h2``."""
    return keys.select(*more, "key", md5_number(F.col("key")).alias("h1"), md5_number(F.col("key"), 1).alias("h2"))


def _places(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bits of each key by double hashing, a row a key."""
    i = np.arange(hashes, dtype=np.int64)[None, :]
    return ((h1 % bits)[:, None] + i * (h2 % bits)[:, None]) % bits


class _Blocks(dict):
    """Blocks by (config, layer, number)."""

    def set(self, config: int, layer: int, places: np.ndarray) -> None:
        places = np.unique(places)
        numbers = places // (8 * BLOCK)
        cuts = np.flatnonzero(np.r_[True, np.diff(numbers) > 0])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(places)]):
            block = self.get(at := (config, layer, int(numbers[lo])))
            if block is None:
                block = self[at] = np.zeros(BLOCK, np.uint8)
            inside = places[lo:hi] % (8 * BLOCK)
            np.bitwise_or.at(block, inside >> 3, (1 << (inside & 7)).astype(np.uint8))

    def merge(self, at: tuple[int, int, int], raw: bytes) -> None:
        block = np.frombuffer(raw, np.uint8)
        self[at] = self[at] | block if at in self else block

    def holds(self, config: int, layer: int, places: np.ndarray) -> np.ndarray:
        out = np.zeros(places.shape, bool)
        numbers = places // (8 * BLOCK)
        for number in np.unique(numbers):
            block = self.get((config, layer, int(number)))
            if block is not None:
                mine = numbers == number
                inside = places[mine] % (8 * BLOCK)
                out[mine] = (block[inside >> 3] >> (inside & 7).astype(np.uint8)) & 1
        return out.all(axis=1)

    def batch(self) -> pa.RecordBatch:
        at = list(self)
        return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in at], pa.int32() if i < 2 else pa.int64()) for i in range(3)), pa.array([self[x].tobytes() for x in at], pa.binary())], names=["config", "layer", "block", "bytes"])


_LAYOUT = "config int, layer int, block bigint, bytes binary"


def _set(shapes: list[list[Layer]]):
    def run(batches):
        blocks = _Blocks()
        for b in batches:
            rank, h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for config, layers_ in enumerate(shapes):
                for x in layers_:
                    mine = (rank >= x.first) & (rank < x.last)
                    if mine.any():
                        blocks.set(config, x.number, _places(h1[mine], h2[mine], x.bits, x.hashes))
        yield blocks.batch()

    return run


def _merge(batches):
    """Rows come by block, so one block is held at a time."""
    blocks = _Blocks()
    for b in batches:
        for config, layer, block, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
            at = (config, layer, block)
            if blocks and at not in blocks:
                yield blocks.batch()
                blocks.clear()
            blocks.merge(at, raw)
    if blocks:
        yield blocks.batch()


@dataclass
class Bloom:
    """Filters of one or more configurations over the same keys; ``blocks``: config, layer, block, bytes."""

    blocks: DataFrame
    shapes: list[list[Layer]]

    @classmethod
    def build(cls, inserts: DataFrame, key: str, order: str, configs: list[tuple[int, float, int]], tightening: float = TIGHTENING) -> "Bloom":
        """Filters with (capacity, error_rate, expansion) each; repeated keys count once, null keys not at all."""
        distinct = inserts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(order).alias("at"))
        ranked = global_rank(distinct, ["at", "key"])
        n = ranked.count()
        shapes = [layers(n, c, p, x, tightening) for c, p, x in configs]
        parts = _hashed(ranked, "rank").select("rank", "h1", "h2").mapInArrow(_set(shapes), _LAYOUT)
        at = ["config", "layer", "block"]
        return cls(stage(parts.repartition(*at).sortWithinPartitions(*at).mapInArrow(_merge, _LAYOUT), "blocks"), shapes)

    @property
    def set_bits(self) -> DataFrame:
        """(``config``, ``layer``, ``bit``), a row for each bit that is set."""

        def run(batches):
            for b in batches:
                for config, layer, block, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                    bits = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")) + block * 8 * BLOCK
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), config, np.int32)), pa.array(np.full(len(bits), layer, np.int32)), pa.array(bits.astype(np.int64))], names=["config", "layer", "bit"])

        return self.blocks.mapInArrow(run, "config int, layer int, bit bigint")

    def contains(self, probes: DataFrame, key: str) -> DataFrame:
        """(``config``, ``key``): the distinct probes that some layer holds all bits of."""
        asked = _hashed(probes.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct())
        if sum((x.bits + 7) // 8 for ls in self.shapes for x in ls) <= MAX_BROADCAST:
            return self._contains_local(asked)
        return self._contains_joined(asked)

    def _contains_local(self, asked: DataFrame) -> DataFrame:
        blocks, shapes = _Blocks(), self.shapes
        for r in self.blocks.toLocalIterator():
            blocks.merge((r.config, r.layer, r.block), bytes(r.bytes))
        held = asked.sparkSession.sparkContext.broadcast(blocks)

        def run(batches):
            for b in batches:
                h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                for config, layers_ in enumerate(shapes):
                    found = np.zeros(b.num_rows, bool)
                    for x in layers_:
                        open_ = np.flatnonzero(~found)
                        found[open_] = held.value.holds(config, x.number, _places(h1[open_], h2[open_], x.bits, x.hashes))
                    keys = b.column(0).filter(pa.array(found))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), config, np.int32)), keys], names=["config", "key"])

        return asked.mapInArrow(run, "config int, key string")

    def _contains_joined(self, asked: DataFrame) -> DataFrame:
        shapes = self.shapes

        def wanted(batches):
            for b in batches:
                h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                for config, layers_ in enumerate(shapes):
                    for x in layers_:
                        places = _places(h1, h2, x.bits, x.hashes)
                        n = places.size
                        keys = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), x.hashes)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, config, np.int32)), pa.array(np.full(n, x.number, np.int32)), pa.array((places // (8 * BLOCK)).ravel()), pa.array((places % (8 * BLOCK)).ravel().astype(np.int32)), keys], names=["config", "layer", "block", "place", "key"])

        spots = asked.mapInArrow(wanted, "config int, layer int, block bigint, place int, key string")
        bit = F.expr("shiftright(cast(conv(hex(substring(bytes, place div 8 + 1, 1)), 16, 10) AS int), place % 8) & 1")
        met = spots.join(self.blocks, ["config", "layer", "block"], "left").select("config", "layer", "key", F.coalesce(bit == 1, F.lit(False)).alias("set"))
        return met.groupBy("config", "layer", "key").agg(F.min("set").alias("all")).where("all").select("config", "key").distinct()

    def info(self) -> DataFrame:
        """(``config``, ``layers``, ``memory_bytes``)."""
        rows = [(i, len(ls), sum((x.bits + 7) // 8 for x in ls)) for i, ls in enumerate(self.shapes)]
        return self.blocks.sparkSession.createDataFrame(rows, "config int, layers int, memory_bytes bigint")


def measure(inserts: DataFrame, absent: DataFrame, configs: list[tuple[int, float, int]], key: str = "url", order: str = "i") -> DataFrame:
    """(``capacity``, ``error_rate``, ``expansion``, ``layers``, ``memory_bytes``, ``fpr``) for each configuration.

    ``fpr`` is the share of the absent probes that the filter claims to hold.
    """
    spark = inserts.sparkSession
    bloom = Bloom.build(inserts, key, order, configs)
    claimed = bloom.contains(absent, key).join(absent.select(F.col(key).alias("key")), "key").groupBy("config").agg(F.count("*").alias("claimed"))
    n = absent.where(F.col(key).isNotNull()).count()
    given = spark.createDataFrame([(i, c, p, x) for i, (c, p, x) in enumerate(configs)], "config int, capacity bigint, error_rate double, expansion int")
    out = given.join(bloom.info(), "config").join(claimed, "config", "left")
    rate = F.round(F.coalesce("claimed", F.lit(0)) / F.lit(max(n, 1)), 6)
    return out.select("capacity", "error_rate", "expansion", "layers", "memory_bytes", rate.alias("fpr"))


def unseen(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Exact seen-set: candidates whose key isn't among the seen ones (null keys stay)."""
    return candidates.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def maybe_unseen(candidates: DataFrame, bloom: Bloom, key: str) -> DataFrame:
    """Approximate seen-set: drops what the first filter claims to hold, false alarms included."""
    claimed = bloom.contains(candidates, key).where("config = 0").select(F.col("key").alias(key))
    return candidates.join(claimed, key, "left_anti")
