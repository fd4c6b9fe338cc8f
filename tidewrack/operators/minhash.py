"""MinHash signatures of item sets.

Items recur far more often than they are new, so each task hashes an item once
for all salts and keeps the leading 64 bits of its hashes in a table of bounded
size; a document's least hash under a salt is an argmin over its items' rows, and
only the winners' full hashes are written out. No vocabulary is gathered.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.runtime import spread

# Seed and length of a signature.
SEED = 47
NUM_HASHES = 128
EMPTY = "0" * 40
#: Items whose hashes a task keeps (a kilobyte each); the plan is the same beyond.
MAX_VOCABULARY = 1 << 16


def salts(num_hashes: int = NUM_HASHES, seed: int = SEED) -> list[int]:
    """32-bit salts of a seeded Mersenne Twister of its own."""
    draw = random.Random(seed)
    return [draw.randint(0, 2**32 - 1) for _ in range(num_hashes)]


def salt_hex(salt: int) -> str:
    return salt.to_bytes(4, "little").hex()


class _Hashes:
    """Leading 64 bits of the salted hashes of items."""

    def __init__(self, tails: list[bytes], room: int):
        self.tails, self.room = tails, room
        self.place: dict[str, int] = {}
        self.heads = np.empty((min(room, 1024), len(tails)), np.uint64)

    def of(self, items: list[str]) -> np.ndarray:
        """A row for each of the items, of which there are ``room`` at most."""
        new = [x for x in dict.fromkeys(items) if x not in self.place]
        if len(self.place) + len(new) > self.room:
            self.place.clear()
            new = list(dict.fromkeys(items))
        while len(self.heads) < len(self.place) + len(new):
            self.heads = np.concatenate([self.heads, np.empty_like(self.heads)])
        for x in new:
            raw, at = x.encode(), len(self.place)
            self.heads[at] = np.frombuffer(b"".join([hashlib.sha1(raw + t).digest()[:8] for t in self.tails]), ">u8")
            self.place[x] = at
        return self.heads[[self.place[x] for x in items]]


def signatures(sets: DataFrame, id_col: str, items_col: str, num_hashes: int = NUM_HASHES, seed: int = SEED, max_vocabulary: int = MAX_VOCABULARY) -> DataFrame:
    """(id, ``signature``): 40 hex digits of the least SHA-1 for each salt; an empty set has zeros only.

    Null sets are left out. ``max_vocabulary`` bounds the items whose hashes a task keeps.
    """
    known = sets.where(F.col(items_col).isNotNull())
    room = max(1, max_vocabulary)
    tails = [salt.to_bytes(4, "little") for salt in salts(num_hashes, seed)]
    kind = dict(sets.dtypes)[id_col]

    def run(frames):
        hashes = _Hashes(tails, room)
        for f in frames:
            out = []
            for own in f.s:
                own = own.tolist()
                if not own:
                    out.append([EMPTY] * num_hashes)
                    continue
                least, winner = None, None
                for at in range(0, len(own), room):
                    rows = hashes.of(own[at : at + room])
                    best = rows.argmin(axis=0)
                    value = rows[best, np.arange(num_hashes)]
                    if least is None:
                        least, winner = value, best
                    else:
                        winner = np.where(value < least, best + at, winner)
                        least = np.minimum(value, least)
                out.append([hashlib.sha1(own[w].encode() + t).hexdigest() for w, t in zip(winner.tolist(), tails)])
            yield pd.DataFrame({id_col: f[id_col], "signature": out})

    return spread(known.select(id_col, F.col(items_col).alias("s"))).mapInPandas(run, f"{id_col} {kind}, signature array<string>")
