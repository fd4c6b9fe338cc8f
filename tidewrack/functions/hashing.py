"""Hash families for sketches.

``md5`` exists in every SQL engine and serves the queries that are compared with
SQL; ``xxh64`` (seed 0, unsigned) is the one that sketches saved elsewhere use.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(text: Column, part: int = 0) -> Column:
    """60 bits of the MD5 of a string as a number; ``part`` 0 and 1 are independent."""
    return F.conv(F.substring(F.md5(text), 1 + 16 * part, 15), 16, 10).cast("bigint")


def _xxh64_cell(width: int):
    @F.pandas_udf("bigint")
    def run(text: pd.Series) -> pd.Series:
        digest = xxhash.xxh64_intdigest
        return pd.Series([digest(t) % width for t in text], dtype="int64")

    return run


def sketch_cell(row: Column, term: Column, width: int | Column, family: str = "md5") -> Column:
    """Cell of a term in a sketch row: hash of the row's number followed by the term, modulo the width."""
    text = F.concat(row.cast("string"), term)
    if family == "md5":
        return md5_number(text) % (F.lit(width) if isinstance(width, int) else width)
    if family == "xxh64":
        return _xxh64_cell(width)(text)
    raise ValueError(f"unknown hash family {family}")


def item_hash(item: Column, salt_hex: Column) -> Column:
    """160-bit hash as 40 hex digits (their order is the numbers'): SHA-1 of item and 4-byte salt."""
    return F.sha1(F.concat(item.cast("binary"), F.unhex(salt_hex)))
