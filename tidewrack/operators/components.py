"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.runtime import drop_stage, stage_counted

MAX_ROUNDS = 64


def _large_star(e: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node's neighbourhood."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``id``, ``component``): the least id each linked node can reach.

    Loops and edges with a null end are ignored; nodes without edges don't
    appear. A hub is never gathered: both operations reduce its neighbours to
    their least by an aggregate with map-side combine.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()

    def cut(df):
        out, n = stage_counted(df, "stars", rows=F.lit(1), sum=F.shiftright(F.xxhash64("u", "v"), 24))
        return out, n

    e, last = cut(e)
    for _ in range(MAX_ROUNDS):
        grown, now = cut(_small_star(_large_star(e).distinct()).distinct())
        drop_stage(e)
        e = grown
        if now == last:
            break
        last = now
    tops = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(tops)
