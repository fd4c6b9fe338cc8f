"""Synthetic URLs: deterministic, generated in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.hashing import md5_number


def random_urls(spark: SparkSession, n: int, dup_ratio: float = 0.3, domain: str = "https://example.com") -> DataFrame:
    """(``i``, ``url``): about ``dup_ratio`` of the URLs repeat the path number of an earlier row."""
    i = F.col("i")
    h = md5_number(F.concat(F.lit("dup"), i.cast("string")))
    earlier = md5_number(F.concat(F.lit("ref"), i.cast("string"))) % F.greatest(i, F.lit(1))
    path = F.when((i > 0) & (h % 1000 < int(dup_ratio * 1000)), earlier).otherwise(i)
    return spark.range(n).withColumnRenamed("id", "i").select("i", F.concat(F.lit(domain + "/"), F.substring(F.md5(F.concat(F.lit("path"), path.cast("string"))), 1, 12)).alias("url"))


def absent_urls(spark: SparkSession, n: int, domain: str = "https://nonexistent.com") -> DataFrame:
    """(``i``, ``url``) of a domain of its own."""
    return spark.range(n).withColumnRenamed("id", "i").select("i", F.concat(F.lit(domain + "/"), F.substring(F.md5(F.concat(F.lit("absent"), F.col("i").cast("string"))), 1, 12)).alias("url"))
