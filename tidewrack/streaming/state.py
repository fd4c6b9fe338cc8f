"""Streaming forms of stateful operators; each equals its batch form over the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.text import word_tokens
from tidewrack.runtime import shared_dir


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the parquet files at ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def dedupe(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key, never forgotten (the crawl's seen-set)."""
    return stream.dropDuplicates(keys)


def dedupe_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key, with state bounded by a watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def term_frequencies(stream: DataFrame, text: str = "text", tokenizer=word_tokens) -> DataFrame:
    """Incremental term frequencies (update or complete mode)."""
    return stream.where(F.col(text).isNotNull()).select(F.explode(tokenizer(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the result as a table.

    Append results go to a parquet sink in the shared folder; complete results
    replace a table there at each batch.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def to_handler(stream: DataFrame, handler: Callable[[DataFrame], None], name: str) -> None:
    """Gives each micro-batch to a handler; its errors are reported and don't stop the stream."""

    def isolated(df: DataFrame, number: int) -> None:
        try:
            handler(df)
        except Exception as e:  # noqa: BLE001
            print(f"handler failed on batch {number}: {e}")

    base = f"{shared_dir(stream.sparkSession)}/{name}"
    stream.writeStream.foreachBatch(isolated).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
