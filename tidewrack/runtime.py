"""Session helpers: test tables, the shared folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()
_staged: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidewrack-")) / "tidewrack.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the parquet tables of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session (tests) may go without the setting; it gets a temporary
    folder. A cluster without it is an error, since a machine-local folder would
    lose stages together with the executor that wrote them.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidewrack-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Deletes all tables staged by this driver; results that still read them must have been taken or saved."""
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_counted(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """Like :func:`stage`, and what the written rows add up to, without another pass."""
    seen = Observation()
    out = stage(df.observe(seen, *[F.sum(c.cast("bigint")).alias(k) for k, c in sums.items()]), label)
    got = seen.get
    return out, {k: got.get(k) or 0 for k in sums}


def drop_stage(df: DataFrame) -> None:
    """Deletes the files behind a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def default_partitions(spark: SparkSession) -> int:
    """Shuffle partitions, but no fewer than the cores at hand."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Evens out rows ahead of a heavy per-row function, if the scan gives fewer tasks than there are cores.

    Such a scan holds less than one split for each core, so the shuffle moves
    little; a larger one is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def key128(key: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a string key (null for a null key).

    The second one starts from another seed, so both collide at once only with
    probability 2**-128 for a pair of keys.
    """
    known = key.isNotNull()
    return [F.when(known, F.xxhash64(key)), F.when(known, F.xxhash64(F.lit(7), key))]
