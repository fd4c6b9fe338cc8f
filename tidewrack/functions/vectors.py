"""Vector functions: norms, cosine, random hyperplanes, pooling."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zero."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


@lru_cache(maxsize=16)
def hyperplanes(num_hashes: int, dim: int, seed: int = 47) -> np.ndarray:
    """Standard normal planes (num_hashes, dim), float32, from a seeded generator."""
    if num_hashes <= 0 or dim <= 0:
        raise ValueError("num_hashes and dim must be positive")
    return np.random.default_rng(seed).standard_normal((num_hashes, dim)).astype(np.float32)


def hyperplane_bits(vector: Column, num_hashes: int, dim: int, seed: int = 47) -> Column:
    """Signature as a string of 0 and 1: 1 where the projection is not negative.

    All zero vectors get ones only; null vectors null; another length is an error.
    """
    planes = hyperplanes(num_hashes, dim, seed).astype(np.float64)

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        out = np.full(len(v), None, object)
        known = np.flatnonzero(v.notna().to_numpy())
        if len(known):
            x = [np.asarray(v.iloc[i], np.float64) for i in known]
            if any(len(y) != dim for y in x):
                raise ValueError(f"expected vectors of length {dim}")
            bits = (np.stack(x) @ planes.T >= 0).astype(np.uint8) + 48
            for i, row in zip(known, bits):
                out[i] = row.tobytes().decode()
        return pd.Series(out)

    return run(vector)


def mean_pool(rows: DataFrame, group: str, position: str, vector: str, mask: str | None = None) -> DataFrame:
    """(group, ``pooled``): mean of the unmasked vectors of each group, by dimension.

    Vectors are summed element by element in the JVM with partial aggregates, so
    a long group isn't gathered. Null vectors are left out; groups without an
    unmasked vector don't appear.
    """
    used = rows.where(F.col(vector).isNotNull())
    if mask:
        used = used.where(F.col(mask).cast("int") == 1)
    cells = used.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return cells.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("c")).select(group, F.col("c.m").alias("pooled"))


def encode(texts: DataFrame, id_col: str, text_col: str, encoder, dim: int) -> DataFrame:
    """(id, ``embedding``): hook for an encoder, a callable of a list of texts to an (n, dim) array.

    It runs on Arrow batches and is shipped once a task; null texts give null.
    """

    def run(frames):
        for f in frames:
            known = np.flatnonzero(f.t.notna().to_numpy())
            out: list = [None] * len(f)
            if len(known):
                x = np.asarray(encoder(f.t.iloc[known].tolist()), np.float32)
                if x.shape != (len(known), dim):
                    raise ValueError(f"the encoder must return {dim} values a text")
                for i, row in zip(known, x):
                    out[i] = row.tolist()
            yield pd.DataFrame({id_col: f[id_col], "embedding": pd.Series(out, index=f.index, dtype=object)})

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, F.col(text_col).alias("t")).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")
