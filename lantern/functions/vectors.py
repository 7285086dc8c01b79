"""Vector arithmetic on array columns, in double."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 where a vector has no length; the longer one is cut."""
    n = F.least(F.size(a), F.size(b))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)) / norm)


def squared_distance(a: Column, b: Column) -> Column:
    def gap(x: Column, y: Column) -> Column:
        return (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))

    return F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda s, x: s + x)


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean per key as ``mean``: sums per position travel, never the vectors of a group."""
    cells = df.select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = cells.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    ordered = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
    return ordered.select(*keys, F.transform("m", lambda x: x["v"]).alias("mean"))


def hashing_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of hashed word counts; a stand-in for an embedding model that needs no service."""
    v = np.zeros(dimensions)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dimensions] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashing_vector(t).astype("float32"))


def embed_distinct(df: DataFrame, text: str, out: str = "embedding", embed=embed_text) -> DataFrame:
    """Embed every distinct text once and join the vectors back."""
    once = df.select(text).distinct().withColumn(out, embed(F.col(text)))
    left, right = df.alias("l"), once.withColumnRenamed(text, "__text").alias("r")
    return left.join(right, F.col(f"l.{text}").eqNullSafe(F.col("r.__text")), "left").drop("__text")
