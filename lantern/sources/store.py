"""Keyed tables of files: upsert, delete, clear, append, checkpoints.

A table is a folder of versions; a version is written whole and then named in a pointer file, so readers see one version
or the next, and a version is never overwritten while it is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.vectors import embed_distinct
from lantern.sources.tables import VECTOR, exists


def last_per_key(df: DataFrame, keys: Sequence[str], seq: str | None) -> DataFrame:
    """One row per key: the last by ``seq`` (without: any). Rows of a key meet in one task only as its latest of each task."""
    if seq is None:
        return df.dropDuplicates(list(keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc()))
    return df.withColumn("__place", place).where(F.col("__place") <= 1).drop("__place")


def merged(base: DataFrame, delta: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """Base rows whose key the delta does not have, and the last delta row of each key."""
    return base.join(delta, list(keys), "left_anti").select(*base.columns).unionByName(last_per_key(delta, keys, seq).select(*base.columns))


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Base rows with the columns that a patch names replaced by its values; keys that only the patch has change nothing."""
    p = patch.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in patch.columns if c != key])
    out = base.join(p, base[key] == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    return out.select(*[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in patch.columns and c != key else F.col(c) for c in base.columns])


def deleted(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys, key, "left_anti")


class VersionedTable:
    """A keyed table under ``path`` in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)

    def _pointer(self) -> str:
        return f"{self.path}/current.json"

    def version(self) -> str | None:
        if not exists(self.spark, self._pointer()):
            return None
        return json.loads(self.spark.read.text(self._pointer(), wholetext=True).first()[0])["version"]

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{v}")

    def replace(self, df: DataFrame, partition: str | None = None) -> str:
        """Write a version and point to it."""
        v = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition) if partition else df.write
        writer.parquet(f"{self.path}/{v}")
        put_json(self.spark, self._pointer(), {"version": v})
        return v

    def upsert(self, delta: DataFrame, seq: str | None = None, partition: str | None = None) -> str:
        return self.replace(merged(self.read(), delta, self.keys, seq), partition)

    def delete(self, keys: DataFrame) -> str:
        return self.replace(self.read().join(keys, self.keys, "left_anti"))

    def clear(self, where: str | None = None) -> str:
        """Empty the table, or take out the rows of a condition."""
        return self.replace(self.read().where(f"not ({where})") if where else self.spark.createDataFrame([], self.schema))


def vector_store(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, VECTOR, ["chunk_id"])


def vector_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with the vector of their embedding text, embedded once per distinct text; the stored text is the display text, else the embedding text."""
    rows = embed_distinct(chunks, "embedding_text")
    return rows.select("chunk_id", "collection", "embedding", F.coalesce(F.nullif("display_text", F.lit("")), "embedding_text").alias("document"), "metadata")


def add_chunks(store: VersionedTable, chunks: DataFrame, seq: str | None = None) -> str:
    return store.upsert(vector_rows(chunks), seq)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small JSON file, replacing it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()


def get_json(spark: SparkSession, path: str) -> dict:
    """A small JSON file; missing or broken gives an empty one."""
    if not exists(spark, path):
        return {}
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError):
        return {}
