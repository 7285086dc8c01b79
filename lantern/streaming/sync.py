"""Incremental sync as Structured Streaming: change feeds, keyed upserts per batch, streaming sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lantern.sources.store import VersionedTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def upsert_stream(stream: DataFrame, table: VersionedTable, checkpoint: str, seq: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Upsert what is new, batch by batch, then stop. The stream's checkpoint is the cursor: it moves on only after a batch is
    written, and writing a batch again changes nothing, so nothing is lost and nothing is counted twice."""

    def write(batch: DataFrame, _: int) -> None:
        table.upsert(transform(batch) if transform else batch, seq)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(events: DataFrame, key: str, ts: str, pause_minutes: int = 360, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of events: a pause of more than ``pause_minutes`` closes one; later events than ``late`` are dropped."""
    return (
        events.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, f"{pause_minutes} minutes"))
        .agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    )
