"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the input folder, with only the named columns; Spark opens the path, so it may be in any store."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder, which ``spark.checkpoint.dir`` names.

    Where it is unset, the session must have been given a folder (``SparkContext.setCheckpointDir``), as tests do. Only on a
    local master is one made here, as driver and executors are one process then.
    """
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lantern-checkpoint-"))
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch that is sent to a worker. Spark's own limit is 10,000 rows, whatever their length: 40 MB of documents, and buffers that double up to twice that beside the heap.
BATCH_BYTES = "4m"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH_BYTES`` or one row; a limit that the session has stays.

    The limit is the session's from then on, as Spark reads it when the plan runs. A worker that is kept for later tasks gives back
    what Arrow holds and doesn't use.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit, None) is None:
        df.sparkSession.conf.set(limit, BATCH_BYTES)

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(freed, schema)


def release(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more, and let the driver drop shuffles that nothing refers to.

    Whatever was made from the frames must be checkpointed itself by then.
    """
    for df in frames:
        context = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, *order) -> tuple[DataFrame, int]:
    """Give every row its 0-based place ``rank`` in the total order, and return the number of rows too.

    One range shuffle sorts the rows; no task ever holds more than its range. Rows keep their place in the
    checkpoint, so the place is the start of the range plus the row's number within it. Only one count per
    partition comes to the driver.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    if not counts:
        return placed.withColumn("rank", F.col("__at")).drop("__at"), 0
    starts, total = [0] * (counts[-1][0] + 1), 0
    for p, n in counts:
        starts[p] = total
        total += n
    offsets = F.array(*[F.lit(x).cast("long") for x in starts])
    at_row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("rank", F.element_at(offsets, (part + 1).cast("int")) + at_row).drop("__at"), total


def interval(value: Column, cuts: list, tie: Column | None = None, ties: list | None = None) -> Column:
    """Number of sorted cuts that are at most ``value`` (null: 0), by halving; the expression stays small for many cuts.

    With ``ties``, cuts are pairs with one of them each, and so are the values with ``tie``.
    """
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c) for c in cuts])
    halves = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    if ties:
        second = F.array(*[F.lit(c) for c in ties])

    def climb(at: Column, step: Column) -> Column:
        up = at + step
        cut = F.try_element_at(table, up)
        reached = (cut < value) | ((cut == value) & (F.try_element_at(second, up) <= tie)) if ties else cut <= value
        return F.when((up <= len(cuts)) & reached, up).otherwise(at)

    return F.coalesce(F.aggregate(halves, F.lit(0), climb), F.lit(0))
