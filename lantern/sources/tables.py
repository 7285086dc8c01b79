"""Table and file sources. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, B, I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()
PERSON = _struct(displayName=S, email=S)
TIME = _struct(date=S, dateTime=S)
METADATA = T.MapType(S, S)

CHUNK = _struct(chunk_id=S, collection=S, embedding_text=S, display_text=S, metadata=METADATA)
VECTOR = _struct(chunk_id=S, collection=S, embedding=T.ArrayType(T.FloatType()), document=S, metadata=METADATA)
MESSAGE = _struct(ROWID=L, guid=S, text=S, date=L, is_from_me=I, handle_id=L, thread_originator_guid=S)
CHAT = _struct(ROWID=L, guid=S, chat_identifier=S, display_name=S)
HANDLE = _struct(ROWID=L, id=S)
CHAT_MESSAGE = _struct(chat_id=L, message_id=L)
CHAT_HANDLE = _struct(chat_id=L, handle_id=L)
CONTACT = _struct(priority=L, handle=S, full_name=S, first_name=S, last_name=S, organization=S)
MAIL = _struct(
    thread_id=S, turn_idx=I, seq=L, id=S, snippet=S, labels=T.ArrayType(S), headers=T.ArrayType(_struct(name=S, value=S)), mime_type=S, body_data=S, parts=S
)
CHANGE = _struct(history_id=L, message_id=S, thread_id=S, kind=S)
CALENDAR = _struct(calendar_id=S, summary=S, hidden=B, calendar_order=I)
EVENT = _struct(
    id=S, calendar_id=S, calendar_name=S, summary=S, location=S, description=S, start=TIME, end=TIME, organizer=PERSON, attendees=T.ArrayType(PERSON), htmlLink=S, status=S
)
FILE = _struct(
    id=S, name=S, mimeType=S, description=S, createdTime=S, modifiedTime=S, webViewLink=S, parents=T.ArrayType(S), size=S, ownedByMe=B, trashed=B, content=T.BinaryType()
)
CELL = _struct(file_id=S, sheet=S, row_idx=I, col_idx=I, value=S)
HISTORY = _struct(role=S, text=S, timestamp=S)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array or JSON lines, with a given schema; rows that do not fit give nulls."""
    return spark.read.schema(schema).json(path, multiLine=True)


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table of a relational store, read in ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with path, modificationTime, length and content, one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Chat history entries; a history that does not exist yet is empty."""
    return json_table(spark, path, HISTORY) if exists(spark, path) else spark.createDataFrame([], HISTORY)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
