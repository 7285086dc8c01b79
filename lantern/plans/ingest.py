"""Ingestion plans: sources to chunks to vectors, full and incremental, with what was rejected and how much was done."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions.text import is_substantive, message_date, normalize_message
from lantern.functions.vectors import embed_distinct
from lantern.operators import calendar, files, mail
from lantern.operators.chunking import first_words, format_message, message_chunks, message_context
from lantern.operators.segment import PAUSE_MINUTES, THRESHOLD, renumber, sessions, topics
from lantern.sources.store import VersionedTable, add_chunks, get_json, put_json


#: Rejects that a report lists; its table has all.
SHOWN = 1000


@dataclass
class Report:
    """What an ingestion wrote and left out."""

    chunks: int
    rejected: list[tuple[str, str]]
    #: All rejects (name, reason), of which ``rejected`` lists the first ones for display.
    rejects: DataFrame | None = None


def message_groups(rows: DataFrame, pause_minutes: int = PAUSE_MINUTES, threshold: float = THRESHOLD) -> DataFrame:
    """Messages (conversation_id, ts, row_id, sender, text, reply_to) with ``group_index``: pauses, then topics.

    Texts are normalised and empty ones dropped first; each distinct text is embedded once.
    """
    clean = rows.withColumn("text", normalize_message(F.col("text"))).where("text <> ''")
    timed = sessions(clean, ["conversation_id"], "ts", ["row_id"], pause_minutes)
    judged = embed_distinct(timed.withColumn("judged", is_substantive(F.col("text"))), "text")
    grouped = topics(judged, ["conversation_id", "session_idx"], ["ts", "row_id"], "embedding", "judged", threshold)
    return renumber(grouped, "conversation_id", ["session_idx", "group_idx"]).drop("embedding", "judged", "session_idx", "group_idx")


def conversation_chunks(rows: DataFrame, labels: DataFrame, pause_minutes: int = PAUSE_MINUTES, threshold: float = THRESHOLD) -> DataFrame:
    """Chunks of conversations; ``labels`` has (conversation_id, conversation_label)."""
    keys = ["conversation_id", "group_index"]
    groups = message_groups(rows, pause_minutes, threshold)
    line = format_message(F.col("sender"), F.col("reply_to"), F.col("text"))
    place = F.struct("ts", "row_id")
    about = groups.groupBy(*keys).agg(F.min_by("ts", place).alias("start"), F.max_by("ts", place).alias("end"))
    # Every message has a word, so the first few hold those of the summary.
    first = groups.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "row_id"))).where(F.col("__i") <= mail.SUMMARY)
    said = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", line.alias("line")))).alias("said"))
    about = about.join(said, keys).select(
        *keys,
        message_date(F.col("start")).alias("start_date"),
        message_date(F.col("end")).alias("end_date"),
        first_words(F.array_join(F.transform("said", lambda x: x["line"]), "\n"), mail.SUMMARY).alias("summary"),
    )
    pieces = message_chunks(groups, keys, ["ts", "row_id"]).join(about, keys).join(labels, "conversation_id", "left")
    place_id = F.concat_ws("_", "group_index", "chunk_index")
    meta = {
        "thread_id": "conversation_id", "message_id": place_id, "sender": F.lit("Me and Them"), "date": "end_date", "source": F.lit("imessage"),
        "conversation_id": "conversation_id", "conversation_label": "conversation_label", "start_date": "start_date", "end_date": "end_date", "summary": "summary",
    }
    pairs = [x for k, v in meta.items() for x in (F.lit(k), F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")))]
    return pieces.select(
        F.concat_ws("_", F.lit("imessage"), "conversation_id", place_id).alias("chunk_id"),
        F.lit("imessage").alias("collection"),
        message_context(F.col("chunk"), F.col("conversation_label"), F.col("start_date"), F.col("end_date"), F.col("summary")).alias("embedding_text"),
        F.col("chunk").alias("display_text"),
        F.create_map(*pairs).alias("metadata"),
    )


def write(store: VersionedTable, chunks: DataFrame, rejected: list[tuple[str, str]] | None = None) -> Report:
    """Upsert chunks and count them on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    add_chunks(store, chunks.observe(seen, F.count("*").alias("n")))
    return Report(seen.get["n"], rejected or [])


def ingest_messages(store: VersionedTable, rows: DataFrame, labels: DataFrame, most_chats: int | None = None) -> Report:
    if most_chats is not None:
        rows = rows.join(labels.orderBy("conversation_id").limit(most_chats).select("conversation_id"), "conversation_id", "left_semi")
    return write(store, conversation_chunks(rows, labels))


def ingest_calendar(store: VersionedTable, events: DataFrame) -> Report:
    return write(store, calendar.event_chunks(events))


def ingest_files(store: VersionedTable, listed: DataFrame, limit: int | None = None, shared: bool = False) -> Report:
    """Chunks of all readable files; the others are reported with their reason."""
    read = files.sections(files.listing(listed, limit, shared))
    failed = files.rejects(read)
    report = write(store, files.chunks(read), [tuple(r) for r in failed.limit(SHOWN).collect()])
    report.rejects = failed
    return report


def ingest_mail(spark: SparkSession, store: VersionedTable, messages: DataFrame, feed: DataFrame, state_path: str, limit: int | None = None) -> Report:
    """All primary threads. The cursor is read before the scan, so mail that arrives meanwhile comes with the next sync."""
    cursor = mail.head(feed).first()[0]
    threads = mail.primary_threads(messages, limit).select("thread_id")
    report = write(store, mail.thread_chunks(mail.thread_turns(messages.join(threads, "thread_id", "left_semi"))))
    put_json(spark, state_path, {"history_id": str(cursor)})
    return report


def sync_mail(spark: SparkSession, store: VersionedTable, messages: DataFrame, feed: DataFrame, state_path: str) -> Report:
    """Primary threads that changed since the cursor; without a cursor, or if the sync fails, all of them."""
    known = get_json(spark, state_path).get("history_id")
    if known is None or not str(known).isdigit():
        return ingest_mail(spark, store, messages, feed, state_path)
    try:
        cursor = mail.head(feed).first()[0]
        threads = mail.changed_threads(feed, int(known)).join(mail.primary_threads(messages), "thread_id", "left_semi").select("thread_id")
        report = write(store, mail.thread_chunks(mail.thread_turns(messages.join(threads, "thread_id", "left_semi"))))
        put_json(spark, state_path, {"history_id": str(cursor)})
        return report
    except Exception:
        return ingest_mail(spark, store, messages, feed, state_path)


def backfill(spark: SparkSession, store: VersionedTable, tables: dict[str, DataFrame], state_path: str) -> dict[str, Report]:
    """Clear the store and ingest all four sources."""
    store.clear()
    return {
        "gmail": ingest_mail(spark, store, tables["mail"], tables["feed"], state_path),
        "imessage": ingest_messages(store, tables["messages"], tables["labels"]),
        "calendar": ingest_calendar(store, tables["events"]),
        "drive": ingest_files(store, tables["files"]),
    }


def preview(listed: DataFrame, n: int = 1) -> DataFrame:
    """Chunks of the first files, with nothing written."""
    return files.chunks(files.sections(files.listing(listed, n)))
