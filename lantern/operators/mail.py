"""Mail: search hits, bodies, threads, key scans, change feeds, drafts and thread chunks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions import markup
from lantern.functions.text import cut_quote, cut_signature, decode_base64url, encode_base64url, header_map, looks_like_html
from lantern.operators.chunking import explode_chunks, first_words, mail_chunks, mail_context
from lantern.operators.calendar import capped
from lantern.operators.messages import first_seen_keys

#: Words in the stand-in for a thread's summary.
SUMMARY = 15


def header(headers: Column, name: str, default: str | None = "") -> Column:
    found = F.try_element_at(header_map(headers), F.lit(name))
    return found if default is None else F.coalesce(found, F.lit(default))


def search(messages: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Hits (id, thread_id, subject, snippet, sender, recipient, date) whose snippet or subject contains the query, in scan order."""
    h = F.col("headers")
    rows = messages.select(
        "seq", "id", "thread_id", header(h, "Subject").alias("subject"), "snippet",
        header(h, "From").alias("sender"), header(h, "To").alias("recipient"), header(h, "Date").alias("date"),
    )
    q = F.lit(query.lower())
    hit = F.contains(F.lower(F.coalesce("subject", F.lit(""))), q) | F.contains(F.lower(F.coalesce("snippet", F.lit(""))), q)
    return rows.where(hit).orderBy("seq").limit(limit).drop("seq")


@F.pandas_udf(T.StructType([T.StructField("data", T.StringType()), T.StructField("kind", T.StringType())]))
def choose_body(parts: pd.Series) -> pd.DataFrame:
    got = [markup.body_part(json.loads(p) if p else []) for p in parts]
    return pd.DataFrame({"data": [g[0] for g in got], "kind": [g[1] for g in got]})


def bodies(messages: DataFrame) -> DataFrame:
    """Add ``content``: the readable text of a message's body, from its tree of parts (JSON) or its own body; a missing body is empty."""
    part = choose_body("parts")
    has = F.coalesce("parts", F.lit("")).rlike(r"\{")
    rows = messages.withColumn("__part", part)
    data = F.when(has, F.col("__part.data")).otherwise(F.col("body_data"))
    kind = F.when(has, F.col("__part.kind")).when(F.contains(F.coalesce("mime_type", F.lit("")), F.lit("plain")), "plain").otherwise("html")
    rows = rows.withColumn("__raw", F.when(F.coalesce(data, F.lit("")) != "", decode_base64url(data))).withColumn("__kind", kind)
    rows = rows.withColumn("__html", (F.col("__kind") == "html") | looks_like_html(F.col("__raw")))
    text = F.when(F.col("__html"), markup.html_text_udf("__raw")).otherwise(F.col("__raw"))
    return rows.withColumn("content", F.coalesce(text, F.lit(""))).drop("__part", "__raw", "__kind", "__html")


def thread_turns(messages: DataFrame) -> DataFrame:
    """One row per message (thread_id, turn_idx, sender, date, subject, content, message_id), quotes and signatures cut."""
    h = F.col("headers")
    content = markup.mail_text_udf(cut_signature(cut_quote(F.col("content"))))
    return bodies(messages).select(
        "thread_id", "turn_idx", header(h, "From", "Unknown").alias("sender"), header(h, "Date").alias("date"),
        header(h, "Subject").alias("subject"), content.alias("content"), F.col("id").alias("message_id"),
    )


def primary_threads(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Thread ids of the primary inbox in first-seen order."""
    return first_seen_keys(messages.where(F.array_contains("labels", "CATEGORY_PERSONAL")), "thread_id", "seq", limit)


def changed_threads(feed: DataFrame, since: int) -> DataFrame:
    """Threads with a message added after the checkpoint, in order, and the new checkpoint beside each."""
    new = feed.where((F.col("history_id") > since) & (F.col("kind") == "messageAdded") & F.col("thread_id").isNotNull())
    head = feed.agg(F.max("history_id").alias("checkpoint"))
    return first_seen_keys(new, "thread_id", "history_id").crossJoin(F.broadcast(head))


def head(feed: DataFrame, column: str = "history_id") -> DataFrame:
    return feed.agg(F.max(column).alias("checkpoint"))


def promotional(headers: Column) -> Column:
    return F.map_contains_key(header_map(headers), F.lit("List-Unsubscribe"))


def draft(to: Column, subject: Column, body: Column) -> Column:
    """A plain-text mail in RFC 822 form, base64url."""
    head = F.concat(F.lit('Content-Type: text/plain; charset="utf-8"\nMIME-Version: 1.0\nContent-Transfer-Encoding: 8bit\nTo: '), to)
    return encode_base64url(F.concat(head, F.lit("\nSubject: "), subject, F.lit("\n\n"), body))


def unique_chunks(chunks: DataFrame, thread: str, order: list[str], chunk: str = "chunk") -> DataFrame:
    """Chunks of a thread without those said before in it; indices keep their gaps. The text itself is the key, by its digest."""
    place = F.row_number().over(Window.partitionBy(thread, F.sha2(chunk, 256)).orderBy(*order))
    return chunks.withColumn("__place", place).where("__place = 1").drop("__place")


def thread_chunks(turns: DataFrame) -> DataFrame:
    """Chunks of threads from their turns, each with the thread's summary in its embedding text."""
    # Every turn has a word, so the first few turns hold the words of the summary, however long a thread is.
    begin = capped(turns.select("thread_id", "turn_idx", first_words(F.concat("sender", F.lit(": "), "content"), SUMMARY).alias("t")), "thread_id", ["turn_idx"], SUMMARY)
    said = F.array_sort(F.collect_list(F.struct("turn_idx", "t")))
    whole = begin.groupBy("thread_id").agg(said.alias("__all"))
    whole = whole.select("thread_id", first_words(F.array_join(F.transform("__all", lambda x: x["t"]), "\n\n"), SUMMARY).alias("summary"))
    pieces = explode_chunks(turns.where(F.trim("content") != ""), "content", mail_chunks)
    pieces = unique_chunks(pieces, "thread_id", ["turn_idx", "chunk_index"]).join(whole, "thread_id")
    meta = {"thread_id": "thread_id", "message_id": "message_id", "subject": "subject", "sender": "sender", "date": "date"}
    return pieces.select(
        F.concat_ws("_", F.lit("gmail"), "thread_id", "message_id", "chunk_index").alias("chunk_id"),
        F.lit("gmail").alias("collection"),
        mail_context(F.col("chunk"), F.col("summary"), F.col("sender"), F.col("date"), F.col("subject")).alias("embedding_text"),
        F.col("chunk").alias("display_text"),
        F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), F.coalesce(F.col(v), F.lit("")))], F.lit("source"), F.lit("gmail")).alias("metadata"),
    )
