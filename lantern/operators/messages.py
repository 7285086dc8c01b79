"""Relational lookups over a message store: message, chat, handle and the two link tables, and contact books."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import apple_timestamp, chat_label, contact_keys, contact_name, message_date, not_blank, shorten

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like_ascii(c: Column, query: str) -> Column:
    """``LIKE %query%`` with letters A-Z alike in either case and no other letters; % and _ are wildcards, as typed."""
    pattern = "%" + query.translate(str.maketrans(_UPPER, _LOWER)) + "%"
    return F.like(F.translate(c, _UPPER, _LOWER), F.lit(pattern.replace("\\", "\\\\")))


def newest(df: DataFrame, ts: str, tie: str, limit: int | None = None) -> DataFrame:
    """Rows from the newest on, ties by ``tie``; with a limit, each task hands on its own newest rows only."""
    out = df.orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return out if limit is None else out.limit(limit)


def keyword_search(messages: DataFrame, query: str, limit: int = 10, text: str = "text", ts: str = "date", tie: str = "ROWID") -> DataFrame:
    return newest(messages.where(F.col(text).isNotNull() & like_ascii(F.col(text), query)), ts, tie, limit)


find_messages = keyword_search


def chat_messages(message: DataFrame, chat_message: DataFrame, handle: DataFrame, chat_id: int, limit: int | None = None) -> DataFrame:
    """Messages of a chat that are not blank, newest first, with the sender's handle where there is one."""
    link = chat_message.where(F.col("chat_id") == chat_id)
    senders = handle.select(F.col("ROWID").alias("handle_id"), F.col("id").alias("handle"))
    return newest(message.join(link, message["ROWID"] == link["message_id"]).where(not_blank(F.col("text"))).join(senders, "handle_id", "left"), "date", "ROWID", limit)


def chats(chat: DataFrame, chat_handle: DataFrame, handle: DataFrame, chat_message: DataFrame, message: DataFrame) -> DataFrame:
    """One row per chat that has a message that is not blank, with its participants in order; empty handles are dropped, repeated ones kept."""
    said = chat_message.join(message.where(not_blank(F.col("text"))), F.col("message_id") == message["ROWID"]).select("chat_id")
    live = chat.join(said, chat["ROWID"] == said["chat_id"], "left_semi").withColumnRenamed("ROWID", "chat_row")
    members = chat_handle.join(handle, chat_handle["handle_id"] == handle["ROWID"], "left").select("chat_id", F.col("id").alias("handle"))
    people = members.where(F.coalesce("handle", F.lit("")) != "").groupBy("chat_id").agg(F.array_sort(F.collect_list("handle")).alias("participants"))
    none = F.array().cast("array<string>")
    out = live.join(people, live["chat_row"] == people["chat_id"], "left").drop("chat_id").withColumn("participants", F.coalesce("participants", none))
    if {"display_name", "chat_identifier"} <= set(out.columns):
        out = out.withColumn("label", chat_label(F.col("display_name"), F.col("participants"), F.col("chat_identifier"), F.col("chat_row")))
    return out


def labelled(chats: DataFrame, part: str) -> DataFrame:
    """Chats whose label contains a text, whatever the case."""
    return chats.where(F.contains(F.lower("label"), F.lower(F.lit(part))))


def chat_kind(participants: Column) -> Column:
    """``group`` for several participants, else ``individual``."""
    return F.when(F.size(participants) > 1, "group").otherwise("individual")


def single_member(links: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Chats with exactly one member row."""
    return links.groupBy(chat).count().where("count = 1").select(chat)


def conversation(message: DataFrame, chat_message: DataFrame, chat_handle: DataFrame, handle: DataFrame, address: str, limit: int = 20) -> DataFrame:
    """Newest messages of the one-to-one chats with an address; chats of all its handle rows merge, repeated rows stay."""
    ours = chat_handle.join(handle.where(F.col("id") == address), chat_handle["handle_id"] == handle["ROWID"]).select("chat_id")
    link = chat_message.join(ours, "chat_id").join(single_member(chat_handle), "chat_id", "left_semi")
    rows = link.join(message.where(F.col("text").isNotNull()), F.col("message_id") == message["ROWID"])
    top = with_replies(newest(rows, "date", "ROWID", limit))
    return top.select(
        "text",
        message_date(apple_timestamp(F.col("date"))).alias("date"),
        F.when(F.col("is_from_me") != 0, "Me").otherwise("Them").alias("sender"),
        "reply_to",
        F.col("date").alias("sort_ns"),
        F.col("ROWID").alias("row_id"),
    )


def with_replies(limited: DataFrame, guid: str = "guid", parent: str = "thread_originator_guid", text: str = "text", order: tuple[str, ...] = ("date", "ROWID")) -> DataFrame:
    """Add ``reply_to``: the start of the message replied to, looked up among these rows alone; of rows with one guid the oldest counts."""
    parents = limited.where((F.coalesce(guid, F.lit("")) != "") & (F.coalesce(text, F.lit("")) != ""))
    one = parents.groupBy(F.col(guid).alias("__guid")).agg(F.min_by(text, F.struct(*order)).alias("__said"))
    out = limited.join(one, limited[parent] == F.col("__guid"), "left")
    return out.withColumn("reply_to", F.when(F.col("__said").isNotNull(), shorten(F.col("__said")))).drop("__guid", "__said")


# Contacts


def contact_entries(sources: Sequence[tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """Entries of several contact stores (phone, email, record) in order of priority; owners without a record give none.

    phone has (ZOWNER, ZFULLNUMBER), email (ZOWNER, ZADDRESS), record (Z_PK, ZNAME, ZFIRSTNAME, ZLASTNAME, ZORGANIZATION). A store whose tables lack
    a column cannot be read and is passed over.
    """
    found = []
    for i, (phone, email, record) in enumerate(sources):
        try:
            names = record.select(F.col("Z_PK").alias("owner"), *[F.col(c).alias(n) for c, n in _NAMES.items()])
            for kind, rows, column in ((0, phone, "ZFULLNUMBER"), (1, email, "ZADDRESS")):
                rows = rows.select(F.col("ZOWNER").alias("owner"), F.col(column).alias("handle"))
                found.append(rows.join(names, "owner").select(F.struct(F.lit(i).alias("source"), F.lit(kind).alias("kind"), "owner", "handle").alias("priority"), "handle", *_NAMES.values()))
        except AnalysisException:
            continue
    if not found:
        raise ValueError("no contact store can be read")
    return reduce(DataFrame.unionByName, found)


_NAMES = {"ZNAME": "full_name", "ZFIRSTNAME": "first_name", "ZLASTNAME": "last_name", "ZORGANIZATION": "organization"}


def contacts(entries: DataFrame) -> DataFrame:
    """(key, name) from rows (priority, handle, full_name, first_name, last_name, organization): the first name for each key.

    ``priority`` is any orderable value: source, then phones before addresses, then row.
    """
    name = contact_name(F.col("full_name"), F.col("first_name"), F.col("last_name"), F.col("organization"))
    keys = entries.withColumn("name", name).where(F.coalesce("name", F.lit("")) != "")
    keys = keys.select("priority", "name", F.posexplode(contact_keys(F.col("handle"))).alias("pos", "key"))
    return keys.groupBy("key").agg(F.min_by("name", F.struct("priority", "pos")).alias("name"))


def name_handles(df: DataFrame, book: DataFrame, row_key: list[str], handle: str, out: str = "sender") -> DataFrame:
    """``name (handle)`` by the handle's first key that the book has, else the handle, else ``Unknown sender``."""
    keys = df.select(*row_key, F.posexplode(contact_keys(F.col(handle))).alias("__pos", "key"))
    found = keys.join(book, "key").groupBy(*row_key).agg(F.min_by("name", "__pos").alias("__name"))
    named = F.when(F.col("__name").isNotNull(), F.concat("__name", F.lit(" ("), F.col(handle), F.lit(")")))
    return df.join(found, row_key, "left").withColumn(out, F.coalesce(named, F.nullif(F.col(handle), F.lit("")), F.lit("Unknown sender"))).drop("__name")


# First-seen operators


def first_seen_keys(df: DataFrame, key: str, seq: str, limit: int | None = None) -> DataFrame:
    """Distinct keys in the order they first appear."""
    out = df.groupBy(key).agg(F.min(seq).alias("first_seq")).orderBy("first_seq", key)
    return out if limit is None else out.limit(limit)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, whole."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def roles(history: DataFrame, keep: tuple[str, ...] = ("user", "model")) -> DataFrame:
    return history.where(F.col("role").isin(*keep))
