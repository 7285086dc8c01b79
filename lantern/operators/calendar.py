"""Calendars and events: windows, participants, display text, and event records to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.markup import calendar_text_udf
from lantern.functions.text import event_time
from lantern.operators.chunking import event_text

ZONE = "US/Eastern"


def visible(calendars: DataFrame) -> DataFrame:
    return calendars.where(~F.coalesce("hidden", F.lit(False)))


def moment(date: Column, timestamp: Column) -> Column:
    """Start or end of an event as a timestamp; days and times without offset are local (session zone UTC)."""
    zoned = F.rlike(timestamp, F.lit(r"(Z|[+-]\d\d:?\d\d)$"))
    local = F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(timestamp), F.try_to_timestamp(date)), ZONE)
    return F.when(zoned, F.try_to_timestamp(timestamp)).otherwise(local)


def expand(events: DataFrame, every_days: str = "repeat_days", times: str = "repeat_times") -> DataFrame:
    """One row per occurrence of events (start, end timestamps) that repeat every so many days; others stay one row."""
    n = F.greatest(F.coalesce(F.col(times), F.lit(1)), F.lit(1))
    rows = events.withColumn("occurrence", F.explode(F.sequence(F.lit(0), n - 1)))
    shift = F.make_dt_interval(F.col("occurrence") * F.coalesce(F.col(every_days), F.lit(0)))
    return rows.withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift)


def list_events(calendars: DataFrame, events: DataFrame, after=None, before=None, most: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """Events of the visible calendars (``calendar_order`` gives their order) by start within each, cut to ``most`` in calendar order.

    Events overlap the window: they end after ``after`` and start before ``before``.
    """
    dims = visible(calendars)
    if ids is not None:
        dims = dims.where(F.col("calendar_id").isin(ids))
    rows = events.join(F.broadcast(dims) if ids is not None and len(ids) < 1000 else dims, "calendar_id")
    if after is not None:
        rows = rows.where(F.col("end") > after)
    if before is not None:
        rows = rows.where(F.col("start") < before)
    out = rows.orderBy("calendar_order", "start", "event_id")
    return out if most is None else out.limit(most)


def day_window(events: DataFrame, day: str, zone: str = ZONE, start: str = "start", end: str = "end") -> DataFrame:
    """Events that overlap a local day, from midnight to its last second."""
    low, high = (F.to_utc_timestamp(F.lit(f"{day} {t}").cast("timestamp"), zone) for t in ("00:00:00", "23:59:59"))
    return events.where((F.col(end) > low) & (F.col(start) < high))


def participants(organizer: Column, attendees: Column) -> Column:
    """``Organizer: X`` first, then attendees; one per address in any case, the organizer's own left out."""
    who = F.coalesce(F.nullif(organizer["displayName"], F.lit("")), F.nullif(organizer["email"], F.lit("")))
    own = F.lower(F.coalesce(organizer["email"], F.lit("")))
    mail = lambda a: F.lower(F.coalesce(a["email"], F.lit("")))
    people = F.coalesce(attendees, F.array().cast("array<struct<displayName:string,email:string>>"))
    mails = F.transform(people, mail)
    first = F.filter(people, lambda a, i: (mail(a) != own) & (F.array_position(mails, mail(a)) == i + 1))
    names = F.transform(first, lambda a: F.coalesce(F.nullif(a["displayName"], F.lit("")), a["email"], F.lit("")))
    return F.concat(F.when(who.isNotNull(), F.array(F.concat(F.lit("Organizer: "), who))).otherwise(F.array().cast("array<string>")), names)


def event_chunks(events: DataFrame) -> DataFrame:
    """One chunk per event with an id; the whole event is both its display and its embedding text."""
    start, end = (event_time(F.col(f"{c}.date"), F.col(f"{c}.dateTime"), ZONE) for c in ("start", "end"))
    rows = events.where(F.coalesce("id", F.lit("")) != "").select(
        F.coalesce("calendar_id", F.lit("primary")).alias("calendar_id"),
        F.coalesce("calendar_name", "calendar_id", F.lit("primary")).alias("calendar_name"),
        F.col("calendar_name").alias("__said_name"),
        F.col("id").alias("event_id"),
        F.coalesce(F.nullif("summary", F.lit("")), F.lit("Untitled event")).alias("title"),
        start.alias("start"),
        end.alias("end"),
        calendar_text_udf("location").alias("location"),
        participants(F.col("organizer"), F.col("attendees")).alias("participants"),
        calendar_text_udf("description").alias("description"),
        F.coalesce("htmlLink", F.lit("")).alias("html_link"),
    )
    names = ["__said_name", "title", "start", "end", "location", "participants", "description"]
    text = event_text(*[F.col(c) for c in names])
    pairs = {
        "thread_id": "event_id", "message_id": F.lit("details"), "source": F.lit("calendar"), "event_id": "event_id", "calendar_id": "calendar_id",
        "calendar_name": "calendar_name", "title": "title", "start": "start", "end": "end", "location": "location",
        "participants": F.array_join("participants", ", "), "html_link": "html_link",
    }
    meta = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("")))])
    return rows.select(
        F.concat(F.lit("calendar_"), "calendar_id", F.lit("_"), "event_id", F.lit("_details")).alias("chunk_id"),
        F.lit("calendar").alias("collection"),
        text.alias("embedding_text"),
        text.alias("display_text"),
        meta.alias("metadata"),
    )


def event_body(title: Column, start: Column, end: Column, all_day: Column, description: Column) -> Column:
    """Record of an event to write. An all-day event ends on the day after its last; other ends carry the zone."""
    none = F.lit(None).cast("string")
    day = lambda c: F.left(c, F.lit(10))
    time = lambda c, d: F.struct(
        F.when(all_day, d).otherwise(none).alias("date"), F.when(~all_day, c).otherwise(none).alias("dateTime"), F.when(~all_day, F.lit(ZONE)).alias("timeZone")
    )
    after = F.date_format(F.date_add(F.try_to_date(day(end)), 1), "yyyy-MM-dd")
    return F.struct(title.alias("summary"), F.coalesce(description, F.lit("")).alias("description"), time(start, day(start)).alias("start"), time(end, after).alias("end"))


def count_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def capped(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
