"""Tool registry: named calls with checked arguments that give DataFrames, errors as an envelope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.text import normalize_message
from lantern.operators import calendar, files, mail, messages
from lantern.operators.calendar import event_body
from lantern.sources.store import deleted, merged, patched


@dataclass
class Tool:
    name: str
    run: Callable[..., DataFrame]
    #: Argument name to type; the required ones come first.
    arguments: dict[str, type]
    required: list[str] = field(default_factory=list)

    def check(self, args: dict) -> None:
        missing = [a for a in self.required if a not in args]
        unknown = [a for a in args if a not in self.arguments]
        wrong = [a for a, v in args.items() if a in self.arguments and not isinstance(v, self.arguments[a])]
        if missing or unknown or wrong:
            raise TypeError(f"{self.name}: missing {missing}, unknown {unknown}, of wrong type {wrong}")


class Tools:
    """Eleven calls over the tables of a workspace (name to DataFrame): events, mail, message store and files."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables
        event = {"title": str, "start_datetime": str, "end_datetime": str, "all_day": bool}
        known = [
            Tool("get_events", self._get_events, {"date_str": str}, ["date_str"]),
            Tool("create_event", self._create_event, event | {"description": str}, list(event)),
            Tool("edit_event", self._edit_event, event | {"event_id": str, "description": str}, [*event, "event_id"]),
            Tool("delete_event", self._delete_event, {"event_id": str}, ["event_id"]),
            Tool("search_emails", self._search_emails, {"query": str, "max_results": int}, ["query"]),
            Tool("get_email_content", self._email_content, {"message_id": str}, ["message_id"]),
            Tool("draft_email", self._draft, {"to": str, "subject": str, "body": str}, ["to", "subject", "body"]),
            Tool("search_messages", self._search_messages, {"query": str, "limit": int}, ["query"]),
            Tool("get_conversation", self._conversation, {"phone_number": str, "limit": int}, ["phone_number"]),
            Tool("search_drive", self._search_drive, {"query": str, "max_results": int}, ["query"]),
            Tool("get_file_content", self._file_content, {"file_id": str}, ["file_id"]),
        ]
        self.known = {t.name: t for t in known}

    def call(self, name: str, **args) -> DataFrame:
        """The tool's rows; an unknown tool or a failure gives one row (error, tool)."""
        try:
            tool = self.known[name]
            tool.check(args)
            return tool.run(**args)
        except Exception as e:
            said = f"unknown tool {name}" if name not in self.known else str(e)
            return self.spark.createDataFrame([(said, name)], "error string, tool string")

    def run(self, calls: list[tuple[str, dict]]) -> list[DataFrame]:
        """One round of an agent's loop: all calls that a model asked for, in order."""
        return [self.call(name, **args) for name, args in calls]

    def _get_events(self, date_str: str) -> DataFrame:
        e = self.tables["events"]
        start, end = (calendar.moment(F.col(f"{c}.date"), F.col(f"{c}.dateTime")) for c in ("start", "end"))
        rows = e.withColumn("__s", start).withColumn("__e", end)
        return calendar.day_window(rows, date_str, start="__s", end="__e").orderBy("__s", "id").drop("__s", "__e")

    def _body(self, event_id: str, title: str, start: str, end: str, all_day: bool, description: str) -> DataFrame:
        body = event_body(F.lit(title), F.lit(start), F.lit(end), F.lit(all_day), F.lit(description))
        return self.spark.range(1).select(F.lit(event_id).alias("id"), body.alias("b")).select("id", "b.summary", "b.description", "b.start", "b.end")

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """Rows in the form of the events table; what they do not say is null."""
        schema = self.tables["events"].schema
        time = lambda c: F.struct(F.col(f"{c}.date").alias("date"), F.col(f"{c}.dateTime").alias("dateTime")).alias(c)
        have = {"id": F.col("id"), "summary": F.col("summary"), "description": F.col("description"), "start": time("start"), "end": time("end")}
        return rows.select(*[have.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])

    def _create_event(self, title: str, start_datetime: str, end_datetime: str, all_day: bool, description: str = "") -> DataFrame:
        n = F.sha2(F.concat_ws("|", F.lit(title), F.lit(start_datetime), F.lit(end_datetime)), 256)
        new = self._shaped(self._body("", title, start_datetime, end_datetime, all_day, description).withColumn("id", F.left(n, F.lit(26))))
        self.tables["events"] = merged(self.tables["events"], new, ["id"])
        return new.select("id", F.lit("created").alias("status"))

    def _edit_event(self, event_id: str, title: str, start_datetime: str, end_datetime: str, all_day: bool, description: str = "") -> DataFrame:
        new = self._shaped(self._body(event_id, title, start_datetime, end_datetime, all_day, description))
        self.tables["events"] = patched(self.tables["events"], new.select("id", "summary", "description", "start", "end"), "id")
        return new.select("id", F.lit("updated").alias("status"))

    def _delete_event(self, event_id: str) -> DataFrame:
        gone = self.spark.range(1).select(F.lit(event_id).alias("id"))
        self.tables["events"] = deleted(self.tables["events"], gone, "id")
        return gone.select("id", F.lit("deleted").alias("status"))

    def _search_emails(self, query: str, max_results: int = 5) -> DataFrame:
        return mail.search(self.tables["mail"], query, max_results)

    def _email_content(self, message_id: str) -> DataFrame:
        return mail.bodies(self.tables["mail"].where(F.col("id") == message_id)).select("id", "content")

    def _draft(self, to: str, subject: str, body: str) -> DataFrame:
        return self.spark.range(1).select(mail.draft(F.lit(to), F.lit(subject), F.lit(body)).alias("raw"), F.lit("drafted").alias("status"))

    def _search_messages(self, query: str, limit: int = 10) -> DataFrame:
        return messages.keyword_search(self.tables["message"], query, limit)

    def _conversation(self, phone_number: str, limit: int = 20) -> DataFrame:
        t = self.tables
        return messages.conversation(t["message"], t["chat_message"], t["chat_handle"], t["handle"], phone_number, limit)

    def _search_drive(self, query: str, max_results: int = 5) -> DataFrame:
        read = files.sections(self.tables["files"])
        text = F.concat_ws("\n", F.col("name"), F.array_join(F.transform("sections", lambda s: s["text"]), "\n"))
        return files.search(read.withColumn("text", text), query, max_results)

    def _file_content(self, file_id: str) -> DataFrame:
        read = files.sections(self.tables["files"].where(F.col("id") == file_id))
        text = F.when(F.col("error").isNull(), F.array_join(F.transform("sections", lambda s: s["text"]), "\n"))
        return read.select("id", files.text_or_notice(text).alias("text"))


def replay(history: DataFrame) -> DataFrame:
    """Turns of a chat history that a model reads, in order of ``idx``, text normalised."""
    return messages.roles(history).orderBy("idx").select("idx", "role", normalize_message(F.col("text")).alias("text"))
