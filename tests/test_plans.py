"""Message store, calendar, mail and file operators, stores, sync, tools and ingestion, end to end on invented rows."""

import base64
import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
from pyspark.sql import functions as F

from lantern import queries
from lantern.operators import calendar, files, mail, messages, retrieval
from lantern.plans import ingest, tools
from lantern.sources import store, tables
from lantern.streaming import sync


def b64(s):
    return base64.urlsafe_b64encode(s.encode()).decode()


def message_store(spark):
    msg = [
        (1, "g1", "first", 10, 0, 1, None), (2, "g2", "re", 20, 1, None, "g1"), (3, "g3", " ", 30, 0, 1, None), (4, "g4", None, 40, 0, 1, None),
        (5, "g5", "group", 50, 0, 2, None), (6, "g6", "Ünder 50%_x", 60, 0, 3, "g0"), (7, "g7", "\t", 60, 0, 3, None),
    ]
    t = {
        "message": spark.createDataFrame(msg, tables.MESSAGE),
        "chat": spark.createDataFrame([(1, "c1", "+15550001111", None), (2, "c2", "grp", "Group"), (3, "c3", "x", ""), (4, "c4", "void", None)], tables.CHAT),
        "handle": spark.createDataFrame([(1, "+15550001111"), (2, "b@x.example"), (3, "+15550001111")], tables.HANDLE),
        "chat_message": spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (3, 6), (3, 7)], tables.CHAT_MESSAGE),
        "chat_handle": spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 3)], tables.CHAT_HANDLE),
    }
    return t


def event(i, start, end, **more):
    base = dict(id=i, calendar_id="c", calendar_name="Cal", summary="s", location=None, description=None, start=start, end=end, organizer=None, attendees=None, htmlLink=None, status=None)
    return base | more


def workspace(spark):
    t = message_store(spark)
    timed = lambda a, b: (dict(date=None, dateTime=a), dict(date=None, dateTime=b))
    day = (dict(date="2024-03-05", dateTime=None), dict(date="2024-03-06", dateTime=None))
    people = [dict(displayName="", email="O@x.example"), dict(displayName="Al", email="al@x.example"), dict(displayName="AL", email="AL@x.example"), dict(displayName=None, email="b@x.example")]
    events = [
        event("e1", *timed("2024-03-05T09:00:00-05:00", "2024-03-05T10:00:00-05:00"), organizer=dict(displayName="Org", email="o@x.example"), attendees=people, description="<p>talk</p>"),
        event("e2", *day), event("e3", *timed("2024-03-04T23:30:00", "2024-03-05T00:30:00")), event(None, *day), event("e4", *timed("2024-03-06T10:00:00Z", "2024-03-06T11:00:00Z")),
    ]
    t["events"] = spark.createDataFrame(events, tables.EVENT)
    plain = json.dumps([{"mimeType": "text/html", "body": {"data": b64("<b>x</b>")}}, {"mimeType": "text/plain", "body": {"data": b64("Body one.\n-- \nsig")}}])
    head = lambda s: [("From", "a@x.example"), ("Subject", s), ("Date", "d"), ("Subject", s + "!")]
    mails = [
        ("t1", 0, 1, "m1", "snip", ["CATEGORY_PERSONAL"], head("Hello"), "multipart/alternative", None, plain),
        ("t1", 1, 2, "m2", "snip", ["CATEGORY_PERSONAL"], head("Re"), "text/plain", b64("Body one.\nOn day X wrote: Body"), None),
        ("t2", 0, 3, "m3", "other", [], [], "text/html", b64("<p>Page <a href='https://zoom.us/j/1'>here</a></p>"), None),
        ("t3", 0, 4, "m4", "none", ["CATEGORY_PERSONAL"], head("Void"), "text/plain", None, None),
    ]
    t["mail"] = spark.createDataFrame(mails, tables.MAIL)
    t["feed"] = spark.createDataFrame([(5, "m1", "t1", "messageAdded"), (6, "m3", "t2", "messageAdded"), (7, "m4", "t3", "labelAdded")], tables.CHANGE)
    slides = {"slides": [{"objectId": "p1", "pageElements": [{"shape": {"text": {"textElements": [{"textRun": {"content": "slide words"}}]}}}]}]}
    row = lambda i, mime, content, **k: (i, f"file {i}", mime, k.get("d"), "c", "m", "l", ["p"], k.get("size", "1"), k.get("own", True), k.get("trash"), content)
    t["files"] = spark.createDataFrame(
        [
            row("f1", "text/plain", b"some text here"), row("f2", files.PRESENTATION, json.dumps(slides).encode()), row("f3", "image/png", b"x"), row("f4", "text/plain", b"big", size=str(21 << 20)),
            row("f5", files.FOLDER, None), row("f6", "text/plain", b"not mine", own=None), row("f7", "text/plain", b"bin", trash=True), row("f8", tables.S.simpleString(), b"", size=""),
        ],
        tables.FILE,
    )
    return t


def test_message_lookups(spark):
    t = message_store(spark)
    found = messages.keyword_search(t["message"], "5%_X").collect()
    assert [r.ROWID for r in found] == [6] and messages.keyword_search(t["message"], "ünder").count() == 0
    assert [r.ROWID for r in messages.chat_messages(t["message"], t["chat_message"], t["handle"], 1).collect()] == [2, 1]
    assert [(r.ROWID, r.handle) for r in messages.chat_messages(t["message"], t["chat_message"], t["handle"], 3, 1).collect()] == [(7, "+15550001111")]
    got = {r.chat_row: r.participants for r in messages.chats(t["chat"], t["chat_handle"], t["handle"], t["chat_message"], t["message"]).collect()}
    assert got == {1: ["+15550001111"], 2: ["+15550001111", "b@x.example"], 3: ["+15550001111"]}
    talk = messages.conversation(t["message"], t["chat_message"], t["chat_handle"], t["handle"], "+15550001111").orderBy(F.desc("sort_ns"), F.desc("row_id")).collect()
    assert [(r.text, r.sender, r.reply_to) for r in talk] == [("\t", "Them", None), ("Ünder 50%_x", "Them", None), (" ", "Them", None), ("re", "Me", "first..."), ("first", "Them", None)]
    short = messages.conversation(t["message"], t["chat_message"], t["chat_handle"], t["handle"], "+15550001111", 4)
    assert all(r.reply_to is None for r in short.collect())


def test_contacts(spark):
    rows = [(1, "+1 555 000 1111", "Ann", None, None, None), (2, "5550001111", "Bob", None, None, None), (3, "x@y.example", "", "", "", ""), (4, "x@y.example", None, "C", "D", None)]
    book = messages.contacts(spark.createDataFrame(rows, tables.CONTACT))
    assert {r.key: r.name for r in book.collect()} == {"phone:15550001111": "Ann", "phone:5550001111": "Ann", "email:x@y.example": "C D"}
    df = spark.createDataFrame([(1, "(555) 000-1111"), (2, "X@Y.example"), (3, None), (4, "99")], "i int, h string")
    assert [r.sender for r in messages.name_handles(df, book, ["i"], "h").orderBy("i").collect()] == ["Ann ((555) 000-1111)", "C D (X@Y.example)", "Unknown sender", "99"]


def test_calendar(spark):
    t = workspace(spark)
    chunks = {r.chunk_id: r for r in calendar.event_chunks(t["events"]).collect()}
    assert set(chunks) == {f"calendar_c_e{i}_details" for i in (1, 2, 3, 4)}
    text = chunks["calendar_c_e1_details"].display_text
    assert "Participants: Organizer: Org, Al, b@x.example" in text and "Start: Tuesday, March 05, 2024 at 09:00 AM ET" in text and text.endswith("Description: talk")
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("b", 1, 1)], "calendar_id string, event_id int, h int")
    rows = rows.withColumn("start", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.col("h"), F.lit(0), F.lit(0))).withColumn("end", F.col("start"))
    cals = spark.createDataFrame([("b", "B", False, 0), ("a", "A", None, 1), ("z", "Z", True, 2)], tables.CALENDAR)
    assert [(r.calendar_id, r.event_id) for r in calendar.list_events(cals, rows, most=2).collect()] == [("b", 1), ("a", 1)]
    assert [r.calendar_id for r in calendar.list_events(cals, rows, ids=["b"]).collect()] == ["b"]
    again = calendar.expand(rows.withColumn("repeat_days", F.lit(7)).withColumn("repeat_times", F.lit(3)))
    assert again.count() == 9 and str(again.agg(F.max("start")).first()[0]).startswith("2024-01-15")


def test_mail(spark):
    t = workspace(spark)
    turns = {r.message_id: r for r in mail.thread_turns(t["mail"]).collect()}
    assert turns["m1"].content == "Body one." and turns["m1"].subject == "Hello!" and turns["m2"].content == "Body one." and turns["m4"].content == ""
    assert turns["m3"].content == "Page\nzoom.us/j/1" and turns["m3"].sender == "Unknown"
    chunks = mail.thread_chunks(mail.thread_turns(t["mail"])).collect()
    assert sorted(r.chunk_id for r in chunks) == ["gmail_t1_m1_0", "gmail_t2_m3_0"]
    assert [r.thread_id for r in mail.primary_threads(t["mail"]).collect()] == ["t1", "t3"]
    assert [(r.thread_id, r.checkpoint) for r in mail.changed_threads(t["feed"], 5).collect()] == [("t2", 7)]
    assert [r.id for r in mail.search(t["mail"], "HELLO").collect()] == ["m1"]


def test_files(spark):
    t = workspace(spark)
    read = files.sections(files.listing(t["files"]))
    assert {r.name: r.reason for r in files.rejects(read).collect()}.keys() == {"file f3", "file f4", "file f8"}
    got = {r.chunk_id: r.display_text for r in files.chunks(read).collect()}
    assert got["drive_f1_document_0"] == "File: file f1\nType: text/plain\nLast modified: m\n\nsome text here" and "drive_f2_slides_p1_p1_0" in got and len(got) == 2
    assert {r.id for r in files.listing(t["files"], shared=True).collect()} == {"f1", "f2", "f3", "f4", "f6", "f8"}


def test_store_and_stream(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"), tables.HANDLE, ["ROWID"])
    assert table.read().count() == 0
    for part in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        table.upsert(spark.createDataFrame(part, tables.HANDLE))
    before = {(r.ROWID, r.id) for r in table.read().collect()}
    table.upsert(spark.createDataFrame([(2, "c"), (3, "d")], tables.HANDLE))
    assert before == {(r.ROWID, r.id) for r in table.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    table.delete(spark.createDataFrame([(1,)], "ROWID long"))
    assert table.read().count() == 2
    table.clear("ROWID = 2")
    assert [r.id for r in table.read().collect()] == ["d"]
    table.clear()
    assert table.read().count() == 0
    source, cursor = str(tmp_path / "in"), str(tmp_path / "cursor")
    for batch in ([(1, "x")], [(1, "y"), (2, "z")]):
        spark.createDataFrame(batch, tables.HANDLE).coalesce(1).write.mode("append").parquet(source)
        sync.upsert_stream(sync.file_stream(spark, source, tables.HANDLE), table, cursor).awaitTermination()
    assert {(r.ROWID, r.id) for r in table.read().collect()} == {(1, "y"), (2, "z")}
    assert store.get_json(spark, str(tmp_path / "none")) == {}
    store.append(spark.createDataFrame([("user", "hi", "t")], tables.HISTORY), str(tmp_path / "h"))
    assert tables.history(spark, str(tmp_path / "h")).count() == 1 and tables.history(spark, str(tmp_path / "h2")).count() == 0


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = [(1, 0), (1, 300), (1, 1000), (2, 5)]
    df = spark.createDataFrame(rows, "k int, m int").select("k", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    df.write.parquet(str(tmp_path / "e"))
    out = sync.session_stream(sync.file_stream(spark, str(tmp_path / "e"), df.schema), "k", "ts")
    q = out.writeStream.format("memory").queryName("sessions_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("sessions_out").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_tools(spark):
    box = tools.Tools(spark, workspace(spark))
    assert len(box.known) == 11
    assert {r.id for r in box.call("get_events", date_str="2024-03-05").collect()} == {"e1", "e2", "e3", None}
    assert box.call("nope").first().tool == "nope" and "missing" in box.call("delete_event").first().error
    new = box.call("create_event", title="T", start_datetime="2024-03-05T12:00:00", end_datetime="2024-03-05T13:00:00", all_day=False).first()
    assert new.status == "created" and new.id in {r.id for r in box.call("get_events", date_str="2024-03-05").collect()}
    box.call("edit_event", event_id=new.id, title="U", start_datetime="2024-03-09", end_datetime="2024-03-09", all_day=True)
    row = box.tables["events"].where(F.col("id") == new.id).first()
    assert row.summary == "U" and row.start.date == "2024-03-09" and row.end.date == "2024-03-10"
    box.call("delete_event", event_id=new.id)
    assert box.tables["events"].where(F.col("id") == new.id).count() == 0
    assert box.call("search_drive", query="slide w").first().mimeType == "Google Slides"
    assert box.call("get_file_content", file_id="f3").first().text == files.UNREADABLE
    assert box.call("get_email_content", message_id="m1").first().content.startswith("Body one.")
    raw = box.call("draft_email", to="a@b.example", subject="S", body="ü").first().raw
    assert base64.urlsafe_b64decode(raw).decode().endswith("To: a@b.example\nSubject: S\n\nü")
    assert box.call("search_messages", query="first").count() == 1 and box.call("get_conversation", phone_number="+15550001111").count() == 5
    assert [df.count() for df in box.run([("search_emails", {"query": "hello"})])] == [1]


def test_backfill_and_search(spark, tmp_path):
    t = workspace(spark)
    talk = [(1, i, "Me" if i % 2 else "Them", f"we talk about the garden and the green trees {i}", None, i) for i in range(6)]
    talk += [(1, 10, "Me", "later on another matter entirely of boats", None, 1000)]
    rows = spark.createDataFrame(talk, "conversation_id long, row_id long, sender string, text string, reply_to string, m int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).drop("m")
    t |= {"messages": rows, "labels": spark.createDataFrame([(1, "Ann")], "conversation_id long, conversation_label string")}
    kept = store.vector_store(spark, str(tmp_path / "v"))
    report = ingest.backfill(spark, kept, t, str(tmp_path / "state.json"))
    assert {k: r.chunks for k, r in report.items()} == {"gmail": 1, "imessage": 2, "calendar": 4, "drive": 2} and len(report["drive"].rejected) == report["drive"].rejects.count() == 3
    assert store.get_json(spark, str(tmp_path / "state.json")) == {"history_id": "7"} and kept.read().count() == 9
    hit = retrieval.search(spark, kept.read(), "garden and green trees", "imessage", 1).first()
    assert hit.chunk_id == "imessage_1_0_0" and hit.document.startswith("Them: we talk")
    store.put_json(spark, str(tmp_path / "state.json"), {"history_id": "4"})
    assert ingest.sync_mail(spark, kept, t["mail"], t["feed"], str(tmp_path / "state.json")).chunks == 1 and kept.read().count() == 9
    assert ingest.preview(t["files"]).count() == 1


DATA = "/root/testdata/sf0.001"


def test_slides_of_all_documents_are_packed(spark):
    want, state = {}, {}
    docs = tables.table(spark, DATA, "documents").orderBy("source", "doc_id").collect()
    for r in docs:
        n = len(r.text.split())
        bin_, total, open_ = state.get(r.source, (-1, 0, False))
        bin_, total = (bin_, total + n) if open_ and n <= 500 and total + n <= 500 else (bin_ + 1, n)
        state[r.source] = bin_, total, n <= 500
        want[(r.source, r.doc_id)] = bin_
    got = {(r.source, r.doc_id): r.bin for r in queries.QUERIES["slide_packing"](spark, DATA).collect()}
    assert got == want and len(got) == len(docs) > tables.table(spark, DATA, "labels").count()


def test_replies_and_upserts_of_all_rows(spark):
    rows = tables.table(spark, DATA, "conversations").collect()
    first = {r.conv_id: r.text for r in rows if r.turn == 0 and r.text}
    want = {(r.conv_id, r.turn): first[r.conv_id][:50] + "..." if r.turn > 0 and r.conv_id in first else None for r in rows}
    got = queries.QUERIES["reply_context"](spark, DATA).collect()
    assert {(r.conv_id, r.turn): r.reply_to for r in got} == want and len(got) == len(rows) and any(r.turn > 3 for r in got)
    docs = tables.table(spark, DATA, "documents").collect()
    want = {r.doc_id: ("new", r.n_chars + 2) if r.doc_id % 3 == 0 else (r.source, r.n_chars) for r in docs}
    got = queries.QUERIES["upsert_last_wins"](spark, DATA).collect()
    assert {r.doc_id: (r.source, r.n_chars) for r in got} == want and len(got) == len(docs)


CLUSTER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
from pyspark.sql import functions as F
import __spark_entry__ as e
from lantern.functions import markup
query = e._with_workers(lambda s, d: s.createDataFrame([("<p>a</p><p>b</p>",)], "t string").select(markup.html_text_udf(F.col("t"))))
for _ in range(2):
    print("rows", query(spark, "").count(), query(spark, "").first()[0].split())
spark.stop()
"""


def test_workers_of_a_cluster_get_the_package(tmp_path):
    """Neither the working folder nor the environment leads the executors to the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED")} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    # Executors of this master work in Spark's home, here one of links.
    for part in Path(pyspark.__file__).parent.iterdir():
        if part.name != "work":
            (tmp_path / "home").mkdir(exist_ok=True)
            (tmp_path / "home" / part.name).symlink_to(part)
    env["SPARK_HOME"] = str(tmp_path / "home")
    (tmp_path / "script.py").write_text(CLUSTER.format(root=root))
    run = subprocess.run([sys.executable, "script.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert run.stdout.split("\n")[:2] == ["rows 1 ['a', 'b']"] * 2, run.stderr[-3000:]
