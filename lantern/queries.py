"""Queries of the engine's operators over the synthetic tables, and the same rows in DuckDB's SQL.

Tables stand in for roles: conversations for chats, events for timed messages and change feeds, documents for mails and
files, embeddings for vector stores, customers and orders for chat dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions import text as t
from lantern.functions.markup import html_text_udf, mail_text_udf
from lantern.functions.vectors import cosine, mean_vector
from lantern.operators import calendar, chunking, files, mail, messages, retrieval, segment
from lantern.sources.store import deleted, merged, patched
from lantern.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(c, n: int = 6):
    return F.round(c, n)


_DISTANCE = "list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"""
SELECT e.vec_id, CAST(q.vec_id AS INTEGER) AS variant_idx, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE}, e.vec_id) AS INTEGER) AS rank, round({_DISTANCE}, 6) AS distance
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q QUALIFY rank <= 10
""")
def knn_search(spark, d):
    """The ten nearest vectors of each vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").cast("int").alias("variant_idx"), F.col("embedding").alias("query"))
    return retrieval.knn(e.select("vec_id", "embedding"), q, 10, "vec_id").select("vec_id", "variant_idx", "rank", rounded("distance").alias("distance"))


@query(f"""
WITH m AS (
  SELECT e.vec_id, q.variant_idx, row_number() OVER (PARTITION BY q.variant_idx ORDER BY {_DISTANCE}, e.vec_id) AS rank, round({_DISTANCE}, 6) AS distance
  FROM embeddings e, (SELECT CAST(vec_id - 1 AS INTEGER) AS variant_idx, embedding FROM embeddings WHERE vec_id BETWEEN 1 AND 5) q
  QUALIFY rank <= 10
)
SELECT vec_id, variant_idx, CAST(rank AS INTEGER) AS rank, distance FROM m
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY variant_idx, rank) = 1
""")
def multi_query_search(spark, d):
    """Five phrasings, ten neighbours each, merged first-seen."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id between 1 and 5").select((F.col("vec_id") - 1).cast("int").alias("variant_idx"), F.col("embedding").alias("query"))
    return retrieval.multi_query(e.select("vec_id", "embedding"), q, 10, "vec_id").select("vec_id", "variant_idx", "rank", rounded("distance").alias("distance"))


@query("""
SELECT label, pos, round(avg(v), 6) AS mean
FROM (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY label, pos
""")
def topic_centroid(spark, d):
    """Mean vector of each label, one row per position."""
    means = mean_vector(table(spark, d, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("pos", "mean")).select("label", "pos", rounded("mean").alias("mean"))


@query("""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[])), 6) AS similarity
FROM embeddings
""")
def consecutive_similarity(spark, d):
    """Cosine of each vector with the one before it in its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select("vec_id", rounded(cosine(F.col("embedding"), F.lag("embedding").over(w))).alias("similarity"))


@query()
def topic_segments(spark, d):
    """Topic groups of each label's vectors in order; vectors point anywhere, so the threshold is low."""
    e = table(spark, d, "embeddings")
    return segment.topics(e, ["label"], ["vec_id"], "embedding", threshold=0.05).select("vec_id", "label", "group_idx")


@query("""
SELECT user_id, event_id, CAST(sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS session_idx
FROM (SELECT *, epoch(date_trunc('minute', ts)) - epoch(date_trunc('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM events)
""")
def session_groups(spark, d):
    """Sessions of each user: a pause of more than 360 minutes opens one."""
    return segment.sessions(table(spark, d, "events"), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "session_idx")


_FOLD = """
WITH RECURSIVE m AS (
  SELECT {key} AS k, {order} AS o, {words} AS n, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM {table}
), f AS (
  SELECT k, o, i, n, 0 AS bin, n AS s, n <= {budget} AS open FROM m WHERE i = 1
  UNION ALL
  SELECT m.k, m.o, m.i, m.n, CASE WHEN f.open AND m.n <= {budget} AND f.s + m.n <= {budget} THEN f.bin ELSE f.bin + 1 END,
    CASE WHEN f.open AND m.n <= {budget} AND f.s + m.n <= {budget} THEN f.s + m.n ELSE m.n END, m.n <= {budget}
  FROM f JOIN m ON m.k = f.k AND m.i = f.i + 1
)
SELECT k AS {name}, o AS {order}, CAST(bin AS INTEGER) AS bin FROM f
"""


@query(
    _FOLD.format(
        key="conv_id", order="turn", name="conv_id", table="conversations", budget=250, words=r"len(regexp_extract_all(role || ': ' || text, '\S+'))"
    )
)
def message_packing(spark, d):
    """Bins of a conversation's messages under the word budget."""
    rows = table(spark, d, "conversations").withColumn("__line", chunking.format_message(F.col("role"), F.lit(None).cast("string"), F.col("text")))
    return chunking.pack_rows(rows, ["conv_id"], ["turn"], t.word_count(F.col("__line")), 250).select("conv_id", "turn", "bin")


@query(_FOLD.format(key="source", order="doc_id", name="source", budget=500, words=r"len(regexp_extract_all(text, '\S+'))", table="documents"))
def slide_packing(spark, d):
    """Bins of all texts, packed like the slides of one presentation per source."""
    return chunking.pack_rows(table(spark, d, "documents"), ["source"], ["doc_id"], t.word_count(F.col("text")), 500).select("source", "doc_id", "bin")


@query()
def message_chunks(spark, d):
    """Chunks of conversations as one group each, long messages split."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("sender"), F.lit(None).cast("string").alias("reply_to"), "text")
    return chunking.message_chunks(rows, ["conv_id"], ["turn"])


@query()
def document_chunks(spark, d):
    """Chunks of documents with a file header."""
    pieces = chunking.explode_chunks(table(spark, d, "documents"), "text", chunking.document_chunks)
    none = F.lit(None).cast("string")
    head = chunking.file_header(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.lit("text/plain"), none, F.col("source"), none, none)
    return pieces.select(F.concat_ws("_", F.lit("drive"), "doc_id", F.lit("document"), "chunk_index").alias("chunk_id"), F.concat(head, F.lit("\n\n"), "chunk").alias("display_text"))


@query()
def mail_chunks(spark, d):
    """Chunks of threads: a source is a thread and its documents are the turns."""
    rows = table(spark, d, "documents")
    turns = rows.select(
        F.col("source").alias("thread_id"), F.col("doc_id").alias("turn_idx"), F.col("lang").alias("sender"), F.lit("").alias("date"),
        F.col("source").alias("subject"), F.col("text").alias("content"), F.col("doc_id").cast("string").alias("message_id"),
    )
    return mail.thread_chunks(turns).select("chunk_id", "display_text")


@query(r"""
SELECT 'documents' AS t, doc_id AS id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words, len(regexp_extract_all(text, '\S+')) >= 4 AS substantive FROM documents
UNION ALL
SELECT 'conversations', conv_id * 1000 + turn, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER), len(regexp_extract_all(text, '\S+')) >= 4 FROM conversations
""")
def word_counts(spark, d):
    """Words of every text, and whether a message is substantive."""
    one = table(spark, d, "documents").select(F.lit("documents").alias("t"), F.col("doc_id").alias("id"), "text")
    two = table(spark, d, "conversations").select(F.lit("conversations").alias("t"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return one.unionByName(two).select("t", "id", t.word_count(F.col("text")).alias("words"), t.is_substantive(F.col("text")).alias("substantive"))


@query("""
SELECT conv_id, turn, role FROM conversations
WHERE text IS NOT NULL AND translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%tion an%' ORDER BY turn DESC, conv_id DESC LIMIT 10
""")
def keyword_search(spark, d):
    """The newest ten messages that hold a keyword; the limit is the operator's."""
    return messages.keyword_search(table(spark, d, "conversations"), "Tion AN", 10, ts="turn", tie="conv_id").select("conv_id", "turn", "role")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1)
""")
def single_participant_chats(spark, d):
    """Rows of keys that occur exactly once."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(messages.single_member(o, "o_custkey"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""
SELECT n.n_nationkey AS chat_id, coalesce(p.participants, '') AS participants
FROM nation n LEFT JOIN (SELECT c_nationkey, string_agg(c_name, '|' ORDER BY c_name) AS participants FROM customer WHERE c_name <> '' GROUP BY 1) p ON p.c_nationkey = n.n_nationkey
WHERE EXISTS (SELECT 1 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = n.n_nationkey AND trim(o.o_orderpriority) <> '')
""")
def chats_with_messages(spark, d):
    """Nations as chats, customers as members, orders as messages: chats that have a message, with ordered members."""
    chat = table(spark, d, "nation").select(F.col("n_nationkey").alias("ROWID"))
    cust, o = table(spark, d, "customer"), table(spark, d, "orders")
    handle = cust.select(F.col("c_custkey").alias("ROWID"), F.col("c_name").alias("id"))
    chat_handle = cust.select(F.col("c_nationkey").alias("chat_id"), F.col("c_custkey").alias("handle_id"))
    message = o.select(F.col("o_orderkey").alias("ROWID"), F.col("o_orderpriority").alias("text"))
    chat_message = o.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("chat_id"), F.col("o_orderkey").alias("message_id"))
    out = messages.chats(chat, chat_handle, handle, chat_message, message)
    return out.select(F.col("chat_row").alias("chat_id"), F.array_join("participants", "|").alias("participants"))


@query("""
SELECT l.conv_id, l.turn, CASE WHEN p.text IS NULL THEN NULL ELSE left(p.text, 50) || '...' END AS reply_to
FROM conversations l LEFT JOIN conversations p ON p.conv_id = l.conv_id AND p.turn = 0 AND p.text <> '' AND l.turn > 0
""")
def reply_context(spark, d):
    """Replies to a conversation's first turn, of all turns."""
    guid = lambda turn: F.concat_ws("-", "conv_id", turn)
    rows = table(spark, d, "conversations").withColumn("guid", guid(F.col("turn"))).withColumn("parent", F.when(F.col("turn") > 0, guid(F.lit(0))))
    return messages.with_replies(rows, "guid", "parent", "text", ("turn",)).select("conv_id", "turn", "reply_to")


@query("""
WITH k AS (
  SELECT c_custkey, c_name, unnest(['phone:' || d, 'phone:' || right(d, 10)]) AS key, unnest([0, 1]) AS pos
  FROM (SELECT *, '1' || CAST(5550000000 + c_custkey % 100 AS VARCHAR) AS d FROM customer)
)
SELECT key, arg_min(c_name, c_custkey * 2 + pos) AS name FROM k GROUP BY key
""")
def contact_first_wins(spark, d):
    """Contacts under all keys of their number; the first source wins."""
    c = table(spark, d, "customer")
    none = F.lit(None).cast("string")
    number = F.concat(F.lit("+1 "), (F.lit(5550000000) + F.col("c_custkey") % 100).cast("string"))
    return messages.contacts(c.select(F.col("c_custkey").alias("priority"), number.alias("handle"), F.col("c_name").alias("full_name"), none.alias("first_name"), none.alias("last_name"), none.alias("organization")))


@query("SELECT user_id, min(event_id) AS first_seq FROM events GROUP BY user_id")
def first_seen_distinct(spark, d):
    """Distinct users in first-seen order."""
    return messages.first_seen_keys(table(spark, d, "events"), "user_id", "event_id")


@query("""
SELECT user_id AS thread_id, min(event_id) AS first_seq, (SELECT max(event_id) FROM events) AS checkpoint
FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) AND event_type = 'click' GROUP BY user_id
""")
def change_feed(spark, d):
    """Threads changed since a checkpoint, with the next one."""
    e = table(spark, d, "events")
    since = e.agg(F.max("event_id")).first()[0] // 2
    feed = e.select(F.col("event_id").alias("history_id"), F.col("user_id").alias("thread_id"), F.when(F.col("event_type") == "click", "messageAdded").alias("kind"))
    return mail.changed_threads(feed, since)


@query("""
WITH d AS (SELECT doc_id, 'new' AS source, n_chars + v AS n_chars, v FROM documents, (VALUES (1), (2)) x(v) WHERE doc_id % 3 = 0)
SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d)
UNION ALL SELECT doc_id, source, n_chars FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) = 1
""")
def upsert_last_wins(spark, d):
    """All documents merged with a delta that has every third key twice; the last write wins."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    v = F.explode(F.array(F.lit(1), F.lit(2)))
    delta = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"), v.alias("v"), "n_chars").withColumn("n_chars", F.col("n_chars") + F.col("v"))
    return merged(docs, delta, ["doc_id"], "v")


@query("""
SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN 'patched' ELSE event_type END AS event_type FROM events WHERE event_id % 10 <> 0
""")
def delete_and_patch(spark, d):
    """Records deleted by id and others patched by id."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    patch = e.where("event_id % 7 = 0").select("event_id", F.lit("patched").alias("event_type"))
    return patched(deleted(e, e.where("event_id % 10 = 0").select("event_id"), "event_id"), patch, "event_id")


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-11 04:59:59'")
def day_window(spark, d):
    """Events of an hour each that overlap a day in US/Eastern."""
    e = table(spark, d, "events").withColumn("start", F.col("ts").cast("timestamp")).withColumn("end", F.expr("cast(ts as timestamp) + interval 1 hour"))
    return calendar.day_window(e, "2024-01-10").select("event_id", "user_id")


@query("""
SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%A, %B %d, %Y at %I:%M %p ET') AS shown, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %I:%M %p') AS minute,
  'All day on ' || strftime(ts, '%Y-%m-%d') AS day FROM events
""")
def event_time_format(spark, d):
    """Times as shown for events, for messages and for whole days; January is in winter time."""
    e = table(spark, d, "events").withColumn("u", F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("string")
    iso = F.date_format("u", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ns = (F.unix_micros("u") - 978_307_200_000_000) * 1000
    return e.select(
        "event_id",
        t.event_time(none, iso).alias("shown"),
        t.message_date(t.apple_timestamp(ns)).alias("minute"),
        t.event_time(F.date_format("u", "yyyy-MM-dd"), none).alias("day"),
    )


_HINTS = " OR ".join(f"contains(p, '{x}')" for x in t.USEFUL_PATHS)
_HOSTS = ", ".join(f"'{x}'" for x in t.USEFUL_DOMAINS)
_SQL_URL = r"^https?://([^/\s<>)\]]+)(/[^\s<>)\]]*)?"


@query(f"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '{_SQL_URL}', 1) AS h, rtrim(regexp_extract(url, '{_SQL_URL}', 2), '/') AS s, lower(regexp_extract(url, '{_SQL_URL}', 2)) AS p FROM pages),
c AS (SELECT *, CASE WHEN h = '' THEN url WHEN s <> '' AND length(s) <= 32 THEN h || s ELSE h END AS compact, h <> '' AND (lower(h) IN ({_HOSTS}) OR {_HINTS}) AS useful FROM u)
SELECT page_id, compact, useful, CASE WHEN useful THEN compact ELSE '' END AS token FROM c
""")
def compact_urls(spark, d):
    """Short form and usefulness of page addresses."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", t.compact_url(u).alias("compact"), t.is_useful_url(u).alias("useful"), t.normalize_url(u).alias("token"))


@query(r"""
WITH l AS (
  SELECT doc_id, pos, trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l WHERE line <> '')
SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (before IS NULL OR before <> line), '') AS collapsed FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
""")
def collapse_lines(spark, d):
    """Lines cleaned, blank ones and runs of equal ones dropped."""
    return table(spark, d, "documents").select("doc_id", t.collapse_lines(t.normalize_message(F.col("text"))).alias("collapsed"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1")
def duplicate_chunk_text(spark, d):
    """First occurrence of each text in its thread."""
    return mail.unique_chunks(table(spark, d, "documents"), "source", ["doc_id"], "text").select("source", "doc_id")


@query()
def html_to_text(spark, d):
    """Readable text of web pages."""
    return table(spark, d, "pages").select("page_id", html_text_udf("html").alias("text"))


@query()
def mail_text(spark, d):
    """Documents through the mail normaliser."""
    return table(spark, d, "documents").select("doc_id", mail_text_udf("text").alias("text"))


@query(rf"""
SELECT 'pages' AS t, page_id AS id, regexp_matches(html, '(?i)</?\s*(?:{t.HTML_TAGS})\b') AS is_html FROM pages
UNION ALL SELECT 'documents', doc_id, regexp_matches(text, '(?i)</?\s*(?:{t.HTML_TAGS})\b') FROM documents
""")
def html_flags(spark, d):
    """Whether a text looks like HTML."""
    one = table(spark, d, "pages").select(F.lit("pages").alias("t"), F.col("page_id").alias("id"), t.looks_like_html(F.col("html")).alias("is_html"))
    return one.unionByName(table(spark, d, "documents").select(F.lit("documents").alias("t"), F.col("doc_id").alias("id"), t.looks_like_html(F.col("text")).alias("is_html")))


@query("SELECT doc_id, trim(regexp_replace(text, '(?is)All rights reserved.*', ''), ' ' || chr(10)) AS cut FROM documents")
def signature_cut(spark, d):
    """Texts cut at a signature; each text is followed by a device line."""
    return table(spark, d, "documents").select("doc_id", t.cut_signature(F.concat("text", F.lit("\nsent FROM my iphone, excuse brevity"))).alias("cut"))


@query("SELECT doc_id, regexp_replace(text, '(?s)On.+?wrote:.*', '') AS cut FROM (SELECT doc_id, text || chr(10) || 'On a day someone wrote:' || chr(10) || '> quoted' AS text FROM documents)")
def quote_cut(spark, d):
    """Texts cut at a quoted reply, which follows each text."""
    return table(spark, d, "documents").select("doc_id", t.cut_quote(F.concat("text", F.lit("\nOn a day someone wrote:\n> quoted"))).alias("cut"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_per_key(spark, d):
    return calendar.count_per_key(table(spark, d, "events"), "event_type")


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')")
def role_filter(spark, d):
    return messages.roles(table(spark, d, "conversations"), ("user", "assistant")).select("conv_id", "turn", "role")


@query("""
SELECT p_brand, 'p_type: ' || string_agg(p_type, ', ' ORDER BY p_partkey) AS line, 0 AS col_idx FROM part GROUP BY p_brand
UNION ALL SELECT p_brand, 'Column 2: ' || string_agg(CAST(p_size AS VARCHAR), ', ' ORDER BY p_partkey), 1 FROM part GROUP BY p_brand
""")
def sheet_transpose(spark, d):
    """Sheets of parts by brand, written by columns; the second column has no header."""
    p = table(spark, d, "part")
    cell = lambda i, c: F.struct(F.lit(i).alias("col_idx"), c.cast("string").alias("value"))
    cells = p.select("p_brand", F.col("p_partkey").alias("row_idx"), F.explode(F.array(cell(0, F.col("p_type")), cell(1, F.col("p_size")))).alias("c")).select("p_brand", "row_idx", "c.*")
    cells = cells.withColumn("row_idx", F.col("row_idx") + 1)
    head = p.select("p_brand").distinct().select("p_brand", F.lit(0).cast("long").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("p_type").alias("value"))
    return files.sheet_columns(cells.unionByName(head), ["p_brand"])


@query(
    "SELECT m AS mime, CASE m "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.MIME_NAMES.items())
    + " ELSE m END AS name FROM (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in [*t.MIME_NAMES, "text/plain", "image/png"])
    + "]) AS m)"
)
def mime_name(spark, d):
    kinds = F.explode(F.array(*[F.lit(x) for x in [*t.MIME_NAMES, "text/plain", "image/png"]]))
    return spark.range(1).select(kinds.alias("mime")).select("mime", t.mime_name(F.col("mime")).alias("name"))


@query("""
SELECT c_custkey, c_name || ' (' || c_custkey || '@Mail.example)' AS sender FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_custkey || '@Mail.example' FROM customer WHERE c_custkey % 2 = 1
""")
def sender_names(spark, d):
    """Handles shown with their contact's name where the book has one."""
    c = table(spark, d, "customer")
    rows = c.select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("@Mail.example")).alias("handle"))
    book = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("email:"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("key"), F.col("c_name").alias("name"))
    return messages.name_handles(rows, book, ["c_custkey"], "handle").select("c_custkey", "sender")


@query("""
SELECT s.s_suppkey AS event_id, CASE WHEN count(a.c_custkey) = 0 THEN 'Organizer: ' || s.s_name ELSE 'Organizer: ' || s.s_name || '|' || string_agg(a.c_name, '|' ORDER BY a.c_name) END AS people
FROM supplier s LEFT JOIN customer a ON a.c_custkey BETWEEN s.s_suppkey * 3 AND s.s_suppkey * 3 + 2 GROUP BY s.s_suppkey, s.s_name
""")
def event_participants(spark, d):
    """Organizer and attendees of events; each attendee is listed twice, in two spellings, and the organizer once more."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    mail_of = lambda k: F.concat(k.cast("string"), F.lit("@x.example"))
    person = lambda name, m: F.struct(name.alias("displayName"), m.alias("email"))
    rows = c.withColumn("event_id", F.floor(F.col("c_custkey") / 3)).groupBy("event_id").agg(F.array_sort(F.collect_list(person(F.col("c_name"), mail_of(F.col("c_custkey"))))).alias("a"))
    e = s.join(rows, s["s_suppkey"] == rows["event_id"], "left").withColumn("o", person(F.col("s_name"), F.concat(F.lit("S"), mail_of(F.col("s_suppkey")))))
    again = F.transform("a", lambda x: person(F.lit("again"), F.upper(x["email"])))
    own = F.array(person(F.lit("self"), F.lower(F.col("o.email"))))
    people = calendar.participants(F.col("o"), F.concat(own, F.coalesce("a", F.array().cast("array<struct<displayName:string,email:string>>")), F.coalesce(again, F.array().cast("array<struct<displayName:string,email:string>>"))))
    return e.select(F.col("s_suppkey").alias("event_id"), F.array_join(people, "|").alias("people"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 2500
""")
def calendar_events(spark, d):
    """Events of visible calendars in a window, cut in calendar order; the cap is the operator's."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("calendar_id"), (F.col("c_mktsegment") == "BUILDING").alias("hidden"), F.col("c_custkey").alias("calendar_order"))
    start = F.col("o_orderdate").cast("timestamp")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("calendar_id"), F.col("o_orderkey").alias("event_id"), start.alias("start"), (start + F.expr("interval 1 second")).alias("end"))
    low, high = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp") for y in (1995, 1997))
    return calendar.list_events(c, o, low, high, 2500).select(F.col("event_id").alias("o_orderkey"), F.col("calendar_id").alias("o_custkey"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS start_date, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS end_date, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timed FROM events
""")
def event_bodies(spark, d):
    """Event records to write: an all-day event ends a day later, a timed one keeps its times."""
    e = table(spark, d, "events").withColumn("iso", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    none = F.lit(None).cast("string")
    day = calendar.event_body(F.col("event_type"), F.col("iso"), F.col("iso"), F.lit(True), none)
    timed = calendar.event_body(F.col("event_type"), F.col("iso"), F.col("iso"), F.lit(False), none)
    return e.select("event_id", day["start"]["date"].alias("start_date"), day["end"]["date"].alias("end_date"), timed["start"]["dateTime"].alias("timed"))


@query("""
SELECT conv_id, turn, replace(replace(to_base64(encode('Content-Type: text/plain; charset="utf-8"' || chr(10) || 'MIME-Version: 1.0' || chr(10) || 'Content-Transfer-Encoding: 8bit'
  || chr(10) || 'To: a@x.example' || chr(10) || 'Subject: ' || role || chr(10) || chr(10) || text)), '+', '-'), '/', '_') AS raw FROM conversations
""")
def drafts(spark, d):
    """Messages as drafts of mails."""
    return table(spark, d, "conversations").select("conv_id", "turn", mail.draft(F.lit("a@x.example"), F.col("role"), F.col("text")).alias("raw"))


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE n_chars <= 20971520 AND source <> 'src1' AND lang = 'en'")
def file_listing(spark, d):
    """Listed files: not trashed, no folders, the owner's, within the size limit."""
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.col("doc_id").alias("id"), "text", F.col("n_chars").cast("string").alias("size"), F.when(F.col("source") == "src1", files.FOLDER).otherwise("text/plain").alias("mimeType"),
        F.lit(None).cast("boolean").alias("trashed"), F.when(F.col("lang") == "en", F.lit(True)).alias("ownedByMe"),
    )
    return files.listing(rows).where(~files.too_large(F.col("size"))).select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("chars"))


@query(r"SELECT CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words FROM documents")
def total_words(spark, d):
    return files.words_in(table(spark, d, "documents"), "text")


def _store(spark, d):
    """Conversations as a message store: each a chat with one member, who has the address ``h`` and the last digit of its number."""
    c = table(spark, d, "conversations")
    guid = lambda turn: F.concat_ws("-", "conv_id", turn)
    row = (F.col("conv_id") * 1000 + F.col("turn")).alias("ROWID")
    message = c.select(
        row, "text", F.col("turn").alias("date"), (F.col("role") == "assistant").cast("int").alias("is_from_me"), (F.col("conv_id") % 10).alias("handle_id"),
        guid("turn").alias("guid"), F.when(F.col("turn") > 0, guid(F.lit(0))).alias("thread_originator_guid"),
    )
    chat_message = c.select(F.col("conv_id").alias("chat_id"), row.alias("message_id"))
    chats = c.select("conv_id").distinct()
    chat_handle = chats.select(F.col("conv_id").alias("chat_id"), (F.col("conv_id") % 10).alias("handle_id"))
    handle = chats.select((F.col("conv_id") % 10).alias("ROWID")).distinct().select("ROWID", F.concat(F.lit("h"), F.col("ROWID").cast("string")).alias("id"))
    return message, chat_message, chat_handle, handle


@query("""
WITH n AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 10 = 3 AND text IS NOT NULL ORDER BY turn DESC, conv_id DESC LIMIT 200)
SELECT n.conv_id * 1000 + n.turn AS row_id, CASE n.role WHEN 'assistant' THEN 'Me' ELSE 'Them' END AS sender, '2000-12-31 07:00 PM' AS date,
  CASE WHEN p.text IS NULL OR p.text = '' THEN NULL ELSE left(p.text, 50) || '...' END AS reply_to
FROM n LEFT JOIN n p ON p.conv_id = n.conv_id AND p.turn = 0 AND n.turn > 0
""")
def conversation_lookup(spark, d):
    """The newest messages of the chats with an address; replies are looked up among them; the limit is the operator's."""
    message, chat_message, chat_handle, handle = _store(spark, d)
    return messages.conversation(message, chat_message, chat_handle, handle, "h3", 200).select("row_id", "sender", "date", "reply_to")


@query("SELECT conv_id * 1000 + turn AS row_id, 'h' || conv_id % 10 AS handle, text FROM conversations WHERE conv_id = 7 AND trim(text) <> ''")
def chat_listing(spark, d):
    """All messages of a chat with the sender's handle."""
    message, chat_message, _, handle = _store(spark, d)
    return messages.chat_messages(message, chat_message, handle, 7).select(F.col("ROWID").alias("row_id"), "handle", "text")


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN 'a, b' END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'Chat ' || c_custkey) AS label,
  CASE WHEN c_custkey % 3 = 1 THEN 'group' ELSE 'individual' END AS kind
FROM customer
""")
def chat_labels(spark, d):
    """Labels of chats by what they have, and groups told from individuals."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    people = F.when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    label = t.chat_label(F.when(k % 3 == 0, F.col("c_name")), people, F.when(k % 2 == 0, F.col("c_mktsegment")), k)
    return c.select("c_custkey", label.alias("label"), messages.chat_kind(people).alias("kind"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE '%build%'")
def label_filter(spark, d):
    """Chats whose label contains a text, in either case."""
    return messages.labelled(table(spark, d, "customer").withColumn("label", F.col("c_mktsegment")), "Build").select("c_custkey")


@query("""
WITH e AS (
  SELECT 'phone:1555' || CAST(1000000 + c_custkey % 500 AS VARCHAR) AS long, c_name AS name, 0 AS kind, c_custkey AS owner FROM customer WHERE c_custkey % 2 = 0
), k AS (
  SELECT long AS key, name, owner * 2 AS place FROM e UNION ALL SELECT 'phone:' || right(long, 10), name, owner * 2 + 1 FROM e
  UNION ALL SELECT 'email:c' || c_custkey || '@x.example', c_name, c_custkey * 2 FROM customer WHERE c_custkey % 2 = 0
) SELECT key, arg_min(name, place) AS name FROM k GROUP BY key
""")
def contact_stores(spark, d):
    """Phones and addresses joined with the records of a contact store; owners without a record, and a store that can't be read, give none."""
    c = table(spark, d, "customer")
    none = F.lit(None).cast("string")
    k = F.col("c_custkey")
    record = c.where("c_custkey % 2 = 0").select(k.alias("Z_PK"), F.col("c_name").alias("ZNAME"), none.alias("ZFIRSTNAME"), none.alias("ZLASTNAME"), none.alias("ZORGANIZATION"))
    phone = c.select(k.alias("ZOWNER"), F.concat(F.lit("+1 (555) "), (1_000_000 + k % 500).cast("string")).alias("ZFULLNUMBER"))
    email = c.select(k.alias("ZOWNER"), F.concat(F.lit("C"), k.cast("string"), F.lit("@X.example")).alias("ZADDRESS"))
    return messages.contacts(messages.contact_entries([(c, c, c), (phone, email, record)]))


@query(f"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '{_SQL_URL}', 1) AS h, rtrim(regexp_extract(url, '{_SQL_URL}', 2), '/') AS s, lower(regexp_extract(url, '{_SQL_URL}', 2)) AS p FROM pages),
c AS (SELECT *, CASE WHEN h = '' THEN url WHEN s <> '' AND length(s) <= 32 THEN h || s ELSE h END AS compact, h <> '' AND (lower(h) IN ({_HOSTS}) OR {_HINTS}) AS useful FROM u)
SELECT page_id, 'see ' || CASE WHEN useful THEN compact ELSE '' END || ' or ' || CASE WHEN useful THEN compact ELSE '' END || ' now' AS text FROM c
""")
def rewritten_urls(spark, d):
    """Texts with two addresses each, which are compacted or dropped."""
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" or "), F.col("url"), F.lit(" now"))
    return table(spark, d, "pages").select("page_id", t.rewrite_urls(text).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE md5(text) END AS digest FROM documents")
def decoded_bodies(spark, d):
    """Bodies of mails through base64url and back; every fifth is broken and gives no text."""
    data = F.when(F.col("doc_id") % 5 == 0, "*not base64*").otherwise(t.encode_base64url(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.md5(t.decode_base64url(data)).alias("digest"))


@query("SELECT conv_id, turn, role AS subject, 'none' AS date, turn % 2 = 1 AS promotional FROM conversations")
def mail_headers(spark, d):
    """Headers of mails by name: the last of a repeated name wins, a missing one has its default."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    some = F.array(pair("Subject", F.lit("first")), pair("From", F.lit("x")), pair("Subject", F.col("role")))
    more = F.when(F.col("turn") % 2 == 1, F.array(pair("List-Unsubscribe", F.lit("y")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    h = F.concat(some, more)
    return table(spark, d, "conversations").select("conv_id", "turn", mail.header(h, "Subject").alias("subject"), mail.header(h, "Date", "none").alias("date"), mail.promotional(h).alias("promotional"))


@query("SELECT conv_id * 1000 + turn AS id, 'about ' || role AS subject FROM conversations WHERE contains(lower(text), 'the') OR role = 'system' ORDER BY id LIMIT 50")
def mail_search(spark, d):
    """Mails whose snippet or subject contains a text, in scan order; the limit is the operator's."""
    c = table(spark, d, "conversations")
    row = F.col("conv_id") * 1000 + F.col("turn")
    head = F.array(F.struct(F.lit("Subject").alias("name"), F.concat(F.lit("about "), "role").alias("value")))
    snippet = F.when(F.col("role") == "system", "THE system").otherwise(F.col("text"))
    rows = c.select(row.alias("seq"), row.alias("id"), F.col("conv_id").alias("thread_id"), head.alias("headers"), snippet.alias("snippet"))
    return mail.search(rows, "The", 50).select("id", "subject")


@query("SELECT user_id AS thread_id, min(event_id) AS first_seq FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def primary_threads(spark, d):
    """Threads of the primary inbox in first-seen order."""
    label = F.when(F.col("event_type").isin("click", "view"), "CATEGORY_PERSONAL").otherwise("CATEGORY_FORUMS")
    rows = table(spark, d, "events").select(F.array(F.lit("INBOX"), label).alias("labels"), F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"))
    return mail.primary_threads(rows)


@query("SELECT doc_id AS id, 'Document' AS mimeType FROM documents WHERE contains(lower(text), 'schl') ORDER BY doc_id LIMIT 40")
def file_search(spark, d):
    """Files whose text contains a text as it is; the limit is the operator's."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.lit("n").alias("name"), F.lit("text/x-own").alias("mimeType"), F.lit("m").alias("modifiedTime"), F.lit("w").alias("webViewLink"), "text")
    return files.search(rows, "sCHl", 40).select("id", F.lit("Document").alias("mimeType"))


@query("SELECT event_id, date_trunc('minute', ts - INTERVAL 5 HOUR) AS parsed FROM events")
def parsed_dates(spark, d):
    """Shown minutes of messages read back as local times."""
    return table(spark, d, "events").select("event_id", t.parse_message_date(t.message_date(F.col("ts").cast("timestamp"))).alias("parsed"))


@query("""
SELECT s_suppkey, 'Calendar: work' || chr(10) || 'Title: ' || CASE WHEN s_suppkey % 4 = 0 THEN 'Untitled event' ELSE s_name END || chr(10) || 'Start: a' || CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || 'Location: hall' ELSE '' END
  || chr(10) || 'Participants: x, y' AS text FROM supplier
""")
def event_texts(spark, d):
    """Labelled lines of events; what is missing or empty has no line."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    title = F.when(k % 4 == 0, "").otherwise(F.col("s_name"))
    text = chunking.event_text(F.lit("work"), title, F.lit("a"), F.lit(""), F.when(k % 3 == 0, "hall"), F.array(F.lit("x"), F.lit("y")), none)
    return table(spark, d, "supplier").select("s_suppkey", text.alias("text"))


@query("""
SELECT conv_id, turn, 'Email from ' || role || ' on today. Subject is s and email summary is sum. ' || text AS mail,
  'iMessage conversation with ' || role || ' from a to b. Conversation summary: sum. ' || chr(10) || ' ' || text || ' ' AS message,
  'File: f' || chr(10) || 'Type: ' || role || CASE WHEN turn = 0 THEN '' WHEN turn = 1 THEN chr(10) || 'Section: ttl' ELSE chr(10) || 'Document tab: ttl' END AS file
FROM conversations
""")
def chunk_contexts(spark, d):
    """What chunks of mails, conversations and files say about where they come from."""
    lit, turn, none = F.lit, F.col("turn"), F.lit(None).cast("string")
    title, label = F.when(turn > 0, "ttl"), F.when(turn > 1, "Document tab")
    return table(spark, d, "conversations").select(
        "conv_id", "turn",
        chunking.mail_context(F.col("text"), lit("sum"), F.col("role"), lit("today"), lit("s")).alias("mail"),
        chunking.message_context(F.col("text"), F.col("role"), lit("a"), lit("b"), lit("sum")).alias("message"),
        chunking.file_header(lit("f"), F.col("role"), none, none, title, label).alias("file"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5('about ' || source || chr(10) || 'in ' || lang) END AS digest FROM documents")
def tab_sections(spark, d):
    """Sections of hosted documents with one tab each; every second file has no text and is rejected."""
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" about\t"), "source", F.lit("\n\nin "), "lang")).otherwise("")
    run = F.struct(F.struct(text.alias("content")).alias("textRun"))
    body = F.struct(F.array(F.struct(F.struct(F.array(run).alias("elements")).alias("paragraph"))).alias("content"))
    tree = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("t").alias("tabId"), F.lit("One").alias("title")).alias("tabProperties"), F.struct(body.alias("body")).alias("documentTab"))).alias("tabs")))
    rows = docs.select("doc_id", F.lit("application/vnd.google-apps.document").alias("mimeType"), F.lit("1").alias("size"), F.encode(tree, "utf-8").alias("content"))
    read = files.sections(rows)
    one = F.try_element_at("sections", F.lit(1))
    good = (one["section_label"] == "Document tab") & (one["section_title"] == "One")
    return read.select("doc_id", F.when(F.col("error").isNull() & good, F.md5(one["text"])).alias("digest"))
