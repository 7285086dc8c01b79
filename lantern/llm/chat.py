"""Chat formatting with typed content parts.

A message is a list of parts, each of type text, image, audio or document. A visitor turns the parts of a
conversation into one string: text is escaped, every other part becomes a numbered placeholder, and beside the string
stand the attachments in the same order, with the number of tokens each placeholder expands to, and the spans that a
loss may look at.

Escaping writes ``&`` as ``&amp;``, ``<`` as ``&lt;`` and ``>`` as ``&gt;``. Escaped text holds no ``<``, so every
``<`` of the output starts a control string, whatever the text says, and undoing the three replacements in reverse order
gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Token costs of attachments: one token per square patch of an image, per slice of audio, and a number per page.
PATCH, AUDIO_PER_SECOND, PER_PAGE = 28, 25, 256
LOSS_ROLES = ("assistant",)
#: Types of attachments.
KINDS = ("image", "audio", "document")


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A part that holds only text (null: the empty text)."""
    rest = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *rest)


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; a missing measure counts as one unit."""
    one = F.lit(1)
    image = F.ceil(F.coalesce(part["width"], one) / PATCH) * F.ceil(F.coalesce(part["height"], one) / PATCH)
    audio = F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_PER_SECOND), F.lit(1))
    document = F.coalesce(part["pages"], one) * PER_PAGE
    return (
        F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", document).otherwise(0)
    ).cast("long")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts).

    Returns conv_id, formatted, loss_spans (start and end in code points of ``formatted``, end exclusive),
    attachments (index, type, ref, tokens) and n_attachment_tokens. A placeholder is ``<type index>``, its index being the attachment's; a part
    of unknown type is ``<part index>`` of 0 tokens, as a type is not trusted with the markup. Messages go by turn; equal turns by role, then by
    their rendered text; null turns come first; a null role is the empty role; a null or empty list of parts is an empty message; a null part is an empty text; rows
    without conv_id form one conversation with a null id. No rows give no rows. Further columns, of any names, are ignored. A conversation is one
    row in the end, so one task holds its text; its turns are placed by a window, which spills.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    role = F.coalesce("role", F.lit(""))
    kind = lambda p: F.when(p["type"].isin(*KINDS), p["type"]).otherwise("part")
    files = F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    # The visitor: a text part gives its escaped text, any other a mark that is numbered once turns are in order.
    pieces = F.transform(parts, lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind(p))))
    rows = messages.select("conv_id", "turn", role.alias("role"), pieces.alias("pieces"), F.array_join(pieces, "").alias("raw"), files.alias("files"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", "role", "pieces", "files", F.row_number().over(w).alias("place"), F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)).alias("first"))
    # Escaped text never starts with "<", so a piece that does is a mark.
    number = F.aggregate(
        "pieces",
        F.struct(F.lit("").alias("out"), F.col("first").cast("long").alias("n")),
        lambda a, x: F.struct(
            F.concat(a["out"], F.when(F.startswith(x, F.lit("<")), F.concat(x, F.lit(" "), a["n"].cast("string"), F.lit(">"))).otherwise(x)).alias("out"),
            (a["n"] + F.when(F.startswith(x, F.lit("<")), 1).otherwise(0)).alias("n"),
        ),
    )["out"]
    text = F.when(F.size("files") == 0, F.array_join("pieces", "")).otherwise(number)
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))
    rows = rows.withColumn("body", F.concat(head, text, F.lit("</turn>\n"))).withColumn("size", F.length("body"))
    placed = Window.partitionBy("conv_id").orderBy("place")
    at = F.sum("size").over(placed) - F.col("size")
    tail = len("</turn>\n")
    span = F.struct((at + F.length(head)).cast("long").alias("start"), (at + F.col("size") - tail).cast("long").alias("end"))
    rows = rows.select("conv_id", "place", "body", "files", F.when(F.col("role").isin(*loss_roles), span).alias("span"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "body", "span", "files"))).alias("m"))
    flat = F.flatten(F.transform("m", lambda t: t["files"]))
    attachments = F.transform(flat, lambda f, i: F.struct(i.alias("index"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("m", lambda t: t["body"]), "").alias("formatted"),
        F.filter(F.transform("m", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(flat, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("n_attachment_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>; placeholders of attachments stay in the text."""
    pieces = F.filter(F.split(formatted, "<turn "), lambda s: s != "")
    return F.transform(
        pieces,
        lambda s: F.struct(
            unescape(F.substring_index(s, ">", 1)).alias("role"),
            unescape(
                F.substring(s, F.instr(s, ">") + 1, F.length(s) - F.instr(s, ">") - len("</turn>\n"))
            ).alias("text"),
        ),
    )


def parse_placeholders(formatted: Column) -> Column:
    """The placeholders of a formatted conversation in order, array<struct<type, index>>."""
    found = F.regexp_extract_all(formatted, F.lit(f"<({'|'.join([*KINDS, 'part'])}) ([0-9]+)>"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substring_index(F.substring(x, 2, 1 << 30), " ", 1).alias("type"), F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("index")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
        "",
    )


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: both roles say a text that looks like markup."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )


def conversation_digests(messages: DataFrame) -> DataFrame:
    """Format conversations of (conv_id, turn, role, text) and read the digests back from the output."""
    out = format_conversations(messages.select("conv_id", "turn", "role", F.array(text_part(F.col("text"))).alias("parts")))
    turns = parse_turns(F.col("formatted"))
    read = out.select(
        "conv_id",
        F.col("formatted"),
        turns.alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "n_attachment_tokens",
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_attachments",
        "n_attachment_tokens",
    )
