"""Files: listing, search, sections, rejects and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions import markup
from lantern.functions.text import mime_name, word_count
from lantern.operators.chunking import document_chunks, explode_chunks, file_header, slide_chunks

FOLDER = "application/vnd.google-apps.folder"
DOCUMENT, PRESENTATION = "application/vnd.google-apps.document", "application/vnd.google-apps.presentation"
UNREADABLE = "This file type cannot be read as only text"


def listing(files: DataFrame, limit: int | None = None, shared: bool = False) -> DataFrame:
    """Files that are neither folders nor trashed; without ``shared`` only the owner's (unknown: not)."""
    out = files.where(~F.coalesce("trashed", F.lit(False)) & (F.coalesce("mimeType", F.lit("")) != FOLDER))
    if not shared:
        out = out.where(F.coalesce("ownedByMe", F.lit(False)))
    return out if limit is None else out.orderBy("id").limit(limit)


def search(files: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Files whose text contains the query, any character of it taken as it is, with readable type names."""
    hit = F.contains(F.lower("text"), F.lower(F.lit(query)))
    return files.where(hit).orderBy("id").limit(limit).select("id", "name", mime_name(F.col("mimeType")).alias("mimeType"), "modifiedTime", "webViewLink")


def text_or_notice(c: Column) -> Column:
    return F.coalesce(c, F.lit(UNREADABLE))


def too_large(size: Column) -> Column:
    """Above 20 MiB; a missing or empty size counts as 0."""
    return F.coalesce(F.nullif(size, F.lit("")).try_cast("long"), F.lit(0)) > markup.MOST_BYTES


_ROW = T.StructType([T.StructField(n, T.StringType()) for n in markup.SECTION])


@F.pandas_udf(T.StructType([T.StructField("sections", T.ArrayType(_ROW)), T.StructField("error", T.StringType())]))
def _sections(kind: pd.Series, content: pd.Series, mime: pd.Series, size: pd.Series) -> pd.DataFrame:
    rows = []
    for k, c, m, s in zip(kind, content, mime, size, strict=True):
        try:
            got = markup.sections_of(k, c, m, int(s))
            rows.append(([dict(zip(markup.SECTION, x, strict=True)) for x in got], None if got else "no text"))
        except Exception as e:  # a broken file must not end the job; it goes to the rejects
            rows.append(([], f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["sections", "error"])


def sections(files: DataFrame) -> DataFrame:
    """Files with their ``sections`` and ``error``. The size is looked at before the content is handed to Python."""
    kind = F.when(F.col("mimeType") == DOCUMENT, "document").when(F.col("mimeType") == PRESENTATION, "presentation")
    large = too_large(F.col("size"))
    size = F.coalesce(F.nullif("size", F.lit("")).try_cast("long"), F.lit(0))
    got = _sections(kind, F.when(~large, F.col("content")), F.col("mimeType"), size)
    return files.withColumn("__got", got).select("*", "__got.sections", "__got.error").drop("__got")


def rejects(read: DataFrame) -> DataFrame:
    return read.where(F.col("error").isNotNull()).select("name", F.col("error").alias("reason"))


def exploded(read: DataFrame) -> DataFrame:
    """One row per section (section_idx, section_id, section_title, section_label, text) of the files that could be read."""
    rows = read.where(F.col("error").isNull()).drop("content")
    return rows.select(*[c for c in rows.columns if c not in ("sections", "error")], F.posexplode("sections").alias("section_idx", "__s")).select("*", "__s.*").drop("__s")


def chunks(read: DataFrame) -> DataFrame:
    """Chunks of all readable files: presentations packed by slides, others section by section."""
    rows = exploded(read)
    slides = slide_chunks(rows.where(F.col("mimeType") == PRESENTATION).select("id", "section_idx", "section_id", "section_title", "section_label", "text"), "id", "section_idx")
    others = rows.where(F.coalesce("mimeType", F.lit("")) != PRESENTATION).select("id", "section_id", "section_title", "section_label", "text")
    pieces = explode_chunks(others, "text", document_chunks).unionByName(slides)
    about = read.drop("content", "sections", "error", "section_id", "section_title", "section_label", "text")
    out = pieces.join(about, "id")
    head = file_header(F.col("name"), F.col("mimeType"), F.col("modifiedTime"), markup.file_text_udf("description"), F.col("section_title"), F.col("section_label"))
    text = F.concat(head, F.lit("\n\n"), F.col("chunk"))
    meta = {
        "thread_id": "id", "message_id": F.col("chunk_index").cast("string"), "source": F.lit("drive"), "file_id": "id",
        "file_name": F.coalesce("name", F.lit("Untitled file")), "mime_type": "mimeType", "modified_time": "modifiedTime", "created_time": "createdTime",
        "web_view_link": "webViewLink", "parent_ids": F.array_join("parents", ", "), "section_id": "section_id",
        "section_title": "section_title", "section_label": "section_label",
    }
    pairs = [x for k, v in meta.items() for x in (F.lit(k), F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("")))]
    return out.select(
        F.concat_ws("_", F.lit("drive"), "id", "section_id", "chunk_index").alias("chunk_id"),
        F.lit("drive").alias("collection"),
        text.alias("embedding_text"),
        text.alias("display_text"),
        F.create_map(*pairs).alias("metadata"),
    )


def sheet_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Text lines of sheets in long form (row_idx, col_idx, value), by column: the header of row 0, then the values below it in order.

    Blank cells are left out, columns without values too; a missing header is ``Column n``.
    """
    live = cells.where(F.coalesce("value", F.lit("")) != "")
    values = F.array_sort(F.collect_list(F.when(F.col("row_idx") > 0, F.struct("row_idx", "value"))))
    cols = live.groupBy(*keys, "col_idx").agg(F.max(F.when(F.col("row_idx") == 0, F.col("value"))).alias("header"), values.alias("v"))
    label = F.coalesce("header", F.concat(F.lit("Column "), (F.col("col_idx") + 1).cast("string")))
    line = F.concat(label, F.lit(": "), F.array_join(F.transform("v", lambda x: x["value"]), ", "))
    return cols.where(F.size("v") > 0).select(*keys, "col_idx", line.alias("line"))


def words_in(chunks: DataFrame, text: str = "display_text") -> DataFrame:
    return chunks.agg(F.sum(word_count(F.col(text))).alias("words"))
