"""Chunking by word budgets: recursive splitting with overlap, packing of messages and slides, and context headers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions import markup
from lantern.functions.text import word_count

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
MAIL, DOCUMENT, MESSAGE, SLIDE = (250, 30), (500, 50), (250, 30), 500
_WORD = re.compile(r"\S+")


def count_words(text: str) -> int:
    return len(_WORD.findall(text))


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that start with the separator, but for the first; no separator cuts every character."""
    if not separator:
        return list(text)
    parts = text.split(separator)
    return [p for p in [parts[0], *[separator + p for p in parts[1:]]] if p]


def _merge(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbours up to the size; each chunk begins with up to ``overlap`` words of the one before."""
    held: list[tuple[str, int]] = []
    total = 0
    for piece in pieces:
        n = count_words(piece)
        if held and total + n > size:
            if text := "".join(p for p, _ in held).strip():
                yield text
            while total > overlap or (total and total + n > size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    if text := "".join(p for p, _ in held).strip():
        yield text


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator that occurs, and pieces that are still too long at finer ones."""
    if overlap > size:
        raise ValueError("the overlap is larger than the chunk")
    k = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[k + 1 :]
    out: list[str] = []
    small: list[str] = []
    for piece in _cut(text, separators[k]):
        if count_words(piece) < size:
            small.append(piece)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return [*out, *_merge(small, size, overlap)]


def mail_chunks(text: str | None) -> list[str]:
    """Chunks of a mail turn, normalised before and after the split."""
    pieces = (markup.mail_text(c).lstrip(". \n") for c in split_text(markup.mail_text(text), *MAIL))
    return [p for p in pieces if p]


def document_chunks(text: str | None) -> list[str]:
    return [c for p in split_text(text or "", *DOCUMENT) if (c := p.strip())]


def explode_chunks(df: DataFrame, text: str, split: Callable[[str | None], list[str]]) -> DataFrame:
    """One row per chunk: ``chunk_index`` and ``chunk`` beside the other columns; texts without chunks give no rows."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(split)

    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(run(F.col(text))).alias("chunk_index", "chunk"))


# Messages


def message_prefix(sender: Column, reply_to: Column) -> Column:
    sender = F.coalesce(sender, F.lit(""))
    reply = F.when(F.coalesce(reply_to, F.lit("")) == "", "").otherwise(F.concat(F.lit(' (replying to: "'), reply_to, F.lit('")')))
    return F.concat(sender, reply, F.lit(": "))


def format_message(sender: Column, reply_to: Column, text: Column) -> Column:
    return F.concat(message_prefix(sender, reply_to), F.coalesce(text, F.lit("")))


def bin_ids(sizes: list[int], budget: int) -> list[int]:
    """Bin of each item of an ordered list of sizes: consecutive items fill a bin up to the budget; one above it has its own bin."""
    out, bin_, total, open_ = [], -1, 0, False
    for n in sizes:
        if open_ and n <= budget and total + n <= budget:
            total += n
        else:
            bin_, total = bin_ + 1, n
        open_ = n <= budget
        out.append(bin_)
    return out


def pack_rows(df: DataFrame, keys: list[str], order: list[str], size: Column, budget: int, out: str = "bin") -> DataFrame:
    """Every row with its bin among the rows of its keys, in order.

    Null keys are keys like any other, null places come first, and a null size is 0. Rows that tie go by a hash of the whole row, and
    rows that are equal in everything one after the other. The fold is sequential by nature, so it sees only places and sizes, a few bytes a row, of one
    key in one task; whole rows are joined back by their hash and number, and Spark splits that join where a key is skewed.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.withColumn("__row", whole)
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("__row", *keys, *order).orderBy(F.lit(0))))
    places = df.select(*keys, *order, whole.alias("__row"), F.coalesce(size, F.lit(0)).cast("int").alias("__n"))
    by = [*order, "__row"]

    def fold(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in by], null_placement="at_start"))
        ids, copies = list(zip(*[table[c].to_pylist() for c in by], strict=True)), []
        for i, x in enumerate(ids):
            copies.append(copies[-1] + 1 if i and ids[i - 1] == x else 1)
        bins = bin_ids(table["__n"].to_pylist(), budget)
        return table.drop_columns("__n").append_column("__copy", pa.array(copies, pa.int32())).append_column(out, pa.array(bins, pa.int32()))

    schema = places.drop("__n").withColumns({"__copy": F.lit(0), out: F.lit(0)}).schema
    names = {c: f"__at_{i}" for i, c in enumerate([*keys, *order])}
    found = places.groupBy(*keys).applyInArrow(fold, schema).withColumnsRenamed(names | {"__row": "__of", "__copy": "__number"})
    same = (F.col("__row") == F.col("__of")) & (F.col("__copy") == F.col("__number"))
    for c, at in names.items():
        same = same & F.col(c).eqNullSafe(F.col(at))
    return rows.join(found, same).drop("__row", "__copy", "__of", "__number", *names.values())


def message_chunks(messages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Chunks of each group of messages (sender, reply_to, text): packed up to the budget, longer messages split with their prefix repeated.

    Returns keys, chunk_index, chunk.
    """
    size, overlap = MESSAGE
    rows = messages.withColumn("__line", format_message(F.col("sender"), F.col("reply_to"), F.col("text")))
    packed = pack_rows(rows, keys, order, word_count(F.col("__line")), size, "__bin")
    lines = F.array_sort(F.collect_list(F.struct(*order, "__line", "sender", "reply_to", "text")))
    bins = packed.groupBy(*keys, "__bin").agg(lines.alias("__rows"))
    whole = F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n")
    prefix = message_prefix(F.col("__rows")[0]["sender"], F.col("__rows")[0]["reply_to"])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(lines: pd.Series, prefixes: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for line, p, body in zip(lines, prefixes, bodies, strict=True):
            if count_words(line) <= size:
                out.append([line])
            else:
                out.append([p + piece for piece in split_text(markup.message_text(body), max(1, size - count_words(p)), overlap)])
        return pd.Series(out)

    pieces = bins.select(*keys, "__bin", F.posexplode(split(whole, prefix, F.col("__rows")[0]["text"])).alias("__piece", "chunk"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__bin", "__piece")) - 1
    return pieces.select(*keys, place.alias("chunk_index"), "chunk")


# Slides


def slide_chunks(slides: DataFrame, file_id: str, order: str) -> DataFrame:
    """Chunks of presentations from rows (section_id, section_title, section_label, text): whole slides packed up to the budget.

    A packed chunk spans its first to last slide and has neither title nor label; a slide above the budget is split alone under its own.
    """
    packed = pack_rows(slides, [file_id], [order], word_count(F.col("text")), SLIDE, "__bin")
    parts = F.array_sort(F.collect_list(F.struct(order, "section_id", "section_title", "section_label", "text")))
    bins = packed.groupBy(file_id, "__bin").agg(parts.alias("__p"))
    first, last = F.col("__p")[0], F.element_at("__p", -1)
    long = word_count(first["text"]) > SLIDE
    rows = bins.select(
        file_id,
        F.when(long, first["section_id"]).otherwise(F.concat(F.lit("slides_"), first["section_id"], F.lit("_"), last["section_id"])).alias("section_id"),
        F.when(long, first["section_title"]).alias("section_title"),
        F.when(long, first["section_label"]).alias("section_label"),
        F.array_join(F.transform("__p", lambda p: p["text"]), "\n\n").alias("text"),
    )
    return explode_chunks(rows, "text", document_chunks)


# Headers


def _labelled(*parts: tuple[str, Column]) -> Column:
    """Lines ``label: value`` of the values that are there."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def file_header(name: Column, mime: Column, modified: Column, description: Column, title: Column, label: Column) -> Column:
    """What every chunk of a file says about it."""
    about = _labelled(("File", F.coalesce(name, F.lit("Untitled file"))), ("Type", mime), ("Last modified", modified), ("File description", description))
    section = F.concat(F.coalesce(F.nullif(label, F.lit("")), F.lit("Section")), F.lit(": "), title)
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(about, F.lit("\n"), section)).otherwise(about)


def mail_context(chunk: Column, summary: Column, sender: Column, date: Column, subject: Column) -> Column:
    return F.format_string("Email from %s on %s. Subject is %s and email summary is %s. %s", sender, date, subject, summary, chunk)


def message_context(chunk: Column, label: Column, start: Column, end: Column, summary: Column) -> Column:
    return F.format_string("iMessage conversation with %s from %s to %s. Conversation summary: %s. \n %s ", label, start, end, summary, chunk)


def event_text(calendar: Column, title: Column, start: Column, end: Column, location: Column, participants: Column, description: Column) -> Column:
    return _labelled(
        ("Calendar", calendar),
        ("Title", F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled event"))),
        ("Start", start),
        ("End", end),
        ("Location", location),
        ("Participants", F.array_join(participants, ", ")),
        ("Description", description),
    )


def first_words(text: Column, n: int = 15) -> Column:
    """Stand-in for a summary by a language model: the first words."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")
