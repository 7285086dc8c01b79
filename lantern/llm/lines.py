"""Line dedup with a log-template tree of fixed depth.

A line is parsed as a log message: tokens with a digit become the field ``<*>``; the number of tokens and the first
``DEPTH`` tokens lead to a leaf of the tree. A leaf holds as many templates as its lines have: a token's support is the number of different
lines of the leaf that have it at its place, a line's support is the largest that ``SIMILAR`` of its tokens reach, and tokens
with no more than half of that are fields. Lines with equal tokens and fields share a template if they are of ``VARIANTS`` kinds or
more; other lines are their own template, so two lines that differ in a word are not one. A template that two documents or more
contain recurs: its first line, by doc_id and place, stays, and all others are dropped.

Lines of fewer than ``LEAST_TOKENS`` tokens are their own templates and recur in ``SHORT_DOCUMENTS`` documents or more, as
they meet by chance in a few; of those, blank lines and lines under ``SHORT_CHARS`` characters (a number, a brace, a
word as heading) say too little to be a template and always stay.

Everything is aggregation and joins: a hot line is pre-aggregated before it is shuffled, and its rows are joined to one row
of its template, which Spark splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import checkpointed, fresh, release

DEPTH, SIMILAR, VARIANTS, LEAST_TOKENS = 3, 7, 3, 5  # SIMILAR in tenths
SHORT_DOCUMENTS, SHORT_CHARS = 10, 12
FIELD = "<*>"
#: Residues of leaves that are sent to every task, at most, so that lines of no interest are not shuffled with their text.
RESIDUES = 1 << 18


def _has(c: Column, *parts: str) -> Column:
    """Whether a text contains one of the parts; much cheaper than a pattern, which only few lines need."""
    out = F.contains(c, F.lit(parts[0]))
    for part in parts[1:]:
        out = out | F.contains(c, F.lit(part))
    return out


def mask(line: Column) -> Column:
    """The line's tokens joined by single spaces, those with a digit as a field."""
    spaced = F.when(_has(line, "  ", "\t", "\r", "\f"), F.regexp_replace(line, r"[ \t\r\f]+", " ")).otherwise(line)
    return _once(F.trim(spaced), lambda t: F.when(_has(t, *"0123456789"), F.regexp_replace(t, r"[^\s0-9]*+[0-9]\S*", FIELD)).otherwise(t))


def _tokens(masked: Column) -> Column:
    return F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def leaf(masked: Column, tokens: Column) -> Column:
    """Hash of the path in the tree: number of tokens and the leading ones."""
    return F.xxhash64(tokens, F.substring_index(masked, " ", DEPTH))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _parsed(text: Column) -> Column:
    """Lines of a text, array<struct<pos, masked, tokens, leaf, content, more>>, without those that say too little.

    Everything about a line is computed once, before the lines are exploded. content and more are 128 bits of the masked line. A short
    line is alone in its leaf.
    """

    def parse(line: Column, pos: Column) -> Column:
        def told(m: Column, n: Column) -> Column:
            content = F.xxhash64(m)
            way = F.when(n >= LEAST_TOKENS, leaf(m, n)).otherwise(content)
            return F.struct(pos.alias("pos"), m.alias("masked"), n.alias("tokens"), way.alias("leaf"), content.alias("content"), F.xxhash64(F.lit(1), m).alias("more"))

        return _once(mask(line), lambda m: _once(_tokens(m), lambda n: told(m, n)))

    return F.filter(F.transform(F.split(text, "\n"), parse), lambda x: (x["tokens"] >= LEAST_TOKENS) | (F.char_length(x["masked"]) >= SHORT_CHARS))


def _fields(several: DataFrame, said: DataFrame) -> DataFrame:
    """(content, more, shape, shape_more): the template of every line of the leaves with several kinds, as 128 bits."""
    said = several.join(said, ["content", "more"]).select("leaf", "kinds", "content", "more", "masked")
    said = checkpointed(said)
    words = F.slice(F.split("masked", " "), DEPTH + 1, 1 << 30)
    tokens = said.select("leaf", "kinds", "content", "more", F.posexplode(words).alias("pos", "token"))
    counts = tokens.groupBy("leaf", "pos", "token").agg(F.count("*").cast("int").alias("n"))
    support = tokens.join(counts, ["leaf", "pos", "token"]).groupBy("content", "more").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("support")
    )
    # The leading tokens are those of every line of the leaf.
    whole = F.concat(F.array_repeat(F.col("kinds").cast("int"), DEPTH), F.col("support"))
    rows = said.join(support, ["content", "more"]).select("leaf", "content", "more", "masked", whole.alias("support"))
    # The largest support that SIMILAR tenths of the tokens reach.
    line = F.element_at(F.sort_array("support", asc=False), F.expr(f"cast((size(support) * {SIMILAR} + 9) div 10 as int)"))
    rows = rows.withColumn("line", line)
    shape = F.array_join(F.zip_with(F.split("masked", " "), F.col("support"), lambda t, n: F.when(n * 2 > F.col("line"), t).otherwise(FIELD)), " ")
    return rows.select("content", "more", F.xxhash64("leaf", shape).alias("shape"), F.xxhash64(F.lit(2), "leaf", shape).alias("shape_more"))


def templates(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Recurring templates by the lines they hold: (content, more, first), first the place of the template's owner.

    ``lines`` are the checkpointed lines of the documents. They are counted by their hashes. Only where enough different lines of two documents meet in a leaf to share a template do
    their tokens matter, and only those lines are parsed again and shuffled with their text.
    """
    at = F.struct("doc_id", "th", "pos")
    short = F.col("tokens") < LEAST_TOKENS
    contents = lines.groupBy("leaf", "content", "more").agg(
        F.min(at).alias("first"), F.max(F.struct("doc_id", "th")).alias("last"), F.count("*").alias("n"), F.max(short).alias("short")
    )
    contents = checkpointed(contents)
    two = ~F.struct("low.doc_id", "low.th").eqNullSafe(F.col("high"))
    leaves = contents.groupBy("leaf").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.count("*").alias("kinds"))
    leaves = leaves.where(two).select("leaf", "kinds")
    met = checkpointed(contents.join(leaves, "leaf"))
    release(contents)
    several = met.where((F.col("kinds") >= VARIANTS) & ~F.col("short")).select("leaf", "kinds", "content", "more")
    residue = F.pmod(F.col("leaf"), F.lit(RESIDUES)).cast("int").alias("residue")
    some = F.broadcast(several.select(residue).distinct())
    again = documents.select(F.explode(_parsed(F.col("text"))).alias("l")).select("l.content", "l.more", "l.masked", F.pmod(F.col("l.leaf"), F.lit(RESIDUES)).cast("int").alias("residue"))
    said = again.join(some, "residue", "left_semi").groupBy("content", "more", "masked").agg(F.count("*").alias("n")).drop("n")
    shapes = checkpointed(_fields(several, said))
    real = shapes.groupBy("shape", "shape_more").agg(F.count("*").alias("variants")).where(F.col("variants") >= VARIANTS)
    shared = shapes.join(real, ["shape", "shape_more"]).select("content", "more", "shape", "shape_more")
    own = F.col("shape").isNull()
    joined = met.join(shared, ["content", "more"], "left").select(
        "content", "more", F.when(own, F.col("content")).otherwise(F.col("shape")).alias("shape"), F.when(own, F.col("more")).otherwise(F.col("shape_more")).alias("shape_more"), "first", "last", "n", "short"
    )
    joined = checkpointed(joined)
    whole = joined.groupBy("shape", "shape_more").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.max(F.when(F.col("short"), F.col("n"))).alias("n"))
    whole = whole.where(two & (F.coalesce("n", F.lit(SHORT_DOCUMENTS)) >= SHORT_DOCUMENTS)).select("shape", "shape_more", F.col("low").alias("first"))
    found = checkpointed(joined.select("content", "more", "shape", "shape_more").join(whole, ["shape", "shape_more"]).select("content", "more", "first"))
    release(met, joined, shapes)
    return found


def drop_recurring(documents: DataFrame, n_lines: str | None = "n_lines", n_dropped: str | None = "n_dropped") -> DataFrame:
    """The documents with recurring lines taken out of ``text``, and the counts of lines and of dropped ones beside.

    All rows and all other columns stay, whatever their names; the counts are named by the caller (None: left out) and must not clash. A null text stays null with 0 lines; an empty text is one
    empty line; rows that repeat one another in doc_id and text have one fate, and different texts of one doc_id, or of none, are different
    documents, a null doc_id first. ``n_chars`` follows the text where it is present. Long texts are exploded by lines. An empty table gives no rows.
    """
    th = F.xxhash64("text")
    lines = documents.select("doc_id", th.alias("th"), F.explode(_parsed(F.col("text"))).alias("l"))
    lines = checkpointed(lines.select("doc_id", "th", "l.pos", "l.tokens", "l.leaf", "l.content", "l.more"))
    found = templates(documents, lines)
    hit = lines.join(found, ["content", "more"]).where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    names = ["owner", "hash", "gone"]
    doc, own, gone = (fresh(documents, n) for n in names)
    lost = checkpointed(hit.groupBy(F.col("doc_id").alias(doc), F.col("th").alias(own)).agg(F.collect_set("pos").alias(gone)))
    release(lines, found)
    joined = documents.join(lost, F.col("doc_id").eqNullSafe(F.col(doc)) & (th == F.col(own)), "left")
    gone_at = F.coalesce(gone, F.array().cast("array<int>"))
    kept = F.transform(
        F.array(F.struct(F.split("text", "\n").alias("l"), gone_at.alias("g"))),
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["g"]), lambda i: F.element_at(x["l"], i + 1)), "\n"
        ),
    )[0]
    same = F.col(gone).isNull()
    text = F.when(same, F.col("text")).otherwise(kept)
    changed = {"text": text}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.char_length(text).cast("long"))
    columns = [changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in documents.columns]
    if n_lines:
        columns.append(F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias(n_lines))
    if n_dropped:
        columns.append(F.size(gone_at).cast("long").alias(n_dropped))
    return joined.select(*columns)


def line_report(documents: DataFrame) -> DataFrame:
    """Per document how many lines it had and lost, and a digest of what is left (null text: as empty)."""
    out = drop_recurring(documents.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length(text).cast("long").alias("kept_chars"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))
