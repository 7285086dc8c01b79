"""Document fingerprints: a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines that are not empty). Every paragraph is hashed to a wide vector, and the
fingerprint is the sum of the vectors, lane by lane, modulo powers of two. So the order of paragraphs does not matter, and
paragraphs are inserted or deleted by adding or subtracting their vectors, without the rest of the text.

A paragraph's vector has three blocks:

* 6 lanes of 42 bits from independent hashes of the whole paragraph; they decide equality;
* 1 lane that counts its clauses (pieces that end in punctuation before white space);
* 126 lanes of 20 bits, three to a long; a lane adds one hash bit of every clause. Read as signs (+1 for a set bit, -1
  for a clear one), these lanes are a random projection of the clause counts, so squared distances between fingerprints
  estimate how many clauses differ.

Paragraph and clause hashes are exploded and summed by Spark's own aggregation. Sums run over blocks of ``BLOCK`` pieces
and are reduced between the blocks, so lanes never run over, however long a text is.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import interval

WIDE, LANES, PITCH, LANE_BITS = 6, 42, 21, 20
WIDE_MASK = (1 << 42) - 1
ONES = 1 | 1 << PITCH | 1 << 2 * PITCH
LANE = (1 << LANE_BITS) - 1
LANE_MASK = LANE | LANE << PITCH | LANE << 2 * PITCH
BLOCK = 1 << 20
CLAUSE = r"(?<=\p{Punct})\s+|\n"
#: Buckets per shuffle partition when a text is paired with its neighbour, and the most cut points the driver holds.
BUCKETS_PER_PARTITION, MOST_BUCKETS = 4, 20_000
#: Rows, about, that show where to split frequent keys, and the characters of a tie that tell their rows apart there.
SAMPLED, TIE_CHARS = 1 << 15, 200


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _pieces(text: Column, which: int) -> Column:
    """Hashes of paragraphs and clauses of a text, array<struct<which, paragraph, h, block>>."""
    whole = F.coalesce(text, F.lit(""))

    def hashed(parts: Column, paragraph: bool) -> Column:
        return F.transform(
            F.filter(parts, lambda p: p != ""),
            lambda p, i: F.struct(F.lit(which).alias("which"), F.lit(paragraph).alias("paragraph"), F.xxhash64(p).alias("h"), F.floor(i / BLOCK).alias("block")),
        )

    return F.concat(hashed(F.split(whole, "\n"), True), hashed(F.split(whole, CLAUSE), False))


def _masks() -> list[int]:
    return [WIDE_MASK] * WIDE + [WIDE_MASK] + [LANE_MASK] * LANES


def fingerprints(df: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """Vectors ``<text>_fp`` (array<long>) of the text columns, beside the key columns; rows with equal keys are added up.

    A null text counts as empty and has the zero vector. Where ``df`` is already dealt out by some of the keys, nothing is shuffled.
    """
    none = F.array(F.struct(F.lit(0).alias("which"), F.lit(None).cast("boolean").alias("paragraph"), _long(0).alias("h"), _long(0).alias("block")))
    pieces = F.concat(none, *[_pieces(F.col(t), i) for i, t in enumerate(texts)])
    one = df.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*")
    h, paragraph, clause = F.col("h"), F.col("paragraph"), ~F.col("paragraph")
    zero = _long(0)
    again = F.xxhash64("h")
    terms = [F.when(paragraph, F.xxhash64(F.lit(k), "h").bitwiseAND(_long(WIDE_MASK))).otherwise(zero) for k in range(WIDE)]
    terms.append(F.when(clause, _long(1)).otherwise(zero))
    one = one.withColumn("again", again)
    for source in (h, F.col("again")):
        terms += [F.when(clause, F.shiftrightunsigned(source, k).bitwiseAND(_long(ONES))).otherwise(zero) for k in range(LANES // 2)]
    blocks = one.groupBy(*keys, "which", "block").agg(*[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)])
    sums = blocks.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("which") == w, F.col(f"s{i}").bitwiseAND(_long(m))).otherwise(zero)).alias(f"v{w}_{i}")
            for w in range(len(texts))
            for i, m in enumerate(_masks())
        ]
    )
    return sums.select(
        *keys,
        *[F.array(*[F.col(f"v{w}_{i}").bitwiseAND(_long(m)) for i, m in enumerate(_masks())]).alias(f"{t}_fp") for w, t in enumerate(texts)],
    )


def _merge(a: Column, b: Column, sign: int) -> Column:
    def lane(x: Column, y: Column, i: Column) -> Column:
        wide = (x + sign * y).bitwiseAND(_long(WIDE_MASK))
        # Guard bits are set before a subtraction, so no lane borrows from the next.
        guard = _long(0 if sign > 0 else (ONES << LANE_BITS) & ((1 << 63) - 1))
        return F.when(i <= WIDE, wide).otherwise((x.bitwiseOR(guard) + sign * y).bitwiseAND(_long(LANE_MASK)))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(pairs, lambda p, i: lane(p["x"], p["y"], i))


def insert(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _merge(a, b, 1)


def delete(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of ``a`` without those of ``b``, which must be among them."""
    return _merge(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated likeness of two texts from their fingerprints, 0 to 1; 1 for equal fingerprints.

    It is 2<A,B> / (<A,A> + <B,B>) over clause counts, that is the share of clauses in common when none repeats. Three
    products are summed over the sign lanes, whose standard error is about 1/11.
    """
    n_a, n_b = F.element_at(a, WIDE + 1), F.element_at(b, WIDE + 1)

    def sums(acc: Column, p: Column) -> Column:
        out = acc
        cells = []
        for k in range(3):
            x = (F.shiftright(p["x"], k * PITCH).bitwiseAND(_long(LANE)) * 2 - p["n"]).cast("double")
            y = (F.shiftright(p["y"], k * PITCH).bitwiseAND(_long(LANE)) * 2 - p["m"]).cast("double")
            cells.append((x, y))
        dot = sum((x * y for x, y in cells[1:]), cells[0][0] * cells[0][1])
        norm = sum((x * x + y * y for x, y in cells[1:]), cells[0][0] * cells[0][0] + cells[0][1] * cells[0][1])
        return F.struct((out["dot"] + dot).alias("dot"), (out["norm"] + norm).alias("norm"))

    pairs = F.transform(
        F.slice(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), WIDE + 2, LANES),
        lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), n_a.alias("n"), n_b.alias("m")),
    )
    got = F.aggregate(pairs, F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("norm")), sums)
    share = F.transform(F.array(got), lambda g: F.when(g["norm"] == 0, 1.0).otherwise(2 * g["dot"] / g["norm"]))[0]
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def _tie_cuts(df: DataFrame, place: Column, head: Column, parts: dict[int, int]) -> list[tuple[int, str]]:
    """Cut points (key, head of the tie) that split each frequent key into about as many parts as stated.

    They come from some SAMPLED rows at random, so the driver's share is bounded; results don't depend on them.
    """
    rows = df.select(place.alias("k"), head.alias("t")).where(F.col("k").isin(list(parts)))
    share = SAMPLED / max(1, rows.count())
    some: dict[int, list[str]] = {k: [] for k in parts}
    for r in rows.where(F.rand(SAMPLED) < share).collect():
        some[r["k"]].append(r["t"])
    cuts = []
    for k, texts in some.items():
        texts.sort(key=str.encode)
        cuts += [(k, texts[len(texts) * i // parts[k]]) for i in range(1, parts[k]) if texts]
    return cuts


def with_next(df: DataFrame, key: str, tie: str, values: list[str]) -> DataFrame:
    """Pair each row with the one that follows in descending ``key`` (after the last row: the first).

    Adds ``next_<value>``, and ``bucket``, ``place`` and ``extra``: rows are dealt into buckets, ranges of the key by
    approximate quantiles, and a bucket's first row is dealt to the bucket before it too, as an ``extra`` row at its end. So one
    shuffle serves all rows and no task holds more than some buckets. The driver holds one place per bucket. Rows with
    equal keys are in descending order of ``tie``, a string that is never null; a null key comes last. A key that holds several
    quantiles is split by the first TIE_CHARS characters of the tie too. The caller drops rows where ``extra`` is 1.
    """
    spark = df.sparkSession
    n = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.coalesce(F.col(key), _long(-(1 << 63)))
    found = Counter(df.agg(F.percentile_approx(place, [i / n for i in range(1, n)], 10 * n)).first()[0] or [])
    frequent = {k: c for k, c in found.items() if c > 1}
    # Without frequent keys the tie is not needed to deal rows out, so the scans for the cuts don't read it.
    head = F.substring(tie, 1, TIE_CHARS) if frequent else F.lit("")
    cuts = {(k, "") for k in found}
    if frequent:
        cuts.update(_tie_cuts(df, place, head, frequent))
    cuts = sorted(cuts, key=lambda c: (c[0], c[1].encode()))
    ties = [t for _, t in cuts] if frequent else None
    bucket = interval(F.col("__k"), [k for k, _ in cuts], F.col("__t"), ties)
    placed = df.withColumn("__k", place).withColumn("__t", head)
    heads = placed.groupBy(bucket.alias("b")).agg(F.max(F.struct("__k", "__t")).alias("head")).collect()
    heads = {r["b"]: tuple(r["head"]) for r in heads}
    filled = sorted(heads)
    before = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}

    def stated(of: dict, default: Column) -> Column:
        """The bucket's entry."""
        return F.element_at(F.array(*[F.lit(of[b]) if b in of else default for b in range(len(cuts) + 1)]), F.col("__b") + 1)

    placed = placed.withColumn("__b", bucket)
    leads = stated({b: k for b, (k, _) in heads.items()}, F.lit(None).cast("long")) == F.col("__k")
    if frequent:
        leads &= stated({b: t for b, (_, t) in heads.items()}, F.lit(None).cast("string")) == F.col("__t")
    once = F.struct(F.col("__b").alias("b"), F.lit(0).alias("extra"))
    twice = F.array(once, F.struct(stated(before, F.lit(0)).alias("b"), F.lit(1).alias("extra")))
    dealt = placed.withColumn("__to", F.explode(F.when(leads, twice).otherwise(F.array(once))))
    dealt = dealt.select("*", F.col("__to.b").alias("bucket"), F.col("__to.extra").alias("extra")).drop("__t", "__b", "__to")
    w = Window.partitionBy("bucket").orderBy("extra", F.col("__k").desc(), F.col(tie).desc())
    out = dealt.select("*", F.row_number().over(w).alias("place"), *[F.lead(v).over(w).alias(f"next_{v}") for v in values])
    return out.drop("__k")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited form, and likenesses.

    The edited text keeps all but the last floor(n/2) code points and goes on with as many first ones of the next text
    in descending doc_id. A null text counts as empty; repeated rows give a row each; one document is its own next;
    an empty table gives no rows; only doc_id and text are read.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(rows, "doc_id", "text", ["text"])
    half = "cast(char_length(text) div 2 as int)"
    edited = F.concat(F.expr(f"left(text, char_length(text) - {half})"), F.coalesce(F.expr(f"left(next_text, {half})"), F.lit("")))
    pairs = pairs.withColumn("edited", edited)
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    done = fingerprints(pairs, ["bucket", "place", "extra", "doc_id", "n_chars", "edited_sha256"], ["text", "edited"])
    done = done.withColumn("next_fp", F.lead("text_fp").over(Window.partitionBy("bucket").orderBy("place"))).where("extra = 0")
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("text_fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("text_fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("text_fp"), F.col("next_fp")).alias("near_next"),
    )
