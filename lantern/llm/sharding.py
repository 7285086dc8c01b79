"""Hilbert-curve sharding: rows that are close in several metadata dimensions land in the same run of files.

Each dimension is quantised to ``2**bits`` levels, the levels are one point of a grid, and the place of that point on
the Hilbert curve orders the rows. Runs of equal length are cut from that order, so each file covers a small box in
every dimension and its min/max statistics prune on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import interval, ranked

BITS = 6
SHARDS = 16


def hilbert_index(levels: Sequence[Column], bits: int = BITS) -> Column:
    """Place of a grid point on the Hilbert curve, after Skilling's transposition, as a long.

    ``levels`` are integers from 0 to ``2**bits - 1``; ``bits * len(levels)`` may be 62 at most. The loop runs over a
    constant array inside a higher-order function, so the expression stays small for any number of bits.
    """
    n = len(levels)
    if not 1 <= bits * n <= 62:
        raise ValueError("bits times dimensions must be between 1 and 62")
    steps = [(1 << (b - 1), i) for b in range(bits, 1, -1) for i in range(n)]
    x = F.array(*[c.cast("long") for c in levels])

    def undo(acc: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low, first, here = q - F.lit(1).cast("long"), acc[0], F.element_at(acc, i + 1)
        swap = F.when(here.bitwiseAND(q) != 0, F.lit(0).cast("long")).otherwise(first.bitwiseXOR(here).bitwiseAND(low))
        flip = F.when(here.bitwiseAND(q) != 0, low).otherwise(F.lit(0).cast("long"))
        moved = F.transform(acc, lambda v, k: F.when(k == i, v.bitwiseXOR(swap)).otherwise(v))
        return F.transform(moved, lambda v, k: F.when(k == 0, first.bitwiseXOR(swap).bitwiseXOR(flip)).otherwise(v))

    if steps:
        table = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps])
        x = F.aggregate(table, x, undo)
    # Gray code: every level takes the one before it, then the last decides a mask for all.
    empty = F.array().cast("array<long>")
    grey = F.aggregate(
        x,
        F.struct(empty.alias("done"), F.lit(0).cast("long").alias("last")),
        lambda a, v: F.struct(
            F.concat(a["done"], F.array(v.bitwiseXOR(a["last"]))).alias("done"), v.bitwiseXOR(a["last"]).alias("last")
        ),
    )
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else empty
    turned = F.transform(
        F.array(grey),
        lambda g: F.struct(
            g["done"].alias("v"),
            F.aggregate(
                masks,
                F.lit(0).cast("long"),
                lambda t, q: F.when(g["last"].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
            ).alias("t"),
        ),
    )[0]
    places = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.transform(
        F.array(turned),
        lambda g: F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda acc, p: acc * 2
            + F.when(
                F.element_at(g["v"], p["i"] + 1).bitwiseXOR(g["t"]).bitwiseAND(p["b"]) != 0, F.lit(1).cast("long")
            ).otherwise(F.lit(0).cast("long")),
        ),
    )[0]



def quantile_level(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Level of a numeric column among its ``2**bits`` approximate quantiles (null: level 0).

    The sketch is merged from partial ones, and only the cut points come to the driver. Cut points only decide which
    rows lie near each other; counts stay exact.
    """
    parts = 1 << bits
    shares = [k / parts for k in range(1, parts)]
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, 10_000)).first()[0] or []
    return interval(F.col(column).cast("double"), [float(c) for c in cuts]).cast("long")


def hash_level(column: str, bits: int = BITS) -> Column:
    """Level of a category: its hash, so equal categories share a level (null is a category of its own)."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("long")


def hilbert_shards(
    df: DataFrame,
    numeric: Sequence[str],
    categories: Sequence[str],
    tie_break: Sequence[str],
    shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """Add ``hilbert``, ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard) to every row.

    Law: row counts of shards differ by one at most. Only the columns of ``df`` are moved, so hand in metadata, not
    texts. Nulls take level 0; rows that agree in everything are ordered among themselves in any way; an empty table
    gives an empty result.
    """
    levels = [quantile_level(df, c, bits) for c in numeric] + [hash_level(c, bits) for c in categories]
    placed, total = ranked(df.withColumn("hilbert", hilbert_index(levels, bits)), "hilbert", *tie_break)
    placed = placed.withColumn("shard", F.expr(f"cast(rank * {shards}L div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("slot", F.col("rank") - first).drop("rank")


def shard_documents(documents: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Shard documents along length, id and source.

    ``size`` is the UTF-8 length of the text plus 1 (null text: 1), ``text_crc32`` its unsigned CRC-32 (null text: 0).
    Columns beyond the named ones are ignored.
    """
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents.select(
        "doc_id",
        "source",
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    out = hilbert_shards(rows, ["size", "doc_id"], ["source"], ["doc_id", "text_crc32", "size"], shards, bits)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )
