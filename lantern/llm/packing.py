"""Best-fit packing into bins of several permitted sizes.

Items are placed in order of falling length into the open bin with the least room that still holds them. If none does, a
new bin opens, of the size that costs least per unit of length it can get: for each permitted size, the items still to be packed are laid into the bin,
longest first, and the cost of the smallest size that holds the result is divided by its length. So the sizes are chosen jointly, by
what is left to fill them. In the end every bin shrinks to the smallest permitted size that holds its contents. Texts longer than
the largest size are cut into pieces of that size and a rest.

A bin's cost is linear in its size, plus the share of attention, which grows with the square, plus a fixed cost per sequence.

Packing runs in groups of about ``GROUP`` items, dealt by a hash of key, piece, length and the number of the repeated row, so groups are even whatever the
data are, their number grows with the input, and each is packed in bounded memory, the same on every run.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import checkpointed

SIZES, GROUP = (2048, 4096, 8192), 2048
#: Units of length that a sequence costs beside its own, and the length at which attention costs as much as all else.
BIN_COST, ATTENTION = 64, 24576
#: Repeated rows that are numbered in one go.
REPEATS = 1 << 16


def bin_cost(size: int) -> float:
    return size + size * size / ATTENTION + BIN_COST


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int]]:
    """Pack falling lengths: bin and offset of each item, and the final size of each bin.

    Every length must be from 1 to the largest size. Ties in room go to the bin that opened first, ties in cost to the smaller size.
    """
    sizes = sorted(sizes)
    if any(a < b for a, b in zip(lengths, lengths[1:], strict=False)):
        raise ValueError("lengths must fall")
    if lengths and lengths[0] > sizes[-1]:
        raise ValueError("an item is longer than the largest size")
    # Runs of equal lengths, by rising length, for looking up the longest item that still fits.
    runs = [(n, len(list(g))) for n, g in groupby(reversed(lengths))]
    values = [n for n, _ in runs]
    left = [c for _, c in runs]
    shrunk = lambda n: sizes[bisect_left(sizes, n)]

    def filled(size: int, n: int) -> int:
        """Length that a new bin reaches if an item opens it and the rest of the items go on, longest first."""
        room, at = size - n, len(values)
        while room and (at := bisect_right(values, room, 0, at)):
            at -= 1
            room -= values[at] * min(left[at], room // values[at])
        return size - room

    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    fill: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        left[bisect_left(values, n)] -= 1
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            reached = {s: filled(s, n) for s in sizes if s >= n}
            room, b = min(reached, key=lambda s: (cost(shrunk(reached[s])) / reached[s], s)), len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return bins, offsets, [shrunk(f) for f in fill]


def pack(df: DataFrame, key: str, length: Column, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = bin_cost, group: int = GROUP) -> DataFrame:
    """Rows (key, piece, start, length, bin, size, at): which stretch of a row stands where in which bin.

    ``length`` counts units of a row (null or below 1: one unit, so that every row is packed). Rows of equal keys, and of none, are
    packed each for itself. ``bin`` is a string that is unique over all groups. No rows give no rows.
    """
    largest = max(sizes)
    long = lambda n: F.lit(n).cast("long")
    rows = df.select(F.col(key).alias("key"), F.greatest(F.coalesce(length, long(1)), long(1)).cast("long").alias("n"))
    rows = checkpointed(rows.groupBy("key", "n").agg(F.count("*").alias("c")))
    last = F.expr(f"(n - 1) div {largest}")  # the number of the last piece
    items = rows.agg(F.sum(F.col("c") * (last + 1))).first()[0] or 0
    groups = max(1, -(-items // group))
    # A row that a large part of the table repeats is numbered in blocks, so no task makes all of its items.
    blocks = rows.select("key", "n", "c", F.explode(F.sequence(long(0), F.expr(f"(c - 1) div {REPEATS}L"))).alias("block"))
    if rows.where(F.col("c") > REPEATS).limit(1).count():
        blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "n", "block")
    first = F.col("block") * REPEATS
    numbered = blocks.select("key", "n", F.explode(F.sequence(first, F.least(first + REPEATS, F.col("c")) - 1)).alias("copy"))
    pieces = numbered.select("key", "n", "copy", F.explode(F.sequence(long(0), last)).alias("piece"))
    pieces = pieces.select("key", "copy", "piece", (F.col("piece") * largest).alias("start"), F.least(long(largest), F.col("n") - F.col("piece") * largest).alias("length"))
    spread = F.pmod(F.xxhash64("key", "piece", "length", "copy"), F.lit(groups))
    kind = df.schema[key].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        table = table.take(order)
        bins, at, final = best_fit(table["length"].to_pylist(), sizes, cost)
        number = table["number"][0].as_py()
        cols = [table["key"], table["piece"], table["start"], table["length"]]
        cols += [pa.array([f"{number}-{b}" for b in bins]), pa.array([final[b] for b in bins], pa.int64()), pa.array(at, pa.int64())]
        return pa.table(cols, names=["key", "piece", "start", "length", "bin", "size", "at"])

    # Items are few bytes and much work, so partitions go by groups, not by size.
    partitions = max(min(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), groups // 8)
    out = pieces.withColumn("number", spread).repartition(partitions, "number").groupBy("number").applyInArrow(one, f"key {kind}, piece long, start long, length long, bin string, size long, at long")
    return out.withColumnRenamed("key", key)


def summary(packed: DataFrame, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = bin_cost) -> DataFrame:
    """One row for each size: bins, units, waste (share of the size that is empty), cost, and bound, the least cost that its units could have."""
    bins = packed.groupBy("bin").agg(F.first("size").alias("size"), F.sum("length").alias("used"))
    price = F.element_at(F.create_map(*[F.lit(x) for s in sizes for x in (s, float(cost(s)))]), F.col("size").cast("int"))
    cheapest = min(cost(s) / s for s in sizes)
    return bins.groupBy("size").agg(
        F.count("*").alias("bins"),
        F.sum("used").alias("units"),
        (1 - F.sum("used") / F.sum("size")).alias("waste"),
        F.sum(price).alias("cost"),
        (F.sum("used") * cheapest).alias("bound"),
    )


def pack_documents(documents: DataFrame) -> DataFrame:
    """Pack texts by their UTF-8 length, the tokens of a byte-level model, plus one separator.

    A null or empty text is the separator alone; a long text is cut into pieces; repeated rows and rows without doc_id are packed each for itself;
    only doc_id and text are read, so other columns may have any names; an empty table gives no rows.
    """
    return pack(documents.select("doc_id", "text"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 1)
