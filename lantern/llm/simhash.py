"""SimHash near-duplicates.

Fingerprints are majority votes over hashes of word shingles. To link fingerprints at a small Hamming distance, each is
mapped to its bit counts in equal segments. Counts of two fingerprints that differ in d bits are at most d apart in
Manhattan distance, so the counts are a lower bound. For d up to 2 there is always a lattice point at distance 1 or less
from both, so the range join on the grid is an equi-join on such midpoints: a fingerprint goes to its own cell and to its
``2 * segments`` neighbours, and only fingerprints that meet another one in a cell stay candidates. At hundreds of
millions of fingerprints most meet one by chance, so candidates must also meet in the counts of one-bit segments of three
blocks out of five, which hardly any does by chance at that size.

Candidates are verified exactly, by the same midpoints on the finest grid, of segments of one bit: there, Manhattan
distance is Hamming distance, so two candidates share a point if and only if they differ in 2 bits or fewer. A point has
65 fingerprints around it at most, so no group is unbounded and no pairs are listed: every member links to the least one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import checkpointed, fresh, mapped, release

SEED, BITS, SEGMENTS = 42, 64, 16
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_PLACE = np.array([1], np.uint64) << np.arange(BITS, dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, split at ASCII white space alone."""
    return (text or "").encode().translate(_LOWER).split()


def shingles(tokens: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words joined by spaces, repeats included; fewer words: the whole sequence; no words: none."""
    if len(tokens) <= width:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*[tokens[i:] for i in range(width)], strict=False)))


def hashes(text: str | None, width: int) -> np.ndarray:
    grams = shingles(words(text), width)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))


def simhash(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; 0 for none."""
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(_PLACE[counts * 2 > n].sum(dtype=np.uint64))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = [_signed(simhash(hashes(t, width))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) of every text; fp holds the 64 bits as a signed long."""
    return mapped(documents.select("doc_id", "text"), fingerprint_batches(width), "doc_id long, fp long")


def segment_counts(fp: Column, segments: int = SEGMENTS) -> Column:
    """Bit counts of the segments, packed into a long with four bits each (16 segments of 4 bits: counts 0 to 4)."""
    if segments * 4 != BITS:
        raise ValueError("counts are packed for segments of four bits")
    m = lambda n: F.lit(n).cast("long")
    # Counts of neighbouring bits, then of neighbouring pairs, side by side in one word.
    even, odd = fp.bitwiseAND(m(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(m(0x5555555555555555))
    one = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # a sum that may reach the sign bit
    two = one.bitwiseAND(m(0x3333333333333333)) + F.shiftrightunsigned(one, 2).bitwiseAND(m(0x3333333333333333))
    return two


def _cells(counts: Column) -> Column:
    """The cell of the counts and those one step away; a count leaves 0..4 in no cell, as no fingerprint is there."""
    up = [F.when(F.shiftrightunsigned(counts, 4 * s).bitwiseAND(F.lit(15)) < 4, counts + F.lit(1 << 4 * s).cast("long")) for s in range(SEGMENTS)]
    down = [F.when(F.shiftrightunsigned(counts, 4 * s).bitwiseAND(F.lit(15)) > 0, counts - F.lit(1 << 4 * s).cast("long")) for s in range(SEGMENTS)]
    return F.array_compact(F.array(counts, *up, *down))


def _points(fp: Column) -> Column:
    """The fingerprint and all that differ from it in one bit."""
    flips = [fp.bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in range(BITS)]
    return F.array(fp, *flips)


def _met(keyed: DataFrame) -> DataFrame:
    """Keys with two or more fingerprints; only the least and greatest of a key and map task travel."""
    return keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")


def _blocks(fp: Column) -> Column:
    """Keys of the bit counts over segments of one bit in three of five blocks, for every choice of the three.

    Two changed bits lie in two blocks at most, so fingerprints at a distance of 2 or less share a key; a key has 38 bits,
    so that of unrelated fingerprints a billion leave one in thirty with a chance meeting.
    """
    widths = (13, 13, 13, 13, 12)
    starts = [sum(widths[:i]) for i in range(5)]
    masks = [(1 << w) - 1 << s for w, s in zip(widths, starts, strict=True)]
    kept = [masks[i] | masks[j] | masks[k] for i, j, k in combinations(range(5), 3)]
    return F.array(*[F.struct(F.lit(c).alias("choice"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits")) for c, m in enumerate(kept)])


def _spread(df: DataFrame, by: str) -> DataFrame:
    """The rows dealt out over all shuffle partitions, so that what is exploded next is not made by a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def _meeting(df: DataFrame, keys: Column) -> DataFrame:
    """The fingerprints that share one of their keys with another one."""
    cells = _spread(df.select("fp"), "fp").select("fp", F.explode(keys).alias("key"))
    shared = _met(cells).select("key")
    return checkpointed(cells.join(shared, "key", "left_semi").select("fp").distinct())


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect all distinct fingerprints ``fp`` at a distance of 2 bits or fewer.

    Every edge is a true link; links between members of one point are implied by their common edge to its least member.
    """
    fp = F.col("fp")
    candidates = _meeting(distinct, _cells(segment_counts(fp)))
    candidates = _meeting(candidates, _blocks(fp))
    points = _spread(candidates, "fp").select("fp", F.explode(_points(fp)).alias("key"))
    stars = points.groupBy("key").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return stars.select("b", F.explode("all").alias("a")).where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root): the least vertex that each vertex of the edges reaches, but for the least ones themselves, by alternating large-star and small-star steps.

    Each round is two aggregations and joins over the remaining edges; lineage is cut through the shared folder.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == last:
            break
        last = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = checkpointed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = checkpointed(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))


def near_components(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach, the row's own included.

    Null and wordless texts have fingerprint zero and are linked like any other; repeated rows are kept; a null doc_id
    never names a component unless all of its component's are null; an empty table gives no rows. Work is on distinct
    fingerprints, so copies of one text, however many, cost no more than one; the join back is split by Spark when skewed.
    """
    rows = checkpointed(fingerprints(documents, width))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = checkpointed(named)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    table = checkpointed(named.join(ids, "root").select("fp", "component_id"))
    return rows.join(table, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document with its fingerprint in hex and its component."""
    out = near_components(documents, 3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates at a similarity. SimHash and its grid link what is nearly equal; prefixes of the shingle sets find the other
# candidates, as 64 bits differ in about ten at a similarity of 0.8. Every link is verified on the whole sets.

SIMILARITY, WIDTH = 0.8, 5
#: One text in so many is read to see which shingles are frequent; a shingle is if that many of them have it, and so many are told to every task at most.
SAMPLED, FREQUENT, MOST_FREQUENT = 16, 3, 1 << 18
#: Rounds that link sets to one set of each key, which leaves few pairs to the last step, which lists all.
STARS = 1
_SLACK = 1e-6


def least_common(n: int, similarity: float) -> int:
    """Shingles, at least, that a set of n has in common with any set at the similarity or above."""
    return max(1, int(np.ceil(similarity * n - _SLACK)))


def prefix(h: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set of distinct ones in the order of all shingles: rare ones before frequent ones, then by hash.

    Two sets at the similarity or above have one of their prefixes' shingles in common, whatever the order is.
    """
    n = len(h)
    if not n:
        return h
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        rank = np.where(frequent[at] == h, ranks[at], 0)
    return h[np.lexsort((h, rank))][: n - least_common(n, similarity) + 1]


def _set_hashes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [np.unique(hashes(t, width)).astype(np.int64) for t in batch.column(0).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else [], pa.int64())], ["gram"])

    return run


def frequent_shingles(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that are frequent in a sample, and their ranks by frequency. Results don't depend on them, but costs do."""
    sample = documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLED)) == 0).select("text")
    counts = mapped(sample, _set_hashes(width), "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).toArrow()
    grams = top["gram"].to_numpy().astype(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.log2(top["n"].to_numpy()[order]).astype(np.int64) + 1


SKETCH = "doc_id long, one long, two long, th string, fp long, n int, keys array<long>"


def _sketches(width: int, similarity: float, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ranks = frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(hashes(t, width)) for t in part.column(3).to_pylist()]
                cols = [
                    pa.array([hashlib.md5(h.tobytes()).hexdigest() for h in sets], pa.string()),
                    pa.array([_signed(simhash(h)) for h in sets], pa.int64()),
                    pa.array([len(h) for h in sets], pa.int32()),
                    pa.array([prefix(h, grams, ranks, similarity).astype(np.int64) for h in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols], [x.split()[0] for x in SKETCH.split(", ")])

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(hashes(t, width)).astype(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "grams"])

    return run


def _row_hashes() -> list[Column]:
    """128 bits of a text, which tell rows with one doc_id, or none, apart."""
    return [F.xxhash64("text"), F.xxhash64(F.lit(SEED), "text")]


class _Texts:
    """Distinct shingle sets by number (``rep``), and one text of each, for verification."""

    def __init__(self, documents: DataFrame, nodes: DataFrame, width: int, similarity: float):
        self.rows = documents.select("doc_id", *[h.alias(n) for h, n in zip(_row_hashes(), ("one", "two"), strict=True)], "text")
        self.nodes, self.width, self.similarity = nodes, width, similarity

    def verified(self, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """The known edges and those of the pairs (a, b) that are similar, by their whole sets of shingles."""
        pairs = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        reps = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        wanted = self.nodes.join(reps, "rep", "left_semi").select("rep", F.col("least.doc_id").alias("d"), F.col("least.one").alias("o"), F.col("least.two").alias("t"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("one") == F.col("o")) & (F.col("two") == F.col("t"))
        # Rows that repeat one another bring their set several times; one is enough.
        texts = self.rows.join(wanted, same).select("rep", "text").dropDuplicates(["rep"])
        sets = checkpointed(mapped(texts, _shingle_sets(self.width), "rep long, grams array<long>"))
        one, two = sets.select(F.col("rep").alias("a"), F.col("grams").alias("x")), sets.select(F.col("rep").alias("b"), F.col("grams").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        found = pairs.join(one, "a").join(two, "b").where((union == 0) | (common >= self.similarity * union)).select("a", "b")
        found = checkpointed(found.unionByName(known) if known else found)
        release(sets, pairs)
        return found

    def nearly_equal(self) -> DataFrame:
        """Pairs of sets whose SimHash fingerprints the grid links, each with the least one of its component, if sizes allow."""
        tops = checkpointed(self.nodes.groupBy("fp").agg(F.min("rep").alias("top")))
        roots = components(links(tops.select("fp")))
        named = tops.join(roots, tops["fp"] == roots["v"], "left").select("fp", "top", F.coalesce("root", "fp").alias("root"))
        center = named.groupBy("root").agg(F.min("top").alias("b"))
        sets = self.nodes.select(F.col("rep").alias("a"), "fp", "n").join(named.join(center, "root").select("fp", "b"), "fp").where("a <> b")
        sizes = self.nodes.select(F.col("rep").alias("b"), F.col("n").alias("m"))
        fit = F.least("n", "m") >= F.lit(self.similarity) * F.greatest("n", "m")
        return self.verified(sets.join(sizes, "b").where(fit).select("a", "b"))


def similar_sets(documents: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Distinct shingle sets by groups of similar ones: (rep, th, least, group), and the rows' sketches.

    Texts with equal sets of shingles collapse first, however many there are; ``least`` names one row of a set: the least
    doc_id, null ones last, and the least text hash. Then sets are linked whose SimHash fingerprints meet in the grid of segment bit
    counts. All other links come from an exact rule: similar sets share a key (a shingle of both prefixes),
    and their keys in common and the shingles after the last one are as many as they need in common. So the pairs that share
    a key and pass that bound hold all similar ones. Pairs are verified on the whole sets: first each set with one set of
    each of its keys, then all pairs whose sets are not in one group yet. Of those, one set is
    always outside the key's largest group, so a large group of near copies does not pair with itself. Wordless and null texts
    are one set.
    """
    frequent = documents.sparkSession.sparkContext.broadcast(frequent_shingles(documents, width))
    rows = documents.select("doc_id", *_row_hashes(), "text")
    sketches = checkpointed(mapped(rows, _sketches(width, similarity, frequent), SKETCH))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "one", "two")
    distinct = sketches.groupBy("th").agg(F.min(row).alias("least"), *[F.any_value(c).alias(c) for c in ("fp", "n", "keys")])
    whole = checkpointed(distinct.withColumn("rep", F.monotonically_increasing_id()))
    nodes = checkpointed(whole.drop("keys"))
    ids = checkpointed(sketches.select("doc_id", "one", "two"))
    release(sketches)
    texts = _Texts(documents, nodes, width, similarity)
    # A set's shingles from the key on: n less the key's place.
    members = whole.select("rep", "n", F.posexplode("keys").alias("at", "key")).select("key", "rep", "n", (F.col("n") - F.col("at")).alias("rest"))
    shared = members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    met = checkpointed(members.join(shared, "key", "left_semi"))
    release(whole)
    # No shingle is common between the last common key and the end of the prefix that ends first.
    beyond = lambda n: F.greatest(F.lit(1.0), F.ceil(similarity * F.col(n) - _SLACK)) - 1
    most = F.col("c") + F.greatest(F.least(beyond("n"), F.col("there") - 1), F.least(beyond("m"), F.col("here") - 1))
    may = most >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - F.lit(_SLACK)
    edges = texts.nearly_equal()
    roots = components(edges)
    for turn in range(STARS + 1):
        named = met.drop("root").join(roots, F.col("rep") == roots["v"], "left").select("key", "rep", "n", "rest", F.coalesce("root", "rep").alias("root"))
        several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        now = checkpointed(named.join(several, "key", "left_semi"))
        release(met)
        met = now
        other = F.struct("rep", "n", "rest", "root").alias("o")
        if turn < STARS:
            place = F.col("rep") if turn == 0 else F.xxhash64("rep")
            others = now.groupBy("key").agg(F.min_by(F.struct("rep", "n", "rest", "root"), place).alias("o"))
            mine = now
        else:
            largest = now.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "root"))["root"].alias("largest"))
            mine = now.join(checkpointed(largest), "key").where("root <> largest")
            others = now.select("key", other)
        # A key gives a pair one row.
        pairs = mine.join(others, "key").where(F.col("root") != F.col("o.root"))
        if turn == STARS:
            pairs = pairs.where((F.col("o.root") == F.col("largest")) | (F.col("rep") < F.col("o.rep")))
        own, its = F.struct("rep", "n", "rest"), F.struct("o.rep", "o.n", "o.rest")
        pairs = pairs.select(F.when(F.col("rep") < F.col("o.rep"), own).otherwise(its).alias("x"), F.when(F.col("rep") < F.col("o.rep"), its).otherwise(own).alias("y"))
        pairs = pairs.select(F.col("x.rep").alias("a"), "x.n", "x.rest", F.col("y.rep").alias("b"), F.col("y.n").alias("m"), F.col("y.rest").alias("other"))
        fit = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")
        pairs = pairs.where(fit).groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"), F.min("rest").alias("here"), F.min("other").alias("there"))
        edges = texts.verified(pairs.where(may).select("a", "b"), edges)
        roots = components(edges)
    release(now)
    grouped = nodes.join(roots, nodes["rep"] == roots["v"], "left").select("rep", "th", "least", F.coalesce("root", "rep").alias("group"))
    return grouped, ids


def keep_one(documents: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near duplicates: one whole row of each group stays; columns are as before.

    It is the row with the least doc_id (a null one only if no other is there), among rows of one doc_id that with the least
    hash of its text, and any of rows that agree in both. Different texts of one doc_id, or of none, are different documents. Null, empty
    and wordless texts are one group. An empty table gives no rows. Columns other than doc_id and text are carried along whatever
    their names. A long text is hashed in one piece, so a worker holds its words once.
    """
    groups, sketches = similar_sets(documents, width, similarity)
    winners = checkpointed(groups.groupBy("group").agg(F.min("least").alias("w")).select("w.doc_id", "w.one", "w.two"))
    repeated = sketches.groupBy("doc_id", "one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = checkpointed(_same_rows(winners, repeated))
    one, two = _row_hashes()
    d, o, t = (fresh(documents, c) for c in ("winner", "one", "two"))

    def semi(rows: DataFrame) -> DataFrame:
        right = rows.select(F.col("doc_id").alias(d), F.col("one").alias(o), F.col("two").alias(t))
        return documents.join(right, F.col("doc_id").eqNullSafe(F.col(d)) & (one == F.col(o)) & (two == F.col(t)), "left_semi")

    if again.isEmpty():
        return semi(winners)
    # Only rows that repeat one another meet; all but one of them go within each task already.
    several = semi(again).withColumns({o: one, t: two}).dropDuplicates(["doc_id", o, t]).drop(o, t)
    return semi(_same_rows(winners, again, "left_anti")).unionByName(several)


def _same_rows(a: DataFrame, b: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``a`` that are (or with ``left_anti`` are not) among those of ``b``, by doc_id (nulls are equal) and both hashes."""
    b = b.select(F.col("doc_id").alias("d"), F.col("one").alias("o"), F.col("two").alias("t"))
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("one") == F.col("o")) & (F.col("two") == F.col("t")), how)
