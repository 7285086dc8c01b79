"""Segmentation, splitting and packing against plain models and their promises."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lantern.operators import chunking, segment


A, B, C = np.eye(3)


def groups(vectors, **more):
    return segment.topic_groups(vectors, 0.45, **more)


def test_topics_by_hand():
    assert groups([A]) == [0] and groups([]) == []
    assert groups([A, A, B]) == [0, 0, 0]  # the end confirms nothing
    assert groups([A, A, B, B, B]) == [0, 0, 1, 1, 1]
    assert groups([A, A, B, A, A]) == [0] * 5  # a remark aside
    assert groups([A, A, B, C, C]) == [0, 0, 0, 1, 1]  # the second is unlike both, so it is the next candidate
    assert groups([A, A, B, None, None, B]) == [0, 0, 1, 1, 1, 1]  # short messages wait with the candidate
    assert groups([A, A, B, None, A]) == [0] * 5
    assert groups([None, None, A, A]) == [0] * 4
    assert groups([A, B, B, C, C, A, A]) == [0, 1, 1, 2, 2, 3, 3]
    assert groups([A, A, A, A, B, B], context=1) == [0, 0, 0, 0, 1, 1]


@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=40), st.sampled_from([0.1, 0.45, 0.8]))
@settings(max_examples=200, deadline=None)
def test_topics_keep_their_promises(kinds, t):
    r = np.random.default_rng(0)
    base = r.normal(size=(6, 8))
    vectors = [None if k is None else base[k] + 0.3 * r.normal(size=8) for k in kinds]
    got = segment.topic_groups(vectors, t)
    # Numbers rise by one from 0; a topic opens with two judged messages that are like each other and unlike the mean before.
    assert got[:1] in ([], [0]) and all(b - a in (0, 1) for a, b in zip(got, got[1:], strict=False))
    for g in range(1, max(got, default=0) + 1):
        first, second = [v for v, k in zip(vectors, got, strict=True) if k == g and v is not None][:2]
        assert vectors[got.index(g)] is first and segment._cosine(first, second) >= t
        before = [v for v, k in zip(vectors, got, strict=True) if k == g - 1 and v is not None]
        assert before and min(segment._cosine(first, np.mean(before[i : i + 3], axis=0)) for i in range(len(before))) < t
    # Scale and the threshold's ends.
    assert got == segment.topic_groups([None if v is None else 7 * v for v in vectors], t)
    assert set(segment.topic_groups(vectors, -1.1)) <= {0}


def test_topics_in_spark(spark):
    rows = [(s, i, [1.0, 0.0] if i < 4 else [0.0, 1.0]) for s in (1, 2) for i in range(8)]
    got = segment.topics(spark.createDataFrame(rows, "s int, i int, v array<double>"), ["s"], ["i"], "v").orderBy("s", "i").collect()
    assert [r.group_idx for r in got] == [0, 0, 0, 0, 1, 1, 1, 1] * 2


def test_sessions_split_after_the_limit(spark):
    ts = ["2024-01-01 00:00:59", "2024-01-01 06:00:01", "2024-01-01 12:01:00", "2024-01-01 12:01:30"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(ts)], "k int, i int, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.session_idx for r in segment.sessions(df, ["k"], "t", ["i"]).orderBy("i").collect()] == [0, 0, 1, 1]


def test_splitter_by_hand():
    assert chunking.split_text("one. Two", 2, 0) == ["one", ". Two"]
    assert chunking.split_text("a b c d e", 3, 1) == ["a b c", "c d e"]
    assert chunking.split_text("a b\n\nc d e f", 3, 0) == ["a b", "c d e", "f"]
    assert chunking.split_text("", 3, 0) == []


@given(st.lists(st.sampled_from(["a", "bb", "ccc.", "\n", "\n\n", "d"]), max_size=120), st.integers(4, 12))
@settings(max_examples=200, deadline=None)
def test_chunks_stay_in_their_budget(parts, size):
    text = " ".join(parts)
    chunks = chunking.split_text(text, size, 2)
    assert all(len(re.findall(r"\S+", c)) <= size for c in chunks)
    assert set(re.findall(r"\w+", text)) == set(re.findall(r"\w+", " ".join(chunks)))


def check_bins(sizes, bins, budget):
    """Bins run on from 0, hold no more than the budget unless they hold one item, and none could have taken the next bin's first item."""
    parts = [[n for n, b in zip(sizes, bins, strict=True) if b == k] for k in range(max(bins) + 1)]
    assert bins == sorted(bins) and all(parts)
    assert all(sum(p) <= budget or len(p) == 1 for p in parts)
    assert all(sum(p) > budget or sum(p) + q[0] > budget for p, q in zip(parts, parts[1:], strict=False))


def test_packing_by_hand_and_by_its_promises(spark):
    assert chunking.bin_ids([100, 150, 1, 251, 10, 240, 1], 250) == [0, 0, 1, 2, 3, 3, 4]
    r = random.Random(1)
    rows = [(k, i, r.choice([1, 50, 100, 249, 250, 251, 400])) for k in range(20) for i in range(r.randint(1, 30))]
    df = spark.createDataFrame(rows, "k int, i int, n int")
    got = {(x.k, x.i): x.bin for x in chunking.pack_rows(df, ["k"], ["i"], F.col("n"), 250).collect()}
    for k in range(20):
        check_bins([n for kk, _, n in rows if kk == k], [got[k, i] for kk, i, _ in rows if kk == k], 250)


def test_packing_keeps_every_row_once(spark):
    rows = [(1, 0, "a", 200), (1, 0, "b", 100), (1, 0, "b", 100), (1, None, "c", 10), (None, 0, "d", 251), (None, None, "e", None), (2, 5, None, 7)]
    df = spark.createDataFrame(rows, "k int, i int, s string, n int")
    got = chunking.pack_rows(df, ["k"], ["i"], F.col("n"), 250)
    assert got.columns == ["k", "i", "s", "n", "bin"]
    assert sorted(map(str, (tuple(x)[:4] for x in got.collect()))) == sorted(map(str, rows))
    one = got.where("k = 1").groupBy("bin").agg(F.sum("n")).collect()
    assert all(total <= 250 for _, total in one) and len(one) in (2, 3)
    said = spark.createDataFrame([(1, 0, None, None, "x"), (1, 0, "B", None, None), (None, 1, "A", "", "y")], "k int, i int, sender string, reply_to string, text string")
    chunks = {r.chunk for r in chunking.message_chunks(said, ["k"], ["i"]).collect()}
    assert chunks in ({"A: y", ": x\nB: "}, {"A: y", "B: \n: x"})


def test_message_chunks(spark):
    long = " ".join(f"w{i}" for i in range(600))
    rows = [(1, 0, "A", None, "hi there"), (1, 1, "B", "what...", "yes"), (1, 2, "A", None, long), (1, 3, "B", None, "end")]
    got = chunking.message_chunks(spark.createDataFrame(rows, "k int, i int, sender string, reply_to string, text string"), ["k"], ["i"]).orderBy("chunk_index").collect()
    assert got[0].chunk == 'A: hi there\nB (replying to: "what..."): yes' and got[-1].chunk == "B: end"
    assert all(c.chunk.startswith("A: w") for c in got[1:-1]) and len(got) >= 5
    assert all(len(c.chunk.split()) <= 250 for c in got)


def test_slides(spark):
    rows = [("f", i, f"s{i}", f"t{i}", "Slide title", " ".join(["w"] * n)) for i, n in enumerate([300, 200, 1, 501, 10])]
    got = chunking.slide_chunks(spark.createDataFrame(rows, "id string, o int, section_id string, section_title string, section_label string, text string"), "id", "o")
    ids = [(r.section_id, r.section_title) for r in got.orderBy("section_id", "chunk_index").collect()]
    assert ids == [("s3", "t3"), ("s3", "t3"), ("slides_s0_s1", None), ("slides_s2_s2", None), ("slides_s4_s4", None)]


def test_headers(spark):
    none = F.lit(None).cast("string")
    head = chunking.file_header(F.lit("n"), F.lit("text/plain"), none, F.lit("d"), F.lit("T"), none)
    event = chunking.event_text(none, F.lit(""), F.lit("s"), F.lit("e"), F.lit(""), F.array(F.lit("x"), F.lit("y")), none)
    r = spark.range(1).select(head, event, chunking.first_words(F.lit(" a  b c"), 2)).first()
    assert tuple(r) == ("File: n\nType: text/plain\nFile description: d\nSection: T", "Title: Untitled event\nStart: s\nEnd: e\nParticipants: x, y", "a b")
