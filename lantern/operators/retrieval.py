"""Vector retrieval: exact nearest neighbours for a bounded set of queries, several phrasings of one question, first-seen merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.vectors import embed_text, squared_distance

NEIGHBOURS = 10
#: Queries of one scan; they are sent to every task, so their number is bounded.
MOST_QUERIES = 1024


def knn(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each query (variant_idx, query), squared Euclidean distance, ties by id.

    The queries are a stated set and go to every task, ``MOST_QUERIES`` or so in one scan, more in several; each task keeps k rows per query before anything is
    shuffled, so a scan of all vectors moves k rows per task and query.
    """
    scans = max(1, -(-queries.count() // MOST_QUERIES))
    q = queries.select("variant_idx", F.col("query").alias("__q"))
    scan = F.pmod(F.xxhash64("variant_idx", "__q"), F.lit(scans))
    place = F.row_number().over(Window.partitionBy("variant_idx").orderBy("distance", id_col))

    def nearest(part: DataFrame) -> DataFrame:
        scored = vectors.join(F.broadcast(part)).withColumn("distance", squared_distance(F.col(vector), F.col("__q"))).drop("__q", vector)
        return scored.withColumn("rank", place).where(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [nearest(q if scans == 1 else q.where(scan == i)) for i in range(scans)])


def first_seen(matches: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One match per chunk: the first in order of variant, then rank, with that variant's distance."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("variant_idx", "rank"))
    return matches.withColumn("__place", place).where("__place = 1").drop("__place")


def multi_query(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Matches of all variants, merged first-seen, in order of (variant_idx, rank); not sorted by distance again."""
    return first_seen(knn(vectors, queries, k, id_col, vector), id_col).orderBy("variant_idx", "rank")


def variants(spark, question: str, rewrite: Callable[[str], list[str]] | None = None) -> DataFrame:
    """Phrasings of a question by a supplied rewriter, blank ones dropped, the question itself last, with their vectors."""
    lines = [x.strip() for x in (rewrite(question) if rewrite else []) if x.strip()]
    rows = [(i, x) for i, x in enumerate([*lines, question])]
    return spark.createDataFrame(rows, "variant_idx int, text string").withColumn("query", embed_text(F.col("text")))


def search(spark, store: DataFrame, question: str, collection: str, k: int = NEIGHBOURS, rewrite: Callable[[str], list[str]] | None = None) -> DataFrame:
    """Multi-query search in one collection of a vector store."""
    rows = store.where(F.col("collection") == collection)
    return multi_query(rows, variants(spark, question, rewrite), k)
