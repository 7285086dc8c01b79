"""A corpus pipeline of five stages over ``documents``.

Each stage takes all rows that the one before it kept; ``STAGES`` lists them as (name, function), and ``run`` applies them
with a table between any two in the shared checkpoint folder. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import language, lines, packing, secrets, simhash
from lantern.llm.common import checkpointed, fresh
from lantern.ship import ship

#: A document needs a language, held with at least this mean probability over its words.
LEAST_SCORE = 0.4
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; texts that are null, empty, have no letter or no clear language go.

    Repeated rows have one fate; nulls in other columns and columns of any name are carried along; a null doc_id is never
    learned from. Texts of any length are read whole. Without labelled rows nothing is recognised, so nothing stays; an empty table gives no rows.
    """
    crf = language.fit(docs.select("doc_id", "text", "lang"))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    out = language.labelled(docs, crf, lang, score)
    return out.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates; a document that had nothing else goes.

    A null or empty text has no line to lose and stays. The first place of a template by doc_id keeps its line; rows that
    agree in doc_id and text have one fate. Columns of any name are carried along; an empty table gives no rows.
    """
    lost = fresh(docs, "n_dropped")
    out = lines.drop_recurring(docs, None, lost)
    return out.where((F.col(lost) == 0) | (F.trim("text") != "")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id.

    Null, empty and wordless texts are one group. Different texts of one doc_id, or of none, are different documents; of rows that
    repeat one another one stays. Columns of any name are carried along; texts are compared whole; an empty table gives no rows.
    """
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark.

    A null text stays null, an empty one empty; repeated rows stay repeated; columns of any name are carried along; texts are read whole;
    an empty table gives no rows.
    """
    return secrets.redact_documents(docs, RANKS, public_tokenizers.PATTERN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each stretch of each document stands in the packed sequences.

    Null and empty texts are one unit long; a text longer than the largest sequence is cut into pieces; repeated rows and rows
    without doc_id are packed each for itself; other columns are not read; an empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: SQL has no word for the field, the redaction and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
