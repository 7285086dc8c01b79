"""Conversation segmentation: pauses, then topic shifts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAUSE_MINUTES, THRESHOLD, CONTEXT, LEAST_WORDS = 360, 0.45, 3, 4


def sessions(df: DataFrame, keys: list[str], ts: str, order: list[str], pause_minutes: int = PAUSE_MINUTES, out: str = "session_idx") -> DataFrame:
    """Number the sessions of each key: a new one begins after a pause of more than ``pause_minutes``, measured on whole minutes."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    minute = F.unix_timestamp(F.date_trunc("minute", F.col(ts).cast("timestamp")))
    opens = F.coalesce((minute - F.lag(minute).over(w) > pause_minutes * 60).cast("int"), F.lit(0))
    return df.withColumn("__opens", opens).withColumn(out, F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__opens")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = min(len(a), len(b))
    norm = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a[:n] @ b[:n]) / norm if norm else 0.0


def topic_groups(vectors: list[np.ndarray | None], threshold: float = THRESHOLD, context: int = CONTEXT) -> list[int]:
    """Group number of each message of one session; a vector is None where a message has too few words to judge.

    A message unlike the mean of the last ``context`` judged ones opens a candidate topic. The next judged message
    confirms it if it is like the candidate's first and unlike the old mean; otherwise the candidate returns to the old topic, and
    that message is judged afresh.
    """
    group, out = 0, [0] * len(vectors)
    recent: list[np.ndarray] = []
    held: list[int] = []  # places of the candidate topic
    for i, v in enumerate(vectors):
        if held:
            held.append(i)
            if v is None:
                continue
            unlike = _cosine(v, np.mean(recent, axis=0)) < threshold
            if unlike and _cosine(v, vectors[held[0]]) >= threshold:
                group += 1
                for j in held:
                    out[j] = group
                recent, held = [vectors[held[0]], v], []
                continue
            for j in held[:-1]:
                out[j] = group
            held = [i] if unlike else []
        elif v is None or not recent:
            unlike = False
        else:
            unlike = _cosine(v, np.mean(recent, axis=0)) < threshold
            held = [i] if unlike else []
        if not unlike:
            out[i] = group
            if v is not None:
                recent = [*recent, v][-context:]
    for j in held:
        out[j] = group
    return out


def topics(df: DataFrame, keys: list[str], order: list[str], vector: str, judged: str | None = None, threshold: float = THRESHOLD, context: int = CONTEXT) -> DataFrame:
    """Add ``group_idx`` within each of ``keys``, which should hold the session: a long pause resets everything, so sessions are independent.

    Sessions are the unit of work, so a busy conversation spreads over many tasks.
    """
    keep = df.columns
    schema = df.withColumn("group_idx", F.lit(0)).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        ok = pdf[judged] if judged else [True] * len(pdf)
        vectors = [np.asarray(v, float) if g and v is not None else None for v, g in zip(pdf[vector], ok, strict=True)]
        return pdf.assign(group_idx=np.array(topic_groups(vectors, threshold, context), "int32"))[[*keep, "group_idx"]]

    return df.groupBy(*keys).applyInPandas(one, schema)


def renumber(df: DataFrame, key: str, parts: list[str], out: str = "group_index") -> DataFrame:
    """Number the groups (session, topic) of each key from 0 in order."""
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(key).orderBy(*parts)) - 1)

