"""The queries of this subpackage: every operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lantern.llm import bpe, chat, fingerprints, language, lines, media, packing, secrets, sharding, simhash
from lantern.llm.common import read

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read(spark, sf_dir, "documents", "doc_id", "text"), BPE_RANKS, public_tokenizers.PATTERN)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat.conversation_digests(rows.unionByName(chat.probe_conversation(spark)))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents", "doc_id", "text"), BPE_JSON, public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_multiset_hash, op2_secret_scan, op3_chat_format, op4_hilbert_shards, op5_bpe, op6_simhash, op7_mpeg_ts, op8_best_fit, op9_line_templates, op10_language, pipeline)
}

ORACLES: dict[str, str] = {}

#: Rendering and escaping of the chat template, once more in SQL.
ORACLES["op3_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
          + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 15 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS n_attachment_tokens
FROM e GROUP BY conv_id
"""

#: Lines that are left of each text.
ORACLES["op9_line_templates"] = r"""
WITH d AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents),
a AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM d),
l AS (
  SELECT doc_id, pos, line, regexp_replace(array_to_string(list_filter(regexp_split_to_array(line, '[ \t\r\f]+'), lambda x: x <> ''), ' '), '\S*[0-9]\S*', '<*>', 'g') AS masked FROM a
), p AS (SELECT *, string_split(masked, ' ') AS t, len(string_split(masked, ' ')) AS k FROM l WHERE len(string_split(masked, ' ')) >= 5 OR length(masked) >= 12),
c AS (
  SELECT masked, any_value(t) AS t, any_value(k) AS k, min({'d': doc_id, 'p': pos}) AS first, max(doc_id) AS last, count(*) AS n,
    any_value(CASE WHEN k < 5 THEN '= ' || masked ELSE k || ' ' || array_to_string(t[1:3], ' ') END) AS leaf
  FROM p GROUP BY masked
), f AS (SELECT leaf, count(*) AS kinds FROM c GROUP BY leaf HAVING min(first).d <> max(last)),
m AS (SELECT * FROM c JOIN f USING (leaf)),
x AS (SELECT masked, leaf, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM m WHERE kinds > 1),
w AS (SELECT leaf, pos, token, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT masked, list(w.n ORDER BY pos) AS support FROM x JOIN w USING (leaf, pos, token) GROUP BY masked),
e AS (
  SELECT masked, leaf || ' = ' || array_to_string(list_transform(list_zip(t, support), lambda z: CASE WHEN z[2] * 2 > list_sort(support, 'DESC')[(len(t) * 7 + 9) // 10] THEN z[1] ELSE '<*>' END), ' ') AS shape
  FROM s JOIN c USING (masked)
), r AS (SELECT shape FROM e GROUP BY shape HAVING count(*) >= 3),
j AS (SELECT m.*, CASE WHEN r.shape IS NULL THEN '= ' || m.masked ELSE r.shape END AS template FROM m LEFT JOIN e USING (masked) LEFT JOIN r ON e.shape = r.shape),
o AS (
  SELECT template, min(first) AS owner FROM j GROUP BY template
  HAVING min(first).d <> max(last) AND coalesce(max(n) FILTER (k < 5), 10) >= 10
), g AS (SELECT p.doc_id, p.pos FROM p JOIN j USING (masked) JOIN o USING (template) WHERE {'d': p.doc_id, 'p': p.pos} <> o.owner),
kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_dropped
  FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.pos = a.pos GROUP BY a.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CAST(length(coalesce(kept.text, '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
