"""Secret scans: patterns for known shapes, and a token-efficiency test for the rest.

A byte-pair vocabulary that was learned from ordinary text and code spends few characters on each token of a random
string. Candidates are unbroken runs of key characters; those whose characters per token
stay under a threshold are reported as ``token`` spans, unless they are digests of a known length, UUIDs or numbers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from lantern.llm.common import mapped

KINDS = ("assign", "access", "hex", "token")
#: Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# A run is at least as long as asked exactly where the greedy + matches such a run, so the lengths stand in the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{10,}")
#: Runs of letters in the case of words tell nothing under this length, as a fourth of all words of 8 to 15 letters has a low ratio too.
LETTERS = 16
WORDLIKE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/=+]+(?:[A-Z]?[a-z]+|[A-Z]+))*[-_/=+]*\Z")
#: Digests that stand in texts for other reasons than secrecy: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hex.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.IGNORECASE)
#: Identifiers of a known form: UUIDs, dates and times, numbers with separators.
IDENTIFIER = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z|[\d+/_=-]+\Z", re.IGNORECASE)
#: Words joined by separators, which take tokens of their own: they are tested by their words.
JOINED = re.compile(r"(?:[A-Za-z]+[-_/=+])+[A-Za-z]+\Z|(?:[A-Za-z]{3,}\d{0,4}[-_/])+[A-Za-z]*\d{0,4}\Z")
WORD = re.compile(r"[A-Za-z]+")
CHARS_PER_TOKEN = 2.2


def vocabulary(path: str) -> bytes:
    """The bytes of a tiktoken rank file, read on the driver and sent along."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a vocabulary; a worker keeps it from task to task."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, in the order of the report: by start, then by kind."""
    out = []
    if ":" in text or "=" in text:  # no match can do without
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def token_spans(text: str, encode: Callable[[str], list[int]], taken: list[tuple[int, int, str]], ratio: float = CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    """Runs with few characters per token that no base span overlaps."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if len(run) < LETTERS and WORDLIKE.match(run) or DIGEST.match(run) or IDENTIFIER.match(run):
            continue
        s, e = m.span()
        if any(a < e and s < b for a, b, _ in taken):
            continue
        parts = WORD.findall(run) if JOINED.match(run) else [run]
        if sum(map(len, parts)) / sum(len(encode(p)) for p in parts) < ratio:
            out.append((s, e, KINDS[3]))
    return out


def find_secrets(text: str | None, encode: Callable[[str], list[int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans of a text (null: none)."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, token_spans(text, encode, base)


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "<secret>") -> str | None:
    """The text with every span, or run of overlapping spans, replaced by a mark; a text without spans stays as it is."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long"


def _batches(ranks, pattern: str, row: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value, pattern).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield row(batch.slice(at, 1024), encode)

    return run


def _report(part: pa.RecordBatch, encode) -> pa.RecordBatch:
    rows = []
    for text in part.column(1).to_pylist():
        base, added = find_secrets(text, encode)
        kinds = [k for _, _, k in base]
        digest = hashlib.sha256(join_spans(base).encode()).hexdigest()
        rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, join_spans(base + added), len(added)))
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [x.split()[0] for x in SCHEMA.split(", ")])


def _redacted(part: pa.RecordBatch, encode) -> pa.RecordBatch:
    texts = []
    for text in part.column(0).to_pylist():
        base, added = find_secrets(text, encode)
        texts.append(redact(text, base + added))
    found = [None if t is None else len(t) for t in texts]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(found, pa.int64()), *part.columns[1:]], ["text", "n_chars", *part.schema.names[1:]])


def scan_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Spans of every text, one row per input row, also for repeated ones; a null text counts as empty.

    ``path`` names the rank file, ``pattern`` is its word pattern. Only doc_id and text are read, so other columns may have any names; a
    null doc_id is carried along; an empty table gives no rows. No shuffle; a text is scanned in one piece, so memory is bounded by a batch of texts, however long.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(vocabulary(path))
    return mapped(documents.select("doc_id", "text"), _batches(ranks, pattern, _report), SCHEMA)


def redact_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents with every found secret replaced by ``<secret>`` and ``n_chars`` brought up to date.

    Every row stays, repeated ones too; a null text stays null; texts without secrets stay byte for byte; all other columns are carried as they are, whatever
    their names; an empty table gives no rows. A table without ``n_chars`` gets none.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(vocabulary(path))
    rest = [c for c in documents.columns if c not in ("text", "n_chars")]
    schema = ", ".join(["text string", "n_chars long", *[f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest]])
    out = mapped(documents.select("text", *[documents[c] for c in rest]), _batches(ranks, pattern, _redacted), schema)
    return out.select(*[c for c in documents.columns])
