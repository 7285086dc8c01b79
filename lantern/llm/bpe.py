"""Byte-level BPE: encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can end its encoding. An automaton over the vocabulary's bytes reads the
piece once and names, at each prefix, the longest token that is a suffix of it; shorter ones follow by a table of suffix tokens. A
candidate is right if it may stand after the last token of the prefix before it, which a test of the pair alone decides. The
last token of every prefix is stored, and following these back from the end gives the ids.

A pair may stand side by side if encoding their joint bytes would not merge across the border. Every token has one
derivation by merges; only the tokens on the right edge of the left one's derivation can meet those on the left edge
of the right one's. A meeting merges if its rank comes before the merges that use up either side.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces kept with their ids in a worker: two generations of this many, so memory is bounded and frequent pieces stay.
STORE = 600_000
#: Answers kept of the pair test.
PAIRS = 2_000_000
#: In a text without these characters, the standard module's classes agree with the Unicode ones of the word pattern.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")
LAST = 1 << 62


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, file: bytes, pattern: str):
        spec = json.loads(file)
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: to_bytes(s) for s, i in model["vocab"].items() if s not in self.special}
        self.special_bytes = {i: s.encode() for s, i in self.special.items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.merge: dict[tuple[int, int], int] = {}  # pair -> rank
        made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (ids[to_bytes(a)], ids[to_bytes(b)])
            self.merge.setdefault(pair, rank)
            made.setdefault(ids[to_bytes(a) + to_bytes(b)], (rank, *pair))
        self._edges(made)
        self._automaton(ids)
        self.word = regex.compile(pattern)
        self.latin_word = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pairs: list[dict[int, bool]] = [{} for _ in range(max(self.bytes_of) + 1)]
        self.n_pairs = 0
        self.store: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        table = {**self.bytes_of, **self.special_bytes}
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]
        self.decimal = [str(i) for i in range(len(self.table))]

    def _edges(self, made: dict[int, tuple[int, int, int]]) -> None:
        """For each token its right and left edge: (token, rank at which the merge above uses it up)."""
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for t in self.bytes_of:
            for side, edges in ((2, self.right), (1, self.left)):
                out, now, used = [], t, LAST
                while True:
                    out.append((now, used))
                    if now not in made:
                        break
                    used, now = made[now][0], made[now][side]
                edges[t] = out

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """Trie of the tokens with failure links: for each state the longest token that ends there, by token the next shorter."""
        goto: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for b, i in ids.items():
            s = 0
            for c in b:
                n = goto[s].get(c)
                if n is None:
                    n = goto[s][c] = len(goto)
                    goto.append({})
                    own.append(-1)
                s = n
            own[s] = i
        fail, ends, order = [0] * len(goto), own[:], [0]
        self.shorter = [-1] * (max(self.bytes_of) + 1)
        for s in order:
            for c, n in goto[s].items():
                order.append(n)
                f = fail[s]
                while f and c not in goto[f]:
                    f = fail[f]
                fail[n] = goto[f][c] if s and c in goto[f] else 0
                below = ends[fail[n]]
                if own[n] < 0:
                    ends[n] = below
                else:
                    self.shorter[own[n]] = below
        self.goto, self.fail, self.ends = goto, fail, ends
        self.step = [dict(g) for g in goto]  # steps over failure links are added as they are met
        self.length = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]

    def _next(self, s: int, c: int) -> int:
        f = s
        while c not in self.goto[f]:
            f = self.fail[f]
        n = self.step[s][c] = self.goto[f][c]
        return n

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; answers are kept with b, up to a bound."""
        merge = self.merge
        # Of equal merges the left one comes first.
        fits = not any(rank < used and rank <= gone for x, used in self.right[a] for y, gone in self.left[b] if (rank := merge.get((x, y))) is not None)
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            self.n_pairs = 0
            for known in self.pairs:
                known.clear()
        self.pairs[b][a] = fits
        return fits

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the pre-tokenizer."""
        step, ends, shorter, length, pairs = self.step, self.ends, self.shorter, self.length, self.pairs
        last = [-1]
        s = i = 0
        for c in data:
            i += 1
            s = step[s].get(c) or self._next(s, c)
            t = ends[s]
            before = i - length[t]
            while before:
                p = last[before]
                fits = pairs[t].get(p)
                if fits is None:
                    fits = self.fits(p, t)
                if fits:
                    break
                t = shorter[t]
                before = i - length[t]
            last.append(t)
        out = []
        while i:
            t = last[i]
            out.append(t)
            i -= length[t]
        out.reverse()
        return out

    def _unseen(self, w: str) -> tuple[int, ...]:
        ids = self.older.get(w)
        if ids is None:
            ids = tuple(self.encode_piece(w.encode()))
        if len(self.store) >= STORE:
            self.older, self.store = self.store, {}
        self.store[w] = ids
        return ids

    def _plain(self, text: str, out: list[int]) -> None:
        pattern = self.word if UNUSUAL.search(text) else self.latin_word
        pieces = pattern.findall(text)
        found = list(map(self.store.get, pieces))
        if None in found:
            found = [self._unseen(w) if ids is None else ids for w, ids in zip(pieces, found, strict=True)]
        out += chain.from_iterable(found)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the contents of special tokens are taken as these tokens, as the library does."""
        out: list[int] = []
        if self.cut is None or not any(s in text for s in self.special):
            self._plain(text, out)
            return out
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids)).decode(errors="replace")


_LOADED: dict[str, Bpe] = {}


def loaded(file: bytes, pattern: str) -> Bpe:
    """The vocabulary of these bytes, built once in a worker."""
    key = hashlib.sha256(file + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(file, pattern)
        gc.freeze()  # the tables live as long as the worker
    return _LOADED[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode its ids again; digests of both, one row per input row.

    A null text counts as empty and has no ids. ``path`` names the vocabulary, ``pattern`` its word pattern. Only doc_id and text
    are read; no shuffle; a worker holds the vocabulary, a bounded store of pieces and a bounded batch of texts.
    """
    with open(path, "rb") as f:
        file = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text or "")
                    line = ",".join(map(bpe.decimal.__getitem__, ids))
                    back = bpe.decode(ids)
                    rows.append((len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                n, ids_sha, text_sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], [x.split()[0] for x in SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
