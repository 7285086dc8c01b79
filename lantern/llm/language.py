"""Language identification of code-switched text by a linear-chain conditional random field.

Words are labelled with languages: features of a word (affixes, character n-grams and membership in a lexicon of frequent words per
language) give a potential for each language, learned transitions tie neighbouring words, and forward-backward gives each
word's probabilities. A document's language is the one with the most probability over its words.

Training runs on the driver over a bounded sample of labelled documents, ``SAMPLE`` of each language, read whole; stretches of different documents are strung together,
so transitions between languages are seen too. The model (a weight table over hashed features) is small and sent along.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import mapped

UNKNOWN = "und"
#: Documents that training takes of each language at most, whole, and languages at most.
SAMPLE, MOST_LANGUAGES = 80, 1000
BUCKETS = 1 << 16
#: Words in a chain: a text is labelled in consecutive chains of this many words, all of them.
CHAIN = 128
LEXICON = 200
EPOCHS, RATE, DECAY, SWITCH = 4, 0.3, 1e-5, 16
STORE = 300_000
#: New words that are scored at once.
BLOCK = 8192
WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
#: Longer runs of letters are cut into consecutive words of this many characters.
LONGEST = 40
HAS_LETTER = regex.compile(r"\p{L}")


def words(text: str | None) -> list[str]:
    """Lower-cased words of letters, long runs in pieces."""
    found = WORD.findall(text.lower()) if text else []
    if max(map(len, found), default=0) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


@lru_cache(maxsize=1 << 18)
def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def features(word: str, lexicons: dict[str, int]) -> list[int]:
    """Hashed features of a word: prefixes and suffixes, character bigrams and trigrams, the lexicons that hold it."""
    found = {"b"} | {f"p{word[:k]}" for k in (1, 2, 3)} | {f"s{word[-k:]}" for k in (1, 2, 3, 4)}
    edged = f"<{word}>"
    found |= {f"g{edged[i : i + k]}" for k in (2, 3) for i in range(len(edged) - k + 1)}
    if word in lexicons:
        found.add(f"l{lexicons[word]}")
    if len(word) <= 4:
        found.add(f"w{word}")
    return sorted(set(map(bucket, found)))


def _remainders() -> np.ndarray:
    """CRC-32 of every byte."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = (r >> 1) ^ (r & 1) * np.uint32(0xEDB88320)
    return r


REMAINDERS = _remainders()


def _begun(text: str) -> np.uint32:
    """State of CRC-32 after a text."""
    return np.uint32(zlib.crc32(text.encode()) ^ 0xFFFFFFFF)


def _followed(states: np.ndarray, raw: np.ndarray, at: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """States of CRC-32 after one more character each, whose ``wide`` bytes of ``raw`` begin ``at``."""
    out = REMAINDERS[(states ^ raw[at]) & 255] ^ (states >> 8)
    for j in range(1, int(wide.max())):
        more = wide > j
        s = out[more]
        out[more] = REMAINDERS[(s ^ raw[at[more] + j]) & 255] ^ (s >> 8)
    return out


def features_of_length(found: list[str], n: int, lexicons: dict[str, int]) -> np.ndarray:
    """``features`` of words that have ``n`` characters each, all at once: a row of sorted buckets for each, repeats and -1 (none) included."""
    raw = np.frombuffer(("<" + "><".join(found) + ">").encode(), np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    wide = np.diff(starts, append=len(raw)).reshape(len(found), n + 2)
    at = starts.reshape(len(found), n + 2)

    def follow(states: np.ndarray, first: int, last: int) -> np.ndarray:
        return _followed(states, raw, at[:, first:last], wide[:, first:last])

    def run(kind: str, first: int, last: int) -> list[np.ndarray]:
        """States after the kind and one, two and more characters, up to the last."""
        out = [np.full((len(found), 1), _begun(kind))]
        for i in range(first, last):
            out.append(follow(out[-1], i, i + 1))
        return out[1:]

    prefixes = run("p", 1, 1 + min(3, n))
    suffixes = [run("s", n + 1 - k, n + 1)[-1] for k in range(1, min(4, n) + 1)]
    pairs = follow(follow(np.full((len(found), n + 1), _begun("g")), 0, n + 1), 1, n + 2)
    short = run("w", 1, n + 1)[-1:] if n <= 4 else []
    hashed = (np.concatenate([*prefixes, *suffixes, pairs, follow(pairs[:, :n], 2, n + 2), *short], axis=1) ^ np.uint32(0xFFFFFFFF)) % BUCKETS
    held = [bucket(f"l{lexicons[w]}") if w in lexicons else -1 for w in found]
    ids = np.concatenate([hashed.astype(np.int32), np.array(held, np.int32)[:, None], np.full((len(found), 1), bucket("b"), np.int32)], axis=1)
    ids.sort(axis=1)
    return ids


class Crf:
    """Weights of the chain. ``langs`` are the labels, in order."""

    def __init__(self, langs: list[str], lexicons: dict[str, int]):
        self.langs, self.lexicons = langs, lexicons
        self.weights = np.zeros((BUCKETS, len(langs)), np.float32)
        self.moves = np.zeros((len(langs), len(langs)), np.float64)
        self.store: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)), np.float32)

    def potentials(self, tokens: list[str]) -> np.ndarray:
        """Potential (log) of every language for every word, through a bounded store of words."""
        store = self.store
        if len(store) > STORE:
            store.clear()
        new = list(dict.fromkeys(filterfalse(store.__contains__, tokens)))
        for at in range(0, len(new), BLOCK):
            part, n = new[at : at + BLOCK], len(store)
            if n + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(part), len(self.rows)), len(self.langs)), np.float32)])
            self.rows[n : n + len(part)] = self.scored(part)
            store.update(zip(part, range(n, n + len(part)), strict=True))
        return self.rows[np.array(list(map(store.__getitem__, tokens)), np.int64)]

    def scored(self, found: list[str]) -> np.ndarray:
        """Sum of the weights of every word's features, each bucket once and in order, over all words of one length at a time."""
        out = np.zeros((len(found), len(self.langs)), np.float32)
        sizes = np.array(list(map(len, found)), np.int64)
        for n in np.unique(sizes):
            of = np.flatnonzero(sizes == n)
            ids = features_of_length([found[i] for i in of], int(n), self.lexicons)
            counts = ids >= 0
            counts[:, 1:] &= ids[:, 1:] != ids[:, :-1]
            total = np.zeros((len(of), len(self.langs)), np.float32)
            for j in range(ids.shape[1]):
                total += self.weights[ids[:, j]] * counts[:, j, None]
            out[of] = total
        return out

    def marginals(self, potentials: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (chains, places, languages) by forward-backward over chains that are padded to one length."""
        return forward_backward(potentials, lengths, self.moves, False)[0]

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "lexicons": self.lexicons, "weights": self.weights, "moves": self.moves}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["langs"], state["lexicons"])
        self.weights, self.moves = state["weights"], state["moves"]


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, moves: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every place and, if counted, the expected number of moves; places beyond a chain's length are zero."""
    n, places, k = potentials.shape
    e = np.exp(potentials - potentials.max(axis=2, keepdims=True)).astype(np.float64)
    t = np.exp(moves)
    inside = np.arange(places)[None, :] < lengths[:, None]
    alpha, beta = np.zeros((places, n, k)), np.ones((places, n, k))
    alpha[0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, places):
        a = alpha[i - 1] @ t * e[:, i]
        alpha[i] = a / a.sum(axis=1, keepdims=True)
    for i in range(places - 2, -1, -1):
        b = (e[:, i + 1] * beta[i + 1]) @ t.T
        beta[i] = np.where(inside[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    m = alpha * beta
    m /= m.sum(axis=2, keepdims=True)
    m *= inside.T[:, :, None]
    expected = np.zeros((k, k))
    for i in range(1, places if counted else 1):
        live = inside[:, i]
        if live.any():
            x = alpha[i - 1][live][:, :, None] * t[None] * (e[live, i] * beta[i][live])[:, None, :]
            expected += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return m.transpose(1, 0, 2), expected


def train(samples: list[tuple[str, str]]) -> Crf:
    """Fit the field on (text, language) pairs. No usable pair: a field without languages."""
    pairs = [(w, lang) for text, lang in samples if (w := words(text))]
    langs = sorted({lang for _, lang in pairs})
    counts = {lang: Counter() for lang in langs}
    for w, lang in pairs:
        counts[lang].update(w)
    lexicons: dict[str, int] = {}
    for i, lang in enumerate(langs):
        for w, c in counts[lang].most_common(LEXICON):
            if c > 1 and all(c >= counts[other][w] for other in langs):
                lexicons[w] = i
    crf = Crf(langs, lexicons)
    if len(langs) < 2:
        return crf
    rng = np.random.default_rng(0)
    # Stretches of one language, dealt into chains at random.
    pieces = []
    for w, lang in pairs:
        pieces += [(w[at : at + SWITCH], langs.index(lang)) for at in range(0, len(w), SWITCH)]
    known: dict[str, np.ndarray] = {}
    for w, _ in pieces:
        for x in w:
            if x not in known:
                known[x] = np.array(features(x, lexicons))
    k, per = len(langs), CHAIN // SWITCH
    square, square_moves = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    # About half of the borders between stretches keep the language, as most text does.
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        order = np.concatenate([np.sort(part) if i % 2 else part for i, part in enumerate(np.array_split(order, max(1, len(order) // per)))])
        chains = [order[i : i + per] for i in range(0, len(order), per)]
        for at in range(0, len(chains), 64):
            batch = [[(x, pieces[p][1]) for p in chain for x in pieces[p][0]] for chain in chains[at : at + 64]]
            lengths = np.array([len(c) for c in batch])
            width = int(lengths.max())
            pot = np.zeros((len(batch), width, k), np.float32)
            gold = np.zeros((len(batch), width, k))
            where = []
            for i, c in enumerate(batch):
                for j, (x, y) in enumerate(c):
                    pot[i, j] = crf.weights[known[x]].sum(axis=0)
                    gold[i, j, y] = 1
                    where.append(known[x])
            m, expected = forward_backward(pot, lengths, crf.moves)
            inside = np.arange(width)[None, :] < lengths[:, None]
            error = (m - gold)[inside]
            flat = np.concatenate(where)
            repeat = np.repeat(error, [len(x) for x in where], axis=0)
            grad = np.stack([np.bincount(flat, repeat[:, c], BUCKETS) for c in range(k)], axis=1) / len(batch) + DECAY * crf.weights
            square += grad**2
            crf.weights -= (RATE * grad / np.sqrt(square)).astype(np.float32)
            seen = np.einsum("ija,ijb->ab", gold[:, :-1], gold[:, 1:])
            g = (expected - seen) / len(batch)
            square_moves += g**2
            crf.moves -= RATE * g / np.sqrt(square_moves)
    return crf


def predict(crf: Crf, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text: the mean probability of the language over all words of the text."""
    tokens = [words(t) for t in texts]
    out = [(UNKNOWN, 0.0)] * len(texts)
    if not crf.langs:
        return out
    sums, chains = np.zeros((len(texts), len(crf.langs))), []
    for d, w in enumerate(tokens):
        chains += [(d, w[at : at + CHAIN]) for at in range(0, len(w), CHAIN)]
    chains.sort(key=lambda c: len(c[1]))
    for at in range(0, len(chains), 512):
        part = chains[at : at + 512]
        lengths = np.array([len(w) for _, w in part])
        pot = np.zeros((len(part), int(lengths.max()), len(crf.langs)), np.float32)
        pot[np.arange(pot.shape[1])[None, :] < lengths[:, None]] = crf.potentials([x for _, w in part for x in w])
        np.add.at(sums, [d for d, _ in part], crf.marginals(pot, lengths).sum(axis=1))
    for d, w in enumerate(tokens):
        if w:
            best = int(sums[d].argmax())
            out[d] = (crf.langs[best], float(min(1.0, sums[d][best] / len(w))))
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text is a multiple of 5 (null id: yes)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(documents: DataFrame, sample: int = SAMPLE) -> Crf:
    """Train on at most ``sample`` documents of each language, chosen by a hash of the id among those not held out; of rows with one id and language, the least text counts.

    Languages are counted first, and only ids whose hash is so small that some eight times the sample remain are ranked, so
    a frequent language does not meet in one task. Texts are read for the chosen ids alone, so ``sample`` texts of a language come to the driver.
    More than ``MOST_LANGUAGES`` languages raise ValueError. Without usable rows, as in an empty table, nothing is learned.
    """
    usable = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("size")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not sizes:
        return train([])
    size = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], float(r["size"]))]), F.col("lang"))
    drawn = usable.select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 1).alias("draw"))
    # Rows of one id have one draw; each language gets the sample's least draws.
    near = drawn.where(F.col("draw") / float(1 << 63) * size <= 8.0 * sample).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    ids = sorted({r["doc_id"] for r in near.withColumn("place", place).where(F.col("place") <= sample).collect()})
    if not ids:
        return train([])
    texts = usable.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return train(sorted((r["text"], r["lang"]) for r in texts.collect()))


def labelled(documents: DataFrame, crf: Crf, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with two columns more, predicted language and score; all others are carried as they are, whatever their names.

    The two must be new names. Rows may repeat, or lack a doc_id; every text is labelled whole, in chains, so a long one takes memory in proportion.
    """
    model = documents.sparkSession.sparkContext.broadcast(crf)
    names = [c for c in documents.columns if c != "text"]
    schema = ", ".join(["text string", *[f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names], f"`{lang}` string, `{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = predict(crf, part.column(0).to_pylist())
                cols = [*part.columns, pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, lang, score])

    return mapped(documents.select("text", *names), run, schema)


def identify(documents: DataFrame) -> DataFrame:
    """Predicted language of every whole text, one row per input row.

    ``und`` with score 0 where a text is null, empty or has no letter, or where nothing was learned. Learning looks at text and
    lang of documents that are not held out; a prediction looks at the text alone, so repeated rows get the same. A null doc_id is held out.
    Columns other than doc_id, text and lang are not read, whatever their names; an empty table gives no rows.
    """
    crf = fit(documents.select("doc_id", "text", "lang"))
    out = labelled(documents.select("doc_id", "text"), crf)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
