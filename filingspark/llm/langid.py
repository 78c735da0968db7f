"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters (ASCII letters and all non-ASCII characters) of the lower-cased text.
Its features are the byte 2-, 3- and 4-grams of the word between two boundary marks - those that
hold a mark are its affixes - and its entry, if any, in a lexicon of words counted while fitting.
The chain's transitions are learned on code-switched sequences put together from stretches of
documents of different languages. Forward-backward labels every word of a text; the text's language
is the one with the largest sum of marginals, weighted by word length, and the score its share.

Fitting uses at most `per_language` documents of each language, those with the least hash, and of a
document at most `train_chars` characters, a stretch from a place that its id hashes to; with many
languages fewer documents of each, so that they are at most `most_documents` in all. Prediction reads
every text whole, as one chain: features are made for WINDOW bytes and labelled for PART words at a
time, and what the chain carries over is carried exactly, so memory per byte has a bound.

Defined results: null text, and text without a letter, gives `und` with score 0; so does every
text if there is nothing to learn from. Ties go to the language first in order. Repeated rows come
out as often as they went in; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingspark.llm import crf
from filingspark.llm.common import crc_bucket, flat_text, hash_place, run_sums, stretch, text_chunks, to_batch

UND = "und"
WINDOW, PART = 2 << 20, 1 << 18
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_TABLE = (1 << 16, 1 << 16, 1 << 17)
NONE = sum(_TABLE)  # the row that always weighs nothing
_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(256)], dtype=np.uint64)


class Words:
    """The words of some texts, one text per row of a column: per word the place of the mark before
    it, its length, text and hash. Place p is the byte p - 1 of the texts, each ended by a line end;
    place 0 is a mark."""

    def __init__(self, column: pa.Array):
        lowered = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        self.data, offsets = flat_text(lowered)
        letter = np.concatenate([[False], _LETTER[self.data], [False]])
        self.at = np.flatnonzero(letter[1:] & ~letter[:-1])
        self.size = np.flatnonzero(letter[:-1] & ~letter[1:]) - self.at
        self.doc = np.searchsorted(offsets, self.at, side="right") - 1
        self.first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(self.at) else np.zeros(0, dtype=bool)
        self.end = len(self.data) + 1
        self.hash = self._hashes()

    def _window(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (marks as 32) and whether they are letters, of places a to b and three beyond."""
        raw = self.data[max(a - 1, 0) : b + 2]
        raw = np.concatenate([np.full(1 if a == 0 else 0, 32, dtype=np.uint8), raw])
        raw = np.concatenate([raw, np.full(b + 3 - a - len(raw), 32, dtype=np.uint8)])
        letter = _LETTER[raw]
        return np.where(letter, raw, 32).astype(np.uint32), letter

    def _hashes(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, dtype=np.uint64)

        def value(a: int, b: int) -> np.ndarray:
            c, letter = self._window(a, b)
            i, j = np.searchsorted(self.at, [a, b])
            word = np.cumsum(np.bincount(self.at[i:j] - a, minlength=b - a)) + (i - 1)
            pos = (np.arange(a, b) - self.at[word] - 1) & 255
            return np.where(letter[: b - a], (c[: b - a].astype(np.uint64) + np.uint64(7)) * _POWERS[pos], np.uint64(0))

        with np.errstate(over="ignore"):
            h = run_sums(value, self.at, self.end, WINDOW)
            return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)

    def grams(self, a: int, b: int) -> list[np.ndarray]:
        """The table rows of the 2-, 3- and 4-grams that begin at places a to b."""
        c, letter = self._window(a, b)
        n = b - a
        l0, l1, l2 = letter[:n], letter[1 : n + 1], letter[2 : n + 2]
        c0, c1, c2, c3 = (c[i : n + i] for i in range(4))
        two = np.where(l0 | l1, c0 | c1 << 8, NONE).astype(np.int32)
        tri = c0 | c1 << 8 | c2 << 16
        three = np.where(l1, _TABLE[0] + ((tri * np.uint32(2654435761)) >> 16), NONE).astype(np.int32)
        four = np.where(l1 & l2, _TABLE[0] + _TABLE[1] + (((tri * np.uint32(2246822519)) ^ (c3 * np.uint32(3266489917))) * np.uint32(668265263) >> 15), NONE).astype(np.int32)
        return [two, three, four]


@dataclass
class Model:
    languages: list[str]
    weights: list[np.ndarray]
    lexicon: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def lexicon_rows(self, h: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(h), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[i] == h, i + 1, 0)

    def scores(self, w: Words, lex: np.ndarray, i: int, j: int) -> np.ndarray:
        """Label scores of the words i to j."""
        table, words = self.weights

        def value(a: int, b: int) -> np.ndarray:
            two, three, four = w.grams(a + base, b + base)
            total = table[two]
            total += table[three]
            total += table[four]
            return total

        if i == j:
            return np.zeros((0, len(self.languages)))
        base = int(w.at[i])
        stop = int(w.at[j]) if j < len(w.at) else w.end
        return run_sums(value, w.at[i:j] - base, stop - base, WINDOW).astype(np.float64) + words[lex[i:j]]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and the shares [n, L] of every text."""
        n, k = len(column), len(self.languages)
        if not k:
            return [UND] * n, np.zeros(n), np.zeros((n, 0))
        total = np.zeros((n, k))
        w = Words(column)
        lex = self.lexicon_rows(w.hash)
        parts = max(1, -(-len(w.at) // PART))
        span = lambda i: (i * PART, min(len(w.at), (i + 1) * PART))
        for i, p in crf.posteriors(lambda i: (self.scores(w, lex, *span(i)), w.first[slice(*span(i))]), parts, self.trans, self.start):
            at = slice(*span(i))
            total += np.stack([np.bincount(w.doc[at], p[:, j] * w.size[at], n) for j in range(k)], axis=1)
        mass = total.sum(axis=1)
        share = total / np.maximum(mass, 1e-300)[:, None]
        best = share.argmax(axis=1)
        known = has_letter(column) & (mass > 0)
        return [self.languages[b] if ok else UND for b, ok in zip(best.tolist(), known.tolist())], np.where(known, np.minimum(share.max(axis=1), 1.0), 0.0), share


def has_letter(column: pa.Array) -> np.ndarray:
    plain = pc.fill_null(pc.match_substring_regex(column, "[A-Za-z]"), False).to_numpy(zero_copy_only=False).astype(bool)
    for i in np.flatnonzero(~plain).tolist():
        plain[i] = any(map(str.isalpha, column[i].as_py() or ""))
    return plain


def train(texts: list[str], labels: list[str], *, rounds: int = 30, lexicon_size: int = 20_000, seed: int = 5) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], [], np.zeros(0, dtype=np.uint64), np.zeros((0, 0)), np.zeros(0))
    w, k = Words(pa.array(texts, type=pa.large_string())), len(languages)
    number = {x: i for i, x in enumerate(languages)}
    y_doc = np.array([number[x] for x in labels])
    found, counts = np.unique(w.hash, return_counts=True)
    often = np.argsort(-counts, kind="stable")[:lexicon_size]
    lexicon = np.sort(found[often][counts[often] >= 3])
    model = Model(languages, [], lexicon, np.zeros((k, k)), np.zeros(k))
    lex = model.lexicon_rows(w.hash)
    rng = np.random.default_rng(seed)
    # stretches of 4 to 40 words, dealt at random into sequences of about five
    cuts = np.cumsum(rng.integers(4, 41, size=len(w.at) // 4 + 2))
    doc_starts = np.flatnonzero(np.concatenate([[True], w.doc[1:] != w.doc[:-1]])) if len(w.doc) else np.zeros(0, dtype=int)
    bounds = np.unique(np.concatenate([cuts[cuts < len(w.at)], doc_starts, [0]])).astype(int)
    stops = np.append(bounds[1:], len(w.at))
    order = rng.permutation(len(bounds))
    perm = np.concatenate([np.arange(bounds[i], stops[i]) for i in order]) if len(w.at) else np.zeros(0, dtype=int)
    first = np.zeros(len(perm), dtype=bool)
    if len(perm):
        first[np.cumsum([0, *(stops - bounds)[order][:-1]])[::5]] = True
    y = y_doc[w.doc][perm]
    grams = w.grams(int(w.at[0]), w.end) if len(w.at) else [np.zeros(0, dtype=np.int32)] * 3
    span = np.repeat(np.arange(len(w.at)), np.diff(np.append(w.at, w.end)))
    back = np.argsort(perm)

    def pull(grad: np.ndarray) -> list[np.ndarray]:
        g = grad[back]
        by_row = np.empty((NONE + 1, k), dtype=np.float32)
        for j in range(k):
            at = g[:, j][span]
            by_row[:, j] = sum(np.bincount(x, at, NONE + 1) for x in grams)
        by_row[NONE] = 0
        by_word = np.stack([np.bincount(lex, g[:, j], len(lexicon) + 1) for j in range(k)], axis=1)
        by_word[0] = 0
        return [by_row, by_word]

    def emit(ws: list[np.ndarray]) -> np.ndarray:
        if not len(w.at):
            return np.zeros((0, k))
        total = ws[0][grams[0]]
        total += ws[0][grams[1]]
        total += ws[0][grams[2]]
        return (np.add.reduceat(total, w.at - w.at[0], axis=0).astype(np.float64) + ws[1][lex])[perm]

    weights = [np.zeros((NONE + 1, k), dtype=np.float32), np.zeros((len(lexicon) + 1, k))]
    model.weights, model.trans, model.start = crf.fit(emit, pull, weights, y, first, k, rounds=rounds, rate=0.15, l2=0.5)
    return model


def fit(documents: DataFrame, *, held_out_mod: int = 5, per_language: int = 120, most_documents: int = 6000, train_chars: int = 10_000) -> Model:
    """A model of the rows whose crc32(doc_id as text) mod held_out_mod is not 0."""
    rows = documents.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.coalesce(crc_bucket(F.col("doc_id"), held_out_mod), F.lit(1)) != 0))
    totals = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    per = max(1, min(per_language, most_documents // max(1, len(totals))))
    # Hashes spread evenly, so rows under this share of their range hold the `per` least of each
    # language, unless copies of one id crowd them; only these few come to the driver.
    share = F.lit(0.0)
    for size in sorted({t.bit_length() for t in totals.values()}):
        names = [x for x, t in totals.items() if t.bit_length() == size]
        share = F.when(F.col("lang").isin(names), (2.0 * per + 20) / (1 << size - 1)).otherwise(share)
    place = hash_place("doc_id")
    found = rows.where(F.coalesce(place, F.lit(0.0)) <= share).select(place.alias("place"), "doc_id", "lang", stretch("text", "doc_id", train_chars).alias("text")).distinct().collect()
    chosen: list[tuple] = []
    taken: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (r[0] is None, r[0] or 0.0, r[2], r[3])):
        taken[r[2]] = taken.get(r[2], 0) + 1
        if taken[r[2]] <= per:
            chosen.append((r[1] is None, r[1] if r[1] is not None else 0, r[2], r[3]))
    chosen.sort()
    return train([r[3] for r in chosen], [r[2] for r in chosen])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    docs = documents.select("doc_id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", 1 << 20):
            lang, score, _ = shared.value.predict(part.column("text"))
            yield to_batch({"doc_id": part.column("doc_id"), "lang_pred": lang, "score": score}, schema)

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, lang_pred string, score double")


def reject(documents: DataFrame, model: Model, least_share: float) -> DataFrame:
    """documents, all columns, without those of no language or whose language has a smaller share."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", 1 << 20):
            lang, score, _ = shared.value.predict(part.column("text"))
            yield part.filter(pa.array([x != UND and s >= least_share for x, s in zip(lang, score.tolist())], type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
