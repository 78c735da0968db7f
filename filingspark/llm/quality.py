"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are shares of kinds of bytes and
words in it (capitals, exclamation marks, pipes, symbols, digits, repeated words, word length), its
own length, whether it occurs before in the document, and the same shares of the line before and
the line after. Fitted weakly: each line carries its document's label. Forward-backward gives each
line's probability of being good; their mean weighted by length, on the log-odds scale, goes
through a logistic curve fitted on the same rows to give the document's score.

Fitting uses at most `per_class` labelled rows of each class, those with the least hash, and of a
text at most `train_chars` characters, a stretch from a place that its id hashes to. Scoring reads
every text whole, as one chain: bytes are looked at WINDOW at a time and lines labelled PART at a
time, and what the chain carries over is carried exactly, so memory per byte has a bound.

Defined results: null, empty and all-newline texts get the share of label 1 among the rows fitted
(0.5 if there are none), as do all texts if only one class or no label is known; repeated rows come
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

_KIND = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 !, 5 |, 6 symbol, 7 . , ; : ? ' " ( ) -, 8 space
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[33] = 4
_KIND[124] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    _KIND[_c] = 6
for _c in b".,;:?'\"()-":
    _KIND[_c] = 7
for _c in b" \t\r\n\x0b\x0c":
    _KIND[_c] = 8
_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(4096)], dtype=np.uint64)


WINDOW, PART = 2 << 20, 1 << 16


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stop: int) -> np.ndarray:
    """A 64-bit hash of every run of bytes that begins at `starts` and has a size, up to stop."""

    def value(a: int, b: int) -> np.ndarray:
        i, j = np.searchsorted(starts, [a, b])
        run = np.cumsum(np.bincount(starts[i:j] - a, minlength=b - a)) + (i - 1)
        pos = np.arange(a, b) - starts[run]
        return np.where(pos < sizes[run], (data[a:b].astype(np.uint64) + np.uint64(11)) * _POWERS[pos & 4095], np.uint64(0))

    with np.errstate(over="ignore"):
        h = run_sums(value, starts, stop, WINDOW)
        return (h ^ (h >> np.uint64(29)) ^ sizes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """The lines of some texts, one text per row of a column, with their sizes, texts and own shares."""

    def __init__(self, column: pa.Array):
        ended = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), ""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        data, offsets = flat_text(ended)
        stop = np.flatnonzero(data == 10)
        start = np.concatenate([[0], stop[:-1] + 1])[: len(stop)]
        n = len(stop)
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        self.first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if n else np.zeros(0, dtype=bool)
        self.size = (stop - start).astype(np.float64)
        if not n:
            self.own, self.shares = np.zeros((0, 6)), np.zeros((0, 21))
            return
        count = lambda k: run_sums(lambda a, b: (_KIND[data[a:b]] == k).astype(np.int32), start, len(data), WINDOW).astype(np.float64)
        size = self.size
        lower, upper, digit, bang, pipe, symbol, point = (count(k) for k in range(1, 8))
        solid = np.concatenate([[False], _KIND[data] != 8])
        w_start = np.flatnonzero(solid[1:] & ~solid[:-1])
        words, again, fresh = np.zeros(n), np.zeros(n), np.zeros(n)
        if len(w_start):
            h = _hashes(data, w_start, np.flatnonzero(solid[:-1] & ~solid[1:]) - w_start, len(data))
            line = np.searchsorted(start, w_start, side="right") - 1
            words = np.bincount(line, minlength=n).astype(np.float64)
            same = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
            again = np.bincount(line[1:][same], minlength=n).astype(np.float64)
            order = np.lexsort((h, line))
            hs, ls = h[order], line[order]
            new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])])
            fresh = np.bincount(ls[new], minlength=n).astype(np.float64)
        line_hash = _hashes(data, start, stop - start + 1, len(data))
        order = np.lexsort((np.arange(n), line_hash, self.doc))
        seen = np.zeros(n)
        seen[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        letters, total = np.maximum(lower + upper, 1), np.maximum(size, 1)
        per_word = np.maximum(words, 1)
        shares = np.stack([upper / letters, bang / per_word, pipe / per_word, symbol / total, digit / total, again / per_word, 1 - fresh / per_word], axis=1)
        self.shares = np.concatenate([shares, np.sqrt(np.clip(shares, 0, 1)), np.minimum(1, shares * 8)], axis=1)
        self.own = np.stack([np.ones(n), np.log1p(size) / 5, np.minimum((lower + upper) / per_word, 30) / 10, np.minimum(point / per_word, 2), seen, words <= 2], axis=1)

    def features(self, i: int, j: int) -> np.ndarray:
        """Features of the lines i to j: their own, and the shares of the lines beside them."""
        near = np.zeros((j - i + 2, self.shares.shape[1]))
        low, high = max(i - 1, 0), min(j + 1, len(self.size))
        near[low - i + 1 : high - i + 1] = self.shares[low:high]
        before, after = near[:-2].copy(), near[2:].copy()
        before[self.first[i:j]] = 0
        last = np.append(self.first[i + 1 : j + 1], np.ones(max(0, j + 1 - len(self.size)), dtype=bool))
        after[last] = 0
        return np.concatenate([self.own[i:j], near[1:-1], before, after], axis=1)


@dataclass
class Model:
    weights: np.ndarray | None
    trans: np.ndarray | None
    start: np.ndarray | None
    curve: np.ndarray | None
    base: float

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean log-odds and mean probability of good, and whether a text has any length."""
        n = len(column)
        mass, odds, mean = np.zeros(n), np.zeros(n), np.zeros(n)
        lines = Lines(column)
        parts = max(1, -(-len(lines.size) // PART))
        span = lambda i: (i * PART, min(len(lines.size), (i + 1) * PART))

        def part(i: int) -> tuple[np.ndarray, np.ndarray]:
            z = lines.features(*span(i)) @ self.weights
            return np.stack([np.zeros_like(z), z], axis=1), lines.first[slice(*span(i))]

        for i, p in crf.posteriors(part, parts, self.trans, self.start):
            at = slice(*span(i))
            good, doc, size = np.clip(p[:, 1], 1e-6, 1 - 1e-6), lines.doc[at], lines.size[at]
            mass += np.bincount(doc, size, n)
            odds += np.bincount(doc, size * np.log(good / (1 - good)), n)
            mean += np.bincount(doc, size * good, n)
        odds, mean = odds / np.maximum(mass, 1), mean / np.maximum(mass, 1)
        return np.stack([np.ones(n), odds, mean], axis=1), mass > 0

    def score(self, column: pa.Array) -> np.ndarray:
        if self.weights is None or not len(column):
            return np.full(len(column), self.base)
        x, some = self.evidence(column)
        return np.where(some, 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30))), self.base)


def train(texts: list[str], labels: list[int], *, rounds: int = 150, base: float | None = None) -> Model:
    y = np.array(labels, dtype=np.int64)
    base = base if base is not None else float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return Model(None, None, None, None, base)
    column = pa.array(texts, type=pa.large_string())
    lines = Lines(column)
    truth = y[lines.doc]
    x = lines.features(0, len(lines.size))
    # the classes weigh alike in the chain; the logistic curve puts the base rate back
    fitted, trans, start = crf.fit(lambda ws: np.stack([np.zeros(len(x)), x @ ws[0]], axis=1), lambda g: [x.T @ g[:, 1]], [np.zeros(x.shape[1])], truth, lines.first, 2, rounds=rounds, rate=0.2, l2=1.0)
    model = Model(fitted[0], trans, start, None, base)
    features, some = model.evidence(column)
    weight = np.where(y == 1, base / max(y.mean(), 1e-9), (1 - base) / max(1 - y.mean(), 1e-9))
    rows = np.flatnonzero(some)
    # resample to the base rate by repeating rows in proportion to their weights
    times = np.maximum(1, np.round(weight / weight.min())).astype(int)
    index = np.repeat(rows, times[rows])
    model.curve = crf.logistic(features[index], y[index].astype(float))
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, *, held_out_mod: int, held_out: int, per_class: int, train_chars: int) -> tuple[list[tuple], float]:
    """(doc_id, text, label) of a bounded sample, and the share of label 1 among all rows that may
    be learned from; a doc_id of both labels counts as 0. Of a longer text a stretch is taken. The
    sample's ids, at most 2 * per_class, are the broadcast side."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), held_out_mod) != held_out)).select("doc_id", F.col(label).alias("label"))
    totals = {r[0]: (r[1], r[2]) for r in known.groupBy("label").agg(F.count(F.lit(1)), F.approx_count_distinct("doc_id", 0.02)).collect()}
    base = totals.get(1, (0, 0))[0] / max(1, sum(n for n, _ in totals.values()))
    # Hashes spread evenly, so ids under this share of their range hold the per_class least of each
    # class; only these few come to the driver, which takes the least.
    share = lambda k: (2.0 * per_class + 50) / max(1, totals.get(k, (0, 0))[1])
    near = known.withColumn("place", hash_place("doc_id")).where(F.col("place") <= F.when(F.col("label") == 1, share(1)).otherwise(share(0))).distinct().collect()
    label_of: dict = {}
    for r in sorted(near, key=lambda r: (r["place"], str(r["doc_id"]), r["label"])):
        label_of.setdefault(r["doc_id"], r["label"])
    chosen: dict = {}
    taken = [0, 0]
    for doc_id, value in label_of.items():
        taken[value] += 1
        if taken[value] <= per_class:
            chosen[doc_id] = int(value)
    if not chosen:
        return [], base if totals else 0.5
    keys = F.broadcast(documents.sparkSession.createDataFrame([(k,) for k in chosen], known.select("doc_id").schema))
    rows = documents.where(F.length("text") >= 0).join(keys, "doc_id", "left_semi").select("doc_id", stretch("text", "doc_id", train_chars).alias("text")).collect()
    return sorted({(r[0], r[1], chosen[r[0]]) for r in rows if r[0] in chosen}), base


def fit(documents: DataFrame, labels: DataFrame, *, held_out_mod: int = 4, held_out: int = 2, per_class: int = 1500, train_chars: int = 12_000) -> Model:
    rows, base = labelled_sample(documents, labels, "quality", held_out_mod=held_out_mod, held_out=held_out, per_class=per_class, train_chars=train_chars)
    return train([r[1] for r in rows], [r[2] for r in rows], base=base)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score."""
    docs = documents.select("doc_id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("score", pa.float64())])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", 1 << 20):
            yield to_batch({"doc_id": part.column("doc_id"), "score": shared.value.score(part.column("text"))}, schema)

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, score double")
