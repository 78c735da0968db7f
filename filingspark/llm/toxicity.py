"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton.

Text is lower-cased and folded first: accents go, look-alike letters of other alphabets, full-width
letters and digits or signs that stand for letters become Latin letters, and invisible characters
go. The lexicon holds whole words and word beginnings (stems); an entry's weight is a lower bound of
its log-odds between toxic and other documents. The automaton finds every entry; of the entries that
match at one word the heaviest counts, and a match inside an exception phrase does not. Exception
phrases are the caller's, and those learned: an entry's word with the word before or behind it, if
that pair stands surely more in clean documents than in toxic ones. A document's evidence is the sum
of its weights and that sum divided by its number of words, both as logarithms; a logistic curve
fitted on the learning rows turns them into the score.

Counting uses at most `per_class` labelled rows of each class, those with the least hash, and of a
text at most `train_chars` characters, a stretch from a place that its id hashes to; scoring reads
every text whole.

Defined results: null and empty texts, and all texts if nothing was learned, score the curve's
value without evidence (0.0 if there is no curve); repeated rows come out as often as they went in;
other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filingspark.llm import crf
from filingspark.llm.common import text_chunks, to_batch
from filingspark.llm.quality import labelled_sample

# Look-alikes: each character of the first string of a pair stands for the letter beside it.
HOMOGLYPHS = (
    ("аɑα", "a"), ("ЬЪв", "b"), ("сϲ", "c"), ("ԁ", "d"), ("еєε", "e"), ("һ", "h"), ("іıɩι", "i"), ("ј", "j"), ("кκ", "k"),
    ("ӏℓ", "l"), ("м", "m"), ("пո", "n"), ("оοօσ", "o"), ("рρ", "p"), ("ԛ", "q"), ("г", "r"), ("ѕ", "s"), ("тτ", "t"),
    ("υս", "u"), ("ν", "v"), ("ѡω", "w"), ("хχ", "x"), ("уγ", "y"),
)
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INSIDE = {"!": "i", "|": "l"}  # between letters only: elsewhere they are signs
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_FOLD: dict[int, str | None] = {ord(c): to for group, to in HOMOGLYPHS for c in group}
_FOLD |= {ord(c): None for c in INVISIBLE}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_ODD = re.compile(f"[{''.join(map(chr, _FOLD))}]")
_SUB = str.maketrans(SUBSTITUTES)
# A run of letters, digits and signs that holds a substitute, from its beginning; possessive, so that
# long runs cost their length. The substitute counts if the run holds a letter.
_MIXED = re.compile(r"(?<![\w@$])[^\W\d]*+[01345789@$][\w@$]*+")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"[01345789@$]")
_INSIDE = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")
_MARKS = re.compile("[\u0300-\u036f]+")
_BREAK = re.compile(r"[^\w]+|_+")


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if _ODD.search(text):
            text = text.translate(_FOLD)
    if "!" in text or "|" in text:
        text = _INSIDE.sub(lambda m: INSIDE[m[0]], text)
    if _DIGIT.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_SUB) if _LETTER.search(m[0]) else m[0], text)
    return text


def words_of(text: str | None) -> str:
    """The folded text's words between single spaces, with a space at both ends."""
    return " " + _BREAK.sub(" ", fold(text)).strip() + " "


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] | None = None
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            entries: dict[str, tuple[int, float]] = {f" {s}": (0, w) for s, w in self.stems.items()}
            entries |= {f" {t} ": (0, w) for t, w in self.words.items()}
            entries |= {words_of(p): (1, 0.0) for p in self.exceptions}
            for text, (kind, weight) in entries.items():
                a.add_word(text, (kind, len(text), weight))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def hits(self, text: str) -> dict[int, float]:
        """Word start -> weight, in a text made by words_of."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        a = self.automaton()
        if not len(a):
            return found
        for end, (kind, size, weight) in a.iter(text):
            start = end - size + 1
            if kind:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if not spared:
            return found
        inside = {i for b, e in spared for i in range(b, e)}
        return {s: w for s, w in found.items() if s not in inside}

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        spaced = words_of(text)
        total = sum(self.hits(spaced).values())
        n = max(1, spaced.count(" ") - 1)
        return 1.0, float(np.log1p(total)), float(np.log1p(100.0 * total / n))

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        x = sum(a * b for a, b in zip(self.curve, self.evidence(text)))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, x)))))


def log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int, z: float = 1.64) -> float:
    """A lower confidence bound of the log-odds that a document with the entry is toxic."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return float(ratio - z * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


def train(
    texts: list[str], labels: list[int], *, exceptions: tuple[str, ...] = (), stem_sizes: tuple[int, ...] = (4, 5, 6), least: int = 5, least_odds: float = 1.8, most: int = 5000
) -> Lexicon:
    """Entries in at least `least` toxic documents, after at least as many different words, whose
    log-odds are surely at least least_odds; at most `most` of each kind, the heaviest. A stem is left out if one word makes up half of it,
    or if a longer stem holds nearly all of it. exceptions: phrases in which no entry counts, beside
    those learned."""
    n = [labels.count(0), labels.count(1)]
    lexicon = Lexicon(exceptions=tuple(exceptions))
    if not all(n):
        return lexicon
    rows = [words_of(t).split() for t in texts]
    words, stems = (Counter(), Counter()), (Counter(), Counter())
    for row, label in zip(rows, labels):
        found = set(row)
        words[label].update(found)
        stems[label].update({w[:k] for w in found for k in stem_sizes if len(w) > k})

    def chosen(counts: tuple[Counter, Counter]) -> dict[str, float]:
        out = {}
        for t, c in counts[1].items():
            if c >= least and (w := log_odds(c, counts[0][t], n[1], n[0])) >= least_odds:
                out[t] = w
        return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:most])

    lexicon.words, found = chosen(words), chosen(stems)
    # In copies of one document a rare word always stands after the same word.
    after: dict[str, set[str]] = {}
    for row, label in zip(rows, labels):
        for before, w in zip(["", *row], row if label else []):
            if w in lexicon.words:
                after.setdefault(f" {w} ", set()).add(before)
            for k in stem_sizes:
                if len(w) > k and w[:k] in found:
                    after.setdefault(f" {w[:k]}", set()).add(before)
    lexicon.words = {t: w for t, w in lexicon.words.items() if len(after[f" {t} "]) >= least}
    found = {t: w for t, w in found.items() if len(after[f" {t}"]) >= least}
    longest_word, longer = Counter(), Counter()
    for t, c in words[1].items():
        for k in stem_sizes:
            longest_word[t[:k]] = max(longest_word[t[:k]], c * (len(t) > k))
    for s in found:
        for k in stem_sizes:
            if k < len(s):
                longer[s[:k]] = max(longer[s[:k]], stems[1][s])
    lexicon.stems = {s: w for s, w in found.items() if 1.25 * longer[s] < stems[1][s] and 2 * longest_word[s] < stems[1][s]}
    lexicon.exceptions += learned_exceptions(rows, labels, lexicon, n, least=least, most=most)
    x = np.array([lexicon.evidence(t) for t in texts])
    lexicon.curve = tuple(crf.logistic(x, np.array(labels, dtype=float), l2=1e-4).tolist())
    return lexicon


def learned_exceptions(rows: list[list[str]], labels: list[int], lexicon: Lexicon, n: list[int], *, least: int, most: int) -> tuple[str, ...]:
    """Pairs of neighbouring words, one of them an entry's, in at least `least` clean documents and
    between as many different words, whose log-odds of being clean are surely above zero."""
    sizes = {len(s) for s in lexicon.stems}
    entry = lambda w: w in lexicon.words or any(w[:k] in lexicon.stems for k in sizes if len(w) > k)
    pairs: tuple[Counter, Counter] = (Counter(), Counter())
    around: dict[str, set[tuple[str, str]]] = {}
    for row, label in zip(rows, labels):
        found = set()
        padded = ["", *row, ""]
        for i, w in enumerate(row):
            if entry(w):
                found.update({(j, f"{row[j]} {row[j + 1]}") for j in (i - 1, i) if 0 <= j < len(row) - 1})
        pairs[label].update({p for _, p in found})
        if not label:
            for j, p in found:
                around.setdefault(p, set()).add((padded[j], padded[j + 3]))
    out = {}
    for p, c in pairs[0].items():
        if c >= least and len(around[p]) >= least and (w := log_odds(c, pairs[1][p], n[0], n[1])) > 0:
            out[p] = w
    return tuple(p for p, _ in sorted(out.items(), key=lambda x: (-x[1], x[0]))[:most])


def fit(documents: DataFrame, labels: DataFrame, *, held_out_mod: int = 5, held_out: int = 0, per_class: int = 4000, train_chars: int = 12_000, exceptions: tuple[str, ...] = ()) -> Lexicon:
    rows, _ = labelled_sample(documents, labels, "toxic", held_out_mod=held_out_mod, held_out=held_out, per_class=per_class, train_chars=train_chars)
    return train([r[1] for r in rows], [r[2] for r in rows], exceptions=exceptions)


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document: doc_id, score."""
    docs = documents.select("doc_id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("score", pa.float64())])
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)  # at most 2 * most entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            yield to_batch({"doc_id": part.column("doc_id"), "score": [shared.value.score(t) for t in part.column("text").to_pylist()]}, schema)

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, score double")


def reject(documents: DataFrame, lexicon: Lexicon, threshold: float) -> DataFrame:
    """documents, all columns, without those that score threshold or more."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            yield part.filter(pa.array([shared.value.score(t) < threshold for t in part.column("text").to_pylist()], type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
