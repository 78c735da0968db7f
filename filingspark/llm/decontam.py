"""Benchmark decontamination: a broadcast hash set of benchmark word windows.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`
after lower-casing A-Z, which on UTF-8 is a matter of bytes. A window is `width` consecutive
words of a benchmark item; an item with fewer words, but not none, is one window. Each task maps
words to the benchmark's vocabulary, finds places where a whole window could stand (all words
known), looks their 64-bit rolling hash up in the sorted hash array and verifies each hit word by
word, so no collision counts.

Defined results: null or empty text has no words and no hits; a repeated row is scanned like any
other and comes out as often as it went in; an empty benchmark hits nothing; a benchmark item that
is null or has no words has no windows; other columns are ignored.

The broadcast has a bound: a benchmark of more than `block_chars` characters (about three bytes each
in the index) is cut into blocks,
each broadcast alone and scanned in its own pass, and a document's spans are then merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingspark.llm.common import free_name, text_chunks, to_batch

_LOWER = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c < 58 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


@dataclass
class WindowIndex:
    """Windows of one block of the benchmark, by length: their hashes in order, and where in the
    block's words each begins."""

    width: int
    vocab: dict[bytes, int]
    words: np.ndarray
    items: list
    item_starts: np.ndarray
    hashes: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    _met: dict[bytes, tuple] = field(default_factory=dict)

    @classmethod
    def build(cls, items: Iterable[tuple], width: int) -> WindowIndex:
        vocab: dict[bytes, int] = {}
        parts, ids = [], []
        for item_id, text in items:
            found = words_of(text)
            if found:
                parts.append(np.fromiter((vocab.setdefault(w, len(vocab) + 1) for w in found), dtype=np.uint32, count=len(found)))
                ids.append(item_id)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        hashes, places = {}, {}
        for k in np.unique(np.minimum(sizes, width)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, width) == k)
            counts = sizes[mine] - k + 1
            at = np.repeat(starts[mine] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            h = _roll([words[at + j] for j in range(k)])
            order = np.argsort(h, kind="stable")
            hashes[k], places[k] = h[order], at[order].astype(np.uint32)
        return cls(width, vocab, words, ids, starts, hashes, places)

    def __getstate__(self):
        return self.__dict__ | {"_met": {}}

    def items_of(self, window: np.ndarray, h: int, k: int) -> tuple:
        """The items that hold a window of words with that hash; the last ones asked are remembered."""
        key = window.tobytes()
        if key not in self._met:
            if len(self._met) >= 50_000:
                self._met.clear()
            low, high = np.searchsorted(self.hashes[k], h, side="left"), np.searchsorted(self.hashes[k], h, side="right")
            at = self.places[k][low:high].astype(np.int64)
            same = np.ones(len(at), dtype=bool)
            for j in range(k):
                same &= self.words[at + j] == window[j]
            rows = np.unique(np.searchsorted(self.item_starts, at[same], side="right") - 1)
            self._met[key] = tuple({self.items[i] for i in rows.tolist()})
        return self._met[key]

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
        """Per text: number of words, (first word, word count) of each verified window, item ids."""
        get, lengths, parts = self.vocab.get, [], []
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            parts.append(np.fromiter((get(w, 0) for w in words), dtype=np.uint32, count=len(words)))
            parts.append(np.zeros(1, dtype=np.uint32))
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64) + 1)])
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        for k, table in self.hashes.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            h = _roll([ids[at + j] for j in range(k)])
            hit = table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h
            at, h = at[hit], h[hit]
            for i, code, doc in zip(at.tolist(), h, (np.searchsorted(starts, at, side="right") - 1).tolist()):
                if found := self.items_of(ids[i : i + k], code, k):
                    spans[doc].append((i - int(starts[doc]), k))
                    items[doc].update(found)
        return lengths, spans, items


def _roll(columns) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h + c.astype(np.uint64)) * _PRIME
            h ^= h >> np.uint64(29)
    return h


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, end) of the union of (first, count) spans."""
    out: list[tuple[int, int]] = []
    for first, count in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], first + count))
        else:
            out.append((first, first + count))
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> int:
    size = benchmark.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-int(size) // block_chars))


def _raw_schema(id_type: pa.DataType, item_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(item_type))])


def scan(documents: DataFrame, benchmark: DataFrame, *, width: int = 13, block_chars: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, n_words, spans (merged [first, end) word ranges), items (sorted as
    strings). documents needs doc_id and text, benchmark item_id and text."""
    return _scan(documents, benchmark, width, block_chars).drop("text_hash")


def _scan(documents: DataFrame, benchmark: DataFrame, width: int, block_chars: int) -> DataFrame:
    """scan, with text_hash, which with doc_id tells rows apart that are not equal."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    bench = benchmark.select("item_id", "text")
    n_blocks = _blocks(bench, block_chars)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, n_words bigint, spans array<array<bigint>>, items array<{bench.schema['item_id'].dataType.simpleString()}>"
    from pyspark.sql.pandas.types import to_arrow_type

    schema = _raw_schema(to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(bench.schema["item_id"].dataType))

    def scanner(block: int):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        index = spark.sparkContext.broadcast(WindowIndex.build(((r[0], r[1]) for r in rows), width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_chunks(batches, "text"):
                lengths, spans, items = index.value.scan(part.column("text").to_pylist())
                yield to_batch({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n_words": lengths, "spans": [merge_spans(s) for s in spans], "items": [sorted(x, key=str) for x in items]}, schema)

        return docs.mapInArrow(run, ddl)

    found = scanner(0)
    if n_blocks == 1:
        return found
    # Every pass reads all documents; after the first, only documents with hits come out. Rows of
    # equal id and text have equal hits, so they meet as one and come apart again by their number.
    found = found.withColumn("rows", F.lit(1))
    for block in range(1, n_blocks):
        found = found.unionByName(scanner(block).where(F.size("spans") > 0).withColumn("rows", F.lit(0)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [merge_spans((s[0], s[1] - s[0]) for s in x) for x in b.column("spans").to_pylist()]
            items = [sorted(set(x), key=str) for x in b.column("items").to_pylist()]
            yield to_batch({"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "n_words": b.column("n_words"), "spans": spans, "items": items}, schema)

    whole = found.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"), F.sum("rows").alias("rows"))
    return whole.select("doc_id", "text_hash", "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("col").mapInArrow(merged, ddl)


def report(documents: DataFrame, benchmark: DataFrame, *, width: int = 13, block_chars: int = 8 << 20) -> DataFrame:
    """The scan with its digest columns; a document is contaminated if hit words make up a
    twentieth of it or more."""
    found = scan(documents, benchmark, width=width, block_chars=block_chars)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.transform("items", lambda x: x.cast("string")).alias("items"),
        "spans",
    )


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words in the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, end = [], 0
    for first, stop in spans:
        out.append(raw[end : at[first][0]])
        end = at[stop - 1][1]
    return b"".join([*out, raw[end:]]).decode()


def _cut(text: str, ranges: list[tuple[int, int]], n_words: int) -> str | None:
    """text without the words in ranges; None if they make up a twentieth of it or more."""
    hit = sum(b - a for a, b in ranges)
    return None if hit and 20 * hit >= n_words else remove_words(text, ranges) if hit else text


def _with_text(part: pa.RecordBatch, texts: list[str | None], keep: list[bool]) -> pa.RecordBatch:
    k = part.schema.get_field_index("text")
    return part.set_column(k, part.schema.field(k), pa.array(texts, type=part.schema.field(k).type)).filter(pa.array(keep, type=pa.bool_()))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, width: int = 13, block_chars: int = 8 << 20) -> DataFrame:
    """documents, all columns, without the contaminated ones; from the others every hit span is cut.

    A benchmark of one block is scanned and cut in one pass without a shuffle. Of a larger one the
    spans of all blocks meet first and are joined to the documents by id and text hash."""
    rows = benchmark.select("item_id", "text")
    if _blocks(rows, block_chars) > 1:
        _id, _hash, _spans, _words = (free_name(x, documents) for x in ("_id", "_hash", "_spans", "_words"))
        found = _scan(documents, rows, width, block_chars).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias(_id), F.col("text_hash").alias(_hash)).agg(F.first("spans").alias(_spans), F.first("n_words").alias(_words))
        joined = documents.join(found, documents["doc_id"].eqNullSafe(F.col(_id)) & (F.xxhash64(documents["text"]) == F.col(_hash)), "left")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_chunks(batches, "text"):
                cut = [t if not r else _cut(t, r, n) for t, r, n in zip(part.column("text").to_pylist(), part.column(_spans).to_pylist(), part.column(_words).to_pylist())]
                keep = [not r or c is not None for c, r in zip(cut, part.column(_spans).to_pylist())]
                yield _with_text(part, cut, keep).select(documents_columns)

        documents_columns = documents.columns
        return joined.select(*documents.columns, _spans, _words).mapInArrow(apply, documents.schema)
    index = documents.sparkSession.sparkContext.broadcast(WindowIndex.build(((r[0], r[1]) for r in rows.collect()), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            texts = part.column("text").to_pylist()
            lengths, spans, _ = index.value.scan(texts)
            cut = [_cut(t, merge_spans(s), n) if s else t for t, s, n in zip(texts, spans, lengths)]
            yield _with_text(part, cut, [not s or c is not None for c, s in zip(cut, spans)])

    return documents.mapInArrow(run, documents.schema)
