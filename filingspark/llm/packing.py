"""Harmonic packing of token sequences.

Documents' lengths fall into reciprocal-capacity classes: class j holds lengths in (capacity/(j+1),
capacity/j], and a sequence of class j takes exactly j documents, whole. Each task fills its classes
alone, so packing needs no shuffle and no talk between workers. A document longer than the capacity
is cut at the capacity; its full pieces are sequences of their own, and its tail is spare.

A sequence that has its j documents may have a gap. Sequences with gaps wait, about `hold` of them, and
their gaps are closed with spare pieces: the longest that fits, whole, and where none fits, the head
of a longer one. If the spare pieces do not suffice, the sequence with the widest gap is taken apart
and its documents become spare. What is spare after that falls into the classes like any document.
So a document that fits is cut only to close a gap, and full sequences need no padding. At a task's
end the documents of its unfilled classes are spare too, and what remains of them fills sequences by
the same rule, the last ones as long as the powers of two that sum to the rest, which need no padding.

Memory: a task holds fewer than j documents of each class, about `hold` waiting sequences and
`hold` spare pieces, each no longer than the capacity, and one chunk of texts.

Defined results: null and empty texts hold the end token alone; repeated rows are packed like any
other; an empty table gives no pieces; other columns are ignored. Sequence ids are the task's
number times 2**40 plus a count, so they are unique, not dense.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from filingspark.llm.common import KEPT, text_chunks, to_batch

END = 1
_LITTLE = sys.byteorder == "little"
_PROBES = ["the", "packing", "straße", "élève", "niño", "überzwölf", "xqzjv"]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))
_PLAIN = bytes(32 if c == 10 else c for c in range(256))
# Latin words: their lower case is its own normal form, and they are one piece to the pre-tokenizer, as
# are the ASCII signs behind them.
_WORD = re.compile(r"([a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)")
# What a tokenizer must do to a text for the ids of its parts to be its ids.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}
LONGEST_PART = 64  # bytes of a part that the table keeps


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the
    next unused one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Ids by part; those of a part that is not there are made by the cache."""

    def __init__(self, cache: TokenCache):
        super().__init__()
        self.cache = cache

    def __missing__(self, part: bytes) -> bytes:
        return self.cache.learn(part)


class TokenCache:
    """Token ids of a text as little-endian unsigned 32-bit bytes, looked up part by part if the
    tokenizer's rules are _RULES; with any other, whole texts go through the tokenizer.

    By these rules the pre-tokenizer never joins what a space or line feed parts, nor a letter and
    the signs behind it, unless a letter follows these, and lower-cases, so a text's ids are those of
    its parts in a row. Latin words go straight to the tokenizer's model, other parts through the
    whole tokenizer. The table holds the first `limit` parts met that are short, the frequent ones
    among them, and stays with the Python worker until a task of another operator."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it may use
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, _Known(self)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_parts = all(spec.get(k) == rule for k, rule in _RULES.items()) and spec["model"].get("end_of_word_suffix") == "</w>"
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.direct = self.by_parts and all(self._word(w) == self._ids(e) for w, e in zip(_PROBES, self.tokenizer.encode_batch_fast(_PROBES, add_special_tokens=False)))

    @classmethod
    def of(cls, path: str) -> TokenCache:
        if path not in KEPT:
            KEPT[path] = cls(path)
        return KEPT[path]

    @staticmethod
    def _ids(encoding) -> bytes:
        return np.array(encoding.ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.lower().encode().decode("latin-1")))
        ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, dtype="<u4").tobytes()

    def learn(self, part: bytes) -> bytes:
        """Ids of an unknown part; they are kept if there is room."""
        text = part.decode()
        found = _WORD.fullmatch(text)
        if found and found[2]:
            ids = self.known[part[: -len(found[2])]] + self.known[part[-len(found[2]) :]]
        elif found and self.direct:
            ids = self._word(text)
        else:
            ids = self._ids(self.tokenizer.encode(text, add_special_tokens=False))
        if len(part) <= LONGEST_PART and len(self.known) < self.limit:
            self.known[part] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts. A special token's text is never brought about by lower-casing."""
        if not self.by_parts:
            return [self._ids(e) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        of = self.known.__getitem__
        raw = ((t or "").encode() for t in texts)
        return [b"".join(map(of, r.translate(_PLAIN if b"<|" in r else _LOWER).split(b" "))) for r in raw]


class Packer:
    """Fills sequences from documents; rows come out as (document, start, ids, length of the
    document, sequence, offset)."""

    def __init__(self, capacity: int, first_id: int, hold: int = 256):
        self.capacity, self.next_id, self.hold = capacity, first_id, hold
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple[int, list[tuple]]] = []  # gap, pieces
        self.spare: list[tuple[int, int, tuple]] = []  # by length: length, a running number, piece
        self.supply = self.number = 0

    def add(self, doc, ids: bytes) -> list[tuple]:
        total, start, out = len(ids) // 4, 0, []
        while total - start > self.capacity:
            out += self._close([(doc, start, ids[4 * start : 4 * (start + self.capacity)], total)])
            start += self.capacity
        piece = (doc, start, ids[4 * start :], total)
        if start:
            self._keep(piece)
        else:
            out += self._place(piece)
        if len(self.waiting) >= self.hold or len(self.spare) >= self.hold:
            out += self._settle()
            rest, self.spare, self.supply = self.spare, [], 0
            for _, _, piece in rest:
                out += self._place(piece)
        return out

    def finish(self) -> list[tuple]:
        """What the task still holds."""
        for pieces in self.open.values():
            for p in pieces:
                self._keep(p)
        self.open = {}
        out = self._settle()
        while self.supply >= self.capacity:
            out += self._close(self._fill(self.capacity))
        for bit in range(self.capacity.bit_length(), -1, -1):
            if self.supply >> bit:
                out += self._close(self._fill(1 << bit))
        return out

    def _place(self, piece: tuple) -> list[tuple]:
        kind = self.capacity // len_of(piece)
        pieces = self.open.setdefault(kind, [])
        pieces.append(piece)
        if len(pieces) < kind:
            return []
        del self.open[kind]
        gap = self.capacity - sum(map(len_of, pieces))
        if not gap:
            return self._close(pieces)
        self.waiting.append((gap, pieces))
        return []

    def _keep(self, piece: tuple) -> None:
        self.number += 1
        self.supply += len_of(piece)
        insort(self.spare, (len_of(piece), self.number, piece), key=lambda x: x[:2])

    def _settle(self) -> list[tuple]:
        """Close the gaps of the waiting sequences."""
        waiting, self.waiting = sorted(self.waiting, key=lambda x: x[0]), []
        gaps = sum(g for g, _ in waiting)
        while gaps > self.supply:
            gap, pieces = waiting.pop()
            gaps -= gap
            for p in pieces:
                self._keep(p)
        return [row for gap, pieces in reversed(waiting) for row in self._close(pieces + self._fill(gap))]

    def _fill(self, gap: int) -> list[tuple]:
        """Spare pieces that fill a gap: the longest that fit, and the head of one that does not."""
        out = []
        self.supply -= gap
        while gap:
            i = bisect_right(self.spare, gap, key=lambda x: x[0])
            if i:
                length, _, piece = self.spare.pop(i - 1)
            else:
                _, _, (doc, start, ids, total) = self.spare.pop(0)
                length, piece = gap, (doc, start, ids[: 4 * gap], total)
                tail = (doc, start + gap, ids[4 * gap :], total)
                self.supply -= len_of(tail)
                self._keep(tail)
            out.append(piece)
            gap -= length
        return out

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next_id, at))
            at += len_of(p)
        self.next_id += 1
        return out


def len_of(piece: tuple) -> int:
    return len(piece[2]) // 4


def pack(documents: DataFrame, tokenizer: str, *, capacity: int = 2048, hold: int = 256, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with with_ids the token ids."""
    docs = documents.select("doc_id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    ddl = f"doc_id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    fields = [("doc_id", to_arrow_type(id_type)), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int64()))] * with_ids)])
    end = END.to_bytes(4, "little")

    def rows(out: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, total, seq, at = zip(*out)
        data = {"doc_id": list(doc), "start": list(start), "length": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "doc_tokens": list(total), "sequence_id": list(seq), "offset": list(at)}
        if with_ids:
            data["ids"] = [np.frombuffer(x, dtype="<u4").astype("int64") for x in ids]
        return to_batch(data, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer, out = TokenCache.of(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 40, hold), []
        for part in text_chunks(batches, "text", 2 << 20, keep=tokenizer):
            for doc, ids in zip(part.column("doc_id").to_pylist(), cache.encode(part.column("text").to_pylist())):
                out += packer.add(doc, ids + end)
            if len(out) > (256 if with_ids else 8192):
                yield rows(out)
                out = []
        out += packer.finish()
        if out:
            yield rows(out)

    return docs.mapInArrow(run, ddl)
