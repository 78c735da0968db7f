"""Language-model scores by subword lattice likelihood.

An existing subword vocabulary spans a lattice over each word: every way to cut the word (with its
word mark) into vocabulary pieces, or single characters into bytes, is a path, weighted by the
product of its pieces' unigram probabilities. A forward recursion in log space sums all paths to
the word's marginal probability; a text's is the product over its words and one end of text: that
is lattice_score. Pieces are counted on the vocabulary's own segmentation of each learning word, as
often as the word occurs, with `smooth` added.

score adds two things, each of which can be left out. Each learning word is an edge of its own from
end to end, weighing (c - discount) / N; what the discounts leave weighs the subword paths, so the
paths' sum is a probability over all words. And within a document words repeat more than that: the
document's words are drawn from a Dirichlet distribution around those probabilities, which is
integrated out in closed form, for each of a few `concentrations` that weigh alike. A high one is
close to the plain product; a low one lets a document's own words recur. What the score gives is
still a probability over texts. The base score is an add-one unigram model over whole words.

Texts are read once. Each task gathers documents into blocks of about `block_chars` characters and
writes, per block, the distinct words with their counts in learning texts, and the documents as
packed word numbers. Counts are summed by word over the corpus, each distinct word runs through the
lattice once, and the results return to the blocks packed, where the documents are summed up. So no
text is shuffled, no word's count is looked up per document, and a hot word has one row per block.

The vocabulary's piece probabilities, at most as many as the vocabulary has pieces, are broadcast.

Defined results: null, empty and blank texts hold the end alone; repeated rows are learned from and
scored as often as they occur; a null doc_id counts as a learning row; with no learning rows the
base is log10(1/2) a token by its formula with V = 0 and all pieces are equally likely; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingspark.llm.common import crc_bucket, materialize, new_path, text_chunks, to_batch
from filingspark.llm.simhash import _SPACES

MARK, END = "▁", "</s>"
_LOG10 = math.log(10.0)


@dataclass
class Lattice:
    """Piece log probabilities (natural), the longest piece, and the weight of whole words."""

    pieces: dict[str, float]
    bytes_: list[float]
    end: float
    longest: int
    tokens: int = 0
    types: int = 0
    discount: float = 0.75

    @classmethod
    def of(cls, vocabulary: list[str], counts: dict[str, int], ends: int, smooth: float) -> Lattice:
        """vocabulary: pieces, bytes written <0xNN>; a piece with a mark inside never spans a word.
        ends: texts, each of which ends once."""
        usable = [p for p in vocabulary if MARK not in p[1:]]
        total = sum(counts.get(p, 0) for p in usable) + ends + smooth * (len(usable) + 1)
        log = {p: math.log((counts.get(p, 0) + smooth) / total) for p in usable}
        raw = [log.pop(f"<0x{b:02X}>", -math.inf) for b in range(256)]
        return cls(log, raw, math.log((ends + smooth) / total), max(map(len, log), default=1))

    def word(self, word: str) -> float:
        """Natural log of the word's probability over all its segmentations."""
        s, get, longest = MARK + word, self.pieces.get, self.longest
        alpha = [0.0]
        for j in range(1, len(s) + 1):
            terms = []
            for i in range(j - longest if j > longest else 0, j):
                w = get(s[i:j])
                if w is not None:
                    terms.append(alpha[i] + w)
            terms.append(alpha[j - 1] + sum(self.bytes_[b] for b in s[j - 1].encode()))
            top = max(terms)
            alpha.append(top if len(terms) == 1 or top == -math.inf else top + math.log(sum([math.exp(t - top) for t in terms])))
        return alpha[-1]

    def tokens_of(self, inner: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Logs of the probabilities of words seen c times, inner their logs over subword paths."""
        if not self.tokens or not self.discount:
            return inner
        with np.errstate(divide="ignore"):
            return np.logaddexp(inner + math.log(self.discount * self.types / self.tokens), np.log(np.maximum(c - self.discount, 0) / self.tokens))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function of positive numbers: Stirling's series after eight steps up."""
    down = np.zeros_like(x)
    low = x < 8
    y = np.where(low, x + 8, x)
    for i in range(8):
        down[low] += np.log(x[low] + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - down


def document_scores(n: int, doc: np.ndarray, times: np.ndarray, lp: np.ndarray, concentrations: tuple[float, ...]) -> np.ndarray:
    """Natural log probability of n bags of words: rows of (document, times a word occurs, log
    probability of the word). The mean over the concentrations of Dirichlet-multinomial sequences."""
    length = np.bincount(doc, times, n)
    distinct, plain = np.bincount(doc, minlength=n), np.bincount(doc, lp, n)
    again = np.flatnonzero(times > 1)
    t, where, p = times[again].astype(np.float64), doc[again], np.exp(lp[again])
    rows = []
    for a in concentrations:
        extra = np.bincount(where, log_gamma(a * p + t) - log_gamma(a * p + 1), n)
        rows.append(plain + distinct * math.log(a) + extra + math.lgamma(a) - log_gamma(a + length))
    v = np.stack(rows)
    top = v.max(axis=0)
    return top + np.log(np.exp(v - top).mean(axis=0))


def load_vocabulary(path: str) -> list[str]:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not p.is_control(i) and not p.is_unknown(i)]


class _Block:
    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.counts = np.zeros(1 << 16, dtype=np.int64)
        self.ids, self.tokens, self.sizes, self.numbers, self.times, self.chars = [], [], [], [], [], 0

    def add(self, doc_id, text: str | None, train: bool) -> None:
        found, put = (text or "").encode().translate(_SPACES).split(), self.words.setdefault
        numbers = np.fromiter((put(w, len(self.words)) for w in found), dtype=np.int64, count=len(found))
        unique, times = np.unique(numbers, return_counts=True)
        while len(self.words) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        if train:
            self.counts[unique] += times
        self.ids.append(doc_id)
        self.tokens.append(len(found))
        self.sizes.append(len(unique))
        self.numbers.append(np.diff(unique, prepend=0).astype(np.uint32))
        self.times.append(times.astype(np.uint32))
        self.chars += len(text or "") + 64


def _squeeze(*arrays: np.ndarray) -> list[bytes]:
    return [pa.compress(a.tobytes(), codec="zstd", asbytes=True) if len(a) else b"" for a in arrays]


def _expand(data: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind) if n else np.zeros(0, dtype=kind)


def score(documents: DataFrame, vocabulary: str, *, held_out_mod: int = 7, held_out: int = 2, smooth: float = 0.1, discount: float = 0.75, concentrations: tuple[float, ...] = (30.0, 100.0, 300.0, 1e3, 3e3, 1e4, 1e5), block_chars: int = 12 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score, one row per
    document. vocabulary: path of a sentencepiece model. discount 0 leaves whole words out, no
    concentrations leave the recurrence within documents out; without both score is lattice_score."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    out_of = lambda c: F.coalesce(crc_bucket(c, held_out_mod) == held_out, F.lit(False))
    docs = documents.select("doc_id", "text", (~out_of(F.col("doc_id"))).alias("train"))
    id_type = docs.schema["doc_id"].dataType
    id_ddl, id_arrow = id_type.simpleString(), to_arrow_type(id_type)

    gathered = pa.schema([
        ("block", pa.int64()), ("word", pa.string()), ("number", pa.int32()), ("times", pa.int64()),
        ("ids", pa.list_(id_arrow)), ("tokens", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("numbers", pa.binary()), ("counts", pa.binary()), ("n_train", pa.int64()),
    ])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, block, n_train = TaskContext.get().partitionId() << 32, 0, _Block(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            none = lambda n: [None] * n
            words = list(block.words)
            for i in range(0, len(words), 50_000):
                part = pa.array(words[i : i + 50_000], type=pa.binary()).cast(pa.string())
                n = len(part)
                data = {"block": [base + made] * n, "word": part, "number": np.arange(i, i + n, dtype=np.int32), "times": block.counts[i : i + n]}
                yield to_batch({f.name: data[f.name] if f.name in data else none(n) for f in gathered}, gathered)
            numbers, counts = _squeeze(np.concatenate(block.numbers), np.concatenate(block.times))
            data = {"block": [base + made], "ids": [block.ids], "tokens": [block.tokens], "sizes": [block.sizes], "numbers": [numbers], "counts": [counts], "n_train": [n_train]}
            yield to_batch({f.name: data[f.name] if f.name in data else none(1) for f in gathered}, gathered)

        for part in text_chunks(batches, "text"):
            for doc_id, text, train in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "train"))):
                block.add(doc_id, text, train)
                n_train += train
                if block.chars >= block_chars:
                    yield from flush()
                    made, block, n_train = made + 1, _Block(), 0
        if block.ids:
            yield from flush()

    ddl = f"block bigint, word string, number int, times bigint, ids array<{id_ddl}>, tokens array<bigint>, sizes array<bigint>, numbers binary, counts binary, n_train bigint"
    path = new_path(spark, "blocks")
    docs.mapInArrow(gather, ddl).withColumn("kind", F.when(F.col("word").isNull(), "docs").otherwise("words")).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    if not spark.read.schema("kind string").parquet(path).limit(1).count():
        return spark.createDataFrame([], f"doc_id {id_ddl}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, lattice_score double")
    blocks = spark.read.schema(f"{ddl}, kind string").parquet(path)
    words = blocks.where("kind = 'words'").select("block", "word", "number", "times")
    packed = blocks.where("kind = 'docs'").select("block", "ids", "tokens", "sizes", "numbers", "counts")

    counted = materialize(words.groupBy("word").agg(F.sum("times").alias("c")), "words")
    n_words, v_words = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = blocks.where("kind = 'docs'").agg(F.sum("n_train")).first()[0]
    n, v = n_words + ends, v_words + (ends > 0)
    denominator = float(n + v + 1)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        total = np.zeros(processor.get_piece_size(), dtype=np.int64)
        for batch in batches:
            found = processor.encode(batch.column("word").to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.fromiter((i for f in found for i in f), dtype=np.int64, count=int(sizes.sum()))
            np.add.at(total, flat, np.repeat(batch.column("c").to_numpy(), sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([processor.id_to_piece(int(i)) for i in at], type=pa.string()), pa.array(total[at])], names=["piece", "n"])

    pieces = {r[0]: r[1] for r in counted.where("c > 0").select("word", "c").mapInArrow(segment, "piece string, n bigint").groupBy("piece").agg(F.sum("n")).collect()}
    spans = Lattice.of(load_vocabulary(vocabulary), pieces, ends, smooth)
    spans.tokens, spans.types, spans.discount = n, v, discount
    lattice = spark.sparkContext.broadcast(spans)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice.value
        for batch in batches:
            lp = [model.word(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lp, type=pa.float64())], names=["word", "c", "lp"])

    weighed = counted.mapInArrow(weigh, "word string, c bigint, lp double")
    back = pa.schema([("block", pa.int64()), ("number", pa.binary()), ("c", pa.binary()), ("lp", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            block, number, c, lp = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((number, block))
            block, number, c, lp = block[order], number[order], c[order], lp[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            starts = np.concatenate([[0], cuts])
            split = lambda a: [x.tobytes() for x in np.split(a, cuts)]
            return to_batch({"block": block[starts], "number": split(number.astype(np.uint32)), "c": split(c.astype(np.uint64)), "lp": split(lp)}, back)

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "number", "c", "lp")))
                rows += batch.num_rows
            if rows >= 1_000_000:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    returned = words.select("block", "word", "number").join(weighed, "word").select("block", "number", "c", "lp").mapInArrow(pack, "block bigint, number binary, c binary, lp binary")
    spans_end = spans.end / _LOG10
    result = pa.schema([("doc_id", id_arrow), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("lattice_score", pa.float64())])
    end_lp, end_base = float(spans.tokens_of(np.array([spans.end]), np.array([float(ends)]))[0]) / _LOG10, math.log10((ends + 1) / denominator)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        join = lambda name, kind: np.concatenate([np.zeros(0, dtype=kind), *(np.frombuffer(x, dtype=kind) for x in right.column(name).to_pylist())])
        number, c, lp = join("number", np.uint32), join("c", np.uint64).astype(np.float64), join("lp", np.float64)
        size = int(number.max()) + 1 if len(number) else 0
        base_of, inner_of, lp_of, known_of = np.full(size, np.nan), np.full(size, np.nan), np.full(size, np.nan), np.zeros(size)
        base_of[number], inner_of[number], lp_of[number], known_of[number] = np.log10((c + 1) / denominator), lp, lattice.value.tokens_of(lp, c), c > 0
        out: dict[str, list] = {f.name: [] for f in result}
        for row in left.to_pylist():
            sizes = np.array(row["sizes"], dtype=np.int64)
            deltas, times = _expand(row["numbers"], int(sizes.sum()), np.uint32).astype(np.int64), _expand(row["counts"], int(sizes.sum()), np.uint32)
            starts = np.cumsum(sizes) - sizes
            total = np.cumsum(deltas)
            at = total - np.repeat(np.where(starts > 0, total[np.maximum(starts, 1) - 1], 0), sizes) if len(deltas) else deltas
            doc = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda values: np.bincount(doc, times * values[at], len(sizes)) if len(at) else np.zeros(len(sizes))
            out["doc_id"] += row["ids"]
            out["n_tokens"] += [t + 1 for t in row["tokens"]]
            out["n_known"] += (np.rint(add(known_of)).astype(np.int64) + (ends > 0)).tolist()
            out["base_score"] += (add(base_of) + end_base).tolist()
            out["lattice_score"] += (add(inner_of) / _LOG10 + spans_end).tolist()
            plain = add(lp_of) if not concentrations else document_scores(len(sizes), doc, times, lp_of[at], concentrations)
            out["score"] += (plain / _LOG10 + end_lp).tolist()
        return pa.Table.from_batches([to_batch(out, result)])

    scored = packed.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(finish, f"doc_id {id_ddl}, n_tokens bigint, n_known bigint, base_score double, score double, lattice_score double")
    return scored.select("doc_id", out_of(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score", "lattice_score")
