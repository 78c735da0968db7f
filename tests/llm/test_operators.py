"""Small tables with nulls, empty and long texts, ties, repeated rows, extra columns; results held
against brute force."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(6000))
TEXTS = [
    (1, "The quick brown fox, jumps over the lazy dog and then some more words follow here for all"),
    (2, "the quick brown fox jumps over the lazy dog and then some more words follow here for all"),
    (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (6, "one"), (7, LONG), (8, LONG + " end"), (9, "Ünïcödé wörds éàü ñandú 12,3. it's <|endoftext|>"), (10, "a b"), (11, "!!! ... ???"), (None, "no id here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", -1, 7, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, word string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_tasks_give_free_memory_back():
    """What a task before left in the allocator does not stay with the worker."""
    code = """
import pyarrow as pa
from filingspark.llm.common import text_chunks
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
held = [bytes(1000) for _ in range(200_000)]
held = held[::1000]
before = rss()
list(text_chunks([pa.record_batch({"text": ["a", None]})], "text"))
print(before - rss())
"""
    assert int(subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True, check=True).stdout) > 100


def test_tables_of_other_operators_do_not_stay_with_a_worker():
    import weakref

    import pyarrow as pa
    import public_tokenizers as P
    from filingspark.llm.common import text_chunks
    from filingspark.llm.packing import TokenCache

    path, batch = P.path("word_bpe_49k.json"), pa.record_batch({"text": ["a", None]})
    held = weakref.ref(TokenCache.of(path))
    held().encode(["some words"])
    assert sum(b.num_rows for b in text_chunks([batch], "text", keep=path)) == 2 and TokenCache.of(path) is held()
    assert sum(b.num_rows for b in text_chunks([batch], "text")) == 2 and held() is None


# -- 1 --------------------------------------------------------------------------------------------

ITEMS = [(30, "brown fox jumps over the lazy dog and then some more words follow"), (4, "One"), (5, None), (6, ""), (7, "lazy dog and then some more words follow here for all not this tail"), (30, "w1x1"), (12, "ünïcödé")]


def brute_windows(text, items, width=13):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        k = min(width, len(w))
        for g in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == g:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_chars", [1 << 20, 90])
def test_decontamination(spark, docs, nothing, block_chars):
    from filingspark.llm import decontam

    bench = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id bigint, text string, doc_id bigint")
    got = sorted(tuple(r)[:6] for r in decontam.report(docs, bench, block_chars=block_chars).collect() if r[0])
    assert got == sorted((i, *brute_windows(t, ITEMS)) for i, t in TEXTS if i is not None)
    assert decontam.report(nothing, bench).count() == 0
    assert decontam.report(docs, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    crowded = docs.withColumns({c: F.lit(3) for c in ("_spans", "_words", "_id", "_hash")})
    clashing = decontam.decontaminate(crowded, bench, block_chars=block_chars)
    assert clashing.columns == crowded.columns and clashing.where("_spans = 3 AND _words = 3").count() == 9
    kept = decontam.decontaminate(docs, bench, block_chars=block_chars)
    assert kept.columns == docs.columns
    left = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert [i for i, _ in left] == [0, 3, 4, 5, 7, 8, 9, 10, 11]  # 1, 2 and both rows of 6 are contaminated
    texts = dict(left)
    assert "w1x1" not in texts[7].split() and len(texts[7].split()) > 5900 and texts[10] == "a b"


# -- 2 --------------------------------------------------------------------------------------------


def test_warc(spark):
    from filingspark.llm import warc

    big = "é" * 700
    rows = [(1, "http://www.b.example.org/x?q=1", big), (2, "https://a.example.org/y z", big), (9, None, big), (3, "http://a.example.org/y%20z/", "small"), (4, None, None), (5, "x", ""), (5, "x", ""), (6, "http://h/" + "p" * 3000, "small"), (7, "http://[bad", "t\r\n\r\nt"), (None, "http://n/", big)]
    pages = spark.createDataFrame([(*r, "no") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    made = warc.write(pages, per_block=2, roll=600)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in made.read().collect())
    revisits = lambda p, h: h == big and p not in (9, None)
    want = sorted(((p or 0, len(b := (h or "").encode()), hashlib.sha1(b).hexdigest(), "revisit" if revisits(p, h) else "response", 9 if revisits(p, h) else None) for p, _, h in rows), key=lambda r: (r[0],))
    assert got == want
    assert sorted(r.page_id for r in made.lookup(["https://a.example.org/y z", "http://b.example.org/x?q=1"])) == [1, 2, 3]
    assert made.lookup(["http://none/"]) == []
    assert {r.page_id: r.payload.decode() for r in made.read().where("record_type = 'response'").collect()}[7] == "t\r\n\r\nt"
    assert warc.write(pages.limit(0)).read().count() == 0


@pytest.mark.parametrize(("per_block", "parts"), [(1, 7), (2, 3), (50, 1)])
def test_warc_lookup_bisects_the_directory(spark, per_block, parts, monkeypatch):
    import glob
    import gzip
    import os

    from filingspark.llm import common, warc

    rng = np.random.default_rng(9)
    rows = [(i, f"http://h{rng.integers(0, 5)}.org/{'ab'[rng.integers(0, 2)] * int(rng.integers(1, 5))}", f"page {i % 9} " * 200 if i % 3 else f"p{i}") for i in range(60)] + [(100 + i, "http://hot.org/", "x" * 2000) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    init = warc.DirectoryFile.__init__
    monkeypatch.setattr(warc.DirectoryFile, "__init__", lambda self, root, name, size: init(self, root, name, size, window=5))
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made = warc.write(pages, per_block=per_block, roll=3000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    made.ranges()
    for url in sorted({u for _, u, _ in rows}) + ["http://a.org/", "http://h2.org/aaaaaa", "http://zz.zz/", ""]:
        want = sorted(p for p, u, _ in rows if warc.url_key(u) == warc.url_key(url))
        assert sorted(r.page_id for r in made.lookup([url])) == want, url
    base = warc.file_system(made.root)[1]
    ids = []
    for path in glob.glob(f"{base}/part-*"):
        text = gzip.open(path).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        ids += re.findall(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)\r\n", text)
    assert len(ids) == len(set(ids)) == len(rows) + len(glob.glob(f"{base}/part-*"))
    assert {r.record_type for r in made.read().where("page_id >= 100 AND page_id < 119").collect()} == {"revisit"} and made.read().where("refers_to = 119").count() == 19
    assert os.listdir(base)


# -- 3 --------------------------------------------------------------------------------------------


def test_packing(docs, nothing):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from filingspark.llm import packing

    path = P.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, capacity=256, hold=2).collect()
    tokenizer = Tokenizer.from_file(path)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for i, text in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        times = [t for _, t in TEXTS].count(text) if i == 6 else 1
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == times * len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        if times == 1:
            assert [t for r in pieces for t in r.ids] == ids
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(nothing, path).count() == 0


@pytest.mark.parametrize("hold", [1, 3, 64])
def test_harmonic_classes(hold):
    """Pieces held against the documents; whole documents stay whole but for those that close gaps."""
    from filingspark.llm.packing import Packer

    for seed, most in ((0, 40), (1, 400), (2, 64), (3, 1)):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, most + 1, 700).tolist()
        data = [rng.integers(0, 99, n, dtype="<u4").tobytes() for n in sizes]
        packer = Packer(64, 5 << 40, hold)
        rows = []
        for i, ids in enumerate(data):
            rows += packer.add(i, ids)
            assert len(packer.waiting) <= hold + 8 and len(packer.spare) <= hold + 8
        rows += packer.finish()
        docs, seqs = {}, {}
        for doc, start, ids, total, seq, offset in rows:
            assert ids and total == sizes[doc] and seq >= 5 << 40
            docs.setdefault(doc, []).append((start, ids))
            seqs.setdefault(seq, []).append((offset, len(ids) // 4, doc))
        assert [b"".join(x for _, x in sorted(docs[i])) for i in range(len(data))] == data
        assert all(s == sum(len(x) // 4 for _, x in sorted(p)[:k]) for p in docs.values() for k, (s, _) in enumerate(sorted(p)))
        lengths = []
        for pieces in seqs.values():
            assert [o for o, _, _ in sorted(pieces)] == [sum(n for _, n, _ in sorted(pieces)[:k]) for k in range(len(pieces))]
            lengths.append(sum(n for _, n, _ in pieces))
        short = [n for n in lengths if n < 64]
        assert max(lengths) <= 64 and all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short))
        if hold == 64 and seed < 2:
            fit = [i for i, n in enumerate(sizes) if n <= 64]
            assert sum(len(docs[i]) == 1 for i in fit) >= 0.8 * len(fit)
            kinds = [{64 // sizes[d]: 0 for _, _, d in p} for p in seqs.values()]
            assert sum(len(k) <= 2 for k in kinds) >= 0.5 * len(kinds)


def test_packing_with_another_tokenizer(docs):
    """A cased tokenizer takes whole texts."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from filingspark.llm.packing import TokenCache

    path = P.path("byte_bpe_50k.json")
    texts = [t for _, t in TEXTS]
    want = [np.array(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert not TokenCache(path).by_parts and TokenCache(path).encode(texts) == want
    own = TokenCache(P.path("word_bpe_49k.json"))
    own.limit = 3
    assert own.by_parts and own.encode(texts) == [np.array(own.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert len(own.known) <= 3 and own.encode(["x" * 900 + " the"]) == [b"".join(own.encode(["x" * 900, "the"]))]


def test_signs_behind_words_do_not_need_the_whole_tokenizer():
    """A word with signs behind it is the word and the signs; both are learned once."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from filingspark.llm.packing import TokenCache

    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer, self.model, self.seen = tokenizer, tokenizer.model, []

        def encode(self, text, **kind):
            self.seen.append(text)
            return self.tokenizer.encode(text, **kind)

        def encode_batch_fast(self, texts, **kind):
            self.seen += texts
            return self.tokenizer.encode_batch_fast(texts, **kind)

    path = P.path("word_bpe_49k.json")
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()] + ["%%%", ".***", "'.", ",'", "...)", "_", "<|", "|>"]
    texts = [f"{w}{s} {w.upper()}{s} {s}{w} {w}{s}{w}\n{w}{s}s {w}{s}7" for s in signs for w in ("packing", "überzÉß", "e\u0301t")]
    texts += ["it's we'll' they've. I'D, can't%%% x<|endoftext|>. X<|ENDOFTEXT|>,", "packing.\u0338 packing<\u0338 a=\u0338"]
    cache, plain = TokenCache(path), Tokenizer.from_file(path)
    assert cache.direct
    cache.tokenizer = Watched(cache.tokenizer)
    assert cache.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert not {f"packing{s}" for s in signs} & set(cache.tokenizer.seen)
    assert cache.tokenizer.seen.count("%%%") == 1
    cache.tokenizer.seen.clear()
    assert cache.encode(texts[-2:]) == cache.encode(texts)[-2:] and not cache.tokenizer.seen


# -- 4 --------------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    from filingspark.llm.lattice_lm import MARK, Lattice

    vocabulary = [MARK, MARK + "a", "a", "b", "ab", "bab", MARK + "ab", *(f"<0x{b:02X}>" for b in range(256))]
    counts = {MARK: 3, "a": 5, "ab": 2, "b": 1, "<0xC3>": 1}
    model = Lattice.of(vocabulary, counts, 2, 0.5)
    p = {k: math.exp(v) for k, v in model.pieces.items()}

    def every(s):
        if not s:
            return 1.0
        head = math.prod(math.exp(model.bytes_[b]) for b in s[0].encode()) * every(s[1:])
        return head + sum(p[s[:k]] * every(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    for word in ("a", "abab", "bé", "babab", ""):
        assert math.isclose(math.exp(model.word(word)), every(MARK + word), rel_tol=1e-9)
    assert math.isclose(sum(p.values()) + sum(map(math.exp, model.bytes_)) + math.exp(model.end), 1.0, rel_tol=1e-9)


def test_document_scores_are_a_probability():
    from itertools import product

    from filingspark.llm.lattice_lm import document_scores, log_gamma

    x = np.array([1e-9, 0.3, 1.0, 7.9, 8.0, 250.5, 1e6])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)
    p = {"a": 0.5, "b": 0.3, "c": 0.2}
    texts = list(product("abc", repeat=4))
    rows = [(d, k, math.log(p[w])) for d, text in enumerate(texts) for w, k in Counter(text).items()]
    doc, times, lp = (np.array(c) for c in zip(*rows))
    got = document_scores(len(texts), doc, times, lp, (0.5, 20.0))
    assert math.isclose(np.exp(got).sum(), 1.0, rel_tol=1e-9)

    def urn(text, a):
        return math.prod((a * p[w] + text[:i].count(w)) / (a + i) for i, w in enumerate(text))

    assert np.allclose(np.exp(got), [(urn(t, 0.5) + urn(t, 20.0)) / 2 for t in texts])
    none = np.zeros(0, dtype=int)
    assert np.allclose(document_scores(2, none, none, none.astype(float), (1.0, 9.0)), 0)


@pytest.mark.parametrize("block_chars", [1 << 20, 50])
def test_lattice_scores(docs, nothing, block_chars):
    import public_tokenizers as P

    from filingspark.llm import lattice_lm

    vocabulary = P.path("piece_bpe_32k.model")
    got = sorted(((r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lattice_lm.score(docs, vocabulary, block_chars=block_chars).collect())
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    counts = Counter(w for i, t in TEXTS if not out(i) for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or 0, out(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), "\n"]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), "\n"]), 6)) for i, t in TEXTS)
    assert got == want
    assert lattice_lm.score(nothing, vocabulary).count() == 0
    # The scores themselves, from a plain version: word by word, in order.
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces, ends = Counter(), counts.pop("\n")
    for w, c in counts.items():
        for i in processor.encode(w):
            pieces[processor.id_to_piece(i)] += c
    plain = lattice_lm.Lattice.of(lattice_lm.load_vocabulary(vocabulary), pieces, ends, 0.1)
    inner = {w: plain.word(w) for _, t in TEXTS for w in words(t)}
    d, some = 0.75, (5.0, 300.0)
    p = {w: d * v / n * math.exp(x) + max(counts[w] - d, 0) / n for w, x in inner.items()}
    end = math.log10(d * v / n * math.exp(plain.end) + (ends - d) / n)

    def urn(text, a):
        seen, total = Counter(), 0.0
        for i, w in enumerate(words(text)):
            total += math.log((a * p[w] + seen[w]) / (a + i))
            seen[w] += 1
        return total

    def mean(text):
        x = [urn(text, a) for a in some]
        return (max(x) + math.log(sum(math.exp(y - max(x)) for y in x) / len(x))) / math.log(10)

    lattice = lambda t: (sum(inner[w] for w in words(t)) + plain.end) / math.log(10)
    rows = lambda **kw: sorted(((r.doc_id or 0, r.score, r.lattice_score) for r in lattice_lm.score(docs, vocabulary, block_chars=block_chars, **kw).collect()), key=lambda r: (r[0], r[1]))
    for kw, own in (({"concentrations": some}, lambda t: mean(t) + end), ({"concentrations": ()}, lambda t: sum(math.log10(p[w]) for w in words(t)) + end), ({"concentrations": (), "discount": 0}, lattice)):
        want = sorted(((i or 0, own(t), lattice(t)) for i, t in TEXTS), key=lambda r: (r[0], r[1]))
        assert np.allclose(np.array(rows(**kw)), np.array(want), rtol=1e-7), kw


# -- 5 --------------------------------------------------------------------------------------------


def brute_print(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, nothing):
    from filingspark.llm import simhash

    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = [(i, brute_print(t)) for i, t in TEXTS]
    roots = brute_components([p for _, p in rows])
    least = {r: min((i for (i, _), q in zip(rows, roots) if q == r and i is not None), default=None) for r in roots}
    assert got == {(i, p, least[r]) for (i, p), r in zip(rows, roots)}
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.near_duplicates(docs).count() == len(TEXTS)


@pytest.mark.parametrize("hot", [1, 20_000])
def test_simhash_classes_with_null_ids(spark, hot, monkeypatch):
    """Links that only fingerprints of null ids make, repeated ids, frequent fingerprints."""
    from filingspark.llm import common, simhash

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = [(1, 0), (None, 7), (2, 63), (9, 0), (9, 0), (5, 1 << 40), (None, (1 << 50) + (1 << 51) + (1 << 52) + (1 << 53)), (7, -1), (6, -1), (8, -2), (7, -1)]
    roots = brute_components([p % (1 << 64) for _, p in rows])
    least = {r: min((i for (i, _), q in zip(rows, roots) if q == r and i is not None), default=None) for r in roots}
    got = sorted(map(str, ((r.doc_id, r.fp, r.component_id) for r in simhash.classes(spark.createDataFrame(rows, "doc_id bigint, fp bigint").repartition(3)).collect())))
    assert got == sorted(map(str, ((i, p, least[r]) for (i, p), r in zip(rows, roots))))
    assert least[roots[0]] == least[roots[2]] == 1 and None in least.values()


@pytest.mark.parametrize(("tile", "wide"), [(4, 1 << 15), (512, 1 << 15), (4, 6)])
def test_simhash_links_in_hot_buckets(spark, tile, wide):
    from filingspark.llm import simhash

    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 62))
    near = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) ^ (1 << int(d)) for a, b, c, d in rng.integers(0, 63, (150, 4))}
    prints = [*near, *(int(x) for x in rng.integers(0, 1 << 62, 100)), 0, -1, -2, (1 << 63) - 1]
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node bigint, fp bigint")
    got = dict(tuple(r) for r in simhash.components(simhash.links(nodes, tile=tile, wide=wide)).collect())
    roots = brute_components([p % (1 << 64) for p in prints])
    assert [got.get(i, i) for i in range(len(prints))] == roots


def test_components_of_long_paths(spark):
    from filingspark.llm import simhash

    order = np.random.default_rng(1).permutation(400)
    edges = [(int(a), int(b)) for a, b in zip(order[:-1], order[1:])] + [(1000, 1001), (1001, 1000), (1002, 1001)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got.get(i, i) == 0 for i in range(400)) and got[1001] == got[1002] == 1000
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 6, 8, 10 -------------------------------------------------------------------------------------


def test_chain_marginals_are_exact():
    from itertools import product

    from filingspark.llm import crf

    rng = np.random.default_rng(0)
    scores, trans, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([1, 0, 0, 1, 1, 0, 0], dtype=bool)
    want = np.zeros((7, 3))
    for a, b in ((0, 3), (3, 4), (4, 7)):
        paths = {p: math.exp(start[p[0]] + sum(scores[a + t][y] for t, y in enumerate(p)) + sum(trans[x][y] for x, y in zip(p, p[1:]))) for p in product(range(3), repeat=b - a)}
        total = sum(paths.values())
        for p, w in paths.items():
            for t, y in enumerate(p):
                want[a + t][y] += w / total
    assert np.allclose(crf.marginals(scores, first, trans, start)[0], want)
    long = rng.normal(size=(500, 3))
    heads = np.zeros(500, dtype=bool)
    heads[0] = True
    assert np.allclose(crf.marginals(long, heads, trans, start)[0].sum(axis=1), 1)
    assert crf.marginals(np.zeros((0, 3)), np.zeros(0, dtype=bool), trans, start)[0].shape == (0, 3)


def test_chain_in_parts_is_the_whole_chain():
    from filingspark.llm import crf

    rng = np.random.default_rng(4)
    n = 331
    scores, trans, start = 3 * rng.normal(size=(n, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    first = rng.random(n) < 0.02
    first[0] = True
    whole = crf.marginals(scores, first, trans, start)[0]
    for size in (1, 7, 48, 50, 96, 331):
        part = lambda i: (scores[i * size : (i + 1) * size], first[i * size : (i + 1) * size])  # noqa: B023, E731
        got = dict(crf.posteriors(part, -(-n // size), trans, start))
        assert np.allclose(np.concatenate([got[i] for i in sorted(got)]), whole, atol=1e-12), size


def test_run_sums():
    from filingspark.llm.common import run_sums

    rng = np.random.default_rng(6)
    values = rng.integers(0, 99, 60)
    for starts in ([0], [3], [0, 1, 2, 30, 59], [5, 6, 40]):
        want = [values[a:b].sum() for a, b in zip(starts, [*starts[1:], 60])]
        for window in (1, 2, 7, 59, 60, 1000):
            assert run_sums(lambda a, b: values[a:b], np.array(starts), 60, window).tolist() == want


def plain_chain(scores, trans, start):
    """Marginals of one chain by the textbook recursions."""
    n, k = len(scores), len(start)
    e, t = np.exp(np.array(scores)), np.exp(trans)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    for i in range(n):
        alpha[i] = e[i] * (np.exp(start) if i == 0 else alpha[i - 1] @ t)
        alpha[i] /= alpha[i].sum()
    for i in range(n - 2, -1, -1):
        beta[i] = t @ (e[i + 1] * beta[i + 1])
        beta[i] /= beta[i].sum()
    return alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)


EN = "the of and that was with for this have from".split()
DE = "der die und nicht für über mit auch schön größe".split()


def sentences(words, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words, 12)) + "." for _ in range(n)]


def test_language(spark, docs, nothing):
    from filingspark.llm import langid

    rows = [(i, t, "en") for i, t in enumerate(sentences(EN, 60, 1))] + [(100 + i, t, "de") for i, t in enumerate(sentences(DE, 60, 2))] + [(500, "the of", None), (501, None, "de"), (502, "", "en"), (503, "12 !!", "en")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, lang string, score string")
    model = langid.fit(table)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table, model).collect()}
    assert all(got[i][0] == lang and 0 <= got[i][1] <= 1 for i, _, lang in rows if i < 200)
    assert got[501] == got[502] == got[503] == ("und", 0.0) and got[500][0] == "en"
    import pyarrow as pa

    mixed = " ".join(EN * 3) + " " + " ".join(DE)
    share = model.predict(pa.array([mixed]))[2][0]
    assert 0.05 < share[model.languages.index("de")] < 0.5
    assert langid.identify(docs, model).count() == len(TEXTS)
    assert langid.identify(nothing, model).count() == 0
    empty = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.reject(docs, model, 0.4).columns == docs.columns


def test_quality(spark, docs, nothing):
    from filingspark.llm import quality

    good = ["\n".join(sentences(EN, 5, s)) for s in range(60)]
    bad = ["\n".join(x.upper().replace(" ", "!! ") for x in sentences(EN, 5, s)) if s % 2 else "spam " * 60 for s in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(bad)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows] + [(7777, None, None), (None, 1, None)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(table, labels)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert all((got[i] >= 0.7) == bool(q) and 0 <= got[i] <= 1 for i, _, q in rows)
    assert quality.score(docs, model).count() == len(TEXTS)
    assert {round(r.score, 6) for r in quality.score(docs.where("doc_id IN (3, 4)"), model).collect()} == {round(model.base, 6)}
    none = quality.fit(nothing, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0


def test_toxicity(spark, docs, nothing):
    from filingspark.llm import toxicity

    clean = sentences(EN, 300, 3)
    toxic = [s.replace(" ", f" {w} ", 1) for s, w in zip(sentences(EN, 300, 4), ["idiot", "scumbag", "blargoid", "blargest", "blargish"] * 60)]
    rows = [(i, t, 0) for i, t in enumerate(clean)] + [(1000 + i, t, 1) for i, t in enumerate(toxic)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, None, x) for i, _, x in rows], "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.fit(table, labels)
    got = {r.doc_id: r.score for r in toxicity.score(table, lexicon).collect()}
    assert all((got[i] >= 0.5) == bool(x) for i, _, x in rows)
    for text in ("you 1d10t there", "you іdіоt there", "you ｉｄｉｏｔ there", "i​diot", "a blargling one", "IDIOT!"):
        assert lexicon.score(text) >= 0.5, text
    for text in ("1010 4 5", "idiotic the of", None, "", "the of and"):
        assert lexicon.score(text) < 0.5, text
    lexicon.words["clown"] = lexicon.words["idiot"]
    lexicon.exceptions, lexicon._automaton = ("Clown-Fish", "circus clown"), None
    assert max(lexicon.score("the clown fish swam"), lexicon.score("a circus clown fish")) < 0.5 <= lexicon.score("the clown swam")
    assert toxicity.score(docs, lexicon).count() == len(TEXTS)
    assert toxicity.score(docs, toxicity.fit(nothing, labels.limit(0))).where("score <> 0").count() == 0
    assert toxicity.score(nothing, lexicon).count() == 0
    assert toxicity.reject(docs, lexicon, 0.5).columns == docs.columns


def test_toxicity_folding_and_evidence():
    from filingspark.llm import toxicity as T

    assert [T.fold(x) for x in ("Ídïot", "i!diot", "what!", "1D|0T", "gr8 b19", "\u0442r\u0430sh", "\uff54rash", "t\u0301rash", "a | b", "stu\u200bpid")] == ["idiot", "iidiot", "what!", "idlot", "grb big", "trash", "trash", "trash", "a | b", "stupid"]
    lexicon = T.Lexicon(words={"idiot": 2.0, "scum": 3.0}, stems={"blarg": 1.5, "blargo": 2.5}, exceptions=("scum bag",), curve=(-2.0, 1.0, 0.5))
    for text in ("idiot", "scum idiot the of", "scum bag scum", "blargoid blargling idiots", "x " * 300 + "idiot", "idiot " * 80, "", "scum bag", "scumbag scum-bag"):
        words = T.words_of(text).split()
        spared = {j for i in range(len(words) - 1) if words[i : i + 2] == ["scum", "bag"] for j in (i, i + 1)}
        weight = lambda w: max([lexicon.words.get(w, 0.0), *(v for t, v in lexicon.stems.items() if w.startswith(t))])
        total = sum(weight(w) for i, w in enumerate(words) if i not in spared)
        x = -2.0 + math.log1p(total) + 0.5 * math.log1p(100 * total / max(1, len(words)))
        assert abs(lexicon.score(text) - 1 / (1 + math.exp(-x))) < 1e-9, text
    assert lexicon.score("idiot " * 20) < lexicon.score("idiot " * 40) < lexicon.score("idiot " * 80)
    assert lexicon.score("idiot the") > lexicon.score("idiot the of and") > lexicon.score("idiot " + "the " * 90)


def test_exceptions_are_learned():
    from filingspark.llm import toxicity as T

    rng = np.random.default_rng(3)
    say = lambda: " ".join(rng.choice(EN, 6))
    texts = [f"{say()} clown fish {say()}" for _ in range(40)] + [f"{say()} {w} {say()}" for w in ("clown", "idiot") * 150] + [f"{say()} {say()}" for _ in range(960)]
    lexicon = T.train(texts, [0] * 40 + [1] * 300 + [0] * 960)
    assert "clown fish" in lexicon.exceptions and set(lexicon.words) == {"clown", "idiot"}
    assert lexicon.score("the clown fish of that") < 0.5 <= lexicon.score("the clown of that")
    copied = ["the of clown fish and was"] * 40
    assert T.train(copied + texts[40:], [0] * 40 + [1] * 300 + [0] * 960).exceptions == ()


def test_language_against_brute_force(monkeypatch):
    import pyarrow as pa

    from filingspark.llm import langid

    model = langid.train(sentences(EN, 40, 1) + sentences(DE, 40, 2), ["en"] * 40 + ["de"] * 40, rounds=8)
    a, b, _ = langid._TABLE
    m32 = (1 << 32) - 1

    def rows(word: bytes) -> list[int]:
        x = [32, *word, 32, 32, 32]
        n = len(word)
        tri = lambda p: x[p] | x[p + 1] << 8 | x[p + 2] << 16
        out = [x[p] | x[p + 1] << 8 for p in range(n + 1)]
        out += [a + (((tri(p) * 2654435761) & m32) >> 16) for p in range(n)]
        return out + [a + b + (((((tri(p) * 2246822519) ^ (x[p + 3] * 3266489917)) & m32) * 668265263 & m32) >> 15) for p in range(n - 1)]

    def word_hash(word: bytes) -> int:
        h = sum((c + 7) * int(langid._POWERS[i & 255]) for i, c in enumerate(word)) % (1 << 64)
        return ((h ^ h >> 31) * 0x9E3779B97F4A7C15) % (1 << 64)

    texts = ["the of größe, with und A1b", *sentences(EN, 2, 8), " ".join(DE), "x", "é" * 40, " ".join(EN * 9 + DE * 9), "12", None]
    want = []
    for text in texts:
        words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
        if not words:
            want.append(("und", 0.0))
            continue
        lex = model.lexicon.tolist()
        scores = [sum(model.weights[0][r].astype(float) for r in rows(w)) + model.weights[1][lex.index(word_hash(w)) + 1 if word_hash(w) in lex else 0] for w in words]
        share = sum(p * len(w) for p, w in zip(plain_chain(scores, model.trans, model.start), words)) / sum(map(len, words))
        want.append((model.languages[int(share.argmax())], float(share.max())))
    for window, part in ((1, 1), (3, 2), (50, 7), (1 << 20, 1 << 18)):
        monkeypatch.setattr(langid, "WINDOW", window)
        monkeypatch.setattr(langid, "PART", part)
        names, score, _ = model.predict(pa.array(texts))
        assert names == [x for x, _ in want] and np.allclose(score, [x for _, x in want], atol=1e-5), (window, part)


def test_quality_against_brute_force(monkeypatch):
    import pyarrow as pa

    from filingspark.llm import quality

    good, bad = sentences(EN, 60, 3), ["SPAM!! win $$ | 9 9 " * 3] * 60
    model = quality.train(["\n".join(good[i : i + 3]) for i in range(57)] + ["\n".join(bad[i : i + 2]) for i in range(57)], [1] * 57 + [0] * 57)
    kinds = "lower upper digit bang pipe symbol point".split()
    kind = lambda c: kinds[k - 1] if 1 <= (k := int(quality._KIND[c])) <= 7 else ""

    def score(text: str | None) -> float:
        lines = (text or "").encode().split(b"\n")
        own, shares, seen = [], [], set()
        for line in lines:
            c = Counter(map(kind, line))
            words, per = line.split(), max(1, len(line.split()))
            letters, total = max(c["lower"] + c["upper"], 1), max(len(line), 1)
            again = sum(x == y for x, y in zip(words, words[1:]))
            r = np.array([c["upper"] / letters, c["bang"] / per, c["pipe"] / per, c["symbol"] / total, c["digit"] / total, again / per, 1 - len(set(words)) / per])
            shares.append(np.concatenate([r, np.sqrt(np.clip(r, 0, 1)), np.minimum(1, 8 * r)]))
            own.append([1, math.log1p(len(line)) / 5, min((c["lower"] + c["upper"]) / per, 30) / 10, min(c["point"] / per, 2), line in seen, len(words) <= 2])
            seen.add(line)
        none = np.zeros(21)
        z = [float(np.concatenate([own[i], shares[i], shares[i - 1] if i else none, shares[i + 1] if i + 1 < len(lines) else none]) @ model.weights) for i in range(len(lines))]
        p = np.clip(plain_chain([[0.0, x] for x in z], model.trans, model.start)[:, 1], 1e-6, 1 - 1e-6)
        size = np.array([len(x) for x in lines], dtype=float)
        if not size.sum():
            return model.base
        x = np.array([1, (size * np.log(p / (1 - p))).sum() / size.sum(), (size * p).sum() / size.sum()])
        return 1 / (1 + math.exp(-float(np.clip(x @ model.curve, -30, 30))))

    texts = ["\n".join(good[:4] + bad[:2] + good[:1]), good[0], bad[0], "", None, "\n\n", "a\n\nB!! c\na\n", "one very long line " * 80, "\n".join(good[i % 7] + str(i) for i in range(60))]
    want = [score(t) for t in texts]
    for window, part in ((1, 1), (3, 2), (50, 7), (1 << 20, 1 << 16)):
        monkeypatch.setattr(quality, "WINDOW", window)
        monkeypatch.setattr(quality, "PART", part)
        assert np.allclose(model.score(pa.array(texts)), want, atol=1e-9), (window, part)


# -- 7 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "first_rows"), [(3, 40), (3, 1), (2048, 40), (2048, 16_384)])
def test_topk(spark, block, first_rows):
    from filingspark.llm import topk

    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    vectors += [(i, vectors[3][1]) for i in range(200, 240)] + [(300, None), (350, [1.0, None]), (301, [math.inf] * 8), (302, [math.nan] * 8), (303, [0.5, 0.5]), (304, []), (50, vectors[50][1]), (100, vectors[7][1])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id bigint, embedding array<double>, score int").repartition(3)
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, query_block=block, chunk=16, first_rows=first_rows).select("query_id", "rank", "vec_id", "score").collect())
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    padded = lambda v: v + [0] * (8 - len(v))
    for q, qv in {i: v for i, v in sorted(((i, padded(v)) for i, v in clean if i % 50 == 0), reverse=True)}.items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in clean if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    data = [(i, [float(x) for x in rng.integers(-(1 << 22), 1 << 22, 3)]) for i in range(60)]  # products beyond 2**53
    top = {(r.query_id, r.rank): r.score for r in topk.search(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, first_rows=1).collect()}
    for q in (0, 50):
        scores = sorted((sum(int(256 * a) * int(256 * b) for a, b in zip(data[q][1], v)) for i, v in data if i != q), reverse=True)[:5]
        assert [top[q, r] for r in range(1, 6)] == scores
    few = topk.search(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]


# -- 9 --------------------------------------------------------------------------------------------


def test_main_text_blocks():
    from filingspark.llm.html_main import ARTICLE, LOOSE, MARKED, blocks

    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>m</a></nav><!-- c --><div class='ad'>ad</div><main><h1>A &amp;&amp; B</h1><p>one<br>two\n <b>x</b>y<p>three &#233;<ul><li>i<li>j</ul><form>f</form><aside>s</aside>k</main><p>tail<div id=comments>c</div><footer>&copy;"
    assert [x for x, k in blocks(page) if k == ARTICLE] == ["A && B", "one two xy", "three é", "i", "j", "k"]
    assert [x for x, k in blocks(page) if k == LOOSE] == ["tail"]
    assert [x for x, k in blocks(page) if k == MARKED] == ["m", "ad", "f", "s", "c", "©"]
    assert blocks(None) == blocks("") == [] and blocks("plain < text")[0][0] == "plain < text"
    assert blocks("<p>a<" + "b" * 50000)
    kept = lambda page: [x for x, k in blocks(page) if k == ARTICLE]
    assert kept("<body class=nav><div class='with-sidebar'><p>s</p><article><div class='entry-header'><h1>T</h1></div><p>x</p><div class=share>n</div></article></div>") == ["T", "x"]
    assert kept("<main><p>x</p></main><section id=comments><article><p>no</p></article></section><aside><article>no</article></aside><article class='comment c2'>no</article>") == ["x"]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines():
    from filingspark.llm.html_main import shared_lines

    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in "ab")
        found = shared_lines(list(a), list(b))
        it = iter(b)
        assert len(found) == brute_lcs(a, b) and all(c in it for c in (a[i] for i in sorted(found)))


def test_page_differencing(spark):
    from filingspark.llm import html_main

    page = lambda body: f"<html><body><div>Site name</div><div>Home</div><div>{body}</div><div>Contact us</div></body></html>"
    rows = [(1, "http://h/a/1", page("first story")), (2, "http://h/a/2", page("second story")), (3, "http://other/x", page("alone")), (4, None, None), (5, "http://h/a/2", page("second story")), (6, "http://h/z", "<article><p>Site name</p></article>"), (7, "http://h/zz", "")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.page_id: (r.text, r.n_chars) for r in html_main.main_text(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = "Site name\nHome\nalone\nContact us"
    assert got[1] == ("first story", 11) and got[2][0] == "second story"
    assert got[3] == (whole, len(whole)) and got[4] == ("", 0) == got[7] and got[6][0] == "Site name"
    assert html_main.main_text(pages.limit(0)).count() == 0


def test_differencing_decides_article_pages(spark):
    from filingspark.llm import html_main

    page = lambda title, *body: f"<div>Site name</div><nav>menu</nav><main><p>{title}</p><p>Read in two minutes</p>{''.join(f'<p>{x}</p>' for x in body)}</main><div>note on {title}</div><div>Imprint</div>"
    rows = [(1, "http://h/a/1", page("one", "a quoted line")), (2, "http://h/a/2", page("two of some length", "a quoted line")), (3, "http://h/a/3", page("three of some length", "another line of the third"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.page_id: r.text.split("\n") for r in html_main.main_text(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[1] == ["one", "Read in two minutes", "a quoted line", "note on one"]  # a single neighbour deletes nothing of an article
    assert got[2] == ["two of some length", "a quoted line", "note on two of some length"]
    assert html_main.template(["x", "y"], bytes([0, 0]), [["x", "y", "z"], ["x", "y"]]) == set()  # copies of the article


def test_differencing_of_copies_and_task_edges(spark):
    from filingspark.llm import html_main

    page = lambda body: f"<div>Site name</div><div>Home</div><div>{body}</div><div>Imprint</div>"
    rows = [(1, "http://h/a/1", page("one")), *((10 + i, "http://h/a/2", page("copied")) for i in range(9)), (30, "http://h/a/3", page("three")), (40, "http://k/1", page("k one")), (41, "http://k/2", page("k two")), (50, "http://l/", page("alone"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    try:
        for n in (1, 2, 5, 14):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {r.page_id: r.text for r in html_main.main_text(pages).collect()}
            assert got == {1: "one", **{10 + i: "copied" for i in range(9)}, 30: "three", 40: "k one", 41: "k two", 50: "Site name\nHome\nalone\nImprint"}, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_main_text_keeps_what_only_looks_like_furniture():
    from filingspark.llm.html_main import ARTICLE, LOOSE, MARKED, blocks

    kept = lambda page: [x for x, k in blocks(page) if k == ARTICLE]
    assert kept('<article><p>one</p><p data-x="' + "a" * 5000 + ' > LEAK ">two</p></article>') == ["one", "two"]
    assert kept("<article><p>it's <a title=it's href='a>b'>a link</a></p></article>") == ["it's a link"]
    assert kept("<article><p>one<button>press<p>two</p><p>three</p></article>") == ["one", "two", "three"]
    assert kept("<article><p>one</p><script>var a = 1;<p>two</p></article>") == ["one", "two"]
    assert kept("<article><p>sum <math><mi>x</mi></math> of <object>y</object></p></article>") == ["sum x of y"]
    assert kept("<article><div class='related work'>a</div><p class='notice-of-law'>b</p><div class='related-posts'>no</div><div class=ad>no</div><p data-y='class=ad'>c</p></article>") == ["a", "b", "c"]
    assert [x for x, k in blocks("<body><nav>menu<p>text</body>") if k == LOOSE] == ["text"]
    assert [x for x, k in blocks("<body><nav>menu<p>text</p></nav>") if k == MARKED] == ["menu", "text"]
    for broken in ('<a "', "<a x='", "<p ", "<!--", "<script>", "<button>", "<![CDATA[", "<a x='\" y=\"'"):
        blocks(broken * 50_000)  # in time linear in the length


def test_differencing_against_brute_force(spark):
    """Every page's text by a plain version over the whole list, whatever the number of tasks."""
    import os

    from filingspark.llm import html_main as H

    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(90):
        tag = ["p", "div", "nav"]
        body = "".join(f"<{t}>{' '.join(rng.choice(words, rng.integers(1, 3)))}</{t}>" for t in rng.choice(tag, rng.integers(0, 7)))
        rows.append((i, f"http://h{rng.integers(0, 4)}/{'ab'[rng.integers(0, 2)]}/{rng.integers(0, 9)}", f"<div>site</div><main>{body}</main><div>foot</div>" if i % 5 else f"<div>site</div>{body}<div>foot</div>"))
    rows += [(100 + i, *rows[7][1:]) for i in range(6)]

    order = []
    for page_id, url, html in rows:
        found = H.blocks(html)
        host, path = H.url_key(url)
        order.append((host, path, page_id, found, tuple(x for x, k in found if k in (H.ARTICLE, H.LOOSE))))
    keys = {r.page_id: H.order_key(r.asDict()) for r in H.parse(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    order.sort(key=lambda x: keys[x[2]])
    runs: list[list] = []
    for x in order:
        if runs and (runs[-1][0][0], runs[-1][0][4]) == (x[0], x[4]):
            runs[-1].append(x)
        else:
            runs.append([x])
    want = {}
    for i, run in enumerate(runs):
        near = []
        for j, mine, other in ((i - 1, 0, -1), (i + 1, -1, 0)):
            if 0 <= j < len(runs) and runs[j][0][0] == run[0][0]:
                x = runs[j][other]
                near.append((-len(os.path.commonprefix([x[1], run[mine][1]])), [t for t, _ in x[3]]))
        near = [x for _, x in sorted(near, key=lambda x: x[0])]
        for x in run:
            kinds = bytes(k for _, k in x[3] if k in (H.ARTICLE, H.LOOSE))
            gone = H.template(list(x[4]), kinds, near)
            want[x[2]] = "\n".join(t for k, t in enumerate(x[4]) if k not in gone)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    try:
        for n in (1, 7, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {r.page_id: r.text for r in H.main_text(pages).collect()} == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# -- the pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    from filingspark.llm import simhash

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left, counts = docs, [docs.count()]
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, left, d)
        out.write.parquet(str(tmp_path / str(i)))
        left = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(C.STAGES) - 1:
            assert left.columns == docs.columns
            counts.append(left.count())
        if name == "near duplicates":
            prints = simhash.near_duplicates(left)
            assert prints.where("doc_id <> component_id").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    assert left.select("doc_id").distinct().count() == counts[-1]
    assert C.run(spark, d).count() == left.count()


def test_near_copies_reach_similarity(spark):
    import corpus_pipeline as C
    from filingspark.llm import simhash

    rng = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(4):
            copy = list(base)
            for at in rng.choice(300, rng.integers(1, 12), replace=False):
                copy[at] = "changed" + str(at)
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    prints = [simhash.fingerprint(" ".join(t)) % (1 << 64) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None), (902, "one two three four"), (903, "one two three  Four"), (904, "five"), (905, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    left = {r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect()}
    assert left == {*root, 900, 902, 904, 905}
    assert C.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("part, hashes, rare", [(1024, 1 << 19, 32), (20, 1 << 19, 2), (1024, 1500, 2)])
def test_no_pair_of_a_crowded_bucket_is_dropped(spark, monkeypatch, part, hashes, rare):
    """All texts under one key: each pair of near copies links, whichever is checked first."""
    from filingspark.llm import minhash

    for name, value in (("PART", part), ("PART_HASHES", hashes), ("RARE", rare)):
        monkeypatch.setattr(minhash, name, value)
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(20)]
    texts = []
    for i in range(90):
        base = common + [f"w{x}" for x in rng.integers(0, 5000, 10 + i % 50)]
        texts += [" ".join(base), " ".join(base + [f"x{i}y{k}" for k in range(i % 14)])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = want[i], want[j]
                want = [min(a, b) if r in (a, b) else r for r in want]
    assert 90 < len(set(want)) < 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = minhash.prints(docs).withColumn("bands", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).cache()
    doc_of = {r.set_id: r.doc_id for r in found.collect()}
    got = list(range(len(texts)))
    for r in minhash.similar_sets(docs, found, 0.8).collect():
        a, b = got[doc_of[r.a]], got[doc_of[r.b]]
        got = [min(a, b) if r in (a, b) else r for r in got]
    least = {s: min(i for i, t in enumerate(texts) if t == texts[d]) for s, d in doc_of.items()}
    assert [got[doc_of[s]] == got[doc_of[u]] for s in least for u in least] == [want[least[s]] == want[least[u]] for s in least for u in least]


def test_near_duplicates_keep_one_row(spark):
    import corpus_pipeline as C

    rows = [(1, "a first text of some words"), (5, "a first text of some words"), (5, "quite another story that stands alone"), (6, "one more"), (6, "one more"), (None, "one more"), (None, "nobody knows this"), (None, "nobody knows this")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    left = sorted((r.doc_id or 0, r.text) for r in C.drop_near_duplicates(spark, docs, "").collect())
    assert left == sorted([(1, rows[0][1]), (5, rows[2][1]), (6, "one more"), (0, "nobody knows this")])


def test_near_duplicates_write_small_tables_in_few_files(spark):
    """However many shuffle partitions there are; the same rows stay."""
    import corpus_pipeline as C
    from filingspark.llm.common import shared_dir

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 40)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 500, t + " end") for i, t in enumerate(texts)] + [(i + 1000, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    top = shared_dir(spark).removeprefix("file://") + "/filingspark"
    before, was = set(os.listdir(top)) if os.path.isdir(top) else set(), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(was, ("40", "false")):
            spark.conf.set(k, v)
        left = C.drop_near_duplicates(spark, docs, "")
        assert sorted(r.doc_id for r in left.collect()) == list(range(150))
        files = {t: sum(f.endswith(".parquet") for f in os.listdir(f"{top}/{t}")) for t in set(os.listdir(top)) - before}
        assert len(files) > 8 and max(files.values()) <= spark.sparkContext.defaultParallelism >= left.rdd.getNumPartitions()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_pipeline_bounds_what_a_worker_gets_at_once(spark):
    import pyarrow as pa
    import corpus_pipeline as C
    from filingspark.llm.common import bound_batches

    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    was = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    try:
        C.pack(spark, rows, "")
        seen = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
        assert sum(seen) == 4000 and max(seen) * 5000 < 5 << 20
        spark.conf.set(key, "1m")
        bound_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, was)


def test_pipeline_gives_token_ids(spark, docs):
    import corpus_pipeline as C
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = sorted((r for r in C.pack(spark, docs, "").collect() if r.doc_id == 1), key=lambda r: r.start)
    assert [t for r in rows for t in r.ids] == Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(TEXTS[0][1], add_special_tokens=False).ids + [1]


def test_registered_queries_run_on_small_tables(spark):
    from filingspark.llm.queries import ORACLE_SQL, QUERIES

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name in ("op1_decontamination", "op5_simhash", "op6_langid", "op8_quality", "op10_toxicity"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == n
