"""Near copies for a training corpus: five-word shingle sets of Jaccard similarity 0.8 or more, and
SimHash fingerprints within the radius.

Sets are 64-bit hashes of a text's five-word shingles (words as in simhash; a shorter text has one
shingle, all its words). Candidates share one of BANDS keys of ROWS MinHash values each: of pairs at
similarity 0.8 all but 1 in 30,000 do, and more of those above. They are checked exactly. Equal sets
are one node. In each bucket the node with the least number is checked against the others; after
that only buckets whose nodes are still in different components are looked at again, and every pair
in different components is checked: of a bucket of at most SMALL nodes as a row of its own; a larger
one is dealt into parts, and pairs of parts are compared at once, by counting the hashes that sets
share. Parts of the bucket's widest component are not compared with each other. So no pair that shares
a key goes unchecked; a crowded bucket costs the number of nodes outside its widest component times
the number of all.

Defined results: as in simhash; a null doc_id is a document like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingspark.llm.common import in_few, materialize, text_chunks, to_batch
from filingspark.llm.simhash import components, fingerprint_of, forest, links, shingle_hashes

ROWS, BANDS = 4, 20
SETS_A_TASK = 5000
SMALL = 64
PART, PART_HASHES = 1024, 1 << 19  # nodes and hashes of a part, on average
RARE = 32
_RANDOM = np.random.default_rng(8)
_FACTORS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def shingle_set(h: np.ndarray, n_words: int) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles, from those of the three-word shingles: the
    first and the last three words of five tell all five."""
    if not n_words:
        return h[:0]
    a, b = (h[:-2], h[2:]) if n_words >= 5 else (h[:1], h[-1:] + np.uint64(n_words))
    mixed = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def band_keys(found: np.ndarray) -> list[int]:
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, (found[i : i + 1024, None] * _FACTORS + _TERMS).min(axis=0))
    keys = [xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def set_id(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), 5)).view(np.int64))


def row_key():
    """A row's key: equal for rows of equal doc_id and text."""
    return F.xxhash64("doc_id", F.lit("|"), "text")


def prints(documents: DataFrame) -> DataFrame:
    """row, doc_id, fp (the SimHash fingerprint), set_id, bands (band keys)."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("set_id", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            hashed = [shingle_hashes(t) for t in part.column("text").to_pylist()]
            sets = [shingle_set(*x) for x in hashed]
            yield to_batch({"row": part.column("row"), "doc_id": part.column("doc_id"), "fp": [fingerprint_of(h) for h, _ in hashed], "set_id": [set_id(s) for s in sets], "bands": [band_keys(s) for s in sets]}, schema)

    return documents.select(row_key().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "row bigint, doc_id bigint, fp bigint, set_id bigint, bands array<bigint>")


def sets_of(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """set_id and hashes (the set, eight bytes each) of the rows."""
    schema = pa.schema([("set_id", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            sets = [shingle_set(*shingle_hashes(t)) for t in part.column("text").to_pylist()]
            yield to_batch({"set_id": [set_id(s) for s in sets], "hashes": [s.tobytes() for s in sets]}, schema)

    return documents.select(row_key().alias("row"), "text").join(rows, "row", "left_semi").mapInArrow(run, "set_id bigint, hashes binary").dropDuplicates(["set_id"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are that similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64) for c in ("x", "y"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    out["a"].append(batch.column("a")[i].as_py())
                    out["b"].append(batch.column("b")[i].as_py())
            yield to_batch(out, schema)

    left = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes each set of left shares with each of right (indices into sets)."""
    n = len(sets)
    flat, holder = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], holder[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    times = np.diff(np.concatenate([starts, [len(flat)]]))
    token, often = np.repeat(np.arange(len(starts)), times), np.repeat(times, times)
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    few = (often > 1) & (often <= RARE)
    t, h = token[few], holder[few]  # of rare hashes, the pairs of holders
    place = np.full((2, n), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for d in range(1, RARE):
        same = np.flatnonzero(t[d:] == t[:-d])
        if not len(same):
            break
        for x, y in ((h[same], h[same + d]), (h[same + d], h[same])):
            i, j = place[0, x], place[1, y]
            met = (i >= 0) & (j >= 0)
            both += np.bincount(i[met] * len(right) + j[met], minlength=both.size).reshape(both.shape)
    t, h = token[often > RARE], holder[often > RARE]  # of others, a product of matrices
    if len(t):
        t = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]]))
        for a in range(0, int(t[-1]) + 1, 1024):
            i, j = np.searchsorted(t, [a, a + 1024])
            has = np.zeros((n, 1024), dtype=np.float32)
            has[h[i:j], t[i:j] - a] = 1
            both += (has[left] @ has[right].T).astype(np.int64)
    return both


def unit_links(ids: np.ndarray, component: np.ndarray, part: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links between the two parts of a unit, or within its one part, of similar sets in
    different components."""
    kinds = np.unique(part)
    left, right = np.flatnonzero(part == kinds[0]), np.flatnonzero(part == kinds[-1])
    both, n = overlaps(sets, left, right), np.array([len(s) for s in sets])
    near = (both >= similarity * (n[left][:, None] + n[right] - both)) & (component[left][:, None] != component[right])
    i, j = np.nonzero(near)
    return [(int(ids[x]), int(ids[y])) for x, y in forest(len(ids), left[i], right[j])]


def crowded_links(told: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the similar sets of a bucket that are in different components. told: key,
    set_id, size (its hashes), component."""
    shares = told.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    bins = shares.groupBy("key").agg(F.max(F.struct("n", "component", "size")).alias("home"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.ceil(F.greatest(n / PART, size / PART_HASHES)).cast("int")
    bins = bins.select("key", F.col("home.component").alias("home"), parts(F.col("home.n"), F.col("home.size")).alias("first"), parts(F.col("n") - F.col("home.n"), F.col("size") - F.col("home.size")).alias("rest"))
    at_home, number = F.col("component") == F.col("home"), F.xxhash64("set_id", F.lit(7))
    dealt = (
        told.join(bins, "key")
        .withColumn("part", F.when(at_home, F.pmod(number, "first")).otherwise(F.col("first") + F.pmod(number, "rest")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(at_home, F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("rest") - 1)))
        .select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "component", "set_id")
    )

    def run(unit: pa.Table) -> pa.Table:
        ids, component, part = (unit.column(c).to_numpy() for c in ("set_id", "component", "part"))
        held = [np.frombuffer(h, dtype=np.uint64) for h in unit.column("hashes").to_pylist()]
        p, q = unit.column("p")[0].as_py(), unit.column("q")[0].as_py()
        found = unit_links(ids, component, part, held, similarity) if p == q or len(np.unique(part)) == 2 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.join(sets, "set_id").groupBy("key", "p", "q").applyInArrow(run, "a bigint, b bigint")


def similar_sets(documents: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of set ids whose components are those of all similar pairs. found: prints."""
    n = found.count()
    nodes = found.groupBy("set_id").agg(F.min("row").alias("row"), F.first("bands").alias("bands"))
    keyed = nodes.select("set_id", "row", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("leader")).where("n > 1")
    met = materialize(in_few(keyed.join(sizes, "key").select("key", "set_id", "row", "leader"), BANDS * n), "buckets")
    sets = materialize(in_few(sets_of(documents, met.select("row").distinct()), n, SETS_A_TASK), "sets")
    stars = met.where("set_id <> leader").select(F.col("leader").alias("a"), F.col("set_id").alias("b")).distinct()
    near = materialize(in_few(verified(stars, sets, similarity), n, SETS_A_TASK), "stars")
    of = components(near, name="star-component", rows=n).select(F.col("node").alias("set_id"), "component")
    told = met.join(of, "set_id", "left").select("key", "set_id", F.coalesce("component", "set_id").alias("component"), "leader")
    mixed = told.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high AND n > 2").select("key", "n")
    open_ = materialize(in_few(told.where("set_id <> leader").join(mixed, "key"), BANDS * n), "open")
    pairs = open_.where(F.col("n") <= SMALL)
    a = pairs.select("key", F.col("set_id").alias("a"), F.col("component").alias("ca"))
    b = pairs.select("key", F.col("set_id").alias("b"), F.col("component").alias("cb"))
    rest = a.join(b, "key").where("a < b AND ca <> cb").select("a", "b").distinct()
    near = near.unionByName(verified(rest, sets, similarity))
    crowded = open_.where(F.col("n") > SMALL)
    if crowded.limit(1).count():
        crowded = crowded.join(sets.select("set_id", (F.length("hashes") / 8).alias("size")), "set_id").select("key", "set_id", "size", "component")
        near = near.unionByName(crowded_links(crowded, sets, similarity))
    return near


def near_copies(documents: DataFrame, *, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """Per document: row (its row_key), doc_id, component (a number). Fingerprints within the
    radius and sets of that similarity link."""
    found = materialize(prints(documents), "prints")
    kinds = found.select("fp", "set_id").distinct().withColumn("node", F.xxhash64("fp", "set_id"))
    n = found.count()
    kinds = materialize(in_few(kinds, n), "kinds")
    by_print = kinds.groupBy("fp").agg(F.min("node").alias("node"))
    by_set = kinds.groupBy("set_id").agg(F.min("node").alias("b"))
    sets = similar_sets(documents, found, similarity)
    first, second = by_set.select(F.col("set_id").alias("a"), F.col("b").alias("left")), by_set.select(F.col("set_id").alias("b"), F.col("b").alias("right"))
    edges = [
        links(by_print, radius=radius, rows=n),
        kinds.join(by_print.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b"),
        kinds.join(by_set, "set_id").where("node <> b").select(F.col("node").alias("a"), "b"),
        sets.join(first, "a").join(second, "b").select(F.col("left").alias("a"), F.col("right").alias("b")),
    ]
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    of = components(every, rows=2 * n)
    names = kinds.join(of, "node", "left").select("fp", "set_id", F.coalesce("component", "node").alias("component"))
    return found.select("row", "doc_id", "fp", "set_id").join(names, ["fp", "set_id"]).select("row", "doc_id", "component")
