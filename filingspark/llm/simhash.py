"""SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is 1 if it is set in more than half the XXH64 hashes (seed 42) of a text's
3-word shingles, repeats counted. Two fingerprints link at `radius` or fewer differing bits;
a component's id is the least doc_id in it.

Equal fingerprints meet in an aggregation first, so a group of copies of any size is one node, the
fingerprint itself. Nodes are dealt to tiles by pigeonhole: of `blocks` bit fields, two fingerprints
within the radius agree on at least blocks - radius, so each node goes under every choice of
blocks - radius fields. (A sweep of tiles over all fingerprints would cost by the square of their
number; the fields only keep apart what cannot link.) A bucket of more than `tile` nodes is split:
its nodes are dealt into parts, and every pair of parts becomes a task-sized unit of its own. A
bucket of more than `wide` nodes would make too many of these: its nodes go under choices of six of
nine fields instead, which any two within three bits agree on as well. Within a unit, fingerprints
are sorted by population count and cut into small tiles; a pair of tiles whose counts differ beyond
the radius is skipped, the others are compared with numpy exclusive-or and bit counts. Of the links
found a unit passes on a spanning forest, which keeps components whole without passing on all pairs.
Components come from alternating large-star and small-star steps on tables in the shared folder.
Keys that many rows share (fingerprints of many copies, nodes of many links) are few, and meet their
row's facts by broadcast, behind a check of their number.

Defined results: null, empty and wordless texts have the fingerprint zero, linked like any other;
a text of fewer than three words has one shingle, all its words; repeated doc_ids come out as
often as they went in; a null doc_id is a document like any other, in no component's id: a
component without any id has null for its id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingspark.llm.common import in_few, join_facts, materialize, text_chunks, to_batch

_SPACES = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SMALL_TILE = 256


def shingle_hashes(text: str | None) -> tuple[np.ndarray, int]:
    """The hashes of a text's shingles in order, and the number of its words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_SPACES).split()
    if not words:
        return np.zeros(0, dtype=np.uint64), 0
    n = max(1, len(words) - 2)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)), dtype=np.uint64, count=n), len(words)


def fingerprint_of(h: np.ndarray) -> int:
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    return fingerprint_of(shingle_hashes(text)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a bigint."""
    docs = documents.select("doc_id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            yield to_batch({"doc_id": part.column("doc_id"), "fp": [fingerprint(t) for t in part.column("text").to_pylist()]}, schema)

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, fp bigint")


def bucket_keys(fp: Column, blocks: int, radius: int) -> Column:
    """An array of (choice number and the chosen fields' bits, hashed to 64 bits) keys. A collision
    only puts strangers in one bucket, and they are compared exactly."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(sum(c))))) for i, c in enumerate(combinations(masks, blocks - radius))))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs within the radius, between fingerprint arrays sorted by population count."""
    pa_, pb = np.bitwise_count(a), np.bitwise_count(b)
    left, right = [], []
    for i in range(0, len(a), SMALL_TILE):
        x = a[i : i + SMALL_TILE]
        low, high = int(pa_[i]) - radius, int(pa_[min(i + SMALL_TILE, len(a)) - 1]) + radius
        for j in range(i if same else 0, len(b), SMALL_TILE):
            if int(pb[min(j + SMALL_TILE, len(b)) - 1]) < low:
                continue
            if int(pb[j]) > high:
                break
            m, n = np.nonzero(np.bitwise_count(x[:, None] ^ b[None, j : j + SMALL_TILE]) <= radius)
            m, n = m + i, n + j
            if same:
                keep = m < n
                m, n = m[keep], n[keep]
            left.append(m)
            right.append(n)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of the links among n nodes, those of a spanning forest."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(left.tolist(), right.tolist()):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def unit_links(fp: np.ndarray, node: np.ndarray, part: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one unit. part tells the two parts of a split bucket apart."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, node, part = fp[order], node[order], part[order]
    kinds = np.unique(part)
    if len(kinds) != 2:
        i, j = close_pairs(fp, fp, radius, True)
    else:
        x, y = np.flatnonzero(part == kinds[0]), np.flatnonzero(part == kinds[1])
        i, j = close_pairs(fp[x], fp[y], radius, False)
        i, j = x[i], y[j]
    return [(int(node[a]), int(node[b])) for a, b in forest(len(fp), i, j)]


def links(nodes: DataFrame, *, radius: int = 3, blocks: int = 5, tile: int = 512, wide: int = 1 << 15, rows: int | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all links. nodes: node (bigint, not null,
    distinct) and fp; rows: about how many, if known."""
    spark = nodes.sparkSession
    keyed = nodes.select("node", "fp", F.explode(bucket_keys(F.col("fp"), blocks, radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes if rows is None else in_few(sizes, 5 * rows), "bucket-sizes")
    met = keyed.join(sizes.where(F.col("n") <= wide), "key")
    if radius <= 3 and sizes.where(F.col("n") > wide).limit(1).count():
        crowded = keyed.join(sizes.where(F.col("n") > wide).select("key"), "key", "left_semi").select("node", "fp").distinct()
        again = crowded.select("node", "fp", F.explode(bucket_keys(F.col("fp"), 9, 3)).alias("key"))
        met = met.unionByName(again.join(again.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))
    units = (
        met.withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", "fp", "part", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "key")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(n, "unit").sortWithinPartitions("unit", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> Iterator[tuple[int, int]]:
            if not len(rows):
                return
            unit = rows[0]
            bounds = np.flatnonzero(np.diff(unit)) + 1
            starts, stops = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(unit)]])
            size = stops - starts
            pairs = starts[size == 2]  # most units: compared all at once
            close = pairs[(np.bitwise_count((rows[1][pairs] ^ rows[1][pairs + 1]).view(np.uint64)) <= radius)]
            yield from zip(rows[2][close].tolist(), rows[2][close + 1].tolist())
            for s, e in zip(starts[size > 2].tolist(), stops[size > 2].tolist()):
                yield from unit_links(rows[1][s:e].view(np.uint64), rows[2][s:e], rows[3][s:e], radius)

        for batch in batches:
            new = np.stack([np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in ("unit", "fp", "node", "part")])
            rows = np.concatenate([*held, new], axis=1) if held else new
            if not rows.shape[1]:
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))  # the last unit may go on
            out = list(done(rows[:, :last])) if last else []
            held = [rows[:, last:]]
            if out:
                yield to_batch({"a": [x[0] for x in out], "b": [x[1] for x in out]}, schema)
        if held:
            out = list(done(held[0]))
            if out:
                yield to_batch({"a": [x[0] for x in out], "b": [x[1] for x in out]}, schema)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, *, name: str = "component", most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """node -> component (least node reachable), for nodes that have a link. rows: about how many
    edges there are, if known.

    Alternates large-star and small-star until the links no longer change; each round is written
    to the shared folder."""
    pairs = lambda df: df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    first = pairs(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    now = materialize(first if rows is None else in_few(first, rows), name)
    state = digest(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        # large star: every larger neighbour of u links to u's least neighbour (or u)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = pairs(join_facts(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: smaller neighbours of u, and u, link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_facts(large, low, "u")
        small = pairs(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))
        after = materialize(in_few(small, 2 * state[0]), name)
        new = digest(after)
        now, done, state = after, new == state, new
        if done:
            break
    else:
        raise RuntimeError(f"components: no fixed point in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(documents: DataFrame, *, radius: int = 3, blocks: int = 5, tile: int = 512, wide: int = 1 << 15) -> DataFrame:
    """Per document: doc_id, fp (bigint), component_id."""
    return classes(materialize(fingerprints(documents), "fingerprints"), radius=radius, blocks=blocks, tile=tile, wide=wide)


def classes(prints: DataFrame, *, radius: int = 3, blocks: int = 5, tile: int = 512, wide: int = 1 << 15) -> DataFrame:
    """Rows of doc_id and fp with component_id, the least doc_id that links reach."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    of = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius=radius, blocks=blocks, tile=tile, wide=wide))
    linked = of.withColumnRenamed("node", "fp").unionByName(of.select(F.col("component").alias("fp"), "component").distinct())
    of_linked = materialize(nodes.join(linked, "fp").select("fp", "component", "least"), "linked")
    ids = of_linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_facts(of_linked.select("fp", "component"), ids, "component").select("fp", "component_id")
    names = nodes.join(named, "fp", "left").select("fp", "n", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return join_facts(prints, materialize(names, "names"), "fp").select("doc_id", "fp", "component_id")
