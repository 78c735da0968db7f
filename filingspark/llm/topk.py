"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are split into `lists` ranges; a range's part of the inner product is
the score that its list holds for the row. Phase one gathers, on a share of the rows, each query's k
highest entries of every list, and resolves those rows exactly. The k-th best of them is a safe
cutoff whatever rows were looked at: at least k rows reach it. Phase two: the cutoff is broadcast,
and all rows' entries are collected, one list after the other. An entry not yet collected is at most
the product of the norms of the two parts; rows whose collected entries and that bound cannot reach
the cutoff for any query are left out of the lists that follow. Phase three: what is left after the
last list is resolved: its entries' sum is its score.

Queries are taken in blocks of at most `query_block` rows, each against all rows, so what is
broadcast and what a task holds per query have a bound; with several blocks, each block's result is
written to a table in the shared folder, so the plan does not grow. Rows are scored in chunks of
`chunk`.

Components become floor(scale * x). Vectors that are null, or hold a null or non-finite component,
take no part. Vectors of different lengths are compared as if the shorter ended in zeros. Ties go
to the smaller id; a repeated row is a candidate as often as it occurs; a query id with several
vectors is answered once, for the first of them in order of components. A query is no candidate of
its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingspark.llm.common import hash_place, new_path, to_batch

_SCORED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def dense(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the integer matrix of a batch's valid vectors, shorter ones filled with zeros."""
    column = batch.column("embedding")
    lists = column.to_pylist() if column.null_count or column.flatten().null_count else None
    if lists is None:
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(sizes) and (sizes == sizes[0]).all():
            m, ids = values.reshape(len(sizes), -1), batch.column("vec_id").to_numpy(zero_copy_only=False)
            keep = np.isfinite(m).all(axis=1)
            return ids[keep], np.floor(scale * m[keep]) + 0.0
        lists = column.to_pylist()
    rows = [(i, v) for i, v in zip(batch.column("vec_id").to_pylist(), lists) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    m = np.zeros((len(rows), max((len(v) for _, v in rows), default=0)))
    for r, (_, v) in enumerate(rows):
        m[r, : len(v)] = v
    return np.array([i for i, _ in rows], dtype=np.int64), np.floor(scale * m) + 0.0


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def parts_of(width: int, lists: int) -> list[slice]:
    edges = [round(i * width / lists) for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a] or [slice(0, 0)]


def list_scores(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Per list the [queries, rows] partial inner products: exact in doubles while they stay below
    2**53, else in 64-bit integers."""
    width = max(q.shape[1], x.shape[1])
    q, x = _fit(q, width), _fit(x, width)
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * width >= 2.0**53:
        q, x = q.astype(np.int64), x.astype(np.int64)
    return [q[:, p] @ x[:, p].T for p in parts_of(width, lists)]


def first_phase(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query the k best exact scores among the k highest entries of each list."""
    parts = list_scores(q, x, lists)
    total = sum(parts[1:], parts[0])
    take = min(k + 1, len(ids))
    chosen = np.sort(np.concatenate([np.argpartition(-p, take - 1, axis=1)[:, :take] for p in parts], axis=1), axis=1)
    fresh = np.concatenate([np.ones((len(chosen), 1), dtype=bool), chosen[:, 1:] != chosen[:, :-1]], axis=1)
    r, at = np.nonzero(fresh & (q_ids[:, None] != ids[chosen]))
    c = chosen[r, at]
    return best_of(q_ids[r], ids[c], total[r, c].astype(np.int64), k)


def later_phases(q_ids: np.ndarray, q: np.ndarray, cutoff: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of the rows that reach the cutoff, the k best per query."""
    width = max(q.shape[1], x.shape[1])
    q, x = _fit(q, width), _fit(x, width)
    exact = not (q.size and x.size and np.abs(q).max() * np.abs(x).max() * width >= 2.0**53)
    parts = parts_of(width, lists)
    total = None
    for i, p in enumerate(parts):
        part = q[:, p] @ x[:, p].T if exact else q[:, p].astype(np.int64) @ x[:, p].astype(np.int64).T
        total = part if total is None else total + part
        left = slice(p.stop, width)
        if i + 1 == len(parts) or not len(ids):
            break
        # a little more than the product of the norms, for what rounding may take off
        bound = np.linalg.norm(q[:, left], axis=1)[:, None] * (np.linalg.norm(x[:, left], axis=1) * (1 + 1e-9) + 1e-6)
        alive = (total + bound >= cutoff[:, None]).any(axis=0)
        if alive.sum() < 0.8 * len(ids):
            ids, x, total = ids[alive], x[alive], total[:, alive]
    r, c = np.nonzero((total >= cutoff[:, None]) & (q_ids[:, None] != ids[None, :]))
    return best_of(q_ids[r], ids[c], total[r, c].astype(np.int64), k)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, dtype=int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[rank < k], ids[rank < k], score[rank < k]


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, lists: int = 4, query_block: int = 8192, chunk: int = 512, first_share: float = 1 / 16, first_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. vectors needs vec_id and embedding. Phase one looks at
    first_share of the rows, about first_rows at least; the result does not depend on it."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    queries = rows.where(is_query)
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks = max(1, -(-n_queries // query_block))
    ddl = "query_id bigint, vec_id bigint, score bigint"
    share = max(first_share, first_rows / max(1, n_rows))
    looked = rows if share >= 1 else rows.where(hash_place("vec_id") <= share).repartition(max(1, -(-int(share * n_rows) // (4 * first_rows))))
    path = new_path(spark, "top-k") if blocks > 1 else None

    def scan(work, held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[tuple[np.ndarray, ...]] = []
            for batch in batches:
                for i in range(0, batch.num_rows, chunk):
                    ids, x = dense(batch.slice(i, chunk), scale)
                    if len(ids):
                        found.append(work(*held.value, ids, x))
                        if sum(len(f[0]) for f in found) > 200_000:
                            found = [best_of(*map(np.concatenate, zip(*found)), k)]
            if found:
                yield to_batch(dict(zip(_SCORED.names, best_of(*map(np.concatenate, zip(*found)), k))), _SCORED)

        return run

    out = None
    for block in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        got = [dense(b, scale) for b in chosen.toArrow().combine_chunks().to_batches()]
        got = [g for g in got if len(g[0])]
        if not got:
            continue
        width = max(m.shape[1] for _, m in got)
        q_ids, q = np.concatenate([i for i, _ in got]), np.concatenate([_fit(m, width) for _, m in got])
        order = np.lexsort((*q.T[::-1], q_ids))
        q_ids, at = np.unique(q_ids[order], return_index=True)
        q = q[order][at]
        held = spark.sparkContext.broadcast((q_ids, q))
        first = looked.mapInArrow(scan(lambda qi, qm, ids, x: first_phase(qi, qm, ids, x, k, lists), held), ddl)
        cutoffs = {r[0]: r[1] for r in _best(first, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score"))).collect()}
        floor = -float(np.iinfo(np.int64).max)
        cutoff = np.array([floor if cutoffs.get(i) is None else cutoffs[i] for i in q_ids.tolist()], dtype=np.float64)
        held2 = spark.sparkContext.broadcast((q_ids, q, cutoff))
        out = _best(rows.mapInArrow(scan(lambda qi, qm, cut, ids, x: later_phases(qi, qm, cut, ids, x, k, lists), held2), ddl), k)
        if path:
            out.write.mode("append").parquet(path)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint, rank int")
    elif path:
        out = spark.read.schema(out.schema).parquet(path)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
