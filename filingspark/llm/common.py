"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and all runs in one process (a local test) is a temporary
    folder made; on a cluster its absence is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN_DIR.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="filingspark-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/filingspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it again: a cut in the lineage
    that survives the loss of executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 50_000


def in_few(df: DataFrame, rows: int, a_task: int = ROWS_A_TASK) -> DataFrame:
    """df, of about so many rows, in a partition per `a_task` rows, one per core at least and never
    more than it has. Written, a small table has few files however many shuffle partitions there are:
    for each file on a local disk Hadoop starts processes, which for a moment share all of the JVM's
    memory."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // a_task)))


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on no more than about BATCH_BYTES, or one row, go to a Python worker at once; Spark's
    own bounds are 64 MB and 10,000 rows. JVM and worker both hold a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(col: Column, mod: int) -> Column:
    """crc32 of an id written as text, modulo mod."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod))


def crc_bucket_py(value, mod: int) -> int:
    return zlib.crc32(str(value).encode()) % mod


KEPT: dict[str, object] = {}  # tables that a worker keeps from task to task, by name


def release(keep: str | None = None) -> None:
    """Drop all of KEPT but `keep` and give free memory back to the system. A Python worker lives on
    from task to task, and what the allocators and other operators' tables keep would add up while
    the JVM beside it needs the memory."""
    if others := KEPT.keys() - {keep}:
        for k in others:
            del KEPT[k]
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20, rows: int = 4096, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text, or one row, so that
    what a task holds at once has a bound whatever the length of the texts. Free memory is given
    back before the first and after the last; keep: the name in KEPT of the task's own table."""
    release(keep)
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("float64"))
        ends = np.cumsum(sizes)
        while start < n:
            base = ends[start - 1] if start else 0.0
            stop = int(np.searchsorted(ends, base + limit, side="right"))
            stop = min(max(stop, start + 1), start + rows, n)
            yield batch.slice(start, stop - start)
            start = stop
    release(keep)


def run_sums(value: Callable[[int, int], np.ndarray], starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Sums of value(a, b), the values of places a to b, over runs that begin at `starts` and follow
    each other to n. Values are made for `window` places at a time; a run may span windows."""
    out = None
    for a in range(int(starts[0]), n, window):
        b = min(n, a + window)
        first, stop = int(np.searchsorted(starts, a, side="right")) - 1, int(np.searchsorted(starts, b, side="left"))
        part = np.add.reduceat(value(a, b), np.concatenate([[0], starts[first + 1 : stop] - a]), axis=0)
        if a == int(starts[0]) and b == n:
            return part
        if out is None:
            out = np.zeros((len(starts), *part.shape[1:]), dtype=np.float64 if part.dtype.kind == "f" else part.dtype)
        out[first:stop] += part
    return out


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows (null: no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def to_batch(data: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(k).type) for k, x in ((f.name, data[f.name]) for f in schema)], schema=schema)


HOT_ROWS, MOST_HOT_KEYS = 20_000, 200_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with the facts of their key; rows without facts go. facts: a row per key, with
    n, the number of rows of that key. Keys of more than HOT_ROWS rows are at most one in HOT_ROWS
    rows; if they are at most MOST_HOT_KEYS, they meet their rows by broadcast, so that no task gets
    all rows of one."""
    hot, most = HOT_ROWS, MOST_HOT_KEYS
    often = facts.where(F.col("n") > hot)
    keys = len(often.select(key).take(most + 1))
    rest = facts.drop("n")
    if not 0 < keys <= most:
        return rows.join(rest, key)
    wide = F.broadcast(often.drop("n"))
    cold = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(facts.where(F.col("n") <= hot).drop("n"), key)
    return rows.join(wide, key).unionByName(cold)


def hash_place(key: str) -> Column:
    """A place from 0 to 1 that a row's key hashes to, the same however the table is cut."""
    return F.xxhash64(F.lit(11), F.col(key).cast("string")) / F.lit(2.0**64) + 0.5


def stretch(text: str, key: str, chars: int) -> Column:
    """A text of at most `chars` characters whole; of a longer one a stretch from a place that its
    key hashes to. Feeds the fitting of classifiers only."""
    start = F.pmod(F.xxhash64(F.lit(5), F.col(key).cast("string")), F.greatest(F.length(text) - chars + 1, F.lit(1))) + 1
    return F.when(F.length(text) > chars, F.substr(F.col(text), start.cast("int"), F.lit(chars))).otherwise(F.col(text))
