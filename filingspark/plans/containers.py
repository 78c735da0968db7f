"""Queries of containers: filings written from the orders into archives, folders and tables, read back,
against the orders."""

from __future__ import annotations

import io
import itertools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.operators import compare as C
from filingspark.operators.extract import extract
from filingspark.plans.documents import _HEAD, _TAIL
from filingspark.plans.facts import FACTS, facts
from filingspark.schemas import FACT
from filingspark.sources import archives as A
from filingspark.sources import tables
from filingspark.sources.datasource import read_filings

ARCHIVE_BYTES, FOLDER_TABLES = 16 << 20, 10_000


def scratch(spark: SparkSession) -> str:
    """A new folder that all tasks reach: under spark.checkpoint.dir, or, where all runs in one
    process, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        folder = f"{named.removeprefix('file://')}/filings-{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="filings-")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and content: one filing per customer, with a fact per order."""
    fact = F.concat(F.lit('<ix:nonNumeric name="core:Order">'), F.col("o_orderkey").cast("string"), F.lit("</ix:nonNumeric>"))
    each = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.array_join(F.collect_list(fact), "").alias("body"))
    name = F.concat(F.lit("Prod1_1_"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("_20200101.html"))
    return each.select(name.alias("name"), F.concat(F.lit(_HEAD), "body", F.lit(_TAIL)).cast("binary").alias("content"))


def _zip(files: dict[str, bytes], path: str) -> None:
    A.pack_zip(files, path, "a/b/")
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("a/readme.txt", "not a member")
        z.writestr("__MACOSX/a.html", "nor this")


def _nested(files: dict[str, bytes], path: str) -> None:
    """Each filing in a zip of its own, in the folder accounts; another folder is not read."""
    with zipfile.ZipFile(path, "w") as out:
        for name, data in sorted(files.items()):
            inner = io.BytesIO()
            with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"accounts/{name}", data)
                z.writestr("cic34/other.html", "<p>")
            out.writestr(f"x/{name}.zip", inner.getvalue())


def _folder(files: dict[str, bytes], path: str) -> None:
    os.makedirs(path, exist_ok=True)
    for name, data in files.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)


def _written(members: DataFrame, write, ending: str) -> list[str]:
    """Paths of the archives that hold the members. A task ends an archive at ARCHIVE_BYTES, so it
    holds no more at once, and there are more archives, not larger ones, as the input grows."""
    folder = scratch(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, bytes] = {}
        size = n = 0

        def close() -> pa.RecordBatch:
            nonlocal size, n
            path = f"{folder}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}-{n}{ending}"
            write(files, path)
            files.clear()
            size, n = 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for b in batches:
            for name, content in zip(b.column("name"), b.column("content")):
                files[name.as_py()] = content.as_py()
                size += len(content.as_py())
                if size >= ARCHIVE_BYTES:
                    yield close()
        if files:
            yield close()

    return [r.path for r in members.mapInArrow(run, "path string").collect()]


def _read(spark: SparkSession, sf_dir: str, write, ending: str) -> DataFrame:
    members = read_filings(spark, _written(filings(spark, sf_dir), write, ending))
    return extract(members).select("source_file", "concept", "value")


def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, _zip, ".zip")


def nested_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, _nested, ".zip")


def tar_zst_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, A.pack_tar_zst, ".tar.zst")


def folder_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, _folder, "")


def fact_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    tables.write_facts(facts(spark, sf_dir), f"file://{folder}/facts")
    return tables.read_facts(spark, f"file://{folder}/facts")


def other_reader_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another reader's tables, one per filing, with short rows and columns in another order, held
    against the facts of those filings."""
    folder = scratch(spark)
    rows = extract(filings(spark, sf_dir).select(F.col("name").alias("source_file"), "content", F.lit(None).cast("string").alias("error"), F.lit(False).alias("only_ukfrs"))).select("source_file", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A filing's facts come one after the other; a folder holds FOLDER_TABLES tables at most."""
        pairs = ((name, value) for b in batches for name, value in zip(b.column("source_file").to_pylist(), b.column("value").to_pylist()))
        for i, (name, facts_of) in enumerate(itertools.groupby(pairs, key=lambda p: p[0])):
            if i % FOLDER_TABLES == 0:
                own_folder = f"{folder}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}-{i // FOLDER_TABLES}"
                os.makedirs(own_folder)
                yield pa.RecordBatch.from_arrays([pa.array([own_folder])], names=["path"])
            with open(f"{own_folder}/{name}.csv", "w", encoding="utf-8") as f:
                f.write("Dec,Name,Value,End/Instant,Start\n")
                f.writelines(f'0,core:Order,"{v}"\n' if int(v) % 2 else f"0,core:Order,{v},,\n" for _, v in facts_of if int(v) % 5)

    folders = [r.path for r in rows.mapInArrow(run, "path string").collect()]
    other = C.oracle_facts(tables.read_other_reader_folders(spark, folders))
    own = C.own_facts(rows.select("source_file", F.lit("Order").alias("concept"), F.lit("").alias("period_start"), F.lit("").alias("period_end"), "value"))
    return C.facts_summary(other, own)


QUERIES = {f.__name__: f for f in (zip_members, nested_zip_members, tar_zst_members, folder_members, fact_csv_round_trip, other_reader_pairs)}

_NAME = "'Prod1_1_' || lpad(o_custkey::VARCHAR, 8, '0') || '_20200101.html'"
_ORDERS = f"SELECT {_NAME} AS source_file, 'Order' AS concept, o_orderkey::VARCHAR AS value FROM orders"
_NOTHING = "''"
ORACLE_SQL = {
    "zip_members": _ORDERS,
    # a zip in a zip gives its documents under its own name
    "nested_zip_members": _ORDERS.replace("AS source_file", "|| '.zip' AS source_file", 1),
    "tar_zst_members": _ORDERS,
    "folder_members": _ORDERS,
    "fact_csv_round_trip": f"SELECT {', '.join(f'nullif({n}, {_NOTHING}) AS {n}' for n in FACT.names)} FROM ({FACTS})",
    # within a filing values meet in the order of their text
    "other_reader_pairs": """WITH x AS (SELECT o_custkey, o_orderkey::VARCHAR AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::VARCHAR) AS i FROM orders),
o AS (SELECT o_custkey, o_orderkey::VARCHAR AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::VARCHAR) AS i FROM orders WHERE o_orderkey % 5 <> 0)
SELECT count(o.v) AS oracle_facts, count(x.v) AS extract_facts, count(DISTINCT CASE WHEN o.v IS NOT NULL THEN 1 END) AS oracle_concepts, count(DISTINCT CASE WHEN x.v IS NOT NULL THEN 1 END) AS extract_concepts, 0::BIGINT AS concepts_only_oracle, 0::BIGINT AS concepts_only_extract,
 count(o.v) AS paired_facts, count(*) FILTER (WHERE o.v = x.v) AS soft_value_matches, count(*) FILTER (WHERE o.v <> x.v) AS soft_value_mismatches, 0::BIGINT AS facts_only_oracle, count(*) FILTER (WHERE o.v IS NULL) AS facts_only_extract FROM x LEFT JOIN o USING (o_custkey, i)""",
}
