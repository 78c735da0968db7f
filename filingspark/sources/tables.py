"""Tables in and out: long-fact CSV, maps, wide Parquet, the concept lookup."""

from __future__ import annotations

import csv
import itertools
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingspark.schemas import CONCEPT, FACT


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, quotes doubled, line ends inside quotes; short rows are padded and extra
    fields dropped. Types are never guessed. Empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, FACT)


def read_map(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A concept or column map, or a comparison spec, with its columns' types given."""
    return read_csv(spark, path, T.StructType.fromDDL(ddl))


# The columns that are read of another reader's table of facts.
OTHER_READER = ("Name", "Value", "Start", "End/Instant")


def read_other_reader(spark: SparkSession, path: str) -> DataFrame:
    """Another reader's table of facts, one or many files: the columns OTHER_READER by name, wherever
    they stand, and source_file, the table's file without its ending. Short rows are padded."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    missing = [c for c in OTHER_READER if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    file = F.regexp_replace(F.element_at(F.split(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "/"), -1), r"\.csv\z", "")
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in OTHER_READER), file.alias("source_file"))


def read_other_reader_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """read_other_reader's rows of all tables (.csv) right in some folders that all tasks reach. A task
    lists and reads one folder, so that the driver holds the folders' names alone, however many tables
    there are. Columns are found by name in each table."""
    columns = [*OTHER_READER, "source_file"]

    def table(path: str) -> Iterator[tuple]:
        with open(path, newline="", encoding="utf-8-sig") as f:
            rows = csv.reader(f)
            header = next(rows, None)
            if header is None:
                return
            missing = [c for c in OTHER_READER if c not in header]
            if missing:
                raise ValueError(f"{path}: no column {', '.join(missing)}")
            places = [header.index(c) for c in OTHER_READER]
            name = os.path.basename(path).removesuffix(".csv")
            for row in rows:
                if row:
                    yield (*(row[i] if i < len(row) else "" for i in places), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (e.path for b in batches for folder in b.column("folder").to_pylist() for e in os.scandir(folder) if e.name.endswith(".csv"))
        found = (row for path in paths for row in table(path))
        while held := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*held)], names=columns)

    places = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders)))
    return places.mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


# A CSV with line ends inside quotes is read whole by one task, so a part file has a bound.
FILE_ROWS = 500_000


def write_facts(facts: DataFrame, path: str, *, single: bool = False) -> None:
    """Facts as CSV, in the fixed order of columns, in files of FILE_ROWS at most; single makes one
    part file."""
    rows = facts.select(FACT.names)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("maxRecordsPerFile", 0 if single else FILE_ROWS).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_facts_file(facts: DataFrame, out) -> int:
    """Facts to an open text file, row by row as they come; the header only if there is a row."""
    writer, n = csv.writer(out, lineterminator="\n"), 0
    for row in facts.select(FACT.names).toLocalIterator(prefetchPartitions=True):
        if not n:
            writer.writerow(FACT.names)
        writer.writerow(["" if v is None else v for v in row])
        n += 1
    return n


def write_concepts(rows: list[list[str]], folder: str) -> str:
    """concepts.csv, written beside and renamed, so that it is whole or not there."""
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".concepts-")
    with os.fdopen(handle, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerow(CONCEPT.names)
        writer.writerows([["" if v is None else v for v in r] for r in rows])
        f.flush()
        os.fsync(f.fileno())
    path = os.path.join(folder, "concepts.csv")
    os.replace(temporary, path)
    return path
