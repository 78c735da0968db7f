"""Spark data source `filings`: members of a path or URL, one row per document.

The driver reads names and directories only; each task reads its own range of one zip, its own
files of a folder, or one tar. Of several paths the driver reads nothing: each task reads one of
them whole, its names and directory too. Options: `path` (a file, folder, archive or URL), or
`paths` (a JSON list of these), `rangeBytes`, `filesPerTask`, `limit` (bytes of one document).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from filingspark.schemas import MEMBER
from filingspark.sources import archives as A
from filingspark.sources import http
from filingspark.sources import names as N


@dataclass
class Work(InputPartition):
    """What one task reads. kind is a format of names, or `package`, `error`, or `whole`: a path
    that the task itself divides."""

    kind: str
    source: str
    entries: tuple = ()
    package: N.Package | None = None
    error: str = ""


BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024


def batched(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of MEMBER in batches of BATCH_BYTES of content: a worker holds no more at once."""
    schema, held, size = to_arrow_schema(MEMBER), [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class FilingsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path") and not options.get("paths"):
            raise ValueError("filings: path is needed")
        self.options = options
        self.paths = json.loads(options["paths"]) if options.get("paths") else None
        if self.paths is not None:
            return
        self.source = options["path"].removeprefix("file://") if options["path"].startswith("file:///") else options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", A.TARGET)))
        self.per_task = int(options.get("filespertask", options.get("filesPerTask", 64)))
        self.limit = int(options.get("limit", N.MOST_BYTES))

    def partitions(self) -> list[Work]:
        if self.paths is not None:
            return [Work("whole", p) for p in self.paths] or [Work("none", "")]
        remote = http.is_remote(self.source)
        if not remote and os.path.isdir(self.source):
            files = A.folder_files(self.source)
            return [Work(N.DIRECTORY, self.source, tuple(files[i : i + self.per_task])) for i in range(0, len(files), self.per_task)] or [Work("none", self.source)]
        kind = N.detect_format(self.source)
        if not remote and kind == N.UNKNOWN:
            with open(self.source, "rb") as f:
                kind = N.sniff(f.read(512))
        if kind != N.ZIP:
            return [Work("remote" if remote else kind, self.source)]
        z, _ = A.open_zip(self.source)
        found = A.entries(z)
        package = N.select_package([i.filename for i in z.infolist()])
        if package.kind != N.BULK:
            chosen = {f: e for e in found for f in [N.clean_name(e.name)] if f in set(package.files)}
            return [Work("package", self.source, tuple(chosen.values()), package)]
        wanted = [e for e in found if N.want_member(e.name) or N.want_nested_zip(e.name)]
        big = [Work("error", A.base(e.name), error=A.TOO_BIG) for e in wanted if e.size > self.limit]
        runs = A.batches([e for e in wanted if e.size <= self.limit], self.range_bytes, max(A.MOST, 2 * self.range_bytes))
        return [*big, *(Work(N.ZIP, self.source, tuple(run)) for run in runs)] or [Work("none", self.source)]

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        return batched(self.rows(partition))

    def rows(self, partition: Work) -> Iterator[tuple]:
        kind, source = partition.kind, partition.source
        if kind == "whole":
            one = FilingsReader({k: v for k, v in self.options.items() if k != "paths"} | {"path": source})
            for work in one.partitions():
                yield from one.rows(work)
        elif kind == "error":
            yield source, None, partition.error, False
        elif kind == N.DIRECTORY:
            for path in partition.entries:
                yield A.file_row(path, limit=self.limit)
        elif kind == N.ZIP:
            _, content_at = A.open_zip(source) if not http.is_remote(source) else (None, lambda start, length: http.read_range(source, start, length))
            yield from A.read_members(content_at, list(partition.entries), self.limit)
        elif kind == "package":
            _, content_at = A.open_zip(source)
            yield from A.package_rows(A.source_name(source), list(partition.entries), partition.package, lambda e: A.inflate(content_at(e.header, e.fence - e.header), e), self.limit)
        elif kind in (N.TAR, N.TAR_ZST):
            with open(source, "rb") as f:
                yield from A.tar_rows(f, kind == N.TAR_ZST, self.limit)
        elif kind == "remote":
            yield from A.remote_rows(source, self.limit)
        elif kind == N.INSTANCE:
            yield A.file_row(source, limit=self.limit)
        elif kind != "none":
            raise A.StreamError(f"unsupported input format for {source!r} (want a zip, tar or tar.zst archive, a folder, or an instance document)")


class Filings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self):
        return MEMBER

    def reader(self, schema) -> FilingsReader:
        return FilingsReader(dict(self.options))


def read_filings(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Members of a path or URL, or of many: a task reads one of these whole."""
    spark.dataSource.register(Filings)
    if isinstance(path, str):
        return spark.read.format("filings").options(**options).load(path)
    return spark.read.format("filings").options(**options, paths=json.dumps(path)).load()


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Members of a folder of instance documents in any store that Spark reads."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.substring_index("path", "/", -1)
    return files.where(N.want_member_column(name)).select(name.alias("source_file"), "content", F.lit(None).cast("string").alias("error"), F.lit(False).alias("only_ukfrs"))
