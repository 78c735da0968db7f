"""WARC archives with a two-level capture index.

Writing: each task writes its rows as one or more .warc.gz archives, which begin with a warcinfo
record; every record is a gzip member of its own, and a task rolls to the next archive at `roll`
bytes. Of records with equal payloads of at least `least` bytes, the one with the largest page_id is
the response; the others are revisit records that name it and hold no payload.

Index: the captures' keys - host labels reversed, then path and query - are sorted over the whole
collection by range and cut into compressed blocks of `per_block` lines. The sparse directory has a
line per block - its first key, file, offset and size - in a sorted file for each range, and the
ranges' first keys are few. A lookup bisects the ranges, then the directory file by byte ranges, reads
the blocks that may hold the key by range, and then the records by range. It runs no job.

Files go through pyarrow's file systems, so the folder may be any that these reach from all
executors. A file is named after the task attempt that writes it, and counts only if the captures or
the directory, which Spark commits, name it: an attempt that is lost or comes second leaves files
that nothing refers to, which are deleted when the collection is complete.

Defined results: null html is an empty payload; a null url has the empty key; a null page_id is
archived and read as null, and is never referred to; repeated rows are
archived as often as they occur (copies of the response row are responses); an empty table gives
an empty collection; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.llm.common import join_facts, materialize, new_path, text_chunks, to_batch

DATE = "1970-01-01T00:00:00Z"
_SPACE = re.compile(r"[\x00-\x20\x7f-\x9f]+")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a Hadoop-style path (file:///x, hdfs://..., /x)."""
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """Reversed host labels, comma-separated, then `)` and path and query."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return _SPACE.sub("%20", url or "")
    if not host:
        return _SPACE.sub("%20", url or "")
    path = parts.path.rstrip("/") or "/"
    return _SPACE.sub("%20", ",".join(reversed(host.split("."))) + ")" + path + (f"?{parts.query}" if parts.query else ""))


def record_id(place: str) -> str:
    """A record's id, from the archive and offset where it stands."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def _headed(fields: list[str], body: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info_record(place: str) -> bytes:
    """The first record of an archive, not compressed."""
    return _headed(["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(place)}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields"], b"software: filingspark\r\nformat: WARC File Format 1.1\r\n")


def record(place: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One record, not compressed."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(place)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_SPACE.sub('%20', url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        fields.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_SPACE.sub('%20', refers_url or '')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return _headed([*fields, "Content-Type: application/http; msgtype=response"], http + (payload if refers_to is None else b""))


@dataclass
class Record:
    page_id: int | None
    kind: str
    url: str
    payload: bytes
    digest: str
    payload_bytes: int
    refers_to: int | None


def parse_record(raw: bytes) -> Record:
    """The record of one gzip member, its payload checked against its digest and length."""
    data = zlib.decompress(raw, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    number = lambda name: int(fields[name]) if name in fields else None
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return Record(number("X-Page-Id"), kind, fields["WARC-Target-URI"], payload, digest, size, number("X-Refers-To-Page-Id"))


def assign(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html, digest, size) with refers_to: null for responses.

    The choice is made on ids and digests alone; one join brings it to the rows."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    small = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    kept = small.groupBy("digest").agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = materialize(kept.select("digest", F.col("kept.page_id").alias("kept"), F.col("kept.url").alias("kept_url"), "n"), "payloads")
    revisits = join_facts(small.drop("url"), kept, "digest").where("page_id < kept").select("page_id", "digest", "kept", "kept_url").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", F.col("kept").alias("refers_to"), F.col("kept_url").alias("refers_url"))


_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_DIRECTORY = pa.schema([("first_key", pa.string()), ("block_file", pa.string()), ("block_offset", pa.int64()), ("block_length", pa.int64()), ("entries", pa.int64()), ("lines_file", pa.string()), ("lines_length", pa.int64())])


@dataclass
class Collection:
    """Where a collection lies: its folder and its directory, a table of one row per index block."""

    spark: SparkSession
    root: str
    directory: DataFrame
    _ranges: list[tuple[str, str, int]] | None = None

    def ranges(self) -> list[tuple[str, str, int]]:
        """First key, file and size of the directory's sorted files, one for each task that wrote
        blocks; read once."""
        if self._ranges is None:
            rows = self.directory.groupBy("lines_file").agg(F.min("first_key"), F.max("lines_length")).collect()
            self._ranges = sorted((r[1], r[0], r[2]) for r in rows)
        return self._ranges

    def blocks_of(self, key: str) -> list[tuple[str, int, int]]:
        """File, offset and length of the blocks that may hold a key: those that begin with it, and
        the one before them."""
        ranges = self.ranges()
        at = bisect.bisect_left(ranges, key, key=lambda r: r[0])
        before, found = None, []
        for _, name, size in ranges[max(at - 1, 0) :]:
            lines = DirectoryFile(self.root, name, size)
            place = lines.first_from(key)
            if place:
                before = lines.line_before(place)
            while place < size:
                line, place = lines.line_at(place)
                if line[0] != key:
                    break
                found.append(line)
            else:
                continue  # the next range may begin with the key too
            break
        return [(f, int(o), int(n)) for _, f, o, n in ([before] if before else []) + found]

    def lookup(self, urls: list[str]) -> list[Record]:
        """All captures of some urls, by binary search, block reads and record reads."""
        out = []
        for key in sorted({url_key(u) for u in urls}):
            for name, offset, length in self.blocks_of(key):
                entries = read_block(self.root, name, offset, length)
                at = bisect.bisect_left([e[0] for e in entries], key)
                while at < len(entries) and entries[at][0] == key:
                    _, _, archive, start, size = entries[at]
                    out.append(parse_record(read_range(self.root, archive, start, size)))
                    at += 1
        return out

    def read(self, gap: int = 1 << 16, batch_bytes: int = 4 << 20) -> DataFrame:
        """Every record, found through the index: blocks are read by range, their entries dealt by
        archive and stretch, and neighbouring records fetched in one range read."""
        root = self.root

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = read_block(root, row["block_file"], row["block_offset"], row["block_length"])
                    yield to_batch({n: [e[i] for e in found] for i, n in enumerate(_ENTRY.names)}, _ENTRY)

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        listed = self.directory.repartition(n, "block_file", "block_offset").mapInArrow(entries, "key string, page_id bigint, file string, offset bigint, length bigint")
        dealt = listed.repartition(n, "file", F.floor(F.col("offset") / batch_bytes)).sortWithinPartitions("file", "offset")
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run: list[dict] = []

            def fetch() -> pa.RecordBatch:
                start = run[0]["offset"]
                raw = read_range(root, run[0]["file"], start, run[-1]["offset"] + run[-1]["length"] - start)
                got = [parse_record(raw[e["offset"] - start : e["offset"] - start + e["length"]]) for e in run]
                return to_batch({"page_id": [r.page_id for r in got], "record_type": [r.kind for r in got], "payload": [r.payload for r in got], "payload_bytes": [r.payload_bytes for r in got], "payload_digest": [r.digest for r in got], "refers_to": [r.refers_to for r in got]}, schema)

            for batch in batches:
                for e in batch.to_pylist():
                    if run and (e["file"] != run[-1]["file"] or e["offset"] - run[-1]["offset"] - run[-1]["length"] > gap or e["offset"] + e["length"] - run[0]["offset"] > batch_bytes):
                        yield fetch()
                        run = []
                    run.append(e)
            if run:
                yield fetch()

        return dealt.mapInArrow(records, "page_id bigint, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint")


class DirectoryFile:
    """A sorted file of directory lines, searched by byte ranges."""

    def __init__(self, root: str, name: str, size: int, window: int = 4096):
        fs, base = file_system(root)
        self.file, self.size, self.window = fs.open_input_file(f"{base}/{name}"), size, window

    def line_at(self, at: int) -> tuple[list[str], int]:
        """The line that begins at a place, and where the next one begins."""
        data, end = b"", at
        while b"\n" not in data:
            data += self.file.read_at(min(self.window, self.size - end), end)
            end = at + len(data)
        line, _, _ = data.partition(b"\n")
        return line.decode().split(" "), at + len(line) + 1

    def start_from(self, at: int) -> int:
        """Where the first line that begins at a place or behind it begins."""
        while 0 < at < self.size:
            data = self.file.read_at(min(self.window, self.size - at + 1), at - 1)
            if (i := data.find(b"\n")) >= 0:
                return at + i
            at += len(data)
        return at

    def line_before(self, place: int) -> list[str]:
        """The line that ends before a place where a line begins."""
        low = place - 1
        while low > 0:
            step = max(0, low - self.window)
            data = self.file.read_at(low - step, step)
            if (i := data.rfind(b"\n")) >= 0:
                low = step + i + 1
                break
            low = step
        return self.line_at(low)[0]

    def first_from(self, key: str) -> int:
        """Where the first line of that key or a greater one begins."""
        low, high = 0, self.size  # lines that begin before low are less; those from high on are not
        while low < high:
            middle = self.start_from((low + high) // 2)
            if middle >= high:
                middle = low
            line, after = self.line_at(middle)
            if line[0] < key:
                low = after
            else:
                high = middle
        return low


def read_range(root: str, name: str, offset: int, length: int) -> bytes:
    fs, base = file_system(root)
    with fs.open_input_file(f"{base}/{name}") as f:
        return f.read_at(length, offset)


def read_block(root: str, name: str, offset: int, length: int) -> list[tuple]:
    lines = zlib.decompress(read_range(root, name, offset, length)).decode().split("\n")[:-1]
    return [(k, None if p == "None" else int(p), f, int(o), int(n)) for k, p, f, o, n in (x.split(" ") for x in lines)]


class _Writer:
    """Files of one task attempt."""

    def __init__(self, root: str, kind: str, suffix: str):
        context = TaskContext.get()
        self.fs, self.base = file_system(root)
        self.stem, self.suffix, self.number = f"{kind}-{context.partitionId():06d}-{context.taskAttemptId():x}", suffix, 0
        self.out = None

    def open(self) -> None:
        self.name = f"{self.stem}-{self.number:04d}{self.suffix}"
        self.out, self.offset = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None), 0

    def write(self, data: bytes) -> int:
        if self.out is None:
            self.open()
        at = self.offset
        self.out.write(data)
        self.offset += len(data)
        return at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out, self.number = None, self.number + 1


def write(pages: DataFrame, *, root: str | None = None, least: int = 1000, roll: int = 256 << 20, per_block: int = 512) -> Collection:
    """Archive pages (page_id, url, html) and index them."""
    spark = pages.sparkSession
    root = root or new_path(spark, "warc")
    fs, base = file_system(root)
    fs.create_dir(base, recursive=True)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(root, "part", ".warc.gz")
        for part in text_chunks(batches, "html", 2 << 20):
            rows = []
            for row in part.to_pylist():
                if out.out is not None and out.offset >= roll:
                    out.close()
                if out.out is None:
                    out.open()
                    out.write(gzip_member(info_record(f"{root}/{out.name}")))
                data = gzip_member(record(f"{root}/{out.name} {out.offset}", row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"], row["refers_url"]))
                at = out.write(data)
                rows.append((url_key(row["url"]), row["page_id"], out.name, at, len(data)))
            yield to_batch({n: [r[i] for r in rows] for i, n in enumerate(_ENTRY.names)}, _ENTRY)
        out.close()

    captures = materialize(assign(pages, least).mapInArrow(archive, "key string, page_id bigint, file string, offset bigint, length bigint"), "captures")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sparse, lines, first = _Writer(root, "index", ".cdx.z"), _Writer(root, "directory", ".txt"), [], None
        found: list[tuple] = []

        def block() -> None:
            data = zlib.compress("".join(lines).encode())
            at = out.write(data)
            sparse.write(f"{first} {out.name} {at} {len(data)}\n".encode())
            found.append((first, out.name, at, len(data), len(lines), sparse.name))
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if not lines:
                    first = row["key"]
                lines.append(" ".join(str(row[c]) for c in _ENTRY.names) + "\n")
                if len(lines) == per_block:
                    block()
        if lines:
            block()
        size = sparse.offset if found else 0
        out.close()
        sparse.close()
        yield to_batch({n: [(*r, size)[i] for r in found] for i, n in enumerate(_DIRECTORY.names)}, _DIRECTORY)

    directory = materialize(dealt.mapInArrow(index, "first_key string, block_file string, block_offset bigint, block_length bigint, entries bigint, lines_file string, lines_length bigint"), "directory")
    known = {r[0] for r in captures.select("file").distinct().collect()}
    known |= {x for r in directory.select("block_file", "lines_file").distinct().collect() for x in r}
    for info in fs.get_file_info(pafs.FileSelector(base)):
        if info.type == pafs.FileType.File and info.base_name not in known and info.base_name.startswith(("part-", "index-", "directory-")):
            fs.delete_file(info.path)
    return Collection(spark, root, directory)


def gzip_member(data: bytes) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as f:
        f.write(data)
    return out.getvalue()
