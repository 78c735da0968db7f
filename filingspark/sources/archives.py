"""Members of files, folders, zip and tar archives: rows of (source_file, content, error, only_ukfrs).

A member error is a row; a broken archive raises.
"""

from __future__ import annotations

import io
import os
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from filingspark.sources import http
from filingspark.sources import names as N

Row = tuple[str, bytes | None, str | None, bool]

TARGET, MOST, GAP = 16 << 20, 32 << 20, 1 << 20
TOO_BIG, NO_REPORTS, BAD_ZIP = "exceeds size limit", "no reports", "zip: not a valid zip file"


def base(name: str) -> str:
    return name.replace("\\", "/").rstrip("/").rpartition("/")[2]


def source_name(source: str) -> str:
    return base(source.split("?")[0].split("#")[0]) or source


class StreamError(RuntimeError):
    """An archive or file that cannot be read on."""


@dataclass(frozen=True)
class Entry:
    """A member of a zip, from its directory."""

    name: str
    header: int
    fence: int  # where the next member, or the directory, begins
    packed: int
    size: int
    method: int
    crc: int


def entries(z: zipfile.ZipFile) -> list[Entry]:
    infos = [i for i in z.infolist() if not i.is_dir()]
    order = sorted({i.header_offset for i in z.infolist()} | {z.start_dir})
    after = dict(zip(order, order[1:]))
    return [Entry(i.filename.replace("\\", "/"), i.header_offset, after[i.header_offset], i.compress_size, i.file_size, i.compress_type, i.CRC) for i in infos]


def inflate(raw: bytes, entry: Entry) -> bytes:
    """A member's content from the bytes at its header; size and checksum must agree."""
    if raw[:4] != b"PK\x03\x04":
        raise StreamError(f"read {entry.name}: no member header")
    skip = 30 + sum(struct.unpack("<HH", raw[26:30]))
    data = raw[skip : skip + entry.packed]
    if entry.method == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompressobj(-15).decompress(data, entry.size + 1)
        except zlib.error as e:
            raise StreamError(f"read {entry.name}: {e}") from e
    elif entry.method != zipfile.ZIP_STORED:
        raise StreamError(f"open member {entry.name}: unsupported compression {entry.method}")
    if len(data) != entry.size or zlib.crc32(data) != entry.crc:
        raise StreamError(f"read {entry.name}: checksum error")
    return data


def batches(wanted: list[Entry], target: int = TARGET, most: int = MOST, gap: int = GAP) -> list[list[Entry]]:
    """Members in runs that one range read fetches: a run ends at a gap of unwanted bytes, at the
    target size, or before it would pass the most."""
    out: list[list[Entry]] = []
    for e in sorted(wanted, key=lambda e: e.header):
        run = out[-1] if out else None
        if run and e.header - run[-1].fence <= gap and run[-1].fence - run[0].header < target and e.fence - run[0].header <= most:
            run.append(e)
        else:
            out.append([e])
    return out


def read_members(content_at, wanted: list[Entry], limit: int = N.MOST_BYTES) -> Iterator[Row]:
    """Rows of some members of a bulk zip. content_at(start, length) reads the archive."""
    if not wanted:
        return
    start = wanted[0].header
    raw = content_at(start, wanted[-1].fence - start)
    for e in wanted:
        data = inflate(raw[e.header - start : e.fence - start], e)
        if N.is_zip_name(e.name):
            yield from nested(base(e.name), data, limit)
        else:
            yield base(e.name), data, None, False


def nested(name: str, data: bytes, limit: int = N.MOST_BYTES) -> Iterator[Row]:
    """A member named .zip: a package or accounts folder one level down, or an instance under a
    wrong name."""
    if not N.is_zip(data):
        yield (name, data, None, False) if N.is_xml(data) else (name, None, BAD_ZIP, False)
        return
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield name, None, BAD_ZIP, False
        return
    found = entries(z)
    package = N.select_package([i.filename for i in z.infolist()])
    if package.kind != N.BULK:
        yield from package_rows(name, found, package, lambda e: inflate(data[e.header : e.fence], e), limit)
        return
    for e in found:
        if N.want_member(e.name) and N.in_folder(e.name, "accounts"):
            if e.size > limit:
                yield name, None, TOO_BIG, False
                return
            yield name, inflate(data[e.header : e.fence], e), None, False


def package_rows(name: str, found: list[Entry], package: N.Package, read, limit: int) -> Iterator[Row]:
    """Rows of a package's chosen reports, all under the package's name."""
    by_name = {N.clean_name(e.name): e for e in found}
    chosen = [by_name[f] for f in package.files if f in by_name]
    if not chosen:
        yield name, None, NO_REPORTS, False
    elif any(e.size > limit for e in chosen):
        yield name, None, TOO_BIG, False
    else:
        for e in chosen:
            yield name, read(e), None, package.only_ukfrs


def tar_rows(stream, compressed: bool, limit: int = N.MOST_BYTES) -> Iterator[Row]:
    """Rows of a tar read in sequence; a member past the limit ends the read."""
    if compressed:
        import zstandard

        stream = zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(stream, read_across_frames=True)
    try:
        with tarfile.open(fileobj=stream, mode="r|") as tar:
            for info in tar:
                if not info.isreg() or not N.want_member(info.name):
                    continue
                if info.size > limit:
                    raise StreamError(f"member {info.name} exceeds size limit")
                yield base(info.name), tar.extractfile(info).read(), None, False
    except (tarfile.TarError, EOFError) as e:
        raise StreamError(f"tar: {e}") from e


def file_row(path: str, name: str | None = None, limit: int = N.MOST_BYTES) -> Row:
    if os.path.getsize(path) > limit:
        raise StreamError(f"member {name or path} exceeds size limit")
    with open(path, "rb") as f:
        return name or base(path), f.read(), None, False


def folder_files(path: str) -> list[str]:
    """Instance documents right in a folder, in order."""
    return [os.path.join(path, n) for n in sorted(os.listdir(path)) if N.want_member(n) and not os.path.isdir(os.path.join(path, n))]


def open_zip(source: str) -> tuple[zipfile.ZipFile, object]:
    """A zip's directory, and a function (start, length) that reads the archive's bytes."""
    if http.is_remote(source):
        return zipfile.ZipFile(io.BufferedReader(http.RangeFile(source), 1 << 16)), lambda start, length: http.read_range(source, start, length)

    def local(start: int, length: int) -> bytes:
        with open(source, "rb") as f:
            f.seek(start)
            return f.read(length)

    return zipfile.ZipFile(source), local


def remote_rows(source: str, limit: int = N.MOST_BYTES) -> Iterator[Row]:
    """A remote file that is no zip by name: by the served file name, else by its first bytes."""
    body, headers, _ = http.request(source)
    name = http.file_name(headers)
    yield from sniffed_rows(io.BytesIO(body), body[:512], name or source_name(source), N.detect_format(name) if name else N.detect_format(source), limit)


def sniffed_rows(stream, head: bytes, name: str, kind: str, limit: int = N.MOST_BYTES) -> Iterator[Row]:
    kind = N.sniff(head) if kind == N.UNKNOWN else kind
    if N.is_gzip(head):
        raise StreamError(f"cannot read gzip from {name!r}: .tar.gz is not supported")
    if kind == N.ZIP:
        raise StreamError(f"cannot read zip from {name!r}: a zip needs a file or a .zip URL for range requests")
    if kind in (N.TAR, N.TAR_ZST):
        yield from tar_rows(stream, kind == N.TAR_ZST, limit)
    elif kind == N.INSTANCE:
        data = stream.read(limit + 1)
        if len(data) > limit:
            raise StreamError(f"member {name} exceeds size limit")
        yield name, data, None, False
    else:
        raise StreamError(f"unsupported input format for {name!r}")


def pack_tar_zst(files: dict[str, bytes], path: str) -> None:
    """A .tar.zst of files under their base names."""
    import zstandard

    with open(path, "wb") as f, zstandard.ZstdCompressor().stream_writer(f) as z, tarfile.open(fileobj=z, mode="w|") as tar:
        for name, data in sorted(files.items()):
            info = tarfile.TarInfo(base(name))
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def pack_zip(files: dict[str, bytes], path: str, prefix: str = "") -> None:
    """A zip of files under prefix and their base names."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files.items()):
            z.writestr(prefix + base(name), data)
