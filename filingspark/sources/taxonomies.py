"""Taxonomy archives: the list of sources, and fetching them with pinned checksums."""

from __future__ import annotations

import csv
import hashlib
import os
import re
import urllib.error
from dataclasses import dataclass

from filingspark.sources import http

MOST_BYTES = 64 << 20


@dataclass(frozen=True)
class Source:
    id: str
    url: str
    sha256: str


class SourcesError(ValueError):
    """A list of sources that cannot be used."""


def read_sources(path: str) -> list[Source]:
    """Sources of a CSV file `id,url,sha256`; lines that begin with # are comments."""
    with open(path, newline="", encoding="utf-8") as f:
        lines = [x for x in f if x.strip() and not x.startswith("#")]
    rows = list(csv.reader(lines))
    if not rows or rows[0] != ["id", "url", "sha256"]:
        raise SourcesError(f"{path}: the header must be id,url,sha256")
    out: list[Source] = []
    for row in rows[1:]:
        if len(row) != 3 or not all(c.strip() for c in row):
            raise SourcesError(f"{path}: three fields are needed: {row}")
        s = Source(*(c.strip() for c in row))
        if not re.fullmatch("[0-9a-fA-F]{64}", s.sha256):
            raise SourcesError(f"{path}: {s.id}: not a SHA-256")
        if s.id in {o.id for o in out}:
            raise SourcesError(f"{path}: {s.id} twice")
        out.append(s)
    return out


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fetch(source: Source, cache: str) -> str:
    """Local path of a source's archive. A local path is used in place; a remote one is downloaded
    once, checked, and kept under its id."""
    local = source.url.removeprefix("file://") if not http.is_remote(source.url) else os.path.join(cache, f"{source.id}.zip")
    if not http.is_remote(source.url) or os.path.exists(local) and _digest(local) == source.sha256.lower():
        if _digest(local) != source.sha256.lower():
            raise SourcesError(f"{source.id}: checksum of {local} differs")
        return local
    os.makedirs(cache, exist_ok=True)
    try:
        body, _, _ = http.request(source.url)
    except (urllib.error.HTTPError, ConnectionError) as e:
        raise SourcesError(f"{source.id}: {e}") from e
    if len(body) > MOST_BYTES:
        raise SourcesError(f"{source.id}: larger than {MOST_BYTES} bytes")
    if hashlib.sha256(body).hexdigest() != source.sha256.lower():
        raise SourcesError(f"{source.id}: checksum differs")
    partial = f"{local}.partial"
    with open(partial, "wb") as f:
        f.write(body)
    os.replace(partial, local)
    return local
