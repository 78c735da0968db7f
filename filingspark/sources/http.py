"""HTTP reads: retries with full jitter, ranges, and a seekable file over ranges."""

from __future__ import annotations

import io
import random
import re
import time
import urllib.error
import urllib.request
from email.message import Message

ATTEMPTS, FIRST_DELAY, LONGEST_DELAY = 6, 0.1, 5.0
AGAIN = frozenset((429, 500, 502, 503, 504))


def is_remote(source: str) -> bool:
    return source.lower().startswith(("http://", "https://"))


def request(url: str, headers: dict[str, str] | None = None, method: str = "GET", *, sleep=time.sleep) -> tuple[bytes, Message, int]:
    """Body, headers and status. Repeats on 429, 5xx, network errors and short bodies; never on
    other refusals."""
    last: Exception | None = None
    for attempt in range(ATTEMPTS):
        if attempt:
            sleep(random.uniform(0, min(LONGEST_DELAY, FIRST_DELAY * 2 ** (attempt - 1))))
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}, method=method), timeout=60) as r:
                body = r.read()
                length = r.headers.get("Content-Length")
                if method != "HEAD" and length is not None and len(body) != int(length):
                    raise ConnectionError(f"short body: {len(body)} of {length} bytes")
                return body, r.headers, r.status
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN and e.code < 500:
                raise
            last = e
        except (OSError, ValueError) as e:
            last = e
        except Exception as e:  # http.client's IncompleteRead and the like
            last = e
    raise ConnectionError(f"{url}: {last}") from last


def size_of(url: str) -> int:
    """Length by HEAD, or where that gives none, by a one-byte range."""
    try:
        _, headers, _ = request(url, method="HEAD")
        if headers.get("Content-Length"):
            return int(headers["Content-Length"])
    except urllib.error.HTTPError:
        pass
    _, headers, status = request(url, {"Range": "bytes=0-0"})
    m = re.search(r"/(\d+)$", headers.get("Content-Range", ""))
    if status != 206 or not m:
        raise ConnectionError(f"{url}: no length and no ranges")
    return int(m[1])


def read_range(url: str, start: int, length: int) -> bytes:
    if not length:
        return b""
    body, _, status = request(url, {"Range": f"bytes={start}-{start + length - 1}"})
    if status != 206:
        raise ConnectionError(f"{url}: the server does not serve ranges")
    if len(body) != length:
        raise ConnectionError(f"{url}: {len(body)} bytes for a range of {length}")
    return body


def file_name(headers: Message) -> str:
    """File name of a Content-Disposition, or empty."""
    return (headers.get_filename() or "").replace("\\", "/").rpartition("/")[2]


class RangeFile(io.RawIOBase):
    """A remote file read by ranges, the tail kept, so that a zip's directory takes two or three
    requests."""

    def __init__(self, url: str, tail: int = 1 << 20):
        self.url, self.size, self.at = url, size_of(url), 0
        self.kept_at = max(0, self.size - tail)
        self.kept = read_range(url, self.kept_at, self.size - self.kept_at)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(n if n >= 0 else self.size, self.size - self.at))
        if self.at >= self.kept_at:
            data = self.kept[self.at - self.kept_at : self.at - self.kept_at + n]
        else:
            data = read_range(self.url, self.at, n)
        self.at += len(data)
        return data

    def readinto(self, b) -> int:
        data = self.read(len(b))
        b[: len(data)] = data
        return len(data)
