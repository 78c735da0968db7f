"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines: runs of text between block-level tags, with character references decoded
and white space folded; scripts, styles and comments give none. Pages are parsed once; the lines
travel compressed. Pages are sorted by host and URL
path, dealt by range, and each page is paired with the neighbour of its host whose path shares the
longest beginning. The pair's lines are aligned by longest common subsequence, and those they share,
the template, are deleted. Pages that quote or copy each other share text as well, so a line inside
an article or main element is deleted only if both neighbours share it, and none is if more than
half of the article's text would go. A check follows for the template lines that differ from page to
page: lines in elements that mark themselves as furniture (by tag, role, or class and id words) go
as well. All other lines are the text, inside and outside of article and main. Pages of
a host with equal unmarked lines that follow each other are copies and say nothing about the
template: they are one run, compared with the pages that differ before and behind it, and get the
same text. Tasks get the pages beyond their edges, so that the result does not depend on their
number. Equal pages with others between them may have different partners.

Defined results: null and empty html give the empty text; a null url stands for a host of its own;
repeated rows are paired like any other; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import os
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingspark.llm.common import materialize, text_chunks

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
DROP = frozenset("nav header footer aside form dialog menu head fieldset select button".split()) | RAW
IN_ARTICLE = frozenset(["header"])  # of DROP, but an article's own
BLOCK = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | DROP - {"button", "select"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form alert".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside rail widget widgets footer header masthead topbar comment comments commentlist disqus replies "
    "share sharing social related recommended newsletter subscribe subscription signup login form search skip toolbar tags tagcloud".split()
)

_OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([A-Za-z][^\s/>]*+)")
# In a tag: its end, or a quote that opens an attribute's value.
_SPECIAL = re.compile(r">|=\s*+[\"']")
_ATTRIBUTE = re.compile(r"([^\s=>/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_HINT = re.compile(r"class|id|role|hidden|style", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_ANY_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)")


ARTICLE, LOOSE, NO, SOFT, MARKED = range(5)

# Words that a wrapper of the article may hold too ("page with-sidebar"): main or article inside
# such an element is the article all the same.
WRAPPERS = frozenset("header masthead sidebar rail nav navbar navigation menu banner footer search tags alert overlay social widget widgets toolbar".split())
# Words that say how an element is laid out: beside a furniture word they change nothing.
LAYOUT = frozenset("area bar block body bottom box btn button buttons card cards col column container content group inner item items left link links list outer panel post posts right row section slot text title top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply".split())


def _furniture(tag: str, attributes: str, inside: bool) -> int:
    """How an element marks itself as furniture: MARKED, SOFT (by a word that wrappers hold too) or
    0. inside: it stands in an article, where a class or id counts only if all its words are
    furniture or layout (an article has "related work" and a "notice of law" of its own)."""
    if tag in DROP:
        return 0 if inside and tag in IN_ARTICLE else MARKED
    if not attributes or tag in ("html", "body", "main") or not _HINT.search(attributes):
        return 0
    soft = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in ROLES or name == "hidden" and not value.startswith("until"):
            return MARKED
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return MARKED
        if name in ("class", "id"):
            words = set(_WORD.findall(value))
            if tag == "article":
                if words & COMMENTS:
                    return MARKED
            elif inside:
                if words & FURNITURE and not words - FURNITURE - LAYOUT:
                    return MARKED
            elif words & FURNITURE:
                if words & FURNITURE - WRAPPERS:
                    return MARKED
                soft = SOFT
    return soft


class _Page:
    """A page's markup; what is looked for and not found is remembered, so that broken markup costs
    no more than its length."""

    def __init__(self, text: str):
        self.text, self.stop, self.dead, self.last = text, text.rfind(">") + 1, set(), {}

    def tag_end(self, at: int) -> int:
        """Place of the `>` that ends the tag whose attributes begin at a place: the first outside
        quoted values; the first of all if a quote never ends; -1 if there is none."""
        start, seen = at, []
        while m := _SPECIAL.search(self.text, at, self.stop):
            quote = m.end() - 1
            if self.text[quote] == ">":
                return quote
            if quote in self.dead:
                break
            seen.append(quote)
            at = self.text.find(self.text[quote], quote + 1, self.stop) + 1
            if not at:
                break
        self.dead.update(seen)
        return self.text.find(">", start, self.stop)

    def closes(self, tag: str, at: int) -> bool:
        """An end tag of that name stands at a place or behind it."""
        if tag not in self.last:
            self.last[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", self.text, re.I)), default=-1)
        return self.last[tag] >= at

    def raw_end(self, tag: str, at: int) -> int:
        """Where a raw element that begins at a place ends: behind its end tag; without one, before
        the next tag of a block."""
        if self.closes(tag, at):
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(self.text, at)
            return m.end()
        for m in _ANY_TAG.finditer(self.text, at):
            if m[1].lower() in BLOCK:
                return m.start()
        return len(self.text)


def blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the blocks in page order; kind is ARTICLE, LOOSE, or SOFT or MARKED as
    furniture. An element that marks itself as furniture and is never closed marks only the text
    before the next block."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # tag, kind outside it
    count: dict[str, int] = {}  # tags on the stack
    page = _Page((html or "").replace("\0", " "))
    kind, at, raw = LOOSE, 0, page.text
    unclosed: int | None = None  # the kind outside an open element that is never closed

    def flush() -> None:
        nonlocal kind, unclosed
        if text:
            if kind != NO and (line := " ".join(_html.unescape("".join(text)).split())):
                out.append((line, kind))
            text.clear()
        if unclosed is not None:
            kind, unclosed = unclosed, None

    def pop() -> str:
        nonlocal kind
        tag, kind = stack.pop()
        count[tag] -= 1
        return tag

    while m := _OPENING.search(raw, at):
        text.append(raw[at : m.start()])
        if not m[2]:
            if m[0] == "<![CDATA[":
                end = raw.find("]]>", m.end())
                text.append(_html.escape(raw[m.end() : end if end >= 0 else len(raw)]))
                at = end + 3 if end >= 0 else len(raw)
            else:
                mark = "-->" if m[0] == "<!--" else ">"
                end = raw.find(mark, m.end())
                at = end + len(mark) if end >= 0 else len(raw)
            continue
        closing, tag = m[1], m[2].lower()
        end = page.tag_end(m.end())
        if end < 0:  # no tag ends any more: the rest is text
            text.append(_html.escape(raw[m.start() :]) if "<" not in raw[m.start() + 1 :] else raw[m.start() :])
            at = len(raw)
            break
        attributes, at = raw[m.end() : end], end + 1
        if tag == "br":
            text.append(" ")
        elif closing:  # an end tag closes what is open inside its element
            if count.get(tag):
                flush()
                while pop() != tag:
                    pass
            elif tag in BLOCK:
                flush()
        elif tag in RAW:
            flush()
            if not attributes.endswith("/"):
                at = page.raw_end(tag, at)
        else:
            if tag in BLOCK:
                flush()
            marked = 0 if tag in VOID else _furniture(tag, attributes, kind == ARTICLE)
            if marked:
                flush()
                if not page.closes(tag, at):
                    if kind in (ARTICLE, LOOSE, SOFT):
                        kind, unclosed = marked, kind
                    continue
            if tag == "p" and stack and stack[-1][0] == "p":
                pop()
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK or not (tag in BLOCK or marked):
                continue
            stack.append((tag, kind))
            count[tag] = count.get(tag, 0) + 1
            if tag == "head":
                kind = NO
            elif kind in (ARTICLE, LOOSE, SOFT):
                kind = marked if marked else ARTICLE if tag in ("article", "main") else kind
    text.append(raw[at:])
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b. Equal ends are matched first; between
    them Hunt-Szymanski, which costs by matching pairs and not by the product of the lengths."""
    from bisect import bisect_left

    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    places: dict[str, list[int]] = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k], links[k] = j, node
    node = links[-1] if links else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def url_key(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    host = (parts.netloc.rpartition("@")[2]).lower()
    return host, parts.path or "/"


_PARSED = pa.schema([("host", pa.string()), ("path", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("whole", pa.string()), ("url", pa.string()), ("kinds", pa.binary()), ("size", pa.int64()), ("lines", pa.binary())])
_PARSED_DDL = "host string, path string, digest string, page_id bigint, whole string, url string, kinds binary, size bigint, lines binary"
_DEALT = pa.schema([("part", pa.int32()), ("role", pa.int32()), *_PARSED])
_ORDER = ["host", "path", "digest", "page_id", "whole"]
BEFORE, OWN, AFTER = range(3)


def order_key(row) -> tuple:
    """The sort order of pages: host, path, unmarked lines, page_id with null first, all lines."""
    return row["host"], row["path"], row["digest"], row["page_id"] is not None, row["page_id"] or 0, row["whole"]


def lines_of(row: dict) -> list[str]:
    """The lines of a dealt row."""
    if not row["kinds"]:
        return []
    return pa.decompress(row["lines"], decompressed_size=row["size"], codec="zstd", asbytes=True).decode().split("\n")


def parse(pages: DataFrame) -> DataFrame:
    """host, path, digest of the unmarked lines, page_id, digest of all lines, url, the lines' kinds,
    a byte each, and the lines with their size."""
    import hashlib

    def digest(*values: bytes) -> str:
        return hashlib.blake2b(b"\0".join(values), digest_size=16).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "html"):
            out = []
            for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                found = blocks(html)
                host, path = url_key(url)
                kinds = bytes(k for _, k in found)
                lines = [x.encode() for x, _ in found]
                data = b"\n".join(lines)
                unmarked = digest(*(x for x, k in zip(lines, kinds) if k in (ARTICLE, LOOSE)))
                out.append({
                    "host": host, "path": path, "digest": unmarked, "page_id": page_id, "whole": digest(kinds, *lines), "url": url, "kinds": kinds,
                    "size": len(data), "lines": data,
                })
            yield pa.RecordBatch.from_pylist(out, schema=_PARSED)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, _PARSED_DDL)


def deal(parsed: DataFrame, bounds: list[tuple], edges: dict[tuple, list[tuple[int, int]]]) -> DataFrame:
    """Parsed pages with part (by bounds) and role, their lines compressed for the way. edges: (part,
    role) of the further places that a page of that order key goes to."""
    from bisect import bisect_right

    at = _PARSED.get_field_index("lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, codec = set(), pa.Codec("zstd", 9)
        for batch in (part for whole in batches for part in text_chunks([whole], "lines")):
            packed = pa.array([codec.compress(x, asbytes=True) if x else b"" for x in batch.column("lines").to_pylist()], type=pa.binary())
            batch = batch.set_column(at, _PARSED.field(at), packed)
            keys = [order_key(r) for r in batch.select(_ORDER).to_pylist()]
            places = [[(bisect_right(bounds, k), OWN)] for k in keys]
            for found, k in zip(places, keys):
                if k in edges and k not in sent:
                    sent.add(k)
                    found += edges[k]
            rows = batch.take(pa.array([i for i, found in enumerate(places) for _ in found], type=pa.int64()))
            flat = [x for found in places for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in flat], pa.int32()), pa.array([r for _, r in flat], pa.int32()), *rows.columns], schema=_DEALT)

    return parsed.mapInArrow(run, f"part int, role int, {_PARSED_DDL}")


def part_ends(keys: DataFrame, bounds: list[tuple]) -> list:
    """Of each part with rows, in order: its first and last page, the last page of the first run's
    end and the first page of the last run (a run: pages of equal unmarked lines that follow each
    other), the page before the last run, the page after the first run."""
    from bisect import bisect_right

    n = len(bounds) + 1
    key = pa.struct([("host", pa.string()), ("path", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("whole", pa.string())])
    names = ["first", "last", "last_run", "before_last", "after_first", "first_run_end"]
    schema = pa.schema([("part", pa.int32()), *((x, key) for x in names)])
    ddl = "part int, " + ", ".join(f"{x} struct<host:string,path:string,digest:string,page_id:bigint,whole:string>" for x in names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bisect_right(bounds, order_key(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], names=[*_ORDER, "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                part = row.pop("part")
                if not now or now["part"] != part:
                    now = {"part": part, "first": row, "last": row, "last_run": row, "before_last": None, "after_first": None, "first_run_end": row}
                    out.append(now)
                    continue
                if (row["host"], row["digest"]) != (now["last"]["host"], now["last"]["digest"]):
                    now["before_last"], now["last_run"] = now["last"], row
                    now["after_first"] = now["after_first"] or row
                elif not now["after_first"]:
                    now["first_run_end"] = row
                now["last"] = row
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    dealt = keys.select(_ORDER).mapInArrow(deal, "host string, path string, digest string, page_id bigint, whole string, part int")
    ends = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", *_ORDER).mapInArrow(run, ddl).collect()
    return sorted((r.asDict(recursive=True) for r in ends), key=lambda r: r["part"])


def neighbours(ends: list[dict]) -> tuple[dict[tuple, list[tuple[int, int]]], dict[int, str], dict[int, str]]:
    """Where edge pages go as well; the path that the run at a part's begin begins with, and that
    the run at its end ends with, wherever that is."""
    edges: dict[tuple, list[tuple[int, int]]] = {}
    paths: tuple[dict[int, str], dict[int, str]] = {}, {}
    for role, order, near, far, near_run, beyond in ((BEFORE, ends, "first", "last", "last_run", "before_last"), (AFTER, ends[::-1], "last", "first", "first_run_end", "after_first")):
        run = outer = previous = start = None  # the run so far, the page beyond it, the last page, the run's outermost path
        for e in order:
            same = (e[near]["host"], e[near]["digest"])
            if same != run:
                run, outer, start = same, previous, e[near]["path"]
            paths[role == AFTER][e["part"]] = start
            if outer and outer["host"] == e[near]["host"]:
                edges.setdefault(order_key(outer), []).append((e["part"], role))
            if e[beyond]:
                run, outer, start = (e[far]["host"], e[far]["digest"]), e[beyond], e[near_run]["path"]
            previous = e[far]
    return edges, *paths


def template(lines: list[str], kinds: bytes, near: list[list[str]]) -> set[int]:
    """Places of the unmarked lines that comparison deletes. near: the lines of the neighbours that
    differ, the partner first. An article's line goes if both share it, unless more than half of
    the article's text would go."""
    if not near:
        return set()
    shared = {i for i in shared_lines(lines, near[0]) if kinds[i] in (ARTICLE, LOOSE)}
    article = [i for i, k in enumerate(kinds) if k == ARTICLE]
    quoted = shared.intersection(article)
    if quoted and len(near) > 1:
        both = quoted & shared_lines(lines, near[1])
        if 2 * sum(len(lines[i]) for i in both) <= sum(len(lines[i]) for i in article):
            quoted -= both
    return shared - quoted


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, partner_id (the page it was compared with, if any),
    n_shared (lines deleted by comparison)."""
    spark = pages.sparkSession
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("partner_id", pa.int64()), ("n_shared", pa.int64())])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = materialize(parse(pages), "pages", compression="zstd")
    keys = parsed.select(_ORDER)
    share = min(1.0, 60 * n / max(1, keys.count()))
    sample = sorted(map(order_key, (r.asDict() for r in keys.sample(share, seed=1).collect())))
    bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    edges, starts, stops = neighbours(part_ends(keys, bounds))
    dealt = deal(parsed, bounds, edges).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "role", *_ORDER, "url")

    def common(a: str, b: str) -> int:
        return len(os.path.commonprefix([a, b]))

    def solve(run: dict, before: dict | None, after: dict | None) -> Iterator[dict]:
        near = [(-common(x["path"], path), x) for x, path in ((before, run["start"]), (after, run["stop"])) if x and x["host"] == run["host"]]
        near = [x for _, x in sorted(near, key=lambda x: x[0])]
        others = [lines_of(x) for x in near]
        texts: dict[bytes, tuple[str, int]] = {}
        for page_id, url, kinds in run["pages"]:
            if kinds not in texts:
                gone = template(run["lines"], kinds, others)
                texts[kinds] = "\n".join(x for i, x in enumerate(run["lines"]) if i not in gone), len(gone)
            text, n_gone = texts[kinds]
            yield {"page_id": page_id, "url": url, "text": text, "n_chars": len(text), "partner_id": near[0]["page_id"] if near else None, "n_shared": n_gone}

    def solved(rows: Iterator[dict]) -> Iterator[dict]:
        part, before, run, last = None, None, None, None
        for row in rows:
            if row["part"] != part:
                if run:
                    yield from solve(run, before, None)
                part, before, run = row["part"], None, None
            if row["role"] == BEFORE:
                before = row
                continue
            same = run and (run["host"], run["digest"]) == (row["host"], row["digest"])
            if run and not same:
                if row["role"] == AFTER:
                    run["stop"] = stops[part]
                yield from solve(run, before, row)
                before, run = last, None
            if row["role"] == AFTER:
                continue
            unmarked = [i for i, k in enumerate(row["kinds"]) if k in (ARTICLE, LOOSE)]
            kinds = bytes(row["kinds"][i] for i in unmarked)
            if not run:
                begins = before is None or before["role"] == BEFORE
                run = {"host": row["host"], "digest": row["digest"], "lines": [x for x, k in zip(lines_of(row), row["kinds"]) if k in (ARTICLE, LOOSE)], "start": starts[part] if begins else row["path"], "pages": []}
            run["pages"].append((row["page_id"], row["url"], kinds))
            run["stop"] = row["path"]
            last = row
        if run:
            yield from solve(run, before, None)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    yield from batch.slice(i, 256).to_pylist()

        out: list[dict] = []
        for row in solved(rows()):
            out.append(row)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.mapInArrow(run_, "page_id bigint, url string, text string, n_chars bigint, partner_id bigint, n_shared bigint")
