"""Tolerant XML tokens: what filings contain, not what a validating parser would accept.

Names are split into prefix and local part; namespaces are scoped. Beyond plain XML it accepts
HTML's named entities, unknown entities and a bare `&` as text, attributes without quotes or value,
end tags that skip open elements, several roots and text outside them. It rejects what a lenient
XML reader still rejects: characters outside XML's range in text or quoted values, `<` in a quoted
value, `]]>` in text, `--` in a comment, elements left open, and encodings other than UTF-8 and
ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.entities import name2codepoint

START, END, TEXT = "start", "end", "text"
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"

_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_NAME = re.compile("[A-Za-z0-9_:.\\-\x80-\U0010ffff]+")
_GAP = re.compile(r"[ \r\n\t]*")
_ATTRIBUTE = re.compile("[ \r\n\t]*([A-Za-z0-9_:.\\-\x80-\U0010ffff]+)[ \r\n\t]*(?:=[ \r\n\t]*(?:\"([^\"<]*)\"|'([^'<]*)'|([A-Za-z0-9_:\\-]*(?![\"'A-Za-z0-9_:\\-]))))?")
_REFERENCE = re.compile("&(?:#(?:([0-9]+)|x([0-9A-Fa-f]+))|([A-Za-z0-9_:.\\-\x80-\U0010ffff]+));")
_CUT_OFF = re.compile("&(?:#(?:[0-9]*|x[0-9A-Fa-f]*)|[A-Za-z0-9_:.\\-\x80-\U0010ffff]*)\\Z")
_PARAMETER = re.compile(r"\b(version|encoding)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


# A tag as most are: ASCII names, quoted values without references. Others take the long way.
_ASCII_NAME = r"([A-Za-z_][\w.\-]*)(?::([A-Za-z_][\w.\-]*))?"
_PAIR = r"[ \r\n\t]+[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?[ \r\n\t]*=[ \r\n\t]*(?:\"[^\"<&\r]*\"|'[^'<&\r]*')"
_TAG = re.compile(rf"</{_ASCII_NAME}[ \r\n\t]*>|<{_ASCII_NAME}((?:{_PAIR})*)[ \r\n\t]*(/?)>", re.A)
_VALUE = re.compile(r"([A-Za-z_][\w.\-]*)(?::([A-Za-z_][\w.\-]*))?[ \r\n\t]*=[ \r\n\t]*(?:\"([^\"]*)\"|'([^']*)')", re.A)
_RESERVED = frozenset(("xml", "xmlns"))


class MarkupError(ValueError):
    """A document that the reader rejects."""


class Reader:
    """Tokens of one document. Between tokens `ns` holds the bindings in scope.

    Elements of the namespace `quiet` that declare no namespace are checked but not told, nor is
    text, while `listening` is false; their ends and text are told while it is true."""

    def __init__(self, data: bytes, quiet: str | None = None):
        self.quiet, self.listening = quiet, quiet is None
        self.doc = data.decode("utf-8", "surrogateescape")
        self.clean = not _BAD.search(self.doc)
        self.ns: dict[str, str] = {}
        self.open: list[tuple[str, str, list]] = []  # prefix, local, bindings to restore

    def fail(self, at: int, message: str) -> MarkupError:
        return MarkupError(f"XML syntax error on line {1 + self.doc.count(chr(10), 0, at)}: {message}")

    def cut_off(self) -> MarkupError:
        return self.fail(len(self.doc), "unexpected EOF")

    def check(self, text: str, at: int) -> None:
        if not self.clean and (m := _BAD.search(text)):
            code = ord(m[0])
            raise self.fail(at + m.start(), "invalid UTF-8" if 0xD800 <= code < 0xE000 else f"illegal character code U+{code:04X}")

    def decode(self, text: str, at: int) -> str:
        """Line ends to line feeds and references decoded; an unknown reference stays."""
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "&" not in text:
            return text

        def of(m: re.Match) -> str:
            if m[3]:
                if m[3] in _PREDEFINED:
                    return _PREDEFINED[m[3]]
                return chr(name2codepoint[m[3]]) if m[3] in name2codepoint else m[0]
            digits, base = (m[1], 10) if m[1] else (m[2], 16)
            code = int(digits, base) if len(digits) < 12 else 0x110000
            if code > 0x10FFFF:
                return m[0]
            if 0xD800 <= code < 0xE000:
                return "�"
            if _BAD.match(chr(code)):
                raise self.fail(at + m.start(), f"illegal character code U+{code:04X}")
            return chr(code)

        return _REFERENCE.sub(of, text)

    def name(self, at: int, missing: str) -> tuple[int, str, str]:
        """End, prefix and local part of the name at a place."""
        m = _NAME.match(self.doc, at)
        if not m:
            raise self.cut_off() if at >= len(self.doc) else self.fail(at, missing)
        if m.end() >= len(self.doc):
            raise self.cut_off()
        return (m.end(), *self.split(m[0], at, missing))

    def split(self, name: str, at: int, missing: str) -> tuple[str, str]:
        first = name[0]
        if not (first in "_:" or first.isalpha()) or not name.isascii() and not all(c in "_:.-·" or c.isalnum() or unicodedata.category(c)[0] == "M" for c in name):
            raise self.fail(at, f"invalid XML name: {name}")
        head, colon, tail = name.partition(":")
        if not colon or not head or not tail:
            if name.count(":") > 1:
                raise self.fail(at, missing)
            return "", name
        if ":" in tail:
            raise self.fail(at, missing)
        return head, tail

    def space(self, prefix: str, local: str) -> str:
        """An element's namespace: the binding, or the prefix itself where it has none."""
        if prefix == "xmlns":
            return "xmlns"
        if prefix == "xml":
            return XML_NAMESPACE
        if not prefix and local == "xmlns":
            return ""
        return self.ns.get(prefix, prefix)

    def tokens(self) -> Iterator[tuple]:
        """(START, namespace, local, attributes), (END, namespace, local) and (TEXT, text, place,
        decoded). Attributes are (prefix, local, value) in order."""
        doc, at, size = self.doc, 0, len(self.doc)
        tag, ns, stack, quiet = _TAG.match, self.ns, self.open, self.quiet
        plain_text = self.clean and "]]>" not in doc
        while at < size:
            lt = doc.find("<", at)
            end = size if lt < 0 else lt
            if end > at:
                if not plain_text or lt < 0 or doc.find("&#", at, end) >= 0:
                    self.check_text(at, end, lt < 0)
                if self.listening:
                    yield TEXT, doc[at:end], at, False
                at = end
                continue
            m = tag(doc, at) if self.clean else None
            if m:
                prefix, local = m.group(1, 2) if m[1] else m.group(3, 4)
                prefix, local = (prefix, local) if local else ("", prefix)
                if m[1]:
                    if stack and not stack[-1][2] and stack[-1][1] == local and stack[-1][0] == prefix and prefix not in _RESERVED:
                        stack.pop()
                        space = ns.get(prefix, prefix)
                        if self.listening or space != quiet:
                            yield END, space, local
                        at = m.end()
                        continue
                elif "xmlns" not in m[5] and prefix not in _RESERVED and local != "xmlns" and m.end() < size:
                    space = ns.get(prefix, prefix)
                    if space != quiet:
                        attributes = [(p, n, v if v is not None else w) if n else ("", p, v if v is not None else w) for p, n, v, w in (x.groups() for x in _VALUE.finditer(m[5]))]
                        yield START, space, local, attributes
                    if not m[6]:
                        stack.append((prefix, local, ()))
                    elif self.listening or space != quiet:
                        yield END, space, local
                    at = m.end()
                    continue
            at += 1
            if at >= size:
                raise self.cut_off()
            sign = doc[at]
            if sign == "/":
                at = yield from self.end_tag(at + 1)
            elif sign == "?":
                at = self.instruction(at + 1)
            elif sign == "!":
                if doc.startswith("[CDATA[", at + 1):
                    stop = doc.find("]]>", at + 8)
                    if stop < 0:
                        raise self.fail(size, "unexpected EOF in CDATA section")
                    text = doc[at + 8 : stop]
                    self.check(text, at + 8)
                    yield TEXT, text, at + 8, True
                    at = stop + 3
                else:
                    at = self.declaration(at + 1)
            else:
                at = yield from self.start_tag(at)
        if self.open:
            raise self.cut_off()

    def check_text(self, at: int, end: int, last: bool) -> None:
        run = self.doc[at:end]
        if "]]>" in run:
            raise self.fail(at + run.index("]]>"), "unescaped ]]> not in CDATA section")
        self.check(run, at)
        if last and "&" in run and _CUT_OFF.search(run):
            raise self.cut_off()
        if "&#" in run:
            self.decode(run, at)

    def start_tag(self, at: int) -> Iterator[tuple]:
        doc = self.doc
        at, prefix, local = self.name(at, "expected element name after <")
        attributes: list[tuple[str, str, str]] = []
        closed = False
        while True:
            here = _GAP.match(doc, at).end()
            if here >= len(doc):
                raise self.cut_off()
            if doc[here] == ">":
                at = here + 1
                break
            if doc[here] == "/":
                if here + 1 >= len(doc):
                    raise self.cut_off()
                if doc[here + 1] != ">":
                    raise self.fail(here + 1, "expected /> in element")
                at, closed = here + 2, True
                break
            m = _ATTRIBUTE.match(doc, here)
            if not m:
                raise self.fail(here, "expected attribute name in element")
            if m.end() >= len(doc):
                raise self.cut_off()
            p, name = self.split(m[1], here, "expected attribute name in element")
            value = m[2] if m[2] is not None else m[3]
            if value is not None:
                place = m.start(2) if m[2] is not None else m.start(3)
                self.check(value, place)
                value = self.decode(value, place)
            elif m[4] is not None:
                value = m[4]
            else:
                value = name
                rest = _GAP.match(doc, m.end(1)).end()
                if doc.startswith("=", rest):
                    # a quoted value that the pattern refused: never ended, or with < inside
                    quote = _GAP.match(doc, rest + 1).end()
                    lt, stop = doc.find("<", quote), doc.find(doc[quote : quote + 1] or '"', quote + 1)
                    raise self.fail(lt, "unescaped < inside quoted string") if lt >= 0 and (stop < 0 or lt < stop) else self.cut_off()
            attributes.append((p, name, value))
            at = m.end()
        restore = []
        for p, name, value in attributes:
            key = name if p == "xmlns" else "" if not p and name == "xmlns" else None
            if key is not None:
                restore.append((key, self.ns.get(key)))
                self.ns[key] = value
        self.open.append((prefix, local, restore))
        yield START, self.space(prefix, local), local, attributes
        if closed:
            yield from self.close(prefix, local, at)
        return at

    def end_tag(self, at: int) -> Iterator[tuple]:
        at, prefix, local = self.name(at, "expected element name after </")
        at = _GAP.match(self.doc, at).end()
        if at >= len(self.doc):
            raise self.cut_off()
        if self.doc[at] != ">":
            raise self.fail(at, f"invalid characters between </{local} and >")
        yield from self.close(prefix, local, at + 1)
        return at + 1

    def close(self, prefix: str, local: str, at: int) -> Iterator[tuple]:
        """Ends of the elements that an end tag closes: those left open inside, each under its raw
        prefix, then its own. One left open that declares a namespace makes the tag an error."""
        while True:
            if not self.open:
                raise self.fail(at, f"unexpected end element </{local}>")
            p, name, restore = self.open.pop()
            if name == local:
                break
            yield END, p, name
            if restore:
                raise self.fail(at, f"unexpected end element </{local}>")
        if p != prefix:
            raise self.fail(at, f"element <{local}> in space {p} closed by </{local}> in space {prefix or '\"\"'}")
        yield END, self.space(prefix, local), local
        for key, old in reversed(restore):
            if old is None:
                self.ns.pop(key, None)
            else:
                self.ns[key] = old

    def instruction(self, at: int) -> int:
        end, prefix, local = self.name(at, "expected target name after <?")
        stop = self.doc.find("?>", end)
        if stop < 0:
            raise self.cut_off()
        if not prefix and local == "xml":
            for m in _PARAMETER.finditer(self.doc, end, stop):
                value = m[2] if m[2] is not None else m[3]
                if m[1] == "version" and value not in ("", "1.0"):
                    raise MarkupError(f'xml: unsupported version "{value}"; only version 1.0 is supported')
                if m[1] == "encoding" and value.strip().lower() not in ("", "utf-8", "ascii", "us-ascii"):
                    raise MarkupError(f'xml: unsupported charset "{value}"')
        return stop + 2

    def declaration(self, at: int) -> int:
        """Skip a comment, or a directive such as DOCTYPE with its quotes and nested brackets."""
        doc = self.doc
        if doc.startswith("-", at):
            if not doc.startswith("--", at):
                raise self.cut_off() if at + 1 >= len(doc) else self.fail(at + 1, "invalid sequence <!- not part of <!--")
            stop = doc.find("--", at + 2)
            if stop < 0 or stop + 2 >= len(doc):
                raise self.cut_off()
            if doc[stop + 2] != ">":
                raise self.fail(stop + 2, 'invalid sequence "--" not allowed in comments')
            return stop + 3
        if doc.startswith("[", at):
            raise self.cut_off() if "[CDATA[".startswith(doc[at : at + 7]) else self.fail(at + 1, "invalid <![ sequence")
        depth, at = 0, at + 1
        for m in re.compile(r"<!--.*?-->|\"[^\"]*\"|'[^']*'|[<>]", re.S).finditer(doc, at):
            if m[0] == ">":
                if not depth:
                    return m.end()
                depth -= 1
            elif m[0] == "<":
                depth += 1
        raise self.cut_off()
