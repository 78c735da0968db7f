"""What a name or the first bytes say: input format, wanted members, package layout. Pure functions."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ZIP, TAR, TAR_ZST, INSTANCE, DIRECTORY, UNKNOWN = "zip", "tar", "tar.zst", "instance", "directory", "unknown"

# Endings of instance documents, and of tar archives compressed with zstd.
INSTANCE_ENDINGS = (".xhtml", ".html", ".htm", ".xbrl", ".xml")
ZST_ENDINGS = (".tar.zst", ".tar.zstd", ".tzst", ".zst", ".zstd")
MOST_BYTES = 100 << 20


def detect_format(source: str) -> str:
    """Format by name; query and fragment are left aside, and only if nothing ends fittingly is an
    archive's ending looked for anywhere in the text."""
    name = re.split(r"[?#]", source, maxsplit=1)[0].lower()
    for endings, kind in (((".zip",), ZIP), (ZST_ENDINGS, TAR_ZST), ((".tar",), TAR), (INSTANCE_ENDINGS, INSTANCE)):
        if name.endswith(endings):
            return kind
    low = source.lower()
    for parts, kind in (((".zip",), ZIP), (("tar.zst", ".tzst"), TAR_ZST), ((".tar",), TAR)):
        if any(p in low for p in parts):
            return kind
    return UNKNOWN


def is_zip(head: bytes) -> bool:
    return head[:2] == b"PK" and (len(head) < 4 or head[2] in (3, 5, 7))


def is_xml(head: bytes) -> bool:
    return head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")[:1] == b"<"


def is_gzip(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b"


def sniff(head: bytes) -> str:
    """Format by the first 512 bytes; gzip is unknown, it is not read."""
    if not head or is_gzip(head):
        return UNKNOWN
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return TAR_ZST
    if is_zip(head):
        return ZIP
    if head[257:262] == b"ustar":
        return TAR
    return INSTANCE if is_xml(head) else UNKNOWN


def is_instance_name(name: str) -> bool:
    return name.lower().endswith(INSTANCE_ENDINGS)


def is_zip_name(name: str) -> bool:
    return name.lower().endswith(".zip")


def is_junk(name: str) -> bool:
    """Hidden files and what archivers add."""
    name = name.replace("\\", "/")
    return "__MACOSX/" in name or posixpath.basename(name.rstrip("/")).startswith((".", "__"))


def want_member(name: str) -> bool:
    return is_instance_name(name) and not is_junk(name)


def want_nested_zip(name: str) -> bool:
    return is_zip_name(name) and not is_junk(name)


def want_member_column(name: Column) -> Column:
    """want_member over a column of names."""
    low, base = F.lower(name), F.substring_index(F.regexp_replace(name, r"\\", "/"), "/", -1)
    return low.rlike(r"\.(xhtml|html|htm|xbrl|xml)$") & ~F.regexp_replace(name, r"\\", "/").contains("__MACOSX/") & ~base.startswith(".") & ~base.startswith("__")


def in_folder(name: str, folder: str) -> bool:
    """A folder of that name, in any letter case, is on the path."""
    return folder.lower() in (p.lower() for p in name.replace("\\", "/").strip("/").split("/")[:-1])


BULK, REPORT, FILING = "bulk", "report", "filing"

# The top folder of a filing package, and what marks a report package.
FILING_ROOT = re.compile(r"[A-Za-z][A-Za-z0-9]*-[A-Z]{0,2}[0-9]{6,8}", re.I)
REPORT_MARK = "META-INF/reportPackage.json"
REPORTS = "reports"
INLINE_ENDINGS = (".xhtml", ".html", ".htm")
REPORT_ENDINGS = (*INLINE_ENDINGS, ".xbrl")


@dataclass
class Package:
    kind: str = BULK
    files: list[str] = field(default_factory=list)
    only_ukfrs: bool = False


def clean_name(name: str) -> str:
    return posixpath.normpath("/" + name.replace("\\", "/")).strip("/")


def select_package(names: list[str]) -> Package:
    """What to read of an archive, by its members' names alone."""
    clean = sorted({c for c in map(clean_name, names) if c})
    tops = sorted({c.split("/")[0] for c in clean})
    for root in ["", *(tops if len(tops) == 1 else [])]:
        base = f"{root}/" if root else ""
        if any(c == base + REPORT_MARK or c == base + REPORTS or c.startswith(f"{base}{REPORTS}/") for c in clean):
            return Package(REPORT, _reports(clean, f"{base}{REPORTS}/"), True)
    if len(tops) == 1 and FILING_ROOT.fullmatch(tops[0]):
        return Package(FILING, _filing(clean, tops[0]))
    return Package()


def _reports(names: list[str], root: str) -> list[str]:
    """Files right under the reports folder, else of each subfolder a single file or a set of inline
    files; nothing deeper."""
    direct: list[str] = []
    sets: dict[str, list[str]] = {}
    for n in names:
        parts = n[len(root) :].split("/") if n.startswith(root) else []
        if not parts or is_junk(n) or not parts[-1].lower().endswith(REPORT_ENDINGS):
            continue
        if len(parts) == 1:
            direct.append(n)
        elif len(parts) == 2:
            sets.setdefault(parts[0], []).append(n)
    return direct or [n for _, files in sorted(sets.items()) if len(files) == 1 or all(f.lower().endswith(INLINE_ENDINGS) for f in files) for n in files]


def _filing(names: list[str], root: str) -> list[str]:
    """English accounts of an overseas company; else subsidiary accounts; else accounts."""
    files = [n for n in names if want_member(n)]
    of = lambda folder: [n for n in files if in_folder(n, folder)]
    if root.upper().startswith("OVERSEAS-"):
        return of("english-accounts")
    return of("subsidiary-accounts") or [n for n in of("accounts") if not in_folder(n, "subsidiary-accounts")]
