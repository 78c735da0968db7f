"""Text functions: white space, qualified names, file names, booleans and the dimensions JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space when runs of it are collapsed (Unicode White_Space), for Java regexes.
SPACE = r"\t\n\x0B\f\r\x85\xA0\p{Zs}\x{2028}\x{2029}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def fold_spaces(c: Column) -> Column:
    """Every Unicode space separator, and the line and paragraph separator, becomes a space."""
    return F.regexp_replace(c, r"[\p{Zs}\x{2028}\x{2029}]", " ")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def format_local(c: Column) -> Column:
    """The transform's local name: lower case, after the last colon. Null is empty."""
    return F.substring_index(F.lower(trim_space(F.coalesce(c, F.lit("")))), ":", -1)


def qname_local(c: Column) -> Column:
    """Local part of `prefix:local` or `{uri}local`: after the last closing brace, else after the
    first colon, unless nothing follows."""
    brace, colon = r"(?s)\A.*\}([^}]+)\z", r"(?s)\A[^:]*:(.+)\z"
    return let(trim_space(c), lambda t: F.when(t.rlike(brace), F.regexp_extract(t, brace, 1)).when(t.rlike(colon), F.regexp_extract(t, colon, 1)).otherwise(t))


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


# The two forms of a filing's file name that hold a company number.
BULK_NAME = r"^Prod\d+_\d+_([A-Za-z0-9]{8})_\d{8}"
ACCOUNT_NAME = r"^([A-Za-z0-9]{8})_[^_]+_"


def company_number(source_file: Column) -> Column:
    """The company number in a file name, upper case, null if there is none. Never a number: letters
    and leading zeros stay."""
    base = base_name(source_file)
    found = [F.regexp_extract(base, p, 1) for p in (BULK_NAME, ACCOUNT_NAME)]
    return F.upper(F.coalesce(*(F.nullif(f, F.lit("")) for f in found)))


def is_plain_dimension(c: Column) -> Column:
    """No dimensions: null, blank, or an empty object."""
    return c.isNull() | F.trim(c).isin("", "{}")


def non_empty(c: Column) -> Column:
    """The trimmed value, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def dimensions_json(dims: Column) -> Column:
    """A map as JSON text with keys in order and `<`, `>`, `&` and the two Unicode line ends
    escaped; an empty or null map is the empty text."""
    sorted_map = F.map_from_entries(F.array_sort(F.map_entries(dims)))
    out = F.to_json(sorted_map)
    for sign, code in (("&", "0026"), ("<", "003c"), (">", "003e"), ("\u2028", "2028"), ("\u2029", "2029")):
        out = F.replace(out, F.lit(sign), F.lit(f"\\u{code}"))
    return F.when(F.coalesce(F.size(dims), F.lit(0)) <= 0, F.lit("")).otherwise(out)


def unit_text(unit_ref: Column, measure: Column) -> Column:
    """The unit's measure; where the unit is unknown or has none, the reference itself."""
    return F.when(F.coalesce(unit_ref, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(F.nullif(measure, F.lit("")), unit_ref))
