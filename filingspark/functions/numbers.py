"""Displayed numbers to plain decimal text, as column expressions.

The value, scale, sign and transform of a tagged number become its plain value with at most ten
fraction digits. Digits, one decimal point and an exponent are handled here on strings of any
length that rounding needs (37 digits where a rounding carry is needed); what else the format
allows - fractions `a/b`, hexadecimal, longer carries - comes from `exact_number`, which the parser
applies to the rare values that need it.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingspark.functions.text import fold_spaces, format_local, let, trim_space

FRACTION_DIGITS = 10
DASHES = ("-", "–", "—")
_NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,6})?"
_PREFIX = r"(?d)(?i)(.*:)|(.+-[ \t\n\f\r])"


def separators(v: Column, fmt: Column) -> Column:
    """Thousands separators out, the decimal separator to a point, by the transform's local name."""
    dotted = F.translate(F.translate(v, ".", ""), ",", ".")
    spaced = F.translate(v, " \u00a0", "")
    return (
        F.when(fmt == "numdotcomma", dotted)
        .when(fmt == "numspacedot", spaced)
        .when(fmt == "numspacecomma", F.translate(spaced, ",", "."))
        .otherwise(F.translate(v, ", \u00a0", ""))
    )


def looks_numeric(v: Column) -> Column:
    bare = F.translate(F.regexp_replace(F.regexp_replace(trim_space(v), r"\A-", ""), r"\A\+", ""), ", ", "")
    return bare.rlike(rf"\A[+-]?{_NUMBER}\z")


def strip_prefix(v: Column) -> Column:
    """Text before a colon, or before a dash and a space, goes if a number is left ("2017 - 2")."""
    bare = let(trim_space(F.regexp_replace(v, _PREFIX, "")), lambda b: F.when((b != "") & looks_numeric(b), b).otherwise(v))
    return F.when(v.rlike(r":|-[ \t\n\f\r]"), bare).otherwise(v)


def plain_text(whole: Column, part: Column, negative: Column) -> Column:
    """A number's text from its digits before and after the point, without idle zeros."""
    number = let(F.regexp_replace(whole, r"\A0+", ""), lambda w: let(F.regexp_replace(part, r"0+\z", ""), lambda p: F.concat(F.when(w == "", F.lit("0")).otherwise(w), F.when(p == "", F.lit("")).otherwise(F.concat(F.lit("."), p)))))
    return let(number, lambda n: F.when((n != "0") & negative, F.concat(F.lit("-"), n)).otherwise(n))


def _rounded(whole: Column, part: Column, negative: Column) -> Column:
    """The number with its first ten fraction digits, carried up by one; null if the carry is long."""
    joined = F.concat(whole, F.substr(part, F.lit(1), F.lit(FRACTION_DIGITS)))
    carried = let(joined, lambda j: F.when(F.length(F.regexp_replace(j, r"\A0+", "")) <= 37, (j.try_cast("decimal(38,0)") + F.lit(1).cast("decimal(1,0)")).cast("string")))
    full = let(carried, lambda c: F.when(F.length(c) < FRACTION_DIGITS, F.lpad(c, FRACTION_DIGITS, "0")).otherwise(c))
    return let(full, lambda f: plain_text(F.substr(f, F.lit(1), F.length(f) - FRACTION_DIGITS), F.substr(f, F.length(f) - FRACTION_DIGITS + 1), negative))


def shift(digits: Column, point: Column, negative: Column) -> Column:
    """The number whose digits stand around `point` (which may lie outside them), rounded half away
    from zero to ten fraction digits, without idle zeros; null if the carry is too long."""

    def render(n: Column) -> Column:
        whole = F.when(point <= 0, F.lit("")).when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n))).otherwise(F.substr(digits, F.lit(1), point))
        part = F.when(point >= n, F.lit("")).when(point < 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substr(digits, point + 1))
        return let(whole, lambda w: let(part, lambda p: F.when(F.substr(p, F.lit(FRACTION_DIGITS + 1), F.lit(1)) >= "5", _rounded(w, p, negative)).otherwise(plain_text(w, F.substr(p, F.lit(1), F.lit(FRACTION_DIGITS)), negative))))

    return let(F.length(digits), render)


def normalise_numeric(value: Column, scale: Column, sign: Column, fmt: Column, exact: Column | None = None) -> Column:
    """Plain decimal text of a tagged number. exact: what exact_number gave for the row, if any."""
    fl = format_local(fmt)
    power = F.when(F.coalesce(scale, F.lit("")).rlike(r"\A[+-]?[0-9]{1,9}\z"), scale.try_cast("int")).otherwise(F.lit(0))

    def number(v: Column, negative: Column) -> Column:
        exponent = F.coalesce(F.nullif(F.regexp_extract(v, r"[eE]([+-]?[0-9]{1,6})\z", 1), F.lit("")).try_cast("int"), F.lit(0))
        plain = let(F.regexp_extract(v, r"\A([0-9.]+)", 1), lambda m: let(power + exponent, lambda n: F.when(F.abs(n) <= 400, shift(F.translate(m, ".", ""), F.length(F.substring_index(m, ".", 1)) + n, negative))))
        other = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), v)
        return F.when(v == "", F.lit("")).otherwise(F.coalesce(*([exact] if exact is not None else []), F.when(v.rlike(rf"\A{_NUMBER}\z"), plain), other))

    def unsigned(v: Column, negative: Column) -> Column:
        minus = v.startswith("-")
        bare = F.regexp_replace(F.when(minus, F.substr(v, F.lit(2))).otherwise(v), r"\A\+", "")
        return let(bare, lambda b: let(negative != minus, lambda n: number(b, n)))

    def bracketed(v: Column) -> Column:
        inside = v.rlike(r"(?s)\A\(.*\)\z")
        bare = F.when(inside, F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return let(bare, lambda b: unsigned(b, inside | (F.coalesce(sign, F.lit("")) == "-")))

    def with_format(f: Column) -> Column:
        start = trim_space(fold_spaces(F.coalesce(value, F.lit(""))))
        known = let(start, lambda v: F.when(v.isin(*DASHES) | (f == "zerodash"), F.lit("0")).otherwise(strip_prefix(v)))
        return let(known, lambda v: let(separators(v, f), bracketed))

    # Most numbers are plain digits and thousands commas, without sign, scaled by zeros if at all.
    zeros = F.coalesce(scale, F.lit(""))
    digits = F.coalesce(value, F.lit("")).rlike(r"\A[1-9][0-9,]{0,17}\z") & zeros.rlike(r"\A[0-9]?\z")
    usual = digits & (F.coalesce(sign, F.lit("")) == "") & ~F.lower(F.coalesce(fmt, F.lit(""))).rlike("numdotcomma|numspace|zerodash")
    return F.when(usual, F.rpad(F.translate(value, ",", ""), F.length(F.translate(value, ",", "")) + F.coalesce(zeros.try_cast("int"), F.lit(0)), "0")).otherwise(let(fl, with_format))


# The residue, in Python.
_PLAIN = re.compile(r"\s*[(]?[-+]?[0-9., \u00a0]*[)]?\s*\Z", re.A)
_RATIO = re.compile(r"([0-9]+)/([0-9]+)\Z", re.A)
_PREFIXED = re.compile(r"0[xX][0-9a-fA-F]+\Z|0[bB][01]+\Z|0[oO][0-7]+\Z")


def exact_number(value: str, scale: str, sign: str, fmt: str) -> str | None:
    """The plain value of a number that the column expression leaves: a ratio, a number in another
    base, or one of so many digits that rounding it needs a long carry. None for any other."""
    if _PLAIN.match(value) and len(value) < 30 and len(scale) < 4:
        return None
    v = re.sub(r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\u2028\u2029]", " ", value).strip()
    fl = fmt.strip().lower().rpartition(":")[2]
    v = v.replace(".", "").replace(",", ".") if fl == "numdotcomma" else v.replace(" ", "").replace(",", ".") if fl == "numspacecomma" else v.replace(" ", "") if fl == "numspacedot" else v.replace(",", "").replace(" ", "")
    negative = sign == "-"
    if v.startswith("(") and v.endswith(")"):
        negative, v = True, v[1:-1]
    if v.startswith("-"):
        negative, v = not negative, v[1:]
    v = v.removeprefix("+")
    if m := _RATIO.match(v):
        if not int(m[2]):
            return None
        number = Fraction(int(m[1]), int(m[2]))
    elif _PREFIXED.match(v):
        number = Fraction(int(v, 0))
    elif re.fullmatch(r"[0-9]*\.?[0-9]*", v) and len(v) > 28 and v not in ("", "."):
        number = Fraction(v if v[-1] != "." else v[:-1])
    else:
        return None
    power = int(scale) if re.fullmatch(r"[+-]?[0-9]{1,4}", scale) else 0
    number *= Fraction(10) ** power
    unit = 10**FRACTION_DIGITS
    scaled = number * unit
    rounded = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    text = f"{rounded // unit}.{rounded % unit:0{FRACTION_DIGITS}d}".rstrip("0").rstrip(".")
    return f"-{text}" if negative and rounded else text
