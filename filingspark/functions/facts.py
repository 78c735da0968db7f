"""Value of a tagged fact: text normalisation and the headcount corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingspark.functions.dates import transform_date
from filingspark.functions.numbers import DASHES, separators
from filingspark.functions.text import collapse_spaces, fold_spaces, format_local, let, trim_space

# The producer that tags headcounts with scale -2, and its programs.
PRODUCER = "CCH Software"
PROGRAMS = ("CCH Accounts Production ", "iXBRL Review & Tag ")
HEADCOUNT = "AverageNumberEmployeesDuringPeriod"
HEADCOUNT_SUFFIX = "AverageNumberEmployees"


def normalise_text(value: Column, fmt: Column) -> Column:
    """struct(value, failed) of a non-numeric fact: booleans and no-content by transform, else
    white space collapsed and the date transforms applied."""
    text = collapse_spaces(fold_spaces(F.coalesce(value, F.lit(""))))
    fixed = lambda x: F.struct(F.lit(x).alias("value"), F.lit(False).alias("failed"))

    def of(fl: Column) -> Column:
        return F.when(fl == "booleantrue", fixed("true")).when(fl == "booleanfalse", fixed("false")).when(fl == "nocontent", fixed("")).otherwise(let(text, lambda t: transform_date(fl, t)))

    plain = F.struct(collapse_spaces(F.coalesce(value, F.lit(""))).alias("value"), F.lit(False).alias("failed"))
    return F.when(F.coalesce(fmt, F.lit("")) == "", plain).otherwise(let(format_local(fmt), of))


def is_headcount(concept: Column) -> Column:
    return (concept == HEADCOUNT) | concept.endswith(HEADCOUNT_SUFFIX)


def is_pure(unit: Column) -> Column:
    u = trim_space(unit)
    return ~u.contains("/") & (F.lower(F.substring_index(u, ":", -1)) == "pure")


def displayed_positive(value: Column, fmt: Column) -> Column:
    """The displayed text is a number above zero, not bracketed, dashed or already negative."""
    fl, v = format_local(fmt), trim_space(fold_spaces(F.coalesce(value, F.lit(""))))
    bare = separators(v, fl)
    number = bare.rlike(r"\A\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z") & F.regexp_replace(bare, "[eE].*", "").rlike("[1-9]")
    return ~v.isin("", *DASHES) & (fl != "zerodash") & ~v.rlike("\\A[(\\-−]") & number


def displayed_integer(value: Column, fmt: Column) -> Column:
    """The displayed text is a whole number without sign once thousands separators are out."""
    fl, v = format_local(fmt), trim_space(fold_spaces(F.coalesce(value, F.lit(""))))
    dot = F.when(fl.isin("numdotcomma", "numspacecomma"), F.lit(",")).otherwise(F.lit("."))
    bare = F.when(fl == "numdotcomma", F.translate(v, ".", "")).when(fl.isin("numspacecomma", "numspacedot"), F.translate(v, " ", "")).otherwise(F.translate(v, ", ", ""))
    return ~v.contains(dot) & bare.rlike(r"\A[0-9]+\z")


def correct_headcount(concept: Column, scale: Column, unit: Column, value: Column, fmt: Column, sign: Column, gate: Column) -> Column:
    """struct(scale, sign, corrected): a positive headcount loses a tagged minus; from the known
    producer (gate), a whole headcount with scale -2 and a pure unit is taken as displayed."""
    same = F.struct(scale.alias("scale"), sign.alias("sign"), F.lit(False).alias("corrected"))
    minus = trim_space(F.coalesce(sign, F.lit(""))) == "-"
    drop = minus & displayed_positive(value, fmt)
    rescale = gate & (trim_space(F.coalesce(scale, F.lit(""))) == "-2") & is_pure(F.coalesce(unit, F.lit(""))) & (~minus | drop) & displayed_integer(value, fmt)
    fixed = F.struct(F.when(rescale, F.lit("0")).otherwise(scale).alias("scale"), F.when(drop, F.lit("")).otherwise(sign).alias("sign"), (drop | rescale).alias("corrected"))
    return F.when(is_headcount(concept), fixed).otherwise(same)


def producer_gate(name: Column, version: Column) -> Column:
    """The filing's producer and program are those of PRODUCER and PROGRAMS."""
    n, v = trim_space(F.coalesce(name, F.lit(""))), trim_space(F.coalesce(version, F.lit("")))
    return (F.lower(n) == PRODUCER.lower()) & (v.startswith(PROGRAMS[0]) | v.startswith(PROGRAMS[1]))
