"""Soft comparison of values from two extracts, and casts that agree with the wide table's rules."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from filingspark.functions.text import let

_NUMBER = r"\A[ ]*[+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ ]*\z"


def to_double(c: Column) -> Column:
    """Double of decimal text; null for anything else (type suffixes such as 1d are not numbers)."""
    special = F.lower(F.trim(c)).isin("nan", "inf", "infinity", "-inf", "-infinity", "+inf", "+infinity")
    return F.when(c.rlike(_NUMBER), F.translate(c, "_", "").try_cast("double")).when(special, c.try_cast("double"))


def to_decimal(c: Column, precision: int, scale: int) -> Column:
    """Decimal rounded half away from zero, null where the text is no number or does not fit."""
    return F.when(c.rlike(_NUMBER), F.translate(c, "_", "").try_cast(f"decimal({precision},{scale})"))


def to_integer(c: Column) -> Column:
    return F.round(to_decimal(c, 38, 10), 0).try_cast("int")


def to_boolean(c: Column) -> Column:
    v = F.lower(c)
    return F.when(v.isin("true", "t", "yes", "y", "1"), True).when(v.isin("false", "f", "no", "n", "0"), False)


def to_date(c: Column) -> Column:
    """Date of ISO text with all three parts; a partial date is null."""
    return F.when(F.trim(c).rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[ T].*)?\z"), F.trim(c).try_cast("date"))


def soft_value(c: Column, reported: bool = False) -> Column:
    """Trimmed, white space collapsed, commas and quotes out; null is empty. With reported, the
    marker `(reported)` is empty too."""
    v = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    if reported:
        v = F.when(v == "(reported)", F.lit("")).otherwise(v)
    return F.translate(F.regexp_replace(v, r"[ \t\n\f\r]+", " "), ',"', "")


# The date displays that are understood, with the shape of each.
DATE_SHAPES = (
    (r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z", "y-M-d"),
    (r"\A[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}\z", "d.M.yy"),
    (r"\A[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{3,4}\z", "d.M.y"),
    (r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{1,2}\z", "d/M/yy"),
    (r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{3,4}\z", "d/M/y"),
    (r"\A[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\z", "d-M-y"),
    (r"\A[0-9]{1,2} [A-Za-z]{3} [0-9]{4}\z", "d MMM y"),
    (r"\A[0-9]{1,2} [A-Za-z]{3,} [0-9]{4}\z", "d MMMM y"),
)


def soft_date(c: Column, reported: bool = False) -> Column:
    """Date of the common displays of a date; two-digit years from 69 are in the 1900s."""

    def of(v: Column) -> Column:
        found = []
        for shape, pattern in DATE_SHAPES:
            text = F.initcap(v) if "MMM" in pattern else v
            if pattern.endswith("yy"):
                mark = pattern[1]
                year = F.substring_index(v, mark, -1).try_cast("int")
                text = F.concat(F.substring_index(v, mark, 2), F.lit(mark), (year + F.when(year >= 69, 1900).otherwise(2000)).cast("string"))
                pattern = pattern[:-1]
            found.append(F.when(v.rlike(shape), F.try_to_date(text, pattern)))
        return F.coalesce(*found)

    return let(soft_value(c, reported), of)


def soft_bool(c: Column) -> Column:
    v = F.lower(soft_value(c))
    return F.when(v == "1", "true").when(v == "0", "false").otherwise(v)


def empty_value(c: Column) -> Column:
    return soft_value(c) == ""


def soft_equal(a: Column, b: Column, *, reported: bool = False, wide: bool = False) -> Column:
    """Equal as text, as numbers or as dates; with wide also as booleans and both empty."""
    def of(x: Column, y: Column) -> Column:
        same = (x == y) | F.coalesce(to_double(x) == to_double(y), F.lit(False)) | F.coalesce(soft_date(x) == soft_date(y), F.lit(False))
        if wide:
            truth = let(soft_bool(x), lambda t: t.isin("true", "false") & (t == soft_bool(y)))
            same = same | truth
        return same

    # equal text needs no more; the rest is looked at only where it differs
    return F.when(a.eqNullSafe(b), True).otherwise(let(soft_value(a, reported), lambda x: let(soft_value(b, reported), lambda y: of(x, y))))


def register(spark: SparkSession) -> None:
    """The soft functions as SQL functions of the session."""
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION soft_value(v STRING) RETURNS STRING RETURN translate(regexp_replace(trim(coalesce(v, '')), '[ \\t\\n\\f\\r]+', ' '), ',"', '')""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION soft_bool(v STRING) RETURNS STRING RETURN CASE lower(soft_value(v)) WHEN '1' THEN 'true' WHEN '0' THEN 'false' ELSE lower(soft_value(v)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION empty_val(v STRING) RETURNS BOOLEAN RETURN soft_value(v) = ''")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_plain_dim(d STRING) RETURNS BOOLEAN RETURN d IS NULL OR trim(d) IN ('', '{}')")
