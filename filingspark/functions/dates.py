"""Dates written in a registry transform's form to ISO text, as column expressions.

A transform is a pattern and the order of its parts. The pattern rewrites a matching text to
year/month/day, parts left out staying empty; one tail common to all transforms then expands the
year, looks the month up, and checks the calendar. So a row costs the patterns of one branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingspark.functions.text import let

# Month names and abbreviations.
MONTHS = "January February March April May June July August September October November December".split()
SHORT_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
FRENCH_MONTHS = {"janv": 1, "févr": 2, "fevr": 2, "mars": 3, "avr": 4, "mai": 5, "juin": 6, "juil": 7, "août": 8, "aout": 8, "sept": 9, "oct": 10, "nov": 11, "déc": 12, "dec": 12}

_ORDERS = {"dmy": "$3/$2/$1", "mdy": "$3/$1/$2", "ymd": "$1/$2/$3", "dm": "/$2/$1", "md": "/$1/$2", "my": "$2/$1/", "ym": "$1/$2/"}


def _group(names: list[str]) -> str:
    return "(" + "|".join(names) + ")"


def _patterns() -> dict[str, str]:
    """Java patterns by short name. D, M, Y are day, month and year; a trailing digit form is any
    non-digits between the parts."""
    two, year, year2, gap = "([0-9]{1,2})", "([0-9]{4}|[0-9]{1,2})", "([0-9]{4}|[0-9]{2})", "[^0-9]+"
    long, short = _group(MONTHS), _group(SHORT_MONTHS)
    either = _group([x for names in (MONTHS, SHORT_MONTHS) for n in names for x in (n, n.upper())])
    french = _group([x for n in ("janv", "févr", "fevr", "juin", "juil", "août", "aout", "sept", "mars", "déc", "dec", "avr", "mai", "oct", "nov") for x in (n, n.upper(), n.capitalize())])
    return {
        "digits3": f"{two}{gap}{two}{gap}{year}",
        "digits3 year first": f"{year}{gap}{two}{gap}{two}[^0-9]*",
        "slashes": "([0-9]+)/([0-9]+)/([0-9]+)",
        "dots": r"([0-9]+)\.([0-9]+)\.([0-9]+)",
        "digits2": f"{two}{gap}{two}",
        "digits2 suffix": f"{two}{gap}{two}[A-Za-z]*",
        "slash2": f"{two}/{two}",
        "month year": f"{two}{gap}{year}",
        "year month": f"{year}{gap}{two}[^0-9]*",
        "long day first": f"{two} {long} {year2}",
        "short day first": f"{two} {short} {year2}",
        "long month first": f"{long} {two}, {year2}",
        "short month first": f"{short} {two}, {year2}",
        "name day first": f"{two}{gap}{either}{gap}{year}",
        "name month first": f"{either}{gap}([0-9]+){gap}{year}",
        "name day month": f"{two}{gap}{either}",
        "name month day": f"{either}{gap}{two}[A-Za-z]{{0,2}}",
        "name month year": f"{either}{gap}{year}",
        "name year month": f"{year}{gap}{either}",
        "long day month": f"{two} {long}",
        "short day month": rf"{two}[ \t\n\f\r]+{short}",
        "long month day": f"{long} {two}",
        "short month day": rf"{short}[ \t\n\f\r]+{two}[A-Za-z]{{0,2}}",
        "long month year": rf"{long}[ \t\n\f\r]+{year2}",
        "short month year": rf"{short}[ \t\n\f\r]+{year2}",
        "long year month": rf"{year2}[ \t\n\f\r]+{long}",
        "short year month": rf"{year2}[ \t\n\f\r]+{short}",
        "french": f"{two}{gap}{french}{gap}{year}",
    }


# The registry's date transforms by pattern and order of parts.
FORMATS = {
    ("long day first", "dmy"): ["datelonguk"],
    ("short day first", "dmy"): ["dateshortuk"],
    ("long month first", "mdy"): ["datelongus"],
    ("short month first", "mdy"): ["dateshortus"],
    ("slashes", "dmy"): ["dateslasheu"],
    ("slashes", "mdy"): ["dateslashus"],
    ("dots", "dmy"): ["datedoteu"],
    ("dots", "mdy"): ["datedotus"],
    ("digits3", "dmy"): ["datedaymonthyear", "date-day-month-year"],
    ("digits3", "mdy"): ["datemonthdayyear", "date-month-day-year"],
    ("digits3 year first", "ymd"): ["dateyearmonthday", "date-year-month-day"],
    ("name day first", "dmy"): ["datedaymonthyearen", "date-day-monthname-year-en"],
    ("name month first", "mdy"): ["datemonthdayyearen", "date-monthname-day-year-en"],
    ("french", "dmy"): ["date-day-monthname-year-fr"],
    ("digits2", "dm"): ["datedaymonth", "date-day-month"],
    ("digits2 suffix", "md"): ["datemonthday", "date-month-day"],
    ("slash2", "dm"): ["dateslashdaymontheu"],
    ("slash2", "md"): ["dateslashmonthdayus"],
    ("name day month", "dm"): ["datedaymonthen", "date-day-monthname-en"],
    ("name month day", "md"): ["datemonthdayen", "date-monthname-day-en"],
    ("long day month", "dm"): ["datelongdaymonthuk"],
    ("short day month", "dm"): ["dateshortdaymonthuk"],
    ("long month day", "md"): ["datelongmonthdayus"],
    ("short month day", "md"): ["dateshortmonthdayus"],
    ("month year", "my"): ["datemonthyear", "date-month-year"],
    ("year month", "ym"): ["date-year-month"],
    ("name month year", "my"): ["datemonthyearen", "date-monthname-year-en"],
    ("name year month", "ym"): ["dateyearmonthen", "date-year-monthname-en"],
    ("long month year", "my"): ["datelongmonthyear"],
    ("short month year", "my"): ["dateshortmonthyear"],
    ("long year month", "ym"): ["datelongyearmonth"],
    ("short year month", "ym"): ["dateshortyearmonth"],
}
DEVANAGARI = ("date-day-month-year", "date-month-year")
FULL_WIDTH = ("dateyearmonthday", "date-year-month-day", "date-year-month")


def _digits(c: Column, first: int) -> Column:
    return F.translate(c, "".join(chr(first + i) for i in range(10)), "0123456789")


_MARK = "\x01"  # stands before what a pattern rewrote


def _rewritten(text: Column, name: str, order: str) -> Column:
    """The parts of a text that matches the pattern, else null: one pass of the pattern. A text that
    itself begins with the mark matches no pattern."""
    rewritten = F.regexp_replace(text, rf"\A{_patterns()[name]}\z", _MARK + _ORDERS[order])
    return let(rewritten, lambda r: F.when(r.startswith(_MARK) & ~text.startswith(_MARK), F.substr(r, F.lit(2))))


def date_parts(fmt: Column, text: Column) -> Column:
    """`year/month/day` as written, parts that the transform lacks empty; null if the text does not
    match or the transform is none of FORMATS. fmt: local name in lower case."""
    def rewrite(folded: Column) -> Column:
        out = None
        for (name, order), formats in FORMATS.items():
            branch = _rewritten(folded, name, order)
            out = F.when(fmt.isin(*formats), branch) if out is None else out.when(fmt.isin(*formats), branch)
        return out

    folded = F.when(fmt.isin(*DEVANAGARI), _digits(text, 0x0966)).when(fmt.isin(*FULL_WIDTH), _digits(text, 0xFF10)).otherwise(text)
    return let(folded, rewrite)


def parts_of(fmt: str, text: Column) -> Column:
    """date_parts for a transform known beforehand: one pattern alone."""
    name, order = next(key for key, formats in FORMATS.items() if fmt in formats)
    folded = _digits(text, 0x0966) if fmt in DEVANAGARI else _digits(text, 0xFF10) if fmt in FULL_WIDTH else text
    return _rewritten(folded, name, order)


def expand_year(y: Column) -> Column:
    """One digit is 200Y, two 20YY, four as written; null otherwise."""
    n = y.try_cast("int")
    return F.when(F.length(y).isin(1, 2), n + 2000).when(F.length(y) == 4, n)


def month_number(m: Column) -> Column:
    names = {n.lower(): i for names in (MONTHS, SHORT_MONTHS) for i, n in enumerate(names, 1)} | FRENCH_MONTHS
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.when(m.rlike(r"\A[0-9]+\z"), m.try_cast("int")).otherwise(F.try_element_at(table, F.lower(m)))


def iso_date(parts: Column) -> Column:
    """ISO text of `year/month/day` parts; null if it is no calendar date (29 February stands where
    there is no year)."""
    four, two = (lambda c: F.lpad(c.cast("string"), 4, "0")), (lambda c: F.lpad(c.cast("string"), 2, "0"))

    def text(year: Column, day: Column, y: Column, m: Column, d: Column) -> Column:
        leap = (year == "") | ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))
        length = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        good = m.between(1, 12) & ((year == "") | y.between(1, 9999)) & ((day == "") | ((d >= 1) & (d <= length)))
        written = F.when(year == "", F.concat(F.lit("--"), two(m), F.lit("-"), two(d))).when(day == "", F.concat(four(y), F.lit("-"), two(m))).otherwise(F.concat(four(y), F.lit("-"), two(m), F.lit("-"), two(d)))
        return F.when(good, written)

    def of(at: Column) -> Column:
        year, month, day = F.get(at, F.lit(0)), F.get(at, F.lit(1)), F.get(at, F.lit(2))
        return let(expand_year(year), lambda y: let(month_number(month), lambda m: let(day.try_cast("int"), lambda d: text(year, day, y, m, d))))

    return let(F.split(parts, "/"), of)


def is_date_format(fmt: Column) -> Column:
    return fmt.isin(*[x for names in FORMATS.values() for x in names])


def transform_date(fmt: Column, text: Column) -> Column:
    """struct(value, failed): the ISO text under a date transform, the text itself under any other
    transform; failed where the text does not match, is no date, or the date transform is unknown."""
    result = lambda value, failed: F.struct(value.alias("value"), failed.alias("failed"))
    dated = let(iso_date(date_parts(fmt, text)), lambda iso: result(iso, iso.isNull()))
    return F.when(is_date_format(fmt), dated).when(fmt.startswith("date"), result(F.lit(None).cast("string"), F.lit(True))).otherwise(result(text, F.lit(False)))
