from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingspark.functions import facts, soft
from filingspark.functions.dates import FORMATS, transform_date
from filingspark.functions.numbers import exact_number, normalise_numeric
from filingspark.functions.text import collapse_spaces, company_number, dimensions_json, fold_spaces, format_local, qname_local

NUMBERS = [
    ("15,605", "", "", "", "15605"), ("1.5", "3", "", "", "1500"), ("100", "", "-", "", "-100"), ("(500)", "", "", "", "-500"),
    ("1.234,56", "", "", "ixt:numdotcomma", "1234.56"), ("3", "-2", "", "", "0.03"), ("2017 - 2", "", "", "", "2"), ("-", "", "", "", "0"), ("–", "3", "", "", "0"),
    ("", "", "", "", ""), ("x", "", "", "ixt2:zerodash", "0"), ("(500)", "", "-", "", "-500"), ("-5", "", "-", "", "5"), ("n/a", "", "-", "", "-n/a"),
    ("0.00000000005", "", "", "", "0.0000000001"), ("0.00000000004", "", "", "", "0"), ("1e3", "", "", "", "1000"), ("1 234", "", "", "numspacedot", "1234"),
    ("999999999999999999999999999999", "30", "", "", "999999999999999999999999999999" + "0" * 30), ("0.99999999999", "", "", "", "1"), ("employees: 12", "", "", "", "12"),
    ("+7.50", "", "", "", "7.5"), ("-0", "", "", "", "0"), ("007", "", "", "", "7"), ("100.00", "-2", "", "", "1"), ("1.", "", "", "", "1"), (".5", "", "", "", "0.5"), ("5", "x", "", "", "5"),
]


def test_numbers(spark):
    df = spark.createDataFrame([r[:4] for r in NUMBERS], "v string, s string, g string, f string")
    got = [r[0] for r in df.select(normalise_numeric(F.col("v"), F.col("s"), F.col("g"), F.col("f"))).collect()]
    assert got == [r[4] for r in NUMBERS]


def plain(value: Fraction) -> str:
    unit = 10**10
    n = abs(value) * unit
    rounded = (2 * n.numerator + n.denominator) // (2 * n.denominator)
    text = f"{rounded // unit}.{rounded % unit:010d}".rstrip("0").rstrip(".")
    return f"-{text}" if value < 0 and rounded else text


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**18), st.integers(0, 15), st.integers(-12, 12), st.booleans()), min_size=20, max_size=60))
def test_numbers_agree_with_exact_arithmetic(spark, cases):
    rows = []
    for digits, places, scale, minus in cases:
        text = str(digits).rjust(places + 1, "0")
        shown = text[: len(text) - places] + ("." + text[-places:] if places else "")
        want = plain(Fraction(digits) / 10**places * Fraction(10) ** scale * (-1 if minus else 1))
        rows.append((shown, str(scale), "-" if minus else "", want))
    df = spark.createDataFrame(rows, "v string, s string, g string, want string")
    assert df.where(normalise_numeric(F.col("v"), F.col("s"), F.col("g"), F.lit("")) != F.col("want")).count() == 0


@pytest.mark.parametrize("value,scale,sign,want", [("3/4", "", "", "0.75"), ("0x1F", "", "", "31"), ("1,234", "", "", None), ("1/3", "2", "-", "-33.3333333333"), ("1/0", "", "", None)])
def test_exact_number(value, scale, sign, want):
    assert exact_number(value, scale, sign, "") == want


DATES = [
    ("datelonguk", "31 December 2024", "2024-12-31"), ("datelonguk", "31 Dec 2024", None), ("dateshortuk", "1 Mar 24", "2024-03-01"), ("datelongus", "March 1, 2024", "2024-03-01"), ("dateshortus", "Mar 1, 2024", "2024-03-01"),
    ("datedaymonthyearen", "30th day of January, 2023", "2023-01-30"), ("datemonthdayyearen", "MARCH 5th, 1969", "1969-03-05"), ("date-day-monthname-year-fr", "1 août 2020", "2020-08-01"), ("date-day-monthname-year-fr", "2 DÉC 21", "2021-12-02"),
    ("dateslasheu", "29/02/2023", None), ("dateslasheu", "29/02/2024", "2024-02-29"), ("dateslashus", "2/29/2024", "2024-02-29"), ("datedoteu", "1.2.3", "2003-02-01"), ("datedoteu", "1.2.345", None),
    ("datedaymonthyear", "01 02 2003", "2003-02-01"), ("dateyearmonthday", "２０２４年１月２日", "2024-01-02"), ("date-day-month-year", "०१.०२.२०२३", "2023-02-01"), ("datedaymonth", "29/2", "--02-29"), ("datedaymonth", "30/2", None),
    ("datemonthday", "2/3rd", "--02-03"), ("datemonthyearen", "May 2020", "2020-05"), ("date-year-month", "2020-13", None), ("dateyearmonthen", "2020 May", "2020-05"), ("datelongmonthdayus", "May 7", "--05-07"),
    ("dateshortyearmonth", "20 Jan", "2020-01"), ("dateslashdaymontheu", "7/8", "--08-07"), ("datenosuch", "x", None),
]


def test_dates(spark):
    assert sum(map(len, FORMATS.values())) == 44
    df = spark.createDataFrame([r[:2] for r in DATES], "f string, t string")
    got = [(r[0], r[1]) for r in df.select(transform_date(F.col("f"), F.col("t"))["value"], transform_date(F.col("f"), F.col("t"))["failed"]).collect()]
    assert got == [(w, w is None) for _, _, w in DATES]
    other = spark.range(1).select(transform_date(F.lit("numdash"), F.lit("a b"))["value"]).first()[0]
    assert other == "a b"


def test_text_functions(spark):
    row = spark.range(1).select(
        fold_spaces(F.lit("a\u00a0b\u2009c\u2028d")), collapse_spaces(F.lit(" \t a\u00a0\n\u2003 b ")), format_local(F.lit(" IXT:Num:DotDecimal ")), qname_local(F.lit("{urn:x}a:b")), qname_local(F.lit("p:q:r")),
        qname_local(F.lit("p:")), dimensions_json(F.create_map(F.lit("b"), F.lit("<&>"), F.lit("a"), F.lit("\u2028"))), dimensions_json(F.lit(None).cast("map<string,string>")),
    ).first()
    assert tuple(row) == ("a b c d", "a b", "dotdecimal", "a:b", "q:r", "p:", '{"a":"\\u2028","b":"\\u003c\\u0026\\u003e"}', "")


@pytest.mark.parametrize("name,want", [("Prod223_4320_00719324_20260405.html", "00719324"), ("x\\y/sc123456_aa_2024-01-01.xhtml", "SC123456"), ("Prod223_4320_0071932_20260405.html", None), ("readme.html", None), ("oc300293_aa_2026.xhtml", "OC300293")])
def test_company_number(spark, name, want):
    assert spark.range(1).select(company_number(F.lit(name))).first()[0] == want


def test_headcounts(spark):
    cases = [
        ("AverageNumberEmployeesDuringPeriod", "-2", "xbrli:pure", "12", "", "", True, ("0", "", True)),
        ("AverageNumberEmployeesDuringPeriod", "-2", "xbrli:pure", "12", "", "", False, ("-2", "", False)),
        ("AverageNumberEmployeesDuringPeriod", "-2", "xbrli:pure", "100.00", "", "", True, ("-2", "", False)),
        ("AverageNumberEmployeesDuringPeriod", "0", "pure", "7.00", "", "-", False, ("0", "", True)),
        ("AverageNumberEmployeesDuringPeriod", "0", "pure", "(4)", "", "-", False, ("0", "-", False)),
        ("AverageNumberEmployeesDuringPeriod", "0", "pure", "0", "", "-", False, ("0", "-", False)),
        ("ProductionAverageNumberEmployees", "-2", "xbrli:PURE", "1,234", "ixt:numcommadot", "-", True, ("0", "", True)),
        ("Creditors", "-2", "pure", "5", "", "-", True, ("-2", "-", False)),
        ("AverageNumberEmployeesDuringPeriod", "-2", "a/pure", "5", "", "", True, ("-2", "", False)),
    ]
    df = spark.createDataFrame([c[:7] for c in cases], "c string, s string, u string, v string, f string, g string, gate boolean")
    got = [tuple(r[0]) for r in df.select(facts.correct_headcount(*(F.col(x) for x in ("c", "s", "u", "v", "f", "g", "gate")))).collect()]
    assert got == [c[7] for c in cases]


def test_soft(spark):
    pairs = [("1,000", "1000.0", True, True), ("31/12/2024", "2024-12-31", True, True), ("5 Jan 2024", "5 January 2024", True, True), ("true", "1", False, True), ("", None, True, True), ("a", "b", False, False), ("01.02.70", "1970-02-01", True, True), ("01/02/68", "2068-02-01", True, True)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = [tuple(r) for r in df.select(soft.soft_equal(F.col("a"), F.col("b")), soft.soft_equal(F.col("a"), F.col("b"), wide=True)).collect()]
    assert got == [p[2:] for p in pairs]
    soft.register(spark)
    assert spark.sql("SELECT soft_value(' a,  \"b\" '), empty_val(' '), is_plain_dim('{}'), soft_bool('1')").first()[:] == ("a b", True, True, "true")
