"""Queries of the scalar functions: text made from the tables, normalised, against the value that
the table itself gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.functions import facts as V
from filingspark.functions import soft
from filingspark.functions.dates import DEVANAGARI, FORMATS, FULL_WIDTH, iso_date, parts_of, transform_date
from filingspark.functions.numbers import normalise_numeric
from filingspark.functions.text import collapse_spaces, dimensions_json, fold_spaces, format_local, qname_local
from filingspark.plans.facts import spread


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))


_MONEY = "CAST(o_totalprice AS DECIMAL(20,2))"
_TRIMMED = "rtrim(rtrim(CAST({} AS VARCHAR), '0'), '.')"


def normalise_numeric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed money with thousands separators, spaces, brackets and signs to its plain value."""
    shown = F.format_number("o_totalprice", 2)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" ("), shown, F.lit(") "))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-"), shown)).otherwise(shown)
    sign = F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("")
    return _orders(spark, sf_dir).select("o_orderkey", normalise_numeric(text, F.lit(""), sign, F.lit("ixt:numcommadot")).alias("value"))


def numeric_scale_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scale from -4 to 6 on displayed money."""
    scale = (F.col("o_orderkey") % 11 - 4).cast("string")
    return _orders(spark, sf_dir).select("o_orderkey", normalise_numeric(F.format_number("o_totalprice", 2), scale, F.lit(""), F.lit("")).alias("value"))


def ixt_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separator transforms on the same amounts."""
    shown = F.format_number("o_totalprice", 2)
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.translate(shown, ",.", ".,")).when(kind == 1, F.translate(shown, ",", " ")).when(kind == 2, F.translate(shown, ",.", " ,")).otherwise(shown)
    fmt = F.when(kind == 0, "ixt:numdotcomma").when(kind == 1, "ixt2:numspacedot").when(kind == 2, "numspacecomma").otherwise("ixt:numdotdecimal")
    return _orders(spark, sf_dir).select("o_orderkey", normalise_numeric(text, F.lit("0"), F.lit(""), fmt).alias("value"))


def human_prefix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("employees: "), "o_custkey")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("2017 - "), "o_custkey")).otherwise(F.concat(F.lit("ref: x"), "o_custkey"))
    return _orders(spark, sf_dir).select("o_orderkey", normalise_numeric(text, F.lit(""), F.lit(""), F.lit("")).alias("value"))


def whitespace_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" \t\n "), "o_orderpriority", F.lit("  "), "o_orderstatus", F.lit("\n"))
    return _orders(spark, sf_dir).select("o_orderkey", collapse_spaces(text).alias("collapsed"), F.length(fold_spaces(text)).cast("bigint").alias("folded_length"), F.regexp_count(fold_spaces(text), F.lit(" ")).cast("bigint").alias("folded_spaces"))


def qname_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    q = F.when(k == 0, F.concat(F.lit("core:"), "o_orderstatus")).when(k == 1, F.concat(F.lit("{urn:a:b}"), "o_orderstatus")).when(k == 2, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).otherwise(F.concat("o_orderstatus", F.lit(":")))
    return _orders(spark, sf_dir).select("o_orderkey", qname_local(q).alias("local"), format_local(F.concat(F.lit(" IXT4:X:"), F.upper("o_orderpriority"), F.lit(" "))).alias("format"))


def boolean_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.when(F.col("o_orderstatus") == "F", "ixt:booleantrue").when(F.col("o_orderstatus") == "O", "ixt:booleanfalse").when(F.col("o_orderkey") % 2 == 0, "ixt:nocontent").otherwise("")
    return _orders(spark, sf_dir).select("o_orderkey", V.normalise_text(F.col("o_orderpriority"), fmt)["value"].alias("value"))


_DATES = {
    # name: (Spark pattern, DuckDB pattern, transform)
    "longuk": ("d MMMM yyyy", "%-d %B %Y", "datelonguk"),
    "shortuk": ("d MMM yy", "%-d %b %y", "dateshortuk"),
    "longus": ("MMMM d, yyyy", "%B %-d, %Y", "datelongus"),
    "slasheu": ("d/M/yyyy", "%-d/%-m/%Y", "dateslasheu"),
    "slashus": ("M/d/yyyy", "%-m/%-d/%Y", "dateslashus"),
    "doteu": ("dd.MM.yyyy", "%d.%m.%Y", "datedoteu"),
    "dmy": ("dd MM yyyy", "%d %m %Y", "datedaymonthyear"),
    "dmyen": ("d 'day of' MMMM, yyyy", "%-d day of %B, %Y", "datedaymonthyearen"),
    "mdyen": ("MMM d yyyy", "%b %-d %Y", "date-monthname-day-year-en"),
    "ymd": ("yyyy-MM-dd", "%Y-%m-%d", "date-year-month-day"),
}


def date_transform_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    shown = F.create_map(*(x for n, (p, _, _) in _DATES.items() for x in (F.lit(n), F.date_format(day, p))))
    rows = _orders(spark, sf_dir).select("o_orderkey", F.explode(shown).alias("form", "text"))
    fmt = F.create_map(*(F.lit(x) for n, (_, _, t) in _DATES.items() for x in (n, t)))
    return rows.select("o_orderkey", "form", transform_date(F.element_at(fmt, F.col("form")), F.col("text"))["value"].alias("value"))


# How the date of a day is shown for each pattern of the registry's transforms.
_SHOWN = {
    "long day first": "d MMMM yyyy", "short day first": "d MMM yyyy", "long month first": "MMMM d, yyyy", "short month first": "MMM d, yyyy", "slashes": "dd/MM/yyyy", "dots": "dd.MM.yyyy",
    "digits3": "d - M - yyyy", "digits3 year first": "yyyy-M-d", "name day first": "d. MMMM yyyy", "name month first": "MMM d yyyy", "french": "d 'F' yyyy", "digits2": "d.M", "digits2 suffix": "M-d'th'", "slash2": "d/M",
    "name day month": "d. MMM", "name month day": "MMMM d'th'", "long day month": "d MMMM", "short day month": "d  MMM", "long month day": "MMMM d", "short month day": "MMM d'st'", "month year": "M/yyyy", "year month": "yyyy-M",
    "name month year": "MMMM-yyyy", "name year month": "yyyy MMM", "long month year": "MMMM  yyyy", "short month year": "MMM yyyy", "long year month": "yyyy MMMM", "short year month": "yyyy MMM",
}
_MONTHS_FR = ["janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc"]


def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date transform of the registry on every order's day; digits of other scripts on even
    orders where the transform folds them. A text is made and transformed once for each day on which
    there are orders, of which there are as many as the calendar has, and joined to the orders."""
    orders = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    day, even = F.col("day"), F.col("even")
    digits = lambda c, first: F.translate(c, "0123456789", "".join(chr(first + i) for i in range(10)))
    shown = []
    for (pattern, order), names in FORMATS.items():
        form = _SHOWN[pattern]
        if order == "mdy" and pattern in ("slashes", "dots", "digits3"):
            form = form.replace("d", "#").replace("M", "d").replace("#", "M")
        if order == "md" and pattern == "slash2":
            form = "M/d"
        text = F.date_format(day, form)
        if pattern == "french":
            text = F.replace(text, F.lit("F"), F.element_at(F.array(*map(F.lit, _MONTHS_FR)), F.month(day)))
        for name in names:
            folded = digits(text, 0x0966) if name in DEVANAGARI else digits(text, 0xFF10) if name in FULL_WIDTH else text
            shown.append(F.struct(F.lit(name).alias("form"), parts_of(name, F.when(even, folded).otherwise(text)).alias("parts")))
    # The transforms run on rows of one text each, dealt over all cores.
    texts = orders.select("day", "even").distinct().repartition(spark.sparkContext.defaultParallelism, "day", "even").select("day", "even", F.explode(F.array(*shown)).alias("x"))
    values = texts.select("day", "even", "x.form", iso_date(F.col("x.parts")).alias("value"))
    of_day = values.groupBy("day", "even").agg(F.collect_list(F.struct("form", "value", F.col("value").isNull().alias("failed"))).alias("x"))
    on = orders["day"].eqNullSafe(of_day["day"]) & orders["even"].eqNullSafe(of_day["even"])
    return orders.join(of_day, on).select("o_orderkey", F.inline("x"))


def date_transform_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    of = lambda fmt, pattern: transform_date(F.lit(fmt), F.date_format(day, pattern))["value"]
    return _orders(spark, sf_dir).select("o_orderkey", of("datedaymonth", "d/M").alias("day_month"), of("datemonthdayen", "MMMM d").alias("month_day"), of("datemonthyearen", "MMM yyyy").alias("month_year"), of("date-year-month", "yyyy.MM").alias("year_month"))


def date_transform_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days past a month's end fail; so does text that is no date, and an unknown date transform."""
    text = F.concat((F.col("o_orderkey") % 33).cast("string"), F.lit("/"), (F.col("o_custkey") % 14).cast("string"), F.lit("/2023"))
    fmt = F.when(F.col("o_orderkey") % 10 == 9, "datenosuch").otherwise("dateslasheu")
    got = transform_date(fmt, text)
    return _orders(spark, sf_dir).select("o_orderkey", got["value"].alias("value"), got["failed"].alias("failed"))


def year_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("1.2."), F.substr(F.lit("2024"), F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int")))
    got = transform_date(F.lit("datedoteu"), text)
    return _orders(spark, sf_dir).select("o_orderkey", got["value"].alias("value"), got["failed"].alias("failed"))


def headcount_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    concept = F.when(k % 3 == 0, "AverageNumberEmployeesDuringPeriod").when(k % 3 == 1, "ProductionAverageNumberEmployees").otherwise("Creditors")
    value = F.when(k % 5 == 0, F.concat((F.col("o_custkey") % 90).cast("string"), F.lit(".00"))).otherwise((F.col("o_custkey") % 90).cast("string"))
    got = V.correct_headcount(concept, F.when(k % 2 == 0, "-2").otherwise("0"), F.when(k % 7 == 0, "iso4217:GBP").otherwise("xbrli:pure"), value, F.lit(""), F.when(k % 4 < 2, "-").otherwise(""), F.col("o_orderstatus") == "F")
    return _orders(spark, sf_dir).select("o_orderkey", got["scale"].alias("scale"), got["sign"].alias("sign"), got["corrected"].alias("corrected"))


def dimensions_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.when(F.col("o_orderkey") % 3 > 0, F.create_map(F.lit("Z"), F.concat(F.lit("a&b<"), "o_orderstatus", F.lit(">")), F.lit("A"), F.col("o_orderpriority"))).otherwise(F.create_map().cast("map<string,string>"))
    return _orders(spark, sf_dir).select("o_orderkey", dimensions_json(dims).alias("dimensions"))


def soft_equal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    amount = F.col("o_totalprice").cast("decimal(20,2)")
    a = F.when(k % 5 == 0, F.format_number("o_totalprice", 2)).when(k % 5 == 1, day.cast("string")).when(k % 5 == 2, F.lit("1")).when(k % 5 == 3, F.lit(" ")).otherwise(F.col("o_orderpriority"))
    b = F.when(k % 5 == 0, F.concat(amount.cast("string"), F.lit("0"))).when(k % 5 == 1, F.date_format(day, "dd/MM/yyyy")).when(k % 5 == 2, F.lit("TRUE")).when(k % 5 == 3, F.lit(None)).otherwise(F.concat(F.lit("\""), "o_orderpriority", F.lit("\"")))
    return _orders(spark, sf_dir).select("o_orderkey", soft.soft_equal(a, b).alias("narrow"), soft.soft_equal(a, b, wide=True).alias("wide"), soft.soft_value(b).alias("soft_b"))


def typed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 8 == 0, "12.5").when(k % 8 == 1, "1e3").when(k % 8 == 2, "1_000").when(k % 8 == 3, "1d").when(k % 8 == 4, "2025-12").when(k % 8 == 5, "yes").when(k % 8 == 6, "2025-01-05").otherwise(F.col("o_custkey").cast("string"))
    return _orders(spark, sf_dir).select("o_orderkey", soft.to_integer(text).alias("as_int"), soft.to_decimal(text, 20, 2).alias("as_decimal"), soft.to_boolean(text).alias("as_boolean"), soft.to_date(text).alias("as_date"), soft.to_double(text).alias("as_double"))


QUERIES = {
    "normalise_numeric": normalise_numeric_query, "numeric_scale_sign": numeric_scale_sign, "ixt_separators": ixt_separators, "human_prefix_strip": human_prefix_strip,
    "whitespace_functions": whitespace_functions, "qname_functions": qname_functions, "boolean_transform": boolean_transform, "date_transform_full": date_transform_full, "date_formats": date_formats,
    "date_transform_partial": date_transform_partial, "date_transform_rejects": date_transform_rejects, "year_expansion": year_expansion,
    "headcount_corrections": headcount_corrections, "dimensions_json": dimensions_json_query, "soft_equal_pairs": soft_equal_pairs, "typed_casts": typed_casts,
}

_K = "o_orderkey"
ORACLE_SQL = {
    "normalise_numeric": f"""SELECT {_K}, CASE WHEN {_K} % 3 = 0 OR ({_K} % 3 = 1) <> ({_K} % 2 = 0) THEN '-' ELSE '' END || {_TRIMMED.format(_MONEY)} AS value FROM orders""",
    "numeric_scale_sign": f"SELECT {_K}, {_TRIMMED.format(f'CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(power(10, {_K} % 11) AS DECIMAL(12,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(38,6))')} AS value FROM orders",
    "ixt_separators": f"SELECT {_K}, {_TRIMMED.format(_MONEY)} AS value FROM orders",
    "human_prefix_strip": f"SELECT {_K}, CASE WHEN {_K} % 3 < 2 THEN o_custkey::VARCHAR ELSE 'ref:x' || o_custkey END AS value FROM orders",
    "whitespace_functions": f"SELECT {_K}, o_orderpriority || ' ' || o_orderstatus AS collapsed, (length(o_orderpriority) + length(o_orderstatus) + 7)::BIGINT AS folded_length, (4 + length(o_orderpriority) - length(replace(o_orderpriority, ' ', '')))::BIGINT AS folded_spaces FROM orders",
    "qname_functions": f"SELECT {_K}, CASE WHEN {_K} % 4 = 3 THEN o_orderstatus || ':' ELSE o_orderstatus END AS local, lower(o_orderpriority) AS format FROM orders",
    "boolean_transform": f"SELECT {_K}, CASE WHEN o_orderstatus = 'F' THEN 'true' WHEN o_orderstatus = 'O' THEN 'false' WHEN {_K} % 2 = 0 THEN '' ELSE o_orderpriority END AS value FROM orders",
    "date_transform_full": f"SELECT {_K}, form, CASE WHEN form = 'shortuk' THEN '20' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders, (SELECT unnest({list(_DATES)}) AS form)",
    "date_formats": f"""SELECT {_K}, form, CASE WHEN form IN ({", ".join(f"'{n}'" for (_, o), x in FORMATS.items() if len(o) == 3 for n in x)}) THEN strftime(o_orderdate, '%Y-%m-%d')
 WHEN form IN ({", ".join(f"'{n}'" for (_, o), x in FORMATS.items() if "d" not in o for n in x)}) THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '--%m-%d') END AS value, FALSE AS failed FROM orders, (SELECT unnest({sorted(n for x in FORMATS.values() for n in x)}) AS form)""",
    "date_transform_partial": f"SELECT {_K}, strftime(o_orderdate, '--%m-%d') AS day_month, strftime(o_orderdate, '--%m-%d') AS month_day, strftime(o_orderdate, '%Y-%m') AS month_year, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders",
    "date_transform_rejects": f"""SELECT {_K}, CASE WHEN {_K} % 10 < 9 THEN strftime(d, '%Y-%m-%d') END AS value, {_K} % 10 = 9 OR d IS NULL AS failed FROM
 (SELECT {_K}, TRY_CAST('2023-' || lpad((o_custkey % 14)::VARCHAR, 2, '0') || '-' || lpad(({_K} % 33)::VARCHAR, 2, '0') AS DATE) AS d FROM orders)""",
    "year_expansion": f"SELECT {_K}, CASE {_K} % 4 WHEN 0 THEN '2002-02-01' WHEN 1 THEN '2020-02-01' WHEN 3 THEN '2024-02-01' END AS value, {_K} % 4 = 2 AS failed FROM orders",
    "headcount_corrections": f"""SELECT {_K}, CASE WHEN fix THEN '0' WHEN {_K} % 2 = 0 THEN '-2' ELSE '0' END AS scale, CASE WHEN {_K} % 4 < 2 AND NOT dropped THEN '-' ELSE '' END AS sign, fix OR dropped AS corrected FROM
 (SELECT *, o_orderstatus = 'F' AND {_K} % 3 < 2 AND {_K} % 2 = 0 AND {_K} % 7 <> 0 AND {_K} % 5 <> 0 AND ({_K} % 4 >= 2 OR dropped) AS fix FROM
 (SELECT {_K}, o_orderstatus, {_K} % 4 < 2 AND {_K} % 3 < 2 AND o_custkey % 90 > 0 AS dropped FROM orders))""",
    "dimensions_json": f"""SELECT {_K}, CASE WHEN {_K} % 3 > 0 THEN '{{"A":"' || o_orderpriority || '","Z":"a' || chr(92) || 'u0026b' || chr(92) || 'u003c' || o_orderstatus || chr(92) || 'u003e"}}' ELSE '' END AS dimensions FROM orders""",
    "soft_equal_pairs": f"""SELECT {_K}, {_K} % 5 <> 2 AS narrow, TRUE AS wide, CASE {_K} % 5 WHEN 0 THEN {_MONEY}::VARCHAR || '0' WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN 'TRUE' WHEN 3 THEN '' ELSE o_orderpriority END AS soft_b FROM orders""",
    "typed_casts": f"""SELECT {_K}, TRY_CAST(t AS INTEGER) AS as_int, TRY_CAST(t AS DECIMAL(20,2)) AS as_decimal, TRY_CAST(t AS BOOLEAN) AS as_boolean, TRY_CAST(t AS DATE) AS as_date, TRY_CAST(t AS DOUBLE) AS as_double FROM
 (SELECT {_K}, CASE {_K} % 8 WHEN 0 THEN '12.5' WHEN 1 THEN '1e3' WHEN 2 THEN '1_000' WHEN 3 THEN '1d' WHEN 4 THEN '2025-12' WHEN 5 THEN 'yes' WHEN 6 THEN '2025-01-05' ELSE o_custkey::VARCHAR END AS t FROM orders)""",
}
