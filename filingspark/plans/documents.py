"""Queries of the parser: small filings written from the orders, parsed, against what the orders
say the facts must be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.operators import extract as E
from filingspark.operators import taxonomy as X
from filingspark.operators.parser import parse_documents
from filingspark.plans.facts import spread

_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" '
    'xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:core="urn:core"><body>'
)
_TAIL = "</body></html>"


class _Sql(str):
    """SQL text that stands for a column where no session is at hand yet."""


def _lit(c) -> Column:
    return F.expr(c) if isinstance(c, _Sql) else F.lit(c) if isinstance(c, str) else c


def _text(*parts) -> Column:
    return F.concat(*(_lit(p) for p in parts))


_DAY = _Sql("cast(cast(o_orderdate as date) as string)")
_FILE = _Sql("concat('Prod100_1_', lpad(cast(o_orderkey as string), 8, '0'), '_20200101.html')")
_CONTEXT = ('<xbrli:context id="c1"><xbrli:period><xbrli:instant>', _DAY, "</xbrli:instant></xbrli:period></xbrli:context>")
_UNIT = ('<xbrli:unit id="u1"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit>',)


def members(spark: SparkSession, sf_dir: str, *body, ukfrs: bool = False) -> DataFrame:
    """One filing per order; body is text and columns."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return orders.select(_lit(_FILE).alias("source_file"), _text(*body).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"), F.lit(ukfrs).alias("only_ukfrs"))


def _facts(spark: SparkSession, sf_dir: str, *body, ukfrs: bool = False) -> DataFrame:
    return E.extract(members(spark, sf_dir, *body, ukfrs=ukfrs))


def parse_orders_ixbrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts after the facts, a scaled amount, a name with references, an undefined context."""
    money = F.format_number("o_totalprice", 2)
    body = (
        _HEAD, '<p>Total <ix:nonFraction name="core:NetAssets" contextRef="c1" unitRef="u1" decimals="2" scale="3" format="ixt:numcommadot">', money, "</ix:nonFraction></p>",
        '<p><ix:nonNumeric name="core:Name" contextRef="c1">A &amp; B&nbsp; ', F.col("o_custkey").cast("string"), "\n </ix:nonNumeric></p>",
        '<ix:nonNumeric name="core:Date" contextRef="gone" format="ixt:datelonguk">', F.date_format("o_orderdate", "d MMMM yyyy"), "</ix:nonNumeric>", *_CONTEXT, *_UNIT, _TAIL,
    )
    return _facts(spark, sf_dir, *body)


def context_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, explicit and typed dimensions, a later definition that wins."""
    body = (
        _HEAD, '<xbrli:context id="c1"><xbrli:period><xbrli:startDate>1900-01-01</xbrli:startDate></xbrli:period></xbrli:context>',
        '<xbrli:context id="c1"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="core:ZDim">core:M<!-- x -->', F.col("o_orderstatus"), "</xbrldi:explicitMember>",
        '<xbrldi:typedMember dimension="core:ADim"><core:v> ', F.col("o_custkey").cast("string"), " </core:v></xbrldi:typedMember></xbrli:segment></xbrli:entity>",
        "<xbrli:period><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>", _DAY, "</xbrli:endDate></xbrli:period></xbrli:context>",
        '<ix:nonNumeric name="core:Note" contextRef="c1">x</ix:nonNumeric>', _TAIL,
    )
    return _facts(spark, sf_dir, *body).select("source_file", "period_start", "period_end", "dimensions")


def unit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit with two measures, an empty one, an undefined one."""
    unit = F.when(F.col("o_orderkey") % 3 == 0, "u1").when(F.col("o_orderkey") % 3 == 1, "u2").otherwise("u3")
    body = (_HEAD, '<xbrli:unit id="u1"><xbrli:divide><xbrli:measure>iso4217:GBP</xbrli:measure><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:divide></xbrli:unit><xbrli:unit id="u2"></xbrli:unit>', '<ix:nonFraction name="core:A" unitRef="', unit, '">', F.col("o_custkey").cast("string"), "</ix:nonFraction>", _TAIL)
    return _facts(spark, sf_dir, *body).select("source_file", "unit", "value")


def continuation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = (
        _HEAD, '<ix:nonNumeric name="core:Note" continuedAt="k1"> one', F.col("o_orderstatus"), '</ix:nonNumeric><ix:continuation id="k2">three </ix:continuation>',
        '<ix:continuation id="k1" continuedAt="k2">two ', F.col("o_custkey").cast("string"), ' <ix:nonNumeric name="core:Inner">in</ix:nonNumeric></ix:continuation>', _TAIL,
    )
    return _facts(spark, sf_dir, *body).select("source_file", "concept", "value")


def nested_facts_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact in a fact, and text and a fact in an exclude."""
    body = (
        _HEAD, '<ix:nonNumeric name="core:Outer">a <ix:nonNumeric name="core:Inner">', F.col("o_orderpriority"), '</ix:nonNumeric> b<ix:exclude>no <ix:nonFraction name="core:Kept" scale="0">',
        F.col("o_custkey").cast("string"), "</ix:nonFraction></ix:exclude></ix:nonNumeric>", _TAIL,
    )
    return _facts(spark, sf_dir, *body).select("source_file", "concept", "value")


def classic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classic instance with a tuple around its items."""
    body = (
        '<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:g="urn:gaap">', *_CONTEXT, *_UNIT, '<g:Tuple><g:Cash contextRef="c1" unitRef="u1" decimals="0">',
        F.col("o_custkey").cast("string"), '</g:Cash></g:Tuple><g:Name contextRef="c1"> ', F.col("o_orderpriority"), " </g:Name></xbrli:xbrl>",
    )
    return _facts(spark, sf_dir, *body)


def target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("o_orderkey") % 3 == 0, ' target="UKFRS"').when(F.col("o_orderkey") % 3 == 1, ' target="IFRS"').otherwise("")
    body = (_HEAD, '<ix:nonNumeric name="core:A" target="UKFRS">k</ix:nonNumeric><ix:nonNumeric name="core:B"', target, ">v</ix:nonNumeric>", _TAIL)
    return _facts(spark, sf_dir, *body, ukfrs=True).select("source_file", "concept", "value")


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings that fail whole: a date that is none, an undeclared prefix, broken markup, no facts."""
    kind = F.col("o_orderkey") % 5
    fact = (
        F.when(kind == 0, '<ix:nonNumeric name="core:D" format="ixt:datedaymonthyearen">31 December</ix:nonNumeric>')
        .when(kind == 1, '<ix:nonNumeric name="nope:D">x</ix:nonNumeric>')
        .when(kind == 2, "<p>open")
        .when(kind == 3, "<br>")
        .otherwise("")
    )
    good = F.when(kind == 3, "").otherwise('<ix:nonNumeric name="core:A">fine</ix:nonNumeric>')
    end = F.when(kind == 2, "").otherwise("</body></html>")
    close = F.when(kind == 3, "</br>").otherwise("")
    status = E.status_of(E.bind(parse_documents(members(spark, sf_dir, _HEAD, good, fact, close, end))))
    return status.select("source_file", "ok", "facts", F.substring_index("error", " in Prod", 1).alias("error"))


def headcount_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headcounts as the known producer tags them, and as others do."""
    name = F.when(F.col("o_orderkey") % 2 == 0, "CCH SOFTWARE").otherwise("Other")
    body = (
        _HEAD, '<ix:nonNumeric name="core:NameProductionSoftware">', name, '</ix:nonNumeric><ix:nonNumeric name="core:VersionProductionSoftware"> CCH Accounts Production 2025.300</ix:nonNumeric>',
        '<xbrli:unit id="p"><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit><ix:nonFraction name="core:AverageNumberEmployeesDuringPeriod" unitRef="p" scale="-2" decimals="2">', (F.col("o_custkey") % 500 + 1).cast("string"), "</ix:nonFraction>", _TAIL,
    )
    bound = E.bind(parse_documents(members(spark, sf_dir, *body)))
    return bound.select("source_file", "corrections", F.explode_outer("facts").alias("f")).where("f.concept = 'AverageNumberEmployeesDuringPeriod'").select("source_file", "corrections", F.col("f.value").alias("value"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = (_HEAD, F.when(F.col("o_orderkey") % 4 == 0, "").otherwise('<ix:nonFraction name="core:A">1</ix:nonFraction><ix:nonFraction name="core:B">2</ix:nonFraction>'), _TAIL)
    return E.summary(E.status_of(E.bind(parse_documents(members(spark, sf_dir, *body)))))


def pages_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as they come: a closing tag inside a script ends every element, so each fails."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_file"), F.col("html").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("only_ukfrs"))
    return E.status_of(E.bind(parse_documents(rows))).select("source_file", "ok", "facts")


def taxonomy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their concepts' attributes, from schemas written from the parts table."""
    concept = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "Q").otherwise("P"), "l_partkey")  # a Q is in no schema
    facts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("urn:parts").alias("namespace"), concept.alias("concept"), "l_orderkey", "l_linenumber")
    return X.join_facts(facts, _concepts(spark, sf_dir)).select("l_orderkey", "l_linenumber", "concept", "period_type", "balance", "type_name")


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = _text('<xs:element name="P', F.col("p_partkey").cast("string"), '" type="xbrli:monetaryItemType" substitutionGroup="xbrli:item" xbrli:periodType="', F.when(F.col("p_size") % 2 == 0, "instant").otherwise("duration"), '" xbrli:balance="credit"/>')
    schema = _text(
        '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:xbrli="http://www.xbrl.org/2003/instance" targetNamespace="urn:parts">', element,
        '<xs:element name="notAConcept" type="xs:string"/></xs:schema>',
    )
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    return X.merge(X.concepts(parts.select(F.concat(F.lit("p"), "p_partkey", F.lit(".xsd")).alias("location"), schema.cast("binary").alias("content"))))


def taxonomy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two suites that disagree on some concepts."""
    base = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    suite = lambda s, balance: base.select(
        F.lit(s).alias("location"), F.lit("urn:p").alias("namespace"), F.concat(F.lit("P"), "p_partkey").alias("local_name"), F.lit("false").alias("abstract"), F.lit("").alias("type_namespace"), F.lit("t").alias("type_name"),
        F.lit("").alias("substitution_group_namespace"), F.lit("item").alias("substitution_group_name"), F.lit("instant").alias("period_type"), balance.alias("balance"), F.lit("true").alias("nillable"),
    )
    return X.conflicts(suite("a", F.lit("debit")).unionByName(suite("b", F.when(F.col("p_size") % 10 == 0, "credit").otherwise("debit")))).select("namespace", "local_name", "fields")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_orders_ixbrl, context_bind, unit_join, continuation_join, nested_facts_exclude, classic_items, target_filter, document_status, headcount_documents, run_summary, pages_rejected, taxonomy_join, taxonomy_conflicts,
    )
}

_SF = "'Prod100_1_' || lpad(o_orderkey::VARCHAR, 8, '0') || '_20200101.html'"
_D = "strftime(o_orderdate, '%Y-%m-%d')"
_ROW = "SELECT {} AS period_start, {} AS period_end, '{}' AS concept, {} AS value, '{}' AS unit, '' AS dimensions, '{}' AS namespace, " + _SF + " AS source_file, '{}' AS decimals FROM orders"
_THOUSANDS = "rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 1000 AS VARCHAR), '0'), '.')"
ORACLE_SQL = {
    "parse_orders_ixbrl": " UNION ALL ".join((
        _ROW.format(_D, _D, "NetAssets", "CAST(CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 1000 AS BIGINT) AS VARCHAR)", "iso4217:GBP", "urn:core", "2"),
        _ROW.format(_D, _D, "Name", "'A & B ' || o_custkey", "", "urn:core", ""),
        _ROW.format("''", "''", "Date", _D, "", "urn:core", ""),
    )),
    "context_bind": f"""SELECT {_SF} AS source_file, '2020-01-01' AS period_start, {_D} AS period_end, '{{"ADim":"' || o_custkey || '","ZDim":"M' || o_orderstatus || '"}}' AS dimensions FROM orders""",
    "unit_join": f"SELECT {_SF} AS source_file, CASE o_orderkey % 3 WHEN 0 THEN 'iso4217:GBP/xbrli:shares' WHEN 1 THEN 'u2' ELSE 'u3' END AS unit, o_custkey::VARCHAR AS value FROM orders",
    "continuation_join": f"SELECT {_SF} AS source_file, 'Note' AS concept, 'one' || o_orderstatus || 'two ' || o_custkey || ' inthree' AS value FROM orders UNION ALL SELECT {_SF}, 'Inner', 'in' FROM orders",
    "nested_facts_exclude": f"SELECT {_SF} AS source_file, 'Outer' AS concept, 'a ' || o_orderpriority || ' b' AS value FROM orders UNION ALL SELECT {_SF}, 'Inner', o_orderpriority FROM orders UNION ALL SELECT {_SF}, 'Kept', o_custkey::VARCHAR FROM orders",
    "classic_items": " UNION ALL ".join((_ROW.format(_D, _D, "Cash", "o_custkey::VARCHAR", "iso4217:GBP", "urn:gaap", "0"), _ROW.format(_D, _D, "Name", "o_orderpriority", "", "urn:gaap", ""))),
    "target_filter": f"SELECT {_SF} AS source_file, 'A' AS concept, 'k' AS value FROM orders UNION ALL SELECT {_SF}, 'B', 'v' FROM orders WHERE o_orderkey % 3 = 0",
    "document_status": f"""SELECT {_SF} AS source_file, o_orderkey % 5 = 4 AS ok, CASE WHEN o_orderkey % 5 = 4 THEN 1 ELSE 0 END::BIGINT AS facts,
 CASE o_orderkey % 5 WHEN 0 THEN 'date transform D format ixt:datedaymonthyearen value 31 December' WHEN 1 THEN 'undeclared prefix "nope" on D' WHEN 2 THEN 'XML syntax error on line 1: unexpected EOF' WHEN 3 THEN 'no facts extracted from ' || {_SF} END AS error FROM orders""",
    "headcount_documents": f"""SELECT {_SF} AS source_file, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS corrections,
 CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 500 + 1)::VARCHAR ELSE rtrim(rtrim(CAST(CAST(o_custkey % 500 + 1 AS DECIMAL(10,2)) * CAST(0.01 AS DECIMAL(3,2)) AS VARCHAR), '0'), '.') END AS value FROM orders""",
    "run_summary": "SELECT count(*) AS members, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS files_ok, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS files_err, 0::BIGINT AS corrections, (2 * count(*) FILTER (WHERE o_orderkey % 4 <> 0))::BIGINT AS facts FROM orders",
    "pages_rejected": "SELECT 'p' || page_id || '.html' AS source_file, FALSE AS ok, 0::BIGINT AS facts FROM pages",
    "taxonomy_join": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'Q' ELSE 'P' END || l_partkey AS concept, CASE WHEN p_partkey IS NULL THEN NULL WHEN p_size % 2 = 0 THEN 'instant' ELSE 'duration' END AS period_type,
 CASE WHEN p_partkey IS NOT NULL THEN 'credit' END AS balance, CASE WHEN p_partkey IS NOT NULL THEN 'monetaryItemType' END AS type_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND l_linenumber % 3 <> 0""",
    "taxonomy_conflicts": "SELECT 'urn:p' AS namespace, 'P' || p_partkey AS local_name, 'balance' AS fields FROM part WHERE p_size % 10 = 0",
}
