"""Queries of the wide transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark import fixed_values
from filingspark.functions.text import company_number
from filingspark.operators import transform as T
from filingspark.plans.facts import FACTS, facts, values_sql

_MAP = [(r["canonical"], r["concept"], int(r["priority"]), r["cast_type"]) for r in fixed_values.rows(fixed_values.CONCEPT_MAP)]
# The checks follow the rules, not the plan: one scan with the fields as expressions, and the pick as
# an aggregate.
_BASE = "regexp_extract(source_file, '[^/' || chr(92) || chr(92) || ']*$')"
_NUMBER = rf"CASE WHEN regexp_matches({_BASE}, '^Prod\d+_\d+_[A-Za-z0-9]{{8}}_\d{{8}}') THEN upper(split_part({_BASE}, '_', 3)) WHEN regexp_matches({_BASE}, '^[A-Za-z0-9]{{8}}_[^_]+_') THEN upper(left({_BASE}, 8)) END"
_BARE = "coalesce(trim(dimensions), '') IN ('', '{}')"
_DATE = lambda c: f"TRY_CAST(trim({c}) AS DATE)"
_RAW = f"WITH raw AS ({FACTS})"
_MAPPED = f"""{_RAW}, {values_sql("names", ["canonical", "concept", "priority", "cast_type"], _MAP)},
kept AS (SELECT {_NUMBER} AS company_number, {_DATE("period_start")} AS period_start, {_DATE("period_end")} AS period_end, canonical, priority, cast_type, concept, CASE WHEN trim(value) <> '' THEN trim(value) END AS value, unit, namespace, {_BASE} AS source_file
 FROM raw JOIN names USING (concept) WHERE {_BARE} AND {_DATE("period_end")} IS NOT NULL AND {_NUMBER} IS NOT NULL)"""
# Least priority first; of equal priorities the greatest value: codes turned round so that min takes it.
_ORDERED = "{'p': priority, 'v': [-unicode(x) for x in string_split(value, '')] || [1], 'value': value, 'concept': concept, 'kind': cast_type}"
_PICK = f"SELECT company_number, period_start, period_end, canonical, min({_ORDERED}) AS chosen FROM kept WHERE value IS NOT NULL GROUP BY ALL"
_BEST = f"{_MAPPED}, picked AS ({_PICK})"


def _cell(canonical: str, kind: str) -> str:
    value = f"any_value(chosen.value) FILTER (WHERE canonical = '{canonical}')"
    return f"{value} AS {canonical}" if kind == "string" else f"TRY_CAST({value} AS {kind.upper()}) AS {canonical}"


_WIDE = f"{_BEST}, wide AS (SELECT company_number, period_start, period_end, {', '.join(_cell(c, k) for c, k in fixed_values.canonicals().items())} FROM picked GROUP BY ALL)"
_PRESENT = ("applicable_tax_rate", "balance_sheet_date", "company_dormant", "company_name", "employees", "net_assets", "profit_before_tax", "profit_for_period")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mapped_facts(T.plain_facts(T.typed_facts(facts(spark, sf_dir))), T.concept_map(spark))


def company_number_from_source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("source_file", company_number(F.col("source_file")).alias("company_number")).distinct()


def plain_fact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.plain_facts(T.typed_facts(facts(spark, sf_dir)))


def mapped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)


def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.best_facts(_mapped(spark, sf_dir))


def pivot_wide_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.accounts_wide(facts(spark, sf_dir))


def pivot_wide_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.wide_dynamic(T.best_facts(_mapped(spark, sf_dir)))


def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _mapped(spark, sf_dir)
    return T.coverage(mapped, T.best_facts(mapped))


def topk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.preview(T.accounts_wide(facts(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (company_number_from_source_file, plain_fact_filter, mapped_facts, priority_pick, pivot_wide_static, pivot_wide_dynamic, coverage_metrics, topk_preview)}

ORACLE_SQL = {
    "company_number_from_source_file": f"{_RAW} SELECT source_file, any_value({_NUMBER}) AS company_number FROM raw GROUP BY source_file",
    "plain_fact_filter": f"""{_RAW} SELECT {_NUMBER} AS company_number, {_DATE("period_start")} AS period_start, {_DATE("period_end")} AS period_end, concept, value, unit, dimensions, namespace, {_BASE} AS source_file, decimals FROM raw WHERE {_BARE}""",
    "mapped_facts": f"{_MAPPED} SELECT * FROM kept",
    "priority_pick": f"{_BEST} SELECT company_number, period_start, period_end, canonical, chosen.value AS value, chosen.kind AS cast_type, chosen.concept AS source_concept, chosen.p AS priority FROM picked",
    "pivot_wide_static": f"{_WIDE} SELECT * FROM wide",
    "pivot_wide_dynamic": f"{_BEST} SELECT company_number, period_start, period_end, {', '.join(_cell(c, 'string') for c in _PRESENT)} FROM picked WHERE canonical <> 'company_number' GROUP BY ALL",
    "coverage_metrics": f"""{_BEST}, n AS (SELECT count(DISTINCT (company_number, period_start, period_end)) AS rows, count(DISTINCT company_number) AS companies, (SELECT count(*) FROM kept) AS mapped_plain_facts, count(*) AS best_facts FROM picked)
 UNPIVOT (SELECT rows::VARCHAR AS rows, companies::VARCHAR AS companies, mapped_plain_facts::VARCHAR AS mapped_plain_facts, best_facts::VARCHAR AS best_facts FROM n) ON COLUMNS(*) INTO NAME metric VALUE value""",
    "topk_preview": f"{_WIDE} SELECT {', '.join(T.PREVIEW)} FROM wide WHERE coalesce(company_name, net_assets::VARCHAR, turnover::VARCHAR) IS NOT NULL ORDER BY company_number, period_end, period_start NULLS FIRST LIMIT 25",
}
