"""Long facts made from the test tables, in SQL that Spark and DuckDB both read, so that a query
and its check start from the same relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_NUMBER = "lpad(CAST(o_custkey AS STRING), 8, '0')"

# One order is one filing of its customer; each branch is a concept in it.
_FILE = f"""CASE WHEN o_orderkey % 6 = 0 THEN concat('in', chr(92), 'SC', lpad(CAST(o_custkey % 1000000 AS STRING), 6, '0'), '_aa_', {_DAY}, '.xhtml')
 WHEN o_orderkey % 6 = 1 THEN concat('note-', CAST(o_orderkey AS STRING), '.html')
 ELSE concat('a/b/Prod', CAST(o_orderkey % 900 + 100 AS STRING), '_', CAST(o_orderkey % 7 AS STRING), '_', {_NUMBER}, '_', replace({_DAY}, '-', ''), '.html') END"""
_DIMENSIONS = "CASE o_orderkey % 7 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '{}' WHEN 2 THEN '   ' WHEN 3 THEN '{\"k\":\"v\"}' ELSE '' END"
_CONCEPTS = (
    ("NetAssetsLiabilities", "CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING)", "iso4217:GBP", "1 = 1"),
    ("NetAssetsLiabilitiesIncludingPensionAssetLiability", "CAST(CAST(o_totalprice AS DECIMAL(20,2)) + 1 AS STRING)", "iso4217:GBP", "o_orderkey % 3 = 0"),
    ("ProfitLoss", "CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE concat('-', CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING), '49') END", "iso4217:GBP", "o_orderkey % 2 = 0"),
    ("ProfitLossForPeriod", "CAST(o_custkey AS STRING)", "iso4217:GBP", "o_orderkey % 8 = 0"),
    ("AverageNumberEmployeesDuringPeriod", "concat(CAST(o_custkey % 300 AS STRING), '.5')", "xbrli:pure", "o_orderkey % 4 <> 1"),
    ("EmployeesTotal", "CAST(o_custkey % 50 AS STRING)", "xbrli:pure", "o_orderkey % 4 = 1"),
    ("EntityCurrentLegalOrRegisteredName", "concat('Company ', CAST(o_custkey AS STRING))", "", "o_orderkey % 9 <> 0"),
    ("EntityDormantTruefalse", "CASE WHEN o_orderstatus = 'F' THEN 'true' WHEN o_orderstatus = 'O' THEN 'false' ELSE 'maybe' END", "", "o_orderkey % 2 = 1"),
    ("BalanceSheetDate", f"CASE WHEN o_orderkey % 10 = 0 THEN substring({_DAY}, 1, 7) ELSE {_DAY} END", "", "o_orderkey % 3 <> 2"),
    ("ApplicableTaxRate", "concat('0.', lpad(CAST(o_custkey % 400 AS STRING), 9, '0'))", "xbrli:pure", "o_orderkey % 5 = 2"),
    ("UKCompaniesHouseRegisteredNumber", "CAST(o_custkey AS STRING)", "", "o_orderkey % 4 = 0"),
    ("UnmappedConcept", "o_orderpriority", "", "o_orderkey % 11 = 0"),
)

FACTS = " UNION ALL ".join(
    f"""SELECT CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE {_DAY} END AS period_start,
 CASE WHEN o_orderkey % 13 = 0 THEN ' ' WHEN o_orderkey % 17 = 0 THEN substring({_DAY}, 1, 7) ELSE {_DAY} END AS period_end,
 '{concept}' AS concept, {value} AS value, '{unit}' AS unit, {_DIMENSIONS} AS dimensions, 'urn:test' AS namespace, {_FILE} AS source_file, '0' AS decimals,
 CAST(o_orderkey AS BIGINT) * 16 + {i} AS fact_ord
 FROM orders WHERE {where}"""
    for i, (concept, value, unit, where) in enumerate(_CONCEPTS)
)


SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores - a small test table is one file and would be one task - and, as it
    grows, over a task for each SPREAD_BYTES of its files. By a hash of the rows: dealing in turn
    would sort them first."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)), *df.columns)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long facts, with fact_ord, a place that grows through a filing: one scan of the orders,
    each of which holds an array of its facts."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"))
    end = f"CASE WHEN o_orderkey % 13 = 0 THEN ' ' WHEN o_orderkey % 17 = 0 THEN substring({_DAY}, 1, 7) ELSE {_DAY} END"
    filing = orders.select(
        F.expr(f"CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE {_DAY} END").alias("period_start"),
        F.expr(end).alias("period_end"),
        F.array(*(F.when(F.expr(where), F.struct(F.lit(concept).alias("concept"), F.expr(value).alias("value"), F.lit(unit).alias("unit"), F.lit(i).alias("i"))) for i, (concept, value, unit, where) in enumerate(_CONCEPTS))).alias("own"),
        F.expr(_DIMENSIONS).alias("dimensions"),
        F.expr(_FILE).alias("source_file"),
        "o_orderkey",
    )
    each = filing.select("period_start", "period_end", "dimensions", "source_file", "o_orderkey", F.explode("own").alias("f")).where("f IS NOT NULL")
    return each.select(
        "period_start", "period_end", "f.concept", "f.value", "f.unit", "dimensions", F.lit("urn:test").alias("namespace"), "source_file", F.lit("0").alias("decimals"),
        (F.col("o_orderkey").cast("bigint") * 16 + F.col("f.i")).alias("fact_ord"),
    )


def values_sql(name: str, columns: list[str], data: list[tuple]) -> str:
    """A CTE of literal rows."""
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in data)
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t({', '.join(columns)}))"
