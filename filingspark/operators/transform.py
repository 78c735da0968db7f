"""Long facts to one wide row per company and period.

typed facts -> facts without dimensions -> join with the concept map -> best value per company,
period and column -> pivot -> casts. One lazy plan: the map is broadcast (its size is fixed by the
package, or checked where a caller brings another), the best value is a windowed rank on rows
dealt by company and period, and the pivot runs on the same partitioning, so there is one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingspark import fixed_values
from filingspark.functions import soft
from filingspark.functions.text import base_name, company_number, is_plain_dimension, non_empty

KEYS = ("company_number", "period_start", "period_end")
MAP_SCHEMA = "canonical string, concept string, priority int, cast_type string"
BROADCAST_ROWS = 100_000


def concept_map(spark: SparkSession, text: str = fixed_values.CONCEPT_MAP) -> DataFrame:
    data = [(r["canonical"], r["concept"], int(r["priority"]), r.get("cast_type") or "VARCHAR") for r in fixed_values.rows(text)]
    return spark.createDataFrame(data, MAP_SCHEMA)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(rows + 1)) <= rows else df


def typed_facts(facts: DataFrame) -> DataFrame:
    """Facts with the company number from the file name, ISO dates, and the bare file name. Extra
    columns of facts go; partial dates are null."""
    return facts.select(
        company_number(F.col("source_file")).alias("company_number"),
        soft.to_date(F.col("period_start")).alias("period_start"),
        soft.to_date(F.col("period_end")).alias("period_end"),
        "concept", "value", "unit", "dimensions", "namespace",
        base_name(F.col("source_file")).alias("source_file"),
        "decimals",
    )


def plain_facts(typed: DataFrame) -> DataFrame:
    return typed.where(is_plain_dimension(F.col("dimensions")))


def mapped_facts(plain: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts joined to their canonical columns; a concept may have several. Only facts with a
    company number and a period end stay."""
    keyed = plain.where(F.col("company_number").isNotNull() & (F.col("company_number") != "") & F.col("period_end").isNotNull())
    return keyed.join(small(mapping), "concept").select(*KEYS, "canonical", "priority", "cast_type", "concept", non_empty(F.col("value")).alias("value"), "unit", "namespace", "source_file")


def best_facts(mapped: DataFrame) -> DataFrame:
    """Per company, period and canonical the value of the first priority; of equal priorities the
    value last in order, so that the pick does not depend on the rows' order. Rows are dealt by
    company and period once: the rank and the pivot after it both stay on that partitioning."""
    order = Window.partitionBy(*KEYS, "canonical").orderBy(F.asc("priority"), F.desc_nulls_last("value"))
    ranked = mapped.where(F.col("value").isNotNull()).repartition(*KEYS).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return ranked.select(*KEYS, "canonical", "value", "cast_type", F.col("concept").alias("source_concept"), "priority")


def pivot(best: DataFrame, canonicals: list[str]) -> DataFrame:
    """One row per company and period, a text column per canonical. The values of a row meet in one
    map, on the partitioning that the pick left; a pivot would carry a buffer per column."""
    entries = F.map_from_entries(F.collect_list(F.struct("canonical", "value")))
    grouped = best.where(F.col("canonical").isin(canonicals)).groupBy(*KEYS).agg(entries.alias("m"))
    return grouped.select(*KEYS, *(F.try_element_at("m", F.lit(c)).alias(c) for c in canonicals))


def cast(c: Column, kind: str) -> Column:
    if kind == "string":
        return c
    if kind == "date":
        return soft.to_date(c)
    if kind == "boolean":
        return soft.to_boolean(c)
    if kind == "int":
        return soft.to_integer(c)
    precision, scale = kind.removeprefix("decimal(").rstrip(")").split(",")
    return soft.to_decimal(c, int(precision), int(scale))


def wide_static(best: DataFrame) -> DataFrame:
    """accounts_wide: keys and the typed canonical columns."""
    types = fixed_values.canonicals()
    entries = F.map_from_entries(F.collect_list(F.struct("canonical", "value")))
    grouped = best.groupBy(*KEYS).agg(entries.alias("m"))
    return grouped.select(*KEYS, *(cast(F.try_element_at("m", F.lit(c)), kind).alias(c) for c, kind in types.items()))


def wide_dynamic(best: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A text column for every canonical that occurs, in name order. The names are those of the
    map, so their number has its bound. Which occur decides the columns, so the picked values are
    persisted (spilling to disk) and read twice; a lost executor's part is computed again."""
    found = best.where("canonical != 'company_number'")
    if names is None:
        found = found.persist()
        names = sorted(r[0] for r in found.select("canonical").distinct().collect())
    return pivot(found, names)


def accounts_wide(facts: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The whole transform: long facts to accounts_wide."""
    mapping = mapping if mapping is not None else concept_map(facts.sparkSession)
    return wide_static(best_facts(mapped_facts(plain_facts(typed_facts(facts)), mapping)))


def coverage(mapped: DataFrame, best: DataFrame) -> DataFrame:
    """metric, value: rows and companies of the wide table, mapped facts, best facts."""
    of_best = best.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("company_number").alias("companies"), F.coalesce(F.sum("n"), F.lit(0)).alias("best_facts"))
    of_mapped = mapped.agg(F.count(F.lit(1)).alias("n"))
    stacked = of_best.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in ("rows", "companies", "best_facts")))))
    return stacked.unionByName(of_mapped.select(F.lit("mapped_plain_facts").alias("metric"), F.col("n").cast("string").alias("value")))


# Columns of the report over the wide table.
PREVIEW = ("company_number", "period_end", "company_name", "employees", "turnover", "fixed_assets", "current_assets", "cash", "net_assets", "equity", "profit_before_tax", "auditor_name")


def preview(wide: DataFrame, rows: int = 25) -> DataFrame:
    """The report: first rows by company and period of those with a name, net assets or turnover."""
    some = wide.where("company_name IS NOT NULL OR net_assets IS NOT NULL OR turnover IS NOT NULL")
    return some.orderBy("company_number", "period_end", "period_start").limit(rows).select(*PREVIEW)


def write_wide(wide: DataFrame, path: str) -> None:
    """ZSTD Parquet, each file in order of company and period."""
    wide.repartitionByRange("company_number", "period_end", "period_start").sortWithinPartitions("company_number", "period_end", "period_start").write.mode("overwrite").option("compression", "zstd").parquet(path)
