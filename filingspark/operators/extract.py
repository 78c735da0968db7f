"""Parsed documents to long facts and a status per document.

Everything here is column expressions over one document's row: references are looked up in the
document's own maps, values are normalised inside its array of facts, and a document with a failing
fact loses all its facts before the array is exploded. So extraction has no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingspark.functions.facts import correct_headcount, normalise_text, producer_gate
from filingspark.functions.numbers import normalise_numeric
from filingspark.functions.text import dimensions_json, let, unit_text
from filingspark.operators.parser import parse_documents
from filingspark.schemas import FACT

TARGET = "UKFRS"


def _bound(fact: Column, contexts: Column, units: Column, gate: Column, source_file: Column) -> Column:
    def row(context: Column, unit: Column, value: Column) -> Column:
        return F.struct(
            F.coalesce(context["period_start"], F.lit("")).alias("period_start"),
            F.coalesce(context["period_end"], F.lit("")).alias("period_end"),
            fact["concept"].alias("concept"),
            value["value"].alias("value"),
            unit.alias("unit"),
            dimensions_json(context["dims"]).alias("dimensions"),
            fact["namespace"].alias("namespace"),
            source_file.alias("source_file"),
            F.when(fact["is_numeric"], fact["decimals"]).otherwise(F.lit("")).alias("decimals"),
            value["corrected"].alias("corrected"),
            F.when(value["failed"], F.concat(F.lit("date transform "), fact["concept"], F.lit(" format "), fact["format"], F.lit(" value "), fact["value"])).alias("failure"),
        )

    def number(unit: Column) -> Column:
        fixed = correct_headcount(fact["concept"], fact["scale"], unit, fact["value"], fact["format"], fact["sign"], gate)
        value = lambda x: normalise_numeric(fact["value"], x["scale"], x["sign"], fact["format"], F.when(~x["corrected"], fact["exact"]))
        return let(fixed, lambda x: F.struct(value(x).alias("value"), F.lit(False).alias("failed"), x["corrected"].alias("corrected")))

    text = let(normalise_text(fact["value"], fact["format"]), lambda x: F.struct(x["value"].alias("value"), x["failed"].alias("failed"), F.lit(False).alias("corrected")))
    unit_of = unit_text(fact["unit_ref"], F.try_element_at(units, fact["unit_ref"]))
    return let(F.try_element_at(contexts, fact["context_ref"]), lambda c: let(unit_of, lambda u: let(F.when(fact["is_numeric"], number(u)).otherwise(text), lambda v: row(c, u, v))))


def bind(documents: DataFrame) -> DataFrame:
    """source_file, error, corrections, facts: one row per document, facts empty where error is not
    null."""
    kept = F.filter("facts", lambda f: (f["name"] != "") & (~F.col("only_ukfrs") | (f["target"] == TARGET)))
    gate = producer_gate(F.col("producer"), F.col("producer_version"))
    bound = F.transform(kept, lambda f: _bound(f, F.col("contexts"), F.col("units"), F.col("gate"), F.col("source_file")))
    # One generated row per document holds its facts, so that what follows reads them and does not
    # compute them again.
    rows = documents.withColumn("gate", gate).select("source_file", "error", F.explode_outer(F.array(bound)).alias("facts"))
    failure = F.get(F.filter(F.transform("facts", lambda f: f["failure"]), lambda x: x.isNotNull()), F.lit(0))
    error = F.coalesce("error", F.concat(failure, F.lit(" in "), "source_file"), F.when(F.size("facts") == 0, F.concat(F.lit("no facts extracted from "), "source_file")))
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    return rows.select(
        "source_file",
        "error",
        F.when(good, F.size(F.filter("facts", lambda f: f["corrected"])).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("corrections"),
        F.when(good, F.col("facts")).otherwise(F.slice("facts", 1, 0)).alias("facts"),
    )


def facts_of(bound: DataFrame, *, with_order: bool = False) -> DataFrame:
    """Long facts, nine text columns; with_order adds each fact's place in its document."""
    # The outer form: for the plain one the optimizer adds filters that compute the array again.
    rows = bound.select(F.posexplode_outer("facts").alias("fact_ord", "f")).where(F.col("fact_ord").isNotNull())
    return rows.select(*(F.col("f")[n].alias(n) for n in FACT.names), *([F.col("fact_ord")] * with_order))


def status_of(bound: DataFrame) -> DataFrame:
    """source_file, ok, error, facts, corrections per document."""
    return bound.select("source_file", F.col("error").isNull().alias("ok"), "error", F.size("facts").cast("bigint").alias("facts"), "corrections")


def extract(members: DataFrame) -> DataFrame:
    """Long facts of members."""
    return facts_of(bind(parse_documents(members)))


def summary(status: DataFrame) -> DataFrame:
    """members, files_ok, files_err, corrections, facts of a run, one row."""
    return status.agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if("ok").alias("files_ok"),
        F.count_if(~F.col("ok")).alias("files_err"),
        F.coalesce(F.sum("corrections"), F.lit(0)).alias("corrections"),
        F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"),
    )
