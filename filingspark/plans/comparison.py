"""Queries of the comparison suites. One side is the long facts; the other is the same facts with
changes made by rule, so that every kind of difference occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark import fixed_values
from filingspark.operators import compare as C
from filingspark.plans.facts import FACTS, facts, values_sql
from filingspark.schemas import FACT

_N = FACT.names


def _methods(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = facts(spark, sf_dir)
    other = base.where("fact_ord % 97 <> 0").withColumn("value", F.expr("CASE WHEN fact_ord % 89 = 0 THEN concat(value, '0') ELSE value END"))
    return {"dir": base.select(_N), "zip": other.select(_N)}


_METHODS = f"""WITH base AS ({FACTS}), dir AS (SELECT {", ".join(_N)} FROM base),
zip AS (SELECT {", ".join("CASE WHEN fact_ord % 89 = 0 THEN concat(value, '0') ELSE value END AS value" if n == "value" else n for n in _N)} FROM base WHERE fact_ord % 97 <> 0)"""


_CHANGED = ", ".join("CASE WHEN fact_ord % 89 = 0 THEN concat(value, '0') ELSE value END AS value" if n == "value" else n for n in _N)


def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.method_counts(_methods(spark, sf_dir))


def source_file_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.source_file_except(_methods(spark, sf_dir))


def fact_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fact_except(_methods(spark, sf_dir))


def methods_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = facts(spark, sf_dir).select(_N)
    return C.assert_agree({"dir": same, "zip": same, "tar": same})


def methods_disagree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the assertion would say of routes that differ in number, in files, and in facts alone."""
    base = facts(spark, sf_dir)
    routes = {
        "count": base.where("fact_ord % 97 <> 0"),
        "files": base.withColumn("source_file", F.expr("CASE WHEN fact_ord % 89 = 0 THEN concat(source_file, '.x') ELSE source_file END")),
        "facts": base.withColumn("value", F.expr("CASE WHEN fact_ord % 89 = 0 THEN concat(value, '0') ELSE value END")),
    }
    out = None
    for name, other in routes.items():
        row = C.agreement({"dir": base.select(_N), "zip": other.select(_N)}).select(F.lit(name).alias("route"), F.substring_index("status", ". first", 1).alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = facts(spark, sf_dir)
    raw = base.where("fact_ord % 41 <> 0").select(
        F.concat(F.lit("core:"), F.when(F.col("fact_ord") % 53 == 0, F.lit("Other")).otherwise(F.col("concept"))).alias("Name"),
        F.when(F.col("fact_ord") % 37 == 0, F.lit("(reported)")).when(F.col("fact_ord") % 3 == 0, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value")).alias("Value"),
        F.when(F.col("fact_ord") % 2 == 0, F.col("period_start")).otherwise(F.lit("")).alias("Start"),
        F.col("period_end").alias("End/Instant"),
        "source_file",
    )
    return C.oracle_facts(raw), C.own_facts(base.where("fact_ord % 43 <> 0"))


_SOFT = lambda v: f"""replace(replace(regexp_replace(trim(coalesce({v}, '')), '\\s+', ' ', 'g'), ',', ''), '"', '')"""
_BASE_NAME = "regexp_extract(source_file, '[^/' || chr(92) || chr(92) || ']*$')"
_KEY = "source_file, concept, period_start, period_end"
_SIDES = f"""WITH base AS ({FACTS}),
both_sides AS (SELECT 'o' AS side, {_BASE_NAME} AS source_file, CASE WHEN fact_ord % 53 = 0 THEN 'Other' ELSE concept END AS concept,
  CASE WHEN fact_ord % 2 = 0 AND trim(period_start) <> '' THEN trim(period_start) ELSE trim(period_end) END AS period_start, trim(period_end) AS period_end,
  {_SOFT("CASE WHEN fact_ord % 37 = 0 THEN '' WHEN fact_ord % 3 = 0 THEN chr(34) || value || chr(34) ELSE value END")} AS v FROM base WHERE fact_ord % 41 <> 0
 UNION ALL SELECT 'x', {_BASE_NAME}, trim(concept), trim(period_start), trim(period_end), {_SOFT("value")} FROM base WHERE fact_ord % 43 <> 0),
met AS (SELECT {_KEY}, list_sort(list(v) FILTER (WHERE side = 'o')) AS o, list_sort(list(v) FILTER (WHERE side = 'x')) AS x FROM both_sides GROUP BY ALL),
rows AS (SELECT {_KEY}, unnest(list_zip(coalesce(o, []), coalesce(x, []))) AS p, unnest(generate_series(1, greatest(len(coalesce(o, [])), len(coalesce(x, []))))) AS i, coalesce(len(o), 0) AS n_o, coalesce(len(x), 0) AS n_x FROM met),
paired AS (SELECT {_KEY}, p[1] AS oracle_value, p[2] AS extract_value, i <= n_o AS in_o, i <= n_x AS in_x,
 trim(p[1]) = trim(p[2]) OR coalesce(TRY_CAST(p[1] AS DOUBLE) = TRY_CAST(p[2] AS DOUBLE), FALSE) OR coalesce(try_strptime(p[1], '%Y-%m-%d') = try_strptime(p[2], '%Y-%m-%d'), FALSE) AS value_match FROM rows),
concepts AS (SELECT concept, bool_or(side = 'o') AS in_o, bool_or(side = 'x') AS in_x FROM both_sides GROUP BY concept)"""


def soft_fact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs(*_sides(spark, sf_dir))


def facts_only_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.only_facts(*_sides(spark, sf_dir))


def facts_only_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.only_facts(*reversed(_sides(spark, sf_dir)))


def concepts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    oracle, own = _sides(spark, sf_dir)
    return C.concept_sides({"oracle": oracle, "extract": own})


def facts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facts_summary(*_sides(spark, sf_dir))


# -- wide rows -------------------------------------------------------------------------------------


def grain_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract_wide(facts(spark, sf_dir))


def _oracle_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows with some files missing, some names changed, some amounts changed."""
    wide = C.extract_wide(facts(spark, sf_dir).where("fact_ord % 7 <> 0"))
    h = F.expr("(ascii(substring(source_file, 6, 1)) * 7 + ascii(substring(source_file, 7, 1))) % 11")
    return wide.where(h != 0).withColumn("entity_current_legal_name", F.when(h == 1, F.concat("entity_current_legal_name", F.lit(" Ltd"))).otherwise(F.col("entity_current_legal_name"))).withColumn(
        "profit_loss_for_period", F.when(h == 2, F.lit("1")).otherwise(F.col("profit_loss_for_period"))
    )


def _compared(spark: SparkSession, sf_dir: str):
    oracle, own = _oracle_wide(spark, sf_dir), C.extract_wide(facts(spark, sf_dir))
    paired = C.paired_rows(oracle, own)
    return oracle, own, paired, C.cells(paired)


def full_outer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = _compared(spark, sf_dir)[3]
    return cell.groupBy("col", "kind", "has_oracle", "has_extract").agg(F.count(F.lit(1)).alias("n"), F.count("o_val").alias("n_oracle"), F.count("e_val").alias("n_extract"))


def cell_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cell_diffs(_compared(spark, sf_dir)[3])


def per_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    oracle, own = _oracle_wide(spark, sf_dir), C.extract_wide(facts(spark, sf_dir))
    files = facts(spark, sf_dir).select(C.base_name(F.col("source_file")).alias("source_file"))
    return C.file_status(C.per_file(files, oracle, own))


_COLUMN_MAP = [(r["column_name"], r["concept"], int(r["priority"]), r["grain"], r["transform"]) for r in fixed_values.rows(fixed_values.COLUMN_MAP)]
_SPEC = [(r["column_name"], r["kind"]) for r in fixed_values.rows(fixed_values.COMPARE_SPEC)]

def _wide_rows(name: str, source: str) -> str:
    """CTEs that end in `name`, the wide rows of a facts relation: the first value of each column by
    priority and place, columns of a file beside each of its periods. A file without a company number
    joins to nothing, so its periods are empty rows."""
    shown = lambda m, columns: ", ".join(f"{m}['{c}'] AS {c}" for c in columns)
    none = ", ".join(f"NULL AS {c}" for c in (*C.GENERAL, *C.PERIODICAL))
    magnitude = "TRY_CAST(replace(trim(value), ',', '') AS DOUBLE)"
    return f"""{name}_first AS (SELECT {_BASE_NAME} AS source_file, {_ID} AS company_id, grain, column_name,
  CASE grain WHEN 'periodical' THEN TRY_CAST(trim(period_start) AS DATE) END AS period_start, CASE grain WHEN 'periodical' THEN TRY_CAST(trim(period_end) AS DATE) END AS period_end,
  arg_min(CASE WHEN transform = 'not_bool' AND lower(trim(value)) IN ('true', 'false') THEN (lower(trim(value)) = 'false')::VARCHAR WHEN transform = 'abs' AND {magnitude} IS NOT NULL THEN abs({magnitude})::VARCHAR ELSE trim(value) END, priority::HUGEINT * 1000000000000 + fact_ord) AS value
 FROM {source} JOIN col_map ON trim({source}.concept) = col_map.concept WHERE trim(value) <> '' AND (grain = 'general' OR coalesce(trim(dimensions), '') IN ('', '{{}}')) GROUP BY ALL),
{name}_of_file AS (SELECT source_file, company_id, map_from_entries(list((column_name, value))) AS g FROM {name}_first WHERE grain = 'general' AND company_id IS NOT NULL GROUP BY ALL),
{name}_of_period AS (SELECT source_file, company_id, period_start, period_end, map_from_entries(list((column_name, value))) AS p FROM {name}_first WHERE grain = 'periodical' AND company_id IS NOT NULL GROUP BY ALL),
{name} AS (SELECT source_file, company_id, {shown("g", C.GENERAL)}, period_start, period_end, {shown("p", C.PERIODICAL)} FROM {name}_of_period FULL JOIN {name}_of_file USING (source_file, company_id)
 UNION ALL BY NAME SELECT source_file, {none} FROM (SELECT DISTINCT source_file, period_start, period_end FROM {name}_first WHERE company_id IS NULL))"""


_ID = rf"CASE WHEN regexp_matches({_BASE_NAME}, '^Prod\d+_\d+_[A-Za-z0-9]{{8}}_\d{{8}}') THEN upper(split_part({_BASE_NAME}, '_', 3)) WHEN regexp_matches({_BASE_NAME}, '^[A-Za-z0-9]{{8}}_[^_]+_') THEN upper(left({_BASE_NAME}, 8)) END"
_WIDE = f"""WITH base AS ({FACTS}), {values_sql("col_map", ["column_name", "concept", "priority", "grain", "transform"], _COLUMN_MAP)}, {values_sql("spec", ["column_name", "kind"], _SPEC)},
{_wide_rows("e", "base")}"""


def release_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = facts(spark, sf_dir)
    after = base.where("fact_ord % 101 <> 0").unionByName(base.where("fact_ord % 103 = 0"))
    return C.release_check(base, after)


def file_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as another source's rows, a third of them mapped to files, some without a date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate").cast("date").cast("string")).otherwise(F.lit(" "))
    rows = orders.select("o_orderkey", F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("company_id"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("run_code"), day.alias("date"))
    files = orders.where("o_orderkey % 3 = 0").select(
        F.col("o_custkey").cast("string").alias("file_company_id"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("run_code"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate").cast("date")).alias("file_date"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("source_file"),
    )
    return C.attach_files(rows, files).select("o_orderkey", "source_file")


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_run(per_file_counts(spark, sf_dir).where("status <> 'ERROR'"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.totals(per_file_counts(spark, sf_dir).drop("status"))


_O_COLUMNS = {
    "entity_current_legal_name": "CASE WHEN h = 1 THEN entity_current_legal_name || ' Ltd' ELSE entity_current_legal_name END",
    "profit_loss_for_period": "CASE WHEN h = 2 THEN '1' ELSE profit_loss_for_period END",
}
_TRUTH = lambda v: f"CASE WHEN lower({v}) IN ('1', 'true') THEN TRUE WHEN lower({v}) IN ('0', 'false') THEN FALSE END"
_COMPARED = ", ".join(f"('{c}', {c}::VARCHAR)" for c in C.COMPARED)
_PLACE = "source_file, period_start, period_end"
# Each side's row is a map of its cells; rows of a file and period meet, and every column of the spec
# is looked up in both maps.
_CELLS = f"""{_WIDE}, part AS (SELECT * FROM base WHERE fact_ord % 7 <> 0), {_wide_rows("r", "part")},
ow AS (SELECT source_file, period_start, period_end, {", ".join(f"{_O_COLUMNS.get(c, c)} AS {c}" for c in C.COMPARED)} FROM (SELECT *, (ascii(substring(source_file, 6, 1)) * 7 + ascii(substring(source_file, 7, 1))) % 11 AS h FROM r) WHERE h <> 0),
o_row AS (SELECT {_PLACE}, coalesce(companies_house_registered_number, period_start::VARCHAR, period_end::VARCHAR, company_id) IS NOT NULL AS known, map_from_entries([{_COMPARED}]) AS m FROM ow),
e_row AS (SELECT {_PLACE}, coalesce(company_id, period_start::VARCHAR, period_end::VARCHAR) IS NOT NULL AS known, map_from_entries([{_COMPARED}]) AS m FROM e),
pairs AS (SELECT ifnull(a.source_file, b.source_file) AS source_file, ifnull(ifnull(a.period_start, b.period_start)::VARCHAR, '') AS period_start, ifnull(ifnull(a.period_end, b.period_end)::VARCHAR, '') AS period_end,
  ifnull(a.known, FALSE) AS has_oracle, ifnull(b.known, FALSE) AS has_extract, a.m AS o, b.m AS e FROM o_row a FULL JOIN e_row b ON row(a.source_file, a.period_start, a.period_end) IS NOT DISTINCT FROM row(b.source_file, b.period_start, b.period_end)),
cells AS (SELECT {_PLACE}, has_oracle, has_extract, column_name AS col, kind, o[column_name] AS o_val, e[column_name] AS e_val FROM pairs, spec WHERE column_name IN ({", ".join(f"'{c}'" for c in C.COMPARED)})),
judged AS (SELECT *, {_SOFT("o_val")} AS so, {_SOFT("e_val")} AS se FROM cells),
diffs AS (SELECT source_file, period_start, period_end, col, o_val, e_val, kind FROM judged WHERE has_oracle AND has_extract AND so <> '' AND (kind = 'must' OR kind = 'observe' AND se <> '')
 AND so <> se AND coalesce(TRY_CAST(so AS DOUBLE) <> TRY_CAST(se AS DOUBLE), TRUE) AND coalesce(try_strptime(so, '%Y-%m-%d') <> try_strptime(se, '%Y-%m-%d'), TRUE) AND coalesce({_TRUTH("so")} <> {_TRUTH("se")}, TRUE)),
unmet AS (SELECT DISTINCT {_PLACE} FROM judged WHERE has_oracle AND NOT has_extract AND kind = 'must' AND so <> '')"""

QUERIES = {f.__name__: f for f in (method_counts, source_file_except, fact_except, methods_agree, methods_disagree, soft_fact_pairs, facts_only_left, facts_only_right, concepts_only, facts_summary, grain_pivot, full_outer_cells, cell_diffs, per_file_counts, release_check, file_map_join, run_status, totals)}

ORACLE_SQL = {
    "method_counts": f"{_METHODS} SELECT 'dir' AS method, count(*) AS n, count(DISTINCT source_file) AS files FROM dir UNION ALL SELECT 'zip', count(*), count(DISTINCT source_file) FROM zip",
    "source_file_except": f"""{_METHODS} SELECT 'dir EXCEPT zip' AS cmp, source_file FROM (SELECT source_file FROM dir EXCEPT SELECT source_file FROM zip)
 UNION ALL SELECT 'zip EXCEPT dir', source_file FROM (SELECT source_file FROM zip EXCEPT SELECT source_file FROM dir)""",
    "fact_except": f"""{_METHODS} SELECT 'dir EXCEPT zip' AS cmp, * FROM (SELECT * FROM dir EXCEPT SELECT {", ".join(_N)} FROM zip) UNION ALL SELECT 'zip EXCEPT dir', * FROM (SELECT * FROM zip EXCEPT SELECT * FROM dir)""",
    "methods_agree": f"{_METHODS} SELECT 'ok: dir, zip, tar agree' AS status FROM dir HAVING count(*) > 0",
    "methods_disagree": f"""{_METHODS}, all_facts AS (SELECT count(*) AS n FROM base), changed AS (SELECT * FROM base WHERE fact_ord % 89 = 0)
 SELECT 'count' AS route, 'row-count mismatch: dir=' || (SELECT n FROM all_facts) || ', zip=' || (SELECT count(*) FROM base WHERE fact_ord % 97 <> 0) AS status
 UNION ALL SELECT 'files', CASE WHEN (SELECT count(DISTINCT source_file) FROM base) <> (SELECT count(DISTINCT CASE WHEN fact_ord % 89 = 0 THEN source_file || '.x' ELSE source_file END) FROM base) THEN 'distinct source_file count mismatch' ELSE 'source_file set mismatch' END
 UNION ALL SELECT 'facts', 'fact EXCEPT mismatch (' || ((SELECT count(*) FROM (SELECT {", ".join(_N)} FROM base EXCEPT SELECT {_CHANGED} FROM base)) + (SELECT count(*) FROM (SELECT {_CHANGED} FROM base EXCEPT SELECT {", ".join(_N)} FROM base))) || ' rows)'""",
    "soft_fact_pairs": f"{_SIDES} SELECT {_KEY}, oracle_value, extract_value, value_match FROM paired WHERE in_o AND in_x",
    "facts_only_left": f"{_SIDES} SELECT {_KEY}, oracle_value AS value FROM paired WHERE NOT in_x",
    "facts_only_right": f"{_SIDES} SELECT {_KEY}, extract_value AS value FROM paired WHERE NOT in_o",
    "concepts_only": f"{_SIDES} SELECT concept, CASE WHEN in_o THEN 'oracle' ELSE 'extract' END AS side FROM concepts WHERE in_o <> in_x",
    "facts_summary": f"""{_SIDES} SELECT count(*) FILTER (WHERE in_o) AS oracle_facts, count(*) FILTER (WHERE in_x) AS extract_facts, (SELECT count(*) FROM concepts WHERE in_o) AS oracle_concepts, (SELECT count(*) FROM concepts WHERE in_x) AS extract_concepts,
 (SELECT count(*) FROM concepts WHERE NOT in_x) AS concepts_only_oracle, (SELECT count(*) FROM concepts WHERE NOT in_o) AS concepts_only_extract, count(*) FILTER (WHERE in_o AND in_x) AS paired_facts, count(*) FILTER (WHERE in_o AND in_x AND value_match) AS soft_value_matches,
 count(*) FILTER (WHERE in_o AND in_x AND NOT value_match) AS soft_value_mismatches, count(*) FILTER (WHERE NOT in_x) AS facts_only_oracle, count(*) FILTER (WHERE NOT in_o) AS facts_only_extract FROM paired""",
    "grain_pivot": f"{_WIDE} SELECT * FROM e",
    "full_outer_cells": f"{_CELLS} SELECT col, kind, has_oracle, has_extract, count(*) AS n, count(o_val) AS n_oracle, count(e_val) AS n_extract FROM cells GROUP BY ALL",
    "cell_diffs": f"{_CELLS} SELECT * FROM diffs",
    "release_check": f"""WITH base AS ({FACTS}), a AS (SELECT {", ".join(_N)} FROM base), b AS (SELECT {", ".join(_N)} FROM base WHERE fact_ord % 101 <> 0 UNION ALL SELECT {", ".join(_N)} FROM base WHERE fact_ord % 103 = 0),
d AS (SELECT 'before' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'after', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT *, count(*) AS n FROM d GROUP BY ALL""",
    "file_map_join": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || o_orderkey END AS source_file FROM orders",
    "totals": f"""{_CELLS} SELECT (SELECT count(*) FROM ow)::BIGINT AS oracle_rows, (SELECT count(*) FROM e)::BIGINT AS extract_rows, count(*) FILTER (WHERE has_oracle AND has_extract)::BIGINT AS paired_rows, count(*) FILTER (WHERE has_oracle AND NOT has_extract)::BIGINT AS oracle_only_rows,
 count(*) FILTER (WHERE has_extract AND NOT has_oracle)::BIGINT AS extract_only_rows, (SELECT count(*) FROM diffs WHERE kind = 'must')::BIGINT AS must_mismatches, (SELECT count(*) FROM diffs WHERE kind = 'observe')::BIGINT AS observe_mismatches,
 (SELECT count(*) FROM unmet)::BIGINT AS oracle_only_must_rows, (SELECT count(DISTINCT source_file) FROM base)::BIGINT AS files FROM pairs""",
    "per_file_counts": f"""{_CELLS}, counted AS (SELECT {_BASE_NAME} AS source_file, NULL AS what FROM base UNION ALL SELECT source_file, 'o' FROM ow UNION ALL SELECT source_file, 'e' FROM e UNION ALL SELECT source_file, 'm' || kind FROM diffs
 UNION ALL SELECT source_file, CASE WHEN has_oracle AND has_extract THEN 'both' WHEN has_oracle THEN 'only' WHEN has_extract THEN 'extract' END FROM pairs UNION ALL SELECT source_file, 'unmet' FROM unmet),
n AS (SELECT source_file, {", ".join(f"count(*) FILTER (WHERE {w}) AS {c}" for c, w in {"oracle_rows": "what = 'o'", "extract_rows": "what = 'e'", "paired_rows": "what = 'both'", "oracle_only_rows": "what = 'only'", "extract_only_rows": "what = 'extract'", "must_mismatches": "what = 'mmust'", "observe_mismatches": "what = 'mobserve'", "oracle_only_must_rows": "what = 'unmet'"}.items())}
 FROM counted GROUP BY source_file)
SELECT *, CASE WHEN least(oracle_rows, extract_rows) = 0 THEN 'ERROR' WHEN must_mismatches > 0 THEN 'FAIL' WHEN observe_mismatches + oracle_only_rows + extract_only_rows > 0 THEN 'OK_SOFT' ELSE 'OK' END AS status FROM n""",
}
ORACLE_SQL["run_status"] = f"SELECT CASE WHEN count(*) = 0 THEN 'ERROR' WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'OK_SOFT') THEN 'OK_SOFT' ELSE 'OK' END AS status FROM ({ORACLE_SQL['per_file_counts']}) WHERE status <> 'ERROR'"
