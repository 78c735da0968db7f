"""Comparing extracts: the same facts by different routes, facts against another reader's facts,
and wide rows against another source's wide rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingspark import fixed_values
from filingspark.functions import soft
from filingspark.functions.text import base_name, company_number, is_plain_dimension, non_empty
from filingspark.operators.transform import small
from filingspark.schemas import FACT

# -- the same facts by different routes ------------------------------------------------------------


def method_counts(methods: dict[str, DataFrame]) -> DataFrame:
    """method, n, files."""
    each = (df.agg(F.lit(name).alias("method"), F.count(F.lit(1)).alias("n"), F.count_distinct("source_file").alias("files")) for name, df in methods.items())
    return reduce(DataFrame.unionByName, each)


def _both_ways(methods: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Rows of the first route that another lacks, and the other way round, as sets. All routes are
    read once and meet in one aggregate of a bit a route, so no side is sent to the driver."""
    (first, base), *others = methods.items()
    routes = [base, *(df for _, df in others)]
    rows = reduce(DataFrame.unionByName, (df.select(*columns, F.lit(1 << i).cast("long").alias("_in")) for i, df in enumerate(routes)))
    met = rows.groupBy(*columns).agg(F.bit_or("_in").alias("_in")).where(F.col("_in") != (1 << len(routes)) - 1)
    has = lambda i: F.col("_in").bitwiseAND(F.lit(1 << i).cast("long")) != 0
    cmps = [F.when(has(x) & ~has(y), F.lit(f"{a} EXCEPT {b}")) for i, (name, _) in enumerate(others, 1) for a, x, b, y in ((first, 0, name, i), (name, i, first, 0))]
    return met.select(F.explode(F.array_compact(F.array(*cmps))).alias("cmp"), *columns)


def source_file_except(methods: dict[str, DataFrame]) -> DataFrame:
    return _both_ways(methods, ["source_file"])


def fact_except(methods: dict[str, DataFrame]) -> DataFrame:
    return _both_ways(methods, FACT.names)


def agreement(methods: dict[str, DataFrame]) -> DataFrame:
    """One row, `status`: ok, or how the routes differ - in counts, else in files, else in facts."""
    counts = method_counts(methods).agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("files").alias("f0"), F.max("files").alias("f1"),
        F.array_join(F.array_sort(F.collect_list(F.concat("method", F.lit("="), "n"))), ", ").alias("list"),
    )
    files = source_file_except(methods).agg(F.count(F.lit(1)).alias("files_off"), F.min(F.concat_ws(":", "cmp", "source_file")).alias("file"))
    facts = fact_except(methods).agg(F.count(F.lit(1)).alias("facts_off"), F.min(F.concat_ws(" ", "cmp", "source_file", "concept")).alias("fact"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    status = (
        F.when((F.col("n0") != F.col("n1")) | (F.col("n0") < 1), text("row-count mismatch: ", F.col("list")))
        .when((F.col("f0") != F.col("f1")) | (F.col("f0") < 1), F.lit("distinct source_file count mismatch"))
        .when(F.col("files_off") > 0, text("source_file set mismatch: ", F.col("file")))
        .when(F.col("facts_off") > 0, text("fact EXCEPT mismatch (", F.col("facts_off").cast("string"), " rows). first: ", F.col("fact")))
        .otherwise(text("ok: ", ", ".join(methods), " agree"))
    )
    return counts.crossJoin(files).crossJoin(facts).select(status.alias("status"))  # three single rows


def assert_agree(methods: dict[str, DataFrame]) -> DataFrame:
    """One row, `status`; evaluating it fails if counts, files or facts differ."""
    status = F.col("status")
    return agreement(methods).select(F.when(status.startswith("ok: "), status).otherwise(F.raise_error(status).cast("string")).alias("status"))


# -- facts against another reader's ----------------------------------------------------------------

PAIR_KEYS = ["source_file", "concept", "period_start", "period_end"]


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def oracle_facts(raw: DataFrame, source_file: str | None = None) -> DataFrame:
    """PAIR_KEYS and value_soft of another reader's table (Name, Value, Start, End/Instant); an
    instant is both ends. The file is the one given, or the table's column source_file."""
    end = F.trim(F.coalesce(F.col("`End/Instant`").cast("string"), F.lit("")))
    concept = F.substring_index(_text("Name"), ":", -1)
    file = base_name(F.col("source_file")) if source_file is None else F.lit(source_file)
    start = F.coalesce(non_empty(F.col("Start").cast("string")), end)
    out = raw.select(file.alias("source_file"), concept.alias("concept"), start.alias("period_start"), end.alias("period_end"), soft.soft_value(F.col("Value"), True).alias("value_soft"))
    return out.where("concept != ''")


def own_facts(facts: DataFrame, source_file: str | None = None) -> DataFrame:
    """The same columns of long facts, of one file if given."""
    file = base_name(F.col("source_file"))
    rows = facts if source_file is None else facts.where(file == source_file)
    return rows.select(file.alias("source_file"), *(_text(k).alias(k) for k in PAIR_KEYS[1:]), soft.soft_value(F.col("value"), True).alias("value_soft"))


def only_concepts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concepts of a that b lacks."""
    return concept_sides({"a": a, "b": b}).where("side = 'a'").select("concept")


def concept_sides(sides: dict[str, DataFrame]) -> DataFrame:
    """concept, side: concepts of either of two sides that the other lacks."""
    named = {name: df.where("concept != ''") for name, df in sides.items()}
    return _both_ways(named, ["concept"]).select("concept", F.substring_index("cmp", " EXCEPT ", 1).alias("side"))


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """PAIR_KEYS, a and b: the values of both sides of a file, concept and period, each in order, so
    that pairs of equal keys meet by place. Both sides are dealt once, together; the file is in the
    key, so no array holds more than one filing's facts. Facts without a file meet none."""
    rows = a.select(*PAIR_KEYS, F.lit(True).alias("_a"), "value_soft").unionByName(b.select(*PAIR_KEYS, F.lit(False).alias("_a"), "value_soft"))
    apart = F.when(F.col("source_file").isNull(), F.col("_a")).alias("_apart")
    side = lambda own, name: F.array_sort(F.collect_list(F.when(own, F.col("value_soft")))).alias(name)
    return rows.select("*", apart).repartition(*PAIR_KEYS).groupBy(*PAIR_KEYS, "_apart").agg(side(F.col("_a"), "a"), side(~F.col("_a"), "b"))


def _in_pairs(both: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each place that a side has: PAIR_KEYS, the values, and in_a and in_b."""
    n = F.greatest(F.size("a"), F.size("b"))
    rows = both.select(*PAIR_KEYS, "a", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select(*PAIR_KEYS, F.get("a", F.col("i")).alias(a), F.get("b", F.col("i")).alias(b), (F.col("i") < F.size("a")).alias("in_a"), (F.col("i") < F.size("b")).alias("in_b"))


def pairs(oracle: DataFrame, own: DataFrame) -> DataFrame:
    rows = _in_pairs(met(oracle, own).where((F.size("a") > 0) & (F.size("b") > 0)), "oracle_value", "extract_value").where("in_a AND in_b")
    return rows.select(*PAIR_KEYS, "oracle_value", "extract_value", soft.soft_equal(F.col("oracle_value"), F.col("extract_value"), reported=True).alias("value_match"))


def only_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts of a without a partner in b. Of b only the number of facts counts."""
    rows = a.select(*PAIR_KEYS, "value_soft").unionByName(b.select(*PAIR_KEYS, F.lit(None).cast("string").alias("value_soft")).where("source_file IS NOT NULL"))
    both = rows.repartition(*PAIR_KEYS).groupBy(*PAIR_KEYS).agg(F.array_sort(F.collect_list("value_soft")).alias("a"), F.count_if(F.col("value_soft").isNull()).cast("int").alias("n"))
    left = both.where(F.size("a") > F.col("n"))
    return left.select(*PAIR_KEYS, F.explode(F.slice("a", F.col("n") + 1, F.size("a") - F.col("n"))).alias("value"))


def facts_summary(oracle: DataFrame, own: DataFrame) -> DataFrame:
    """Counts of both sides, of pairs and of what is left over, one row. Each side is read and dealt
    once; the pairs are counted by concept, then in all."""
    in_o, in_x = F.col("in_a"), F.col("in_b")
    match = soft.soft_equal(F.col("o"), F.col("x"), reported=True)
    kinds = {"n_o": in_o, "n_x": in_x, "both": in_o & in_x, "same": in_o & in_x & match, "differ": in_o & in_x & ~match, "only_o": in_o & ~in_x, "only_x": in_x & ~in_o}
    by_concept = _in_pairs(met(oracle, own), "o", "x").groupBy("concept").agg(*(F.count_if(c).alias(k) for k, c in kinds.items()))
    total = lambda k: F.coalesce(F.sum(k), F.lit(0))
    named = F.col("concept") != ""
    return by_concept.agg(
        total("n_o").alias("oracle_facts"), total("n_x").alias("extract_facts"), F.count_if(F.col("n_o") > 0).alias("oracle_concepts"), F.count_if(F.col("n_x") > 0).alias("extract_concepts"),
        F.count_if(named & (F.col("n_x") == 0)).alias("concepts_only_oracle"), F.count_if(named & (F.col("n_o") == 0)).alias("concepts_only_extract"),
        total("both").alias("paired_facts"), total("same").alias("soft_value_matches"), total("differ").alias("soft_value_mismatches"), total("only_o").alias("facts_only_oracle"), total("only_x").alias("facts_only_extract"),
    )


# -- wide rows against another source's ------------------------------------------------------------

_COLUMNS = fixed_values.rows(fixed_values.COLUMN_MAP)
GENERAL = list(dict.fromkeys(r["column_name"] for r in _COLUMNS if r["grain"] == "general"))
PERIODICAL = list(dict.fromkeys(r["column_name"] for r in _COLUMNS if r["grain"] == "periodical"))
COMPARED = ["company_id", *GENERAL, *PERIODICAL]
FILE_KEYS = ["source_file", "company_id"]
PERIOD_KEYS = [*FILE_KEYS, "period_start", "period_end"]


def column_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r["column_name"], r["concept"], int(r["priority"]), r["grain"], r["transform"]) for r in _COLUMNS], "column_name string, concept string, priority int, grain string, transform string")


def compare_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r["column_name"], r["kind"]) for r in fixed_values.rows(fixed_values.COMPARE_SPEC)], "column_name string, kind string")


def transformed(value: Column, transform: Column) -> Column:
    """The map's transforms: a negated boolean, a magnitude, or the value."""
    low = F.lower(value)
    number = soft.to_double(F.translate(value, ",", ""))
    return (
        F.when((transform == "not_bool") & (low == "true"), F.lit("false"))
        .when((transform == "not_bool") & (low == "false"), F.lit("true"))
        .when((transform == "abs") & number.isNotNull(), F.abs(number).cast("string"))
        .otherwise(value)
    )


def mapped_columns(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts with an order (fact_ord) joined to the columns they feed. Columns of general grain take
    dimensional facts too."""
    rows = facts.select(
        "fact_ord",
        base_name(F.col("source_file")).alias("source_file"),
        company_number(F.col("source_file")).alias("company_id"),
        soft.to_date(F.col("period_start")).alias("period_start"),
        soft.to_date(F.col("period_end")).alias("period_end"),
        F.trim("concept").alias("concept"),
        non_empty(F.col("value")).alias("value"),
        F.trim(F.coalesce("dimensions", F.lit(""))).alias("dimensions"),
    )
    joined = rows.where("value IS NOT NULL").join(small(mapping), "concept").where((F.col("grain") == "general") | is_plain_dimension(F.col("dimensions")))
    return joined.select("fact_ord", *PERIOD_KEYS, "column_name", "priority", "grain", transformed(F.col("value"), F.col("transform")).alias("value"))


def first_values(mapped: DataFrame) -> DataFrame:
    """Per file and column - and period, for columns of periodical grain - the first value by
    priority, then by place. The period of a general column's value is null.

    Rows are dealt by file and company once; the rank, and what later groups by them, stays there."""
    periodical = F.col("grain") == "periodical"
    rows = mapped.withColumns({c: F.when(periodical, F.col(c)) for c in ("period_start", "period_end")}).repartition(*FILE_KEYS)
    order = Window.partitionBy(*PERIOD_KEYS, "grain", "column_name").orderBy("priority", "fact_ord")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def extract_wide(facts: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Wide rows per file, company and period; a file with general columns alone has one row
    without a period. Without a company number a row keeps its file alone, as nothing joins on a
    missing number: such a file has a row per period, and one more if it has general columns."""
    best = first_values(mapped_columns(facts, mapping if mapping is not None else column_map(facts.sparkSession)))
    values = best.groupBy(*PERIOD_KEYS, "grain").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "value"))).alias("m"))
    general = F.col("grain") == "general"
    entry = F.struct("period_start", "period_end", "m")
    files = values.groupBy(*FILE_KEYS).agg(F.collect_list(F.when(~general, entry)).alias("periods"), F.first(F.when(general, F.col("m")), True).alias("general"))
    named = F.col("company_id").isNotNull()
    bare = F.transform("periods", lambda x: F.struct(x["period_start"].alias("period_start"), x["period_end"].alias("period_end")))
    none = F.array(F.struct(F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end")))
    n_rows = F.when(named, F.greatest(F.size("periods"), F.lit(1))).otherwise(F.size(F.array_distinct(F.when(F.col("general").isNotNull(), F.concat(bare, none)).otherwise(bare))))
    rows = files.select(*FILE_KEYS, F.when(named, F.col("general")).alias("g"), F.when(named, F.col("periods")).alias("periods"), F.explode(F.sequence(F.lit(0), n_rows - 1)).alias("i")).withColumn("p", F.get("periods", F.col("i")))
    return rows.select(
        *FILE_KEYS,
        *(F.try_element_at("g", F.lit(c)).alias(c) for c in GENERAL),
        F.col("p.period_start").alias("period_start"),
        F.col("p.period_end").alias("period_end"),
        *(F.try_element_at("p.m", F.lit(c)).alias(c) for c in PERIODICAL),
    )


def paired_rows(oracle: DataFrame, own: DataFrame) -> DataFrame:
    """Full outer join of wide rows by file and period; columns of each side under o_ and e_."""
    names = ["period_start", "period_end", *COMPARED]
    o = oracle.select(F.col("source_file").alias("o_source_file"), *(F.col(c).alias(f"o_{c}") for c in names))
    e = own.select(F.col("source_file").alias("e_source_file"), *(F.col(c).alias(f"e_{c}") for c in names))
    on = (F.col("o_source_file") == F.col("e_source_file")) & F.col("o_period_start").eqNullSafe(F.col("e_period_start")) & F.col("o_period_end").eqNullSafe(F.col("e_period_end"))
    some = lambda side, cols: reduce(lambda a, b: a | b, (F.col(f"{side}_{c}").isNotNull() for c in cols))
    return o.join(e, on, "full").select(
        F.coalesce("o_source_file", "e_source_file").alias("source_file"),
        some("o", ("companies_house_registered_number", "period_start", "period_end", "company_id")).alias("has_oracle"),
        some("e", ("company_id", "period_start", "period_end")).alias("has_extract"),
        *(F.col(f"{s}_{c}") for c in names for s in "oe"),
    )


def cells(paired: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    """One row per compared column of a pair: col, o_val, e_val, kind."""
    spec = spec if spec is not None else compare_spec(paired.sparkSession)
    either = lambda c: F.coalesce(F.col(f"o_{c}").cast("string"), F.col(f"e_{c}").cast("string"), F.lit("")).alias(c)
    values = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"o_{c}").cast("string").alias("o_val"), F.col(f"e_{c}").cast("string").alias("e_val")) for c in COMPARED))
    rows = paired.select("source_file", either("period_start"), either("period_end"), "has_oracle", "has_extract", F.inline(values))
    return rows.join(small(spec), rows["col"] == spec["column_name"]).drop("column_name")


def _differs(kind: Column, o: Column, e: Column) -> Column:
    """A cell counts: must columns where the oracle has a value, observed columns where both have
    one, unless the values are softly equal."""
    counts = ((kind == "must") & ~soft.empty_value(o)) | ((kind == "observe") & ~soft.empty_value(o) & ~soft.empty_value(e))
    return counts & ~soft.soft_equal(o, e, wide=True)


def cell_diffs(cell: DataFrame) -> DataFrame:
    """Cells of paired rows that differ."""
    return cell.where(F.col("has_oracle") & F.col("has_extract") & _differs(F.col("kind"), F.col("o_val"), F.col("e_val"))).select("source_file", "period_start", "period_end", "col", "o_val", "e_val", "kind")


def oracle_only_must(cell: DataFrame) -> DataFrame:
    return cell.where(F.col("has_oracle") & ~F.col("has_extract") & (F.col("kind") == "must") & ~soft.empty_value(F.col("o_val"))).select("source_file", "period_start", "period_end").distinct()


def per_file(files: DataFrame, oracle: DataFrame, own: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Counts per file of rows, pairs, leftovers and mismatches; files without any have zeros. kinds:
    how each column counts. Each side is computed once and dealt by file with the other; the rows of
    a file, as many as it has periods, meet in arrays, so neither rows nor cells are exploded."""
    kinds = kinds or {r["column_name"]: r["kind"] for r in fixed_values.rows(fixed_values.COMPARE_SPEC)}
    columns = {kind: [c for c in COMPARED if kinds.get(c) == kind] for kind in ("must", "observe")}
    known = {True: ("companies_house_registered_number", "period_start", "period_end", "company_id"), False: ("company_id", "period_start", "period_end")}

    def rows(df: DataFrame, is_oracle: bool) -> DataFrame:
        texts = lambda kind: F.array(*(F.col(c).cast("string") for c in columns[kind])).cast("array<string>").alias(kind)
        has = reduce(lambda x, y: x | y, (F.col(c).isNotNull() for c in known[is_oracle]))
        return df.select("source_file", F.lit(is_oracle).alias("_o"), F.struct("period_start", "period_end", has.alias("known"), texts("must"), texts("observe")).alias("_row"))

    o, e = rows(oracle, True), rows(own, False)
    named = files.select("source_file").distinct().select("source_file", F.lit(None).cast("boolean").alias("_o"), F.lit(None).cast(o.schema["_row"].dataType).alias("_row"))
    side = lambda own_side, name: F.collect_list(F.when(own_side, F.col("_row"))).alias(name)
    met = o.unionByName(e).unionByName(named).repartition("source_file").groupBy("source_file").agg(F.bool_or(F.col("_o").isNull()).alias("_named"), side(F.col("_o"), "o"), side(~F.col("_o"), "e")).where("_named")

    same_period = lambda x, y: x["period_start"].eqNullSafe(y["period_start"]) & x["period_end"].eqNullSafe(y["period_end"])
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    without = lambda a, b: F.filter(a, lambda x: ~F.exists(b, lambda y: same_period(x, y)))
    met = met.select("source_file", F.size("o").alias("oracle_rows"), F.size("e").alias("extract_rows"),
        F.flatten(F.transform("o", lambda x: F.transform(F.filter("e", lambda y: same_period(x, y)), lambda y: pair(x, y)))).alias("pairs"),
        without("o", "e").alias("o_alone"), without("e", "o").alias("e_alone"))

    def mismatches(kind: str, p: Column) -> Column:
        return F.size(F.filter(F.arrays_zip(p["x"][kind].alias("o"), p["y"][kind].alias("e")), lambda c: _differs(F.lit(kind), c["o"], c["e"]))) if columns[kind] else F.lit(0)

    both = F.filter("pairs", lambda p: p["x"]["known"] & p["y"]["known"])
    oracle_only = F.concat(F.transform(F.filter("pairs", lambda p: p["x"]["known"] & ~p["y"]["known"]), lambda p: p["x"]), F.filter("o_alone", lambda x: x["known"]))
    extract_only = F.size(F.filter("pairs", lambda p: p["y"]["known"] & ~p["x"]["known"])) + F.size(F.filter("e_alone", lambda y: y["known"]))
    must = F.filter(oracle_only, lambda x: F.exists(x["must"], lambda v: ~soft.empty_value(v)))
    total = lambda kind: F.aggregate(both, F.lit(0).cast("long"), lambda n, p: n + mismatches(kind, p))
    count = lambda c, name: c.cast("long").alias(name)
    return met.select(
        "source_file", count(F.col("oracle_rows"), "oracle_rows"), count(F.col("extract_rows"), "extract_rows"),
        count(F.size(both), "paired_rows"), count(F.size(oracle_only), "oracle_only_rows"), count(extract_only, "extract_only_rows"),
        count(total("must"), "must_mismatches"), count(total("observe"), "observe_mismatches"),
        count(F.size(F.array_distinct(F.transform(must, lambda x: F.struct(x["period_start"], x["period_end"])))), "oracle_only_must_rows"),
    )


def totals(by_file: DataFrame) -> DataFrame:
    return by_file.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in by_file.columns if c != "source_file"), F.count(F.lit(1)).alias("files"))


def file_status(by_file: DataFrame) -> DataFrame:
    """ERROR without rows on a side, FAIL on a must mismatch, OK_SOFT on an observed one or rows
    without partner, else OK."""
    status = (
        F.when((F.col("oracle_rows") == 0) | (F.col("extract_rows") == 0), "ERROR")
        .when(F.col("must_mismatches") > 0, "FAIL")
        .when((F.col("observe_mismatches") > 0) | (F.col("oracle_only_rows") > 0) | (F.col("extract_only_rows") > 0), "OK_SOFT")
        .otherwise("OK")
    )
    return by_file.withColumn("status", status)


def classify_run(statuses: DataFrame, unmapped_rows: int = 0) -> DataFrame:
    """One row, `status`, of a whole comparison: the worst of its files; ERROR without files, FAIL if
    rows of the oracle belong to no file."""
    has = lambda s: F.count_if(F.col("status") == s) > 0
    worst = F.when(F.count(F.lit(1)) == 0, "ERROR").when(F.lit(unmapped_rows) > 0, "FAIL")
    for s in ("ERROR", "FAIL", "OK_SOFT"):
        worst = worst.when(has(s), s)
    return statuses.agg(worst.otherwise("OK").alias("status"))


def attach_files(oracle: DataFrame, files: DataFrame) -> DataFrame:
    """The other source's rows (company_id, run_code, date, ...) with the source_file they came from,
    by file_map rows (file_company_id, run_code, file_date, source_file); null where none fits."""
    keys = files.select(F.col("file_company_id").alias("_id"), F.col("run_code").alias("_code"), F.col("file_date").cast("date").alias("_date"), "source_file")
    on = (F.trim(oracle["company_id"].cast("string")) == F.col("_id")) & (F.trim(oracle["run_code"].cast("string")) == F.col("_code")) & soft.to_date(oracle["date"].cast("string")).eqNullSafe(F.col("_date"))
    return oracle.join(keys, on, "left").drop("_id", "_code", "_date")


def release_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Facts that two runs do not share, as multisets: side, n, and the facts' columns. A fact's
    surplus is one sum over both runs; rows are dealt first, as a sum before that meets few equal ones."""
    rows = before.select(*FACT.names, F.lit(1).cast("long").alias("n")).unionByName(after.select(*FACT.names, F.lit(-1).cast("long").alias("n")))
    surplus = rows.repartition(*FACT.names).groupBy(*FACT.names).agg(F.sum("n").alias("n")).where("n <> 0")
    return surplus.select(F.when(F.col("n") > 0, "before").otherwise("after").alias("side"), *FACT.names, F.abs("n").alias("n"))
