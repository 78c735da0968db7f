"""Plans and steps whose cost must not grow past the input, or land on the driver or on one task."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from filingspark.functions.dates import parts_of
from filingspark.operators import compare as C
from filingspark.operators import parser
from filingspark.operators import taxonomy as X
from filingspark.plans import containers, scalars
from filingspark.plans import facts as plan_facts
from filingspark.plans.facts import spread
from filingspark.schemas import FACT
from filingspark.sources import datasource, tables
from filingspark.sources.datasource import FilingsReader, read_filings


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routes_meet_without_a_join(spark):
    frame = lambda *files: spark.createDataFrame([(f,) for f in files], "source_file string")
    methods = {"dir": frame("a", "a", None, "b"), "zip": frame("a", None, "c"), "tar": frame("a", "b", "b", None)}
    got = C.source_file_except(methods)
    assert "Join" not in plan_of(got) and plan_of(got).count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in got.collect()) == [("dir EXCEPT zip", "b"), ("zip EXCEPT dir", "c")]


def test_release_check_is_one_shuffle(spark):
    fact = lambda v: ("2023-01-01", "2023-12-31", "A", v, "", None, "", "f.html", "")
    runs = [spark.createDataFrame([fact(v) for v in vs], FACT) for vs in (["1", "1", "1", None, "2"], ["1", "2", "3", "3"])]
    got = C.release_check(*runs)
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    assert sorted(((r.side, r.value, r.n) for r in got.collect()), key=str) == [("after", "3", 2), ("before", "1", 2), ("before", None, 1)]


def test_spread_follows_the_size(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(plan_facts, "SPREAD_BYTES", 100)
    assert spread(table).rdd.getNumPartitions() > 40 and spread(table).count() == 1000
    assert "hashpartitioning" in plan_of(spread(table))


def soft_side(spark, rows):
    return spark.createDataFrame(rows, "source_file string, concept string, period_start string, period_end string, value_soft string")


def test_facts_pair_by_one_shuffle(spark):
    key = ("f", "A", "", "")
    a = soft_side(spark, [(*key, v) for v in "cab"] + [("f", "B", "", "", "1"), (None, "A", "", "", "n")])
    b = soft_side(spark, [(*key, v) for v in "ba"] + [("f", "C", "", "", "2"), (None, "A", "", "", "n")])
    paired, left, summary = C.pairs(a, b), C.only_facts(a, b), C.facts_summary(a, b)
    for df in (paired, left):
        assert plan_of(df).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(df)
    assert plan_of(summary).count("Exchange hashpartitioning") == 2  # the other one is of counts by concept
    assert sorted(tuple(r)[4:] for r in paired.collect()) == [("a", "a", True), ("b", "b", True)]
    assert sorted((r.source_file, r.concept, r.value) for r in left.where("source_file IS NOT NULL").collect()) == [("f", "A", "c"), ("f", "B", "1")]
    assert left.where("source_file IS NULL").first().value == "n"
    assert tuple(summary.first()) == (5, 4, 2, 2, 1, 1, 2, 2, 0, 3, 2)


def test_concepts_of_both_sides_at_once(spark):
    a, b = (spark.createDataFrame([(c,) for c in cs], "concept string") for cs in (["A", "A", "", "B"], ["B", "C"]))
    got = C.concept_sides({"oracle": a, "extract": b})
    assert "Join" not in plan_of(got)
    assert sorted(tuple(r) for r in got.collect()) == [("A", "oracle"), ("C", "extract")]


def test_conflicts_do_not_multiply_rows(spark):
    row = lambda at, **kw: (at, "urn:t", "Item", *(kw.get(f, "x") for f in X.FIELDS))
    two = spark.createDataFrame([row("a", balance=None, nillable=None), row("b", balance="", nillable="true"), row("c", abstract="y")], X.LOCATED)
    got = X.conflicts(two)
    assert "Expand" not in plan_of(got) and plan_of(got).count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in got.collect()] == [("urn:t", "Item", ",".join(f for f in X.FIELDS if f in ("abstract", "balance", "nillable")), ["a", "c"])]


def test_fact_files_have_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 10)
    facts = spark.createDataFrame([("", "", "A", str(i), "", "", "", "f.html", "") for i in range(95)], FACT).coalesce(1)
    tables.write_facts(facts, str(tmp_path / "f"))
    assert len(list((tmp_path / "f").glob("part-*"))) == 10
    assert tables.read_facts(spark, str(tmp_path / "f")).count() == 95
    tables.write_facts(facts, str(tmp_path / "one"), single=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_many_archives_are_read_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(containers, "ARCHIVE_BYTES", 2000)
    members = spark.createDataFrame([(f"f{i:03}.html", b"<html/>" * 100) for i in range(50)], "name string, content binary").coalesce(1)
    paths = containers._written(members, containers._zip, ".zip")
    assert len(paths) == 17
    reader = FilingsReader({"paths": json.dumps(paths)})
    assert [(w.kind, w.source, w.entries) for w in reader.partitions()] == [("whole", p, ()) for p in paths]
    got = read_filings(spark, paths)
    assert sorted((r.source_file, bytes(r.content)) for r in got.collect()) == [(f"f{i:03}.html", b"<html/>" * 100) for i in range(50)]
    assert read_filings(spark, []).count() == 0


def test_rows_go_out_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(datasource, "BATCH_BYTES", 100)
    rows = [("a", b"x" * 60, None, False), ("b", None, "broken", True), ("c", b"x" * 60, None, False), ("d", b"", None, None)]
    out = list(datasource.batched(iter(rows)))
    assert [b.num_rows for b in out] == [3, 1] and [tuple(r.values()) for b in out for r in b.to_pylist()] == rows


def test_folders_of_another_readers_tables(spark, tmp_path):
    tables_of = {"a/x.csv": 'Dec,Name,Value,End/Instant,Start\n0,core:A,"1,5 ""q""",2020-12-31,\n\n0,core:B\n', "a/y+ z.csv": "Start,Value,Name,End/Instant\ns,v,n,e,more\n", "b/none.csv": "", "b/not.txt": "x"}
    for name, text in tables_of.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = tables.read_other_reader_folders(spark, [str(tmp_path / d) for d in "ab"])
    assert got.columns == [*tables.OTHER_READER, "source_file"] and "FileScan" not in plan_of(got)
    assert sorted(tuple(r) for r in got.collect()) == [("core:A", '1,5 "q"', "", "2020-12-31", "x"), ("core:B", "", "", "", "x"), ("n", "v", "s", "e", "y+ z")]
    (tmp_path / "a/x.csv").write_text("Name,Value\n")
    with pytest.raises(Exception, match="no column Start, End/Instant"):
        got.collect()


def test_dates_are_transformed_once_a_day(spark):
    got = scalars.date_formats(spark, "/root/testdata/sf0.001")
    assert "Join" in plan_of(got)  # of the orders with the days' values
    assert got.count() == 44 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_a_text_that_no_pattern_matches_has_no_parts(spark):
    texts = spark.createDataFrame([("1/2/2020",), ("\x011/2/2020",), ("\x012020/2/1",), ("1/2",), (None,)], "t string")
    assert [r.p for r in texts.select(parts_of("dateslasheu", F.col("t")).alias("p")).collect()] == ["2020/2/1", None, None, None, None]


def test_each_side_of_per_file_is_computed_once(spark):
    names = ["source_file", *C.COMPARED, "period_start", "period_end"]
    kinds = {c: "string" for c in names} | {"period_start": "date", "period_end": "date"}
    day = datetime.date(2020, 1, 1)
    wide = lambda *rows: spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
    row = lambda f, d, **kw: {"source_file": f, "period_end": d, "company_id": "1", **kw}
    column = C.COMPARED[-1]
    oracle = wide(row("f", day, **{column: "1"}), row("f", day, **{column: "2"}), row("f", None, **{column: "3"}), row("gone", day))
    own = wide(row("f", day, **{column: "1"}), {"source_file": "f"})
    files = spark.createDataFrame([("f",), ("f",), ("none",)], "source_file string")
    got = C.per_file(files, oracle, own, {column: "must"})
    assert "Join" not in plan_of(got)
    found = {r.source_file: tuple(r)[1:] for r in got.collect()}
    # of three rows of the oracle two meet the dated row, one of them with another value; the row without
    # a period meets one that is not known, so it stands alone
    assert found == {"f": (3, 2, 2, 1, 0, 1, 0, 1), "none": (0,) * 8}


def test_undeclared_entities_do_not_need_the_tolerant_reader():
    head = b'<!DOCTYPE html><html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:c="urn:c"><body title="&nbsp;">'
    fact = lambda text, note=b"": b"<p>&pound;<b>&nosuch;</b></p><ix:nonNumeric name='c:A' contextRef='" + note + b"'>" + text + b"</ix:nonNumeric></body></html>"
    for text in (b"a&nbsp;b", b"&nosuch; &amp;amp; &#163;&pound;&alefsym;", b"<![CDATA[&nbsp;]]>&Eacute;\r\n&eacute;", b"<!-- &nbsp; -->x&a.b-c;"):
        for note in (b"", b"&nbsp;&lt;&x;"):
            found = parser.read_well_formed(head + fact(text, note))
            assert found is not None and found == parser.read_tolerant(head + fact(text, note))
    for broken in (b"&nbsp", b"&;", b"&1;", b"& x"):
        assert parser.read_well_formed(head + fact(broken)) is None


def test_agreement_does_not_broadcast_facts(spark):
    frame = lambda *files: spark.createDataFrame([("", "", "A", "1", "", "", "", f, "") for f in files], FACT)
    got = C.agreement({"dir": frame("a"), "zip": frame("a")})
    assert "LeftAnti" not in plan_of(got) and got.first().status == "ok: dir, zip agree"
