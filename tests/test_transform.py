import pytest
from pyspark.sql import functions as F

from filingspark import fixed_values
from filingspark.operators import compare as C
from filingspark.operators import taxonomy as X
from filingspark.operators import transform as T
from filingspark.schemas import FACT

SOURCE = "Prod1_2_00000001_20240101.html"


def facts(spark, rows):
    base = {"period_start": "2023-01-01", "period_end": "2023-12-31", "unit": "", "dimensions": "", "namespace": "", "source_file": SOURCE, "decimals": ""}
    return spark.createDataFrame([tuple((base | r)[n] for n in FACT.names) for r in rows], FACT)


def fact(concept, value, **kw):
    return {"concept": concept, "value": value, **kw}


def test_wide_row(spark):
    rows = [
        fact("TurnoverRevenue", "10.005"), fact("TurnoverGrossOperatingRevenue", "99"), fact("EmployeesTotal", "12.5"), fact("EntityDormant", "true"), fact("ApplicableTaxRate", "0.1234567"),
        fact("ProfitLoss", "7"), fact("NetAssetsLiabilities", "5", dimensions='{"a":"b"}'), fact("BalanceSheetDate", "2023-12"), fact("EntityCurrentLegalName", " "), fact("CashBankInHand", "x"),
        fact("Debtors", "1"), fact("Debtors", "2"), fact("Equity", "3", period_end=""), fact("Equity", "3", source_file="readme.html"),
        fact("UKCompaniesHouseRegisteredNumber", "1", period_end="2022-12-31"),
    ]
    wide = {str(r.period_end): r for r in T.accounts_wide(facts(spark, rows)).collect()}
    assert set(wide) == {"2023-12-31", "2022-12-31"}
    r = wide["2023-12-31"]
    assert (str(r.turnover), r.employees, r.company_dormant, str(r.applicable_tax_rate), str(r.profit_before_tax), str(r.profit_for_period), str(r.debtors)) == ("10.01", 13, True, "0.123457", "7.00", "7.00", "2.00")
    assert r.net_assets is None and r.balance_sheet_date is None and r.company_name is None and r.cash is None and r.equity is None
    assert set(wide["2022-12-31"][3:]) == {None}
    assert len(r) == 75 and len(fixed_values.canonicals()) == 72


def test_wide_plan_has_one_shuffle(spark):
    plan = T.accounts_wide(facts(spark, [fact("Debtors", "1")]).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan and "ObjectHashAggregate" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_and_extra_columns(spark):
    empty = facts(spark, []).withColumn("canonical", F.lit("x")).withColumn("priority", F.lit(1))
    assert T.accounts_wide(empty).count() == 0
    assert T.accounts_wide(facts(spark, [fact("Debtors", "1"), fact("Debtors", None)]).withColumn("canonical", F.lit("clash"))).first().debtors == 1


def test_write_wide(spark, tmp_path):
    wide = T.accounts_wide(facts(spark, [fact("Debtors", str(i), source_file=f"Prod1_2_0000000{i}_20240101.html") for i in range(5)]))
    T.write_wide(wide, str(tmp_path / "w"))
    back = spark.read.parquet(str(tmp_path / "w"))
    assert back.count() == 5 and back.schema == wide.schema


def test_another_map(spark):
    other = spark.createDataFrame([("cash", "MyCash", 1, "DECIMAL")], T.MAP_SCHEMA)
    mapped = T.mapped_facts(T.plain_facts(T.typed_facts(facts(spark, [fact("MyCash", "4")]))), other)
    assert T.wide_dynamic(T.best_facts(mapped)).first().cash == "4"


def test_file_status(spark):
    zero = {"oracle_rows": 1, "extract_rows": 1, "paired_rows": 1, "oracle_only_rows": 0, "extract_only_rows": 0, "must_mismatches": 0, "observe_mismatches": 0, "oracle_only_must_rows": 0}
    cases = [({}, "OK"), ({"extract_rows": 0}, "ERROR"), ({"must_mismatches": 1}, "FAIL"), ({"observe_mismatches": 1}, "OK_SOFT"), ({"oracle_only_rows": 1}, "OK_SOFT")]
    df = spark.createDataFrame([(str(i), *(zero | c).values()) for i, (c, _) in enumerate(cases)], "source_file string, " + ", ".join(f"{k} bigint" for k in zero))
    assert [r.status for r in C.file_status(df).orderBy("source_file").collect()] == [s for _, s in cases]
    from filingspark.cli import batch_report

    assert "| 2 | FAIL |" in batch_report(C.file_status(df))


XSD = b"""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:i="http://www.xbrl.org/2003/instance" xmlns:xbrldt="http://xbrl.org/2005/xbrldt" xmlns="urn:d" targetNamespace="urn:t">
<xs:element name="Item" type="i:monetaryItemType" substitutionGroup="i:item" i:periodType="instant" i:balance="%s" nillable="true" abstract="false"/>
<xs:element name="Tuple" substitutionGroup="i:tuple"><xs:complexType><xs:element name="Inner" substitutionGroup="i:item"/></xs:complexType></xs:element>
<xs:element name="Cube" substitutionGroup="xbrldt:hypercubeItem"/><xs:element name="Plain" type="own"/></xs:schema>"""


def schemas(spark, *files):
    return X.concepts(spark.createDataFrame(list(files), "location string, content binary"))


def test_taxonomy(spark):
    one = schemas(spark, ("a", XSD % b"debit"), ("b", XSD % b"debit"))
    rows = X.sorted_rows(X.merge(one))
    assert [r[:2] for r in rows] == [["urn:t", "Item"], ["urn:t", "Tuple"]]
    assert rows[0][2:] == ["false", "http://www.xbrl.org/2003/instance", "monetaryItemType", "http://www.xbrl.org/2003/instance", "item", "instant", "debit", "true"]
    two = schemas(spark, ("a", XSD % b"debit"), ("b", XSD % b"credit"))
    assert [tuple(r)[:3] for r in X.conflicts(two).collect()] == [("urn:t", "Item", "balance")]
    with pytest.raises(Exception, match="conflict on .urn:t.Item: balance"):
        X.merge(two).collect()
    with pytest.raises(Exception, match="unbound prefix"):
        schemas(spark, ("a", b'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="A" substitutionGroup="q:item"/></xs:schema>')).collect()


def test_taxonomy_command(spark, tmp_path, monkeypatch):
    import hashlib
    import zipfile

    from filingspark import cli
    from filingspark.sources.taxonomies import SourcesError, read_sources

    monkeypatch.setattr(cli, "session", lambda workers=None: spark)
    archive = tmp_path / "t.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("x/a.xsd", XSD % b"debit")
    digest = hashlib.sha256(archive.read_bytes()).hexdigest()
    sources = tmp_path / "sources.csv"
    sources.write_text(f"# pinned\nid,url,sha256\nt,{archive},{digest}\n")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/keep.txt").write_text("k")
    args = ["taxonomy", "-o", str(tmp_path / "out"), "-c", str(tmp_path / "cache"), "-s", str(sources)]
    assert cli.main(args) == 0
    assert (tmp_path / "out/concepts.csv").read_text().splitlines()[1].startswith("urn:t,Item,false") and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["concepts.csv", "keep.txt"]
    sources.write_text(f"id,url,sha256\nt,{archive},{'0' * 64}\n")
    assert cli.main(args) == 1
    for bad in ("id,url\n", "id,url,sha256\na,b,c\n", f"id,url,sha256\na,b,{digest}\na,c,{digest}\n"):
        sources.write_text(bad)
        with pytest.raises(SourcesError):
            read_sources(str(sources))
