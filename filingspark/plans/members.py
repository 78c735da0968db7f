"""Queries of the member and package rules, over archive listings made from the orders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.sources import names as N

_NAME = """CASE o_orderkey % 9 WHEN 0 THEN concat('a/', CAST(o_orderkey AS STRING), '.XHTML') WHEN 1 THEN concat('__MACOSX/', CAST(o_orderkey AS STRING), '.html') WHEN 2 THEN concat('x/.h', CAST(o_orderkey AS STRING), '.htm')
 WHEN 3 THEN concat('x/__', CAST(o_orderkey AS STRING), '.xml') WHEN 4 THEN concat('b', chr(92), CAST(o_orderkey AS STRING), '.xbrl') WHEN 5 THEN concat(CAST(o_orderkey AS STRING), '.zip') WHEN 6 THEN concat(CAST(o_orderkey AS STRING), '.html.txt')
 ELSE concat('d/', CAST(o_orderkey AS STRING), '.xml') END"""


def member_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(_NAME).alias("name"))
    return names.where(N.want_member_column(F.col("name"))).select("o_orderkey", "name")


# One archive per order: what its members are called depends on the order's kind.
_LISTING = """CASE o_orderkey % 6 WHEN 0 THEN array('a.html', 'b.xml') WHEN 1 THEN array('META-INF/reportPackage.json', 'reports/r.xhtml', 'reports/x.svg') WHEN 2 THEN array('S/reports/set/b.html', 'S/reports/set/a.xhtml', 'S/reports/set/n.txt')
 WHEN 3 THEN array('CIC-10878733/accounts/f.xhtml', 'CIC-10878733/cic34/c.xhtml') WHEN 4 THEN array('OVERSEAS-FC041186/original-accounts/o.xhtml', 'OVERSEAS-FC041186/English-Accounts/e.xhtml') ELSE array('AUDITEXEMPT-13515245/consolidated-accounts/g.html', 'AUDITEXEMPT-13515245/subsidiary-accounts/s.html') END"""
_SCHEMA = pa.schema([("archive", pa.int64()), ("kind", pa.string()), ("files", pa.string()), ("only_ukfrs", pa.bool_())])


def package_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archive's layout, and what is read of it, from the members' names alone."""
    members = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("archive"), F.explode(F.expr(_LISTING)).alias("name"))
    listings = members.groupBy("archive").agg(F.collect_list("name").alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [N.select_package(n) for n in b.column("names").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("archive"), pa.array([p.kind for p in found]), pa.array([",".join(p.files) for p in found], type=pa.string()), pa.array([p.only_ukfrs for p in found], type=pa.bool_())], schema=_SCHEMA)

    return listings.mapInArrow(run, "archive bigint, kind string, files string, only_ukfrs boolean")


QUERIES = {f.__name__: f for f in (member_name_filter, package_select)}

ORACLE_SQL = {
    "member_name_filter": "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'a/' || o_orderkey || '.XHTML' WHEN 4 THEN 'b' || chr(92) || o_orderkey || '.xbrl' ELSE 'd/' || o_orderkey || '.xml' END AS name FROM orders WHERE o_orderkey % 9 IN (0, 4, 7, 8)",
    "package_select": """SELECT o_orderkey AS archive, CASE WHEN o_orderkey % 6 = 0 THEN 'bulk' WHEN o_orderkey % 6 < 3 THEN 'report' ELSE 'filing' END AS kind,
 CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'reports/r.xhtml' WHEN 2 THEN 'S/reports/set/a.xhtml,S/reports/set/b.html' WHEN 3 THEN 'CIC-10878733/accounts/f.xhtml' WHEN 4 THEN 'OVERSEAS-FC041186/English-Accounts/e.xhtml' ELSE 'AUDITEXEMPT-13515245/subsidiary-accounts/s.html' END AS files,
 o_orderkey % 6 IN (1, 2) AS only_ukfrs FROM orders""",
}
