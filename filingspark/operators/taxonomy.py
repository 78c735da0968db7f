"""Taxonomy concepts from schema files: reading, merging with conflict detection, joining to facts."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filingspark.operators.markup import END, START, Reader
from filingspark.schemas import CONCEPT

# Namespaces of schemas and instances.
SCHEMA_NS = "http://www.w3.org/2001/XMLSchema"
INSTANCE_NS = "http://www.xbrl.org/2003/instance"
KEY = ["namespace", "local_name"]
FIELDS = [f for f in CONCEPT.names if f not in KEY]
MOST_BYTES = 32 << 20

LOCATED = T.StructType([T.StructField("location", T.StringType()), *CONCEPT.fields])


class TaxonomyError(ValueError):
    """A schema that cannot be read."""


def schema_concepts(content: bytes) -> list[dict[str, str]]:
    """Concepts declared by one schema: elements directly under its root whose substitution group is
    the instance namespace's item or tuple."""
    content = content.removeprefix(b"\xef\xbb\xbf")
    reader = Reader(content)
    out: list[dict[str, str]] = []
    depth, target = 0, ""

    def resolve(qname: str, what: str) -> tuple[str, str]:
        prefix, colon, local = qname.strip().partition(":")
        if not qname.strip():
            return "", ""
        if not colon:
            return reader.ns.get("", ""), prefix
        if prefix not in reader.ns:
            raise TaxonomyError(f'unbound prefix "{prefix}" in {what}')
        return reader.ns[prefix], local

    for token in reader.tokens():
        if token[0] == START:
            _, space, local, attributes = token
            own = {n: v for p, n, v in attributes if not p}
            there = {n: v for p, n, v in attributes if p and reader.ns.get(p) == INSTANCE_NS}
            if depth == 0 and (space, local) == (SCHEMA_NS, "schema"):
                target = own.get("targetNamespace", "")
            elif depth == 1 and (space, local) == (SCHEMA_NS, "element") and own.get("name"):
                group = resolve(own.get("substitutionGroup", ""), "substitutionGroup")
                if group[0] == INSTANCE_NS and group[1] in ("item", "tuple"):
                    kind = resolve(own.get("type", ""), "type")
                    out.append({
                        "namespace": target, "local_name": own["name"], "abstract": own.get("abstract", ""), "type_namespace": kind[0], "type_name": kind[1], "substitution_group_namespace": group[0],
                        "substitution_group_name": group[1], "period_type": there.get("periodType", ""), "balance": there.get("balance", ""), "nillable": own.get("nillable", ""),
                    })
            depth += 1
        elif token[0] == END:
            depth -= 1
    return out


def concepts(files: DataFrame) -> DataFrame:
    """location and the ten concept columns for schema files (location, content)."""
    schema = to_arrow_schema(LOCATED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"location": at, **c} for at, data in zip(batch.column("location").to_pylist(), batch.column("content").to_pylist()) for c in schema_concepts(data)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("location", "content").mapInArrow(run, LOCATED)


def zip_schemas(spark: SparkSession, archives: list[str]) -> DataFrame:
    """location, content of every .xsd in some zip files; one task reads one archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = 0
                with zipfile.ZipFile(path) as z:
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.lower().endswith(".xsd"):
                            continue
                        if ".." in info.filename.split("/"):
                            raise TaxonomyError(f"{path}: unsafe name {info.filename}")
                        if info.file_size > MOST_BYTES:
                            raise TaxonomyError(f"{path}: {info.filename} is too large")
                        found += 1
                        yield pa.RecordBatch.from_pydict({"location": [f"{path}!{info.filename}"], "content": [z.read(info)]}, schema=pa.schema([("location", pa.string()), ("content", pa.binary())]))
                if not found:
                    raise TaxonomyError(f"{path}: no schema files")

    paths = spark.createDataFrame([(a,) for a in archives], "path string").repartition(max(1, len(archives)))
    return paths.mapInArrow(run, "location string, content binary")


def conflicts(located: DataFrame) -> DataFrame:
    """namespace, local_name, fields (that differ, comma-separated), locations (of two variants) of
    concepts declared in more than one way."""
    rows = located.select(*KEY, "location", *(F.coalesce(f, F.lit("")).alias(f) for f in FIELDS))
    # A field differs where its least and greatest text do; a count of distinct texts would multiply
    # the rows by the fields. Rows are dealt first, so that no task sorts a whole file of them.
    grouped = rows.repartition(*KEY).groupBy(*KEY).agg(*(F.min(f).alias(f) for f in FIELDS), *(F.max(f).alias(f"_{f}") for f in FIELDS), F.min("location").alias("first"), F.max("location").alias("last"))
    differing = F.array_compact(F.array(*(F.when(F.col(f) != F.col(f"_{f}"), F.lit(f)) for f in FIELDS)))
    return grouped.select(*KEY, F.array_join(differing, ",").alias("fields"), F.array("first", "last").alias("locations")).where("fields <> ''")


def merge(located: DataFrame) -> DataFrame:
    """One row per concept. Evaluating it fails on a concept declared in more than one way."""
    rows = located.repartition(*KEY).groupBy(*KEY).agg(*(F.min(f).alias(f) for f in FIELDS), *(F.max(f).alias(f"_{f}") for f in FIELDS), F.min("location").alias("_first"), F.max("location").alias("_last"))
    differing = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in FIELDS))), ",")
    failure = F.raise_error(F.concat(F.lit("conflict on {"), "namespace", F.lit("}"), "local_name", F.lit(": "), differing, F.lit(" between "), "_first", F.lit(" and "), "_last"))
    same = F.when(differing == "", F.col(FIELDS[0])).otherwise(failure.cast("string"))
    return rows.select(*KEY, same.alias(FIELDS[0]), *FIELDS[1:])


def join_facts(facts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Facts with the attributes of their concepts, null where the lookup has none."""
    from filingspark.operators.transform import small

    return facts.join(small(lookup.withColumnRenamed("local_name", "concept"), 200_000), ["namespace", "concept"], "left")


def sorted_rows(lookup: DataFrame) -> list[list[str]]:
    """The lookup's rows in order of namespace and name, for the one CSV file it is kept in (some
    tens of thousands of rows, bounded by the taxonomies)."""
    return [list(r) for r in lookup.select(CONCEPT.names).orderBy(*KEY).toLocalIterator()]
