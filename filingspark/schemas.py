"""Schemas of the relations that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


# Column names and order of the long fact table and of the concept lookup.
FACT = strings("period_start", "period_end", "concept", "value", "unit", "dimensions", "namespace", "source_file", "decimals")
CONCEPT = strings("namespace", "local_name", "abstract", "type_namespace", "type_name", "substitution_group_namespace", "substitution_group_name", "period_type", "balance", "nillable")

#: One document on its way to the parser.
MEMBER = T.StructType([T.StructField("source_file", _S), T.StructField("content", T.BinaryType()), T.StructField("error", _S), T.StructField("only_ukfrs", T.BooleanType())])

CONTEXT = T.StructType([T.StructField("period_start", _S), T.StructField("period_end", _S), T.StructField("dims", T.MapType(_S, _S))])
RAW_FACT = T.StructType(
    [T.StructField(n, _S) for n in ("name", "concept", "context_ref", "unit_ref", "namespace", "scale", "sign", "format", "decimals")]
    + [T.StructField("is_numeric", T.BooleanType())]
    + [T.StructField(n, _S) for n in ("value", "exact", "target")]
)
#: One parsed document, its parts not yet bound to each other.
DOCUMENT = T.StructType([
    T.StructField("source_file", _S), T.StructField("only_ukfrs", T.BooleanType()), T.StructField("error", _S),
    T.StructField("producer", _S), T.StructField("producer_version", _S),
    T.StructField("contexts", T.MapType(_S, CONTEXT)), T.StructField("units", T.MapType(_S, _S)), T.StructField("facts", T.ArrayType(RAW_FACT)),
])
