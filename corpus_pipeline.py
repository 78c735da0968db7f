"""The training-data pipeline: toxicity, language, near-duplicates, decontamination, packing.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
run() applies them to the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.llm import decontam, langid, minhash, packing, toxicity
from filingspark.llm.common import bound_batches, free_name, in_few, materialize, table

TOXIC_FROM = 0.5
LEAST_LANGUAGE_SHARE = 0.4
NEAR_COPY_FROM = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is TOXIC_FROM or more go; learned on the table's labels. Null and
    empty texts stay; repeated rows go or stay together; an empty table stays empty."""
    bound_batches(spark)
    lexicon = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, lexicon, TOXIC_FROM)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without one that holds LEAST_LANGUAGE_SHARE of them, go; so do
    null texts and texts without a letter. Repeated rows go or stay together."""
    bound_batches(spark)
    return langid.reject(docs, langid.fit(docs), LEAST_LANGUAGE_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the least doc_id (a null one comes last),
    and of those with the least row key. Fingerprints within SimHash's radius make near copies, and
    so do sets of five-word shingles of similarity NEAR_COPY_FROM or more. Null, empty and blank texts
    are copies of each other."""
    bound_batches(spark)
    found, row = minhash.near_copies(docs, similarity=NEAR_COPY_FROM), free_name("_row", docs)
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")).select(F.col("least.row").alias(row))
    left = docs.withColumn(row, minhash.row_key()).join(kept, row, "left_semi").dropDuplicates([row]).select(docs.columns)
    return in_few(left, docs.count(), minhash.SETS_A_TASK)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, the words of benchmark passages are cut. Null and
    empty texts stay; repeated rows go, are cut or stay together."""
    bound_batches(spark)
    clean = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(clean.schema["n_chars"].dataType), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece with its token ids. Null and empty texts hold
    the end token alone; repeated rows are packed as often as they occur."""
    import public_tokenizers

    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Three stages apply fitted models or a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
