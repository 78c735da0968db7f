"""Incremental ingestion: filings that arrive in a folder, once each, into a fact table.

Each micro-batch parses the new documents and writes facts and statuses partitioned by a number of
the batch, so a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingspark.operators.extract import bind, facts_of, status_of
from filingspark.operators.parser import parse_documents
from filingspark.sources.names import want_member_column


def new_members(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of members of a folder's new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.substring_index("path", "/", -1)
    return files.where(want_member_column(name)).select(name.alias("source_file"), "content", F.lit(None).cast("string").alias("error"), F.lit(False).alias("only_ukfrs"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, *, files_per_batch: int = 1000):
    """Read what is new in folder and stop; facts go to out/facts, statuses to out/status. Returns
    the finished query."""

    def write(batch: DataFrame, number: int) -> None:
        bound = bind(parse_documents(batch)).persist()
        try:
            for rows, name in ((facts_of(bound), "facts"), (status_of(bound), "status")):
                rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/batch={number}")
        finally:
            bound.unpersist()

    query = new_members(spark, folder, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
