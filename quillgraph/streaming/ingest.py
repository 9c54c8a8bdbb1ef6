"""Continuous ingestion: a folder of extracted records as a file stream, each micro-batch merged into the edge table.

Every batch is a function of its own files and of what is stored, and writes under its batch number, so a batch that is
run again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import schema


def stream_records(spark: SparkSession, folder: str, kind: str = schema.RAW_REFERENCES, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def citation_counts(records: DataFrame) -> DataFrame:
    """Running citations by title and year; complete or update mode."""
    return records.groupBy("Title", "Year").agg(F.count("*").alias("n_citations"), F.approx_count_distinct("citing_id").alias("n_papers"))


def ingest(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's distinct (citing_id, Title, Year) to ``out``/batch=N, all available files at once."""

    def store(batch: DataFrame, number: int) -> None:
        batch.select("citing_id", "Title", "Year").distinct().write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
