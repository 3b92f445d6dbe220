"""What an incremental ingest has done with every file: pending, processing, ready or failed.

A micro-batch notes its files before it touches data and again after its data is written. Rows of a batch count only for
files that the ledger calls ready, so a batch that dies in between leaves no visible rows, and running it again replaces
both its notes and its data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.sources.tables import ERROR_CHARS

BATCH = ("stream_id", "batch_id")
# The states of a file, in their order.
STATES = ("pending", "processing", "ready", "failed")
STARTED, FINISHED = "started", "finished"
NOTE = "file_id string, status string, produced bigint, error_message string"


def note(entries: DataFrame, path: str, stream_id: str, batch_id: int, phase: str) -> None:
    """Write the notes (file_id, status, produced, error_message) of one phase of a batch in place of earlier ones."""
    told = entries.select(
        F.col("file_id").cast("string").alias("file_id"), "status", F.col("produced").cast("bigint").alias("produced"),
        F.substring("error_message", 1, ERROR_CHARS).alias("error_message"),
    )
    placed = told.withColumns({"stream_id": F.lit(stream_id), "batch_id": F.lit(batch_id).cast("bigint"), "phase": F.lit(phase)})
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*BATCH, "phase").parquet(path)


def _notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{NOTE}, stream_id string, batch_id bigint, phase string").parquet(path)


def statuses(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """(file_id, status, produced, error_message, stream_id, batch_id): the latest note of every file.

    With ``files(file_id)`` those without a note are pending. A file that was ingested again is judged by its latest
    batch, and a finished note counts before the started one of the same batch.
    """
    order = F.struct(F.col("batch_id"), (F.col("phase") == FINISHED).alias("finished"), F.col("stream_id"))
    rest = F.struct("status", "produced", "error_message", *BATCH)
    latest = _notes(spark, path).groupBy("file_id").agg(F.max_by(rest, order).alias("_last")).select("file_id", "_last.*")
    if files is None:
        return latest
    asked = files.select(F.col("file_id").cast("string").alias("file_id")).distinct()
    return asked.join(latest, "file_id", "left").withColumn("status", F.coalesce("status", F.lit(STATES[0])))


def committed(points: DataFrame, spark: SparkSession, path: str, file_id: str = "doc_id") -> DataFrame:
    """Points of files that are ready, as their latest batch wrote them."""
    ready = statuses(spark, path).filter(F.col("status") == "ready").select(F.col("file_id").alias("_file"), *[F.col(c).alias(f"_{c}") for c in BATCH])
    same = (points[file_id].cast("string") == F.col("_file")) & (points["stream_id"] == F.col("_stream_id")) & (points["batch_id"] == F.col("_batch_id"))
    return points.join(ready, same, "left_semi")
