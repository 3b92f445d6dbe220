"""Incremental ingest: a folder of documents -> chunks with vectors, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citewise.functions.hashing import DEFAULT_DIM
from citewise.operators.chunking import CHUNK_CHARS, OVERLAP_CHARS, chunk_documents
from citewise.operators.search import embed
from citewise.sources.files import text_units
from citewise.sources.tables import as_points, ingest_status
from citewise.streaming.ledger import FINISHED, STARTED, note


def ingest_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    prepare,
    size: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    dim: int = DEFAULT_DIM,
    partition_by: Sequence[str] = (),
    files_per_batch: int | None = None,
    ledger: str | None = None,
) -> None:
    """Process what is new under ``source`` and stop. ``prepare`` maps source rows to (doc_id, text, ...).

    Each micro-batch replaces its own folder, named by the stream and the batch, so a batch that is run again after a failure
    leaves no duplicates. A stream keeps its id as long as its checkpoint: one with a new checkpoint starts at batch 0 in
    folders of its own and overwrites nothing.

    With a ``ledger`` every document's state is noted there before and after its batch (see ledger.py). ``prepare`` may
    add ``error``: such a document is failed with that message and gives no chunks, as is one without text. An error of
    Spark while a batch is worked on fails the batch's documents instead of the stream; one while noting ends the stream.
    """

    def over_all_cores(rows: DataFrame) -> DataFrame:
        """A few large files are read by as few tasks; chunks and vectors are made by as many as there are cores."""
        cores = rows.sparkSession.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)

    def points_of(rows: DataFrame, stream_id: str, batch_id: int) -> DataFrame:
        sound = rows.filter(F.col("error").isNull()).drop("error") if "error" in rows.columns else rows
        chunks = chunk_documents(text_units(sound), size, overlap, single_unit=True)
        return as_points(embed(chunks, dim=dim), dim=dim).withColumns({"stream_id": F.lit(stream_id), "batch_id": F.lit(batch_id)})

    def store(points: DataFrame) -> None:
        writer = points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("stream_id", "batch_id", *partition_by).parquet(target)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream_id = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = prepare(over_all_cores(batch))
        points = points_of(rows, stream_id, batch_id)
        if ledger is None:
            store(points)
            return
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        files = rows.groupBy(F.col("doc_id").cast("string").alias("file_id")).agg(F.max(error).alias("error")).withColumn("category", F.lit("document"))
        started = files.select("file_id", F.lit("processing").alias("status"), F.lit(0).alias("produced"), F.lit(None).cast("string").alias("error_message"))
        note(started, ledger, stream_id, batch_id, STARTED)
        try:
            store(points)
            written = session.read.schema(points.schema).parquet(target).filter((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id))
            produced = written.groupBy(F.col("doc_id").cast("string").alias("file_id")).agg(F.count(F.lit(1)).alias("produced"))
            finished = ingest_status(files.drop("error"), produced, files.select("file_id", "error"))
        except PySparkException as problem:
            failed = {"status": F.lit("failed"), "error_message": F.lit(str(problem))}
            finished = started.withColumns(failed)
        note(finished, ledger, stream_id, batch_id, FINISHED)

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source)
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
