"""Writes: points, sheet rows, message log, ingest status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewise.functions.hashing import DEFAULT_DIM, checked_dense, to_dense

ERROR_CHARS = 2000
TENANT = ("user_id", "session_id")
NO_TEXT = "The document holds no text; images of pages are not read."
NO_ROWS = "The sheet holds no rows of values."


def payload_json(columns: list[str]) -> Column:
    """Stored payload: the non-null fields only."""
    return F.to_json(F.struct(*columns))


def as_points(chunks: DataFrame, content_type: str = "document_chunk", dim: int = DEFAULT_DIM) -> DataFrame:
    """chunks with a vector -> rows of the point table; a vector of the wrong length fails the write."""
    sparse = chunks.schema["vector"].dataType.simpleString().startswith("array<struct")
    dense = to_dense(F.col("vector"), dim) if sparse else F.col("vector").cast("array<float>")
    return chunks.withColumn("vector", checked_dense(dense, dim)).withColumn("content_type", F.lit(content_type))


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the point table, laid out by tenant so that a tenant filter prunes folders.

    Rows are rebalanced by tenant first: a small tenant gets one file per write, and adaptive execution splits a large one
    over several tasks.
    """
    points.hint("rebalance", *[F.col(c) for c in TENANT]).write.mode(mode).partitionBy(*TENANT).parquet(path)


def write_sheet_rows(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Typed sheet rows, laid out by sheet."""
    rows.write.mode(mode).partitionBy("sheet_id").parquet(path)


def message_rows(answers: DataFrame) -> DataFrame:
    """answers(session_id, user_id, question_id, question, answer, question_type, sources) -> two messages each."""
    nothing = F.lit(None)
    said = F.array(
        F.struct(
            F.lit("user").alias("role"), F.col("question").alias("content"), nothing.cast("string").alias("question_type"),
            F.when(F.lit(False), F.col("sources")).alias("sources"), F.lit(0).alias("message_no"),
        ),
        F.struct(
            F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("question_type"),
            F.col("sources"), F.lit(1).alias("message_no"),
        ),
    )
    return answers.select(*TENANT, "question_id", F.inline(said))


def append_messages(answers: DataFrame, path: str) -> None:
    message_rows(answers).write.mode("append").parquet(path)


def ingest_status(files: DataFrame, produced: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """files(file_id, category, ...) ⟕ produced(file_id, produced) ⟕ errors(file_id, error) -> status, error_message."""
    joined = files.join(produced, "file_id", "left")
    joined = joined.join(errors, "file_id", "left") if errors is not None else joined.withColumn("error", F.lit(None).cast("string"))
    count = F.coalesce("produced", F.lit(0)).cast("bigint")
    empty = F.when(F.col("category") == "document", NO_TEXT).otherwise(NO_ROWS)
    message = F.coalesce("error", F.when(count == 0, empty))
    return (
        joined.withColumn("produced", count)
        .withColumn("error_message", F.substring(message, 1, ERROR_CHARS))
        .withColumn("status", F.when(message.isNull(), "ready").otherwise("failed"))
        .drop("error")
    )
