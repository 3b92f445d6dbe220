"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from citewise.plans.batches import slices

WORD = r"[^\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, which may hold dots and back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names under free ones, and what gives a result of it df's columns again."""
    held = {c: free for c, free in zip(df.columns, free_names(df, *[f"own_{c}" for c in df.columns])) if c.lower() in names}
    shown = [column(held.get(c, c)).alias(c) for c in df.columns]
    return df.withColumnsRenamed(held), lambda out: out.select(*shown)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands Python about BATCH_BYTES of rows at a time unless it has a bound of its own.

    Spark's own bound of 64 MB is held several times over outside of the heap, for every task of an executor and its worker.
    """
    spark = df.sparkSession
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return df


def add_columns(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: Sequence[StructField]) -> DataFrame:
    """df with further columns that fn puts behind those of its batches; df's columns may have any names."""
    names = df.columns
    plain = [f"c{i}" for i in range(len(names) + len(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = (pa.RecordBatch.from_arrays(b.columns, names) for b in batches)
        for out in fn(shown):
            yield pa.RecordBatch.from_arrays(out.columns, plain)

    safe = in_small_batches(df).toDF(*plain[: len(names)])
    fields = [*safe.schema.fields, *[StructField(name, f.dataType) for name, f in zip(plain[len(names) :], added)]]
    return safe.mapInArrow(run, StructType(fields)).toDF(*names, *[f.name for f in added])


def unit_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / F.lit(float(1 << 53))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str | None = None, max_bytes: int = 1 << 20
) -> DataFrame:
    """Apply a function of one Arrow batch where the rows lie; with ``text``, of parts with about max_bytes of that column."""

    return in_small_batches(df).mapInArrow(by_parts(fn, text, max_bytes), schema)


def by_parts(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str | None = None, max_bytes: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, max_bytes) if text else (batch,):
                if part.num_rows and (out := fn(part)) is not None:
                    yield out

    return run


def text_bytes(column: pa.Array):
    """(uint8 buffer, start of each row, end of each row); a null has no bytes. Offsets fit 64 bits."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    base = ends[0] if len(ends) else 0
    raw = np.frombuffer(data, dtype=np.uint8)[base : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends[:-1] - base, ends[1:] - base
