"""File listing checks and file-backed scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions.text import is_blank
from citewise.plans.materialize import settle
from citewise.sources.csv_scan import csv_records, record_cells

# Accepted file types.
DOCUMENT_TYPES = ("pdf", "docx", "pptx", "txt")
SHEET_TYPES = ("xlsx", "csv")
MAX_FILE_BYTES = 50 * 1024 * 1024
# Cell texts a CSV reader takes for a missing value.
MISSING_MARKS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def file_type(filename: Column) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(filename, r"[^/.][^/]*\.([^./]*)$", 1))


def classify_files(files: DataFrame) -> DataFrame:
    """files(filename, size_bytes, ...) + file_type, category (document/sheet), rejection reason or null."""
    kind = F.col("file_type")
    category = F.when(kind.isin(*DOCUMENT_TYPES), "document").when(kind.isin(*SHEET_TYPES), "sheet")
    rejection = F.when(F.col("size_bytes") > MAX_FILE_BYTES, "too_large").when(F.col("category").isNull(), "unsupported_type")
    return (
        files.withColumn("file_type", file_type(F.col("filename")))
        .withColumn("category", category)
        .withColumn("rejection", rejection)
    )


def accepted_files(files: DataFrame) -> DataFrame:
    return classify_files(files).filter(F.col("rejection").isNull()).drop("rejection")


def text_units(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents(doc_id, text, ...) -> one unit per non-blank text, positions counted from 0."""
    units = documents.filter(~is_blank(F.col(text)))
    return units.withColumn("unit_no", F.lit(0)).withColumn("base_char_offset", F.lit(0))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as units, broken UTF-8 replaced; the path is the document id."""
    files = spark.read.text(path, wholetext=True)
    named = files.select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_name").alias("filename"), F.make_valid_utf8(F.col("value")).alias("text")
    )
    return text_units(named.withColumn("file_type", F.lit("txt")))


def read_csv_grids(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV files as raw rows, no header assumed: (sheet_id, sheet_name, row_idx, cells, cell_types).

    A sheet is as wide as its widest record up to the last cell with a value; shorter records are filled up with nulls.
    Cells that stand for a missing value are null. With ``multi_line`` off no quoted cell runs over a line's end. Files
    without a record give no rows. No file is read or numbered by one task (see csv_scan).
    """
    cell = lambda c: F.when(~c.isin(*MISSING_MARKS), c)
    records = csv_records(spark, path, multi_line)
    rows = settle(records.select("sheet_id", "sheet_name", "row_idx", F.transform(record_cells(F.col("record")), cell).alias("_cells")))
    filled = F.coalesce(F.array_max(F.transform("_cells", lambda c, i: F.when(c.isNotNull(), i + 1))), F.lit(0))
    widths = rows.groupBy("sheet_id").agg(F.max(filled).alias("_width"))
    missing = F.array_repeat(F.lit(None).cast("string"), F.greatest(F.col("_width") - F.size("_cells"), F.lit(0)))
    cells = F.slice(F.concat("_cells", missing), F.lit(1), F.col("_width"))
    shaped = rows.join(widths, "sheet_id").select("sheet_id", "sheet_name", "row_idx", cells.alias("cells"))
    return shaped.select(
        "sheet_id",
        F.when(F.col("sheet_name") == "", "Sheet1").otherwise(F.col("sheet_name")).alias("sheet_name"),
        "row_idx",
        "cells",
        F.transform("cells", lambda _: F.lit("string")).alias("cell_types"),
    )


def read_sheet_grids(spark: SparkSession, path: str) -> DataFrame:
    """Decoded workbook grids stored as raw rows; every sheet is its own ``sheet_id``."""
    schema = "sheet_id string, row_idx bigint, cells array<string>, cell_types array<string>"
    return spark.read.schema(schema).parquet(path)
