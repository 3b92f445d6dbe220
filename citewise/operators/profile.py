"""Column profiles, inferred types and the texts built from them.

Cells are first folded into one row per distinct (sheet, column, text value) with map-side counting; every pattern and
date test then runs once per distinct value instead of once per row. Numbers, dates and booleans that arrive typed are
folded without their value, since only text needs an exact distinct count.

These folded rows are the state of a profile: states of several ingests add up to that of all their cells, so a sheet that
grows is profiled again from its states without its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citewise.functions.names import column_slug, distinct_names
from citewise.functions.values import (
    display_float,
    display_timestamp,
    has_digit,
    is_integer,
    is_number,
    parse_timestamp,
    to_double,
    to_integer,
)
from citewise.plans.materialize import settle

COLUMN = ["sheet_id", "col_idx"]
DATE_RATE = 0.9
SAMPLE_VALUES = 8
CATEGORICAL_MAX = 50
CATEGORICAL_SMALL = 20
CATEGORICAL_SHARE = 0.5


STATE = "sheet_id string, col_idx int, value_type string, value string, n bigint, low double, high double, integers bigint, low_integer bigint, high_integer bigint, first_time timestamp_ntz, last_time timestamp_ntz, first_row bigint"
RANGES = (("low", F.min), ("high", F.max), ("integers", F.sum), ("low_integer", F.min), ("high_integer", F.max), ("first_time", F.min), ("last_time", F.max), ("first_row", F.min))


def value_counts(cells: DataFrame) -> DataFrame:
    """(sheet_id, col_idx, value_type, value, n, ranges, first_row): one row per distinct text value."""
    keyed = F.col("value_type").isin("string", "bool")
    typed = lambda kind, target: F.when(F.col("value_type") == kind, F.col("value").try_cast(target))
    return (
        cells.withColumn("_key", F.when(keyed, F.col("value")))
        .withColumn("_number", typed("number", "double"))
        .withColumn("_integer", typed("number", "bigint"))
        .withColumn("_time", typed("date", "timestamp_ntz"))
        .groupBy(*COLUMN, "value_type", F.col("_key").alias("value"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_number").alias("low"),
            F.max("_number").alias("high"),
            F.count("_integer").alias("integers"),
            F.min("_integer").alias("low_integer"),
            F.max("_integer").alias("high_integer"),
            F.min("_time").alias("first_time"),
            F.max("_time").alias("last_time"),
            F.min("row_idx").cast("bigint").alias("first_row"),
        )
    )


def merged_counts(states: DataFrame) -> DataFrame:
    """The state of all cells from the states of parts of them; rows of a later part have to be numbered behind the earlier."""
    merged = [F.sum("n").alias("n"), *[fold(name).alias(name) for name, fold in RANGES]]
    return states.groupBy(*COLUMN, "value_type", "value").agg(*merged)


def append_state(cells: DataFrame, path: str, ingest: str) -> None:
    """Keep the state of one ingest beside those before it; the same ingest again replaces its own."""
    state = value_counts(cells).withColumn("ingest", F.lit(ingest))
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest").parquet(path)


def stored_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of all ingests together."""
    return merged_counts(spark.read.schema(f"{STATE}, ingest string").parquet(path))


def column_stats(counts: DataFrame) -> DataFrame:
    """Counts, distinct texts, numeric and date coverage and ranges per column."""
    text = F.col("value_type") == "string"
    n = F.col("n")

    def share(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    tested = (
        counts.withColumn("_number", F.when(text, to_double(F.col("value"))))
        .withColumn("_is_number", F.when(text, is_number(F.col("value"))).otherwise(F.col("value_type") == "number"))
        .withColumn("_integer", F.when(text & is_integer(F.col("value")), to_integer(F.col("value"))))
        .withColumn("_integers", F.when(text, F.when(F.col("_integer").isNotNull(), n).otherwise(0)).otherwise(F.col("integers")))
        .withColumn("_time", F.when(text, parse_timestamp(F.col("value"))))
    )
    return tested.groupBy(*COLUMN).agg(
        F.sum(n).alias("non_null"),
        F.count("value").alias("nunique"),
        share(F.col("_is_number")).alias("numbers"),
        F.sum("_integers").alias("integers"),
        share(F.col("value_type") == "bool").alias("booleans"),
        share(has_digit(F.col("value")) | (F.col("value_type") == "date")).alias("with_digit"),
        share(F.col("_time").isNotNull() | (F.col("value_type") == "date")).alias("as_time"),
        F.min(F.coalesce("_integer", "low_integer")).alias("low_integer"),
        F.max(F.coalesce("_integer", "high_integer")).alias("high_integer"),
        F.min(F.coalesce("_number", "low")).alias("low"),
        F.max(F.coalesce("_number", "high")).alias("high"),
        F.min(F.coalesce("_time", "first_time")).alias("first_time"),
        F.max(F.coalesce("_time", "last_time")).alias("last_time"),
    )


def classify(stats: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Add data_type and the four flags. ``rows(sheet_id, row_count)``; columns without a value are left out."""
    known = stats.join(columns, COLUMN).join(rows, "sheet_id")
    complete = F.col("non_null") == F.col("row_count")
    all_of = lambda name: F.col(name) == F.col("non_null")
    dated = (F.col("with_digit") >= DATE_RATE * F.col("non_null")) & (F.col("as_time") >= DATE_RATE * F.col("non_null"))
    kind = (
        F.when(all_of("booleans") & complete, "BOOLEAN")
        .when(all_of("numbers") & all_of("integers") & complete, "INTEGER")
        .when(all_of("numbers"), "NUMERIC")
        .when(dated, "TIMESTAMP")
        .otherwise("TEXT")
    )
    distinct = F.col("nunique")
    few = (distinct <= CATEGORICAL_SMALL) | (distinct <= CATEGORICAL_SHARE * F.greatest(F.col("row_count"), F.lit(1)))
    return (
        known.withColumn("data_type", kind)
        .withColumn("is_numeric", F.col("data_type").isin("INTEGER", "NUMERIC"))
        .withColumn("is_date", F.col("data_type") == "TIMESTAMP")
        .withColumn("is_text", F.col("data_type") == "TEXT")
        .withColumn("is_categorical", F.col("is_text") & (distinct > 0) & (distinct <= CATEGORICAL_MAX) & few)
    )


def first_values(cells: DataFrame, columns: DataFrame, limit: int = SAMPLE_VALUES) -> DataFrame:
    """(sheet_id, col_idx, sample): the first ``limit`` distinct values in row order of the listed columns."""
    mine = cells.join(columns.select(*COLUMN), COLUMN, "left_semi")
    return sample_of(mine.groupBy(*COLUMN, "value").agg(F.min("row_idx").alias("first_row")), limit)


def sample_of(seen: DataFrame, limit: int = SAMPLE_VALUES) -> DataFrame:
    """(sheet_id, col_idx, sample) from rows (sheet_id, col_idx, value, first_row)."""
    order = Window.partitionBy(*COLUMN).orderBy("first_row", "value")
    first = seen.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
    values = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda p: p["value"])
    return first.groupBy(*COLUMN).agg(values.alias("sample"))


def describe() -> Column:
    """Column description text by type."""
    name, kind = F.col("column_name"), F.col("data_type")
    integer_range = F.concat(F.col("low_integer").cast("string"), F.lit("-"), F.col("high_integer").cast("string"))
    float_range = F.concat(display_float(F.col("low")), F.lit("-"), display_float(F.col("high")))
    span = F.when(kind == "INTEGER", integer_range).otherwise(float_range)
    numeric = F.concat(name, F.lit(": "), kind, F.lit(" column, range "), span, F.lit("."))
    times = F.concat(
        name, F.lit(": date/time column, range "), display_timestamp(F.col("first_time")), F.lit(" to "),
        display_timestamp(F.col("last_time")), F.lit("."),
    )
    distinct = F.concat(F.lit(" column with "), F.col("nunique").cast("string"), F.lit(" distinct values"))
    sample = F.concat(F.lit(" (e.g. "), F.array_join("sample", ", "), F.lit(")."))
    return (
        F.when(F.col("is_numeric"), numeric)
        .when(F.col("is_date"), times)
        .when(F.col("is_categorical"), F.concat(name, F.lit(": categorical text"), distinct, sample))
        .otherwise(F.concat(name, F.lit(": free-text"), distinct, F.lit(".")))
    )


def physical_names(catalog: DataFrame) -> DataFrame:
    """(sheet_id, col_idx, physical_name): slugs de-duplicated in column order, one small array per sheet."""
    ordered = catalog.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "column_name"))).alias("_c"))
    names = distinct_names(F.transform("_c", lambda c: column_slug(c["column_name"])))
    positions = F.transform("_c", lambda c: c["col_idx"])
    return ordered.select("sheet_id", F.inline(F.arrays_zip(positions.alias("col_idx"), names.alias("physical_name"))))


CATALOG_COLUMNS = (
    "sheet_id",
    "col_idx",
    "column_name",
    "physical_name",
    "data_type",
    "is_numeric",
    "is_date",
    "is_text",
    "is_categorical",
    "row_count",
    "non_null",
    "nunique",
    "description",
)


def profile_columns(cells: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Long cells + column names + row counts -> the column catalog; cells are read once and folded to their state."""
    return profile_of_state(settle(value_counts(cells)), columns, rows, cells)


def profile_of_state(state: DataFrame, columns: DataFrame, rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The column catalog from a state. The statistics, one row per column, are written once, as naming and sampling start from them.

    A sample comes from the state too. Only a column of texts that also has typed cells, whose values the state does not
    keep, is sampled from ``cells``; without them its sample holds its texts alone.
    """
    typed = settle(classify(column_stats(state), columns, rows))
    shown = typed.filter("is_categorical")
    texts = state.filter(F.col("value").isNotNull()).join(shown.select(*COLUMN), COLUMN, "left_semi")
    sample = sample_of(texts.groupBy(*COLUMN, "value").agg(F.min("first_row").alias("first_row")))
    mixed = state.filter(F.col("value").isNull()).select(*COLUMN).distinct().join(shown, COLUMN, "left_semi")
    if cells is not None and not mixed.isEmpty():
        whole = first_values(cells, mixed).withColumnRenamed("sample", "_whole")
        sample = sample.join(whole, COLUMN, "left").select(*COLUMN, F.coalesce("_whole", "sample").alias("sample"))
    known = typed.join(sample, COLUMN, "left").join(physical_names(typed), COLUMN)
    return known.withColumn("description", describe()).select(*CATALOG_COLUMNS)


def profile_sheets(columns: DataFrame, body: DataFrame, cells: DataFrame) -> DataFrame:
    """Catalog of normalised sheets."""
    return profile_columns(cells, columns, body.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("row_count")))


def _column_lines(line: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("col_idx"), line.alias("line")))), lambda p: p["line"])


def schema_texts(catalog: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_id, schema_text): physical names and types, original names and sample values as comments.

    ``sheets(sheet_id, sheet_name, table_name, filename)``.
    """
    notes = F.concat_ws(
        " | ",
        F.when(F.col("physical_name") != F.col("column_name"), F.concat(F.lit('"'), "column_name", F.lit('"'))),
        F.when(F.col("is_categorical") & (F.col("description") != ""), F.col("description")),
    )
    line = F.concat(
        F.lit('  "'), "physical_name", F.lit('" '), "data_type", F.when(notes == "", "").otherwise(F.concat(F.lit("  -- "), notes))
    )
    blocks = catalog.groupBy("sheet_id").agg(F.array_join(_column_lines(line), ",\n").alias("_columns"))
    text = F.concat(
        F.lit("-- Sheet: "), "sheet_name", F.lit(" (from "), F.coalesce("filename", F.lit("")), F.lit(")\n"),
        "table_name", F.lit("(\n"), "_columns", F.lit("\n)"),
    )
    return blocks.join(sheets, "sheet_id").select("sheet_id", text.alias("schema_text"))


def sheet_summaries(catalog: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_id, text): the sheet description that is embedded for discovery."""
    line = F.concat(F.lit("- "), "column_name", F.lit(" ("), "data_type", F.lit("): "), "description")
    blocks = catalog.groupBy("sheet_id").agg(
        F.array_join(_column_lines(line), "\n").alias("_columns"), F.max("row_count").alias("_rows")
    )
    text = F.concat(
        F.lit("File: "), "filename", F.lit("\nSheet: "), "sheet_name", F.lit("\nRows: "),
        F.col("_rows").cast("string"), F.lit("\nColumns:\n"), "_columns",
    )
    return blocks.join(sheets, "sheet_id").select("sheet_id", text.alias("text"))


def session_schema(schema_text: DataFrame, sheets: DataFrame) -> DataFrame:
    """(session_id, schema_description, allowed_tables) over each session's sheets in ``sheet_order``."""
    block = F.struct("sheet_order", "schema_text")
    return schema_text.join(sheets, "sheet_id").groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["schema_text"]), "\n\n").alias("schema_description"),
        F.array_sort(F.collect_set("table_name")).alias("allowed_tables"),
    )
