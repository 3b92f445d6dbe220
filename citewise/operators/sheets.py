"""Raw sheet grids -> header, body rows and long cells, for many sheets at once.

``raw_rows(sheet_id, row_idx, cells array<string>, cell_types array<string>)`` with types string, number, bool, date.
Per-sheet facts are one small row each; body rows stay where they are and are never grouped by sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.values import canonical_text
from citewise.plans.materialize import settle
from citewise.plans.scans import number_rows

HEADER_SCAN_ROWS = 15
LOOK_AHEAD_ROWS = 3
FOLLOWED_BONUS = 5


def filled(cells: Column | str) -> Column:
    """Number of non-null cells."""
    return F.size(F.filter(cells, lambda c: c.isNotNull()))


def header_scores(raw: DataFrame) -> DataFrame:
    """Score of every row that may be the header; only the first rows of a sheet are read."""
    head = raw.filter(F.col("row_idx") < HEADER_SCAN_ROWS + LOOK_AHEAD_ROWS)
    texts_only = F.forall(
        F.zip_with("cells", "cell_types", lambda c, t: c.isNull() | t.eqNullSafe(F.lit("string"))), lambda ok: ok
    )
    rows = head.select("sheet_id", "row_idx", "cells", filled("cells").alias("n"), texts_only.alias("texts_only"))
    ahead = Window.partitionBy("sheet_id").orderBy("row_idx").rowsBetween(1, LOOK_AHEAD_ROWS)
    followed = F.coalesce(F.max("n").over(ahead) >= F.col("n") * 0.5, F.lit(False))
    score = F.when((F.col("n") < 2) | ~F.col("texts_only"), F.lit(-1)).otherwise(
        F.col("n") + F.when(followed, FOLLOWED_BONUS).otherwise(0)
    )
    return rows.withColumn("score", score).filter(F.col("row_idx") < HEADER_SCAN_ROWS)


def detect_headers(raw: DataFrame) -> DataFrame:
    """(sheet_id, header_row, names): best score wins, the first on ties, row 0 when nothing scores."""
    picked = header_scores(raw).groupBy("sheet_id").agg(
        F.max("score").alias("score"),
        F.max_by(F.struct("row_idx", "cells"), F.struct(F.col("score"), -F.col("row_idx"))).alias("best"),
        F.min_by(F.struct("row_idx", "cells"), "row_idx").alias("first"),
    )
    chosen = F.when(F.col("score") > -1, F.col("best")).otherwise(F.col("first"))
    named = F.transform(chosen["cells"], lambda c, i: F.coalesce(c, F.concat(F.lit("column_"), i.cast("string"))))
    return picked.select("sheet_id", chosen["row_idx"].alias("header_row"), named.alias("names"))


def body_bounds(raw: DataFrame) -> DataFrame:
    """(sheet_id, header_row, names, last_row); ``last_row`` is the last row with more than one value."""
    ends = raw.groupBy("sheet_id").agg(F.max(F.when(filled("cells") > 1, F.col("row_idx"))).alias("last_row"))
    return detect_headers(raw).join(ends, "sheet_id")


def body_rows(raw: DataFrame, bounds: DataFrame) -> DataFrame:
    """Data rows: below the header, above trailing footnotes, not wholly empty."""
    limits = bounds.select("sheet_id", "header_row", "last_row")
    joined = raw.join(limits, "sheet_id")
    return joined.filter(
        (F.col("row_idx") > F.col("header_row")) & (F.col("row_idx") <= F.col("last_row")) & (filled("cells") > 0)
    ).select("sheet_id", "row_idx", "cells", "cell_types")


def sheet_columns(bounds: DataFrame) -> DataFrame:
    """(sheet_id, col_idx, column_name)."""
    return bounds.select("sheet_id", F.posexplode("names").alias("col_idx", "column_name"))


def normalize_sheets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, body rows) of every sheet; the bounds, one row per sheet, are written once for both."""
    bounds = settle(body_bounds(raw))
    return sheet_columns(bounds), body_rows(raw, bounds)


def long_cells(body: DataFrame) -> DataFrame:
    """Body rows -> (sheet_id, row_idx, col_idx, value, value_type), nulls left out."""
    cells = body.select(
        "sheet_id", "row_idx", F.posexplode_outer(F.arrays_zip(F.col("cells").alias("v"), F.col("cell_types").alias("t")))
    )
    return cells.select(
        "sheet_id", "row_idx", F.col("pos").alias("col_idx"), F.col("col")["v"].alias("value"), F.col("col")["t"].alias("value_type")
    ).filter(F.col("value").isNotNull())


def filled_columns(body: DataFrame) -> DataFrame:
    """(sheet_id, col_idx) of the columns that hold a value in some row."""
    return long_cells(body).groupBy("sheet_id", "col_idx").agg(F.count(F.lit(1)).alias("_n")).select("sheet_id", "col_idx")


def without_empty(body: DataFrame) -> DataFrame:
    """Body rows without rows and columns that hold no value anywhere in their sheet; ``columns`` lists the kept positions.

    A row carries its sheet's short list of kept columns; cells beyond a short row's end are null.
    """
    kept = filled_columns(body).groupBy("sheet_id").agg(F.array_sort(F.collect_list("col_idx")).alias("columns"))
    joined = body.filter(filled("cells") > 0).join(kept, "sheet_id")
    pick = lambda name: F.transform("columns", lambda i: F.get(name, i)).alias(name)
    return joined.select("sheet_id", "row_idx", pick("cells"), pick("cell_types"), "columns")


def table_as_raw_rows(df: DataFrame, sheet_id: Column, row_idx: Column) -> DataFrame:
    """A typed DataFrame as raw rows: values as text with their kind."""
    kinds = {"string": "string", "boolean": "bool", "timestamp": "date", "timestamp_ntz": "date", "date": "date"}
    columns = [(c, kinds.get(t, "number")) for c, t in df.dtypes]
    return df.select(
        sheet_id.alias("sheet_id"),
        row_idx.cast("bigint").alias("row_idx"),
        F.array(*[F.col(c).cast("string") for c, _ in columns]).alias("cells"),
        F.array(*[F.lit(k) for _, k in columns]).alias("cell_types"),
    )


def typed_rows(body: DataFrame, catalog: DataFrame) -> DataFrame:
    """(sheet_id, _row_id, values): numbered rows holding every cell in the stored form of its column type."""
    types = catalog.groupBy("sheet_id").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "data_type"))).alias("_types")
    )
    joined = body.join(types, "sheet_id")
    values = F.transform("cells", lambda c, i: canonical_text(c, F.try_element_at(F.col("_types"), i)))
    numbered = number_rows(joined.select("sheet_id", "row_idx", values.alias("values")), ["sheet_id"], ["row_idx"], "_row_id")
    return numbered.select("sheet_id", "_row_id", "values")


# The stored SQL type of each inferred type.
SPARK_TYPES = {
    "TEXT": "string",
    "INTEGER": "bigint",
    "NUMERIC": "decimal(18,4)",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def sheet_table(rows: DataFrame, sheet_id: str, columns: list[tuple[int, str, str]]) -> DataFrame:
    """One sheet as a typed table; ``columns`` lists (col_idx, physical_name, data_type)."""
    mine = rows.filter(F.col("sheet_id") == sheet_id)
    typed = [F.col("values")[i].cast(SPARK_TYPES[kind]).alias(name) for i, name, kind in columns]
    return mine.select("_row_id", *typed)
