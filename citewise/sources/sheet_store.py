"""Sheet rows of any shape in one typed table.

A row keeps its values in one array per stored type, and the column catalog says which array and place a column has. A sum
over a column of numbers reads numbers from the file, not texts, and no other array. Sheets share folders by hash, so
their number does not set the number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citewise.operators.sheets import SPARK_TYPES
from citewise.sources.stores import SHEET_ROWS, replace_units, stored

# Array of each inferred type.
FAMILIES = {"INTEGER": "longs", "NUMERIC": "decimals", "BOOLEAN": "flags", "TIMESTAMP": "times", "TEXT": "texts"}
NUMBERS = ("INTEGER", "NUMERIC")
TOTAL_TYPE = "decimal(38,4)"


def stored_columns(catalog: DataFrame) -> DataFrame:
    """(sheet_id, col_idx, physical_name, data_type, slot): the place of every column in the array of its type."""
    order = Window.partitionBy("sheet_id", "data_type").orderBy("col_idx")
    return catalog.select("sheet_id", "col_idx", "physical_name", "data_type", (F.row_number().over(order) - 1).alias("slot"))


def typed_families(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows(sheet_id, _row_id, values) in stored text form -> one array per type; what does not fit its type is null."""
    listed = [
        F.array_sort(F.collect_list(F.when(F.col("data_type") == kind, F.col("col_idx")))).alias(f"_{name}") for kind, name in FAMILIES.items()
    ]
    joined = rows.join(catalog.groupBy("sheet_id").agg(*listed), "sheet_id")

    def family(kind: str, name: str) -> Column:
        return F.transform(f"_{name}", lambda i: F.get("values", i).try_cast(SPARK_TYPES[kind])).alias(name)

    return joined.select("sheet_id", "_row_id", *[family(kind, name) for kind, name in FAMILIES.items()])


def write_sheets(rows: DataFrame, catalog: DataFrame, path: str) -> None:
    """Store the sheets of the catalog; a sheet that was stored before is replaced, also by one without rows."""
    replace_units(typed_families(rows, catalog), path, SHEET_ROWS, catalog.select("sheet_id").distinct())


def read_sheets(spark: SparkSession, path: str, sheet_id: str | None = None) -> DataFrame:
    """Stored rows, of one sheet from its folder alone."""
    return stored(spark, path, SHEET_ROWS, None if sheet_id is None else (sheet_id,))


def sheet_frame(store: DataFrame, columns: list[tuple[str, str, int]]) -> DataFrame:
    """One sheet's rows as a typed table; ``columns`` lists (physical_name, data_type, slot)."""
    return store.select("_row_id", *[F.get(FAMILIES[kind], F.lit(slot)).alias(name) for name, kind, slot in columns])


def column_totals(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sheet_id, col_idx, total, numbers) of wanted columns of numbers (sheet_id, col_idx, data_type, slot).

    Only the arrays of numbers are read; sums form where the rows lie.
    """
    slots = wanted.filter(F.col("data_type").isin(*NUMBERS)).groupBy("sheet_id").agg(
        F.collect_list(F.struct("col_idx", "data_type", "slot")).alias("_wanted")
    )

    def value(column: Column) -> Column:
        longs, decimals = (F.get(name, column["slot"]).cast(TOTAL_TYPE) for name in ("longs", "decimals"))
        return F.struct(column["col_idx"].alias("col_idx"), F.when(column["data_type"] == "INTEGER", longs).otherwise(decimals).alias("v"))

    cells = store.select("sheet_id", "longs", "decimals").join(slots, "sheet_id").select("sheet_id", F.inline(F.transform("_wanted", value)))
    return cells.groupBy("sheet_id", "col_idx").agg(F.sum("v").alias("total"), F.count("v").alias("numbers"))
