"""Query results as evidence text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewise.functions.values import display_value
from citewise.operators.scoped_sql import MAX_ROWS

ROWS_SHOWN = 20


def result_header(sql: Column) -> Column:
    return F.concat(F.lit("Query executed: "), sql, F.lit("\n\n"))


def single_value_text(sql: Column, value: Column) -> Column:
    """Evidence of a one-cell result."""
    return F.concat(result_header(sql), F.lit("Database result: "), value)


def render_result(
    result: DataFrame, sql: str, order: Sequence[str] = (), max_rows: int = MAX_ROWS, shown: int = ROWS_SHOWN
) -> DataFrame:
    """One row (context, row_count): a single cell inline, else a header line and the first rows.

    At most ``max_rows`` rows of the result count; with ``order`` they are its first ones.
    """
    capped = (result.orderBy(*order) if order else result).limit(max_rows)
    kinds = dict(capped.dtypes)
    cells = [display_value(F.col(c), kinds[c]) for c in capped.columns]
    position = F.struct(*order) if order else F.monotonically_increasing_id()
    lines = capped.select(position.alias("at"), F.concat_ws(", ", *cells).alias("line"))
    gathered = lines.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda p: p["line"]).alias("lines"),
    )
    table = F.concat(
        F.lit("Database result:\n" + ", ".join(capped.columns) + "\n"),
        F.array_join(F.slice("lines", 1, shown), "\n"),
        F.when(F.col("row_count") > shown, F.concat(F.lit(" (+"), (F.col("row_count") - shown).cast("string"), F.lit(" more rows)"))).otherwise(""),
    )
    body = F.when(F.col("row_count") == 0, "Database result: (no rows)")
    if len(capped.columns) == 1:
        body = body.when(F.col("row_count") == 1, F.concat(F.lit("Database result: "), F.col("lines")[0]))
    return gathered.select(F.concat(result_header(F.lit(sql)), body.otherwise(table)).alias("context"), "row_count")
