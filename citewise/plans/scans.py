"""Ordered scans that survive a hot key.

A plain window over ``partitionBy(key)`` puts a whole key into one task. Here the order column (an integer such as a
page or row number) is cut into blocks of ``width`` values first: each block is scanned on its own, one summary row
per block carries the state forward, and the carried state is joined back on (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
DEFAULT_WIDTH = 2048


def _blocked(df: DataFrame, order: Sequence[str], width: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(order[0]) / F.lit(width)))


def _join_carry(blocks: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [blocks[k].eqNullSafe(carry[k]) for k in keys] + [blocks[BLOCK] == carry[BLOCK]]
    condition = on[0]
    for clause in on[1:]:
        condition = condition & clause
    joined = blocks.join(carry, condition, "left")
    for k in [*keys, BLOCK]:
        joined = joined.drop(carry[k])
    return joined


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` at or before each row of its key."""
    base = _blocked(df.withColumn("_value", value), order, width)
    here = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("_local", F.last("_value", ignorenulls=True).over(here))
    tails = (
        base.groupBy(*keys, BLOCK)
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, BLOCK, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    joined = _join_carry(local, carry, keys)
    return joined.withColumn(out, F.coalesce("_local", "_carry")).drop("_value", "_local", "_carry", BLOCK)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    width: int = DEFAULT_WIDTH,
    block: Column | None = None,
) -> DataFrame:
    """Add ``out``: 0-based position of each row inside its key, by ``order``.

    ``block`` replaces the default cut of an integer first order column; it has to grow along the order.
    """
    base = df.withColumn(BLOCK, block) if block is not None else _blocked(df, order, width)
    here = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = base.withColumn("_local", F.row_number().over(here).cast("bigint") - 1)
    counts = base.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = _join_carry(local, carry, keys)
    return joined.withColumn(out, F.col("_local") + F.col("_offset")).drop("_local", "_offset", BLOCK)
