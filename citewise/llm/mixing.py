"""Mixing sources to target weights: token totals per source, repetition rates, floor(rate) copies and one seeded coin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewise.llm.common import WORD, column, free_names, set_aside
from citewise.plans.materialize import settle
from citewise.plans.scans import number_rows

PLAN = ("size", "source_size", "target", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def coin(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed, the same in every run and engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(docs: DataFrame, size: Column, weights: Sequence[int] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """(source, source_size, target): all sizes shared out by weight, no target above ceiling times the source's size.

    Sources stand in code point order, null last, and take the weights in turn. What a full source cannot hold is
    shared again among the others; each round reads one row per source and the rounds end when no source fills up.
    """
    spark = docs.sparkSession
    totals = docs.groupBy("source").agg(F.sum(size).alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    dealt = totals.repartitionByRange(spark.sparkContext.defaultParallelism, by_name).withColumn("_part", F.spark_partition_id())
    ranked = number_rows(settle(dealt), [], [by_name], "_rank", block=F.col("_part")).drop("_part")
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = settle(ranked.withColumn("_weight", F.element_at(turn, (F.col("_rank") % len(weights) + 1).cast("int"))))

    full, level, filled = F.lit(False), 0.0, -1
    while True:
        row = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.col("source_size") * ceiling)).alias("held"),
            F.sum(F.when(~full, F.col("_weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("filled"),
        ).first()
        if row["filled"] == filled or not row["open"]:
            break
        filled, level = row["filled"], ((row["total"] or 0) - (row["held"] or 0)) / row["open"]
        full = F.col("source_size") * ceiling < F.col("_weight") * F.lit(level)
    target = F.least((F.col("source_size") * ceiling).cast("double"), F.col("_weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), ceiling: int = 3, seed: int = 0) -> DataFrame:
    """docs with size (words), source_size, target (of the source) and copies of every document.

    A source's rate is target / source_size; a document gets floor(rate) copies and one more with the probability of
    the fraction, by a coin from its doc_id. Rows of the same doc_id share the coin. A null or empty text has size 0
    and gets copies like any other; a source without words has rate 0; a null source is a source of its own, the last.
    Input columns named like the added ones are replaced. An empty table gives an empty one.
    """
    kept = docs.drop(*PLAN)
    (own,) = free_names(kept, "plan_source")
    targets = source_targets(kept, word_count(F.col("text")), weights, ceiling).withColumnRenamed("source", own)
    joined = kept.join(targets, F.col("source").eqNullSafe(F.col(own))).drop(own)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (coin(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")
    return joined.select(
        *[column(c) for c in kept.columns],
        word_count(F.col("text")).alias("size"), "source_size", "target",
        (F.floor(rate) + extra).cast("int").alias("copies"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), ceiling: int = 3, seed: int = 0) -> DataFrame:
    """The mixed corpus: every document as often as its plan says, with the columns of docs, whatever their names."""
    renamed, restore = set_aside(docs, PLAN)
    plan = mixing_plan(renamed, weights, ceiling, seed).filter(F.col("copies") > 0)
    (copy,) = free_names(plan, "copy")
    return restore(plan.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))))
