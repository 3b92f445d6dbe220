"""Second stage: score candidates, filter by floor and margin, keep the best few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.text import lexical_overlap, words_within

KEPT = 5


def rank_and_filter(
    scored: DataFrame,
    top_n: int = KEPT,
    min_score: float | None = None,
    score_margin: float | None = None,
    score: str = "score",
    index: str = "idx",
    failed: str | None = None,
) -> DataFrame:
    """Best first (ties by ``index``); the absolute floor applies before the margin below the best survivor.

    Where the column ``failed`` is true, scores do not count: rows stand by ``index`` and no filter applies.

    The filters come after the cut to ``top_n``, which they cannot change: what they drop ranks last. So every task
    forwards at most ``top_n`` rows per question, and a costly score is not evaluated again in a filter pushed below.
    """
    counts = F.when(~F.col(failed), F.col(score)) if failed else F.col(score)
    order = Window.partitionBy("question_id").orderBy(F.desc_nulls_last(counts), index)
    ranked = scored.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= top_n)
    keep = F.col(score).isNotNull()
    if min_score is not None:
        keep = keep & (F.col(score) >= F.lit(min_score))
    if score_margin is not None:
        ranked = ranked.withColumn("_best", F.max(score).over(Window.partitionBy("question_id")))
        keep = keep & (F.col(score) >= F.col("_best") - F.lit(score_margin))
    return ranked.filter(F.col(failed) | keep if failed else keep).drop("_best")


def rerank_by_overlap(
    candidates: DataFrame, top_n: int = KEPT, question: str = "question", text: str = "text", plain: str | None = None
) -> DataFrame:
    """Default reranker: number of shared words; candidates that share none are dropped.

    ``plain`` names a column with the ``spaced`` texts, made once for every text rather than for every candidate; it is dropped.
    """
    overlap = words_within(F.col(question), F.col(plain)) if plain else lexical_overlap(F.col(question), F.col(text))
    scored = candidates.withColumn("overlap", overlap.cast("bigint")).drop(*([plain] if plain else []))
    return rank_and_filter(scored, top_n, min_score=1, score="overlap", index="rank")


def rerank_by_model(candidates: DataFrame, scorer, top_n: int = KEPT, **limits) -> DataFrame:
    """``scorer(question, text) -> Column`` (usually a pandas UDF over pairs) gives the relevance.

    A question with a candidate that has no relevance (the scorer failed on it) keeps the order of retrieval, cut to
    ``top_n`` and not filtered: a better order is worth nothing if it costs the answer.
    """
    scored = candidates.withColumn("relevance", scorer(F.col("question"), F.col("text")).cast("double"))
    missing = F.max(F.col("relevance").isNull()).over(Window.partitionBy("question_id"))
    judged = scored.withColumn("_failed", missing)
    return rank_and_filter(judged, top_n, score="relevance", index="rank", failed="_failed", **limits).drop("_failed")


def gather_by_order(candidates: DataFrame, verdicts: DataFrame, top_n: int = KEPT) -> DataFrame:
    """Keep candidates in the order a verdict lists them.

    ``verdicts(question_id, verdict array<int>)`` holds 0-based candidate positions. A null verdict (the call failed)
    falls back to the retrieval order; an empty one keeps nothing.
    """
    indexed = candidates.withColumn("idx", (F.col("rank") - 1).cast("int"))
    listed = indexed.groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    fallback = F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(top_n)) - 1)
    orders = listed.join(verdicts, "question_id", "left").select(
        "question_id", F.posexplode(F.coalesce("verdict", fallback)).alias("_position", "idx")
    )
    kept = indexed.join(orders.filter(F.col("_position") < top_n), ["question_id", "idx"])
    return kept.withColumn("final_rank", F.col("_position") + 1).drop("_position")


def dropped_candidates(candidates: DataFrame, kept: DataFrame, key: Column | str = "chunk_id") -> DataFrame:
    """Candidates the reranker did not select."""
    return candidates.join(kept.select("question_id", key), ["question_id", key], "left_anti")
