"""A training corpus in five stages: language, near-duplicates, repeated passages, source mix, token pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.llm.common import column, free_names, set_aside
from citewise.llm.language import LETTER, UNKNOWN, held_out, identify_language
from citewise.llm.mixing import mix
from citewise.llm.near_duplicates import near_duplicates
from citewise.llm.pieces import encode
from citewise.llm.repeats import without_repeats
from citewise.plans.materialize import settle, settle_alone

NEAR_PERCENT = 80  # of the stage; the query op1 has a threshold of its own


def with_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a letter. lang becomes the predicted language; where nothing could be learnt it stays, or is "und"."""
    renamed, restore = set_aside(docs, ("lang_pred", "score"))
    learnt = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify_language(renamed, learnt).filter((F.col("lang_pred") != UNKNOWN) | F.col("text").rlike(LETTER))
    told = F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred")).otherwise(F.coalesce("lang", F.lit(UNKNOWN)))
    return restore(found.withColumn("lang", told))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate component (similarity of 0.8 or more), the one with the smallest doc_id, once.

    Different texts of one doc_id are different documents: where there are any, every (doc_id, text) is judged under
    an id of its own, in the order of doc_id.
    """
    (label,) = free_names(docs, "label")
    labelled = docs.withColumn(label, F.xxhash64(F.coalesce("text", F.lit(""))))
    named = labelled.filter(F.col("doc_id").isNotNull())
    pairs = settle(named.select("doc_id", F.col(label).alias("label")).distinct())
    if pairs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept, key = settle_alone(lambda: near_duplicates(docs, percent=NEAR_PERCENT).filter("kept").select("doc_id").distinct()), ["doc_id"]
    else:
        ids = settle(pairs.orderBy("doc_id", "label").withColumn("id", F.monotonically_increasing_id()))
        texts = named.select("doc_id", F.col(label).alias("label"), "text")
        own = settle(texts.join(ids, ["doc_id", "label"]).select(F.col("id").alias("doc_id"), "text"))
        judged = settle_alone(lambda: near_duplicates(own, percent=NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias("id")).distinct())
        kept, key = ids.join(judged, "id", "left_semi").select("doc_id", F.col("label").alias(label)), ["doc_id", label]
    once = named.join(kept.filter(F.col("doc_id").isNotNull()), key, "left_semi").dropDuplicates(["doc_id", label])
    return once.drop(label).unionByName(docs.filter(F.col("doc_id").isNull())).select(*[column(c) for c in docs.columns])


def without_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that an earlier document holds; n_chars follows the text."""
    cleaned = without_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*[column(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target shares."""
    return mix(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, lang, source and the piece ids of every document that the mix takes."""
    coded = encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size(F.coalesce("pieces", F.array().cast("array<int>"))).cast("bigint").alias("n_pieces"), "pieces")


STAGES = [
    ("language", with_language),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeated_passages),
    ("mixing", mixed_sources),
    ("pieces", as_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; each is written and read again before the next, the last is returned as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
