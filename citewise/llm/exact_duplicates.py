"""Exact duplicates by an extendible-hash index that is kept as shared tables; DataFrame functions only.

The index has a directory, whose 2^depth slots name buckets by the leading bits of a key, and the buckets' entries, one
per distinct key. A bucket with more entries than its capacity is split by one more bit, and the directory doubles
until no bucket overflows. Tasks own ranges of keys. Equal keys with different texts form a chain: the texts' own
bytes decide, so the result does not depend on the hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewise.plans.materialize import settle

# A run of white space that is not already a single space; a run of one space stays as it is.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
FINER = 6  # bits by which the counted prefixes are finer than the buckets are expected to be


@dataclass
class Index:
    """entries (uid, doc_id, key, sha) of every row; directory (slot, bucket, depth); buckets (bucket, key, n, first)."""

    entries: DataFrame
    directory: DataFrame
    buckets: DataFrame
    depth: int


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def hash_key(text: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash, the rest zero."""
    whole = F.xxhash64(text)
    return whole if bits == 64 else F.shiftleft(F.shiftrightunsigned(whole, 64 - bits), 64 - bits)


def prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def split_buckets(keys: DataFrame, capacity: int, bits: int) -> DataFrame:
    """(bucket, depth, n): the smallest depths at which no prefix holds more than capacity keys, as (prefix, depth).

    Keys are counted once by a prefix finer than needed; all levels of the doubling follow from those counts.
    """
    total = keys.count()
    fine = min(bits, 62, max(0, (max(1, total // capacity) - 1).bit_length()) + FINER)
    while True:
        counted = settle(keys.groupBy(prefix(F.col("key"), fine).alias("cell")).agg(F.count("*").alias("n")))
        if fine == min(bits, 62) or counted.filter(F.col("n") > capacity).isEmpty():
            break
        fine = min(bits, 62, fine + FINER)
    levels = counted.select(F.explode(F.sequence(F.lit(0), F.lit(fine))).alias("depth"), "cell", "n")
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {fine} - depth)"))
    levels = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("n"))
    overfull = (F.col("n") > capacity) & (F.col("depth") < fine)
    parents = levels.filter(overfull).select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("above"))
    own = levels.filter(~overfull).withColumn("above", F.shiftright("bucket", 1))
    split = own.join(parents, ["depth", "above"], "left_semi").unionByName(own.filter("depth = 0"))
    return settle(split.select("bucket", "depth", "n"))


def build_index(docs: DataFrame, capacity: int = 1 << 16, bits: int = 64) -> Index:
    """The index of all texts; capacity counts distinct keys of a bucket, bits are those of a key that are used."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    rows = texts.select("doc_id", hash_key(F.col("text"), bits).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"))
    entries = settle(rows.withColumn("uid", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")
    keys = settle(entries.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    split = split_buckets(keys, capacity, bits)
    depth = split.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    first = F.expr(f"shiftleft(bucket, {depth} - depth)")
    slots = F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth) - 1"))
    directory = settle(split.select(F.explode(slots).alias("slot"), first.alias("bucket"), "depth"))
    found = keys.withColumn("slot", prefix(F.col("key"), depth)).join(directory.select("slot", "bucket"), "slot").drop("slot")
    owned = found.repartitionByRange(F.col("bucket"), F.col("key")).sortWithinPartitions("bucket", "key")
    return Index(entries, directory, settle(owned.select("bucket", "key", "n", "first")), depth)


def chained_keys(docs: DataFrame, bits: int) -> DataFrame:
    """Keys that belong to more than one text. Copies are counted where they lie, so a large group travels once per task."""
    texts = docs.select(normalised(F.col("text")).alias("text"))
    distinct = texts.groupBy(hash_key(F.col("text"), bits).alias("key"), "text").agg(F.lit(1).alias("one"))
    return settle(distinct.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1").select("key"))


def _judged(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Each row with the row of its group that stays; groups of one row need no entry."""
    several = groups.filter("n > 1").select(*on, "n", F.col("first.doc_id").alias("first_id"), F.col("first.uid").alias("first_uid"))
    joined = rows.join(several, on, "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("uid") == F.col("first_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, capacity: int = 1 << 16, bits: int = 64) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Texts are equal when they are after each run of white space became one space (no trimming); null counts as empty,
    and empty texts equal each other. Of equal texts the row with the smallest doc_id stays, a null doc_id last; of
    rows that also share the doc_id exactly one stays, and keep_id is null only where no row of the group has an id.
    Rows of one doc_id with different texts are judged apart. Texts of any length are hashed and compared whole.
    Other columns are not read, whatever their names. An empty table gives an empty one.
    """
    index = build_index(docs, capacity, bits)
    chained = chained_keys(docs, bits)
    if chained.isEmpty():
        return _judged(index.entries, index.buckets, ["key"])
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("key", hash_key(F.col("text"), bits))
    rows = settle(texts.join(chained, "key", "left_semi").withColumn("uid", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")
    chains = rows.groupBy("key", "text").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    compared = _judged(rows.withColumn("sha", F.unhex(F.sha2("text", 256))), chains, ["key", "text"])
    plain = _judged(index.entries.join(chained, "key", "left_anti"), index.buckets, ["key"])
    return plain.unionByName(compared)
