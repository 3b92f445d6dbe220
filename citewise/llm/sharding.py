"""Sharding by sampled splitters: size-weighted key sample, quantile boundaries, ranges, overfull ranges subdivided."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.llm.common import column, unit_hash
from citewise.plans.materialize import settle

KEY = ("_k1", "_k2", "_k3")
MAX_ROUNDS = 8


def _bounds(rows: Sequence, parts: float, per: float) -> list[tuple]:
    """Keys that cut weighted samples, sorted by key, into pieces of the weight ``per``."""
    found, gathered, due = [], 0.0, per
    for key, weight in rows:
        gathered += weight
        if gathered >= due and len(found) < parts - 1:
            if not found or found[-1] != key:
                found.append(key)
            due = (gathered // per + 1) * per
    return found


def _range_of(bounds: Sequence[tuple]) -> Column:
    if not bounds:
        return F.lit(0)
    key = F.struct(*KEY)
    made = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(KEY, b)]) for b in bounds])
    return F.size(F.filter(made, lambda b: b <= key))


def shard(docs: DataFrame, shards: int = 8, ranges: int = 256, per_range: int = 32, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) and carried columns: contiguous key ranges of near equal bytes.

    Records are ordered by (hash of the text, doc_id, hash of the row), so equal texts lie together and even one text
    that fills the corpus can be cut. About ranges * per_range keys are sampled, a record with a chance that grows
    with its share of bytes plus its share of rows; their weighted quantiles cut the key order into ranges, which are
    then counted exactly. A range with more than twice its share is subdivided by a sample of its own. Running
    sums over the exact counts place every record: shard = shards * (bytes before it) / (all bytes), so shards differ
    by one record at most. The sample decides only how the work is dealt, never where a record goes.

    size is the UTF-8 length plus 1 (null text: 1, and text_crc32 is null); law is "bytes", so grown_shard is null.
    Repeated rows are separate records that take neighbouring slots. Only the length and hash of a text of any length are
    kept. Other columns break ties between rows of one text and doc_id, whatever their names. An empty table gives an empty one.
    """
    text = F.col("text")
    slim = settle(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_k1"),
            F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_k2"),
            F.xxhash64(*[column(c) for c in docs.columns]).alias("_k3"),
            *[F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry],
        )
    )
    whole = slim.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = whole["size"] or 1, whole["rows"] or 1
    load = F.col("size") / F.lit(total) + F.lit(1.0) / F.lit(rows)  # sums to 2

    def sampled(frame: DataFrame, rate: float, seed: int) -> list:
        chance = F.least(F.lit(1.0), load * F.lit(rate))
        drawn = frame.withColumn("_chance", chance).filter(unit_hash(*KEY, seed=seed) < F.col("_chance"))
        found = drawn.select(*KEY, (load / F.col("_chance")).alias("_weight")).collect()
        return sorted(((r[0], r[1], r[2]), r[3]) for r in found)

    share = 2.0 / ranges
    bounds = _bounds(sampled(slim, ranges * per_range / 2.0, 1), ranges, share)
    counted: dict[int, tuple[int, int]] = {}
    for attempt in range(MAX_ROUNDS):
        placed = slim.withColumn("_range", _range_of(bounds))
        counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")).collect()
        counted = {r["_range"]: (r["rows"], r["size"]) for r in counts}
        over = [k for k, (n, s) in counted.items() if n / rows + s / total > 2 * share and n > 1]
        if not over or attempt == MAX_ROUNDS - 1:
            break
        inside = sampled(placed.filter(F.col("_range").isin(over)), ranges * per_range / 2.0, 2 + attempt)
        more = {k for k in _bounds(inside, len(inside) + 1, share / 2)} - set(bounds)
        if not more:
            break
        bounds = sorted([*bounds, *more])
    order = range(len(bounds) + 1)
    row_base = [0, *accumulate(counted.get(k, (0, 0))[0] for k in order)]
    size_base = [0, *accumulate(counted.get(k, (0, 0))[1] for k in order)]

    def base(values: Sequence[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("_range") + 1)

    here = Window.partitionBy("_range").orderBy(*KEY)
    before = F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + base(size_base)
    at = placed.withColumn("_position", F.row_number().over(here) - 1 + base(row_base)).withColumn("_before", before)
    at = settle(at.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_before") * shards / F.lit(total))).cast("int")))
    first = {r["shard"]: r["first"] for r in at.groupBy("shard").agg(F.min("_position").alias("first")).collect()}
    start = F.element_at(F.array(*[F.lit(first.get(s, 0)).cast("bigint") for s in range(shards)]), F.col("shard") + 1)
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_position") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"`_carry_{c}`").alias(c) for c in carry],
    )
