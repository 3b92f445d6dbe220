"""MinHash near-duplicates with HyperMinHash registers: banded, estimated with collision correction, then verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewise.llm.common import map_batches
from citewise.llm.components import components
from citewise.llm.shingles import mixed, shingle_sets
from citewise.plans.materialize import parts_for, settle

BUCKETS = 64
ROWS = 4  # registers of a band
MANTISSA = 10
MARGIN = 0.2  # over four standard errors of the estimate below the threshold
STAR_ROUNDS = 3
PAIRED = 32  # members up to which a bucket's pairs are listed; larger buckets are compared in blocks
BLOCK = 128
PERCENT = 85
PART = 1 << 20  # shingles whose rows make up a file


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, buckets) uint16: leading-zero count and mantissa bits of each bucket's smallest hash, 0 for an empty bucket."""
    out = np.zeros((len(sets), BUCKETS), np.uint64)
    held = np.zeros((len(sets), BUCKETS), bool)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    floors = np.arange(BUCKETS, dtype=np.uint64) << shift
    for i, own in enumerate(sets):
        if len(own):
            at = np.minimum(np.searchsorted(own, floors), len(own) - 1)
            low = own[at]
            held[i] = (low >> shift) == (floors >> shift)
            out[i] = low << np.uint64(BUCKETS.bit_length() - 1)
    zeros = np.uint64(64) - np.frexp(np.maximum(out, np.uint64(1)).astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(62))
    rest = (out << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(held, ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | rest, np.uint64(0)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, bands): four registers and the band's number.

    An empty bucket borrows from the first full one in an order of its own, so that the bands of a short text still
    depend on several of its shingles.
    """
    turns = np.argsort(mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), axis=1)
    filled = regs.copy()
    for turn in turns.T:
        empty = filled == 0
        if not (empty.any(axis=1) & (regs > 0).any(axis=1)).any():
            break
        filled = np.where(empty, regs[:, turn], filled)
    grouped = filled.astype(np.uint64).reshape(len(regs), BUCKETS // ROWS, ROWS)
    packed = np.zeros(grouped.shape[:2], np.uint64)
    for r in range(ROWS):
        packed = (packed << np.uint64(16)) | grouped[:, :, r]
    return mixed(packed + mixed(np.arange(1, BUCKETS // ROWS + 1, dtype=np.uint64))[None, :]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers: equal ones less the expected accidental ones, over the filled ones."""
    equal = ((a == b) & (a > 0)).sum(axis=1)
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    levels = np.arange(58)[None, :]
    chance = lambda size: np.exp(-size[:, None] / BUCKETS * 0.5 ** (levels + 1)) - np.exp(-size[:, None] / BUCKETS * 0.5**levels)
    accidental = BUCKETS * (chance(n) * chance(m)).sum(axis=1) / (1 << MANTISSA)
    return np.maximum(0, equal - accidental) / np.maximum(1, filled)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, regs): size, 128-bit digest and registers of every document's shingle set."""

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column("text"))
        first = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
        second = np.array([mixed(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) for s in sets], np.uint64)
        regs = pa.array([r.tobytes() for r in registers(sets)], pa.binary())
        columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _signed(first), _signed(second), regs]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "regs"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(source, sign, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, regs binary", "text")


def _bands(classes: DataFrame) -> DataFrame:
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(batch.num_rows, BUCKETS)
        keys = band_keys(regs)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column("rep"), np.int64), keys.shape[1]))], ["key", "rep"])

    return map_batches(classes.select("rep", "regs"), cut, "key bigint, rep bigint")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles): the whole shingle sets of the wanted documents."""

    def gather(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([s.tobytes() for s in shingle_sets(part.column("text"))], pa.binary())
        return pa.RecordBatch.from_arrays([part.column("rep"), sets], ["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(wanted.hint("merge"), "rep", "left_semi")
    return map_batches(texts, gather, "rep bigint, shingles binary", "text")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose registers do not rule the similarity out."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb")]
        sizes = [np.asarray(batch.column(c), np.float64) for c in ("na", "nb")]
        good = (estimate(*regs, *sizes) >= percent / 100 - MARGIN) & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes))
        return batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    return map_batches(pairs.join(side("b"), "b").join(side("a"), "a"), judge, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * common >= percent * all shingles, counted on whole sets."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            left, right = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            at = np.minimum(np.searchsorted(left, right), len(left) - 1)
            common = int((left[at] == right).sum())
            good.append(100 * common >= percent * (len(left) + len(right) - common))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}"))
    return map_batches(pairs.join(side("b"), "b").join(side("a"), "a"), judge, "a bigint, b bigint")


def _linked_in(reps: np.ndarray, comps: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Verified pairs of different blocks (or of one, if there is just one) that join different components, as few as join them all."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)), np.float32)
    place = np.cumsum(counts > 1) - 1  # only shingles of several members count
    shared = counts[inverse] > 1
    columns, rows = place[inverse[shared]], owner[shared]
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], rows[order]
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
        low, high = np.searchsorted(columns, [at, at + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[rows[low:high], columns[low:high] - at] = 1
        common += held @ held.T
    sizes = np.array([len(s) for s in sets], np.float64)
    good = 100 * common.astype(np.float64) >= percent * (sizes[:, None] + sizes[None, :] - common)
    good &= comps[:, None] != comps[None, :]
    if blocks.min() != blocks.max():
        good &= blocks[:, None] != blocks[None, :]
    top: dict[int, int] = {}

    def head(c: int) -> int:
        while top.setdefault(c, c) != c:
            c = top[c]
        return c

    found = []
    for i, j in zip(*np.nonzero(np.triu(good))):
        a, b = head(int(comps[i])), head(int(comps[j]))
        if a != b:
            top[max(a, b)] = min(a, b)
            found.append((int(reps[i]), int(reps[j])))
    return found


def _linked_in_blocks(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links between components inside large buckets.

    A bucket is cut into blocks of about BLOCK members and every two blocks meet in one group of bounded size, where whole
    sets are compared; a group gives fewer links than it has members.
    """

    def judge(batches):
        key, held = None, []

        def flush():
            if len({h[1] for h in held}) > 1:
                reps, comps, blocks = (np.array([h[i] for h in held], np.int64) for i in range(3))
                if links := _linked_in(reps, comps, blocks, [h[3] for h in held], percent):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "x", "y", "rep", "component", "block")]
            for k, x, y, rep, component, block, own in zip(*columns, batch.column("shingles")):
                if (k, x, y) != key:
                    yield from flush()
                    key, held = (k, x, y), []
                held.append((rep, component, block, np.frombuffer(own.as_buffer(), np.uint64)))
        yield from flush()

    count = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = crowded.join(count, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(sets, "rep")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", "component", "block", "shingles")
    grouped = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return grouped.mapInArrow(judge, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    Documents with the same shingle set form a class, represented by its smallest doc_id; only representatives go on.
    Their 64 registers are banded by four. In a bucket of equal bands every member meets a pivot first: the smallest id, then
    members chosen by hash. Candidates pass the collision-corrected estimate and are then verified on whole sets. What
    is linked is one component; at last the members of a bucket that lie in different components are compared with
    each other, as pairs in a small bucket and block by block in a large one, where only verified links leave the
    task. So no bucket is capped, and only pairs that could not join anything are left out.
    Links: 100 * common >= percent * union over distinct shingles of five words.

    A null or empty text, or one without words, has no shingles and is linked with nothing; so is a row without
    doc_id, whose component_id is null and which is kept. Repeated rows get equal rows. doc_id has to name one text: rows of
    one doc_id with different texts get a row each with the size of their own text, and count as linked if any of
    their texts is (the pipeline gives such texts ids of their own first). Whole texts of any length are read, a
    bounded number of bytes at a time unless one text is longer. Other columns are not read, whatever their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    signed = settle(signatures(docs))
    parts = parts_for(spark, signed.agg(F.sum("n_shingles")).first()[0], PART)
    named = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    grouped = named.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n_shingles", "regs")).alias("first"))
    classes = settle(grouped.select("d1", "d2", F.col("first.doc_id").alias("rep"), "first.n_shingles", "first.regs"), parts)

    bands = settle(_bands(classes), parts)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key")
    members = settle(bands.join(shared, "key").distinct(), parts)
    sets = settle(_sets(docs, members.select("rep").distinct()), parts)

    tested = spark.createDataFrame([], "a bigint, b bigint")
    links = tested
    found = members.select(F.col("rep").alias("id"), F.col("rep").alias("component")).distinct()
    for attempt in range(STAR_ROUNDS + 1):
        placed = settle(members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), parts)
        order = F.col("rep") if attempt == 0 else F.xxhash64(F.lit(attempt), "rep")
        pivots = placed.groupBy("key").agg(
            F.min(F.struct(order.alias("h"), F.col("rep").alias("pivot"), F.col("component").alias("at"))).alias("p"),
            F.min("component").alias("least"), F.max("component").alias("most"),
        ).filter(F.col("least") < F.col("most"))
        if attempt < STAR_ROUNDS:
            met = placed.join(pivots.select("key", "p.pivot", "p.at"), "key").filter(F.col("component") != F.col("at"))
            pairs = met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        else:
            open_ = settle(placed.join(pivots.select("key"), "key"), parts)
            large = settle(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRED).select("key"), parts)
            crowded = settle(_linked_in_blocks(open_.join(large, "key", "left_semi"), sets, percent), parts)
            rest = open_.join(large, "key", "left_anti")
            other = rest.select("key", F.col("rep").alias("b"), F.col("component").alias("other"))
            pairs = rest.join(other, "key").filter((F.col("component") != F.col("other")) & (F.col("rep") < F.col("b"))).select(F.col("rep").alias("a"), "b")
        fresh = settle(pairs.distinct().join(tested, ["a", "b"], "left_anti"), parts)
        linked = settle(_verified(settle(_estimated(fresh, classes, percent), parts), sets, percent), parts)
        tested = tested.unionAll(fresh)
        if attempt == STAR_ROUNDS:
            linked = linked.unionAll(crowded)
        if not linked.isEmpty():
            links = links.unionAll(linked)
            found = components(links, parts)

    member = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("_component"))
    joined = signed.join(settle(member, parts), ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
