"""Approximate nearest neighbours: inverted lists scanned by column blocks of rotated vectors, candidates given up early."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewise.llm.common import map_batches, unit_hash
from citewise.llm.topk import query_blocks, usable, usual_length, vectors_of
from citewise.plans.materialize import settle

LISTS = 64
PROBES = 44  # near-isotropic vectors spread their neighbours over many lists
SAMPLE_ROWS = 8192  # vectors the lists are fitted on
SAMPLE_BYTES = 32 << 20
CONFIDENCE = 3.0  # larger: fewer candidates given up by mistake
STEP = 512  # rows that are scanned between two updates of the thresholds
COLUMNS = 16


@dataclass(frozen=True)
class Index:
    """rows (vec_id, list, embedding, rotated), the lists' centres, their sizes and the rotation."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    rotation: np.ndarray


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home = nearest_list(sample, centres)
        for c in np.unique(home):
            centres[c] = sample[home == c].mean(axis=0)
    return centres


def nearest_list(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T, axis=1)


def build_index(vectors: DataFrame, dim: int, lists: int = LISTS, seed: int = 3) -> Index | None:
    """Every usable row with its list; centres are fitted on a sample of at most about SAMPLE_ROWS rows, chosen by hash."""
    count = vectors.count()
    if not count:
        return None
    rows = min(SAMPLE_ROWS, max(lists, SAMPLE_BYTES // (8 * dim)))
    chosen = vectors.filter(unit_hash("vec_id", seed=seed) < min(1.0, rows / count)).orderBy("vec_id").limit(2 * rows).toArrow()
    if not chosen.num_rows:
        chosen = vectors.limit(lists).toArrow()
    centres = fit_lists(vectors_of(chosen, dim), lists)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = vectors_of(batch, dim)
        turned = pa.FixedSizeListArray.from_arrays(pa.array((points @ rotation).astype(np.float32).ravel()), dim).cast(pa.list_(pa.float32()))
        columns = [batch.column("vec_id"), pa.array(nearest_list(points, centres).astype(np.int32)), batch.column("embedding"), turned]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "list", "embedding", "rotated"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = map_batches(vectors.select("vec_id", "embedding"), place, f"vec_id bigint, list int, embedding {kind}, rotated array<float>")
    stored = settle(placed.sortWithinPartitions("list"))
    sizes = np.zeros(len(centres), np.int64)
    for r in stored.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    return Index(stored, centres, sizes, rotation)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = LISTS, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found by Euclidean distance, nearest first.

    Vectors are turned by one random rotation and kept in lists by nearest centre. A query probes its ``probes`` nearest
    lists, or more until they hold k candidates. In a list, squared distances grow by blocks of 16 columns; after d of D
    columns a candidate is given up when its part exceeds what a vector at the query's present k-th distance would show
    at the chosen confidence: r^2 * d/D * (1 + 3/sqrt(d))^2. Survivors get the exact distance of the original vectors in double precision.

    The query's own vec_id is no candidate; ties go to the smaller vec_id. Vectors that are null, zero, hold null or non-finite
    components, or have another length than most, and rows with a null vec_id, take no part. Repeated vec_ids are
    candidates each; a repeated query is asked once, with the smallest vector. Lists are scanned where their rows lie, so a list may hold any share of all rows.
    Other columns are not read, whatever their names. An empty table gives an empty one.
    """
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession

    def clean(frame: DataFrame) -> DataFrame:
        moved = F.exists(F.col("embedding"), lambda x: x != 0)
        return frame.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & moved)

    base, asked = clean(vectors), clean(queries)
    dim = usual_length(base)
    if not dim:
        return spark.createDataFrame([], shape)
    index = build_index(base.filter(F.size("embedding") == dim), dim, lists)
    found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    for part in query_blocks(asked.filter(F.size("embedding") == dim), dim):
        # a block is answered and written before the next one is held
        found = found.unionAll(settle(_search(index, part, dim, k, probes)))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def probed(index: Index, asked: np.ndarray, own: np.ndarray, k: int, probes: int) -> np.ndarray:
    """(queries, lists): the nearest lists, and as many more as hold k candidates besides the query's own rows."""
    apart = (index.centres**2).sum(axis=1)[None, :] - 2 * asked @ index.centres.T
    order = np.argsort(apart, axis=1, kind="stable")
    held = np.cumsum(index.sizes[order], axis=1)
    before = np.concatenate([np.zeros((len(asked), 1), np.int64), held[:, :-1]], axis=1)
    wanted = (np.arange(order.shape[1])[None, :] < probes) | (before < (k + own)[:, None])
    chosen = np.zeros(order.shape, bool)
    np.put_along_axis(chosen, order, wanted, axis=1)
    return chosen


def _search(index: Index, part: pa.Table, dim: int, k: int, probes: int) -> DataFrame:
    ids = np.asarray(part.column("vec_id"), np.int64)
    asked = vectors_of(part, dim)
    turned = asked @ index.rotation
    visits = probed(index, asked, np.asarray(part.column("own"), np.int64), k, probes)
    ends = [*range(COLUMNS, dim, COLUMNS), dim]
    slack = {d: d / dim * (1 + CONFIDENCE / np.sqrt(d)) ** 2 if d < dim else 1 + 1e-4 for d in ends}

    def scan(batches):
        limit = np.full(len(ids), np.inf)  # squared distance of the present k-th neighbour
        best: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, home = np.asarray(batch.column("vec_id"), np.int64), np.asarray(batch.column("list"))
            points, original = np.asarray(batch.column("rotated").flatten(), np.float64).reshape(-1, dim), vectors_of(batch, dim)
            for name in np.unique(home):
                rows, q = np.flatnonzero(home == name), np.flatnonzero(visits[:, name])
                for at in range(0, len(rows) if len(q) else 0, STEP):
                    r = rows[at : at + STEP]
                    i, j = _survivors(points[r], turned[q], own[r], ids[q], limit[q], ends, slack)
                    gap = original[r[i]] - asked[q[j]]
                    score = np.sqrt((gap * gap).sum(axis=1))
                    best = _merge(best, q[j], own[r[i]], score, k)
                    full = np.bincount(best[0], minlength=len(ids)) == k
                    last = np.searchsorted(best[0], np.flatnonzero(full), side="right") - 1
                    limit[full] = best[2][last] ** 2
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

    return index.rows.mapInArrow(scan, "query_id bigint, vec_id bigint, score double")


def _survivors(points, turned, own, ids, limit, ends, slack):
    """(row, query) pairs that no block of columns ruled out; a query without k neighbours yet rules out nothing."""
    first = ends[0]
    a, b = points[:, :first], turned[:, :first]
    apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    i, j = np.nonzero((apart <= limit[None, :] * slack[first] + 1e-9) & (own[:, None] != ids[None, :]))
    apart = apart[i, j]
    for start, end in zip(ends[:-1], ends[1:]):
        gap = points[i, start:end] - turned[j, start:end]
        apart = apart + (gap * gap).sum(axis=1)
        stay = apart <= limit[j] * slack[end] + 1e-9
        i, j, apart = i[stay], j[stay], apart[stay]
    return i, j


def _merge(best, q, p, score, k):
    q, p, score = np.concatenate([best[0], q]), np.concatenate([best[1], p]), np.concatenate([best[2], score])
    order = np.lexsort((p, score, q))
    q, p, score = q[order], p[order], score[order]
    stay = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return [q[stay], p[stay], score[stay]]
