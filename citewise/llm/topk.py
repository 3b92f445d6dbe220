"""Exact top-k by inner product with a three-phase uniform threshold over column blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.llm.common import map_batches
from citewise.plans.materialize import settle

BLOCK_BYTES = 8 << 20  # of query vectors that are searched in one pass over the table
CELLS = 1 << 20  # scores that a task holds at once
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length, the smaller among equals; 0 for an empty table."""
    sizes = vectors.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    row = sizes.orderBy(F.desc("rows"), "n").first()
    return row["n"] if row else 0


def query_blocks(queries: DataFrame, dim: int, item: int = 8):
    """Query ids and vectors in blocks of a bounded number of bytes, dealt by hash; each distinct row is asked once."""
    chosen = settle(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("own")))
    blocks = max(1, -(-chosen.count() * dim * item // BLOCK_BYTES))
    for b in range(blocks):
        part = chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        if part.num_rows:
            yield part


def vectors_of(batch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("embedding").combine_chunks().flatten() if isinstance(batch, pa.Table) else batch.column("embedding").flatten(), np.float64).reshape(-1, dim)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as float64, which holds it exactly."""
    return np.floor(256 * vectors)


def _products(queries: np.ndarray, points: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return queries @ points.T
    integers = [np.array([[int(x) for x in row] for row in side], object).reshape(side.shape) for side in (queries, points)]
    return integers[0] @ integers[1].T


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, blocks: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query, exactly.

    Components count as floor(256 x). The columns are cut into ``blocks`` lists of partial scores. First every task
    takes the k best entries of each list, completes their scores and notes the smallest entry of the list; the k-th best
    completed score of all tasks is a safe cutoff t. Whoever reaches t in total has, in some list, at least its
    share: min + (t - sum of mins) / blocks. Second, entries at or above that are collected; a row with none is out. Third, the rows
    left are completed, and those below t dropped. Queries are asked in blocks of bounded size against rows that stay where they lie.

    The query's own vec_id is no candidate; ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, or of another length than most, take no part. Rows with a null vec_id take no part. Repeated vec_ids are candidates
    each; a repeated query is asked once, with the smallest vector. Fewer than k candidates give as many rows; scores beyond a long are cut to its bounds.
    Other columns are not read, whatever their names. An empty table gives an empty one.
    """
    shape = "query_id bigint, rank int, vec_id bigint, score bigint"
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    dim = usual_length(base)
    spark = vectors.sparkSession
    if not dim:
        return spark.createDataFrame([], shape)
    base, asked = base.filter(F.size("embedding") == dim), asked.filter(F.size("embedding") == dim)
    borders = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    cuts = list(zip(borders[:-1], borders[1:]))
    found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    for part in query_blocks(asked, dim):
        # a block is answered and written before the next one is held
        found = found.unionAll(settle(_search(base, part, dim, cuts, k)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(base: DataFrame, part: pa.Table, dim: int, cuts: list[tuple[int, int]], k: int) -> DataFrame:
    ids = np.asarray(part.column("vec_id"), np.int64)
    asked = whole(vectors_of(part, dim))
    largest = np.abs(asked).max()
    step = max(1, CELLS // len(ids))

    def pieces(batch):
        own, raw = np.asarray(batch.column("vec_id"), np.int64), whole(vectors_of(batch, dim))
        for at in range(0, len(own), step):
            points = raw[at : at + step]
            exact = largest * np.abs(points).max() * dim < EXACT
            yield own[at : at + step], points, exact, [_products(asked[:, a:b], points[:, a:b], exact) for a, b in cuts]

    def gather(batches):
        """Per query: the k best completed scores among the k best entries of each list, and the lists' minima."""
        tops = lows = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for own, points, exact, lists in pieces(batch):
                mine = own[None, :] == ids[:, None]
                total = sum(lists)
                low = np.stack([part.min(axis=1) for part in lists], axis=1)
                lows = low if lows is None else np.minimum(lows, low)
                chosen = np.zeros(total.shape, bool)
                take = min(k + 1, len(own))
                for part_scores in lists:
                    best = np.argpartition(-part_scores.astype(np.float64), take - 1, axis=1)[:, :take]
                    np.put_along_axis(chosen, best, True, axis=1)
                chosen &= ~mine
                held = np.where(chosen, total.astype(np.float64), -np.inf)
                held = np.concatenate([held, tops], axis=1) if tops is not None else held
                tops = -np.sort(-held, axis=1)[:, :k]
        if lows is None:
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(tops.astype(np.float64).tolist(), pa.list_(pa.float64())), pa.array(lows.astype(np.float64).tolist(), pa.list_(pa.float64()))],
            ["query_id", "tops", "lows"],
        )

    gathered = settle(base.mapInArrow(gather, "query_id bigint, tops array<double>, lows array<double>"))
    tops = gathered.select("query_id", F.explode("tops").alias("v")).filter(F.col("v") > F.lit(-float("inf")))
    kth = tops.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("v")))).filter(F.col("r") == k)
    lows = gathered.select("query_id", F.posexplode("lows").alias("list", "v")).groupBy("query_id", "list").agg(F.min("v").alias("v"))
    cutoff = {r["query_id"]: r["v"] for r in kth.select("query_id", "v").collect()}
    least = {(r["query_id"], r["list"]): r["v"] for r in lows.collect()}
    m = len(cuts)
    floor = np.array([cutoff.get(q, -1e300) for q in ids.tolist()])
    floor -= np.abs(floor) * 1e-9 + 1e-6  # rounding may only let more entries through
    lowest = np.array([[least.get((q, j), 0.0) for j in range(m)] for q in ids.tolist()])
    share = lowest + ((floor - lowest.sum(axis=1)) / m)[:, None]
    share -= np.abs(share) * 1e-9 + np.abs(lowest) * 1e-9 + 1e-6

    def resolve(batches):
        """Rows with an entry at or above a list's share, completed, at or above the cutoff: the k best of the task."""
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            for own, points, exact, lists in pieces(batch):
                enough = np.zeros((len(ids), len(own)), bool)
                for j, part_scores in enumerate(lists):
                    enough |= part_scores >= share[:, j : j + 1]
                enough &= own[None, :] != ids[:, None]
                q, p = np.nonzero(enough)
                total = lists[0][q, p]
                for part_scores in lists[1:]:
                    total = total + part_scores[q, p]
                good = total >= floor[q]
                if not exact:
                    total = np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in total], object)
                kept.append((q[good], own[p[good]], total[good].astype(np.int64)))
                if sum(len(x[0]) for x in kept) > CELLS:
                    kept = [_best(kept, k)]
        if kept:
            q, p, s = _best(kept, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(p), pa.array(s)], ["query_id", "vec_id", "score"])

    return base.mapInArrow(resolve, "query_id bigint, vec_id bigint, score bigint")


def _best(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, p, s = (np.concatenate(c) for c in zip(*kept))
    order = np.lexsort((p, -s, q))
    q, p, s = q[order], p[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[rank < k], p[rank < k], s[rank < k]
