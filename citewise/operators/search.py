"""Exact cosine top-k of questions against stored points, inside each tenant.

Questions are cut into blocks of bounded size. A block's vectors go to every task once and the points are scanned where
they lie, once per block; a task keeps the best k per question, so nothing but those winners is shuffled.

No question x point pairs are emitted. Ties go to the smaller point id; scores are rounded before ranking.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewise.functions.hashing import DEFAULT_DIM, hashed_vector
from citewise.plans.materialize import settle, shared_path

CANDIDATES = 15
DEFAULT_K = 6
SHEETS_K = 2
SCORE_DIGITS = 6
BLOCK_BYTES = 64 * 1024 * 1024  # of question vectors that one pass over the points holds
BLOCK_SCORES = 1_000_000
POINT_ROWS = 2048  # points that a worker opens at a time
HELD_ROWS = 100_000  # hits that may gather before they are cut to the best
SCORE_SLACK = 2 * 10.0**-SCORE_DIGITS  # scores that are equal when rounded lie closer together
TENANT, BLOCK = "_tenant", "_block"


def embed(df: DataFrame, text: str = "text", out: str = "vector", dim: int = DEFAULT_DIM, provider=None) -> DataFrame:
    """Add an embedding column: the hashed vector, or what ``provider`` (a Column -> Column plug-in) gives."""
    return df.withColumn(out, provider(F.col(text)) if provider else hashed_vector(F.col(text), dim))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow vectors (dense lists or sparse bucket/weight lists) -> float64 rows of length one (zero rows stay zero)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.zeros((len(column), dim))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    flat = column.flatten()
    if pa.types.is_struct(flat.type):
        owner = np.repeat(np.arange(len(column)), lengths)
        rows[owner, np.asarray(flat.field("bucket"))] = np.asarray(flat.field("weight"))
    else:
        if not np.isin(lengths, (0, dim)).all():
            raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} values where {dim} are expected")
        rows[lengths == dim] = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=rows, where=norms > 0)


def _winners(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, question) positions that may belong to a top-k: not below the k-th score met before (``least``) nor, where
    many are above it, the k-th of this part; ties with either are all kept."""
    found = scores >= least - SCORE_SLACK
    if len(scores) > k and np.count_nonzero(found) > k * scores.shape[1]:
        found &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] - SCORE_SLACK
    return np.nonzero(found)


def _best(table: pa.Table, k: int) -> pa.Table:
    """Rows within the first k of their question by score, then point id."""
    order = pc.sort_indices(
        table, sort_keys=[("_question", "ascending"), ("score", "descending"), (table.schema.names[2], "ascending")]
    )
    ordered = table.take(order)
    question = ordered.column("_question").to_numpy()
    first = np.r_[True, question[1:] != question[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(question)), 0))
    return ordered.filter(pa.array(np.arange(len(question)) - start < k)).combine_chunks()


def _score_block(points: pa.Table, vectors: np.ndarray, questions: np.ndarray, positions: np.ndarray, least: np.ndarray, k: int) -> Iterator[pa.Table]:
    """Candidate hits of one block; questions are taken in slices so that the score matrix stays small."""
    step = max(1, BLOCK_SCORES // max(1, len(vectors)))
    for start in range(0, len(questions), step):
        mine = positions[start : start + step]
        scores = vectors @ questions[start : start + step].T
        point, question = _winners(scores, least[mine], k)
        rounded = np.round(scores[point, question], SCORE_DIGITS) + 0.0
        hits = points.take(pa.array(point))
        where = pa.array(mine[question], pa.int64())
        yield pa.table([where, pa.array(rounded), *hits.columns], names=["_question", "score", *hits.schema.names])


def _scan(placed, carried: Sequence[str], vector: str, dim: int, k: int):
    """Points come in parts of a few rows, whatever the batch; a question's k-th best score so far bars the rest of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_tenant, question_ids = placed.value
        least = np.full(len(question_ids), -np.inf)
        held, rows, limit = [], 0, HELD_ROWS
        for table in (batch.slice(start, POINT_ROWS) for batch in batches for start in range(0, batch.num_rows, POINT_ROWS)):
            tenants = table.column(TENANT).dictionary_encode()
            codes = np.asarray(tenants.indices)
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(tenants.dictionary) + 1))
            for code, tenant in enumerate(tenants.dictionary.to_pylist()):
                if tenant not in by_tenant:
                    continue
                positions, questions = by_tenant[tenant]
                mine = pa.Table.from_batches([table]).take(pa.array(order[edges[code] : edges[code + 1]]))
                vectors = unit_rows(mine.column(vector), dim)
                for hits in _score_block(mine.select(list(carried)), vectors, questions, positions, least, k):
                    held.append(hits)
                    rows += len(hits)
                    if rows > limit:
                        held = [_best(pa.concat_tables(held), k)]
                        rows = len(held[0])
                        limit = HELD_ROWS + 2 * rows
                        _raise_least(least, held[0], k)
        if held:
            best = _best(pa.concat_tables(held), k)
            ids = question_ids.take(best.column("_question"))
            out = best.drop_columns(["_question"]).add_column(0, "question_id", ids)
            yield from out.combine_chunks().to_batches(max_chunksize=HELD_ROWS)

    return run


def _scan_questions(placed, carried: Sequence[str], dim: int, k: int):
    """The other way round: few points are at hand, questions come as they lie, and each leaves with its best k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_tenant, points = placed.value
        for table in (batch.slice(start, POINT_ROWS) for batch in batches for start in range(0, batch.num_rows, POINT_ROWS)):
            tenants = table.column(TENANT).dictionary_encode()
            codes = np.asarray(tenants.indices)
            asked = unit_rows(table.column("vector"), dim)
            least = np.full(len(asked), -np.inf)
            for code, tenant in enumerate(tenants.dictionary.to_pylist()):
                if tenant not in by_tenant:
                    continue
                rows, vectors = by_tenant[tenant]
                positions = np.flatnonzero(codes == code)
                for hits in _score_block(points.take(pa.array(rows)), vectors, asked[positions], positions, least, k):
                    best = _best(hits, k)
                    ids = table.column("question_id").take(best.column("_question").combine_chunks())
                    yield from best.drop_columns(["_question"]).add_column(0, "question_id", ids).combine_chunks().to_batches()

    return run


def _raise_least(least: np.ndarray, best: pa.Table, k: int) -> None:
    """Note the k-th score of every question that has k hits; ``best`` is ordered by question, best first."""
    question = best.column("_question").to_numpy()
    found, first, count = np.unique(question, return_index=True, return_counts=True)
    full = count == k
    least[found[full]] = best.column("score").to_numpy()[first[full] + k - 1]


def _question_blocks(stored: DataFrame, dim: int, block_bytes: int) -> tuple[int, Iterator[pa.Table]]:
    """(number of blocks, the written questions in blocks of about block_bytes of vectors).

    Blocks are ranges of tenants, and each is a folder of its own: a block reads its questions only and concerns few tenants.
    """
    blocks = max(1, -(-stored.count() * 8 * dim // block_bytes))

    def parts() -> Iterator[pa.Table]:
        if blocks == 1:
            yield stored.toArrow()
            return
        spark = stored.sparkSession
        path = shared_path(spark, "questions")
        dealt = stored.repartitionByRange(blocks, TENANT, F.xxhash64("question_id")).withColumn(BLOCK, F.spark_partition_id())
        dealt.write.partitionBy(BLOCK).parquet(path)
        placed = spark.read.schema(dealt.schema).parquet(path)
        for block in range(blocks):
            yield placed.filter(F.col(BLOCK) == block).drop(BLOCK).toArrow()

    return blocks, (part for part in parts() if part.num_rows)


def _place(spark, table: pa.Table, dim: int, kept: Sequence[str] = ("question_id",)):
    """Bounded side as {tenant: (positions, unit rows)} plus the ids (one column, or a table of several), shipped once per executor."""
    vectors = unit_rows(table.column("vector"), dim)
    grouped: dict = {}
    for position, tenant in enumerate(table.column(TENANT).to_pylist()):
        grouped.setdefault(tenant, []).append(position)
    by_tenant = {t: (np.array(p), vectors[p]) for t, p in grouped.items()}
    ids = table.select(list(kept)).combine_chunks()
    return spark.sparkContext.broadcast((by_tenant, ids.column(0).combine_chunks() if len(kept) == 1 else ids))


def top_k(
    questions: DataFrame,
    points: DataFrame,
    k: int = DEFAULT_K,
    tenant: Sequence[str] = (),
    point_id: str = "chunk_id",
    vector: str = "vector",
    payload: Sequence[str] = (),
    dim: int = DEFAULT_DIM,
    block_bytes: int = BLOCK_BYTES,
    asked_with: Sequence[str] = (),
) -> DataFrame:
    """questions(question_id, *tenant, vector) x points(point_id, *tenant, vector, *payload) -> best k points each.

    Output: question_id, score, point_id, payload columns and 1-based ``rank``. Questions come in blocks of bounded size;
    each block meets the points where they lie, and only ids and tenants of a task's best k leave it. Where questions would
    make several blocks and the points only one, the points are sent out and the questions read once. The payload is joined to
    the ranked rows on tenant and id, so an id may occur in several tenants; inside one it has to be unique. The columns
    ``asked_with`` of the questions come along, joined while the rows are still narrow.
    """
    tenant_key = F.to_json(F.struct(*[F.col(c).cast("string") for c in tenant])) if tenant else F.lit("")
    asked = settle(questions.select("question_id", tenant_key.alias(TENANT), "vector"))
    carried = [point_id, TENANT]
    stored = points.select(point_id, tenant_key.alias(TENANT), F.col(vector))
    schema = T.StructType(
        [asked.schema["question_id"], T.StructField("score", T.DoubleType()), *[stored.schema[c] for c in carried]]
    )
    spark = questions.sparkSession
    blocks, parts = _question_blocks(asked, dim, block_bytes)
    # one block scans the points where they lie; for several their vectors are made once, by tenant inside every file, so a
    # block passes over those of other tenants, and it leaves the driver and the executors when its hits are written
    stored = settle(stored.sortWithinPartitions(TENANT)) if blocks > 1 else stored
    found = spark.createDataFrame([], schema)
    if blocks > 1 and stored.count() * 8 * dim <= block_bytes:
        placed = _place(spark, stored.withColumnsRenamed({vector: "vector"}).toArrow(), dim, carried)
        found, parts = settle(asked.mapInArrow(_scan_questions(placed, carried, dim, k), schema)), ()
        placed.destroy()
    for block in parts:
        placed = _place(spark, block, dim)
        tenants = pc.min_max(block.column(TENANT)).as_py()
        near = stored.filter(F.col(TENANT).between(tenants["min"], tenants["max"])) if blocks > 1 else stored
        hits = near.mapInArrow(_scan(placed, carried, vector, dim, k), schema)
        if blocks > 1:
            hits = settle(hits)
            placed.destroy()
        found = found.unionAll(hits)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), point_id)
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if asked_with:
        best = best.join(questions.select("question_id", *asked_with), "question_id")
    if payload:
        best = best.join(points.select(point_id, tenant_key.alias(TENANT), *payload), [point_id, TENANT])
    return best.select("question_id", *asked_with, "score", point_id, *payload, "rank")


def search_chunks(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = CANDIDATES,
    tenant: Sequence[str] = (),
    dim: int = DEFAULT_DIM,
    provider=None,
    file_id=None,
    asked_with: Sequence[str] = (),
) -> DataFrame:
    """questions(question_id, question, *tenant) against chunk text: candidates with every chunk column and those of ``asked_with``.

    ``provider`` embeds both sides, with vectors of ``dim`` values. ``file_id`` narrows the search to one file's chunks;
    questions that each name a file of their own pass it as a tenant column instead.
    """
    searched = chunks if file_id is None else chunks.filter(F.col("file_id") == file_id)
    asked = embed(questions, "question", dim=dim, provider=provider)
    stored = embed(searched, "text", dim=dim, provider=provider)
    payload = [c for c in chunks.columns if c != "chunk_id" and c not in tenant]
    return top_k(asked, stored, k, tenant, payload=payload, dim=dim, asked_with=asked_with)
