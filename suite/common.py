"""Table loading and derived inputs shared by the queries, each with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table that is a single file over all cores; a table of several files stays as it is read."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def long(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    """documents as pages of the volume named by their source."""
    return spread(load(spark, folder, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text"))


LINES_SQL = """
lines AS (
  SELECT source AS doc_id, doc_id AS page_no, u.i - 1 AS line_no, parts[u.i] AS text
  FROM (SELECT source, doc_id,
               CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts
        FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents)) d,
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u
)"""

HEADING_SQL = (
    "(length(trim(text, E' \\t\\n\\r')) <= 80 AND NOT regexp_matches(trim(text, E' \\t\\n\\r'), '[.,;:]$') "
    "AND regexp_matches(trim(text, E' \\t\\n\\r'), '^[A-Z0-9][A-Za-z0-9 ,.&/''\\-]{2,79}$') "
    "AND ((regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]')) "
    "OR regexp_matches(trim(text, E' \\t\\n\\r'), '^[^A-Za-z]*([A-Z][a-z]*([^A-Za-z]+|$))+$')))"
)


def whole_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents as chunk rows of one chunk each, the source being the session."""
    docs = load(spark, folder, "documents").select("doc_id", "text", "source")
    return spread(docs).select(
        F.col("doc_id").alias("chunk_id"),
        "doc_id",
        F.lit(0).cast("bigint").alias("chunk_index"),
        "text",
        F.concat("source", F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("file_type"),
        F.lit(None).cast("int").alias("page_end"),
        F.lit(1).alias("line_start"),
        "source",
    )


def benchmark_questions(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def vectors_sql(name: str, relation: str, key: str, text: str, dim: int = 384) -> str:
    """CTEs ``{name}`` (key, bucket, weight) with the hashed vectors of a relation's text."""
    return f"""
{name}_tokens AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS token FROM {relation}
),
{name}_counts AS (
  SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % {dim} AS bucket,
         sum(CASE WHEN ('0x' || substr(md5(token), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS c
  FROM {name}_tokens GROUP BY 1, 2
),
{name} AS (
  SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS weight FROM {name}_counts
)"""


def top_k_sql(
    questions: str, question_id: str, points: str, point_id: str, qv: str, pv: str, k: int, same: str = "TRUE"
) -> str:
    """CTEs ``scored`` and ``ranked``: every pair scored, zero when nothing is shared, first k kept."""
    return f"""
shared AS (
  SELECT a.{question_id} AS question_id, b.{point_id} AS point_id, sum(a.weight * b.weight) AS s
  FROM {qv} a JOIN {pv} b ON a.bucket = b.bucket GROUP BY 1, 2
),
scored AS (
  SELECT q.{question_id} AS question_id, p.{point_id} AS point_id, round(coalesce(s.s, 0), 6) + 0.0 AS score
  FROM {questions} q JOIN {points} p ON {same}
  LEFT JOIN shared s ON s.question_id = q.{question_id} AND s.point_id = p.{point_id}
),
ranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM scored
  ) WHERE rank <= {k}
)"""


WORDS_SQL = "list_distinct([w for w in string_split(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), ' ') if w <> ''])"


def overlap_sql(a: str, b: str) -> str:
    return f"len(list_intersect({WORDS_SQL.format(a)}, {WORDS_SQL.format(b)}))"


class Registry:
    """Queries and their SQL counterparts of one module."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register
