"""Similarity search, reranking, passage merging, citations, evidence text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions import labels as lb
from citewise.functions import text as tx
from citewise.functions.hashing import hashed_vector, sparse_dot
from citewise.operators import evidence, rerank, search, vector_lists
from citewise.plans.answers import semantic_evidence
from citewise.plans.materialize import settle
from suite.common import (
    Registry,
    benchmark_questions,
    load,
    long,
    overlap_sql,
    spread,
    top_k_sql,
    vectors_sql,
    whole_documents,
)
from suite.documents import chunks_sql, corpus_chunks

query = Registry()
Q, SQL = query.queries, query.sql

DOCUMENT_SEARCH_SQL = f"""
WITH {vectors_sql('dv', 'documents', 'doc_id', 'text')},
{vectors_sql('bv', 'benchmark', 'item_id', 'text')},
{top_k_sql('benchmark', 'item_id', 'documents', 'doc_id', 'bv', 'dv', 15)}"""


@query(
    "j1_semantic_topk",
    DOCUMENT_SEARCH_SQL
    + """ SELECT r.question_id, r.point_id AS doc_id, r.score, r.rank::BIGINT AS rank, d.source || '.txt (line 1)' AS citation
FROM ranked r JOIN documents d ON d.doc_id = r.point_id""",
)
def j1(spark: SparkSession, folder: str) -> DataFrame:
    """Best 15 documents of the whole corpus for every benchmark text, with citation labels."""
    found = search.search_chunks(benchmark_questions(spark, folder), whole_documents(spark, folder), k=15)
    nothing = F.lit(None)
    label = lb.location_label(nothing.cast("int"), nothing.cast("int"), nothing.cast("int"), F.col("line_start"), nothing.cast("string"))
    return found.select(
        "question_id", "doc_id", "score", long("rank").alias("rank"), F.concat("filename", label).alias("citation")
    )


@query("j1_listed_topk", DOCUMENT_SEARCH_SQL + " SELECT question_id, point_id AS doc_id, score, rank::BIGINT AS rank FROM ranked")
def j1_listed(spark, folder):
    """The same search over stored lists, in several blocks of questions; what cannot be among the best is not scored."""
    documents = spread(load(spark, folder, "documents").select("doc_id", "text"))
    index = vector_lists.store_lists(search.embed(documents), point_id="doc_id")
    questions = search.embed(benchmark_questions(spark, folder), "question")
    found, _ = vector_lists.top_k_in_lists(questions, index, 15, block_bytes=300_000)
    return found.select("question_id", "doc_id", "score", long("rank").alias("rank"))


@query(
    "j1_dense_topk",
    """
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
scored AS (
  SELECT a.vec_id AS question_id, b.vec_id AS vec_id, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) + 0.0 AS score
  FROM n a JOIN n b ON a.label = b.label
)
SELECT question_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 4""",
)
def j1_dense(spark, folder):
    """Every stored vector as a question inside its own label."""
    stored = load(spark, folder, "embeddings")
    asked = stored.select(F.col("vec_id").alias("question_id"), "label", F.col("embedding").alias("vector"))
    points = stored.select("vec_id", "label", F.col("embedding").alias("vector"))
    found = search.top_k(asked, points, 4, ["label"], point_id="vec_id", dim=64)
    return found.select("question_id", "vec_id", "score", long("rank").alias("rank"))


@query(
    "f3_cosine",
    f"""WITH {vectors_sql('v', 'documents', 'doc_id', 'text')}
SELECT l.doc_id, round(coalesce(sum(a.weight * b.weight), 0), 6) + 0.0 AS score
FROM documents l LEFT JOIN v a ON a.doc_id = l.doc_id LEFT JOIN v b ON b.doc_id = l.doc_id + 1 AND b.bucket = a.bucket
GROUP BY 1""",
)
def f3(spark, folder):
    """Cosine of every document with the one after it, through the sparse form."""
    vectors = settle(spread(load(spark, folder, "documents").select("doc_id", "text")).select("doc_id", hashed_vector(F.col("text")).alias("vector")))
    following = vectors.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("other"))
    pairs = vectors.join(following, "doc_id", "left").select("doc_id", sparse_dot(F.col("vector"), F.col("other")).alias("cosine"))
    return pairs.groupBy("doc_id").agg((F.round(F.coalesce(F.sum("cosine"), F.lit(0.0)), 6) + 0.0).alias("score"))


RERANKED_SQL = (
    DOCUMENT_SEARCH_SQL
    + f""",
overlapped AS (
  SELECT r.question_id, r.point_id AS doc_id, r.score, r.rank, d.text, d.source,
         {overlap_sql('q.text', 'd.text')} AS overlap
  FROM ranked r JOIN documents d ON d.doc_id = r.point_id JOIN benchmark q ON q.item_id = r.question_id
),
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, rank) AS final_rank FROM overlapped WHERE overlap > 0
  ) WHERE final_rank <= 5
)"""
)


def _kept(spark, folder):
    questions = benchmark_questions(spark, folder)
    found = search.search_chunks(questions, whole_documents(spark, folder), k=15)
    return found.join(questions, "question_id")


@query("f5_rerank", RERANKED_SQL + " SELECT question_id, doc_id, overlap::BIGINT AS overlap, final_rank::BIGINT AS final_rank FROM kept")
def f5(spark, folder):
    kept = rerank.rerank_by_overlap(_kept(spark, folder))
    return kept.select("question_id", "doc_id", "overlap", long("final_rank").alias("final_rank"))


@query(
    "u2_dropped_candidates",
    RERANKED_SQL + " SELECT question_id, point_id AS doc_id FROM ranked EXCEPT SELECT question_id, doc_id FROM kept",
)
def u2(spark, folder):
    found = _kept(spark, folder)
    return rerank.dropped_candidates(found, rerank.rerank_by_overlap(found), "doc_id").select("question_id", "doc_id")


@query(
    "a10_evidence",
    RERANKED_SQL
    + """ SELECT question_id, md5(string_agg('[Source: ' || source || '.txt (line 1)]' || chr(10) || text, chr(10) || chr(10) ORDER BY final_rank)) AS context_md5,
string_agg(source || '.txt ' || CASE WHEN round(score, 3) < 0 THEN 'below' ELSE 'above' END, ';' ORDER BY final_rank) AS cited
FROM kept GROUP BY 1""",
)
def a10(spark, folder):
    """Evidence text and citations of the reranked documents."""
    context = evidence.build_context(evidence.merge_adjacent(rerank.rerank_by_overlap(_kept(spark, folder))))
    cited = F.array_join(
        F.transform(
            "sources",
            lambda s: F.concat(s["filename"], F.lit(" "), F.when(F.round(s["score"], 3) < 0, "below").otherwise("above")),
        ),
        ";",
    )
    return context.select("question_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), cited.alias("cited"))


@query(
    "p12_display_sources",
    RERANKED_SQL + " SELECT DISTINCT question_id, 'Source: ' || source || '.txt' AS shown FROM kept",
)
def p12(spark, folder):
    context = evidence.build_context(evidence.merge_adjacent(rerank.rerank_by_overlap(_kept(spark, folder))))
    shown = context.select("question_id", F.explode("sources").alias("s"))
    return shown.select("question_id", lb.display_source(F.col("s")).alias("shown")).distinct()


CHUNK_SEARCH_SQL = f"""
WITH RECURSIVE {chunks_sql()},
passages AS (SELECT substr(sha256(doc_id || '|' || chunk_index), 1, 32) AS chunk_id, doc_id, chunk_index, chunk AS text FROM chunks),
{vectors_sql('pv', 'passages', 'chunk_id', 'text')},
{vectors_sql('bv', 'benchmark', 'item_id', 'text')},
{top_k_sql('benchmark', 'item_id', 'passages', 'chunk_id', 'bv', 'pv', 15)},
overlapped AS (
  SELECT r.question_id, r.rank, r.score, p.doc_id, p.chunk_index, {overlap_sql('b.text', 'p.text')} AS overlap
  FROM ranked r JOIN passages p ON p.chunk_id = r.point_id JOIN benchmark b ON b.item_id = r.question_id
)"""


@query(
    "c6_kept_chunks",
    CHUNK_SEARCH_SQL
    + """ SELECT question_id, doc_id, chunk_index, overlap::BIGINT AS overlap, final_rank::BIGINT AS final_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, rank) AS final_rank FROM overlapped WHERE overlap > 0) WHERE final_rank <= 5""",
)
def c6_kept(spark, folder):
    """The chunks of the whole corpus that search and reranking keep for every benchmark text."""
    questions = benchmark_questions(spark, folder)
    found = search.search_chunks(questions, corpus_chunks(spark, folder), k=15).join(questions, "question_id")
    kept = rerank.rerank_by_overlap(found)
    return kept.select("question_id", "doc_id", long("chunk_index").alias("chunk_index"), "overlap", long("final_rank").alias("final_rank"))


@query("c6_semantic_search")
def c6(spark, folder):
    """Chunks of the whole corpus searched, reranked, merged and cited for every benchmark text."""
    context = semantic_evidence(benchmark_questions(spark, folder), corpus_chunks(spark, folder))
    return context.select(
        "question_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), long(F.size("sources")).alias("cited")
    )


@query(
    "w11_rank_filter",
    """
WITH s AS (SELECT label AS question_id, vec_id AS idx, round(list_max(embedding)::DOUBLE, 6) AS score FROM embeddings),
f AS (SELECT *, max(score) OVER (PARTITION BY question_id) AS best FROM s WHERE score >= 0.05)
SELECT question_id, idx, score, r::BIGINT AS final_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, idx) AS r FROM f WHERE score >= best - 0.1
) WHERE r <= 5""",
)
def w11(spark, folder):
    """Absolute floor, then the margin below the best survivor, then the best five per label."""
    scored = load(spark, folder, "embeddings").select(
        F.col("label").alias("question_id"), F.col("vec_id").alias("idx"), F.round(F.array_max("embedding").cast("double"), 6).alias("score")
    )
    kept = rerank.rank_and_filter(scored, 5, min_score=0.05, score_margin=0.1)
    return kept.select("question_id", "idx", "score", long("final_rank").alias("final_rank"))


@query(
    "t1_topk_per_question",
    """SELECT question_id, idx, r::BIGINT AS final_rank FROM (
  SELECT user_id AS question_id, event_id AS idx, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events
) WHERE r <= 5""",
)
def t1(spark, folder):
    scored = load(spark, folder, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("idx"), F.col("value").alias("score"))
    return rerank.rank_and_filter(scored, 5).select("question_id", "idx", long("final_rank").alias("final_rank"))


# Conversations as questions, their turns as candidates; the reply that orders them depends on the conversation.
VERDICTS_SQL = """
verdicts AS (
  SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE [2, 0, 99] END AS verdict
  FROM (SELECT DISTINCT conv_id FROM conversations)
)"""


def _verdicts(spark, folder):
    turns = load(spark, folder, "conversations")
    candidates = turns.select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("rank"), "text")
    reply = F.when(F.col("question_id") % 3 == 1, F.array().cast("array<int>")).when(F.col("question_id") % 3 == 2, F.array(F.lit(2), F.lit(0), F.lit(99)))
    return candidates, candidates.select("question_id").distinct().withColumn("verdict", reply)


@query(
    "j6_ordered_gather",
    f"""WITH {VERDICTS_SQL},
listed AS (
  SELECT v.conv_id, unnest(coalesce(v.verdict, range(0, n))) AS idx, unnest(range(1, len(coalesce(v.verdict, range(0, n))) + 1)) AS final_rank
  FROM verdicts v JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c USING (conv_id)
)
SELECT l.conv_id AS question_id, l.idx::BIGINT AS idx, l.final_rank::BIGINT AS final_rank, md5(c.text) AS text_md5
FROM listed l JOIN conversations c ON c.conv_id = l.conv_id AND c.turn = l.idx WHERE l.final_rank <= 5""",
)
def j6(spark, folder):
    candidates, verdicts = _verdicts(spark, folder)
    kept = rerank.gather_by_order(candidates, verdicts)
    return kept.select("question_id", long("idx").alias("idx"), long("final_rank").alias("final_rank"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


# Windows of 600 characters every 500, so neighbours share 100; runs of five windows go to two questions in turn, which breaks the chains.
WINDOWS_SQL = """
windows AS (
  SELECT doc_id, i, substr(text, i * 500 + 1, 600) AS text
  FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 500.0) AS BIGINT)))) AS i)
)"""


def _windows(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text", "source")
    count = F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / 500.0)).cast("int")
    parts = spread(docs).select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    return parts.select(
        (F.col("doc_id") * 2 + F.floor(F.col("i") / 5) % 2).alias("question_id"), "doc_id", F.col("i").alias("chunk_index"),
        F.substring("text", F.col("i") * 500 + 1, F.lit(600)).alias("text"), F.lit(None).cast("int").alias("page_end"),
        (F.col("i") / 100.0).alias("score"), (F.lit(1000) - F.col("i")).alias("final_rank"),
    )


def _merge_sql(acc: str, nxt: str, out: str, source: str) -> str:
    """One merge step over CTE ``source``: the longest end of ``acc`` found in the first 400 characters of ``nxt``."""
    return f"""
{out}_size AS (
  SELECT *, list_max([n for n in range(20, least(length({acc}), length(substr({nxt}, 1, 400))) + 1)
                      if contains(substr({nxt}, 1, 400), right({acc}, n))]) AS size FROM {source}
),
{out} AS (
  SELECT * EXCLUDE (size, {acc}), CASE WHEN {nxt} IS NULL THEN {acc}
         ELSE {acc} || substr({nxt}, instr(substr({nxt}, 1, 400), right({acc}, size)) + size) END AS {acc} FROM {out}_size
)"""


@query(
    "w10_merge_groups",
    f"""WITH {WINDOWS_SQL},
runs AS (
  SELECT doc_id, i // 5 AS run, max(i) AS high, max(CASE WHEN i % 5 = 0 THEN text END) AS acc,
         max(CASE WHEN i % 5 = 1 THEN text END) AS w1, max(CASE WHEN i % 5 = 2 THEN text END) AS w2,
         max(CASE WHEN i % 5 = 3 THEN text END) AS w3,
         max(CASE WHEN i % 5 = 4 THEN text END) AS w4
  FROM windows GROUP BY 1, 2
),
{_merge_sql("acc", "w1", "one", "runs")},
{_merge_sql("acc", "w2", "two", "one")},
{_merge_sql("acc", "w3", "three", "two")},
{_merge_sql("acc", "w4", "four", "three")}
SELECT doc_id, high::BIGINT AS chunk_index, md5(acc) AS text_md5, round(high / 100.0, 6) AS score, (1000 - high)::BIGINT AS best_rank
FROM four""",
)
def w10(spark, folder):
    """Overlapping windows of every document merged back into the passages they were cut from."""
    merged = evidence.merge_adjacent(_windows(spark, folder))
    return merged.select(
        "doc_id", long("chunk_index").alias("chunk_index"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.round("score", 6).alias("score"), long("final_rank").alias("best_rank"),
    )


@query(
    "j7_adjacent_chunks",
    f"""WITH {WINDOWS_SQL}
SELECT doc_id, i::BIGINT AS chunk_index, coalesce(lead(i) OVER (PARTITION BY doc_id, i // 5 % 2 ORDER BY i) = i + 1, FALSE) AS continues FROM windows""",
)
def j7(spark, folder):
    """Kept chunks of every question, each with whether the one behind it continues it."""
    found = evidence.with_adjacency(_windows(spark, folder), within=("question_id",))
    return found.select("doc_id", long("chunk_index").alias("chunk_index"), "continues")


# Citation fields laid over documents: pages, slides and sections present or absent by document.
FIELDS_SQL = """
fields AS (
  SELECT doc_id, source || '.pdf' AS filename,
         CASE WHEN doc_id % 2 = 0 THEN 1 + doc_id % 7 END AS page_start,
         CASE WHEN doc_id % 4 = 0 THEN 1 + doc_id % 5 END AS page_end,
         CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 9 END AS slide_number,
         CASE WHEN doc_id % 5 = 0 THEN 1 + length(text) - length(replace(text, chr(10), '')) END AS line_start,
         CASE WHEN doc_id % 7 = 0 THEN lang WHEN doc_id % 7 = 1 THEN '' END AS section,
         CASE WHEN doc_id % 11 = 0 THEN 'excel_sheet' ELSE 'document_chunk' END AS content_type
  FROM documents
)"""


def _fields(spark, folder):
    docs = load(spark, folder, "documents")
    n = F.col("doc_id")
    lines = 1 + F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return docs.select(
        "doc_id", F.concat("source", F.lit(".pdf")).alias("filename"), F.col("lang").alias("sheet_name"),
        F.when(n % 2 == 0, 1 + n % 7).cast("int").alias("page_start"), F.when(n % 4 == 0, 1 + n % 5).cast("int").alias("page_end"),
        F.when(n % 3 == 0, 1 + n % 9).cast("int").alias("slide_number"), F.when(n % 5 == 0, lines).cast("int").alias("line_start"),
        F.when(n % 7 == 0, F.col("lang")).when(n % 7 == 1, "").alias("section"),
        F.when(n % 11 == 0, "excel_sheet").otherwise("document_chunk").alias("content_type"),
    )


@query(
    "p8_citation_label",
    f"""WITH {FIELDS_SQL}, parts AS (
  SELECT doc_id, concat_ws(', ',
    CASE WHEN page_start IS NOT NULL THEN 'page ' || page_start || CASE WHEN page_end IS NOT NULL AND page_end <> page_start THEN '-' || page_end ELSE '' END END,
    'slide ' || slide_number, 'line ' || line_start, CASE WHEN section <> '' THEN 'section: ' || section END) AS p FROM fields)
SELECT doc_id, CASE WHEN p = '' THEN '' ELSE ' (' || p || ')' END AS label FROM parts""",
)
def p8(spark, folder):
    f = _fields(spark, folder)
    names = ("page_start", "page_end", "slide_number", "line_start", "section")
    return f.select("doc_id", lb.location_label(*[F.col(n) for n in names]).alias("label"))


@query(
    "p9_short_label",
    f"""WITH {FIELDS_SQL}
SELECT f.doc_id, CASE WHEN content_type = 'excel_sheet' THEN 'sheet ''' || d.lang || ''' (' || filename || ')'
  ELSE concat_ws(' ', filename, 'p.' || page_start, 'slide ' || slide_number, 'line ' || line_start, CASE WHEN section <> '' THEN 'sec=''' || section || '''' END) END AS label
FROM fields f JOIN documents d USING (doc_id)""",
)
def p9(spark, folder):
    f = _fields(spark, folder)
    names = ("content_type", "filename", "sheet_name", "page_start", "slide_number", "line_start", "section")
    return f.select("doc_id", lb.short_location(*[F.col(n) for n in names]).alias("label"))


@query(
    "p10_source_struct",
    f"""WITH {FIELDS_SQL}
SELECT doc_id, filename, page_start::BIGINT AS page_start, section,
  CASE WHEN filename <> '' THEN 'Source: ' || filename || CASE WHEN p = '' THEN '' ELSE ' (' || p || ')' END ELSE '' END AS shown,
  'Source: database query (' || (doc_id % 3) || ' row' || CASE WHEN doc_id % 3 = 1 THEN '' ELSE 's' END || ')' AS query_shown
FROM (SELECT *, concat_ws(', ', 'page ' || page_start, 'slide ' || slide_number, CASE WHEN section <> '' THEN 'section: ' || section END) AS p FROM fields)""",
)
def p10(spark, folder):
    f = _fields(spark, folder)
    absent = {"file_type": F.lit("pdf"), "chunk_id": F.col("doc_id"), "slide_title": F.lit(None), "line_end": F.lit(None), "score": F.lit(0.5)}
    source = lb.chunk_source(lambda name: absent.get(name, F.col(name) if name not in absent else absent[name]))
    asked = lb.query_source(F.lit("SELECT 1"), F.col("doc_id") % 3)
    cited = f.select("doc_id", source.alias("s"), asked.alias("q"))
    return cited.select(
        "doc_id", "s.filename", long("s.page_start").alias("page_start"), "s.section",
        lb.display_source(F.col("s")).alias("shown"), lb.display_source(F.col("q")).alias("query_shown"),
    )


@query(
    "u4_evidence_union",
    """SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 3 <> 0 THEN source END, CASE WHEN doc_id % 4 <> 0 THEN lang END) AS context,
(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END)::BIGINT AS sources FROM documents""",
)
def u4(spark, folder):
    docs = load(spark, folder, "documents")
    text = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    table = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    one = F.array(lb.query_source(F.lit("SELECT 1"), F.lit(1))).cast(f"array<{lb.SOURCE_TYPE}>")
    sources = evidence.join_sources(F.when(text.isNotNull(), one), F.when(table.isNotNull(), one))
    return docs.select("doc_id", evidence.join_evidence(text, table).alias("context"), long(F.size(sources)).alias("sources"))


@query(
    "f5_overlap_turns",
    f"""SELECT a.conv_id, a.turn, {overlap_sql('a.text', 'b.text')}::BIGINT AS overlap
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def f5_turns(spark, folder):
    """Shared words of each turn and the reply to it."""
    turns = load(spark, folder, "conversations")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(replies, ["conv_id", "turn"]).select(
        "conv_id", "turn", long(tx.lexical_overlap(F.col("text"), F.col("reply"))).alias("overlap")
    )
