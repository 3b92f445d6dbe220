"""Whole-question plans: retrieval to cited evidence, sheet discovery, routing and answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewise.functions.hashing import DEFAULT_DIM
from citewise.functions.labels import SOURCE_TYPE, query_source
from citewise.functions.questions import HYBRID, SEMANTIC, STRUCTURED, extract_answer, guarded_route, keyword_route
from citewise.functions.text import spaced
from citewise.operators.evidence import build_context, join_evidence, join_sources, merge_adjacent
from citewise.operators.intents import question_intents, structured_answers
from citewise.operators.lifecycle import session_flags
from citewise.operators.profile import sheet_summaries
from citewise.operators.rerank import KEPT, rerank_by_model, rerank_by_overlap
from citewise.operators.search import CANDIDATES, SHEETS_K, embed, search_chunks, top_k
from citewise.plans.materialize import settle

SESSION = ("user_id", "session_id")
ASKED = ("question", *SESSION)
PLAIN = "_plain"


@dataclass(frozen=True)
class Collections:
    """Stored tables the answer plan reads.

    chunks: chunk rows with filename and tenant columns; files: file_id, session_id, file_type, status;
    sheets: sheet_id, session_id, user_id, sheet_name, table_name, filename, sheet_order, row_count;
    catalog: column catalog; rows: typed sheet rows (sheet_id, _row_id, values).
    """

    chunks: DataFrame
    files: DataFrame
    sheets: DataFrame
    catalog: DataFrame
    rows: DataFrame


@dataclass(frozen=True)
class Providers:
    """Models the plans use; by default hashed vectors and the overlap of words.

    embedding: Column -> Column with vectors of ``dim`` values, for questions, chunks and sheet descriptions alike;
    scorer: (question, passage) -> Column, with the floor and margin below the best that its scores have to meet.
    """

    embedding: Callable | None = None
    dim: int = DEFAULT_DIM
    scorer: Callable | None = None
    min_score: float | None = None
    score_margin: float | None = None


def semantic_evidence(
    questions: DataFrame,
    chunks: DataFrame,
    tenant: Sequence[str] = (),
    candidates: int = CANDIDATES,
    kept: int = KEPT,
    providers: Providers = Providers(),
    file_id=None,
) -> DataFrame:
    """(question_id, context, sources): search, rerank, merge neighbours, cite; ``file_id`` narrows it to one file."""
    if not providers.scorer:
        chunks = chunks.withColumn(PLAIN, spaced(F.col("text")))
    asked = search_chunks(questions, chunks, candidates, tenant, providers.dim, providers.embedding, file_id, ["question"])
    if providers.scorer:
        limits = {"min_score": providers.min_score, "score_margin": providers.score_margin}
        best = rerank_by_model(asked, providers.scorer, kept, **limits)
    else:
        best = rerank_by_overlap(asked, kept, plain=PLAIN)
    return build_context(merge_adjacent(best))


def discover_sheets(
    questions: DataFrame,
    catalog: DataFrame,
    sheets: DataFrame,
    k: int = SHEETS_K,
    tenant: Sequence[str] = (),
    providers: Providers = Providers(),
) -> DataFrame:
    """(question_id, score, sheet_id, rank): the sheets whose description is nearest to each question."""
    described = sheet_summaries(catalog, sheets).join(sheets.select("sheet_id", *tenant), "sheet_id")
    shape = {"dim": providers.dim, "provider": providers.embedding}
    return top_k(embed(questions, "question", **shape), embed(described, **shape), k, tenant, point_id="sheet_id", dim=providers.dim)


def route_questions(questions: DataFrame, files: DataFrame, sheets: DataFrame, classifier=None) -> DataFrame:
    """Add has_documents, has_structured_data and question_type."""
    flagged = questions.join(session_flags(files, sheets), "session_id", "left")
    for flag in ("has_documents", "has_structured_data"):
        flagged = flagged.withColumn(flag, F.coalesce(flag, F.lit(False)))
    flags = (F.col("has_documents"), F.col("has_structured_data"))
    label = classifier(F.col("question"), *flags) if classifier else keyword_route(F.col("question"), *flags)
    return flagged.withColumn("question_type", guarded_route(label, *flags))


def asked_once(questions: DataFrame) -> DataFrame:
    """(question_id, question, user_id, session_id): the distinct questions of every session, each with its smallest question_id."""
    return settle(questions.groupBy(*ASKED).agg(F.min("question_id").alias("question_id")).select("question_id", *ASKED))


def same_question(questions: DataFrame, told: DataFrame, how: str) -> DataFrame:
    """questions with the columns of told, by question and session (nulls are equal) and by ``_read`` where both have it."""
    keys = [c for c in (*ASKED, "_read") if c in questions.columns and c in told.columns]
    named = told.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return questions.join(named, reduce(Column.__and__, same), how).drop(*[f"_of_{c}" for c in keys])


def answer_questions(
    questions: DataFrame, data: Collections, classifier=None, generator=None, providers: Providers = Providers()
) -> DataFrame:
    """questions(question_id, question, user_id, session_id) -> answer, question_type, context, sources.

    The routed questions are written once, since both evidence paths start from them. What a session asks again in the same
    words is searched and reranked once, under the smallest question_id; its passages join the questions last, so they
    are not moved once for every question.
    """
    routed = settle(route_questions(questions, data.files, data.sheets, classifier))
    reads_text = F.col("question_type").isin(SEMANTIC, HYBRID)
    reads_tables = routed.filter(F.col("question_type").isin(STRUCTURED, HYBRID))
    texts = asked_once(routed.filter(reads_text))
    evidence = semantic_evidence(texts, data.chunks, SESSION, providers=providers).withColumnRenamed("question_id", "_first")
    passages = texts.withColumnRenamed("question_id", "_first").join(evidence, "_first").drop("_first").withColumn("_read", F.lit(True))

    mixed = routed.filter(F.col("question_type") == HYBRID)
    once = asked_once(mixed)
    nearest = discover_sheets(once, data.catalog, data.sheets, tenant=SESSION, providers=providers).select("question_id", "sheet_id")
    told = once.join(nearest, "question_id").drop("question_id")
    found = same_question(mixed.select("question_id", *ASKED), told, "inner").select("question_id", "sheet_id")
    intents = question_intents(reads_tables, data.sheets, data.catalog, found)
    results = structured_answers(intents, data.catalog, data.rows).filter(F.col("problem").isNull())
    cited = F.array(query_source(F.col("sql"), F.col("row_count"))).cast(f"array<{SOURCE_TYPE}>")
    tables = results.select("question_id", F.col("context").alias("_result"), cited.alias("_cited"))

    joined = same_question(routed.join(tables, "question_id", "left").withColumn("_read", reads_text), passages, "left").drop("_read")
    context = join_evidence(F.col("context"), F.col("_result"))
    sources = join_sources(F.col("sources"), F.col("_cited"))
    gathered = joined.withColumn("context", context).withColumn("sources", sources).drop("_result", "_cited")
    stated = extract_answer(F.col("context"))
    if generator is None:
        return gathered.withColumn("answer", stated)
    # a reply that could not be made gives way to what the evidence states
    replied = gathered.withColumn("answer", generator(F.col("question"), F.col("context"), F.col("question_type")))
    return replied.withColumn("answer", F.coalesce("answer", stated))
