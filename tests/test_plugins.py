"""Models that load once, fail now and then, or fail on single rows."""

import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from citewise.operators.rerank import rerank_by_model
from citewise.plugins import embedding_provider, relevance_scorer, results_of, text_generator

SCHEMA = "question_id int, rank int, question string, text string"


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def order(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["question_id"], r["final_rank"])):
        out.setdefault(r["question_id"], []).append(r["rank"])
    return out


def candidates(spark, questions=20, each=8):
    return spark.createDataFrame([(q, r, f"q{q}", "x" * ((r * 7 + q) % 19 + 1)) for q in range(questions) for r in range(1, each + 1)], SCHEMA).repartition(3)


def lengths(rows, questions=20, each=8, top=5):
    return {q: sorted(range(1, each + 1), key=lambda r: (-((r * 7 + q) % 19), r))[:top] for q in range(questions)}


def test_every_third_batch_fails_and_is_tried_again(spark, small_batches):
    def load():
        calls = []

        def score(pairs):
            calls.append(1)
            if len(calls) % 3 == 0:
                raise RuntimeError("busy")
            return [len(p) for _, p in pairs]

        return score

    assert order(rerank_by_model(candidates(spark), relevance_scorer(load=load))) == lengths(None)


def test_bad_rows_send_only_their_question_back(spark, small_batches):
    def score(pairs):
        if any(q == "q3" and len(p) > 15 or q == "q7" for q, p in pairs):
            raise RuntimeError("cannot score")
        return [len(p) for _, p in pairs]

    got = order(rerank_by_model(candidates(spark), relevance_scorer(score), min_score=100))
    assert got == {3: [1, 2, 3, 4, 5], 7: [1, 2, 3, 4, 5]}  # a floor that no score meets, and no filter where scoring failed
    assert order(rerank_by_model(candidates(spark), relevance_scorer(score))) == {**lengths(None), 3: [1, 2, 3, 4, 5], 7: [1, 2, 3, 4, 5]}


def test_a_scorer_that_always_fails_keeps_the_order(spark):
    def score(pairs):
        raise ValueError("down")

    assert order(rerank_by_model(candidates(spark, 4), relevance_scorer(score), top_n=3)) == {q: [1, 2, 3] for q in range(4)}
    short = relevance_scorer(lambda pairs: [1.0] * (len(pairs) - 1))
    assert order(rerank_by_model(candidates(spark, 2), short, top_n=2)) == {0: [1, 2], 1: [1, 2]}


def test_models_are_loaded_once_per_worker(spark, small_batches, tmp_path):
    folder = str(tmp_path)

    def load():
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda prompts: [p.upper() for p in prompts]

    generate = text_generator(load=load)
    for _ in range(2):
        rows = spark.range(200).repartition(4).select(generate(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("v")).collect()
        assert len(rows) == 200 and all(r["v"].startswith("A") for r in rows)
    workers = [name.split("-")[0] for name in os.listdir(folder)]
    assert workers and len(workers) == len(set(workers))


def test_failed_replies_are_null_and_failed_vectors_fail(spark):
    def reply(prompts):
        if "bad" in prompts:
            raise RuntimeError("no reply")
        return prompts

    df = spark.createDataFrame([("one",), ("bad",), (None,)], "p string")
    assert [r["v"] for r in df.select(text_generator(reply)("p").alias("v")).collect()] == ["one", None, ""]
    provider = embedding_provider(lambda texts: [[1.0]] * len(reply(texts)), dim=1)
    with pytest.raises(PythonException):
        df.select(provider(F.col("p")).alias("v")).collect()
    with pytest.raises(ValueError):
        relevance_scorer()


def test_results_in_halves():
    asked = []

    def call(rows):
        asked.append(len(rows))
        if 5 in rows:
            raise RuntimeError
        return [r * 2 for r in rows]

    assert results_of(call, list(range(8)), attempts=1) == [0, 2, 4, 6, 8, None, 12, 14]
    assert asked == [8, 4, 4, 2, 1, 1, 2]
    assert results_of(call, []) == []
