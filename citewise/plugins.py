"""Plug-in points: batch functions run as Arrow pandas UDFs next to the data.

A model may be given as a function or as a loader that makes one; a loader runs once in each Python worker. A batch that
raises is tried again, then halved until the rows that fail are alone, so one bad row costs no other its result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citewise.functions.hashing import checked_dense

ATTEMPTS = 2
_LOADED: dict[str, Callable] = {}


def _model(given: Callable | None, load: Callable | None) -> Callable[[], Callable]:
    """What gives the batch function inside a task."""
    if (given is None) == (load is None):
        raise ValueError("give either a batch function or a loader of one")
    key = uuid.uuid4().hex

    def get() -> Callable:
        if given is not None:
            return given
        from citewise import plugins  # the worker's own copy keeps the model for later tasks

        if key not in plugins._LOADED:
            plugins._LOADED[key] = load()
        return plugins._LOADED[key]

    return get


def results_of(call: Callable[[list], Sequence], rows: list, attempts: int = ATTEMPTS, fail: bool = False) -> list:
    """A result per row, null where the call fails for a row alone; with ``fail`` that error is raised instead.

    A call that gives another number of results than it got rows has failed.
    """
    if not rows:
        return []
    problem: Exception | None = None
    for _ in range(max(1, attempts)):
        try:
            found = list(call(rows))
            if len(found) != len(rows):
                raise ValueError(f"{len(found)} results for {len(rows)} rows")
            return found
        except Exception as error:  # noqa: BLE001 - whatever a model raises
            problem = error
    if len(rows) == 1:
        if fail:
            raise problem
        return [None]
    half = len(rows) // 2
    return results_of(call, rows[:half], attempts, fail) + results_of(call, rows[half:], attempts, fail)


def embedding_provider(embed_batch: Callable | None = None, dim: int = 0, load: Callable | None = None, attempts: int = ATTEMPTS):
    """``embed_batch(list[str]) -> list[vector]`` as a Column -> Column function with a length check.

    A text that cannot be embedded fails the job, as it could never be found.
    """
    model = _model(embed_batch, load)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(results_of(model(), texts.fillna("").tolist(), attempts, fail=True), dtype=object)

    return lambda text: checked_dense(run(text), dim)


def relevance_scorer(score_pairs: Callable | None = None, load: Callable | None = None, attempts: int = ATTEMPTS):
    """``score_pairs(list[(question, passage)]) -> list[float]`` as a scorer for ``rerank_by_model``.

    A pair that cannot be scored is null, and its question keeps the order of retrieval (see ``rerank_by_model``).
    """
    model = _model(score_pairs, load)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, passages in batches:
            scores = results_of(model(), list(zip(questions.fillna(""), passages.fillna(""))), attempts)
            yield pd.Series([None if s is None else float(s) for s in scores], dtype="float64")

    def scorer(question: Column, passage: Column) -> Column:
        return run(question, passage)

    return scorer


def text_generator(generate_batch: Callable | None = None, load: Callable | None = None, attempts: int = ATTEMPTS):
    """``generate_batch(list[prompt]) -> list[reply]`` as a Column -> Column function; a prompt that fails gives null."""
    model = _model(generate_batch, load)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(results_of(model(), prompts.fillna("").tolist(), attempts), dtype=object)

    return run
