"""The pipeline stage by stage, and the entry's registration."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_registered():
    names = set(entry.queries())
    assert {"pipeline"} | {f"op{n}" for n in range(1, 14)} <= {"pipeline"} | {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mixing", "pieces"]


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], FOLDER))
    assert all(df.columns == docs.columns for df in seen[:-1])
    counts = [df.count() for df in seen]
    assert counts[1] == counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    assert counts[5] == counts[4]


def test_odd_rows(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (4, "some words here", "en", "a", 15), (4, "some words here", "en", "a", 15), (None, "other words", None, "b", 11)]
    docs = spark.createDataFrame(odd, SCHEMA)
    told = corpus_pipeline.with_language(spark, docs, "")
    assert sorted((r["doc_id"] or 0) for r in told.collect()) == [0, 4, 4]
    one = corpus_pipeline.without_near_duplicates(spark, told, "")
    assert sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_stage_takes_near_duplicates_from_80_percent(spark):
    """Pairs above and below 0.8, and a chain that only holds with links between 0.80 and 0.85, against brute force."""
    rng = random.Random(11)

    def changed(words, places):
        own = list(words)
        for at in places:
            own[at] = f"x{rng.randrange(10**9)}"
        return own

    made = []
    for places in ((40, 75, 110), (30, 60, 90, 120), (50, 100)):  # similarity 0.81, 0.76 and 0.87
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        made += [base, changed(base, places)]
    made += [changed(made[1], (20, 60, 130))]  # 0.81 to the second text, less to the first
    texts = {i: " ".join(words) for i, words in enumerate(made)}
    sets = {i: {tuple(words[k : k + 5]) for k in range(len(words) - 4)} for i, words in enumerate(made)}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.80 <= alike(0, 1) < 0.85 and 0.80 <= alike(1, 6) < 0.85 and alike(0, 6) < 0.8 and alike(2, 3) < 0.8 < 0.85 <= alike(4, 5)
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[b] = min(label[a], label[b])
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], SCHEMA)
    left = sorted(r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect())
    assert left == sorted(i for i in label if label[i] == i) == [0, 2, 3, 4]


def test_texts_of_one_doc_id_are_documents(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    three, clean, other, last = text(), text(), text(), text()
    made = [(3, three), (7, three + " more"), (7, clean), (7, clean), (8, other), (8, last), (9, clean), (2, last), (None, three)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in made], SCHEMA).repartition(3)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(2, last), (3, three), (7, clean), (8, other), (None, three)], key=str)


def test_language_stage_keeps_letters_without_labels(spark):
    made = [(1, "some words", None), (2, "12 34", None), (3, "more words", None), (4, None, None)]
    docs = spark.createDataFrame([(i, t, lang, "a", 0) for i, t, lang in made], SCHEMA)
    told = corpus_pipeline.with_language(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in told) == [(1, "und"), (3, "und")]
