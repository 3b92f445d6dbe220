"""Written intermediates: their files follow the rows, not the number of shuffle partitions."""

import glob
import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citewise.llm import repeats
from citewise.llm.common import BATCH, map_batches
from citewise.llm.near_duplicates import near_duplicates
from citewise.llm.repeats import remove_repeats
from citewise.plans import materialize

FOLDER = "/root/testdata/sf0.001"
PARTITIONS = 40


@pytest.fixture
def written(spark, monkeypatch, tmp_path):
    """The folder of intermediates while every shuffle keeps all of its partitions."""
    monkeypatch.setattr(materialize, "shared_path", lambda _, name, made=[]: made.append(0) or f"{tmp_path}/{name}-{len(made)}")  # noqa: B006
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield tmp_path
    for k, v in before.items():
        spark.conf.set(k, v)


def _files(folder) -> list[int]:
    return [len(glob.glob(f"{table}/part-*")) for table in glob.glob(f"{folder}/*")]


def test_settle_bounds_files_and_keeps_rows(spark, written):
    made = spark.range(1000).groupBy((F.col("id") % 300).alias("k")).count()
    plain, few = materialize.settle(made), materialize.settle(made, 3)
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, few.collect()))
    assert sorted(_files(written)) == [3, PARTITIONS]
    assert materialize.parts_for(spark, None, 10) == 2 * spark.sparkContext.defaultParallelism
    assert materialize.parts_for(spark, 12_345, 10) == 1235


def test_settle_alone_leaves_one_table(spark, written):
    def made():
        first = materialize.settle(spark.range(10))
        inner = materialize.settle_alone(lambda: materialize.settle(first.filter("id > 2")).filter("id > 4"))
        return materialize.settle(inner.union(first)).filter("id < 7")

    out = materialize.settle_alone(made)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 6]
    assert len(_files(written)) == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("stage, most", [(corpus_pipeline.without_near_duplicates, 2), (corpus_pipeline.without_repeated_passages, 1)])
def test_stages_leave_few_tables(spark, written, stage, most):
    """A stage's result reads what it names itself; the tables it was found by are gone before it is written."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert 0 < stage(spark, docs, FOLDER).count() <= docs.count()
    assert len(_files(written)) <= most


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("operator, spread_tables", [(near_duplicates, 0), (remove_repeats, 1)])
def test_rounds_write_few_files(spark, written, operator, spread_tables):
    """The texts and ids of remove_repeats are written once before their size is known; no other table is spread."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = Counter(map(tuple, operator(docs).collect()))
    most = 2 * spark.sparkContext.defaultParallelism
    files = _files(written)
    assert len(files) > 5 and sum(n > most for n in files) <= spread_tables
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == Counter(map(tuple, operator(docs).collect()))


def test_contexts_of_repeats_take_a_bounded_share(spark, written, monkeypatch):
    """Where every passage is shared, no more than a few times the bytes of the texts lie written at a time."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=50_000)) for _ in range(40)]
    made = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:25_000] + "#" + t[25_001:]) for i, t in enumerate(texts)]
    held, settle = [], repeats.settle

    def measured(df, parts=None):
        out = settle(df, parts)
        held.append(sum(os.path.getsize(f) for f in glob.glob(f"{written}/*/part-*")))
        return out

    monkeypatch.setattr(repeats, "settle", measured)
    monkeypatch.setattr(repeats, "ROUND_LEAST", 1 << 20, raising=False)
    got = remove_repeats(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: 0 if i < 100 else 49_999 for i, _ in made}
    assert max(held) < 1.2 * sum(len(t) for _, t in made)


def test_python_gets_texts_in_bounded_batches(spark):
    before = spark.conf.getAll.get(BATCH)
    spark.conf.unset(BATCH)
    try:
        docs = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
        rows = lambda batch: pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
        sizes = [r["n"] for r in map_batches(docs, rows, "n bigint").collect()]
        assert sum(sizes) == 60 and max(sizes) <= 5
        spark.conf.set(BATCH, str(12 << 20))
        assert max(r["n"] for r in map_batches(docs, rows, "n bigint").collect()) > 5
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)
