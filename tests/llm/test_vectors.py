"""Vector searches against brute force."""

import math
import random

import numpy as np
import pytest

from citewise.llm import topk
from citewise.llm.neighbours import nearest
from citewise.llm.topk import top_inner_products

SCHEMA = "vec_id bigint, embedding array<float>, rank int"


def table(n=700, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    points = (middle[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    points[1::50] = points[0]
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0] * (dim + 1)]
    rows += [(1000 + 50 * i, v, 0) for i, v in enumerate(odd)]
    return rows + [rows[3], (5, rows[9][1], 0), (None, rows[0][1], 0)]


def clean(rows, zero):
    return [
        (i, np.array(v, np.float64)) for i, v, _ in rows
        if i is not None and v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))
    ]


def brute(points, every, k, score):
    out = []
    for q in sorted({i for i, _ in points if i % every == 0}):
        own = min((v.tolist() for i, v in points if i == q))
        ranked = sorted((score(np.array(own), v), i) for i, v in points if i != q)[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(ranked, 1)]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(4)


def test_top_inner_products(vectors):
    want = brute(clean(table(), True), 50, 5, lambda q, v: -int(np.floor(256 * q) @ np.floor(256 * v)))
    got = [tuple(r) for r in top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(q, r, i, -s) for q, r, i, s in want]


def test_top_inner_products_in_many_blocks(vectors, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 12 * 8 * 4)
    monkeypatch.setattr(topk, "CELLS", 64)
    want = brute(clean(table(), True), 50, 5, lambda q, v: -int(np.floor(256 * q) @ np.floor(256 * v)))
    got = [tuple(r) for r in top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(q, r, i, -s) for q, r, i, s in want]


def test_top_of_few_and_huge(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1e6, -3.0], 0), (2, [1e9, 1e9], 0), (3, [-1e9, 4.0], 0)]
    few = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in top_inner_products(few, few.filter("vec_id % 50 = 0"), 5).orderBy("rank").collect()]
    score = lambda v: sum(math.floor(256 * float(np.float32(a))) * math.floor(256 * float(np.float32(b))) for a, b in zip([1.0, 2.0], v))
    assert got == [(0, r, i, s) for r, (s, i) in enumerate(sorted(((score(v), i) for i, v, _ in rows[1:]), reverse=True), 1)]
    big = spark.createDataFrame([(0, [1e18, 1e18], 0), (1, [1e18, 1e18], 0)], SCHEMA)
    assert [r["score"] for r in top_inner_products(big, big, 5).orderBy("query_id").collect()] == [2**63 - 1] * 2


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_inner_products(none, none).count() == 0 and nearest(none, none).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0], 0)], SCHEMA)
    assert top_inner_products(one, one).count() == 0 and nearest(one, one).count() == 0


def test_nearest(vectors):
    points = clean(table(), False)
    want = brute(points, 100, 10, lambda q, v: float(np.sqrt(((q - v) ** 2).sum())))
    got = [tuple(r) for r in nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    assert [(q, r) for q, r, *_ in got] == [(q, r) for q, r, *_ in want]
    by = {}
    for i, v in points:
        by.setdefault(i, []).append(v)
    for q, _, i, s in got:
        own = np.array(min(v.tolist() for v in by[q]))
        assert any(s == pytest.approx(float(np.sqrt(((own - v) ** 2).sum())), abs=1e-12) for v in by[i])
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want})
    assert hits >= 0.9 * len({(q, i) for q, _, i, _ in want})


def test_nearest_reaches_all_of_few(spark):
    rng = random.Random(1)
    few = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(7)], SCHEMA)
    got = nearest(few, few.filter("vec_id = 0"), 10, lists=4, probes=1).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3, 4, 5, 6]
