"""Exact duplicates, source divergence and collocations against brute force and their SQL, on odd and hot rows."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pytest

from citewise.llm import collocations as phrases
from citewise.llm import divergence
from citewise.llm.collocations import collocations
from citewise.llm.divergence import skyband, smoothed, source_divergence
from citewise.llm.exact_duplicates import build_index, exact_duplicates
from citewise.llm.queries import COLLOCATION_SQL, DIVERGENCE_SQL, EXACT_SQL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéfG") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " 7 ", " "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", "", None]), rng.choice(["a", "a", "a", "b", "ü", "", None]), len(text)))
    rows += [(i + n, t, lang, s, k) for i, (_, t, lang, s, k) in enumerate(rows[:20])]
    rows += [(500, " same   text", "en", "a", 0), (400, " same text", "en", "b", 0), (401, "same text", "en", "b", 0), (400, "\nsame\r\ntext", "fr", "c", 0)]
    rows += [(600 + i, "hot text, again and again and again", "en", "a", 0) for i in range(90)]
    rows += [(None, "hot text, again and again and again", "en", "a", 0), (None, "only here", "xx", "z", 0), (None, "only here", "xx", "z", 0)]
    rows += [(700, None, "en", "a", None), (701, "", None, None, 0), (702, " ", "yy", "q", 0), (703, "12 34 !!", "yy", "r", 0), (704, "go " * 9000, "en", "b", 0), (705, "x" * 70_000, "en", "b", 0)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", key string, `lang.n` string").repartition(5).withColumnRenamed("n_chars", "n")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def db(rows):
    import pandas as pd

    base = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    base.register("frame", frame)
    base.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM frame")
    return base


def table(df):
    return Counter(tuple(r) for r in df.collect())


def exact_by_hand(rows):
    import hashlib

    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out[(i, first, len(ids), stays, hashlib.sha256(text.encode()).hexdigest())] += 1
            stays = False
    return out


@pytest.mark.parametrize("settings", [{}, {"capacity": 8}, {"bits": 3, "capacity": 2}, {"bits": 1}])
def test_exact_duplicates(docs, rows, settings):
    """Also with keys of one and three bits, where nearly all texts chain."""
    assert table(exact_duplicates(docs, **settings)) == exact_by_hand(rows)


def test_exact_duplicates_sql_and_empty(docs, rows, db, empty):
    assert Counter(db.execute(EXACT_SQL).fetchall()) == exact_by_hand(rows)
    assert exact_duplicates(empty).count() == 0
    assert exact_duplicates(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_index_splits_and_doubles(docs, rows):
    index = build_index(docs, capacity=6)
    held = {(r["bucket"], r["key"]): r["n"] for r in index.buckets.collect()}
    slots = {r["slot"]: (r["bucket"], r["depth"]) for r in index.directory.collect()}
    assert sum(held.values()) == len(rows)
    assert sorted(slots) == list(range(1 << index.depth)) and index.depth > 3
    assert max(Counter(b for b, _ in held).values()) <= 6
    assert len({d for _, d in slots.values()}) > 1  # buckets of different depths share one directory
    for bucket, key in held:
        assert slots[(key & (2**64 - 1)) >> (64 - index.depth)][0] == bucket


def divergence_by_hand(rows, least=3, first=200):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        found = terms.findall((text or "").translate(lower))
        seen[lang or ""].update(set(found))
        counts[(lang or "", source or "")].update(found)
    out = Counter()
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for one, s in counts if one == lang]
        total = Counter()
        for s in sources:
            total.update({t: counts[(lang, s)][t] for t in kept})
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        p = {s: {t: share(counts[(lang, s)][t], sum(counts[(lang, s)][x] for x in kept)) for t in kept} for s in sources}
        q = {t: share(total[t], sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            best = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[(lang, s)][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(best)[:first])):
                out.update((lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1))
    return out


def test_source_divergence(docs, rows, db, empty):
    want = divergence_by_hand(rows)
    assert {p for _, _, p, *_ in want} == {"pair", "term"} and ("yy", "q", "pair", "r", 0, 1) in want
    assert table(source_divergence(docs)) == want == Counter(db.execute(DIVERGENCE_SQL).fetchall())
    assert source_divergence(empty).count() == 0


def test_source_divergence_in_many_parts(docs, rows, monkeypatch):
    """Few terms a task, so that skybands are merged in rounds, few ranks, and texts cut into segments."""
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", 2)
    monkeypatch.setattr(divergence, "FAN", 2)
    assert table(source_divergence(docs, least_docs=2, first=3)) == divergence_by_hand(rows, 2, 3)


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "AT_ONCE", 64)
    raw = np.frombuffer(b"ab, cd ef. " * 50 + b"x" * 300 + b" y", np.uint8)
    starts, ends = np.array([0, 0, 100, 550]), np.array([0, 100, 550, len(raw)])
    parts = list(divergence.segments(raw, starts, ends, divergence.OUTSIDE, 64))
    assert b"".join(p.tobytes() for p, _, _ in parts) == raw.tobytes() and len(parts) > 8
    terms, group, code, n, docs = divergence._counted(raw, starts, ends, np.array([0, 0, 1, 0]))
    found = {(g, terms[c].as_py()): (k, d) for g, c, k, d in zip(group.tolist(), code.tolist(), n.tolist(), docs.tolist())}
    want = defaultdict(lambda: [0, 0])
    for g, a, b in zip((0, 0, 1, 0), starts, ends):
        for w, k in Counter(re.findall("[a-z]+", raw.tobytes()[a:b].decode())).items():
            want[(g, w)] = [want[(g, w)][0] + k, want[(g, w)][1] + 1]
    assert found == {k: tuple(v) for k, v in want.items()}


@pytest.mark.parametrize("k", [1, 3, 200])
def test_skyband(k):
    rng = np.random.default_rng(k)
    up, down, place = rng.integers(1, 12, 2500), rng.integers(1, 15, 2500), rng.permutation(2500)
    above = (up[None, :] >= up[:, None]) & (down[None, :] <= down[:, None]) & (place[None, :] < place[:, None])
    assert skyband(up, down, place, k).tolist() == np.flatnonzero(above.sum(axis=1) < k).tolist()


def test_long_division():
    counts, totals = np.array([0, 5, 10**15, 9 * 10**15 - 1]), np.array([1, 7, 10**15 + 3, 9 * 10**15])
    assert smoothed(counts, totals).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals)]


def collocations_by_hand(rows, least=10, first=2000):
    lower = {c: c + 32 for c in range(65, 91)}
    count = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for size in (1, 2, 3):
                count["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = Counter()
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        ranked = []
        for p, a in candidates.items():
            if any(len(o) > len(p) and p in (o[:2], o[1:]) and 100 * c >= 50 * a for o, c in candidates.items()):
                continue
            cuts = [(floor(Fraction(10**6 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        out.update((lang, rank, *row[3:]) for rank, row in enumerate(sorted(ranked)[:first], 1))
    return out


def test_collocations(docs, rows, db, empty):
    want = collocations_by_hand(rows)
    assert len(want) > 20
    assert table(collocations(docs)) == want == Counter(db.execute(COLLOCATION_SQL).fetchall())
    assert collocations(empty).count() == 0


def test_collocations_in_short_stretches(docs, rows, monkeypatch):
    """Texts cut into segments, chunks cut after seven words, and other limits."""
    monkeypatch.setattr(phrases, "AT_ONCE", 500)
    assert table(collocations(docs, least=4, first=30)) == collocations_by_hand(rows, 4, 30)
    monkeypatch.setattr(phrases, "STRETCH", 7)
    raw = np.frombuffer(b"go " * 100 + b". one two three. a b c d e f g h i j", np.uint8)
    data, edges, own, text = phrases._chunks(raw, np.array([0, 200]))
    chunks = [data[a:b].tobytes().decode() for a, b in zip(edges, edges[1:])]
    assert own.max() <= 7 and own.sum() == 113 and sorted(set(text)) == [0, 1]
    counted = Counter(tuple(c.split(" ")[i : i + 3]) for c, n in zip(chunks, own) for i in range(n) if i + 3 <= len(c.split(" ")))
    assert counted[("go",) * 3] == 65 + 31 and counted[("one", "two", "three")] == 1 and sum(counted.values()) == 96 + 1 + 8


def test_small_sieve_counts_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "SIEVE_BITS", 64)
    assert table(collocations(docs, least=5)) == collocations_by_hand(rows, 5)


def test_rare_pairs_are_not_grouped_as_strings(spark, monkeypatch):
    """Words that are all frequent, in pairs that mostly are not: only hashes of the rare pairs are counted."""
    grouped, plain = [], phrases.phrase_counts

    def whole(chunks, *given):
        counts = plain(chunks, given[0], 1, *given[2:]) if len(given) > 2 else plain(chunks, *given)
        grouped.append(counts)
        return counts.filter("n >= 10") if len(given) > 2 else counts

    monkeypatch.setattr(phrases, "phrase_counts", whole)
    texts = [f"w{i} w{j}. once w{i} w{i} more" for i in range(50) for j in range(50)]
    rows = [(i, text, ("en", "de", None)[i % 3], "a", 0) for i, text in enumerate(texts)]
    assert table(collocations(spark.createDataFrame(rows, SCHEMA))) == collocations_by_hand(rows)
    assert sum(counts.filter("n < 10 AND phrase LIKE '% %'").count() for counts in grouped) < 20


def test_many_buckets(docs, rows, monkeypatch):
    """Packed keys and phrases of few bytes a row, and more buckets than phrases in most of them."""
    monkeypatch.setattr(phrases, "KEYS_AT_ONCE", 40)
    assert phrases.buckets_for(20_000) == 1024
    assert table(collocations(docs, least=4, first=30)) == collocations_by_hand(rows, 4, 30)
    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 64, 10_000, np.uint64, endpoint=False))
    place = phrases.bucket_of(np.concatenate([[np.uint64(0)], keys, [np.uint64((1 << 64) - 1)]]), 1024)
    assert place[0] == 0 and place[-1] == 1023 and (np.diff(place) >= 0).all()


def test_phrases_under_one_hash(docs, rows, monkeypatch):
    """Whatever shares a hash is counted apart in the end."""

    class Coarse(phrases.Words):
        def keys(self, size):
            at, keys = super().keys(size)
            return at, keys % np.uint64(5)

    monkeypatch.setattr(phrases, "Words", Coarse)
    assert table(collocations(docs, least=5)) == collocations_by_hand(rows, 5)


def test_dictionary_owns_every_word_once(docs, rows):
    chunks = phrases.dictionary(docs).collect()
    words = sum(len([w for w in re.split(r"[\x09-\x0D\x20.,;:!?]+", t or "") if w]) for _, t, *_ in rows)
    assert sum(c["own"] * c["n"] for c in chunks) == words
    assert max(c["n"] for c in chunks) >= 91 and all(len(c["chunk"].split(" ")) - c["own"] in (0, 1, 2) for c in chunks)
