"""Operators on documents against brute force, on texts with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citewise.llm import repeats
from citewise.llm.language import UNKNOWN, draw_sample, identify_language, suffix_automaton
from citewise.llm.licenses import scan_licenses
from citewise.llm.mixing import mix, mixing_plan
from citewise.llm.near_duplicates import near_duplicates
from citewise.llm.pieces import MODEL, decode, encode
from citewise.llm.repeats import maximal_repeats, remove_repeats, without_repeats
from citewise.llm.sharding import shard
from citewise.llm.tokens import attribute, section_tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            own = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        elif texts and kind < 0.6:
            piece = rng.choice(texts) or ""
            at = rng.randrange(max(1, len(piece)))
            texts.append(" ".join(rng.choice(words) for _ in range(20)) + piece[at : at + rng.randint(30, 200)] + rng.choice(["", " é ü", "\n"]))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))))
    texts += [None, "", " \t\n", "one", "One", "two words", "ONE two three four", "one two three four", "ab " * 400, "ab " * 900, "é" * 60, "é" * 70, words[0] * 3000]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", "ü", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + rows[:3] + [(None, texts[0], "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORD.findall(raw)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    want = Counter((i, len(sets[i]), find(i), find(i) == i) for i, *_ in rows if i is not None)
    want += Counter((None, len(shingles(t)), None, True) for i, t, *_ in rows if i is None)
    got = Counter(tuple(r) for r in near_duplicates(docs.withColumn("kept", F.lit("x")).withColumn("regs", F.lit(1))).collect())
    assert got == want
    assert len(set(find(i) for i in ids)) < len(ids) - 20
    assert near_duplicates(empty).count() == 0


def test_near_copies_form_one_component(spark):
    """A large group of different near copies, none of which is the original for all."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    made = []
    for i in range(300):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in made}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert got == label


def removed(rows):
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, raw in raws:
        if i is not None:
            for s in range(len(raw) - 49):
                key = raw[s : s + 50]
                least[key] = min(least.get(key, i), i)
    out = Counter()
    for i, raw in raws:
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if i is not None and least[raw[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out[(i, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest())] += 1
    return out


def test_remove_repeats(docs, rows, empty):
    want = removed(rows)
    assert sum(k[2] > 0 for k in want) > 30
    assert Counter(tuple(r) for r in remove_repeats(docs.withColumn("h", F.lit(1)).withColumn("label", F.lit("x"))).collect()) == want
    assert remove_repeats(empty).count() == 0


def test_remove_repeats_by_strings(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT", 2)
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == removed(rows)


@pytest.mark.parametrize("split", [2, 4096])
def test_remove_repeats_in_rounds(spark, docs, rows, monkeypatch, split):
    """Many rounds, units and buckets, with and without copies of whole texts and rows, give what one round gives."""
    for name, value in (("SPLIT", split), ("ROUND_LEAST", 1 << 14), ("ROUND", 0.4), ("UNIT", 300)):
        monkeypatch.setattr(repeats, name, value)
    made = []
    plain = repeats._contexts_of
    monkeypatch.setattr(repeats, "_contexts_of", lambda marked, turn: made.append(turn) or plain(marked, turn))
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == removed(rows)
    assert len(made) > 3
    apart = list({r[1]: r[:2] for r in rows if r[0] is not None and r[1]}.values())
    for some in (apart, apart + apart[:20]):
        assert Counter(tuple(r) for r in remove_repeats(spark.createDataFrame(some, "doc_id bigint, text string")).collect()) == removed(some)


def test_anchors_of_one_long_text():
    """Parts of a text beyond the packed positions find the same contexts as the whole."""
    import numpy as np

    raw = np.random.default_rng(1).integers(97, 123, 6_000_000).astype(np.uint8)
    whole = repeats.anchors(raw, np.zeros(1, np.int64), np.array([len(raw)]))
    parts = repeats._anchors_long(raw, np.zeros(1, np.int64), np.array([len(raw)]))
    assert set(whole[2].tolist()) == set(parts[2].tolist())


def test_maximal_repeats(spark):
    line = "the quick brown fox jumps over the lazy dog and runs away again"
    made = [(1, "aaa " + line + " bbb"), (2, "ccc " + line + " bbb"), (3, "zz " + line + "!"), (4, "nothing of the kind")]
    found = maximal_repeats(spark.createDataFrame(made, "doc_id bigint, text string")).distinct().collect()
    groups = defaultdict(set)
    for r in found:
        groups[r["repeat"]].add((r["doc_id"], dict(made)[r["doc_id"]][r["start"] : r["start"] + r["length"]]))
    assert all(len({text for _, text in group}) == 1 for group in groups.values())
    shared = {(next(iter(g))[1], frozenset(d for d, _ in g)) for g in groups.values()}
    assert any(docs == {1, 2, 3} for _, docs in shared) and any(docs == {1, 2} and text.endswith("bbb") for text, docs in shared)
    # left extensions differ among three documents, so no group of three starts inside the word before
    assert all(not text.startswith("c ") for text, docs in shared if len(docs) == 3)


def test_interval_tree():
    strings = [b"banana", b"band", b"bandit", b"bee", b"cat"]
    found = {(depth, frozenset(strings[m] for m in members)) for depth, members in repeats.interval_tree(strings, 1)}
    assert found == {(1, frozenset(strings[:4])), (3, frozenset(strings[:3])), (4, frozenset(strings[1:3]))}


def test_without_repeats(docs, rows):
    by = defaultdict(set)
    for (i, _, _, _, sha), _n in removed(rows).items():
        by[i].add(sha)
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    for r in out.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).collect():
        if r["text"].isascii():
            assert hashlib.sha256(r["text"].encode()).hexdigest() in by[r["doc_id"]] or "é" in dict((i, t or "") for i, t, *_ in rows)[r["doc_id"]]


def test_mixing(docs, rows, empty):
    plan = mixing_plan(docs.withColumn("target", F.lit("x")).withColumn("_rank", F.lit(1)))
    got = plan.collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall((t or "").encode()))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and 3 * size[s] < weight[s] * level}
        if not more:
            break
        full |= more
    for r in got:
        target = 3 * size[r["source"]] if r["source"] in full else weight[r["source"]] * level
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target)
        assert int(target / size[r["source"]]) <= r["copies"] <= min(3, int(target / size[r["source"]]) + 1)
    again = {(r["doc_id"], r["source"], r["copies"]) for r in mixing_plan(docs.repartition(2)).collect()}
    assert again == {(r["doc_id"], r["source"], r["copies"]) for r in got}
    assert mix(docs).columns == docs.columns and mix(docs).count() == sum(r["copies"] for r in got)
    assert mixing_plan(empty).count() == 0 and mix(empty).count() == 0


def test_mixing_without_words(spark):
    plan = mixing_plan(spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, "b", 0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in plan] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("ranges,per_range", [(256, 32), (16, 2)])
def test_shards(docs, rows, empty, ranges, per_range):
    got = shard(docs.withColumn("size", F.lit("x")), ranges=ranges, per_range=per_range).collect()
    want = Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    for own in held.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in held[s]) - total / 8) <= largest for s in range(8))
    assert shard(empty).count() == 0


def test_one_text_fills_all_shards(spark):
    made = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = shard(made, ranges=32).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in sizes) == [500] * 8


def test_languages(spark, docs, rows, empty):
    rng = random.Random(2)
    syllables = {"xx": ["ka", "lo", "mi", "ra"], "yy": ["sch", "ung", "pf", "ber"]}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(60))
    made = [(i, text(lang), lang, "s", 0) for i, lang in enumerate(["xx", "yy"] * 60)]
    labelled = spark.createDataFrame(made[:60], SCHEMA)
    fresh = made[60:] + [(900, None, None, None, 0), (901, "", None, None, 0), (902, "12 !? 3", None, None, 0), (903, text("yy") * 300, "yy", None, 0), (904, "Ω", None, None, 0)]
    got = {r["doc_id"]: r for r in identify_language(spark.createDataFrame(fresh, SCHEMA).withColumn("score", F.lit("x")), labelled).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in made[60:]) and got[903]["lang_pred"] == "yy"
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == [UNKNOWN] * 3 and got[904]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in identify_language(docs, empty).collect()} == {UNKNOWN}
    assert identify_language(empty, labelled).count() == 0


def test_suffix_automaton():
    text = [1, 2, 1, 2, 2, 3, 1, 2]
    moves = suffix_automaton(text)

    def accepts(word):
        state = 0
        for c in word:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    substrings = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    rng = random.Random(3)
    tried = [tuple(rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 6))) for _ in range(500)]
    assert all(accepts(w) for w in substrings) and all(accepts(w) == (w in substrings) for w in tried)


def test_pieces(docs, rows, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = decode(encode(docs.withColumn("pieces", F.lit("x")))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] == r["text"]
        assert r["pieces"] == (None if r["text"] is None else library.encode(r["text"]))
    assert decode(encode(empty)).count() == 0


def test_pieces_of_odd_texts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [" ", "   a    b ", "\n\n x\ty\r\n", "ﬁ Å é ½ 🙂 \x01", "日本語 텍스트", "a" * 700, " " * 50, "x" + " " * 33 + "y"]
    got = decode(encode(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()
    assert [r["pieces"] for r in got] == library.encode(texts) and [r["decoded"] for r in got] == texts
    lost = decode(spark.createDataFrame([([5, None, -3, 99_999_999, 1],), (None,)], "pieces array<int>")).collect()
    assert [r["decoded"] for r in lost] == ["\x02", None]


def test_section_tokens(docs, rows, empty):
    by = defaultdict(list)
    for r in section_tokens(docs, rule="shared").collect():
        by[r["doc_id"]].append(r)
    from citewise.llm.tokens import VOCABULARY, encoder

    coder, lengths = encoder(VOCABULARY)
    for i, t in {(i, t) for i, t, *_ in rows}:
        if i is None:
            continue
        times = sum(r[0] == i for r in rows)
        own = sorted(by.get(i, []), key=lambda r: r["section"])
        assert len(own) == times * len(re.findall(r"[^\n]+\n*|\n+", t or ""))
        assert sum(r["n_tokens"] for r in own) == times * len(coder.encode_ordinary(t or ""))
        assert sum(r["share"] for r in own) == pytest.approx(sum(r["n_tokens"] for r in own))
        assert sum(r["stop"] - r["start"] for r in own) == times * len((t or "").encode())
    assert section_tokens(empty).count() == 0
    with pytest.raises(ValueError):
        section_tokens(docs, rule="none")


def test_attribution_rules():
    import numpy as np

    ends, sections = np.array([2, 7, 9, 12]), np.array([3, 8, 12])  # tokens [0,2) [2,7) [7,9) [9,12)
    assert attribute(ends, sections, "first_byte")[0].tolist() == [2, 1, 1]
    assert attribute(ends, sections, "most_bytes")[0].tolist() == [1, 2, 1]
    assert attribute(ends, sections, "shared")[2].tolist() == pytest.approx([1.2, 1.3, 1.5])
    assert attribute(ends, sections, "first_byte")[1].tolist() == [1, 1, 0]


def test_licenses(spark, docs, rows, empty):
    found = scan_licenses(docs.withColumn("known", F.lit(1)))
    assert found.count() == len(rows) and scan_licenses(empty).count() == 0
    texts = [
        "Intro.\nLicensed under the Apache License, Version 2.0.\nMore.", "RELEASED under the   MIT license! All rights reserved.", None, "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\n"
        "Some words.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Text " * 5000 + ". Licensed under CC BY-NC 4.0.",
    ]
    got = {r["n"]: r["licenses"] for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).collect()}
    assert got == {0: ["Apache-2.0"], 1: ["MIT", "LicenseRef-all-rights-reserved"], 2: [], 3: [], 4: ["MIT-text"], 5: [], 6: ["CC-BY-NC-4.0"]}


def test_near_copies_in_blocks(spark, monkeypatch):
    """Blocks find what pairs find."""
    from citewise.llm import near_duplicates as module

    monkeypatch.setattr(module, "STAR_ROUNDS", 0)
    monkeypatch.setattr(module, "PAIRED", 1)
    monkeypatch.setattr(module, "BLOCK", 16)
    test_near_copies_form_one_component(spark)


MIT = """The MIT License (MIT)

Copyright (c) 2020 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Copyright (c) 2020, A. Nobody

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GPL = """Copyright (C) 2020 A. Nobody

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""


def test_complete_notices(spark):
    """Standard notices unwrapped, wrapped at several widths, behind comment marks, and right under a heading."""
    import textwrap

    wants = {MIT: (["MIT-text"], ["mit_permission_conditions", "mit_notice"]), BSD: (["BSD-2-Clause"], ["bsd_redistribution", "bsd_source", "bsd_binary"]), GPL: (["GPL-3.0-or-later"], ["gpl_free", "gpl_redistribute_version3"])}
    wrap = lambda text, width: "\n".join("\n".join(textwrap.wrap(line, width, subsequent_indent="   " if line[:1].isdigit() else "")) for line in text.split("\n"))
    marks = ["", "# ", " * ", "// ", ";; ", "dnl ", "! ", "% "]
    made = []
    for text, want in wants.items():
        made += [(text, want), (text.replace("\n", "\r\n"), want), (text.replace("\n\n", "\n"), want), ("Some heading\n" + wrap(text.split("\n\n", 1)[1], 60).split("\n\n", 1 if text is MIT else 0)[-1], want)]
        for width in (40, 66, 78):
            for mark in marks:
                lines = [mark + line for line in wrap(text, width).split("\n")]
                made += [("\n".join(lines), want), ("\r\n".join(["/*", *lines, "*/ code();"]), want)]
    made += [(wrap(BSD, 70).replace("1. ", "1) ").replace("2. ", "(2) "), wants[BSD]), (wrap(GPL, 70) + "\n\n" + wrap(MIT, 70), (["MIT-text", "GPL-3.0-or-later"], wants[GPL][1] + wants[MIT][1]))]
    made += [
        ("Permission is hereby granted,\n\nfree of charge", ([], [])),
        ("All rights\nreserved", (["LicenseRef-all-rights-reserved"], ["reserved"])), ("All rights\n\nreserved", ([], [])), ("Not all rights reserved", ([], [])),
        ("Copyright\nAll rights reserved\nby nobody", (["LicenseRef-all-rights-reserved"], ["reserved"])),
        ("Licensed under the Apache License, Version\n2.0 (the \"License\"); you may not use this file except in\ncompliance with the License. You may obtain a\ncopy of the License at\n\n    http://www.apache.org/", (["Apache-2.0-header"], ["apache_grant_defined", "apache_compliance", "apache_copy"])),
    ]
    found = scan_licenses(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(made)], "n int, text string")).collect()
    got = {r["n"]: (r["licenses"], r["known"]) for r in found}
    assert {made[n][0]: own for n, own in got.items() if own != made[n][1]} == {}


def test_sentences_over_lines_against_brute_force(spark):
    """Every stretch of lines without a blank line in it may be a sentence."""
    rng = random.Random(9)
    known = {"a": "x y z", "b": "x y", "c": "z", "d": "y z w"}
    texts = ["".join(rng.choice("xyzw") + rng.choice([" ", " ", "\n", "\n", ". ", "\n\n", ".\n"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]

    def want(text):
        ids, paragraphs = [], re.split(r"[.][ \n]+|\n\n+", text)
        for paragraph in paragraphs:
            atoms = [a.split() for a in paragraph.split("\n")]
            at = 0
            while at < len(atoms):
                ends = [(j, i) for j in range(len(atoms), at, -1) for i, s in known.items() if s == " ".join(" ".join(a) for a in atoms[at:j])]
                at = ends[0][0] if ends else at + 1
                ids += [ends[0][1]] if ends else []
        return ids

    got = {r["n"]: r["known"] for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), known, [("A", ("a",))]).collect()}
    assert got == {n: want(text) for n, text in enumerate(texts)}
    assert sum(map(len, got.values())) > 200
    assert scan_licenses(spark.createDataFrame([(1, "x y")], "n int, text string"), {}, [("A", ("a",))]).first()["licenses"] == []


def test_language_of_mostly_copies(spark):
    """A language whose rows are nearly all one text, or have few letters, keeps its pieces."""
    rng = random.Random(4)
    syllables = {"xx": ["ka", "lo", "mi", "ra"], "yy": ["sch", "ung", "pf", "ber"], "zz": ["quo", "vex", "jaw"]}
    text = lambda lang, n=60: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    others = [text("xx") for _ in range(10)]
    made = [(text("yy"), "yy") for _ in range(60)] + [(t, "xx") for t in others]
    copied = spark.range(9990).select(F.lit(text("xx")).alias("text"), F.lit("xx").alias("lang"))
    odd = [("12 34 %d" % i, "zz") for i in range(2000)] + [("1 " * 5000 + text("zz"), "zz"), ("12 !?", "none"), (None, "null"), ("", "empty"), ("abc", None), ("abc", UNKNOWN)]
    labelled = spark.createDataFrame(made + odd, "text string, lang string").unionAll(copied)
    sample = draw_sample(labelled)
    assert sorted(sample) == ["xx", "yy", "zz"] and all(t in sample["xx"] for t in others)
    assert any(c.isalpha() for c in sample["zz"])
    few = draw_sample(spark.createDataFrame(made, "text string, lang string"), texts=1)
    assert sorted(few) == ["xx", "yy"]
    fresh = [(text(lang), lang) for lang in syllables for _ in range(20)]
    got = identify_language(spark.createDataFrame(fresh, "text string, lang string"), labelled).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
