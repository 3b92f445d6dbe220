"""Odd columns, very long runs and many letters for the operators on documents."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citewise.llm.collocations import collocations
from citewise.llm.common import column
from citewise.llm.divergence import source_divergence
from citewise.llm.exact_duplicates import exact_duplicates
from citewise.llm.language import identify_language
from citewise.llm.licenses import scan_licenses
from citewise.llm.mixing import mix, mixing_plan
from citewise.llm.near_duplicates import near_duplicates
from citewise.llm.pieces import MODEL, decode, encode, piece_table
from citewise.llm.repeats import remove_repeats, without_repeats
from citewise.llm.sharding import shard
from citewise.llm.tokens import VOCABULARY, encode_text, encoder, piece_encoder, section_tokens

ODD = [
    "a.b", "a`b", "_source", "_id", "_label", "_kept", "_label2", "label", "own_label", "kept_text", "id_of_text", "label_of_text", "plan_source", "own_size",
    "copy", "size", "copies", "target", "source_size", "pieces", "decoded", "lang_pred", "score", "h", "k", "cid", "uid", "key", "n", "word", "band", "part", "deal", "row", "rank", "space d",
]
BASE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) for _ in range(40)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "en", rng.choice("ab"), len(t)) for i, t in enumerate(texts + texts[:3])], BASE)
    return docs.select("*", *[F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(ODD)], F.struct(F.lit(1).alias("in side")).alias("s t"))


def test_every_column_comes_back(spark, odd):
    want = Counter(tuple(r) for r in odd.select("doc_id", *[column(c) for c in ODD], column("s t")).collect())
    steps = {
        "mix": lambda: mix(odd), "without_repeats": lambda: without_repeats(odd), "language": lambda: corpus_pipeline.with_language(spark, odd, ""),
        "near": lambda: corpus_pipeline.without_near_duplicates(spark, odd, ""), "repeats": lambda: corpus_pipeline.without_repeated_passages(spark, odd, ""),
    }
    for name, step in steps.items():
        out = step()
        assert out.columns == odd.columns, name
        got = Counter(tuple(r) for r in out.select("doc_id", *[column(c) for c in ODD], column("s t")).collect())
        assert got and set(got) <= set(want), name
        if name in ("without_repeats", "language", "repeats"):
            assert got == want, name


@pytest.mark.parametrize("operator", [
    near_duplicates, remove_repeats, mixing_plan, shard, section_tokens, scan_licenses, exact_duplicates, source_divergence, collocations, encode,
    lambda d: decode(encode(d)), lambda d: identify_language(d, d),
])
def test_odd_names_and_empty_tables(odd, operator):
    want = operator(odd.select("doc_id", "text", "lang", "source"))
    own = [c for c in want.columns if c not in ("lang", "source", "text") or c in ("lang", "source") and "rank" in want.columns]
    got = operator(odd)
    assert Counter(map(str, got.select(*own).collect())) == Counter(map(str, want.select(*own).collect()))
    assert operator(odd.limit(0)).count() == 0


def test_long_runs_of_white_space():
    (coder, lengths), piece = encoder(VOCABULARY), piece_encoder(VOCABULARY)
    short = ["a" + " " * n + "b" for n in (255, 256, 257, 3000)] + [" " * 400, "\n" * 999 + "x", "x" + "\u3000 \t" * 300 + "\r\ny", " " * 300 + "\n", "\x1c" * 400 + " a", "a \n" * 300]
    for text in short:
        assert encode_text(text, coder, piece) == coder.encode_ordinary(text), repr(text[:10])
    for char, n in ((" ", 10_000_000), ("\n", 2_000_000)):
        ids = encode_text("head" + char * n + "tail", coder, piece)
        assert int(lengths[np.asarray(ids)].sum()) == n + 8 and coder.decode(ids) == "head" + char * n + "tail"


def test_sections_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000 + "x"), (2, "\n" * 5 + "word\n")], "doc_id bigint, text string")
    got = section_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("stop").alias("stop"), F.count("*").alias("sections")).collect()
    assert {r["doc_id"]: (r["stop"], r["sections"]) for r in got} == {1: (1_500_001, 1), 2: (10, 2)}


@pytest.mark.parametrize("rule", ["first_byte", "most_bytes", "shared"])
def test_sections_by_hand(spark, rule):
    """Every token of every document dealt to the sections by its bytes, one after the other."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "x", "\n", "\n\n", " \n", "  ", "\n ", "é", "1", ".\n"]) for _ in range(60)) for _ in range(25)]
    coder, _ = encoder(VOCABULARY)
    want = {}
    for d, text in enumerate(texts):
        raw, section, owner = text.encode(), 0, []
        for i, byte in enumerate(raw):
            if i and raw[i - 1] == 10 and byte != 10:
                section += 1
            owner.append(section)
        at = 0
        for token in coder.encode_ordinary(text):
            own = Counter(owner[at : at + len(coder.decode_single_token_bytes(token))])
            at += sum(own.values())
            homes = {min(own): 1.0} if rule == "first_byte" else {s: n / sum(own.values()) for s, n in own.items()}
            if rule == "most_bytes":
                homes = {min(s for s in own if own[s] == max(own.values())): 1.0}
            for s, share in homes.items():
                want[(d, s)] = want.get((d, s), 0) + share
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["doc_id"], r["section"]): r["share"] for r in section_tokens(docs, rule).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and abs(sum(got.values()) - sum(want.values())) < 1e-6


def test_lattice_of_frequent_words_and_rare_ones_agree(spark):
    """The relational fold, the fold over arrays and that of long words give the library's ids, whichever takes a word."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("aehintorsxy,.ÄéЖ日🙂\n") for _ in range(rng.randint(1, 14))) for _ in range(80)) for _ in range(30)]
    texts += ["the of and " * 50, "x" * 3000, "ab" * 900 + "日" * 40, " " * 70, "a" * 48 + " " + "a" * 49 + " b", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for most in (0, 300, 1 << 18):
        for r in encode(docs, most_known=most, with_decoded=True).collect():
            assert r["decoded"] == r["text"]
            assert r["pieces"] == (None if r["text"] is None else library.encode(r["text"])), (most, r["text"][:50])


def test_long_words_in_parts(monkeypatch):
    import sentencepiece

    from citewise.llm import lattice

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = piece_table(MODEL)
    monkeypatch.setattr(lattice, "PART", 64)
    text = "some words, and " * 30 + "y" * 500 + " end " + "é" * 90 + " of"
    words = [w for part, _ in table.cuts.of_texts([None, text, "", "x"]) for w in part.to_pylist()]
    assert "".join(words) == ("▁" + text + "▁x").replace(" ", "▁")
    assert np.concatenate(table.encode_words(words[:-1])).tolist() == library.encode(text)
    rows = [r for _, row in table.cuts.of_texts([None, text, "", "x"]) for r in row.tolist()]
    assert set(rows) == {1, 3} and rows == sorted(rows)
    long = "▁" + "".join(random.Random(1).choice("etaoinshr") for _ in range(4000))
    assert table.fold_long(long).tolist() == np.concatenate(table.encode_words([long])).tolist() == library.encode(long[1:])
    table.known.clear()
    short = long[:300]
    assert table.fold_long(short).tolist() == table.encode_words([short])[0].tolist() == library.encode(short[1:])


BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
FREE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
NOTICES = {
    BSD_CLAUSES: ["BSD-2-Clause"], BSD_CLAUSES + ENDORSEMENT: ["BSD-3-Clause"], BSD_CLAUSES + ENDORSEMENT + "\n\n" + BSD_CLAUSES: ["BSD-2-Clause", "BSD-3-Clause"],
    FREE.format("program", ";", "", ";", 2): ["GPL-2.0-or-later"], FREE.format("program", ":", "", ",", 2): ["GPL-2.0-or-later"], FREE.format("program", ":", "", ",", 3): ["GPL-3.0-or-later"],
    FREE.format("library", ";", "Lesser ", ";", 2.1): ["LGPL-2.1-or-later"], FREE.format("program", ":", "Lesser ", ",", 3): ["LGPL-3.0-or-later"], FREE.format("program", ":", "Affero ", ",", 3): ["AGPL-3.0-or-later"],
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": ["ISC"],
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": ["MPL-2.0"],
    "code\n// SPDX-License-Identifier: MIT\nmore": ["MIT"], "# SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0-or-later"], "/* SPDX-License-Identifier: Apache-2.0 */ x": [], "/* SPDX-License-Identifier: Apache-2.0 */\nx": ["Apache-2.0"],
    "Licensed under the MIT License.": ["MIT"], "This project is licensed under the MIT License.\n": ["MIT"], "MIT": [], "der mit. MIT. License: MIT": [], "A text about a license and permission.": [],
}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_standard_notices(spark, mark):
    import textwrap

    texts = []
    for text, want in NOTICES.items():
        wrapped = "\n".join("\n".join(textwrap.wrap(line, 62)) for line in text.split("\n"))
        texts += [(text, want), ("\n".join(mark + line for line in wrapped.split("\n")), want)]
    found = scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "n int, text string")).collect()
    assert {texts[r["n"]][0]: r["licenses"] for r in found if r["licenses"] != texts[r["n"]][1]} == {}


def test_words_that_cover_all_sentences():
    from citewise.llm.licenses import ALL_SENTENCES, covering_words

    words = covering_words(list(ALL_SENTENCES.values()))
    assert all(set(words) & set(s.split(" ")) for s in ALL_SENTENCES.values()) and len(words) < 20
    assert covering_words([]) == []


def test_texts_of_one_id_link_together(spark):
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = lambda words: " ".join([*words[:-1], "other"])
    a, b, c = text(), text(), text()
    made = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, "few words"), (1, "few words")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)).collect())
    assert got == [(1, 1, 1, True), (1, 116, 1, True), (1, 116, 1, True), (2, 116, 1, False), (3, 116, 1, False), (4, 116, 4, True), (5, 1, 1, False)]
