"""Licence scans: normalised sentences become identifiers, sequences of identifiers are matched by ordered rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewise.functions.text import let

BREAK = r"[.!?;:][ \t\r\n]+|[\r\n]+"

# Sentences by identifier, normalised: lower case, everything but a-z and 0-9 becomes one space.
SENTENCES: Mapping[str, str] = {
    "apache_grant": "licensed under the apache license version 2 0",
    "apache_grant_defined": "licensed under the apache license version 2 0 the license",
    "apache_compliance": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_release": "released under the mit license",
    "mit_title": "the mit license",
    "mit_permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software",
    "gpl_redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3_version": "either version 3 of the license or at your option any later version",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "reserved": "all rights reserved",
}

# Rules in order: a name and the identifiers that have to follow each other.
RULES: Sequence[tuple[str, tuple[str, ...]]] = (
    ("Apache-2.0-header", ("apache_grant_defined", "apache_compliance", "apache_copy")),
    ("Apache-2.0", ("apache_grant",)),
    ("MIT-text", ("mit_permission", "mit_notice")),
    ("MIT", ("mit_release",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_redistribute", "gpl3_version")),
    ("GPL-3.0", ("gpl3_work",)),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)


GPL_TERMS = "you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation"
GPL_VERSION = "either version {0} of the license or at your option any later version"
ENDORSE = "neither the name of the {0} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
ISC = "permission to use copy modify {0} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"

# Sentences of the standard notices as they stand there, and the rules that take them; a name may have several rules. A
# version stands in the sentence of the terms behind a comma, and is one of its own behind a semicolon.
NOTICE_SENTENCES: Mapping[str, str] = {
    "mit_permission_conditions": SENTENCES["mit_permission"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "gpl_redistribute_version3": SENTENCES["gpl_redistribute"] + " " + SENTENCES["gpl3_version"],
    "gpl_redistribute_version2": GPL_TERMS.format("") + " " + GPL_VERSION.format("2"),
    "gpl2_version": GPL_VERSION.format("2"),
    "lgpl_free": "this library is free software",
    "lgpl_redistribute": GPL_TERMS.format("lesser "),
    "lgpl_redistribute_version21": GPL_TERMS.format("lesser ") + " " + GPL_VERSION.format("2 1"),
    "lgpl_redistribute_version3": GPL_TERMS.format("lesser ") + " " + GPL_VERSION.format("3"),
    "lgpl21_version": GPL_VERSION.format("2 1"),
    "agpl_redistribute": GPL_TERMS.format("affero "),
    "agpl_redistribute_version3": GPL_TERMS.format("affero ") + " " + GPL_VERSION.format("3"),
    "bsd_endorse": ENDORSE.format("copyright holder"),
    "bsd_endorse_author": ENDORSE.format("author"),
    "isc_permission": ISC.format("and or"),
    "isc_permission_and": ISC.format("and"),
    "mpl_terms": "this source code form is subject to the terms of the mozilla public license v",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mit_licensed": "licensed under the mit license",
    "mit_project": "this project is licensed under the mit license",
}
BSD2, TERMS = ("bsd_redistribution", "bsd_source", "bsd_binary"), ("gpl_free", "lgpl_free")
NOTICE_RULES: Sequence[tuple[str, tuple[str, ...]]] = (
    ("MIT-text", ("mit_permission_conditions", "mit_notice")),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_project",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_redistribute_version3")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl_redistribute_version2")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl_redistribute", "gpl2_version")),
    *[("LGPL-2.1-or-later", (free, "lgpl_redistribute_version21")) for free in TERMS],
    *[("LGPL-2.1-or-later", (free, "lgpl_redistribute", "lgpl21_version")) for free in TERMS],
    *[("LGPL-3.0-or-later", (free, "lgpl_redistribute_version3")) for free in TERMS],
    *[("LGPL-3.0-or-later", (free, "lgpl_redistribute", "gpl3_version")) for free in TERMS],
    ("AGPL-3.0-or-later", ("gpl_free", "agpl_redistribute_version3")),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl_redistribute", "gpl3_version")),
    ("BSD-3-Clause", (*BSD2, "bsd_endorse")),
    ("BSD-3-Clause", (*BSD2, "bsd_endorse_author")),
    ("ISC", ("isc_permission",)),
    ("ISC", ("isc_permission_and",)),
    ("MPL-2.0", ("mpl_terms", "mpl_copy")),
)
# Names that a line "SPDX-License-Identifier: name" may give; each is a licence only right behind that marker.
SPDX_MARK = "spdx license identifier"
SPDX_NAMES = (
    "Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0",
)
SPDX_SENTENCES: Mapping[str, str] = {"spdx": SPDX_MARK, **{f"spdx:{n}": re.sub("[^a-z0-9]+", " ", n.lower()) for n in SPDX_NAMES}}
SPDX_RULES: Sequence[tuple[str, tuple[str, ...]]] = tuple((n, ("spdx", f"spdx:{n}")) for n in SPDX_NAMES)
ALL_SENTENCES: Mapping[str, str] = {**SENTENCES, **NOTICE_SENTENCES, **SPDX_SENTENCES}
ALL_RULES: Sequence[tuple[str, tuple[str, ...]]] = (*RULES, *NOTICE_RULES, *SPDX_RULES)

# Marks of a comment at the start of a line, and numbers of a list there ("1)"), which may also begin a sentence.
COMMENT = r"(^|\n)[^a-z0-9\n]*(?:(?:dnl|rem)(?![a-z0-9])[^a-z0-9\n]*)?"
NUMBER = r"(^|\n)([0-9]{1,3}|[ivx]{1,4}|[a-z])\)[ \t]+"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text in order, without empty ones."""
    clean = F.transform(F.split(text, BREAK), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(clean, lambda s: s != "")


def marked(text: Column) -> Column:
    """The normalised text with H where a sentence ends (punctuation, blank line) and S at a line break inside a paragraph."""
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?", "\n"), COMMENT, "$1")
    ended = F.regexp_replace(F.regexp_replace(lines, NUMBER, "$1$2\n"), r"[.!?;:][ \t\n]+|\n\n+", "H")
    words = F.regexp_replace(F.translate(ended, "\n", "S"), "[^a-z0-9HS]+", " ")
    return F.concat(F.lit("H"), F.regexp_replace(F.regexp_replace(words, " ?([HS]) ?", "$1"), "^ | $", ""), F.lit("H"))


def wrapped(text: Column, known: Mapping[str, str]) -> Column:
    """Known sentences of a text in order, also those that run over line breaks; the longest of those that start at one place."""
    wanted = sorted((s for s in known.values() if re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s)), key=len, reverse=True)
    if not wanted:
        return F.array().cast("array<string>")
    # no known sentence is without one of these words; a short name counts behind its marker only, which has one
    telling = covering_words([s for i, s in known.items() if s in wanted and not i.startswith("spdx:")])
    named = F.rlike(F.lower(text), F.lit("(?<![a-z0-9])(?:" + "|".join(telling) + ")(?![a-z0-9])")) if telling else F.lit(False)
    pattern = "(?<=[HS])(?:" + "|".join(s.replace(" ", "[ S]") for s in wanted) + ")(?=[HS])"
    found = F.transform(F.regexp_extract_all(marked(text), F.lit(pattern), F.lit(0)), lambda s: F.translate(s, "S", " "))
    return F.when(named, found).otherwise(F.array().cast("array<string>"))


def covering_words(known: Sequence[str]) -> list[str]:
    """Few words, long ones first, of which every sentence has one; a text without them needs no closer look."""
    rest, chosen = [set(s.split(" ")) for s in known], []
    while rest:
        counts: dict[str, int] = {}
        for words in rest:
            for word in words:
                counts[word] = counts.get(word, 0) + 1
        best = min(counts, key=lambda w: (-counts[w] * min(len(w), 8), w))
        chosen.append(best)
        rest = [words for words in rest if best not in words]
    return chosen


def scan_licenses(docs: DataFrame, known: Mapping[str, str] = ALL_SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = ALL_RULES) -> DataFrame:
    """docs with n_sentences, known (identifiers in text order) and licenses (names of matching rules, in rule order).

    A sentence is a licence sentence when its normalised form equals a known one. It begins and ends at punctuation or at a
    line break, and a line break inside it counts as a space, as do comment marks at line starts; a blank line, or one without
    a-z and 0-9, ends it. n_sentences counts the pieces between punctuation and line breaks. A rule matches when its
    identifiers follow each other in the document's sequence of identifiers, or in that of these pieces alone; sentences that are not known
    do not break a sequence. What a longer rule takes is not left for a shorter one inside it (a BSD-3-Clause notice is no
    BSD-2-Clause notice). A name with several rules stands where its first one does. Repeated sentences repeat in known; a null
    or empty text has no sentences and empty lists. Texts of any length are read whole. Input columns named like the added ones are replaced. Every
    document stays one row, whatever it holds; an empty table gives an empty one.
    """
    table = F.create_map(*[F.lit(v) for identifier, sentence in known.items() for v in (sentence, identifier)])
    wanted = list(known.values())

    def name(found: Column) -> Column:
        """Identifiers of sentences; a licence's short name counts only right behind the marker that announces one."""
        behind = lambda ids: F.filter(ids, lambda x, i: ~x.startswith("spdx:") | (F.get(ids, i - 1) == F.lit("spdx")))
        return let(F.transform(found, lambda s: F.element_at(table, s)), behind)

    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.drop("n_sentences", "known", "licenses", "_sentences", "_pieces").withColumn("_sentences", F.coalesce(sentences(F.col("text")), F.array().cast("array<string>")))
    out = split.withColumn("n_sentences", F.size("_sentences").cast("bigint")).withColumn("known", name(wrapped(text, known)))
    out = out.withColumn("_pieces", name(F.filter(F.col("_sentences"), lambda s: s.isin(wanted)))).drop("_sentences")
    line = F.concat(F.lit("|"), F.array_join("known", "|"), F.lit("||"), F.array_join("_pieces", "|"), F.lit("|"))
    ways: dict[str, list[Column]] = {}
    for license_name, ids in rules:
        longer = [other for _, other in rules if len(other) > len(ids) and "|" + "|".join(ids) + "|" in "|" + "|".join(other) + "|"]
        left = reduce(lambda held, other: F.replace(held, F.lit("|" + "|".join(other) + "|"), F.lit("||")), sorted(longer, key=len, reverse=True), line)
        ways.setdefault(license_name, []).append(left.contains("|" + "|".join(ids) + "|"))
    names = [F.when(reduce(Column.__or__, found), F.lit(license_name)) for license_name, found in ways.items()]
    return out.withColumn("licenses", F.array_compact(F.array(*names))).drop("_pieces")
