import hashlib
import math
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citewise.functions import hashing, labels, names, text, values
from citewise.functions import questions as qs


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("QUARTER RESULTS", True), ("3.2 TANK INSPECTION", True), ("Weld Seams", True), ("4.1 Weld Seams", True),
        ("weld seams", False), ("Weld seams", False), ("STOPS HERE:", False), ("QZ", False), ("Y" * 81, False), ("", False),
        ("Form Nr: K | Issue: 2", False), ("B2nd", False),
    ],
)
def test_heading(one, line, expected):
    assert one(text.is_heading(F.lit(line))) is expected


def test_strip_and_blank(one):
    assert one(text.strip(F.lit(" \t a b  \n"))) == "a b"
    assert one(text.strip(F.lit("plain"))) == "plain"
    assert one(text.is_blank(F.lit(" \n\x1c"))) and one(text.is_blank(F.lit(None).cast("string")))
    assert not one(text.is_blank(F.lit("  x")))


@pytest.mark.parametrize("raw", ["a\nb\r\nc\rd", "one", "", "x\n", "\n\n", "a b\x0cc", "end\r\n"])
def test_split_lines_matches_python(one, raw):
    assert one(text.split_lines(F.lit(raw))) == raw.splitlines()


def test_table_rendering(one):
    assert one(text.pipe_row(F.array(F.lit(" a "), F.lit(""), F.lit(None).cast("string")))) == "a | (blank) | (blank)"
    assert one(text.row_is_empty(F.array(F.lit(" "), F.lit(None).cast("string"))))


def test_line_numbers_and_digits(one):
    assert one(text.line_number_at(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert one(text.collapse_digits(F.lit(" Page 12 of 345 "))) == "Page # of #"


def test_overlap_counts_whole_words(one):
    assert one(text.lexical_overlap(F.lit("The cat  sat"), F.lit("the\ncat satx."))) == 2
    assert one(text.lexical_overlap(F.lit(""), F.lit("x"))) == 0


def plain_vector(value, dim):
    counts = {}
    for token in re.findall("[a-z0-9]+", value.lower()):
        digest = hashlib.md5(token.encode()).digest()
        bucket = int.from_bytes(digest[:4], "big") % dim
        counts[bucket] = counts.get(bucket, 0) + (1 if digest[4] % 2 == 0 else -1)
    norm = math.sqrt(sum(c * c for c in counts.values()))
    return {b: c / norm for b, c in counts.items() if c}


@pytest.mark.parametrize("dim", [8, 384])
def test_hashed_vector(one, dim):
    value = "Übergrößen: a night train, an early ferry; train 42 the-end " * 5
    got = one(hashing.hashed_vector(F.lit(value), dim))
    assert {e["bucket"]: e["weight"] for e in got} == pytest.approx(plain_vector(value, dim))
    assert [e["bucket"] for e in got] == sorted(e["bucket"] for e in got)
    dense = one(hashing.to_dense(hashing.hashed_vector(F.lit(value), dim), dim))
    want = plain_vector(value, dim)
    assert dense == pytest.approx([want.get(i, 0.0) for i in range(dim)], abs=1e-6)


def test_empty_vector(one):
    assert one(hashing.hashed_vector(F.lit("ñ ü"))) == []
    assert one(hashing.to_dense(hashing.hashed_vector(F.lit("")), 4)) == [0.0] * 4


def test_wrong_dimension_fails(one):
    with pytest.raises(Exception, match="expects 3"):
        one(hashing.checked_dense(F.array(F.lit(1.0).cast("float")), 3))


@pytest.mark.parametrize(
    ("header", "slug"),
    [("Ship Day", "ship_day"), ("3 Year Plan", "col_3_year_plan"), ("where", "where_col"), ("%%", "col"), (" B--C ", "b_c")],
)
def test_column_slug(one, header, slug):
    assert one(names.column_slug(F.lit(header))) == slug


@pytest.mark.parametrize(
    ("given", "expected"),
    [(["a", "a", "a"], ["a", "a_2", "a_3"]), (["a", "a_2", "a"], ["a", "a_2", "a_3"]), ([], []), (["x", "y"], ["x", "y"])],
)
def test_distinct_names(spark, given, expected):
    df = spark.createDataFrame([(given,)], "n array<string>")
    assert df.select(names.distinct_names(F.col("n")).alias("v")).first()["v"] == expected


def test_table_name(one):
    name = one(names.table_name(F.lit("s"), F.lit("Q1 Sheet!" + "x" * 60), F.lit("id")))
    assert re.fullmatch(r"xlsx_q1_sheet_x{23}_[0-9a-f]{10}", name) and len(name) <= 63


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2024-01-05", "2024-01-05 00:00:00"), ("13/02/2024", "2024-02-13 00:00:00"), ("01/02/2024", "2024-01-02 00:00:00"),
        ("Jan 5, 2024", "2024-01-05 00:00:00"), ("5-Mar-24", "2024-03-05 00:00:00"), ("March 2024", "2024-03-01 00:00:00"),
        ("2024/1/5 3:04 PM", "2024-01-05 15:04:00"), ("2024-13-01", None), ("January", None), ("Lot 5", None), ("Q1 2024", None),
    ],
)
def test_dates(one, value, expected):
    assert one(values.parse_timestamp(F.lit(value)).cast("string")) == expected


@pytest.mark.parametrize(
    ("value", "kind", "expected"),
    [
        ("0.27384615384615384615", "decimal(38,20)", "0.2738"), ("48210.75", "decimal(18,4)", "48210.75"), ("70.0000", "decimal(18,4)", "70"),
        (31, "int", "31"), ("Open", "string", "Open"), (None, "string", "None"), (0.27384615384615384615, "double", "0.2738"),
        (False, "boolean", "False"), (0.0, "double", "0"),
    ],
)
def test_display_value(one, value, kind, expected):
    assert one(values.display_value(F.lit(value).cast(kind), kind)) == expected


@pytest.mark.parametrize("number", [1.0, 1e7, 123456789.123, 1e16, 1.5e-5, 0.0001, -2.5e20, 0.1, 25.0])
def test_display_float_matches_python(one, number):
    assert one(values.display_float(F.lit(number))) == repr(number)


def test_location_labels(one):
    none = F.lit(None)
    label = labels.location_label(F.lit(1), F.lit(3), F.lit(2), F.lit(9), F.lit("Intro"))
    assert one(label) == " (page 1-3, slide 2, line 9, section: Intro)"
    assert one(labels.location_label(F.lit(1), F.lit(1), none, none, F.lit(""))) == " (page 1)"
    assert one(labels.location_label(*[none.cast("int")] * 4, none.cast("string"))) == ""
    short = labels.short_location(F.lit("document_chunk"), F.lit("a.pdf"), none, F.lit(3), F.lit(2), F.lit(9), F.lit("x"))
    assert one(short) == "a.pdf p.3 slide 2 line 9 sec='x'"


@pytest.mark.parametrize(
    ("question", "documents", "tables", "expected"),
    [
        ("Which risks does the memo describe?", True, False, "SEMANTIC"),
        ("What is the average weight of a crate?", False, True, "STRUCTURED"),
        ("Find the tyre stock list and tell me the total weight in May.", True, True, "HYBRID"),
        ("How many distinct ports are there?", True, False, "SEMANTIC"), ("Describe the second memo.", False, True, "STRUCTURED"),
        ("good day", False, False, "SEMANTIC"),
    ],
)
def test_routing(one, question, documents, tables, expected):
    assert one(qs.keyword_route(F.lit(question), F.lit(documents), F.lit(tables))) == expected


@pytest.mark.parametrize(
    ("label", "documents", "tables", "expected"),
    [
        ("nonsense", True, True, "SEMANTIC"), ("nonsense", False, True, "STRUCTURED"), ("structured", True, False, "SEMANTIC"),
        ("SEMANTIC", False, True, "STRUCTURED"), (" hybrid ", False, True, "STRUCTURED"), ("HYBRID", True, False, "SEMANTIC"),
        ("HYBRID", True, True, "HYBRID"), ("STRUCTURED", False, False, "STRUCTURED"),
    ],
)
def test_route_guard(one, label, documents, tables, expected):
    assert one(qs.guarded_route(F.lit(label), F.lit(documents), F.lit(tables))) == expected


@pytest.mark.parametrize(
    ("reply", "count", "expected"),
    [
        ("[4, 1, 2]", 6, [4, 1, 2]), ("[2, 77, 1, 2, -3]", 4, [2, 1]), ("My order:\n```json\n[3, 0]\n```", 4, [3, 0]),
        ("```\n[2]\n```", 3, [2]), ("[]", 5, []), ("no list here", 5, []), ("", 5, []), ("null", 5, []), ("[two, one]", 5, []),
        ('{"order": [3, 1]}', 5, [3, 1]), ("[false, 3, 1.0]", 5, [3]),
    ],
)
def test_index_list(one, reply, count, expected):
    assert one(qs.index_list(F.lit(reply), F.lit(count))) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("SELECT MAX(w) FROM c WHERE \"k\" = 'Z' NO_QUERY", "SELECT MAX(w) FROM c WHERE \"k\" = 'Z'"), ("  NO_QUERY  ", "NO_QUERY"),
        ("SELECT MIN(w) FROM c", "SELECT MIN(w) FROM c"), ("SELECT 'NO_QUERY as text' AS remark FROM c", "SELECT 'NO_QUERY as text' AS remark FROM c"),
    ],
)
def test_clean_sql(one, raw, expected):
    assert one(qs.clean_sql(F.lit(raw))) == expected


@pytest.mark.parametrize(
    ("question", "sql"),
    [
        ("How many unique ports are there?", 'SELECT COUNT(DISTINCT "port") FROM t;'),
        ("What is the average weight in the Steel department?", 'SELECT AVG("weight") FROM t WHERE "department" = \'Steel\';'),
        ("total of weight where department = 'Grain'", 'SELECT SUM("weight") FROM t WHERE "department" = \'Grain\';'),
        ("Sum of nothing known", 'SELECT SUM("department") FROM t;'), ("Will it rain tomorrow?", "NO_QUERY"),
    ],
)
def test_intents(one, question, sql):
    columns = F.array(F.lit("department"), F.lit("port"), F.lit("weight"))
    assert one(qs.intent_sql(qs.intent(F.lit(question), columns), F.lit("t"))) == sql


def test_answers(one):
    assert one(qs.extract_answer(F.lit("Query executed: q\n\nDatabase result: 4"))) == "4"
    assert one(qs.extract_answer(F.lit("Query executed: q\n\nDatabase result:\na, b\n1, 2"))) == "a, b"
    assert one(qs.extract_answer(F.lit("[Source: a.txt]\nfirst\nsecond\n\n[Source: b.txt]\nthird"))) == "first second"
    assert one(qs.extract_answer(F.lit("  "))) == qs.NOT_FOUND
    assert len(one(qs.extract_answer(F.lit("x" * 1000)))) == 300


def test_sparse_dot(one):
    entry = lambda b, w: F.struct(F.lit(b).alias("bucket"), F.lit(w).alias("weight"))
    left, right = F.array(entry(0, 0.5), entry(3, 2.0), entry(9, 1.0)), F.array(entry(3, 0.25), entry(4, 7.0), entry(9, -1.0))
    assert one(hashing.sparse_dot(left, right)) == -0.5
    assert one(hashing.sparse_dot(left, F.lit(None).cast(hashing.SPARSE_TYPE))) is None


def test_vectors_are_made_of_few_texts_at_a_time(monkeypatch):
    seen = []
    monkeypatch.setattr(hashing, "unit_vectors", lambda texts, keys: seen.append(len(texts)) or pa.array([[]] * len(texts), hashing.ARROW_TYPE))
    embed = hashing._hasher(384).func
    out = list(embed(iter([pa.array(["x"] * 10_000), pa.array(["word " * 20_000] * 50)])))
    assert [len(a) for a in out] == [10_000, 50]
    assert max(seen[:-5]) * 384 <= hashing.PART_CELLS and max(seen[-5:]) < 11
