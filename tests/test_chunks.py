import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citewise.operators.chunking import PART_BYTES, _split_batches, chunk_documents, split_text
from citewise.operators.segments import block_units, page_rows, segment_lines, segment_pages, slide_units, text_pages
from citewise.plans.scans import carry_forward, number_rows
from citewise.sources.files import text_units


def merge(pieces, size, overlap):
    """The documented merging rule, piece by piece."""
    done, window, total = [], [], 0
    for piece in pieces:
        if total + len(piece) > size and window:
            done.append("".join(window))
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    if window:
        done.append("".join(window))
    return done


def naive_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The documented recursive rule: first separator present, kept at the front of the piece it opens."""
    rest = list(separators)
    while rest[0] and rest[0] not in text:
        rest.pop(0)
    mark, *deeper = rest
    if mark:
        head, *tail = text.split(mark)
        pieces = [p for p in [head, *(mark + t for t in tail)] if p]
    else:
        pieces = list(text)
    out, fitting = [], []
    for piece in pieces:
        if len(piece) < size:
            fitting.append(piece)
            continue
        out += merge(fitting, size, overlap)
        fitting = []
        out += naive_split(piece, size, overlap, deeper) if deeper else [piece]
    return out + merge(fitting, size, overlap)


def expected_pieces(text, size, overlap):
    if len(text) <= size:
        return [text] if text else []
    return [c.strip() for c in naive_split(text, size, overlap) if c.strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_split_matches_the_documented_rule(text, size, overlap):
    got = split_text(text, size, overlap)
    assert [c for c, _, _ in got] == expected_pieces(text, size, overlap)
    assert all(text[s:e] == c for c, s, e in got)


def test_split_of_long_prose():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "longer ", "\n", "x" * 30, ". ", "\n\n"]) for _ in range(3000))
    assert [c for c, _, _ in split_text(text, 600, 80)] == expected_pieces(text, 600, 80)


def test_text_document_positions(spark):
    body = "first line\nsecond line\n" + "\n".join(f"row {i} of the text" for i in range(100))
    docs = spark.createDataFrame([("d", body), ("blank", " \n ")], "doc_id string, text string")
    rows = chunk_documents(text_units(docs), 200, 40, single_unit=True).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {"d"}
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert body[r["char_start"] : r["char_end"]] == r["text"]
        assert r["line_start"] == body.count("\n", 0, r["char_start"]) + 1
        assert r["line_end"] == body.count("\n", 0, r["char_end"] - 1) + 1


def test_table_header_repeats(spark):
    header = "Lot | Status"
    table = "\n".join([header] + [f"L-{i:03d} | fine" for i in range(40)])
    units = spark.createDataFrame([("d", 0, table, header), ("d", 1, "closing text", None)], "doc_id string, unit_no int, text string, table_header string")
    rows = chunk_documents(units, 120, 20).orderBy("chunk_index").collect()
    assert len(rows) > 3 and all(r["text"].startswith(header) for r in rows[:-1])
    assert rows[-1]["text"] == "closing text" and rows[-1]["line_start"] is None
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


LINES = "doc_id string, page_no int, line_no int, kind string, text string, cells array<string>, table_no int"


def lines_of(spark, pages):
    rows = []
    for page, entries in enumerate(pages, start=1):
        for number, entry in enumerate(entries):
            if isinstance(entry, list):
                rows.append(("d", page, number, "table", None, entry, 0))
            else:
                rows.append(("d", page, number, "text", entry, None, None))
    return spark.createDataFrame(rows, LINES)


def test_segments_follow_headings_and_pages(spark):
    lines = lines_of(spark, [
        ["ACME Report 1", "FINANCIAL PERFORMANCE", "Revenue grew significantly.", "It really did.", "Page 1 of 3"],
        ["ACME Report 2", "no heading here.", "1.0 COMPLAINT SUMMARY", "Fourteen complaints.", "2.0 ROOT CAUSE ANALYSIS", "Supplier change.", "Page 2 of 3"],
        ["ACME Report 3", "Closing words here today.", "Page 3 of 3"],
    ])
    units = segment_lines(lines).orderBy("page_start", "unit_no").collect()
    assert [(u["page_start"], u["section"], u["text"]) for u in units] == [
        (1, "FINANCIAL PERFORMANCE", "Revenue grew significantly.\nIt really did."),
        (2, "FINANCIAL PERFORMANCE", "no heading here."),
        (2, "1.0 COMPLAINT SUMMARY", "Fourteen complaints."),
        (2, "2.0 ROOT CAUSE ANALYSIS", "Supplier change."),
        (3, "2.0 ROOT CAUSE ANALYSIS", "Closing words here today."),
    ]


def test_short_lead_in_joins_its_table(spark):
    long_text = "a paragraph long enough to stand alone, " * 3
    lines = lines_of(spark, [["short title:", ["A", "B"], ["1", None], long_text, ["C"], ["2"]]])
    units = segment_lines(lines).orderBy("unit_no").collect()
    assert [u["text"] for u in units] == ["short title:\nA | B\n1 | (blank)", long_text.strip(), "C\n2"]
    assert [u["table_header"] for u in units] == ["A | B", None, "C"]


def test_heading_between_text_and_table_keeps_them_apart(spark):
    lines = lines_of(spark, [["short text.", "DATA TABLE", ["A"], ["1"]]])
    units = segment_lines(lines).orderBy("unit_no").collect()
    assert [(u["text"], u["section"]) for u in units] == [("short text.", None), ("A\n1", "DATA TABLE")]


def test_block_sections(spark):
    schema = "doc_id string, block_no int, kind string, style string, text string, rows array<array<string>>"
    blocks = spark.createDataFrame([
        ("d", 0, "table", None, None, [["SOP Number", "QA-SOP"]]), ("d", 1, "paragraph", "Heading 1", "Purpose", None),
        ("d", 2, "paragraph", "Normal", " ", None), ("d", 3, "table", None, None, [["Prepared By", "J. Rao"], ["", None]]),
        ("d", 4, "paragraph", "Title", "Scope", None), ("d", 5, "paragraph", "Normal", "Applies to all.", None),
    ], schema)
    units = block_units(blocks).orderBy("unit_no").collect()
    assert [(u["paragraph_start"], u["section"], u["text"]) for u in units] == [
        (0, None, "SOP Number | QA-SOP"), (3, "Purpose", "Prepared By | J. Rao"), (5, "Scope", "Applies to all."),
    ]


def test_slides(spark):
    schema = "doc_id string, slide_no int, shape_no int, is_title boolean, text string, rows array<array<string>>"
    shapes = spark.createDataFrame([
        ("d", 1, 0, True, " Welcome ", None), ("d", 1, 1, False, "Our roadmap.", None), ("d", 2, 0, True, " ", None),
        ("d", 3, 0, False, None, [["a", ""], ["", ""]]),
    ], schema)
    units = slide_units(shapes).orderBy("slide_number").collect()
    assert [(u["slide_number"], u["slide_title"], u["text"]) for u in units] == [(1, "Welcome", "Welcome\nOur roadmap."), (3, None, "a | (blank)")]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_scans_cross_blocks(spark, width):
    rows = [("k" if i % 3 else "m", i, str(i) if i % 7 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, at int, v string")
    carried = {(r["key"], r["at"]): r["out"] for r in carry_forward(df, ["key"], ["at"], F.col("v"), "out", width).collect()}
    numbered = {(r["key"], r["at"]): r["n"] for r in number_rows(df, ["key"], ["at"], "n", width).collect()}
    last, count = {}, {}
    for key, at, value in rows:
        last[key] = value or last.get(key)
        assert carried[key, at] == last[key] and numbered[key, at] == count.get(key, 0)
        count[key] = count.get(key, 0) + 1
    assert len(carried) == len(numbered) == 60


def test_page_forms_agree(spark):
    pages = spark.createDataFrame([("d", 1, "A HEAD LINE\nbody one"), ("d", 300, "body two\nmore")], "doc_id string, page_no int, text string")
    from citewise.operators.segments import page_lines

    direct = segment_pages(text_pages(pages)).collect()
    through_lines = segment_pages(page_rows(page_lines(text_pages(pages)))).collect()
    assert sorted(direct) == sorted(through_lines) and {u["section"] for u in direct} == {"A HEAD LINE"}


@pytest.mark.parametrize("texts", [["word " * 600] * 3000, ["a line of a longer text\n" * 400_000]])
def test_a_worker_gives_chunks_on_in_bounded_parts(texts):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "_source": pa.array(texts)})
    parts = list(_split_batches(["doc_id"], 1200, 200)(iter([batch])))
    assert len(parts) > 5
    assert all(part.nbytes < 3 * PART_BYTES for part in parts)
    found = [row for part in parts for row in part.to_pylist()]
    expected = [(i, n, c.strip(), a, b) for i, t in enumerate(texts) for n, (c, a, b) in enumerate(split_text(t, 1200, 200))]
    assert [(r["doc_id"], r["_piece"], r["text"], r["_start"], r["_end"]) for r in found] == expected
