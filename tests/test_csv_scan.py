"""CSV records over many splits against a plain reader of whole files."""

import csv
import io
import random

import pytest

from citewise.sources.csv_scan import csv_records
from citewise.sources.files import read_csv_grids


def whole_file(text):
    """Records of a text, one character after the other: rows of cells, blank lines left out."""
    rows, cells, cell, state, seen, i = [], [], "", "start", False, 0
    text = text.removeprefix("﻿")

    def close():
        nonlocal cells, cell, state, seen
        if seen and (cells or cell.strip(" \t") or quoted):
            rows.append([*cells, cell])
        cells, cell, state, seen = [], "", "start", False

    quoted = False
    while i < len(text):
        c = text[i]
        i += 1
        if state != "quoted" and c in "\r\n":
            if c == "\r" and text[i : i + 1] == "\n":
                i += 1
            close()
            quoted = False
            continue
        seen = True
        if state == "quoted":
            if c == '"':
                state = "closed"
            else:
                cell += c
        elif c == '"' and state == "start":
            state, quoted = "quoted", True
        elif c == '"' and state == "closed":
            cell, state = cell + '"', "quoted"
        elif c == ",":
            cells.append(cell)
            cell, state = "", "start"
        else:
            cell, state = cell + c, "cell"
    if state == "quoted" and not text.endswith(("\n", "\r")):
        cell += "\n"  # a line scan cannot tell whether the last line had an ending
    close()
    return rows


def some_text(seed):
    rng = random.Random(seed)
    kind = rng.choice(["plain", "open", "wild"])
    out = []
    for _ in range(rng.randint(1, 60)):
        for _ in range(rng.randint(1, 5)):
            if kind == "wild":
                out.append("".join(rng.choice(['"', "a", "b", " ", ",", '""', "\n", "\r\n", "\r", "é", "\t"]) for _ in range(rng.randint(0, 8))))
            else:
                inner = "".join(rng.choice(['""', "x", " ", ",", "\n", "\r\n", "y" * 30, "'"]) for _ in range(rng.randint(0, 12)))
                out.append(rng.choice([f'"{inner}"', '5" pipe', "w", "", f'"{inner}"z', 'u 7" v']))
            out.append(",")
        out[-1] = rng.choice(["\n", "\n", "\r\n", "\r", "\n\n", "\n  \n"])
    if kind == "open":
        out.append('last,"never closed\nand on\n')
    return rng.choice(["", "﻿"]) + "".join(out)


@pytest.fixture(params=[48, 700, 1 << 27])
def split_bytes(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_random_files(spark, tmp_path, split_bytes):
    texts = {f"f{i}": some_text(i) for i in range(24)}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    got = {}
    for r in read_csv_grids(spark, str(tmp_path)).collect():
        got.setdefault(r["sheet_name"], {})[r["row_idx"]] = r["cells"]
    for name, text in texts.items():
        want = [[None if c in ("", "NA") else c for c in row] for row in whole_file(text)]
        width = max([i + 1 for row in want for i, c in enumerate(row) if c is not None], default=0)
        want = [(row + [None] * width)[:width] for row in want]
        assert [got.get(name, {}).get(i) for i in range(len(want))] == want, name
        assert len(got.get(name, {})) == len(want), name


def test_same_as_the_csv_module(spark, tmp_path):
    """On files without blank lines or open quotes the records are those of Python's own reader."""
    rng = random.Random(4)
    rows = [[rng.choice(["a", "b,c", 'say "x"', "two\nlines", "cr\r\nlf", "", 'mid"dle', "ü" * 40]) for _ in range(4)] for _ in range(200)]
    held = io.StringIO(newline="")
    csv.writer(held).writerows(rows)
    text = held.getvalue() + 'u,5" pipe,x,y\r\n"z"tail,"",q,r\r\n'
    (tmp_path / "own.csv").write_bytes(text.encode())
    want = [[None if c == "" else c for c in row] for row in csv.reader(io.StringIO(text, newline=""))]
    got = sorted((r["row_idx"], r["cells"]) for r in read_csv_grids(spark, str(tmp_path)).collect())
    assert [c for _, c in got] == want


def test_stray_quotes_keep_all_columns(spark, tmp_path):
    (tmp_path / "pipe.csv").write_text('a,b\n5" pipe,x\nr,s,t,u 7" w\n')
    rows = read_csv_grids(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r["cells"] for r in rows] == [["a", "b", None, None], ['5" pipe', "x", None, None], ["r", "s", "t", 'u 7" w']]


def test_a_large_quoted_file_is_read_in_many_splits(spark, tmp_path):
    body = "".join(f'{i},"line {i}\nmore, of ""it""\r\n\n end {i}",z\n' for i in range(5000))
    (tmp_path / "big.csv").write_bytes(body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = sorted((r["row_idx"], tuple(r["cells"])) for r in read_csv_grids(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, (str(i), f'line {i}\nmore, of "it"\r\n\n end {i}', "z")) for i in range(5000)]


def test_empty_files_and_single_lines(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n\t\n")
    assert csv_records(spark, str(tmp_path)).count() == 0
    (tmp_path / "one.csv").write_text('a,"b')
    assert [(r["row_idx"], r["record"]) for r in csv_records(spark, str(tmp_path)).collect()] == [(0, 'a,"b\n')]
    assert [r["cells"] for r in read_csv_grids(spark, str(tmp_path), multi_line=False).collect()] == [["a", "b"]]
