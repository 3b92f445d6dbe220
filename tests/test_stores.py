"""Stored tables after replacing, removing and compacting; typed sheets; the ingest ledger."""

import os
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citewise.sources import sheet_store as ss
from citewise.sources import stores as st
from citewise.streaming import ingest
from citewise.streaming.ledger import committed, statuses

SMALL = st.Layout(("user_id", "session_id"), ("user_id", "session_id", "doc_id"), ("chunk_id",), places=8, parts=4)
SCHEMA = "user_id string, session_id int, doc_id int, chunk_id int, text string"


def points(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def many(docs, chunks=3, text="x"):
    return [(f"u{s % 3}", s, d, c, f"{text}{d}.{c}") for s in range(6) for d in docs for c in range(chunks)]


def held(spark, path):
    return sorted(tuple(r) for r in st.stored(spark, path).select("user_id", "session_id", "doc_id", "chunk_id", "text").collect())


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_writing_again_changes_no_rows(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = many(range(20))
    for _ in range(2):
        st.replace_units(points(spark, rows + rows[:7]), path, SMALL)
        assert held(spark, path) == sorted(rows)


def test_newest_write_replaces_whole_documents(spark, tmp_path):
    path = str(tmp_path / "points")
    st.replace_units(points(spark, many(range(20))), path, SMALL)
    before = files(path)
    fresh = [("u0", 0, 4, 0, "new"), ("u1", 1, 99, 0, "first"), (None, None, 5, 0, "nobody's")]
    st.replace_units(points(spark, fresh), path, SMALL)
    want = [r for r in many(range(20)) if r[1:3] != (0, 4)] + fresh
    assert sorted(held_any(spark, path), key=str) == sorted(want, key=str)
    after = files(path)
    changed = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert 0 < len(changed) <= 3 and all(before[f] == after[f] for f in set(before) & set(after))
    st.replace_units(points(spark, [(None, None, 5, 0, "again")]), path, SMALL)
    assert [r[4] for r in held_any(spark, path) if r[2] == 5 and r[0] is None] == ["again"]


def held_any(spark, path):
    return [tuple(r) for r in st.stored(spark, path).select("user_id", "session_id", "doc_id", "chunk_id", "text").collect()]


def test_units_without_rows_go(spark, tmp_path):
    path = str(tmp_path / "points")
    st.replace_units(points(spark, many([1])), path, SMALL)
    st.replace_units(points(spark, []), path, SMALL, points(spark, many([1])).filter("session_id < 5"))
    assert held(spark, path) == [r for r in sorted(many([1])) if r[1] == 5]


def test_removed_owners_leave_no_bytes(spark, tmp_path):
    path = str(tmp_path / "points")
    st.replace_units(points(spark, many(range(10), text="secret")), path, SMALL)
    before = files(path)
    gone = spark.createDataFrame([("u1", 1), ("u1", 1), ("u2", 2), ("u1", 2), ("nobody", 9)], "user_id string, session_id int")
    assert st.remove_owners(spark, path, SMALL, gone) > 0
    want = sorted(r for r in many(range(10), text="secret") if (r[0], r[1]) not in {("u1", 1), ("u2", 2)})
    assert held(spark, path) == want
    on_disk = spark.read.parquet(*files(path)).select("user_id", "session_id").distinct().collect()
    assert {tuple(r) for r in on_disk}.isdisjoint({("u1", 1), ("u2", 2)})
    places = {r[0] for r in gone.select(st.bucket(SMALL.owner, SMALL.places)).collect()}
    after = files(path)
    assert all(before[f] == after.get(f) for f in before if not any(f"/place={p}/" in f for p in places))
    assert st.remove_owners(spark, path, SMALL, gone) == 0 and files(path) == after
    everyone = points(spark, many([0])).select("user_id", "session_id")
    st.remove_owners(spark, path, SMALL, everyone)
    assert not files(path)
    assert st.remove_owners(spark, str(tmp_path / "none"), SMALL, gone) == 0


def test_one_owner_is_read_from_one_folder(spark, tmp_path):
    path = str(tmp_path / "points")
    st.replace_units(points(spark, many(range(5))), path, SMALL)
    mine = st.stored(spark, path, SMALL, ("u1", 4))
    assert mine.count() == 15 and len({os.path.dirname(os.path.dirname(f)) for f in mine.inputFiles()}) <= 8
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(place" in plan


def test_compaction_joins_small_files(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = points(spark, many(range(8)))
    for _ in range(3):
        SMALL.placed(rows).repartition(2).write.mode("append").partitionBy(st.PLACE, st.PART).parquet(path)
    before, many_files = sorted(held_any(spark, path)), len(files(path))
    assert st.compact(spark, path, SMALL) > 0
    assert sorted(held_any(spark, path)) == before and len(files(path)) < many_files / 3
    assert st.compact(spark, path, SMALL) == 0


TYPES = ("INTEGER", "TEXT", "NUMERIC", "BOOLEAN", "TIMESTAMP", "INTEGER")


def catalog_of(spark, sheets):
    rows = [(s, i, f"c{i}", kind) for s, kinds in sheets.items() for i, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "sheet_id string, col_idx int, physical_name string, data_type string")


def test_typed_sheets(spark, tmp_path):
    path = str(tmp_path / "sheets")
    catalog = catalog_of(spark, {"a": TYPES, "b": ("NUMERIC", "TEXT"), "none": ("TEXT",)})
    rows = [("a", 0, ["1", "x", "2.5", "true", "2024-01-02 03:04:05", "7"]), ("a", 1, [None, "", "oops", "no date", "never", "100000000000000"]), ("b", 0, ["0.1", "t"]), ("b", 1, ["0.2"])]
    ss.write_sheets(spark.createDataFrame(rows, "sheet_id string, _row_id bigint, values array<string>"), catalog, path)
    columns = ss.stored_columns(catalog)
    slots = {(r["sheet_id"], r["col_idx"]): (r["physical_name"], r["data_type"], r["slot"]) for r in columns.collect()}
    own = ss.sheet_frame(ss.read_sheets(spark, path, "a"), [slots[("a", i)] for i in range(6)]).orderBy("_row_id")
    assert own.dtypes[1:] == [("c0", "bigint"), ("c1", "string"), ("c2", "decimal(18,4)"), ("c3", "boolean"), ("c4", "timestamp_ntz"), ("c5", "bigint")]
    assert [tuple(r) for r in own.collect()] == [
        (0, 1, "x", Decimal("2.5000"), True, datetime(2024, 1, 2, 3, 4, 5), 7), (1, None, "", None, None, None, 100000000000000)
    ]
    totals = {(r["sheet_id"], r["col_idx"]): (r["total"], r["numbers"]) for r in ss.column_totals(ss.read_sheets(spark, path), columns).collect()}
    assert totals == {("a", 0): (1, 1), ("a", 2): (Decimal("2.5"), 1), ("a", 5): (100000000000007, 2), ("b", 0): (Decimal("0.3"), 2)}
    plan = ss.column_totals(ss.read_sheets(spark, path), columns)._jdf.queryExecution().executedPlan().toString()
    assert "texts" not in [part for part in plan.split("ReadSchema") if part.startswith(": struct<sheet_id")][0]
    again = spark.createDataFrame([("a", 0, ["5"])], "sheet_id string, _row_id bigint, values array<string>")
    ss.write_sheets(again, catalog_of(spark, {"a": ("INTEGER",), "b": ("TEXT",)}), path)
    assert [(r["sheet_id"], r["longs"]) for r in ss.read_sheets(spark, path).collect()] == [("a", [5])]


def test_many_sheets_make_few_files(spark, tmp_path):
    path = str(tmp_path / "sheets")
    sheets = spark.range(5000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sheet_id"))
    catalog = sheets.select("sheet_id", F.lit(0).alias("col_idx"), F.lit("n").alias("physical_name"), F.lit("INTEGER").alias("data_type"))
    rows = sheets.select("sheet_id", F.lit(0).cast("bigint").alias("_row_id"), F.array(F.lit("3")).alias("values"))
    ss.write_sheets(rows, catalog, path)
    assert len(files(path)) <= st.SHEET_ROWS.places
    assert ss.column_totals(ss.read_sheets(spark, path), ss.stored_columns(catalog)).agg(F.sum("total")).first()[0] == 15000


@pytest.fixture
def inbox(spark, tmp_path):
    rows = [(i, None if i == 2 else " " if i == 3 else f"text number {i}. " * 5) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for i in range(3):
        docs.filter(F.col("doc_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
    return docs


def run(spark, tmp_path, docs, prepare=lambda df: df):
    where = {n: str(tmp_path / n) for n in ("inbox", "target", "state", "ledger")}
    ingest.ingest_stream(spark, where["inbox"], docs.schema, where["target"], where["state"], prepare, dim=16, files_per_batch=1, ledger=where["ledger"])
    return where


def seen(spark, where):
    return sorted({r["doc_id"] for r in committed(spark.read.parquet(where["target"]), spark, where["ledger"]).collect()})


def test_states_of_documents(spark, tmp_path, inbox):
    where = run(spark, tmp_path, inbox, lambda df: df.withColumn("error", F.when(F.col("doc_id") == 7, "broken " * 1000)))
    got = {r["file_id"]: r for r in statuses(spark, where["ledger"], spark.range(14).select(F.col("id").alias("file_id"))).collect()}
    assert {i for i, r in got.items() if r["status"] == "failed"} == {"2", "3", "7"} and len(got["7"]["error_message"]) == 2000
    assert {i for i, r in got.items() if r["status"] == "pending"} == {"12", "13"} and got["2"]["produced"] == 0
    assert seen(spark, where) == [0, 1, 4, 5, 6, 8, 9, 10, 11]


def test_a_batch_that_dies_before_its_note_is_not_seen(spark, tmp_path, inbox, monkeypatch):
    real, calls = ingest.note, []

    def dying(entries, path, stream_id, batch_id, phase):
        calls.append((batch_id, phase))
        if len(calls) == 4:  # the second batch, its data written
            raise RuntimeError("killed")
        real(entries, path, stream_id, batch_id, phase)

    monkeypatch.setattr(ingest, "note", dying)
    with pytest.raises(PySparkException):
        run(spark, tmp_path, inbox)
    where = {n: str(tmp_path / n) for n in ("target", "ledger")}
    stored = {r["doc_id"] for r in spark.read.parquet(where["target"]).collect()}
    state = {r["file_id"]: r["status"] for r in statuses(spark, where["ledger"]).collect()}
    first = seen(spark, where)
    assert 0 < len(first) < len(stored) and {state[str(i)] for i in stored - set(first)} == {"processing"}
    monkeypatch.setattr(ingest, "note", real)
    where = run(spark, tmp_path, inbox)
    assert seen(spark, where) == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11]
    points = committed(spark.read.parquet(where["target"]), spark, where["ledger"])
    assert points.count() == points.select("chunk_id").distinct().count()


def test_a_failing_batch_does_not_end_the_stream(spark, tmp_path, inbox):
    bad = F.when(F.col("doc_id") == 4, F.raise_error(F.lit("unreadable"))).otherwise(F.col("text"))
    where = run(spark, tmp_path, inbox, lambda df: df.withColumn("text", bad))
    got = {int(r["file_id"]): (r["status"], r["error_message"]) for r in statuses(spark, where["ledger"]).collect()}
    failed = {i for i, (s, _) in got.items() if s == "failed"}
    assert {i for i in failed if i % 3 == 1} == {1, 4, 7, 10} and "unreadable" in got[4][1] and len(got) == 12
    assert seen(spark, where) == [0, 5, 6, 8, 9, 11]
