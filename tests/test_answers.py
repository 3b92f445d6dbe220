import pytest
from pyspark.sql import functions as F

from citewise.functions.questions import NOT_FOUND
from citewise.operators import lifecycle as lc
from citewise.operators import profile, sheets
from citewise.operators.chunking import chunk_documents
from citewise.plans import answers
from citewise.plans.answers import Collections, answer_questions
from citewise.sources import tables as tb
from citewise.sources.files import accepted_files, classify_files, read_text_files, text_units
from citewise.streaming.ingest import ingest_stream

SHEETS = {
    ("s1", "emp"): [["name", "department", "salary"], ["Alice", "IT", "90000"], ["Bob", "HR", "60000"], ["Carol", "IT", "95000"], ["Alice", "Sales", "70000"], ["Erin", "IT", "91000"]],
    ("s2", "sales"): [["Month", "Product", "Revenue"], ["January", "Laptop", "1000"], ["March", "Laptop", "1500"], ["March", "Mouse", "20"], ["March", "Laptop", "2500"]],
}


@pytest.fixture(scope="module")
def data(spark):
    raw = spark.createDataFrame(
        [(f"{s}/{n}", i, row, ["string" if i == 0 or not v.isdigit() else "number" for v in row]) for (s, n), rows in SHEETS.items() for i, row in enumerate(rows)],
        "sheet_id string, row_idx bigint, cells array<string>, cell_types array<string>",
    )
    columns, body = sheets.normalize_sheets(raw)
    catalog = profile.profile_sheets(columns, body, sheets.long_cells(body)).cache()
    listed = spark.createDataFrame(
        [(f"{s}/{n}", s, "u", n, f"xlsx_{n}", f"{n}.csv", 0, len(rows) - 1) for (s, n), rows in SHEETS.items()],
        "sheet_id string, session_id string, user_id string, sheet_name string, table_name string, filename string, sheet_order int, row_count int",
    )
    docs = spark.createDataFrame(
        [("s2", "notes.txt", "General company notes about the laptop sales data."), ("s3", "dogs.txt", "Dogs bark at night."), ("s3", "cats.txt", "Cats sleep all day long.")],
        "session_id string, filename string, text string",
    ).select("*", F.col("filename").alias("doc_id"), F.lit("u").alias("user_id"), F.lit("txt").alias("file_type"))
    files = docs.select(F.col("doc_id").alias("file_id"), "session_id", "file_type", F.lit("ready").alias("status"))
    return Collections(chunk_documents(text_units(docs), single_unit=True), files, listed, catalog, sheets.typed_rows(body, catalog).cache())


CASES = [
    ("s1", "How many unique names are there?", "STRUCTURED", "4", 1),
    ("s1", "What is the total salary across all employees", "STRUCTURED", "406000", 1),
    ("s1", "What is the total salary", "STRUCTURED", "406000", 1),
    ("s1", "What is the average salary where department = 'IT'", "STRUCTURED", "92000", 1),
    ("s1", "What is the weather?", "STRUCTURED", NOT_FOUND, 0),
    ("s1", "What is the average name?", "STRUCTURED", NOT_FOUND, 0),
    ("s2", "Find the laptop sales data and tell me the total revenue in March.", "HYBRID", "4020", 2),
    ("s3", "What do dogs do at night?", "SEMANTIC", "Dogs bark at night.", 1),
    ("s3", "What is the total salary?", "SEMANTIC", NOT_FOUND, 0),
    ("s4", "Anything?", "SEMANTIC", NOT_FOUND, 0),
]


def test_answers(spark, data):
    asked = spark.createDataFrame([(i, q, s, "u") for i, (s, q, *_) in enumerate(CASES)], "question_id int, question string, session_id string, user_id string")
    rows = {r["question_id"]: r for r in answer_questions(asked, data).collect()}
    got = [(rows[i]["question_type"], rows[i]["answer"], len(rows[i]["sources"])) for i in range(len(CASES))]
    want = [(t, a, n) for _, _, t, a, n in CASES]
    assert got == want
    cited = rows[6]["sources"]
    assert [c["type"] for c in cited] == [None, "structured_query"] and cited[1]["row_count"] == 1
    assert cited[1]["sql"] == 'SELECT SUM("revenue") FROM xlsx_sales WHERE "month" = \'March\';'


def test_repeated_questions_are_searched_once(spark, data, monkeypatch):
    """Any number of askers of one session cost one search; everyone gets the answer, whatever the id, also where it is asked elsewhere."""
    seen = []
    search, discover = answers.semantic_evidence, answers.discover_sheets
    monkeypatch.setattr(answers, "semantic_evidence", lambda questions, *a, **k: seen.append(questions.count()) or search(questions, *a, **k))
    monkeypatch.setattr(answers, "discover_sheets", lambda questions, *a, **k: seen.append(questions.count()) or discover(questions, *a, **k))
    asked = [(100 * n + i, q, s, "u") for n in range(5) for i, (s, q, *_) in enumerate(CASES)]
    asked += [(900, None, CASES[0][0], "u"), (901, None, CASES[0][0], "u")]
    shape = "question_id int, question string, session_id string, user_id string"
    rows = {r["question_id"]: r for r in answer_questions(spark.createDataFrame(asked, shape), data).collect()}
    assert len(rows) == len(asked)
    for n in range(5):
        got = [rows[100 * n + i] for i in range(len(CASES))]
        assert [(r["question_type"], r["answer"], len(r["sources"])) for r in got] == [(t, a, k) for _, _, t, a, k in CASES]
        assert [r["context"] for r in got] == [rows[i]["context"] for i in range(len(CASES))]
    types = [t for _, _, t, _, _ in CASES]
    assert seen[0] <= 1 + sum(t != "STRUCTURED" for t in types) and seen[1] == types.count("HYBRID")


def test_foreign_user_gets_nothing(spark, data):
    asked = spark.createDataFrame([(1, "What do dogs do at night?", "s3", "intruder")], "question_id int, question string, session_id string, user_id string")
    assert answer_questions(asked, data).first()["answer"] == NOT_FOUND


def test_file_rules(spark):
    rows = [("a.PDF", 10), ("b.csv", 51 * 1024 * 1024), ("c.exe", 1), ("noext", 1), (".txt", 1), ("dir.x/name", 1), ("x.tar.docx", 1)]
    df = spark.createDataFrame(rows, "filename string, size_bytes long")
    got = {r["filename"]: (r["file_type"], r["category"], r["rejection"]) for r in classify_files(df).collect()}
    assert got["a.PDF"] == ("pdf", "document", None) and got["b.csv"] == ("csv", "sheet", "too_large") and got["x.tar.docx"][0] == "docx"
    assert all(got[n] == ("" if n != "c.exe" else "exe", None, "unsupported_type") for n in ("c.exe", "noext", ".txt", "dir.x/name"))
    assert accepted_files(df).count() == 2


def test_ingest_status(spark):
    files = spark.createDataFrame([(1, "document"), (2, "document"), (3, "sheet"), (4, "sheet")], "file_id int, category string")
    produced = spark.createDataFrame([(1, 3), (2, 0), (4, 5)], "file_id int, produced int")
    errors = spark.createDataFrame([(4, "x" * 3000)], "file_id int, error string")
    got = {r["file_id"]: r for r in tb.ingest_status(files, produced, errors).collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["ready", "failed", "failed", "failed"]
    assert "holds no text" in got[2]["error_message"] and "no rows of values" in got[3]["error_message"] and len(got[4]["error_message"]) == 2000


def test_sessions_and_purge(spark):
    sessions = spark.createDataFrame([("s1", "u1", 1), ("s2", "u1", 2), ("s3", "u2", 3)], "session_id string, user_id string, created_at int")
    files = spark.createDataFrame([("s1", 1), ("s1", 2), ("s3", 3)], "session_id string, file_id int")
    assert [r["session_id"] for r in lc.newest_sessions(sessions, "u1").collect()] == ["s2", "s1"]
    counts = {r["session_id"]: (r["files"], r["messages"]) for r in lc.session_rollup(sessions, files, files.limit(0), files.filter("file_id = 3")).collect()}
    assert counts == {"s1": (2, 0), "s2": (0, 0), "s3": (1, 1)}
    requests = spark.createDataFrame([("u1", "s1"), ("u1", "s3"), ("u1", "unknown")], "user_id string, session_id string")
    left = lc.purge_sessions({"files": files}, sessions, requests)
    assert sorted(r["session_id"] for r in left["sessions"].collect()) == ["s2", "s3"] and [r["file_id"] for r in left["files"].collect()] == [3]
    again = lc.purge_sessions({"files": left["files"]}, left["sessions"], requests)
    assert again["files"].count() == 1 and again["sessions"].count() == 2
    users = lc.get_or_create_users(spark.createDataFrame([("u1",)], "user_id string"), "w", spark.createDataFrame([(" u1 ",), ("new\t",), ("new",), (" ",)], "w string"))
    assert sorted(r["user_id"] for r in users.collect()) == ["new", "u1"]


def test_point_table_layout(spark, tmp_path):
    from citewise.operators.search import embed

    docs = spark.createDataFrame([("u", "s1", "a", "alpha beta"), ("u", "s2", "b", "gamma")], "user_id string, session_id string, chunk_id string, text string")
    path = str(tmp_path / "points")
    tb.write_points(tb.as_points(embed(docs, dim=16), dim=16), path)
    stored = spark.read.parquet(path)
    mine = lc.tenant_filter(stored, "u", "s1", "document_chunk")
    assert [r["chunk_id"] for r in mine.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(user_id" in mine._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "vector" not in lc.scroll_points(stored).columns
    assert {r["content_type"]: r["points"] for r in lc.point_stats(stored).collect()} == {"all": 2, "document_chunk": 2, "excel_sheet": 0}


def test_stream_equals_batch(spark, tmp_path):
    inbox, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs = spark.createDataFrame([(i, f"text number {i} " * 200) for i in range(6)], "doc_id long, text string")
    docs.filter("doc_id < 3").write.parquet(inbox)
    run = lambda: ingest_stream(spark, inbox, docs.schema, target, state, lambda df: df, dim=16)
    run()
    first = spark.read.parquet(target).count()
    docs.filter("doc_id >= 3").write.mode("append").parquet(inbox)
    run()
    run()
    stored = spark.read.parquet(target)
    batch = chunk_documents(text_units(docs), single_unit=True)
    assert 0 < first < stored.count()
    assert sorted(r["chunk_id"] for r in stored.collect()) == sorted(r["chunk_id"] for r in batch.collect())


def test_stream_with_a_new_checkpoint_overwrites_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(8)], "doc_id long, text string")
    for name, part in (("a", "doc_id < 4"), ("b", "doc_id >= 4")):
        docs.filter(part).repartition(4, "doc_id").write.parquet(str(tmp_path / name))
        ingest_stream(spark, str(tmp_path / name), docs.schema, target, str(tmp_path / f"state-{name}"), lambda df: df, dim=16, files_per_batch=1)
    stored = spark.read.parquet(target)
    assert sorted(r["doc_id"] for r in stored.collect()) == list(range(8))
    assert stored.select("stream_id").distinct().count() == 2 and stored.select("batch_id").distinct().count() > 1


def test_point_writes_hold_few_files(spark, tmp_path):
    points = spark.range(0, 4000, numPartitions=16).select(
        F.lit("u").alias("user_id"), (F.col("id") % 20).cast("string").alias("session_id"), F.col("id").alias("chunk_id")
    )
    tb.write_points(points, str(tmp_path / "points"))
    assert len(list((tmp_path / "points").rglob("*.parquet"))) == 20
    assert spark.read.parquet(str(tmp_path / "points")).count() == 4000


def test_scope_names_sheets_or_takes_the_session(spark):
    questions = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, "s")], "question_id int, session_id string")
    sheets = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c")], "session_id string, sheet_id string")
    found = spark.createDataFrame([(1, "a"), (1, "a"), (3, "a"), (4, "zz")], "question_id int, sheet_id string")
    got = sorted((r["question_id"], r["sheet_id"]) for r in lc.sheets_in_scope(questions, sheets, found).collect())
    assert got == [(1, "a"), (2, "a"), (2, "b")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xff\nline two\nline three")
    (tmp_path / "blank.txt").write_text(" \n ")
    rows = chunk_documents(read_text_files(spark, str(tmp_path)), single_unit=True).collect()
    assert [(r["filename"], r["line_start"], r["line_end"]) for r in rows] == [("a.txt", 1, 3)] and "�" in rows[0]["text"]


def test_named_subquery_cannot_hide_a_table(spark):
    from citewise.operators.scoped_sql import ScopedQueryError, checked_tables

    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("outside_people")
    hidden = "SELECT u.x FROM (WITH outside_people AS (SELECT 1 AS y) SELECT y FROM outside_people) t CROSS JOIN outside_people u"
    earlier = "WITH a AS (SELECT x FROM outside_people), outside_people AS (SELECT 1 AS x) SELECT x FROM a"
    for text in (hidden, earlier):
        with pytest.raises(ScopedQueryError):
            checked_tables(spark, text, set())
    assert checked_tables(spark, "WITH own AS (SELECT x FROM t_sheet) SELECT x FROM own", {"t_sheet"}) == ["t_sheet"]
    spark.catalog.dropTempView("outside_people")


def test_long_integers_are_summed_whole(spark):
    from pyspark.sql import functions as F

    from citewise.operators.intents import NO_FILTER, filtered_sums

    rows = spark.createDataFrame([("s", ["100000000000000"]), ("s", ["5"]), ("s", ["7"])], "sheet_id string, values array<string>")
    needed = spark.createDataFrame([("s", NO_FILTER, "", 0)], "sheet_id string, filter_idx int, filter_text string, target_idx int")
    got = filtered_sums(rows, needed).select(F.col("total").cast("bigint"), "numbers").first()
    assert tuple(got) == (100000000000012, 3)


def test_a_batch_of_one_file_is_worked_on_by_all_cores(spark, tmp_path):
    documents = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    documents.coalesce(1).write.parquet(str(tmp_path / "in"))
    dealt = []
    ingest_stream(spark, str(tmp_path / "in"), documents.schema, str(tmp_path / "out"), str(tmp_path / "state"), lambda df: dealt.append(df.rdd.getNumPartitions()) or df, dim=4)
    assert dealt == [spark.sparkContext.defaultParallelism]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
