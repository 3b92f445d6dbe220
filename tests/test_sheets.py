import pytest
from pyspark.sql import functions as F

from citewise.operators import profile, sheets
from citewise.operators.results import render_result
from citewise.operators.scoped_sql import ScopedQueryError, checked_tables, query_audit, scoped_sql
from citewise.sources.files import read_csv_grids

RAW = "sheet_id string, row_idx bigint, cells array<string>, cell_types array<string>"
S, N, B, D = "string", "number", "bool", "date"


def grid(spark, sheet_id, rows):
    """Rows of (cells, types) or of cells alone (all text)."""
    out = []
    for i, row in enumerate(rows):
        cells, types = row if isinstance(row, tuple) else (row, [S] * len(row))
        out.append((sheet_id, i, cells, types))
    return spark.createDataFrame(out, RAW)


def catalog_of(raw):
    columns, body = sheets.normalize_sheets(raw)
    catalog = profile.profile_sheets(columns, body, sheets.long_cells(body))
    return {r["column_name"]: r for r in catalog.collect()}, body, catalog


MESSY = [
    ["Harbour throughput, spring half - internal", None, None, None], [None] * 4, ["Region", "Product", "CratesMoved", "Revenue"],
    (["Northern quay", "HX-20B", "4300", "198300"], [S, S, N, N]), (["Old dock", "HX-20B", "5200", "251450"], [S, S, N, N]),
    (["East pier", "LM-7Q", "950", "47085"], [S, S, N, N]), [None] * 4, ["Remark: counts may still change", None, None, None],
]


def test_messy_report(spark):
    raw = grid(spark, "m", MESSY)
    columns, body, catalog = catalog_of(raw)
    assert set(columns) == {"Region", "Product", "CratesMoved", "Revenue"}
    assert columns["Revenue"]["is_numeric"] and columns["CratesMoved"]["data_type"] == "INTEGER" and columns["Region"]["is_text"]
    rows = sheets.typed_rows(body, catalog).orderBy("_row_id").collect()
    assert [r["_row_id"] for r in rows] == [0, 1, 2]
    table = sheets.sheet_table(sheets.typed_rows(body, catalog), "m", [(3, "revenue", "INTEGER"), (0, "region", "TEXT")])
    assert table.agg(F.sum("revenue")).first()[0] == 496835


def test_employee_types(spark):
    rows = [["Name", "Age", "Department", "Salary"]] + [
        ([n, a, d, s], [S, N, S, N])
        for n, a, d, s in (("Alice", "30", "IT", "90000.5"), ("Bob", "25", "HR", "60000.25"), ("Carol", "35", "IT", "95000.75"), ("Dave", "40", "Sales", "70000.1"), ("Erin", "28", "IT", "88000.4"))
    ]
    columns, _, _ = catalog_of(grid(spark, "e", rows))
    assert {n: c["data_type"] for n, c in columns.items()} == {"Name": "TEXT", "Age": "INTEGER", "Department": "TEXT", "Salary": "NUMERIC"}
    assert columns["Department"]["is_categorical"] and columns["Name"]["row_count"] == 5
    assert columns["Department"]["description"] == "Department: categorical text column with 3 distinct values (e.g. IT, HR, Sales)."
    assert columns["Salary"]["description"] == "Salary: NUMERIC column, range 60000.25-95000.75."
    assert columns["Age"]["description"] == "Age: INTEGER column, range 25-40."


def test_dates_months_bools_and_gaps(spark):
    rows = [["OrderDate", "Month", "Amount", "Gap", "Code", "Flag", "Text flag", "Big"]] + [
        ([d, m, a, g, c, f, t, b], [S, S, S, S, S, B, S, S])
        for d, m, a, g, c, f, t, b in (
            ("2024-01-05", "January", "100", "1", "007", "true", "True", "9007199254740993"), ("2024-02-14", "March", "200", None, "008", "false", "False", "1"), ("2024-03-01", "March", "150", "3", "009", "true", "True", "2"),
        )
    ]
    columns, body, catalog = catalog_of(grid(spark, "d", rows))
    kinds = {n: c["data_type"] for n, c in columns.items()}
    assert kinds == {"OrderDate": "TIMESTAMP", "Month": "TEXT", "Amount": "INTEGER", "Gap": "NUMERIC", "Code": "INTEGER", "Flag": "BOOLEAN", "Text flag": "TEXT", "Big": "INTEGER"}
    assert columns["OrderDate"]["is_date"] and columns["OrderDate"]["description"].endswith("range 2024-01-05 00:00:00 to 2024-03-01 00:00:00.")
    assert columns["Gap"]["description"] == "Gap: NUMERIC column, range 1.0-3.0."
    assert columns["Big"]["description"] == "Big: INTEGER column, range 1-9007199254740993."
    first = sheets.typed_rows(body, catalog).orderBy("_row_id").first()["values"]
    assert first[:2] == ["2024-01-05 00:00:00", "January"] and first[3] == "1.0000"


@pytest.mark.parametrize(
    ("rows", "header"),
    [
        ([["a", "b"], ["c", "d"]], 0),
        ([["title", None, None], ["a", "b", "c"], (["1", "2", "3"], [N, N, N])], 1),
        ([["a", None, "c"], ["d", "e", "f"], ["g", "h", "i"]], 1),
        ([(["1", "2"], [N, N]), (["3", "4"], [N, N])], 0),
        ([[None, None]] * 16 + [["late", "header"], ["x", "y"]], 0),
        ([["a", "b", "c", "d"], ["lone", None, None, None], ["e", "f", "g", None]], 0),
    ],
)
def test_header_detection(spark, rows, header):
    assert sheets.detect_headers(grid(spark, "h", rows)).first()["header_row"] == header


def test_middle_rows_stay_and_single_column_ends_empty(spark):
    rows = [["a", "b"], ["1", "2"], ["note", None], ["3", "4"], ["foot", None], [None, None]]
    _, body = sheets.normalize_sheets(grid(spark, "x", rows))
    assert [r["row_idx"] for r in body.orderBy("row_idx").collect()] == [1, 2, 3]
    _, body = sheets.normalize_sheets(grid(spark, "y", [["a"], ["1"], ["2"]]))
    assert body.count() == 0


def test_unnamed_and_repeated_headers(spark):
    raw = grid(spark, "z", [["Total", None, "Total", "empty"], (["1", "2", "3", None], [N, N, N, S]), (["4", "5", "6", None], [N, N, N, S])])
    columns, body = sheets.normalize_sheets(raw)
    catalog = profile.profile_sheets(columns, body, sheets.long_cells(body)).orderBy("col_idx").collect()
    assert [(c["column_name"], c["physical_name"]) for c in catalog] == [("Total", "total"), ("column_1", "column_1"), ("Total", "total_2")]


def test_catalog_texts(spark):
    _, _, catalog = catalog_of(grid(spark, "m", MESSY))
    listed = spark.createDataFrame([("m", "Sales", "xlsx_sales", "r.xlsx", 0, "s")], "sheet_id string, sheet_name string, table_name string, filename string, sheet_order int, session_id string")
    text = profile.schema_texts(catalog, listed).first()["schema_text"]
    assert text.splitlines()[:2] == ["-- Sheet: Sales (from r.xlsx)", "xlsx_sales("]
    assert '  "cratesmoved" INTEGER  -- "CratesMoved",' in text.splitlines()
    assert '  "product" TEXT  -- "Product" | Product: categorical text column with 2 distinct values (e.g. HX-20B, LM-7Q).,' in text.splitlines()
    summary = profile.sheet_summaries(catalog, listed).first()["text"]
    assert summary.startswith("File: r.xlsx\nSheet: Sales\nRows: 3\nColumns:\n- Region (TEXT): Region: categorical")
    scope = profile.session_schema(profile.schema_texts(catalog, listed), listed).first()
    assert scope["schema_description"] == text and scope["allowed_tables"] == ["xlsx_sales"]


def test_csv_grid(spark, tmp_path):
    (tmp_path / "sales.csv").write_text('Product,"Re, venue"\nLaptop,1200.5\n\nMouse,NA\nKeyboard,45.0,extra\n')
    rows = read_csv_grids(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == [0, 1, 2, 3] and {r["sheet_name"] for r in rows} == {"sales"}
    assert [r["cells"] for r in rows] == [["Product", "Re, venue", None], ["Laptop", "1200.5", None], ["Mouse", None, None], ["Keyboard", "45.0", "extra"]]


def test_large_csv_is_numbered_across_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f"{i},x{i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        grid_rows = read_csv_grids(spark, str(tmp_path), multi_line=False)
        assert grid_rows.filter(F.col("row_idx").cast("string") != F.col("cells")[0]).count() == 0
        assert grid_rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wide_csv_and_quoted_line_breaks(spark, tmp_path):
    wide = ",".join(f"v{i}" for i in range(300))
    (tmp_path / "wide.csv").write_text(f'id,"two\nlines, one ""cell"""\n{wide}\n"a,b,c",d\n')
    rows = read_csv_grids(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [[c for c in r["cells"] if c is not None] for r in rows] == [["id", 'two\nlines, one "cell"'], wide.split(","), ["a,b,c", "d"]]
    assert [r["row_idx"] for r in rows] == [0, 1, 2] and {len(r["cells"]) for r in rows} == {300}


EMPLOYEES = [("Alice", "IT", 90000), ("Bob", "HR", 60000), ("Carol", "IT", 95000), ("Alice", "Sales", 70000), ("Erin", "IT", 91000)]


@pytest.fixture
def views(spark):
    return {"xlsx_emp": spark.createDataFrame(EMPLOYEES, "name string, department string, salary long")}


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ('SELECT COUNT(DISTINCT "name") FROM xlsx_emp', 4), ('SELECT SUM("salary") FROM xlsx_emp;', 406000),
        ('SELECT AVG("salary") FROM xlsx_emp WHERE "department" = \'IT\'', 92000), ("WITH t AS (SELECT * FROM xlsx_emp) SELECT COUNT(*) FROM t", 5),
        ("SELECT COUNT(*) FROM (SELECT 1 AS x UNION ALL SELECT 2 UNION ALL SELECT name FROM xlsx_emp) d", 7),
        ("SELECT DISTINCT 1 FROM xlsx_emp ORDER BY 1 LIMIT 3", 1),
    ],
)
def test_scoped_sql_answers(spark, views, sql, expected):
    rows = scoped_sql(spark, sql, views).collect()
    assert len(rows) == 1 and rows[0][0] == expected


def test_scoped_sql_caps_rows(spark, views):
    assert scoped_sql(spark, "SELECT name FROM xlsx_emp LIMIT 999999", views, 2).count() == 2
    assert scoped_sql(spark, "SELECT name FROM xlsx_emp LIMIT 1", views, 2).count() == 1
    assert scoped_sql(spark, 'SELECT "department", SUM("salary") AS total FROM xlsx_emp GROUP BY "department"', views).count() == 3


HOSTILE = [
    "", "NO_QUERY", " ; ", "DROP TABLE xlsx_emp", "DELETE FROM xlsx_emp", "UPDATE xlsx_emp SET salary = 0", "INSERT INTO xlsx_emp VALUES ('x')",
    "TRUNCATE TABLE xlsx_emp", "ALTER TABLE xlsx_emp ADD COLUMN hacked STRING", "CREATE TABLE evil (id INT)",
    "SELECT * FROM xlsx_emp; DROP TABLE xlsx_emp;", "SELECT 1; SELECT 2;", "GRANT ALL ON xlsx_emp TO public", "SELECT name FROM xlsx_emp UNION SELECT 'x'",
    "SELECT name FROM xlsx_emp EXCEPT SELECT 'x'", "SELECT * FROM users", "SELECT name FROM xlsx_emp WHERE name IN (SELECT user_id FROM users)",
    "SELECT (SELECT MAX(x) FROM users) FROM xlsx_emp", "SELECT * FROM other.xlsx_emp", "SELECT * FROM parquet.`/tmp/x`", "TABLE xlsx_emp", "SHOW TABLES",
    "SET a = b", "DESCRIBE xlsx_emp", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT reflect('java.lang.System', 'exit', 1) FROM xlsx_emp",
    "WITH t AS (SELECT * FROM users) SELECT * FROM t", "SELECT * FROM xlsx_emp, range(5)", "not sql at all", "EXPLAIN SELECT 1",
]


@pytest.mark.parametrize("sql", HOSTILE)
def test_scoped_sql_rejects(spark, views, sql):
    with pytest.raises(ScopedQueryError):
        checked_tables(spark, sql, set(views))


def test_audit_verdicts(spark):
    cases = {
        "DROP TABLE t": "not_select", "SELECT 1; DROP TABLE t": "stacked", "SELECT 'a;b' FROM t": "ok", "": "empty", "no_query": "empty",
        "SELECT * FROM t LIMIT 9999": "capped", "SELECT * FROM t, u": "out_of_scope", "SELECT * FROM t a, u b": "out_of_scope", "SELECT * FROM t JOIN u ON 1=1": "out_of_scope",
        "SELECT * FROM t WHERE x IN (SELECT y FROM u)": "out_of_scope", "WITH c AS (SELECT 1 FROM t) SELECT * FROM c": "ok",
        "SELECT x FROM t UNION SELECT y FROM t": "not_select", "SELECT * FROM (SELECT 1 UNION SELECT 2) d": "ok", "SELECT * FROM \"t\"": "ok",
        "SELECT delete FROM t": "forbidden", "SELECT a -- drop\n FROM t": "ok", "GRANT ALL ON t TO public": "not_select",
    }
    log = spark.createDataFrame([(i, s, ["t"]) for i, s in enumerate(cases)], "query_id int, sql string, allowed array<string>")
    got = {r["sql"]: r["verdict"] for r in query_audit(log).collect()}
    assert got == cases


def test_rendered_results(spark, views):
    context = lambda df, sql="SELECT": render_result(df, sql).first()["context"]
    assert context(views["xlsx_emp"].agg(F.sum("salary"))) == "Query executed: SELECT\n\nDatabase result: 406000"
    assert context(views["xlsx_emp"].filter("false")) == "Query executed: SELECT\n\nDatabase result: (no rows)"
    many = spark.range(25).select(F.col("id").alias("n"))
    row = render_result(many, "Q", ["n"]).first()
    assert row["row_count"] == 25 and row["context"].endswith("\n18\n19 (+5 more rows)") and "Database result:\nn\n0\n1" in row["context"]
    average = views["xlsx_emp"].agg(F.avg(F.lit("0.18076923076923076923").cast("decimal(30,20)")).alias("avg"))
    assert context(average).endswith("Database result: 0.1808")
