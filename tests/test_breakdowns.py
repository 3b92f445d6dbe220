"""Questions about spans of time and breakdowns, against answers worked out row by row."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from citewise.functions.breakdowns import date_range, grouping, without_dates
from citewise.operators.breakdowns import grouped_answers, ranged_answers

SPANS = {
    "What was the total revenue in March 2024?": ("2024-03-01", "2024-04-01"), "revenue in december, 2023": ("2023-12-01", "2024-01-01"),
    "average value in Q4 2023": ("2023-10-01", "2024-01-01"), "the second quarter of 2024": ("2024-04-01", "2024-07-01"),
    "between 2024-01-05 and 2024-02-29": ("2024-01-05", "2024-03-01"), "from 2024-02-28 to 2024-02-28": ("2024-02-28", "2024-02-29"),
    "since 2024-05-01": ("2024-05-01", "9999-12-31"), "before 2024-05-01?": ("0001-01-01", "2024-05-01"), "on 2024-02-29": ("2024-02-29", "2024-03-01"),
    "total in 2022": ("2022-01-01", "2023-01-01"), "during the year 1999": ("1999-01-01", "2000-01-01"), "on 2024-02-30": None, "how many rows?": None, "total of item 2024": None,
    None: None,
}


def test_spans(spark):
    rows = spark.createDataFrame([(q,) for q in SPANS], "q string").select("q", date_range(F.col("q")).alias("r")).collect()
    got = {r["q"]: None if r["r"] is None else (str(r["r"]["start"]), str(r["r"]["end"])) for r in rows}
    assert got == SPANS


def test_questions_without_dates(one):
    assert one(without_dates(F.lit("What was the total revenue in March 2024?"))) == "What was the total revenue ?"
    assert one(without_dates(F.lit("Total price between 2024-01-05 and 2024-02-01 where status = Open"))) == "Total price where status = Open"


COLUMNS = ["region", "sales_rep", "amount"]


@pytest.mark.parametrize(("question", "want"), [
    ("How many orders by region?", ("COUNT", None, ["region"])), ("total amount broken down by sales rep and region", ("SUM", "amount", ["sales_rep", "region"])),
    ("What is the average amount per Region", ("AVG", "amount", ["region"])), ("count for each sales rep, region.", ("COUNT", None, ["sales_rep", "region"])),
    ("total by colour", None), ("total amount", None), ("list them by region", None), ("sum of things by region", None), (None, None),
])
def test_groupings(one, question, want):
    got = one(grouping(F.lit(question).cast("string"), F.array(*[F.lit(c) for c in COLUMNS])))
    assert (got and (got["aggregate"], got["column"], got["keys"])) == want


NAMES = {"a": ["ordered", "status", "amount", "note"], "b": ["label", "qty"]}
KINDS = {"a": ["TIMESTAMP", "TEXT", "NUMERIC", "TEXT"], "b": ["TEXT", "INTEGER"]}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        day = date(2023, 1, 1) + timedelta(days=rng.randrange(800))
        when = rng.choice([f"{day} 00:00:00", f"{day} 23:59:59", f"{day} 12:30:00", None])
        rows.append(("a", i, [when, rng.choice(["Open", "OPEN", "done", None]), rng.choice([f"{rng.randint(-500, 900)}.{rng.randint(0, 9999):04d}", None]), rng.choice(["x", "y"])]))
    rows += [("b", i, [rng.choice(["k", "m", None]), str(rng.choice([2, 10, 1]))]) for i in range(90)]
    catalog = [(s, i, n, k, "status: categorical text column with 3 distinct values (e.g. OPEN, done)." if n == "status" else "") for s in NAMES for i, (n, k) in enumerate(zip(NAMES[s], KINDS[s]))]
    listed = [(s, s, f"xlsx_{s}", 0) for s in NAMES]
    return (
        rows, spark.createDataFrame(listed, "sheet_id string, session_id string, table_name string, sheet_order int"),
        spark.createDataFrame(catalog, "sheet_id string, col_idx int, physical_name string, data_type string, description string"),
        spark.createDataFrame(rows, "sheet_id string, _row_id bigint, values array<string>").repartition(3),
    )


def shown(value):
    if value is None:
        return "None"
    text = f"{value.quantize(Decimal('0.0001'), ROUND_HALF_UP)}".rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


def test_many_ranges(spark, tables):
    rows, listed, catalog, stored = tables
    asked, want = [], {}
    rng = random.Random(6)
    for q in range(300):
        start = date(2022, 12, 1) + timedelta(days=rng.randrange(900))
        stop = start + timedelta(days=rng.randrange(0, 400))
        kind, status = rng.choice(["total", "average", "How many rows"]), rng.choice([None, "OPEN", "open", "Done", "gone"])
        status = None if kind.startswith("How") else status
        where = f" where status = {status}" if status else ""
        asked.append((q, f"{kind} amount between {start} and {stop}{where}" if kind != "How many rows" else f"How many rows between {start} and {stop}?", "a"))
        exact = status in ("OPEN", "done")
        mine = [r[2] for r in rows if r[0] == "a" and r[2][0] and start <= date.fromisoformat(r[2][0][:10]) <= stop]
        mine = [v for v in mine if status is None or v[1] is not None and (v[1] == status if exact else v[1].lower() == status.lower())]
        numbers = [Decimal(v[2]) for v in mine if v[2] is not None]
        if kind.startswith("How"):
            want[q] = str(len(mine))
        else:
            want[q] = shown(sum(numbers) if kind == "total" else sum(numbers) / len(numbers)) if numbers else "None"
    asked += [(900, "total amount in march 2024", "b"), (901, "total amount", "a"), (902, "total note in 2023", "a"), (903, "total amount in march 2024", "nobody"), (904, "total amount between 2024-02-01 and 2024-01-01", "a")]
    got = {r["question_id"]: r for r in ranged_answers(spark.createDataFrame(asked, "question_id int, question string, session_id string"), listed, catalog, stored).collect()}
    assert {q: r["value"] for q, r in got.items() if q < 300} == want
    assert set(got) - set(want) == {900, 902, 904} and got[900]["problem"] == "no date column" and got[902]["problem"] == "not a number" and got[904]["value"] == "None"
    one = got[next(q for q, (_, text, _) in enumerate(asked) if text.startswith("total") and "open" in text)]
    assert one["context"].startswith("Query executed: SELECT SUM(\"amount\") FROM xlsx_a WHERE \"ordered\" >= '") and "LOWER(\"status\") = LOWER('open')" in one["sql"]


def test_ranges_meet_no_rows(spark, tables):
    """The plan has no join but those on equal keys, however many ranges are asked."""
    _, listed, catalog, stored = tables
    asked = spark.range(50).select(F.col("id").alias("question_id"), F.lit("total amount in 2024").alias("question"), F.lit("a").alias("session_id"))
    plan = ranged_answers(asked, listed, catalog, stored)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_groups(spark, tables):
    rows, listed, catalog, stored = tables
    asked = [(1, "How many rows by status?", "a"), (2, "total amount by note and status", "a"), (3, "average qty per label", "b"), (4, "number of rows by qty", "b"), (5, "sum of note by status", "a"), (6, "How many by status", "a")]
    got = {r["question_id"]: r for r in grouped_answers(spark.createDataFrame(asked, "question_id int, question string, session_id string"), listed, catalog, stored).collect()}

    def lines(sheet, keys, target, average=False):
        held = defaultdict(list)
        for s, _, v in rows:
            if s == sheet:
                held[tuple(v[k] for k in keys)].append(v[target] if target is not None else "1")
        order = lambda g: [(x is not None, Decimal(x) if KINDS[sheet][k] == "INTEGER" and x else 0, x or "") for k, x in zip(keys, g)]
        out = []
        for g in sorted(held, key=order):
            numbers = [Decimal(x) for x in held[g] if x is not None]
            value = str(len(numbers)) if target is None else shown(sum(numbers) / len(numbers) if average else sum(numbers)) if numbers else "None"
            out.append(", ".join([*(x or "None" for x in g), value]))
        return "\n".join(out)

    body = {i: r["context"].split("Database result:\n")[1] for i, r in got.items() if r["context"]}
    assert body[1] == "status, count\n" + lines("a", [1], None) == body[6]
    assert body[2] == "note, status, sum_amount\n" + lines("a", [3, 1], 2) and got[2]["row_count"] == 8
    assert body[3] == "label, avg_qty\n" + lines("b", [0], 1, True)
    assert body[4] == "qty, count\n" + lines("b", [1], None) and body[4].split("\n")[1].startswith("1, ")
    assert got[5]["problem"] == "not a number" and got[5]["context"] is None
    assert got[2]["sql"] == 'SELECT "note", "status", SUM("amount") FROM xlsx_a GROUP BY "note", "status" ORDER BY "note", "status"'


def test_many_groups_are_cut(spark):
    rows = spark.range(700).select(F.lit("s").alias("sheet_id"), F.col("id").alias("_row_id"), F.array(F.col("id").cast("string")).alias("values"))
    catalog = spark.createDataFrame([("s", 0, "n", "INTEGER", "")], "sheet_id string, col_idx int, physical_name string, data_type string, description string")
    listed = spark.createDataFrame([("s", "s", "xlsx_s", 0)], "sheet_id string, session_id string, table_name string, sheet_order int")
    asked = spark.createDataFrame([(1, "count by n", "s")], "question_id int, question string, session_id string")
    row = grouped_answers(asked, listed, catalog, rows).first()
    assert row["row_count"] == 500 and row["context"].endswith("\n19, 1 (+480 more rows)")
    assert grouped_answers(asked, listed, catalog, rows.limit(0)).first()["context"].endswith("Database result: (no rows)")
