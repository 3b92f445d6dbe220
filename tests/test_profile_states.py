"""Profiles from states of several ingests against the profile of all cells at once."""

import random

from pyspark.sql import functions as F

from citewise.operators import profile

CELLS = "sheet_id string, row_idx bigint, col_idx int, value string, value_type string"


def cells_of(seed):
    rng = random.Random(seed)
    out = []
    for sheet in "ab":
        for row in range(300):
            made = [
                ("string", rng.choice(["red", "green", "blue", "Red"])), ("number", str(rng.randint(-5, 5000))), ("string", f"{rng.randint(0, 99)}.5"),
                ("date", f"2024-0{rng.randint(1, 9)}-11 00:00:00"), ("string", f"2023-1{rng.randint(0, 2)}-0{rng.randint(1, 9)}"), ("bool", rng.choice(["true", "false"])),
                ("string", f"free text {rng.randint(0, 400)}"), rng.choice([("string", "n/k"), ("number", str(rng.randint(1, 3)))]),
            ]
            out += [(sheet, row, i, v, t) for i, (t, v) in enumerate(made) if rng.random() < 0.9]
    return out


def parts(spark, cells):
    columns = spark.createDataFrame([(s, i, f"Col {i}") for s in "ab" for i in range(8)], "sheet_id string, col_idx int, column_name string")
    return spark.createDataFrame(cells, CELLS).repartition(3), columns, spark.createDataFrame([("a", 300), ("b", 300)], "sheet_id string, row_count bigint")


def catalog(df, drop=()):
    return sorted(tuple(r) for r in df.filter(~F.col("col_idx").isin(*drop)).collect())


def test_states_add_up(spark, tmp_path):
    rows = cells_of(1)
    cells, columns, sizes = parts(spark, rows)
    whole = profile.profile_columns(cells, columns, sizes)
    path = str(tmp_path / "states")
    rng = random.Random(2)
    cuts = [sorted(rng.sample(range(300), 3)) for _ in range(1)][0]
    bounds = [0, *cuts, 300]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = cells.filter((F.col("row_idx") >= low) & (F.col("row_idx") < high))
        for _ in range(1 + i % 2):
            profile.append_state(part, path, f"i{i}")
    merged = profile.profile_of_state(profile.stored_state(spark, path), columns, sizes)
    assert catalog(merged, (7,)) == catalog(whole, (7,)) and len(catalog(whole)) == 16
    assert catalog(profile.profile_of_state(profile.stored_state(spark, path), columns, sizes, cells)) == catalog(whole)
    one = {r["col_idx"]: r for r in whole.filter("sheet_id = 'a'").collect()}
    first = list(dict.fromkeys(v for s, r, c, v, t in sorted(rows, key=lambda x: x[1]) if s == "a" and c == 7))
    assert one[7]["data_type"] == "TEXT" and one[7]["description"].endswith(f"(e.g. {', '.join(first)}).")
    assert [one[i]["data_type"] for i in range(6)] == ["TEXT", "INTEGER" if one[1]["non_null"] == 300 else "NUMERIC", "NUMERIC", "TIMESTAMP", "TIMESTAMP", one[5]["data_type"]]


def test_state_is_folded(spark):
    cells, _, _ = parts(spark, cells_of(3))
    state = profile.value_counts(cells)
    assert state.filter("col_idx = 1").count() == 2 and state.filter("col_idx = 0 AND sheet_id = 'a'").count() == 4
    assert profile.merged_counts(state.unionByName(state)).agg(F.sum("n")).first()[0] == 2 * cells.count()
    assert profile.merged_counts(state.limit(0)).count() == 0
