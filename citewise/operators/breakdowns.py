"""Date-range and grouped questions answered together over a fleet of sheets.

However many questions are asked, rows are read once. Ranges never meet rows: rows add up per day, running sums over the
days are taken where a range begins or ends, and a question looks up two of them. Groupings are shared by all questions
that break the same sheet down by the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.breakdowns import asks_count, date_range, grouping, grouping_sql, ranged_sql, without_dates
from citewise.functions.questions import intent
from citewise.functions.text import let
from citewise.functions.values import NUMERIC_TYPE, canonical_text, display_value
from citewise.operators.intents import AVERAGE_TYPE, NO_FILTER, scopes
from citewise.operators.results import ROWS_SHOWN, result_header, single_value_text
from citewise.operators.scoped_sql import MAX_ROWS
from citewise.plans.materialize import settle

EVERY_ROW = -1  # target of a count
SAMPLE_TEXT = r"\(e\.g\. (.*)\)\.$"
FIGURE = ["sheet_id", "date_idx", "filter_idx", "folded", "filter_key", "target_idx"]


def _bound(questions: DataFrame, catalog: DataFrame, role: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add the position, type and further facts of the column named in ``role``."""
    facts = [F.col("col_idx").alias(f"{role}_idx"), F.col("data_type").alias(f"{role}_type"), *[F.col(c).alias(f"{role}_{c}") for c in extra]]
    return questions.join(catalog.select("sheet_id", F.col("physical_name").alias(role), *facts), ["sheet_id", role], "left")


def ranged_questions(questions: DataFrame, sheets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Questions that name a time, bound to a figure of their session's first sheet: FIGURE, span, aggregate, sql, problem.

    Times are compared with the first date column of the sheet. A filter value that the catalog shows for its column is
    taken as it is, any other is compared without regard to case.
    """
    asked = questions.select("question_id", "question", "session_id").join(scopes(sheets, catalog, "session_id"), "session_id")
    read = asked.select(
        "question_id", "sheet_id", "table_name", date_range(F.col("question")).alias("span"), asks_count(F.col("question")).alias("counted"),
        let(without_dates(F.col("question")), lambda plain: intent(plain, F.col("columns"))).alias("wanted"),
    )
    # what a question says is read once; the steps below only look at it
    asked = settle(read).filter(F.col("span").isNotNull())
    asked = asked.withColumn("aggregate", F.when(F.col("counted"), "COUNT").otherwise(F.col("wanted.aggregate")))
    asked = asked.filter(F.col("aggregate").isin("COUNT", "SUM", "AVG"))
    dates = catalog.filter("data_type = 'TIMESTAMP'").groupBy("sheet_id").agg(F.min(F.struct("col_idx", "physical_name")).alias("_date"))
    asked = asked.join(dates, "sheet_id", "left").withColumn("date_idx", F.col("_date.col_idx")).withColumn("date_name", F.col("_date.physical_name"))
    named = asked.withColumn("target", F.when(F.col("aggregate") != "COUNT", F.col("wanted.column"))).withColumn("condition", F.when(F.col("aggregate") != "COUNT", F.col("wanted.filter_column")))
    bound = _bound(_bound(named, catalog, "target"), catalog, "condition", ("description",))
    value = canonical_text(F.col("wanted.filter_value"), F.col("condition_type"))
    shown = F.array_contains(F.split(F.regexp_extract("condition_description", SAMPLE_TEXT, 1), ", "), value)
    filtered = F.col("condition").isNotNull()
    folded = filtered & (F.col("condition_type") == "TEXT") & ~F.coalesce(shown, F.lit(False))
    text = F.when(folded, F.lower(value)).otherwise(value)
    problem = (
        F.when(F.col("date_idx").isNull(), "no date column")
        .when((F.col("aggregate") != "COUNT") & F.col("target_idx").isNull(), "unknown column")
        .when((F.col("aggregate") != "COUNT") & ~F.col("target_type").isin("INTEGER", "NUMERIC"), "not a number")
        .when(filtered & (F.col("condition_idx").isNull() | value.isNull()), "filter value of another type")
    )
    column = F.concat(F.lit('"'), F.col("target"), F.lit('"'))
    call = F.when(F.col("aggregate") == "COUNT", "COUNT(*)").otherwise(F.concat(F.col("aggregate"), F.lit("("), column, F.lit(")")))
    name, literal = F.concat(F.lit('"'), F.col("condition"), F.lit('"')), F.concat(F.lit("'"), F.col("wanted.filter_value"), F.lit("'"))
    same = F.when(folded, F.concat(F.lit("LOWER("), name, F.lit(") = LOWER("), literal, F.lit(")"))).otherwise(F.concat(name, F.lit(" = "), literal))
    return bound.select(
        "question_id", "sheet_id", "span", "aggregate", problem.alias("problem"), "date_idx",
        F.when(filtered, F.col("condition_idx")).otherwise(NO_FILTER).alias("filter_idx"), F.coalesce(folded, F.lit(False)).alias("folded"),
        F.when(filtered, text).otherwise("").alias("filter_key"), F.coalesce("target_idx", F.lit(EVERY_ROW)).alias("target_idx"),
        ranged_sql(call, F.col("table_name"), F.col("date_name"), F.col("span"), F.when(filtered, same)).alias("sql"),
    )


def daily_sums(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """(FIGURE, day, total, numbers) of the wanted figures, added up before anything is shuffled."""
    shape = ["date_idx", "filter_idx", "folded"]
    shapes = figures.select("sheet_id", *shape).distinct().groupBy("sheet_id").agg(F.collect_list(F.struct(*shape)).alias("_shapes"))
    keys = ["sheet_id", *shape, "filter_key"]
    targets = figures.groupBy(*keys).agg(F.collect_set("target_idx").alias("_targets"))
    opened = rows.select("sheet_id", "values").join(shapes, "sheet_id").select("sheet_id", "values", F.inline("_shapes"))
    held = F.get("values", F.col("filter_idx"))
    key = F.when(F.col("filter_idx") == NO_FILTER, F.lit("")).when(F.col("folded"), F.lower(held)).otherwise(held)
    day = F.get("values", F.col("date_idx")).try_cast("timestamp_ntz").cast("date")
    dated = opened.withColumn("filter_key", key).withColumn("day", day).filter(F.col("day").isNotNull())
    matched = dated.join(targets, keys)
    value = F.transform("_targets", lambda i: F.struct(i.alias("target_idx"), F.when(i == EVERY_ROW, F.lit("1")).otherwise(F.get("values", i)).alias("v")))
    cells = matched.select(*keys, "day", F.inline(value)).withColumn("number", F.col("v").try_cast(NUMERIC_TYPE))
    return cells.groupBy(*FIGURE, "day").agg(F.sum("number").alias("total"), F.count("number").alias("numbers"))


def range_sums(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(FIGURE, span, total, numbers) of needed (FIGURE, span): the difference of two running sums over the days of a figure."""
    figures = needed.select(*FIGURE).distinct()
    ends = needed.select(*FIGURE, F.explode(F.array("span.start", "span.end")).alias("day"))
    nothing = ends.distinct().withColumn("total", F.lit(0).cast("decimal(38,4)")).withColumn("numbers", F.lit(0).cast("bigint"))
    days = daily_sums(rows, figures).withColumn("total", F.col("total").cast("decimal(38,4)")).withColumn("cut", F.lit(False))
    both = days.unionByName(nothing.withColumn("cut", F.lit(True)))
    merged = both.groupBy(*FIGURE, "day").agg(F.sum("total").alias("total"), F.sum("numbers").alias("numbers"), F.max("cut").alias("cut"))
    before = Window.partitionBy(*FIGURE).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    running = merged.withColumn("total", F.coalesce(F.sum("total").over(before), F.lit(0))).withColumn("numbers", F.coalesce(F.sum("numbers").over(before), F.lit(0)))
    at = settle(running.filter("cut").select(*FIGURE, "day", "total", "numbers"))
    side = lambda name: at.select(*FIGURE, F.col("day").alias(name), F.col("total").alias(f"{name}_total"), F.col("numbers").alias(f"{name}_numbers"))
    spans = needed.select(*FIGURE, "span").distinct().withColumn("_start", F.col("span.start")).withColumn("_end", F.col("span.end"))
    found = spans.join(side("_start"), [*FIGURE, "_start"]).join(side("_end"), [*FIGURE, "_end"])
    return found.select(
        *FIGURE, "span", (F.col("_end_total") - F.col("_start_total")).alias("total"), (F.col("_end_numbers") - F.col("_start_numbers")).alias("numbers")
    )


def _figure(aggregate: Column, total: Column, numbers: Column) -> Column:
    """A figure as shown; a sum or average of nothing is null."""
    average = (total.cast("decimal(28,4)") / numbers.cast("decimal(20,0)")).cast(AVERAGE_TYPE)
    some = numbers > 0
    return (
        F.when(aggregate == "COUNT", numbers.cast("string"))
        .when(aggregate == "AVG", display_value(F.when(some, average), AVERAGE_TYPE))
        .otherwise(display_value(F.when(some, total), "decimal"))
    )


def ranged_answers(questions: DataFrame, sheets: DataFrame, catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """(question_id, sql, value, context, row_count, problem) of the questions that name a time.

    A range whose end does not lie behind its start holds nothing. Rows without a date count for no range.
    """
    bound = settle(ranged_questions(questions, sheets, catalog))
    proper = bound.filter(F.col("problem").isNull() & (F.col("span.start") < F.col("span.end")))
    sums = range_sums(rows, proper.select(*FIGURE, "span"))
    joined = bound.join(sums, [*FIGURE, "span"], "left")
    total, numbers = F.col("total"), F.coalesce("numbers", F.lit(0).cast("bigint"))
    sound = F.col("problem").isNull()
    told = joined.withColumn("value", F.when(sound, _figure(F.col("aggregate"), total, numbers)))
    return told.select(
        "question_id", "sql", "value", F.when(sound, single_value_text(F.col("sql"), F.col("value"))).alias("context"),
        F.when(sound, F.lit(1)).cast("bigint").alias("row_count"), "problem",
    )


def grouped_questions(questions: DataFrame, sheets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Questions that break a figure down, bound to their session's first sheet: keys and target as positions, sql, problem."""
    asked = questions.select("question_id", "question", "session_id").join(scopes(sheets, catalog, "session_id"), "session_id")
    read = asked.select("question_id", "sheet_id", "table_name", grouping(F.col("question"), F.col("columns")).alias("wanted"))
    asked = settle(read).filter(F.col("wanted").isNotNull())
    places = catalog.groupBy("sheet_id").agg(F.map_from_entries(F.collect_list(F.struct("physical_name", F.struct("col_idx", "data_type")))).alias("_places"))
    placed = asked.join(places, "sheet_id").withColumn("target", F.col("wanted.column"))
    keys = F.transform("wanted.keys", lambda k: F.try_element_at(F.col("_places"), k)["col_idx"])
    target = F.try_element_at(F.col("_places"), F.col("target"))
    counting = F.col("wanted.aggregate") == "COUNT"
    problem = (
        F.when(F.exists(keys, lambda k: k.isNull()) | (~counting & target.isNull()), "unknown column")
        .when(~counting & ~target["data_type"].isin("INTEGER", "NUMERIC"), "not a number")
    )
    measure = F.lower(F.col("wanted.aggregate"))
    header = F.concat_ws(", ", F.array_join("wanted.keys", ", "), F.when(counting, measure).otherwise(F.concat_ws("_", measure, "target")))
    numeric = F.transform("wanted.keys", lambda k: F.coalesce(F.try_element_at(F.col("_places"), k)["data_type"].isin("INTEGER", "NUMERIC"), F.lit(False)))
    return placed.select(
        "question_id", "sheet_id", F.col("wanted.aggregate").alias("aggregate"), keys.alias("keys"), numeric.alias("numeric"),
        F.when(counting, EVERY_ROW).otherwise(target["col_idx"]).alias("target_idx"), header.alias("header"),
        grouping_sql(F.col("wanted"), F.col("table_name")).alias("sql"), problem.alias("problem"),
    )


def group_sums(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(sheet_id, keys, target_idx, group, total, numbers) of needed (sheet_id, keys, target_idx): one pass over the rows.

    A row is opened once per set of keys that someone asks of its sheet; sums form before the shuffle.
    """
    targets = needed.groupBy("sheet_id", "keys").agg(F.collect_set("target_idx").alias("targets"))
    wanted = targets.groupBy("sheet_id").agg(F.collect_list(F.struct("keys", "targets")).alias("_wanted"))
    opened = rows.select("sheet_id", "values").join(wanted, "sheet_id").select("sheet_id", "values", F.inline("_wanted"))
    group = F.transform("keys", lambda k: F.get("values", k))
    value = F.transform("targets", lambda i: F.struct(i.alias("target_idx"), F.when(i == EVERY_ROW, F.lit("1")).otherwise(F.get("values", i)).alias("v")))
    cells = opened.select("sheet_id", "keys", group.alias("group"), F.inline(value)).withColumn("number", F.col("v").try_cast(NUMERIC_TYPE))
    return cells.groupBy("sheet_id", "keys", "target_idx", "group").agg(F.sum("number").alias("total"), F.count("number").alias("numbers"))


def grouped_answers(questions: DataFrame, sheets: DataFrame, catalog: DataFrame, rows: DataFrame, shown: int = ROWS_SHOWN, max_rows: int = MAX_ROWS) -> DataFrame:
    """(question_id, sql, context, row_count, problem) of the questions that break a figure down.

    Groups stand in the order of their keys, numbers by size and null first; the first ``shown`` are written out, of at most
    ``max_rows``. Each set of keys is rendered once per aggregate, for all questions that share it.
    """
    bound = settle(grouped_questions(questions, sheets, catalog))
    result = ["sheet_id", "keys", "numeric", "target_idx", "aggregate"]
    needed = bound.filter(F.col("problem").isNull())
    sums = settle(group_sums(rows, needed.select("sheet_id", "keys", "target_idx").distinct()))
    asked = needed.select(*result).distinct()
    groups = sums.join(asked, ["sheet_id", "keys", "target_idx"])
    place = F.zip_with("group", "numeric", lambda v, n: F.struct(F.when(n, v.try_cast(NUMERIC_TYPE)).alias("number"), v.alias("text")))
    order = Window.partitionBy(*result).orderBy(place)
    first = groups.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= shown)
    counts = groups.groupBy(*result).agg(F.count(F.lit(1)).alias("groups"))
    cells = F.transform("group", lambda v: F.coalesce(v, F.lit("None")))
    line = F.concat_ws(", ", F.array_join(cells, ", "), _figure(F.col("aggregate"), F.col("total"), F.col("numbers")))
    lines = first.groupBy(*result).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", line.alias("line")))), lambda p: p["line"]).alias("lines"))
    told = bound.join(lines.join(counts, result), result, "left")
    row_count = F.least(F.coalesce("groups", F.lit(0)), F.lit(max_rows)).cast("bigint")
    more = F.when(row_count > shown, F.concat(F.lit(" (+"), (row_count - shown).cast("string"), F.lit(" more rows)"))).otherwise("")
    body = F.when(row_count == 0, "Database result: (no rows)").otherwise(
        F.concat(F.lit("Database result:\n"), "header", F.lit("\n"), F.array_join("lines", "\n"), more)
    )
    sound = F.col("problem").isNull()
    context = F.concat(result_header(F.col("sql")), body)
    return told.select("question_id", "sql", F.when(sound, context).alias("context"), F.when(sound, row_count).alias("row_count"), "problem")
