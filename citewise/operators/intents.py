"""Aggregate questions answered together over a fleet of sheets.

Intents are reduced to the distinct (sheet, filter, column) sums they need, rows are matched to filters by an equi-join
on the filter value, and partial sums form before anything is shuffled. How many questions ask the same thing does not
change the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewise.functions.questions import INTENT_TYPE, intent, intent_sql
from citewise.functions.values import NUMERIC_TYPE, canonical_text, display_value
from citewise.operators.results import single_value_text
from citewise.plans.materialize import settle

NO_FILTER = -1
# Fixed value: the scale averages are carried with.
AVERAGE_TYPE = "decimal(38,14)"


def scopes(sheets: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, sheet_id, table_name, columns) per session or question.

    The first sheet of a scope is the one queried; ``columns`` holds the distinct column names over all its sheets in
    order. ``sheets`` has key, sheet_id, sheet_order and table_name.
    """
    listed = sheets.select(key, "sheet_id", "sheet_order", "table_name")
    first = listed.groupBy(key).agg(F.min(F.struct("sheet_order", "sheet_id", "table_name")).alias("_first"))
    named = listed.join(catalog.select("sheet_id", "col_idx", "physical_name"), "sheet_id")
    seen = named.groupBy(key, "physical_name").agg(F.min(F.struct("sheet_order", "sheet_id", "col_idx")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "physical_name")))
    columns = seen.groupBy(key).agg(F.transform(ordered, lambda c: c["physical_name"]).alias("columns"))
    joined = first.join(columns, key)
    return joined.select(key, "_first.sheet_id", "_first.table_name", "columns")


def question_intents(questions: DataFrame, sheets: DataFrame, catalog: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(question_id, question, sheet_id, table_name, wanted, sql).

    A question (question_id, question, session_id) asks the sheets discovered for it in ``found(question_id,
    sheet_id)``, or all sheets of its session when there are none.
    """
    asked = questions.select("question_id", "question", "session_id")
    joined = asked.join(scopes(sheets, catalog, "session_id"), "session_id", "left")
    if found is not None:
        own = scopes(found.join(sheets.select("sheet_id", "sheet_order", "table_name"), "sheet_id"), catalog, "question_id")
        names = ("sheet_id", "table_name", "columns")
        joined = joined.join(own.select("question_id", F.struct(*names).alias("_own")), "question_id", "left")
        for name in names:
            joined = joined.withColumn(name, F.when(F.col("_own").isNotNull(), F.col("_own")[name]).otherwise(F.col(name)))
    wanted = F.when(F.col("columns").isNotNull(), intent(F.col("question"), F.col("columns"))).cast(INTENT_TYPE)
    return joined.select("question_id", "question", "sheet_id", "table_name", wanted.alias("wanted")).withColumn(
        "sql", intent_sql(F.col("wanted"), F.col("table_name"))
    )


def resolve_intents(intents: DataFrame, catalog: DataFrame) -> DataFrame:
    """Bind column names to positions and types; ``problem`` names what the query would fail on."""
    bound = intents.filter(F.col("wanted").isNotNull())

    def column(role: str) -> DataFrame:
        return catalog.select(
            "sheet_id",
            F.col("physical_name").alias(role),
            F.col("col_idx").alias(f"{role}_idx"),
            F.col("data_type").alias(f"{role}_type"),
            *([F.col("nunique").alias("_distinct")] if role == "target" else []),
        )

    named = bound.withColumn("target", F.col("wanted")["column"]).withColumn("condition", F.col("wanted")["filter_column"])
    joined = named.join(column("target"), ["sheet_id", "target"], "left")
    joined = joined.join(column("condition"), ["sheet_id", "condition"], "left")
    literal = canonical_text(F.col("wanted")["filter_value"], F.col("condition_type"))
    filtered = F.col("condition").isNotNull()
    problem = (
        F.when(F.col("target_idx").isNull(), "unknown column")
        .when(filtered & F.col("condition_idx").isNull(), "unknown filter column")
        .when(filtered & literal.isNull(), "filter value of another type")
        .when((F.col("wanted")["aggregate"] != "COUNT_DISTINCT") & ~F.col("target_type").isin("INTEGER", "NUMERIC"), "not a number")
    )
    return (
        joined.withColumn("filter_idx", F.when(filtered, F.col("condition_idx")).otherwise(NO_FILTER))
        .withColumn("filter_text", F.when(filtered, literal).otherwise(""))
        .withColumn("problem", problem)
    )


def filtered_sums(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Sums and counts per needed (sheet_id, filter_idx, filter_text, target_idx).

    ``rows(sheet_id, values array<string>)`` in stored form; a row is only opened at the filter columns someone uses.
    """
    keys = ["sheet_id", "filter_idx", "filter_text"]
    used = needed.groupBy("sheet_id").agg(F.collect_set("filter_idx").alias("_used"))
    targets = needed.groupBy(*keys).agg(F.collect_set("target_idx").alias("_targets"))
    opened = rows.select("sheet_id", "values").join(used, "sheet_id").select(
        "sheet_id", "values", F.explode("_used").alias("filter_idx")
    )
    value = F.when(F.col("filter_idx") == NO_FILTER, F.lit("")).otherwise(F.get("values", F.col("filter_idx")))
    matched = opened.withColumn("filter_text", value).join(targets, keys)
    cells = matched.select(
        *keys, F.explode(F.transform("_targets", lambda i: F.struct(i.alias("target_idx"), F.get("values", i).alias("v")))).alias("c")
    ).select(*keys, "c.target_idx", F.col("c.v").try_cast(NUMERIC_TYPE).alias("number"))
    return cells.groupBy(*keys, "target_idx").agg(
        F.sum("number").alias("total"), F.count("number").alias("numbers")
    )


def distinct_counts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sheet_id, target_idx, distinct_values) for the wanted columns, exact."""
    columns = wanted.groupBy("sheet_id").agg(F.collect_set("target_idx").alias("_targets"))
    cells = rows.select("sheet_id", "values").join(columns, "sheet_id").select(
        "sheet_id", F.explode(F.transform("_targets", lambda i: F.struct(i.alias("target_idx"), F.get("values", i).alias("v")))).alias("c")
    ).select("sheet_id", "c.target_idx", "c.v")
    seen = cells.filter(F.col("v").isNotNull()).distinct()
    return seen.groupBy("sheet_id", "target_idx").agg(F.count(F.lit(1)).alias("distinct_values"))


def structured_answers(intents: DataFrame, catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """(question_id, sql, value, context, row_count, problem) per question with an intent.

    The resolved intents are written once: they feed the sums, the distinct counts and the answers.
    """
    resolved = settle(resolve_intents(intents, catalog))
    usable = resolved.filter(F.col("problem").isNull())
    counting = F.col("wanted")["aggregate"] == "COUNT_DISTINCT"
    keys = ["sheet_id", "filter_idx", "filter_text", "target_idx"]
    sums = filtered_sums(rows, usable.filter(~counting).select(*keys).distinct())
    distinct = distinct_counts(rows, usable.filter(counting).select("sheet_id", "target_idx").distinct())
    joined = resolved.join(sums, keys, "left").join(distinct, ["sheet_id", "target_idx"], "left")
    total, numbers = F.col("total"), F.col("numbers")
    average = F.when(numbers > 0, (total.cast("decimal(28,4)") / numbers.cast("decimal(20,0)")).cast(AVERAGE_TYPE))
    value = (
        F.when(counting, F.coalesce("distinct_values", F.lit(0)).cast("string"))
        .when(F.col("wanted")["aggregate"] == "AVG", display_value(average, AVERAGE_TYPE))
        .otherwise(display_value(total, "decimal"))
    )
    answered = joined.withColumn("value", F.when(F.col("problem").isNull(), value))
    return answered.select(
        "question_id",
        "sql",
        "value",
        F.when(F.col("problem").isNull(), single_value_text(F.col("sql"), F.col("value"))).alias("context"),
        F.when(F.col("problem").isNull(), F.lit(1)).cast("bigint").alias("row_count"),
        "problem",
    )

