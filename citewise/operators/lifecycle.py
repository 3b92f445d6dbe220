"""Tenant-scoped reads, roll-ups and purges over the app tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions.names import TABLE_PREFIX
from citewise.functions.text import strip
from citewise.plans.materialize import settle
from citewise.plans.scans import number_rows
from citewise.sources.files import DOCUMENT_TYPES

SCROLL_LIMIT = 500
ROWS_SHOWN = 20
CONTENT_TYPES = ("document_chunk", "excel_sheet")


def tenant_filter(
    points: DataFrame, user_id, session_id, content_type: str | None = None, file_id: str | None = None
) -> DataFrame:
    """Rows of one user's session; prunes the point table's partitions."""
    kept = points.filter((F.col("user_id") == user_id) & (F.col("session_id") == session_id))
    if content_type is not None:
        kept = kept.filter(F.col("content_type") == content_type)
    return kept if file_id is None else kept.filter(F.col("file_id") == file_id)


def scroll_points(points: DataFrame, limit: int = SCROLL_LIMIT) -> DataFrame:
    """Payload columns of up to ``limit`` points; vectors are never read."""
    return points.select(*[c for c in points.columns if c != "vector"]).limit(limit)


def ready_documents(files: DataFrame) -> DataFrame:
    return files.filter((F.col("status") == "ready") & F.col("file_type").isin(*DOCUMENT_TYPES))


def owned_requests(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests whose session belongs to the asking user."""
    return requests.join(sessions.select("user_id", "session_id"), ["user_id", "session_id"], "left_semi")


def sheets_in_scope(questions: DataFrame, sheets: DataFrame, discovered: DataFrame) -> DataFrame:
    """(question_id, session_id, sheet_id): the discovered sheets of a question, or all of its session's if none.

    ``discovered(question_id, sheet_id)``. A question with discovered sheets meets only those, not the whole session.
    """
    asked = questions.select("question_id", "session_id")
    held = sheets.select("session_id", "sheet_id")
    named = asked.join(discovered.select("question_id", "sheet_id").distinct(), "question_id").join(held, ["session_id", "sheet_id"])
    others = asked.join(discovered.select("question_id"), "question_id", "left_anti").join(held, "session_id")
    out = ("question_id", "session_id", "sheet_id")
    return named.select(*out).unionAll(others.select(*out))


def session_rollup(sessions: DataFrame, files: DataFrame, sheets: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their file, sheet and message counts; each table is counted before it meets the sessions."""
    out = sessions
    for name, table in (("files", files), ("sheets", sheets), ("messages", messages)):
        counts = table.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "session_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def catalog_with_columns(sheets: DataFrame, columns: DataFrame, workbooks: DataFrame) -> DataFrame:
    """Sheets with their workbook's file name, one row per column (or one row without, for a sheet that has none)."""
    named = sheets.join(workbooks.select("workbook_id", "filename"), "workbook_id", "left")
    return named.join(columns.select("sheet_id", "col_idx", "column_name", "physical_name", "data_type"), "sheet_id", "left")


def owned_tables(sheets: DataFrame, sessions: DataFrame, user_prefix: str) -> DataFrame:
    """Tables of sessions whose user id starts with ``user_prefix`` (taken literally)."""
    mine = sessions.filter(F.col("user_id").startswith(user_prefix)).select("session_id", "user_id")
    return sheets.join(mine, "session_id")


def point_stats(points: DataFrame) -> DataFrame:
    """(content_type, points) per known type plus the total as ``all``; a type without points counts zero."""
    known = [F.count(F.when(F.col("content_type") == t, 1)).alias(t) for t in CONTENT_TYPES]
    totals = points.agg(F.count(F.lit(1)).alias("all"), *known)
    return totals.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("content_type"), F.col(n).alias("points")) for n in ("all", *CONTENT_TYPES)]))
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, table_group, rows) over named tables."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"),
            F.lit("sheet" if name.startswith(TABLE_PREFIX) else "app").alias("table_group"),
            "rows",
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def catalog_listing(catalog: DataFrame, sheets: DataFrame) -> DataFrame:
    """(table_name, table_group, column_name, data_type, columns) of the stored column catalog, one row per column.

    Sheets without a column give one row without one; ``columns`` counts those of the table.
    """
    listed = sheets.select("sheet_id", "table_name").join(catalog.select("sheet_id", F.col("physical_name").alias("column_name"), "data_type"), "sheet_id", "left")
    counts = catalog.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("columns"))
    group = F.when(F.col("table_name").startswith(TABLE_PREFIX), "sheet").otherwise("app")
    return listed.join(counts, "sheet_id", "left").select("table_name", group.alias("table_group"), "column_name", "data_type", F.coalesce("columns", F.lit(0)).alias("columns"))


def outside_tables(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """(query_id, outside): tables that logged queries read beyond their session's, for the queries that do so.

    ``log(query_id, session_id, tables array<string>)`` holds the names the guard has taken from a statement;
    ``allowed(session_id, table_name)``. A table counts once per query.
    """
    read = log.select("query_id", "session_id", F.explode(F.array_distinct("tables")).alias("table_name"))
    beyond = read.join(allowed.select("session_id", "table_name").distinct(), ["session_id", "table_name"], "left_anti")
    return beyond.groupBy("query_id").agg(F.array_sort(F.collect_set("table_name")).alias("outside"))


def audit_log(log: DataFrame, allowed: DataFrame, max_rows: int) -> DataFrame:
    """log(query_id, session_id, kind, tables, asked_rows) + outside, verdict and the rows that may be returned.

    ``kind`` is what the guard found a statement to be; only a select over the session's own tables is let through.
    """
    judged = log.join(outside_tables(log, allowed), "query_id", "left")
    verdict = (
        F.when(F.coalesce("kind", F.lit("")) != "select", "not_select").when(F.col("outside").isNotNull(), "out_of_scope")
        .when(F.col("asked_rows") > max_rows, "capped").otherwise("ok")
    )
    rows = F.least(F.coalesce("asked_rows", F.lit(max_rows)), F.lit(max_rows)).cast("bigint")
    return judged.withColumn("verdict", verdict).withColumn("row_limit", F.when(F.col("verdict").isin("ok", "capped"), rows))


def table_listing(spark: SparkSession) -> DataFrame:
    """(table_name, table_group, column_name, data_type) of the session catalog."""
    rows = [
        (t.name, "sheet" if t.name.startswith(TABLE_PREFIX) else "app", c.name, c.dataType)
        for t in spark.catalog.listTables()
        for c in spark.catalog.listColumns(t.name)
    ]
    return spark.createDataFrame(rows, "table_name string, table_group string, column_name string, data_type string")


def session_flags(files: DataFrame, sheets: DataFrame) -> DataFrame:
    """(session_id, has_documents, has_structured_data); every sheet counts, also one without rows."""
    documents = ready_documents(files).select("session_id", F.lit(True).alias("d"), F.lit(False).alias("s"))
    tables = sheets.select("session_id", F.lit(False).alias("d"), F.lit(True).alias("s"))
    return documents.unionAll(tables).groupBy("session_id").agg(
        F.max("d").alias("has_documents"), F.max("s").alias("has_structured_data")
    )


def newest_sessions(sessions: DataFrame, user_id=None) -> DataFrame:
    """A user's sessions, newest first."""
    mine = sessions if user_id is None else sessions.filter(F.col("user_id") == user_id)
    return mine.orderBy(F.desc("created_at"), "session_id")


def chronological(rows: DataFrame, session_id=None) -> DataFrame:
    """Files or messages of a session, oldest first."""
    mine = rows if session_id is None else rows.filter(F.col("session_id") == session_id)
    return mine.orderBy("created_at")


def sample_rows(table: DataFrame, limit: int = ROWS_SHOWN) -> DataFrame:
    return table.limit(limit)


def purge(tables: Mapping[str, DataFrame], deleted: DataFrame, key: Sequence[str] = ("session_id",)) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys; keys that own nothing change nothing."""
    gone = settle(deleted.select(*key).distinct())
    return {name: df.join(gone, list(key), "left_anti") for name, df in tables.items()}


def purge_sessions(tables: Mapping[str, DataFrame], sessions: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Purge requests(user_id, session_id) from all tables; a request by anyone but the owner is ignored."""
    owned = owned_requests(requests.select("user_id", "session_id"), sessions)
    return purge({**tables, "sessions": sessions}, owned)


def get_or_create_users(users: DataFrame, wanted: Column | str, requests: DataFrame) -> DataFrame:
    """Users plus the trimmed, non-empty ids that were not known yet."""
    ids = requests.select(strip(F.col(wanted) if isinstance(wanted, str) else wanted).alias("user_id"))
    fresh = ids.filter(F.col("user_id") != "").distinct().join(users.select("user_id"), "user_id", "left_anti")
    return users.select("user_id").unionByName(fresh)


def newest_per_user(sessions: DataFrame) -> DataFrame:
    """All users' sessions with ``position`` 1 for the newest; a user's sessions are ranked day by day."""
    day = -F.date_diff(F.to_date("created_at"), F.lit("1970-01-01").cast("date"))
    ranked = number_rows(sessions, ["user_id"], [F.desc("created_at"), F.col("session_id")], "position", block=day)
    return ranked.withColumn("position", F.col("position") + 1)
