"""Structured queries, guarded SQL, routing, intents and whole answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions import questions as qs
from citewise.functions.text import cell_text, normalize
from citewise.operators import breakdowns, intents, profile, sheets
from citewise.operators.rerank import rerank_by_model
from citewise.operators.results import render_result
from citewise.operators.scoped_sql import query_audit, scoped_sql
from citewise.plans.answers import Collections, answer_questions
from citewise.operators.search import embed
from citewise.plans.materialize import settle
from citewise.plugins import embedding_provider, relevance_scorer, text_generator
from suite.common import Registry, load, long, overlap_sql, spread, top_k_sql, vectors_sql, whole_documents

query = Registry()
Q, SQL = query.queries, query.sql

MONEY = "decimal(18,4)"


def double(col):
    return col.cast("double")


@query(
    "a1_count_distinct",
    "SELECT o_orderpriority, count(DISTINCT o_custkey)::BIGINT AS customers, count(DISTINCT o_orderstatus)::BIGINT AS statuses FROM orders GROUP BY 1",
)
def a1(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses")
    )


@query(
    "a2_sum_avg",
    "SELECT l_returnflag, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS total, round(avg(l_quantity::DECIMAL(18,4)), 6) AS mean_quantity "
    "FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1",
)
def a2(spark, folder):
    lines = load(spark, folder, "lineitem").filter(F.col("l_linestatus") == "O")
    return lines.groupBy("l_returnflag").agg(
        double(F.sum(F.col("l_extendedprice").cast(MONEY))).alias("total"),
        F.round(double(F.avg(F.col("l_quantity").cast(MONEY))), 6).alias("mean_quantity"),
    )


@query(
    "a3_group_by",
    "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2",
)
def a3(spark, folder):
    return load(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).orderBy("l_returnflag", "l_linestatus")


@query(
    "p6_date_range",
    "SELECT count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01' AND lower(o_orderpriority) = lower('2-high')",
)
def p6(spark, folder):
    """Half-open month and a case-insensitive equality; the date comparison reaches the scan."""
    orders = load(spark, folder, "orders")
    kept = orders.filter(
        (F.col("o_orderdate") >= F.lit("1997-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-04-01").cast("timestamp_ntz"))
        & (F.lower("o_orderpriority") == F.lower(F.lit("2-high")))
    )
    return kept.agg(F.count(F.lit(1)).alias("n"), double(F.sum(F.col("o_totalprice").cast(MONEY))).alias("total"))


ORDER_COLUMNS = ["status", "priority", "ordered", "price"]
TRIMMED = "regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '0+$', ''), '\\.$', '')"
RANGED_SQL = f"""
WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderdate::DATE AS day, o_orderstatus, o_totalprice::DECIMAL(18,4) AS price FROM orders),
asked AS (
  SELECT o_orderkey AS question_id, kind, CASE kind WHEN 0 THEN date_trunc('month', day) WHEN 2 THEN date_trunc('quarter', day) WHEN 3 THEN date_trunc('year', day) ELSE day END::DATE AS s,
    CASE kind WHEN 0 THEN date_trunc('month', day) + INTERVAL 1 MONTH WHEN 1 THEN day + INTERVAL 10 DAY WHEN 2 THEN date_trunc('quarter', day) + INTERVAL 3 MONTH
      WHEN 3 THEN date_trunc('year', day) + INTERVAL 1 YEAR WHEN 4 THEN DATE '9999-12-31' ELSE day + INTERVAL 1 DAY END::DATE AS e,
    CASE WHEN kind IN (3, 5) THEN o_orderstatus END AS status
  FROM d
),
spans AS (SELECT DISTINCT s, e, status FROM asked),
found AS (
  SELECT p.s, p.e, p.status, count(d.day) AS n, sum(d.price) AS total, avg(d.price) AS mean
  FROM spans p LEFT JOIN d ON d.day >= p.s AND d.day < p.e AND (p.status IS NULL OR d.o_orderstatus = p.status) GROUP BY ALL
)
SELECT question_id, CASE WHEN kind = 2 THEN n::VARCHAR WHEN n = 0 THEN 'None' WHEN kind IN (1, 4) THEN {TRIMMED.format('CAST(mean AS DECIMAL(38,4))')} ELSE {TRIMMED.format('total')} END AS value,
  'WHERE "ordered" >= ''' || a.s || ''' AND "ordered" < ''' || a.e || '''' || CASE kind WHEN 3 THEN ' AND LOWER("status") = LOWER(''' || lower(a.status) || ''')' WHEN 5 THEN ' AND "status" = ''' || a.status || '''' ELSE '' END AS condition
FROM asked a JOIN found f ON f.s = a.s AND f.e = a.e AND f.status IS NOT DISTINCT FROM a.status"""


def order_sheet(spark, folder):
    """(sheets, catalog, typed rows) of one sheet made from orders: status, priority, ordered, price."""
    orders = load(spark, folder, "orders")
    cells = F.array("o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("string"), F.col("o_totalprice").cast("string"))
    body = orders.select(
        F.lit("orders").alias("sheet_id"), F.col("o_orderkey").alias("row_idx"), cells.alias("cells"),
        F.array(*[F.lit(k) for k in ("string", "string", "date", "number")]).alias("cell_types"),
    )
    sizes = body.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("row_count"))
    columns = sizes.select("sheet_id", F.posexplode(F.array(*[F.lit(c) for c in ORDER_COLUMNS])).alias("col_idx", "column_name"))
    catalog = settle(profile.profile_columns(sheets.long_cells(spread(body)), columns, sizes))
    listed = sizes.select("sheet_id", F.lit("s").alias("session_id"), F.lit("xlsx_orders").alias("table_name"), F.lit(0).alias("sheet_order"))
    return listed, catalog, sheets.typed_rows(body, catalog)


@query("p6_ranged_questions", RANGED_SQL)
def p6_ranged(spark, folder):
    """A question about a span of time from every order: months, quarters, years, days, spans of days, open ends."""
    day, month = F.col("o_orderdate").cast("date"), F.date_format("o_orderdate", "MMMM yyyy")
    iso, year = day.cast("string"), F.year(day).cast("string")
    texts = [
        F.concat(F.lit("What was the total price in "), month, F.lit("?")),
        F.concat(F.lit("average price between "), iso, F.lit(" and "), F.date_add(day, 9).cast("string")),
        F.concat(F.lit("How many orders in Q"), F.quarter(day).cast("string"), F.lit(" "), year, F.lit("?")),
        F.concat(F.lit("total price in "), year, F.lit(" where status = "), F.lower("o_orderstatus")),
        F.concat(F.lit("Mean price since "), iso),
        F.concat(F.lit("Sum of price on "), iso, F.lit(" where status = '"), "o_orderstatus", F.lit("'")),
    ]
    kind = (F.col("o_orderkey") % 6 + 1).cast("int")
    asked = load(spark, folder, "orders").select(F.col("o_orderkey").alias("question_id"), F.element_at(F.array(*texts), kind).alias("question"), F.lit("s").alias("session_id"))
    answered = breakdowns.ranged_answers(asked, *order_sheet(spark, folder))
    return answered.select("question_id", "value", F.regexp_extract("sql", "(WHERE .*)$", 1).alias("condition"))


GROUPED_SQL = f"""
WITH p AS (SELECT p_partkey, p_partkey % 7 AS n, p_type AS kind, 'B' || substr(p_brand, 7) AS brand, p_size AS size, p_retailprice::DECIMAL(18,4) AS price FROM part),
lines AS (
  SELECT n, 0 AS ask, brand || ', ' || count(*) AS line, row_number() OVER (PARTITION BY n ORDER BY brand) AS r, 'brand, count' AS header FROM p GROUP BY n, brand
  UNION ALL SELECT n, 1, brand || ', ' || size || ', ' || {TRIMMED.format('sum(price)')}, row_number() OVER (PARTITION BY n ORDER BY brand, size), 'brand, size, sum_price' FROM p GROUP BY n, brand, size
  UNION ALL SELECT n, 2, kind || ', ' || {TRIMMED.format('CAST(avg(price) AS DECIMAL(38,4))')}, row_number() OVER (PARTITION BY n ORDER BY kind), 'kind, avg_price' FROM p GROUP BY n, kind
  UNION ALL SELECT n, 3, size || ', ' || brand || ', ' || count(*), row_number() OVER (PARTITION BY n ORDER BY size, brand), 'size, brand, count' FROM p GROUP BY n, size, brand
  UNION ALL SELECT n, 4, kind || ', ' || sum(size), row_number() OVER (PARTITION BY n ORDER BY kind), 'kind, sum_size' FROM p GROUP BY n, kind
),
texts AS (
  SELECT n, ask, least(max(r), 500) AS row_count, 'Database result:' || chr(10) || any_value(header) || chr(10) || string_agg(line, chr(10) ORDER BY r) FILTER (r <= 20)
    || CASE WHEN max(r) > 20 THEN ' (+' || (least(max(r), 500) - 20) || ' more rows)' ELSE '' END AS body
  FROM lines GROUP BY n, ask
)
SELECT p_partkey AS question_id, row_count::BIGINT AS row_count, body FROM p JOIN texts t ON t.n = p.n AND t.ask = p_partkey % 5"""


@query("a3_grouped_questions", GROUPED_SQL)
def a3_grouped(spark, folder):
    """Counts, sums and averages by one and two columns, asked once for every part over seven sheets."""
    texts = [
        "How many parts by brand?", "What is the total price broken down by brand and size?", "average price per kind",
        "number of parts for each size and brand", "Sum of size grouped by kind.",
    ]
    sheet = F.concat(F.lit("p"), (F.col("p_partkey") % 7).cast("string"))
    listed, catalog, rows = part_sheets(spark, folder, sheet, sheet)
    asked = load(spark, folder, "part").select(
        F.col("p_partkey").alias("question_id"), sheet.alias("session_id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("question")
    )
    answered = breakdowns.grouped_answers(asked, listed, catalog, rows)
    return answered.select("question_id", "row_count", F.regexp_extract("context", r"(?s)(Database result:.*)$", 1).alias("body"))


@query("t4_row_cap", "SELECT least(count(*), 500)::BIGINT AS n FROM orders")
def t4(spark, folder):
    """A query without a limit of its own returns at most the capped number of rows."""
    orders = load(spark, folder, "orders")
    return scoped_sql(spark, 'SELECT "o_orderkey" FROM xlsx_orders', {"xlsx_orders": orders}).agg(F.count(F.lit(1)).alias("n"))


@query(
    "t5_render",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500),
r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS total FROM o)
SELECT 'Query executed: SELECT' || chr(10) || chr(10) || 'Database result:' || chr(10) || 'o_orderkey, o_orderstatus, o_totalprice' || chr(10) ||
  string_agg(o_orderkey || ', ' || o_orderstatus || ', ' || regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '\\.$', ''), chr(10) ORDER BY n) FILTER (n <= 20)
  || CASE WHEN max(total) > 20 THEN ' (+' || (max(total) - 20) || ' more rows)' ELSE '' END AS context, max(total)::BIGINT AS row_count FROM r""",
)
def t5(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return render_result(orders, "SELECT", order=["o_orderkey"])


@query(
    "c9_scoped_sql",
    """SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(o_totalprice::DECIMAL(18,4))::DOUBLE, 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY 1""",
)
def c9(spark, folder):
    views = {"xlsx_orders": load(spark, folder, "orders"), "xlsx_customer": load(spark, folder, "customer")}
    text = """
SELECT "c_mktsegment", COUNT(*) AS n, ROUND(CAST(SUM(CAST("o_totalprice" AS DECIMAL(18,4))) AS DOUBLE), 4) AS total
FROM xlsx_orders JOIN xlsx_customer ON "o_custkey" = "c_custkey"
WHERE "o_totalprice" > (SELECT AVG("o_totalprice") FROM xlsx_orders) GROUP BY "c_mktsegment";"""
    return scoped_sql(spark, text, views)


# A query log made from the event stream: every event type stands for another way of asking, good or bad.
LOG_SQL = """
log AS (
  SELECT event_id AS query_id,
    CASE event_id % 16
      WHEN 0 THEN 'SELECT value FROM xlsx_events WHERE user_id = ' || user_id
      WHEN 1 THEN 'DROP TABLE xlsx_events'
      WHEN 2 THEN 'SELECT * FROM xlsx_events; DELETE FROM xlsx_events'
      WHEN 3 THEN 'select * from users where id in (select user_id from xlsx_events)'
      WHEN 4 THEN 'SELECT event_type FROM xlsx_events LIMIT ' || (event_id % 1000)
      WHEN 5 THEN ' NO_QUERY '
      WHEN 6 THEN 'SELECT ''a;b -- drop'' AS note FROM xlsx_events;'
      WHEN 7 THEN 'SELECT a FROM xlsx_events UNION SELECT b FROM xlsx_events'
      WHEN 8 THEN 'SELECT e.value FROM xlsx_events e JOIN xlsx_users u ON e.user_id = u.id'
      WHEN 9 THEN 'UPDATE xlsx_events SET value = 0'
      WHEN 10 THEN 'WITH t AS (SELECT value FROM xlsx_events) SELECT * FROM t'
      WHEN 11 THEN 'SELECT * FROM public.xlsx_events'
      WHEN 12 THEN 'SELECT 1; SELECT 2;'
      WHEN 13 THEN 'SELECT x FROM (SELECT 1 AS x UNION ALL SELECT 2) d, xlsx_events'
      WHEN 14 THEN 'TRUNCATE TABLE xlsx_events'
      ELSE 'SELECT "drop" FROM "xlsx_events" LIMIT 999999' END AS sql
  FROM events
)"""


def query_log(spark, folder) -> DataFrame:
    events = load(spark, folder, "events")
    texts = [
        F.concat(F.lit("SELECT value FROM xlsx_events WHERE user_id = "), F.col("user_id").cast("string")),
        F.lit("DROP TABLE xlsx_events"),
        F.lit("SELECT * FROM xlsx_events; DELETE FROM xlsx_events"),
        F.lit("select * from users where id in (select user_id from xlsx_events)"),
        F.concat(F.lit("SELECT event_type FROM xlsx_events LIMIT "), (F.col("event_id") % 1000).cast("string")),
        F.lit(" NO_QUERY "),
        F.lit("SELECT 'a;b -- drop' AS note FROM xlsx_events;"),
        F.lit("SELECT a FROM xlsx_events UNION SELECT b FROM xlsx_events"),
        F.lit("SELECT e.value FROM xlsx_events e JOIN xlsx_users u ON e.user_id = u.id"),
        F.lit("UPDATE xlsx_events SET value = 0"),
        F.lit("WITH t AS (SELECT value FROM xlsx_events) SELECT * FROM t"),
        F.lit("SELECT * FROM public.xlsx_events"),
        F.lit("SELECT 1; SELECT 2;"),
        F.lit("SELECT x FROM (SELECT 1 AS x UNION ALL SELECT 2) d, xlsx_events"),
        F.lit("TRUNCATE TABLE xlsx_events"),
        F.lit('SELECT "drop" FROM "xlsx_events" LIMIT 999999'),
    ]
    text = F.element_at(F.array(*texts), (F.col("event_id") % 16 + 1).cast("int"))
    return events.select(F.col("event_id").alias("query_id"), text.alias("sql"), F.array(F.lit("xlsx_events")).alias("allowed"))


AUDIT_SQL = f"""WITH {LOG_SQL}, judged AS (
SELECT query_id, CASE query_id % 16 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_select' WHEN 2 THEN 'stacked' WHEN 3 THEN 'out_of_scope'
  WHEN 4 THEN CASE WHEN query_id % 1000 > 500 THEN 'capped' ELSE 'ok' END WHEN 5 THEN 'empty' WHEN 6 THEN 'ok' WHEN 7 THEN 'not_select'
  WHEN 8 THEN 'out_of_scope' WHEN 9 THEN 'not_select' WHEN 10 THEN 'ok' WHEN 11 THEN 'out_of_scope' WHEN 12 THEN 'stacked'
  WHEN 13 THEN 'ok' WHEN 14 THEN 'not_select' ELSE 'capped' END AS verdict,
  CASE query_id % 16 WHEN 3 THEN 'users' WHEN 8 THEN 'xlsx_users' WHEN 11 THEN 'public.xlsx_events' ELSE '' END AS outside,
  CASE WHEN query_id % 16 = 4 THEN least(query_id % 1000, 500) WHEN query_id % 16 IN (0, 6, 10, 13, 15) THEN 500 END::BIGINT AS row_limit
FROM log)"""


@query("c13_query_audit", AUDIT_SQL + " SELECT query_id, verdict, outside, row_limit FROM judged")
def c13(spark, folder):
    return query_audit(query_log(spark, folder)).select("query_id", "verdict", "outside", "row_limit")


@query("j8_outside_tables", AUDIT_SQL + " SELECT outside, count(*)::BIGINT AS n FROM judged WHERE outside <> '' GROUP BY 1")
def j8(spark, folder):
    audited = query_audit(query_log(spark, folder)).filter(F.col("outside") != "")
    return audited.groupBy("outside").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f19_clean_sql",
    f"""WITH {LOG_SQL}, hedged AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN sql || chr(10) || ' NO_QUERY ' ELSE sql END AS sql FROM log)
SELECT query_id, CASE WHEN trim(sql, E' \\n') = 'NO_QUERY' THEN 'NO_QUERY'
  ELSE trim(regexp_replace(sql, '\\s*NO_QUERY\\s*$', ''), E' \\n') END AS cleaned FROM hedged""",
)
def f19(spark, folder):
    hedged = F.when(F.col("query_id") % 3 == 0, F.concat("sql", F.lit("\n NO_QUERY "))).otherwise(F.col("sql"))
    return query_log(spark, folder).select("query_id", qs.clean_sql(hedged).alias("cleaned"))


@query(
    "f18_index_lists",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '3,0' WHEN 1 THEN CASE WHEN user_id < 20 THEN user_id::VARCHAR || ',1' ELSE '1' END
  WHEN 2 THEN '2,1' WHEN 3 THEN '' WHEN 4 THEN '1,2' ELSE '' END AS kept FROM events WHERE NOT (event_id % 6 = 1 AND user_id = 1)
UNION ALL SELECT event_id, '1' FROM events WHERE event_id % 6 = 1 AND user_id = 1""",
)
def f18(spark, folder):
    """Index lists out of model replies of several shapes, one per event."""
    n = F.col("event_id") % 6
    reply = (
        F.when(n == 0, "[3, 99, 0, 3, -1, true, 2.5]")
        .when(n == 1, F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", 1]")))
        .when(n == 2, "Here are the results:\n```json\n[2, 1]\n```")
        .when(n == 3, "not json at all").when(n == 4, '{"indices": [1, 2]}').otherwise("[not, valid, json]")
    )
    kept = qs.index_list(reply, F.lit(20))
    return load(spark, folder, "events").select("event_id", F.array_join(kept, ",").alias("kept"))


@query(
    "u3_ordered_dedup",
    "WITH n AS (SELECT event_id, user_id % 5 AS n, 2 + user_id % 6 AS size FROM events), "
    "f AS (SELECT event_id, list_filter([3, n, 1, 3, n, 40, n + 2], lambda x: x < size) AS l FROM n) "
    "SELECT event_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS kept FROM f",
)
def u3(spark, folder):
    """Replies that list candidates twice or beyond their number, read as the order of their first mention."""
    n = (F.col("user_id") % 5).cast("string")
    listed = F.concat_ws(", ", F.lit("3"), n, F.lit("1"), F.lit("3"), n, F.lit("40"), (F.col("user_id") % 5 + 2).cast("string"))
    reply = F.concat(F.lit("```json\n["), listed, F.lit("]\n```"))
    kept = qs.index_list(reply, 2 + F.col("user_id") % 6)
    return load(spark, folder, "events").select("event_id", F.array_join(kept, ",").alias("kept"))


@query(
    "f4_normalize_question",
    "SELECT conv_id, turn, md5(trim(regexp_replace(lower('  ' || text || ' ?'), '\\s+', ' ', 'g'))) AS question_md5 FROM conversations",
)
def f4(spark, folder):
    asked = F.concat(F.lit("  "), "text", F.lit(" ?"))
    return load(spark, folder, "conversations").select("conv_id", "turn", F.md5(normalize(asked).cast("binary")).alias("question_md5"))


@query(
    "f8_blank_cells",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '(blank)' WHEN 1 THEN '(blank)' ELSE c_mktsegment END AS cell FROM customer",
)
def f8(spark, folder):
    n = F.col("c_custkey") % 3
    cell = F.when(n == 1, " \t\n").when(n == 2, F.concat(F.lit(" "), "c_mktsegment", F.lit("\n")))
    return load(spark, folder, "customer").select("c_custkey", cell_text(cell).alias("cell"))


# Questions made from parts, in several phrasings.
QUESTIONS_SQL = """
asked AS (
  SELECT p_partkey AS question_id, CASE p_partkey % 8
      WHEN 0 THEN 'What is the average price in ' || p_type || '?'
      WHEN 1 THEN 'How many unique brand values are there?'
      WHEN 2 THEN 'total of size where brand = ''' || substr(p_brand, 7) || ''''
      WHEN 3 THEN 'Summarize the notes on ' || p_name || '.'
      WHEN 4 THEN 'Find the parts list and tell me the total price in ' || p_type || '.'
      WHEN 5 THEN 'Who makes the ' || p_name
      WHEN 6 THEN 'Sum of price in the ' || p_type || ' range according to the catalogue'
      ELSE 'mean kind in ' || p_type END AS question,
    p_partkey % 3 <> 0 AS has_documents, p_partkey % 5 <> 0 AS has_structured_data
  FROM part
)"""


def part_questions(spark, folder) -> DataFrame:
    part = load(spark, folder, "part")
    texts = [
        F.concat(F.lit("What is the average price in "), "p_type", F.lit("?")),
        F.lit("How many unique brand values are there?"),
        F.concat(F.lit("total of size where brand = '"), F.substring("p_brand", 7, 10), F.lit("'")),
        F.concat(F.lit("Summarize the notes on "), "p_name", F.lit(".")),
        F.concat(F.lit("Find the parts list and tell me the total price in "), "p_type", F.lit(".")),
        F.concat(F.lit("Who makes the "), "p_name"),
        F.concat(F.lit("Sum of price in the "), "p_type", F.lit(" range according to the catalogue")),
        F.concat(F.lit("mean kind in "), "p_type"),
    ]
    n = F.col("p_partkey")
    return part.select(
        n.alias("question_id"), F.element_at(F.array(*texts), (n % 8 + 1).cast("int")).alias("question"),
        (n % 3 != 0).alias("has_documents"), (n % 5 != 0).alias("has_structured_data"),
    )


ROUTE_SQL = """
routed AS (
  SELECT *, CASE WHEN question_id % 8 IN (3, 4, 6) AND has_structured_data AND has_documents THEN 'HYBRID'
    WHEN question_id % 8 <> 5 AND has_structured_data THEN 'STRUCTURED'
    WHEN has_documents THEN 'SEMANTIC' WHEN has_structured_data THEN 'STRUCTURED' ELSE 'SEMANTIC' END AS label
  FROM asked
)"""


@query("f20_route", f"WITH {QUESTIONS_SQL}, {ROUTE_SQL} SELECT question_id, label FROM routed")
def f20(spark, folder):
    asked = part_questions(spark, folder)
    return asked.select("question_id", qs.keyword_route(F.col("question"), F.col("has_documents"), F.col("has_structured_data")).alias("label"))


@query(
    "f21_route_guard",
    """WITH e AS (SELECT event_id, user_id % 3 <> 0 AS d, user_id % 4 <> 0 AS s,
  CASE event_id % 4 WHEN 0 THEN 'SEMANTIC' WHEN 1 THEN 'STRUCTURED' WHEN 2 THEN 'HYBRID' ELSE CASE WHEN user_id % 3 <> 0 THEN 'SEMANTIC' ELSE 'STRUCTURED' END END AS r FROM events),
a AS (SELECT *, CASE WHEN r = 'STRUCTURED' AND NOT s THEN CASE WHEN d THEN 'SEMANTIC' ELSE 'STRUCTURED' END ELSE r END AS r1 FROM e),
b AS (SELECT *, CASE WHEN r1 = 'SEMANTIC' AND NOT d THEN CASE WHEN s THEN 'STRUCTURED' ELSE 'SEMANTIC' END ELSE r1 END AS r2 FROM a)
SELECT event_id, CASE WHEN r2 = 'HYBRID' AND NOT (d AND s) THEN CASE WHEN s THEN 'STRUCTURED' ELSE 'SEMANTIC' END ELSE r2 END AS question_type FROM b""",
)
def f21(spark, folder):
    """Labels of unknown origin checked against what each asker has."""
    n = F.col("event_id") % 4
    label = F.when(n == 0, " semantic ").when(n == 1, "Structured").when(n == 2, "HYBRID\n").otherwise(F.col("event_type"))
    flags = (F.col("user_id") % 3 != 0, F.col("user_id") % 4 != 0)
    return load(spark, folder, "events").select("event_id", qs.guarded_route(label, *flags).alias("question_type"))


PART_COLUMNS = ["kind", "brand", "size", "price"]
INTENTS_SQL = """
intents AS (
  SELECT question_id, question,
    CASE question_id % 8 WHEN 1 THEN 'COUNT_DISTINCT' WHEN 0 THEN 'AVG' WHEN 7 THEN 'AVG' WHEN 2 THEN 'SUM' WHEN 4 THEN 'SUM' WHEN 6 THEN 'SUM' END AS aggregate,
    CASE question_id % 8 WHEN 1 THEN 'brand' WHEN 2 THEN 'size' WHEN 7 THEN 'kind' WHEN 0 THEN 'price' WHEN 4 THEN 'price' WHEN 6 THEN 'price' END AS target,
    CASE WHEN question_id % 8 IN (0, 4, 6, 7) THEN 'kind' WHEN question_id % 8 = 2 THEN 'brand' END AS filter_column,
    CASE WHEN question_id % 8 IN (0, 4, 6, 7) THEN p_type WHEN question_id % 8 = 2 THEN substr(p_brand, 7) END AS filter_value
  FROM asked JOIN part ON p_partkey = question_id
),
queries AS (
  SELECT *, CASE WHEN aggregate IS NULL THEN 'NO_QUERY' ELSE 'SELECT ' || CASE WHEN aggregate = 'COUNT_DISTINCT' THEN 'COUNT(DISTINCT "' || target || '")' ELSE aggregate || '("' || target || '")' END
    || ' FROM xlsx_parts' || CASE WHEN filter_column IS NULL THEN '' ELSE ' WHERE "' || filter_column || '" = ''' || filter_value || '''' END || ';' END AS sql
  FROM intents
)"""


@query(
    "f22_intents",
    f"WITH {QUESTIONS_SQL}, {INTENTS_SQL} SELECT question_id, aggregate, target, filter_column, filter_value, sql FROM queries",
)
def f22(spark, folder):
    columns = F.array(*[F.lit(c) for c in PART_COLUMNS])
    asked = part_questions(spark, folder).withColumn("wanted", qs.intent(F.col("question"), columns))
    return asked.select(
        "question_id", "wanted.aggregate", F.col("wanted.column").alias("target"), "wanted.filter_column", "wanted.filter_value",
        qs.intent_sql(F.col("wanted"), F.lit("xlsx_parts")).alias("sql"),
    )


def part_sheets(spark, folder, sheet_id, session_id):
    """(sheets, catalog, typed rows) made from part, one sheet per ``sheet_id``: kind, brand, size, price.

    Catalog and rows are written once, as they would be stored after ingest.
    """
    part = load(spark, folder, "part").select(
        sheet_id.alias("sheet_id"), session_id.alias("session_id"), F.col("p_partkey").alias("row_idx"),
        F.array(
            F.col("p_type"), F.concat(F.lit("B"), F.substring("p_brand", 7, 10)), F.col("p_size").cast("string"),
            F.col("p_retailprice").cast("string"),
        ).alias("cells"),
        F.array(*[F.lit(k) for k in ("string", "string", "number", "number")]).alias("cell_types"),
    )
    sizes = part.groupBy("sheet_id", "session_id").agg(F.count(F.lit(1)).alias("row_count"))
    columns = sizes.select("sheet_id", F.posexplode(F.array(*[F.lit(c) for c in PART_COLUMNS])).alias("col_idx", "column_name"))
    catalog = settle(profile.profile_columns(sheets.long_cells(spread(part)), columns, sizes.select("sheet_id", "row_count")))
    listed = sizes.select(
        "sheet_id", "session_id", F.lit("u").alias("user_id"), F.lit("parts").alias("sheet_name"),
        F.lit("xlsx_parts").alias("table_name"), F.lit("parts.csv").alias("filename"), F.lit(0).alias("sheet_order"), "row_count",
    )
    return listed, catalog, settle(sheets.typed_rows(part, catalog))


VALUES_SQL = """
answers AS (
  SELECT q.question_id, q.sql, CASE
      WHEN aggregate = 'COUNT_DISTINCT' THEN (SELECT count(DISTINCT p_brand)::VARCHAR FROM part)
      WHEN aggregate IS NULL OR target = 'kind' THEN NULL
      WHEN aggregate = 'SUM' AND target = 'size' THEN 'None'
      WHEN aggregate = 'SUM' THEN regexp_replace(regexp_replace(CAST(s.total AS VARCHAR), '0+$', ''), '\\.$', '')
      ELSE regexp_replace(regexp_replace(CAST(CAST(s.mean AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '\\.$', '') END AS value
  FROM queries q LEFT JOIN (
    SELECT p_type, sum(p_retailprice::DECIMAL(18,4)) AS total, avg(p_retailprice::DECIMAL(18,4)) AS mean FROM part GROUP BY 1
  ) s ON s.p_type = q.filter_value
)"""


@query(
    "c10_structured_answers",
    f"WITH {QUESTIONS_SQL}, {INTENTS_SQL}, {VALUES_SQL} SELECT question_id, sql, value FROM answers WHERE sql <> 'NO_QUERY'",
)
def c10(spark, folder):
    """A question per part, evaluated together over the part sheet."""
    listed, catalog, rows = part_sheets(spark, folder, F.lit("parts"), F.lit("s"))
    asked = part_questions(spark, folder).withColumn("session_id", F.lit("s"))
    found = intents.question_intents(asked, listed, catalog)
    return intents.structured_answers(found, catalog, rows).select("question_id", "sql", "value")


@query(
    "f23_extract_answer",
    """SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN source
  WHEN 1 THEN 'I couldn''t find that information in the uploaded files.'
  ELSE substr(trim(replace(text, chr(10), ' '), ' '), 1, 300) END AS answer FROM documents""",
)
def f23(spark, folder):
    """Answers read off evidence made from every document."""
    n = F.col("doc_id") % 4
    block = F.concat(F.lit("[Source: "), "source", F.lit("]\n"), "text")
    context = (
        F.when(n == 0, F.concat(block, F.lit("\n\nQuery executed: q\n\nDatabase result:\n"), "source", F.lit(" \nrest")))
        .when(n == 1, F.concat(F.lit("[Source: "), "source", F.lit("]\n\n"), "text"))
        .otherwise(block)
    )
    return load(spark, folder, "documents").select("doc_id", qs.extract_answer(context).alias("answer"))


@query(
    "f24_prompts",
    """SELECT conv_id, turn,
  md5('Route: SEMANTIC' || chr(10) || 'Found:' || chr(10) || text || chr(10) || chr(10) || 'Asked: ' || role || chr(10) || 'Reply:') AS answer_md5,
  md5('Label what is asked: SEMANTIC, STRUCTURED or HYBRID.' || chr(10) || 'Texts at hand: ' || CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END || chr(10) ||
      'Tables at hand: no' || chr(10) || 'Asked: ' || text || chr(10) || 'Label:') AS route_md5,
  md5('Asked: ' || role || chr(10) || chr(10) || '#0: ' || text || chr(10) || '#1: ' || role || chr(10) || chr(10) ||
      'Numbers of the candidates that help to reply, best first, 5 or fewer, as JSON:') AS rerank_md5,
  md5('Tables and their columns:' || chr(10) || role || chr(10) || chr(10) || 'Asked: ' || text || chr(10) ||
      'Give one SELECT over these columns for whatever they can settle, or NO_QUERY where they settle nothing.' || chr(10) || 'Statement:') AS sql_md5
FROM conversations""",
)
def f24(spark, folder):
    turns = load(spark, folder, "conversations")
    md5 = lambda c: F.md5(c.cast("binary"))
    return turns.select(
        "conv_id", "turn",
        md5(qs.answer_prompt(F.col("role"), F.col("text"), F.lit("SEMANTIC"))).alias("answer_md5"),
        md5(qs.route_prompt(F.col("text"), F.col("turn") % 2 == 0, F.lit(False))).alias("route_md5"),
        md5(qs.rerank_prompt(F.col("role"), F.array("text", "role"), 5)).alias("rerank_md5"),
        md5(qs.sql_prompt(F.col("text"), F.col("role"))).alias("sql_md5"),
    )


# Whole answers: sessions are document sources; all parts are dealt over the sheets of two sessions in three, the others have none.
ANSWERS_SQL = f"""
WITH {QUESTIONS_SQL}, {INTENTS_SQL},
sessions AS (SELECT DISTINCT source AS session_id, CAST(substr(source, 4) AS BIGINT) AS n FROM documents),
dealt AS (SELECT *, p_partkey % 20 + CASE WHEN p_partkey % 20 % 3 = 0 THEN 1 ELSE 0 END AS n FROM part),
answered AS (
  SELECT q.question_id, CASE
      WHEN aggregate = 'COUNT_DISTINCT' THEN d.brands::VARCHAR
      WHEN aggregate IS NULL OR target = 'kind' THEN NULL
      WHEN aggregate = 'SUM' AND target = 'size' THEN 'None'
      WHEN aggregate = 'SUM' THEN coalesce(regexp_replace(regexp_replace(CAST(s.total AS VARCHAR), '0+$', ''), '\\.$', ''), 'None')
      ELSE coalesce(regexp_replace(regexp_replace(CAST(CAST(s.mean AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '\\.$', ''), 'None') END AS value
  FROM queries q
  LEFT JOIN (SELECT n, count(DISTINCT p_brand) AS brands FROM dealt GROUP BY 1) d ON d.n = q.question_id % 20
  LEFT JOIN (SELECT n, p_type, sum(p_retailprice::DECIMAL(18,4)) AS total, avg(p_retailprice::DECIMAL(18,4)) AS mean FROM dealt GROUP BY 1, 2) s
    ON s.n = q.question_id % 20 AND s.p_type = q.filter_value
),
placed AS (
  SELECT q.question_id, q.question, s.session_id, s.n % 3 <> 0 AS has_tables FROM asked q JOIN sessions s ON s.session_id = 'src' || (q.question_id % 20)
),
routed AS (
  SELECT *, CASE WHEN question_id % 8 IN (3, 4, 6) AND has_tables THEN 'HYBRID'
    WHEN question_id % 8 <> 5 AND has_tables THEN 'STRUCTURED' ELSE 'SEMANTIC' END AS question_type
  FROM placed
),
reading AS (SELECT * FROM routed WHERE question_type <> 'STRUCTURED'),
{vectors_sql('dv', 'documents', 'doc_id', 'text')},
{vectors_sql('bv', 'reading', 'question_id', 'question')},
{top_k_sql('reading', 'question_id', 'documents', 'doc_id', 'bv', 'dv', 15, same="p.source = q.session_id")},
overlapped AS (
  SELECT r.question_id, r.point_id, r.rank, d.text, d.source, {overlap_sql('q.question', 'd.text')} AS overlap
  FROM ranked r JOIN documents d ON d.doc_id = r.point_id JOIN reading q ON q.question_id = r.question_id
),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, rank) AS final_rank FROM overlapped WHERE overlap > 0) WHERE final_rank <= 5),
passages AS (
  SELECT question_id, count(*) AS cited, arg_min(text, final_rank) AS first_text FROM kept GROUP BY 1
),
final AS (
  SELECT r.question_id, r.question_type, coalesce(p.cited, 0) AS cited, p.first_text,
         CASE WHEN r.question_type <> 'SEMANTIC' THEN a.value END AS value
  FROM routed r LEFT JOIN passages p USING (question_id) LEFT JOIN answered a USING (question_id)
)
SELECT question_id, question_type, (cited + CASE WHEN value IS NULL THEN 0 ELSE 1 END)::BIGINT AS sources,
  CASE WHEN value IS NOT NULL THEN value WHEN first_text IS NOT NULL THEN substr(trim(replace(first_text, chr(10), ' '), ' '), 1, 300)
       ELSE 'I couldn''t find that information in the uploaded files.' END AS answer
FROM final"""


@query("c11_answers", ANSWERS_SQL)
def c11(spark, folder):
    """A question per part, routed and answered from its session's documents and sheet."""
    owner = F.lit("u")
    chunks = whole_documents(spark, folder).select("*", owner.alias("user_id"), F.col("source").alias("session_id")).drop("source")
    sessions = load(spark, folder, "documents").select(F.col("source").alias("session_id")).distinct()
    files = load(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("session_id"), F.lit("txt").alias("file_type"), F.lit("ready").alias("status")
    )
    number = F.col("p_partkey") % 20
    session = F.concat(F.lit("src"), (number + F.when(number % 3 == 0, 1).otherwise(0)).cast("string"))
    listed, catalog, rows = part_sheets(spark, folder, F.concat(session, F.lit("/parts")), session)
    asked = part_questions(spark, folder).select(
        "question_id", "question", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")).alias("session_id"), owner.alias("user_id")
    )
    data = Collections(chunks, files, listed, catalog, rows)
    answered = answer_questions(asked.join(sessions, "session_id", "left_semi"), data)
    return answered.select("question_id", "question_type", long(F.size("sources")).alias("sources"), "answer")


@query(
    "d1_embedding_plugin",
    "SELECT doc_id, 2::BIGINT AS dim, round(length(text)::DOUBLE, 3) AS first, round((length(text) - length(replace(text, chr(10), '')))::DOUBLE, 3) AS second FROM documents",
)
def d1(spark, folder):
    """A batch embedding function plugged in for the hashed one."""
    provider = embedding_provider(lambda texts: [[float(len(t)), float(t.count("\n"))] for t in texts], dim=2)
    docs = embed(load(spark, folder, "documents").select("doc_id", "text"), provider=provider)
    return docs.select(
        "doc_id", long(F.size("vector")).alias("dim"), F.round(double(F.col("vector")[0]), 3).alias("first"), F.round(double(F.col("vector")[1]), 3).alias("second")
    )


@query(
    "d2_scorer_plugin",
    """SELECT conv_id AS question_id, turn, r::BIGINT AS final_rank FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations WHERE length(text) >= 100
) WHERE r <= 5""",
)
def d2(spark, folder):
    """A batch pair scorer plugged into the reranker: longer turns count as more relevant."""
    turns = load(spark, folder, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn"), F.col("turn").alias("rank"), F.col("role").alias("question"), "text")
    scorer = relevance_scorer(lambda pairs: [len(passage) for _, passage in pairs])
    kept = rerank_by_model(turns, scorer, min_score=100)
    return kept.select("question_id", "turn", long("final_rank").alias("final_rank"))


@query(
    "d2_failing_scorer",
    """WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, bool_or(length(text) % 11 = 3) OVER (PARTITION BY conv_id) AS failed FROM conversations)
SELECT conv_id AS question_id, turn, r::BIGINT AS final_rank FROM (
  SELECT conv_id, turn, failed, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN NOT failed THEN length(text) END DESC NULLS LAST, turn) AS r FROM n
) WHERE r <= 5 AND (failed OR size >= 100)""",
)
def d2_failing(spark, folder):
    """A scorer that raises on some passages: their questions keep the order of retrieval, all others are reranked."""
    turns = load(spark, folder, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn"), F.col("turn").alias("rank"), F.col("role").alias("question"), "text")

    def score(pairs):
        if any(len(passage) % 11 == 3 for _, passage in pairs):
            raise RuntimeError("no score")
        return [len(passage) for _, passage in pairs]

    kept = rerank_by_model(turns, relevance_scorer(score, attempts=1), min_score=100)
    return kept.select("question_id", "turn", long("final_rank").alias("final_rank"))


@query(
    "d3_generator_plugin",
    "SELECT conv_id, turn, length('Route: SEMANTIC' || chr(10) || 'Found:' || chr(10) || text || chr(10) || chr(10) || 'Asked: ' || role || chr(10) || 'Reply:')::VARCHAR AS reply FROM conversations",
)
def d3(spark, folder):
    """A batch text generator fed with the answer prompt."""
    generate = text_generator(lambda prompts: [str(len(p)) for p in prompts])
    prompt = qs.answer_prompt(F.col("role"), F.col("text"), F.lit("SEMANTIC"))
    return load(spark, folder, "conversations").select("conv_id", "turn", generate(prompt).alias("reply"))
