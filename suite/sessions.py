"""Files, sessions, messages, points: listing, scoping, roll-ups, purge, sinks, incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.operators import lifecycle as lc
from citewise.operators.search import embed
from citewise.plans.materialize import shared_path
from citewise.sources import files as fl
from citewise.sources import stores as st
from citewise.sources import tables as tb
from citewise.streaming.ingest import ingest_stream
from citewise.streaming.ledger import committed, statuses
from suite.common import TABLES, Registry, load, long, spread
from suite.documents import chunks_sql

query = Registry()
Q, SQL = query.queries, query.sql

# A listing of uploads made from documents: eight endings, sizes that pass and fail the gate.
FILES_SQL = """
uploads AS (
  SELECT doc_id AS file_id, source AS session_id, lang,
    source || '/' || CASE doc_id % 9 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.docx' WHEN 2 THEN 'c.pptx' WHEN 3 THEN 'd.txt' WHEN 4 THEN 'e.xlsx'
      WHEN 5 THEN 'f.csv' WHEN 6 THEN 'g.exe' WHEN 7 THEN 'noending' ELSE '.hidden' END AS filename,
    n_chars * 4000 AS size_bytes
  FROM documents
),
classified AS (
  SELECT *, CASE doc_kind WHEN 7 THEN '' WHEN 8 THEN '' ELSE lower(regexp_extract(filename, '\\.([a-zA-Z]+)$', 1)) END AS file_type,
    CASE WHEN doc_kind < 4 THEN 'document' WHEN doc_kind < 6 THEN 'sheet' END AS category
  FROM (SELECT *, file_id % 9 AS doc_kind FROM uploads)
)"""


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    endings = ["a.PDF", "b.docx", "c.pptx", "d.txt", "e.xlsx", "f.csv", "g.exe", "noending", ".hidden"]
    name = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % 9 + 1).cast("int"))
    return load(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("session_id"), "lang",
        F.concat("source", F.lit("/"), name).alias("filename"), (F.col("n_chars") * 4000).alias("size_bytes"),
    )


@query("s4_file_types", f"WITH {FILES_SQL} SELECT file_id, file_type, category FROM classified")
def s4(spark, folder):
    return fl.classify_files(uploads(spark, folder)).select("file_id", "file_type", "category")


@query(
    "s5_size_gate",
    f"WITH {FILES_SQL} SELECT file_id, CASE WHEN size_bytes > 50 * 1024 * 1024 THEN 'too_large' WHEN category IS NULL THEN 'unsupported_type' ELSE 'accepted' END AS outcome FROM classified",
)
def s5(spark, folder):
    return fl.classify_files(uploads(spark, folder)).select("file_id", F.coalesce("rejection", F.lit("accepted")).alias("outcome"))


STATUS_SQL = f"""{FILES_SQL},
accepted AS (SELECT * FROM classified WHERE category IS NOT NULL AND size_bytes <= 50 * 1024 * 1024),
produced AS (SELECT doc_id AS file_id, count(*) AS n FROM labels GROUP BY 1),
status AS (
  SELECT a.*, coalesce(p.n, 0) AS n, CASE WHEN a.file_id % 10 = 3 THEN 'broken file' WHEN p.n IS NULL AND category = 'document' THEN 'text' WHEN p.n IS NULL THEN 'rows' END AS problem
  FROM accepted a LEFT JOIN produced p USING (file_id)
)"""


def file_status(spark, folder) -> DataFrame:
    produced = load(spark, folder, "labels").groupBy(F.col("doc_id").alias("file_id")).agg(F.count(F.lit(1)).alias("produced"))
    accepted = fl.accepted_files(uploads(spark, folder))
    errors = accepted.filter(F.col("file_id") % 10 == 3).select("file_id", F.lit("broken file").alias("error"))
    return tb.ingest_status(accepted, produced, errors)


@query(
    "s10_ingest_status",
    f"""WITH {STATUS_SQL}
SELECT file_id, n::BIGINT AS produced, CASE WHEN problem IS NULL THEN 'ready' ELSE 'failed' END AS status, CASE problem WHEN 'broken file' THEN 'broken'
  WHEN 'text' THEN 'The document holds ' WHEN 'rows' THEN 'The sheet holds no ' END AS message FROM status""",
)
def s10(spark, folder):
    status = file_status(spark, folder)
    message = (
        F.when(F.col("error_message") == "broken file", "broken")
        .when(F.col("error_message").startswith("No data"), F.substring("error_message", 1, 19)).otherwise(F.substring("error_message", 1, 19))
    )
    return status.select("file_id", "produced", "status", message.alias("message"))


@query(
    "p3_ready_documents",
    f"WITH {STATUS_SQL} SELECT file_id, file_type FROM status WHERE problem IS NULL AND category = 'document'",
)
def p3(spark, folder):
    return lc.ready_documents(file_status(spark, folder)).select("file_id", "file_type")


@query(
    "a8_session_flags",
    f"""WITH {STATUS_SQL}
SELECT s.source AS session_id, coalesce(bool_or(problem IS NULL AND category = 'document'), FALSE) AS has_documents,
  (SELECT count(*) > 0 FROM labels l JOIN documents d USING (doc_id) WHERE d.source = s.source) AS has_structured_data
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN status f ON f.session_id = s.source GROUP BY 1""",
)
def a8(spark, folder):
    """Which sessions have ready documents and sheets, with rows or without; a labelled document stands for a sheet."""
    documents = load(spark, folder, "documents")
    sheets = load(spark, folder, "labels").join(documents, "doc_id").select(
        F.col("source").alias("session_id"), (F.col("quality") * F.col("toxic")).alias("row_count")
    )
    flags = lc.session_flags(file_status(spark, folder), sheets)
    sessions = documents.select(F.col("source").alias("session_id")).distinct().join(flags, "session_id", "left")
    return sessions.select(
        "session_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_documents", "has_structured_data")]
    )


@query(
    "p1_tenant_filter",
    "SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'click'",
)
def p1(spark, folder):
    """One tenant's rows of one type; the equality filters reach the scan."""
    points = load(spark, folder, "events").select(
        "event_id", "value", F.col("user_id"), F.col("event_type").alias("content_type"), F.col("user_id").alias("session_id")
    )
    return lc.tenant_filter(points, 7, 7, "click").select("event_id", "value")


@query(
    "p2_payload_json",
    """SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN lang = 'de' THEN '' ELSE ',"lang":"' || lang || '"' END || ',"source":"' || source || '"}' AS payload FROM documents""",
)
def p2(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), "source")
    return docs.select("doc_id", tb.payload_json(["doc_id", "lang", "source"]).alias("payload"))


TURNS_SQL = """
asked AS (SELECT conv_id * 1000 + turn AS question_id, conv_id AS session_id, length(text) AS n FROM conversations WHERE role = 'user'),
sheets AS (SELECT conv_id * 1000 + turn AS sheet_id, conv_id AS session_id FROM conversations WHERE role <> 'user'),
found AS (SELECT question_id, question_id + 1 AS sheet_id FROM asked WHERE n % 3 = 0)"""


@query(
    "p7_sheets_in_scope",
    f"""WITH {TURNS_SQL}
SELECT a.question_id, s.sheet_id FROM asked a JOIN sheets s USING (session_id)
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.question_id = a.question_id)
   OR EXISTS (SELECT 1 FROM found f WHERE f.question_id = a.question_id AND f.sheet_id = s.sheet_id)""",
)
def p7(spark, folder):
    """Discovered sheets narrow a question's scope; without any, all sheets of its session count."""
    turns = load(spark, folder, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = turns.filter(F.col("role") == "user").select(F.col("id").alias("question_id"), F.col("conv_id").alias("session_id"), "text")
    sheets = turns.filter(F.col("role") != "user").select(F.col("id").alias("sheet_id"), F.col("conv_id").alias("session_id"))
    found = asked.filter(F.length("text") % 3 == 0).select("question_id", (F.col("question_id") + 1).alias("sheet_id"))
    return lc.sheets_in_scope(asked, sheets, found).select("question_id", "sheet_id")


@query(
    "p11_owned_requests",
    "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = o.o_orderkey % 25)",
)
def p11(spark, folder):
    """Orders as requests: kept when the asking nation owns the customer."""
    requests = load(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 25).cast("int").alias("user_id"), F.col("o_custkey").alias("session_id")
    )
    owners = load(spark, folder, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("session_id"))
    return lc.owned_requests(requests, owners).select("o_orderkey")


@query(
    "j3_session_rollup",
    """SELECT c.c_custkey AS session_id, c.c_name AS title,
  (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey)::BIGINT AS files,
  (SELECT count(*) FROM documents d WHERE d.doc_id = c.c_custkey)::BIGINT AS sheets,
  (SELECT count(*) FROM events e WHERE e.user_id = c.c_custkey)::BIGINT AS messages
FROM customer c""",
)
def j3(spark, folder):
    """Customers as sessions with counts of three owned tables."""
    sessions = load(spark, folder, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title"))
    owned = lambda t, k: load(spark, folder, t).select(F.col(k).alias("session_id"))
    return lc.session_rollup(sessions, owned("orders", "o_custkey"), owned("documents", "doc_id"), owned("events", "user_id"))


@query(
    "j4_catalog_load",
    """SELECT p.p_partkey AS sheet_id, s.s_name AS filename, l.k AS col_idx, l.q AS column_name
FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey % 150
LEFT JOIN (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS k, min(l_returnflag) AS q FROM lineitem GROUP BY 1, 2) l ON l.l_partkey = p.p_partkey""",
)
def j4(spark, folder):
    """Parts as sheets, order lines as their columns, suppliers as workbooks (some missing)."""
    sheets = load(spark, folder, "part").select(F.col("p_partkey").alias("sheet_id"), (F.col("p_partkey") % 150).alias("workbook_id"))
    lines = load(spark, folder, "lineitem").groupBy(
        F.col("l_partkey").alias("sheet_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("col_idx")
    ).agg(F.min("l_returnflag").alias("column_name"))
    columns = lines.withColumn("physical_name", F.col("column_name")).withColumn("data_type", F.lit("TEXT"))
    workbooks = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("workbook_id"), F.col("s_name").alias("filename"))
    return lc.catalog_with_columns(sheets, columns, workbooks).select("sheet_id", "filename", "col_idx", "column_name")


@query(
    "j5_owned_tables",
    r"""SELECT o_orderkey AS sheet_id, 'user' || CASE WHEN c_nationkey % 2 = 0 THEN '_' ELSE 'x' END || c_nationkey AS user_id
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE 'user' || CASE WHEN c_nationkey % 2 = 0 THEN '_' ELSE 'x' END || c_nationkey LIKE 'user\_%' ESCAPE '\'""",
)
def j5(spark, folder):
    mark = F.when(F.col("c_nationkey") % 2 == 0, "_").otherwise("x")
    sessions = load(spark, folder, "customer").select(
        F.col("c_custkey").alias("session_id"), F.concat(F.lit("user"), mark, F.col("c_nationkey").cast("string")).alias("user_id")
    )
    sheets = load(spark, folder, "orders").select(F.col("o_orderkey").alias("sheet_id"), F.col("o_custkey").alias("session_id"))
    return lc.owned_tables(sheets, sessions, "user_").select("sheet_id", "user_id")


@query(
    "j9_purge",
    """WITH gone AS (SELECT source FROM documents GROUP BY 1 HAVING sum(n_chars) % 2 = 0),
kept AS (SELECT * FROM documents WHERE source NOT IN (SELECT source FROM gone))
SELECT 'documents' AS table_name, source AS session_id, count(*)::BIGINT AS n FROM kept GROUP BY 2
UNION ALL SELECT 'labels', source, count(*) FROM labels JOIN kept USING (doc_id) GROUP BY 2""",
)
def j9(spark, folder):
    """Sessions (sources) with an even number of characters are purged from two tables."""
    documents = load(spark, folder, "documents").withColumnRenamed("source", "session_id")
    labels = load(spark, folder, "labels").join(documents.select("doc_id", "session_id"), "doc_id")
    gone = documents.groupBy("session_id").agg(F.sum("n_chars").alias("n")).filter(F.col("n") % 2 == 0)
    kept = lc.purge({"documents": documents, "labels": labels}, gone)
    counts = [t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "session_id", "n") for n, t in kept.items()]
    return counts[0].unionByName(counts[1])


@query(
    "c12_purge_sessions",
    """WITH s AS (SELECT c_custkey AS session_id, c_nationkey AS user_id FROM customer),
req AS (SELECT DISTINCT user_id, event_id % 1500 AS session_id FROM events),
owned AS (SELECT s.session_id FROM s JOIN req ON req.session_id = s.session_id AND req.user_id = s.user_id)
SELECT (SELECT count(*) FROM s WHERE session_id NOT IN (SELECT session_id FROM owned))::BIGINT AS sessions,
       (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT session_id FROM owned))::BIGINT AS files""",
)
def c12(spark, folder):
    """Deletion requests from the event stream; only the owner's take effect, the rest change nothing."""
    sessions = load(spark, folder, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").cast("bigint").alias("user_id"))
    requests = load(spark, folder, "events").select("user_id", (F.col("event_id") % 1500).alias("session_id"))
    files = load(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("session_id"))
    left = lc.purge_sessions({"files": files}, sessions, requests)
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    both = counts[0].unionByName(counts[1])
    return both.agg(
        F.max(F.when(F.col("name") == "sessions", F.col("n"))).alias("sessions"), F.max(F.when(F.col("name") == "files", F.col("n"))).alias("files")
    )


OWNED = st.Layout(("session_id",), ("session_id", "doc_id"), ("doc_id",), places=16, parts=4)


@query(
    "j9_stored_purge",
    """WITH gone AS (SELECT source FROM documents GROUP BY 1 HAVING sum(n_chars) % 2 = 0 UNION ALL SELECT 'nobody'),
kept AS (SELECT * FROM documents WHERE source NOT IN (SELECT source FROM gone))
SELECT 'documents' AS table_name, source AS session_id, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS total, 0::BIGINT AS changed_again FROM kept GROUP BY 2
UNION ALL SELECT 'labels', source, count(*), sum(quality), 0 FROM labels JOIN kept USING (doc_id) GROUP BY 2""",
)
def j9_stored(spark, folder):
    """Stored tables after the purge of the sessions with an even number of characters; a second purge changes nothing."""
    documents = load(spark, folder, "documents").select("doc_id", F.col("source").alias("session_id"), F.col("n_chars").alias("value"))
    labels = load(spark, folder, "labels").join(documents.select("doc_id", "session_id"), "doc_id").select("doc_id", "session_id", F.col("quality").cast("bigint").alias("value"))
    gone = documents.groupBy("session_id").agg(F.sum("value").alias("n")).filter(F.col("n") % 2 == 0).select("session_id")
    gone = gone.unionByName(spark.range(1).select(F.lit("nobody").alias("session_id")))
    counts = []
    for name, table in (("documents", documents), ("labels", labels)):
        path = shared_path(spark, f"owned-{name}")
        st.replace_units(table, path, OWNED)
        st.remove_owners(spark, path, OWNED, gone)
        again = st.remove_owners(spark, path, OWNED, gone)
        rows = st.stored(spark, path).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        counts.append(rows.select(F.lit(name).alias("table_name"), "session_id", "n", "total", F.lit(again).cast("bigint").alias("changed_again")))
    return counts[0].unionByName(counts[1])


@query(
    "c12_stored_purge",
    """WITH s AS (SELECT c_custkey AS session_id, c_nationkey AS user_id FROM customer),
req AS (SELECT DISTINCT user_id, event_id % 1500 AS session_id FROM events),
owned AS (SELECT s.session_id FROM s JOIN req ON req.session_id = s.session_id AND req.user_id = s.user_id)
SELECT o_orderpriority AS kind, count(*)::BIGINT AS files, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey NOT IN (SELECT session_id FROM owned) GROUP BY 1""",
)
def c12_stored(spark, folder):
    """Orders as stored files of customers; deletion requests by their owners take the rows off the disk."""
    sessions = load(spark, folder, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").cast("bigint").alias("user_id"))
    requests = load(spark, folder, "events").select("user_id", (F.col("event_id") % 1500).alias("session_id"))
    files = load(spark, folder, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("doc_id"), "o_orderpriority", "o_totalprice")
    path = shared_path(spark, "owned-files")
    st.replace_units(files, path, OWNED)
    st.remove_owners(spark, path, OWNED, lc.owned_requests(requests, sessions))
    left = st.stored(spark, path).groupBy(F.col("o_orderpriority").alias("kind"))
    return left.agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "j10_get_or_create",
    "SELECT c_name AS user_id FROM customer UNION SELECT DISTINCT 'Customer#' || lpad((user_id * 37)::VARCHAR, 9, '0') FROM events WHERE event_id % 13 <> 0",
)
def j10(spark, folder):
    """Customer names as known users; events ask for padded, blank and unknown ones."""
    users = load(spark, folder, "customer").select(F.col("c_name").alias("user_id"))
    name = F.concat(F.lit(" Customer#"), F.lpad((F.col("user_id") * 37).cast("string"), 9, "0"), F.lit("\t"))
    wanted = load(spark, folder, "events").select(F.when(F.col("event_id") % 13 == 0, "  ").otherwise(name).alias("asked"))
    return lc.get_or_create_users(users, "asked", wanted)


@query(
    "a6_point_stats",
    "SELECT 'all' AS content_type, count(*)::BIGINT AS points FROM documents UNION ALL "
    "SELECT 'document_chunk', count(*) FROM documents WHERE lang <> 'de' UNION ALL SELECT 'excel_sheet', count(*) FROM documents WHERE lang = 'de'",
)
def a6(spark, folder):
    kind = F.when(F.col("lang") == "de", "excel_sheet").otherwise("document_chunk")
    return lc.point_stats(load(spark, folder, "documents").select(kind.alias("content_type")))


@query(
    "a7_table_counts",
    " UNION ALL ".join(
        f"SELECT '{'xlsx_' if t in ('part', 'orders') else ''}{t}' AS table_name, '{'sheet' if t in ('part', 'orders') else 'app'}' AS table_group, count(*)::BIGINT AS rows FROM {t}"
        for t in TABLES
    ),
)
def a7(spark, folder):
    return lc.table_counts({("xlsx_" if t in ("part", "orders") else "") + t: load(spark, folder, t) for t in TABLES})


@query(
    "s12_catalog_listing",
    "SELECT CASE WHEN table_name IN ('part', 'orders') THEN 'xlsx_' || table_name ELSE table_name END AS table_name, "
    "CASE WHEN table_name IN ('part', 'orders') THEN 'sheet' ELSE 'app' END AS table_group, column_name "
    f"FROM information_schema.columns WHERE table_name IN {TABLES}",
)
def s12(spark, folder):
    """Tables and columns of the session catalog."""
    for name in TABLES:
        load(spark, folder, name).createOrReplaceTempView(("xlsx_" if name in ("part", "orders") else "") + name)
    names = ["xlsx_" + n if n in ("part", "orders") else n for n in TABLES]
    return lc.table_listing(spark).filter(F.col("table_name").isin(names)).select("table_name", "table_group", "column_name")


# Sessions are users; a session may read the tables of its own number and the two behind it. Every event is a logged query.
LOGGED_SQL = """
log AS (
  SELECT event_id AS query_id, user_id % 40 AS session_id, CASE WHEN event_type = 'purchase' THEN 'insert' WHEN event_id % 97 = 0 THEN NULL ELSE 'select' END AS kind,
    ['t' || (event_id % 43), 't' || (user_id % 40), 't' || (event_id % 43)] AS tables, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 END AS asked_rows
  FROM events),
allowed AS (SELECT DISTINCT user_id % 40 AS session_id, unnest(['t' || (user_id % 40), 't' || (user_id % 40 + 1), 't' || (user_id % 40 + 2)]) AS table_name FROM events),
outside AS (
  SELECT query_id, string_agg(table_name, ',' ORDER BY table_name) AS outside
  FROM (SELECT DISTINCT query_id, session_id, unnest(tables) AS table_name FROM log) r
  WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.session_id = r.session_id AND a.table_name = r.table_name) GROUP BY 1)"""


def logged_queries(spark, folder) -> tuple[DataFrame, DataFrame]:
    events = load(spark, folder, "events").withColumn("session_id", F.col("user_id") % 40)
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    kind = F.when(F.col("event_type") == "purchase", "insert").when(F.col("event_id") % 97 != 0, "select")
    log = events.select(
        F.col("event_id").alias("query_id"), "session_id", kind.alias("kind"),
        F.array(name(F.col("event_id") % 43), name(F.col("session_id")), name(F.col("event_id") % 43)).alias("tables"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 1000).alias("asked_rows"),
    )
    own = F.explode(F.array(*[name(F.col("session_id") + i) for i in range(3)]))
    return log, events.select("session_id", own.alias("table_name"))


@query("j8_logged_tables", f"WITH {LOGGED_SQL} SELECT query_id, outside FROM outside")
def j8_logged(spark, folder):
    """Tables that logged queries read beyond their session's."""
    return lc.outside_tables(*logged_queries(spark, folder)).select("query_id", F.array_join("outside", ",").alias("outside"))


@query(
    "c13_logged_audit",
    f"""WITH {LOGGED_SQL},
judged AS (SELECT l.*, CASE WHEN kind IS DISTINCT FROM 'select' THEN 'not_select' WHEN o.outside IS NOT NULL THEN 'out_of_scope' WHEN asked_rows > 500 THEN 'capped' ELSE 'ok' END AS verdict
  FROM log l LEFT JOIN outside o USING (query_id))
SELECT query_id, verdict, CASE WHEN verdict IN ('ok', 'capped') THEN least(coalesce(asked_rows, 500), 500) END::BIGINT AS row_limit FROM judged""",
)
def c13_logged(spark, folder):
    """Every logged query judged by what the guard noted of it."""
    return lc.audit_log(*logged_queries(spark, folder), 500).select("query_id", "verdict", "row_limit")


@query(
    "t2_newest_sessions",
    "SELECT c.c_nationkey AS user_id, o.o_orderkey AS session_id, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY o_orderdate DESC, o_orderkey)::BIGINT AS position "
    "FROM orders o JOIN customer c ON o_custkey = c_custkey",
)
def t2(spark, folder):
    owners = load(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("user_id"))
    sessions = load(spark, folder, "orders").join(owners, "o_custkey").select(
        "user_id", F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("created_at")
    )
    return lc.newest_per_user(sessions).select("user_id", "session_id", long("position").alias("position"))


@query("t3_chronological", "SELECT event_id, user_id AS session_id, ts AS created_at FROM events ORDER BY ts")
def t3(spark, folder):
    rows = load(spark, folder, "events").select("event_id", F.col("ts").alias("created_at"), F.col("user_id").alias("session_id"))
    return lc.chronological(rows).select("event_id", "session_id", "created_at")


@query("t6_sample_rows", "SELECT least(count(*), 20)::BIGINT AS n FROM lineitem")
def t6(spark, folder):
    return lc.sample_rows(load(spark, folder, "lineitem")).agg(F.count(F.lit(1)).alias("n"))


@query("s8_scroll_points", "SELECT least(count(*), 500)::BIGINT AS n, 2::BIGINT AS fields FROM embeddings")
def s8(spark, folder):
    """At most 500 payloads, without vectors."""
    points = load(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")
    page = lc.scroll_points(points)
    return page.agg(F.count(F.lit(1)).alias("n"), F.lit(len(page.columns)).cast("bigint").alias("fields"))


def whole_points(spark, folder):
    """Documents as one point each, embedded on all cores before they are stored."""
    docs = spread(load(spark, folder, "documents")).select(
        F.lit("u").alias("user_id"), F.col("source").alias("session_id"), "doc_id", F.col("doc_id").alias("chunk_id"), "text"
    )
    return tb.as_points(embed(docs))


@query(
    "s7_replaced_points",
    """SELECT source AS session_id, doc_id, CASE WHEN lang = 'en' THEN upper(source) ELSE md5(text) END AS held, 1::BIGINT AS points FROM documents""",
)
def s7_replaced(spark, folder):
    """All documents stored, the same again, then the English ones with other texts: the newest write of each is left."""
    path = shared_path(spark, "points-again")
    points = whole_points(spark, folder).drop("vector")
    st.replace_units(points, path, st.POINTS)
    st.replace_units(points, path, st.POINTS)
    english = load(spark, folder, "documents").filter(F.col("lang") == "en").select("doc_id")
    changed = points.join(english, "doc_id", "left_semi").withColumn("text", F.upper("session_id"))
    st.replace_units(changed, path, st.POINTS)
    stored = st.stored(spark, path)
    held = F.when(F.col("text") == F.upper("session_id"), F.col("text")).otherwise(F.md5(F.col("text").cast("binary")))
    return stored.groupBy("session_id", "doc_id", held.alias("held")).agg(F.count(F.lit(1)).alias("points"))


@query(
    "s7_point_write",
    """SELECT source AS session_id, count(*)::BIGINT AS points, 384::BIGINT AS dim,
sum(CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 THEN 1 ELSE 0 END)::BIGINT AS non_zero FROM documents GROUP BY 1""",
)
def s7(spark, folder):
    """Documents with vectors stored in a point table and read back."""
    path = shared_path(spark, "points")
    st.replace_units(whole_points(spark, folder), path, st.POINTS)
    stored = st.stored(spark, path)
    non_zero = F.exists("vector", lambda x: x != 0)
    return stored.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("points"), long(F.max(F.size("vector"))).alias("dim"), F.sum(non_zero.cast("bigint")).alias("non_zero")
    )


@query(
    "s9_message_log",
    """WITH a AS (SELECT q.conv_id, q.turn, q.text AS question, r.text AS answer FROM conversations q JOIN conversations r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 WHERE q.role = 'user')
SELECT conv_id, turn, 'user' AS role, md5(question) AS content_md5, NULL AS question_type FROM a
UNION ALL SELECT conv_id, turn, 'assistant', md5(answer), 'SEMANTIC' FROM a""",
)
def s9(spark, folder):
    """Each user turn and its reply as two message rows, appended and read back."""
    turns = load(spark, folder, "conversations")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    answers = turns.filter(F.col("role") == "user").join(replies, ["conv_id", "turn"]).select(
        F.lit("u").alias("user_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("question_id"),
        F.col("text").alias("question"), "answer", F.lit("SEMANTIC").alias("question_type"),
        F.array(F.struct(F.lit("x").alias("filename"))).alias("sources"),
    )
    path = shared_path(spark, "messages")
    tb.append_messages(answers, path)
    stored = spark.read.parquet(path)
    return stored.select(
        F.col("session_id").alias("conv_id"), F.col("question_id").alias("turn"), "role", F.md5(F.col("content").cast("binary")).alias("content_md5"), "question_type"
    )


@query(
    "s10_ingest_ledger",
    r"""WITH judged AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'broken file' WHEN regexp_full_match(coalesce(text, ''), '[ \t\n\r\f\v]*') THEN 'The document holds' END AS problem FROM documents)
SELECT doc_id::VARCHAR AS file_id, CASE WHEN problem IS NULL THEN 'ready' ELSE 'failed' END AS status, coalesce(problem, '') AS message, problem IS NULL AS visible FROM judged""",
)
def s10_ledger(spark, folder):
    """Documents ingested as a stream with a ledger: the state of each, and whether readers see its chunks."""
    target, state, inbox, ledger = (shared_path(spark, n) for n in ("ledger-points", "ledger-state", "ledger-inbox", "ledger"))
    documents = load(spark, folder, "documents").select("doc_id", "text", "source")
    documents.repartition(4, "doc_id").write.parquet(inbox)
    broken = F.when(F.col("doc_id") % 10 == 3, "broken file")
    ingest_stream(spark, inbox, documents.schema, target, state, lambda df: df.withColumn("error", broken), dim=16, files_per_batch=2, ledger=ledger)
    seen = committed(spark.read.parquet(target), spark, ledger).select(F.col("doc_id").cast("string").alias("file_id"), F.lit(True).alias("seen")).distinct()
    message = F.when(F.col("error_message").startswith("The document holds"), "The document holds").otherwise(F.coalesce("error_message", F.lit("")))
    told = statuses(spark, ledger, documents.select(F.col("doc_id").alias("file_id")))
    return told.join(seen, "file_id", "left").select("file_id", "status", message.alias("message"), F.coalesce("seen", F.lit(False)).alias("visible"))


@query("s11_stream_ingest", f"WITH RECURSIVE {chunks_sql()} SELECT doc_id, count(*)::BIGINT AS chunks, count(DISTINCT chunk)::BIGINT AS texts, sum(length(chunk))::BIGINT AS chars FROM chunks GROUP BY 1")
def s11(spark, folder):
    """The whole corpus ingested as a stream in several batches; the stored chunks of every document."""
    schema = load(spark, folder, "documents").schema
    target, state, inbox = (shared_path(spark, n) for n in ("stream-points", "stream-state", "stream-inbox"))
    load(spark, folder, "documents").repartition(4, "doc_id").write.parquet(inbox)
    ingest_stream(spark, inbox, schema, target, state, lambda df: df.select("doc_id", "text", "source"), files_per_batch=2)
    return spark.read.parquet(target).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("text").alias("texts"), F.sum(F.length("text")).alias("chars")
    )
