"""Sheet grids, column profiles, catalog texts, sheet discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions import names as nm
from citewise.functions import values as vl
from citewise.functions.text import let
from citewise.operators import lifecycle, profile, sheets
from citewise.plans.answers import discover_sheets
from citewise.plans.materialize import settle, shared_path
from citewise.plans.scans import number_rows
from citewise.sources.files import read_csv_grids, read_sheet_grids
from citewise.sources.sheet_store import column_totals, read_sheets, stored_columns, write_sheets
from suite.common import Registry, load, long, spread, top_k_sql, vectors_sql

query = Registry()
Q, SQL = query.queries, query.sql

# One sheet per nation: even nations carry a banner and a blank row above the header; every sheet ends in a footnote,
# every 50th customer leaves an empty row, every 7th leaves the segment blank.
GRID_SQL = """
customers AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n,
         CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 0 END AS header_row
  FROM customer
),
grid AS (
  SELECT c_nationkey, header_row, header_row + 1 + n AS row_idx,
         CASE WHEN c_custkey % 50 = 0 THEN [NULL, NULL, NULL, NULL]
              ELSE [c_custkey::VARCHAR, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END, c_acctbal::VARCHAR] END AS cells,
         c_custkey % 50 <> 0 AS filled
  FROM customers
)"""

TEXT4 = ["string"] * 4


def nation_grids(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of the per-nation customer sheets."""
    customer = load(spark, folder, "customer")
    header_row = F.when(F.col("c_nationkey") % 2 == 0, 2).otherwise(0)
    sheet_id = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))
    texts = F.array(*[F.lit(t) for t in TEXT4])
    blank = F.array(*[F.lit(None).cast("string")] * 4)
    cells = F.array(
        F.col("c_custkey").cast("string"), F.col("c_name"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")), F.col("c_acctbal").cast("string"),
    )
    body = number_rows(customer, ["c_nationkey"], ["c_custkey"], "n").select(
        sheet_id.alias("sheet_id"), (header_row + 1 + F.col("n")).cast("bigint").alias("row_idx"),
        F.when(F.col("c_custkey") % 50 == 0, blank).otherwise(cells).alias("cells"),
        F.array(F.lit("number"), F.lit("string"), F.lit("string"), F.lit("number")).alias("cell_types"),
    )
    sizes = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    one = lambda *texts_: F.array(*[F.lit(t).cast("string") for t in texts_])
    extra = F.array(
        F.struct(F.when(header_row == 2, 0).cast("bigint").alias("row_idx"), one("Customer report", None, None, None).alias("cells")),
        F.struct(F.when(header_row == 2, 1).cast("bigint").alias("row_idx"), blank.alias("cells")),
        F.struct(header_row.cast("bigint").alias("row_idx"), one("Cust Key", "Name", None, "Acct Bal").alias("cells")),
        F.struct((header_row + 1 + F.col("n")).cast("bigint").alias("row_idx"), one("Note: unaudited", None, None, None).alias("cells")),
    )
    framing = sizes.select(sheet_id.alias("sheet_id"), F.inline(extra)).filter(F.col("row_idx").isNotNull())
    return body.unionByName(framing.withColumn("cell_types", texts))


@query(
    "w1_header_detect",
    "SELECT DISTINCT 'nation_' || c_nationkey AS sheet_id, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS header_row, "
    "'Cust Key|Name|column_2|Acct Bal' AS names FROM customer",
)
def w1(spark, folder):
    found = sheets.detect_headers(nation_grids(spark, folder))
    return found.select("sheet_id", long("header_row").alias("header_row"), F.array_join("names", "|").alias("names"))


@query(
    "w3_body_bounds",
    f"WITH {GRID_SQL} SELECT 'nation_' || c_nationkey AS sheet_id, max(CASE WHEN filled THEN row_idx END)::BIGINT AS last_row FROM grid GROUP BY c_nationkey",
)
def w3(spark, folder):
    """Last row that is neither empty nor a footnote."""
    bounds = sheets.body_bounds(nation_grids(spark, folder))
    return bounds.select("sheet_id", long("last_row").alias("last_row"))


@query(
    "c4_normalize",
    f"WITH {GRID_SQL} SELECT 'nation_' || c_nationkey AS sheet_id, row_idx::BIGINT AS row_idx, "
    "array_to_string([coalesce(c, '~') for c in cells], '|') AS line FROM grid WHERE filled",
)
def c4(spark, folder):
    _, body = sheets.normalize_sheets(nation_grids(spark, folder))
    return body.select("sheet_id", "row_idx", F.array_join("cells", "|", "~").alias("line"))


@query(
    "p5_empty_columns",
    """WITH c AS (
  SELECT c_nationkey AS n, c_custkey, c_custkey % 13 = 5 AS blank, CASE WHEN c_nationkey % 3 <> 0 THEN c_name END AS a,
    CASE WHEN c_acctbal > 9900 THEN c_mktsegment END AS b, c_acctbal::VARCHAR AS d FROM customer),
held AS (SELECT n, bool_or(a IS NOT NULL) AS has_a, bool_or(b IS NOT NULL) AS has_b FROM c WHERE NOT blank GROUP BY n)
SELECT 'nation_' || c.n AS sheet_id, c_custkey AS row_idx, concat_ws('|', c_custkey, CASE WHEN has_a THEN coalesce(a, '~') END, CASE WHEN has_b THEN coalesce(b, '~') END, d) AS line,
  concat_ws(',', '0', CASE WHEN has_a THEN '2' END, CASE WHEN has_b THEN '3' END, '4') AS columns
FROM c JOIN held ON held.n = c.n WHERE NOT blank""",
)
def p5(spark, folder):
    """Customers as a sheet per nation, with blank rows, a column that is never filled and two that are in some sheets only."""
    customer = load(spark, folder, "customer")
    cells = F.array(
        F.col("c_custkey").cast("string"), F.lit(None).cast("string"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name")),
        F.when(F.col("c_acctbal") > 9900, F.col("c_mktsegment")), F.col("c_acctbal").cast("string"),
    )
    blank = F.array_repeat(F.lit(None).cast("string"), 5)
    body = customer.select(
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("sheet_id"), F.col("c_custkey").alias("row_idx"),
        F.when(F.col("c_custkey") % 13 == 5, blank).otherwise(cells).alias("cells"), F.array_repeat(F.lit("string"), 5).alias("cell_types"),
    )
    kept = sheets.without_empty(body)
    return kept.select("sheet_id", "row_idx", F.array_join("cells", "|", "~").alias("line"), F.array_join("columns", ",").alias("columns"))


@query(
    "w12_row_ids",
    f"""WITH {GRID_SQL}
SELECT 'nation_' || c_nationkey AS sheet_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY row_idx) - 1)::BIGINT AS _row_id,
       cells[1] || '|' || cells[2] || '|' || coalesce(cells[3], '~') || '|' || CAST(CAST(cells[4] AS DECIMAL(18,4)) AS VARCHAR) AS line
FROM grid WHERE filled""",
)
def w12(spark, folder):
    """Typed rows as they are stored, numbered per sheet."""
    rows = nation_rows(spark, folder)[2]
    return rows.select("sheet_id", "_row_id", F.array_join("values", "|", "~").alias("line"))


def nation_rows(spark, folder):
    """(columns, catalog, typed rows) of the per-nation sheets."""
    columns, body = sheets.normalize_sheets(settle(nation_grids(spark, folder)))
    catalog = settle(profile.profile_sheets(columns, body, sheets.long_cells(body)))
    return columns, catalog, sheets.typed_rows(body, catalog)


@query(
    "s6_sheet_tables",
    f"""WITH {GRID_SQL}
SELECT 'nation_' || c_nationkey AS sheet_id, count(*)::BIGINT AS row_count, round(sum(cells[4]::DOUBLE), 2) AS acct_bal,
       count(cells[3])::BIGINT AS segments FROM grid WHERE filled GROUP BY c_nationkey""",
)
def s6(spark, folder):
    """Sheets stored as typed rows and read back: sums over the column of numbers, counts over that of texts."""
    path = shared_path(spark, "sheet-rows")
    _, catalog, rows = nation_rows(spark, folder)
    write_sheets(rows, catalog, path)
    store, columns = read_sheets(spark, path), stored_columns(catalog)
    totals = column_totals(store, columns.filter("col_idx = 3")).select("sheet_id", F.round(F.col("total").cast("double"), 2).alias("acct_bal"))
    segment = columns.filter("col_idx = 2").select("sheet_id", "slot")
    counts = store.join(segment, "sheet_id").groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(F.get("texts", F.col("slot"))).alias("segments")
    )
    return counts.join(totals, "sheet_id").select("sheet_id", "row_count", "acct_bal", "segments")


@query(
    "s2_csv_grid",
    "SELECT p_partkey::VARCHAR || '|' || p_name || '|' || p_size || '|' || p_retailprice::VARCHAR AS line, 'string,string,string,string' AS kinds FROM part "
    "UNION ALL SELECT 'p_partkey|p_name|p_size|p_retailprice', 'string,string,string,string'",
)
def s2(spark, folder):
    """part written as CSV and scanned back as a raw grid; header rows of the files count once each."""
    part = load(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    path = shared_path(spark, "csv-grid")
    part.write.option("header", True).csv(path)
    grid = read_csv_grids(spark, path)
    body = grid.filter(F.col("row_idx") > 0)
    header = grid.filter(F.col("row_idx") == 0).dropDuplicates(["cells"])
    return body.unionByName(header).select(F.array_join("cells", "|").alias("line"), F.array_join("cell_types", ",").alias("kinds"))


@query(
    "s2_quoted_cells",
    """SELECT doc_id::VARCHAR AS doc, CASE WHEN text IN ('', 'NA', 'NULL', 'None', 'nan') THEN '~' ELSE md5(text) END AS text_md5, doc_id || '" pipe, ' || lang || '" x' AS stray, 4::BIGINT AS width
FROM documents WHERE text IS NOT NULL
UNION ALL SELECT n_name, md5('line' || chr(13) || chr(10) || n_name || chr(13) || '"quoted"'), n_nationkey || '" pipe, n" x', 4 FROM nation""",
)
def s2_quoted(spark, folder):
    """Whole texts as quoted cells with line breaks, commas and doubled quotes, beside quotes inside plain cells."""
    held = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    stray = lambda n, lang: F.concat(n.cast("string"), F.lit('" pipe, '), lang, F.lit('" x'))
    documents = load(spark, folder, "documents").filter(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("string").alias("name"), F.col("text"), stray(F.col("doc_id"), F.col("lang")).alias("stray")
    )
    broken = F.concat(F.lit("line\r\n"), "n_name", F.lit('\r"quoted"'))
    nations = load(spark, folder, "nation").select(F.col("n_name").alias("name"), broken.alias("text"), stray(F.col("n_nationkey"), F.lit("n")).alias("stray"))
    path = shared_path(spark, "csv-quoted")
    lines = documents.unionByName(nations).select(F.concat_ws(",", "name", held(F.col("text")), "stray", F.lit("")).alias("value"))
    lines.write.text(path)
    cells = F.col("cells")
    grid = read_csv_grids(spark, path).withColumn("whole", F.concat_ws(",", F.slice(cells, 3, 2)))
    md5 = F.when(cells[1].isNull(), "~").otherwise(F.md5(cells[1].cast("binary")))
    return grid.select(cells[0].alias("doc"), md5.alias("text_md5"), F.col("whole").alias("stray"), long(F.size("cells")).alias("width"))


PROFILED = {
    "part": "p_partkey", "customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "nation": "n_nationkey",
    "region": "r_regionkey",
}
KINDS = {
    "part": "p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:f",
    "customer": "c_custkey:i c_name:t c_nationkey:i c_acctbal:f c_mktsegment:t",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:f o_orderdate:d o_orderpriority:t",
    "supplier": "s_suppkey:i s_name:t s_nationkey:i s_acctbal:f",
    "nation": "n_nationkey:i n_name:t n_regionkey:i",
    "region": "r_regionkey:i r_name:t",
}


def _column_sql(table: str, key: str, position: int, name: str, kind: str) -> str:
    if kind == "t":
        return f"""
SELECT '{table}' AS sheet_id, {position} AS col_idx, '{name}' AS column_name, 'TEXT' AS data_type,
  (SELECT count(*) FROM {table}) AS row_count, (SELECT count({name}) FROM {table}) AS non_null, count(*) AS nunique,
  count(*) > 0 AND count(*) <= 50 AND (count(*) <= 20 OR count(*) <= 0.5 * (SELECT count(*) FROM {table})) AS is_categorical,
  '{name}: ' || CASE WHEN count(*) > 0 AND count(*) <= 50 AND (count(*) <= 20 OR count(*) <= 0.5 * (SELECT count(*) FROM {table}))
    THEN 'categorical text column with ' || count(*) || ' distinct values (e.g. ' || string_agg(CASE WHEN r <= 8 THEN v END, ', ' ORDER BY r) || ').'
    ELSE 'free-text column with ' || count(*) || ' distinct values.' END AS description
FROM (SELECT {name} AS v, row_number() OVER (ORDER BY min({key}), {name}) AS r FROM {table} WHERE {name} IS NOT NULL GROUP BY 1)"""
    data_type, text = {
        "i": ("INTEGER", f"'{name}: INTEGER column, range ' || min({name}) || '-' || max({name}) || '.'"),
        "f": ("NUMERIC", f"'{name}: NUMERIC column, range ' || min({name})::VARCHAR || '-' || max({name})::VARCHAR || '.'"),
        "d": ("TIMESTAMP", f"'{name}: date/time column, range ' || min({name})::VARCHAR || ' to ' || max({name})::VARCHAR || '.'"),
    }[kind]
    return f"""
SELECT '{table}' AS sheet_id, {position} AS col_idx, '{name}' AS column_name, '{data_type}' AS data_type,
  count(*) AS row_count, count({name}) AS non_null, 0 AS nunique, FALSE AS is_categorical, {text} AS description FROM {table}"""


CATALOG_SQL = "catalog AS (" + " UNION ALL ".join(
    _column_sql(table, PROFILED[table], i, *entry.split(":"))
    for table, columns in KINDS.items()
    for i, entry in enumerate(columns.split())
) + ")"


def table_grids(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw rows without header, columns, row counts) of the profiled tables, one sheet each."""
    grids, named, sizes = [], [], []
    for table, key in PROFILED.items():
        df = load(spark, folder, table)
        grids.append(sheets.table_as_raw_rows(df, F.lit(table), F.col(key)))
        named.append(
            df.limit(1).select(
                F.lit(table).alias("sheet_id"), F.posexplode(F.array(*[F.lit(c) for c in df.columns])).alias("col_idx", "column_name")
            )
        )
        sizes.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(table).alias("sheet_id"), "row_count"))

    def union(parts):
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return union(grids), union(named), union(sizes)


def table_catalog(spark, folder) -> DataFrame:
    raw, columns, sizes = table_grids(spark, folder)
    return profile.profile_columns(sheets.long_cells(spread(raw)), columns, sizes)


@query(
    "c5_profile",
    f"WITH {CATALOG_SQL} SELECT sheet_id, col_idx::BIGINT AS col_idx, column_name, column_name AS physical_name, data_type, is_categorical, "
    "row_count::BIGINT AS row_count, non_null::BIGINT AS non_null, nunique::BIGINT AS nunique, description FROM catalog",
)
def c5(spark, folder):
    catalog = table_catalog(spark, folder)
    return catalog.select(
        "sheet_id", long("col_idx").alias("col_idx"), "column_name", "physical_name", "data_type", "is_categorical",
        long("row_count").alias("row_count"), long("non_null").alias("non_null"), long("nunique").alias("nunique"), "description",
    )


@query(
    "c5_merged_profile",
    f"WITH {CATALOG_SQL} SELECT sheet_id, col_idx::BIGINT AS col_idx, column_name, data_type, is_categorical, "
    "row_count::BIGINT AS row_count, non_null::BIGINT AS non_null, nunique::BIGINT AS nunique, description FROM catalog",
)
def c5_merged(spark, folder):
    """The same profiles from the states of three ingests, one of them sent twice; the cells are not read again."""
    raw, columns, sizes = table_grids(spark, folder)
    cells, path = sheets.long_cells(settle(spread(raw))), shared_path(spark, "profile-states")
    thirds = [F.col("row_idx") < 40, (F.col("row_idx") >= 40) & (F.col("row_idx") < 1000), F.col("row_idx") >= 1000]
    for ingest in (0, 1, 1, 2):
        profile.append_state(cells.filter(thirds[ingest]), path, f"part-{ingest}")
    catalog = profile.profile_of_state(settle(profile.stored_state(spark, path)), columns, sizes)
    return catalog.select(
        "sheet_id", long("col_idx").alias("col_idx"), "column_name", "data_type", "is_categorical",
        long("row_count").alias("row_count"), long("non_null").alias("non_null"), long("nunique").alias("nunique"), "description",
    )


@query(
    "a4_column_stats",
    """
SELECT 0::BIGINT AS col_idx, count(*)::BIGINT AS non_null, count(DISTINCT event_type)::BIGINT AS nunique, 0::BIGINT AS numbers, 0::BIGINT AS with_digit, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM events
UNION ALL SELECT 1, count(*), 0, count(*), 0, min(value), max(value) FROM events
UNION ALL SELECT 2, count(*), count(DISTINCT props), 0, sum(CASE WHEN regexp_matches(props, '[0-9]') THEN 1 ELSE 0 END)::BIGINT, NULL, NULL FROM events
UNION ALL SELECT 3, count(*), 0, count(*), 0, min(event_id), max(event_id) FROM events""",
)
def a4(spark, folder):
    events = load(spark, folder, "events")
    raw = sheets.table_as_raw_rows(events.select("event_type", "value", "props", "event_id"), F.lit("events"), F.col("event_id"))
    cells = sheets.long_cells(spread(raw))
    stats = profile.column_stats(profile.value_counts(cells))
    return stats.select(*[long(c).alias(c) for c in ("col_idx", "non_null", "nunique", "numbers", "with_digit")], "low", "high")


@query(
    "a5_first_values",
    """SELECT string_agg(v, ',' ORDER BY r) AS sample FROM (
  SELECT event_type AS v, row_number() OVER (ORDER BY min(event_id), event_type) AS r FROM events GROUP BY 1) WHERE r <= 8
UNION ALL SELECT string_agg(v, ',' ORDER BY r) FROM (
  SELECT props AS v, row_number() OVER (ORDER BY min(event_id), props) AS r FROM events GROUP BY 1) WHERE r <= 8""",
)
def a5(spark, folder):
    events = load(spark, folder, "events")
    raw = events.select(F.lit("events").alias("sheet_id"), F.col("event_id").alias("row_idx"), F.array("event_type", "props").alias("cells"), F.array(F.lit("string"), F.lit("string")).alias("cell_types"))
    cells = sheets.long_cells(spread(raw))
    found = profile.first_values(cells, cells.select("sheet_id", "col_idx").distinct())
    return found.select(F.array_join("sample", ",").alias("sample"))


@query(
    "f13_f14_text_grid",
    """
SELECT 'o_orderkey' AS column_name, 'INTEGER' AS data_type, FALSE AS is_categorical, 'o_orderkey: INTEGER column, range ' || min(o_orderkey) || '-' || max(o_orderkey) || '.' AS description FROM orders
UNION ALL SELECT 'o_totalprice', 'NUMERIC', FALSE, 'o_totalprice: NUMERIC column, range ' || min(o_totalprice)::VARCHAR || '-' || max(o_totalprice)::VARCHAR || '.' FROM orders
UNION ALL SELECT 'o_custkey', 'NUMERIC', FALSE, 'o_custkey: NUMERIC column, range ' || min(o_custkey)::DOUBLE::VARCHAR || '-' || max(o_custkey)::DOUBLE::VARCHAR || '.' FROM orders WHERE o_orderkey % 9 <> 0
UNION ALL SELECT 'o_orderdate', 'TIMESTAMP', FALSE, 'o_orderdate: date/time column, range ' || min(o_orderdate)::VARCHAR || ' to ' || max(o_orderdate)::VARCHAR || '.' FROM orders
UNION ALL SELECT 'mixed', 'TEXT', FALSE, 'mixed: free-text column with ' || count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE 'n/k' END) || ' distinct values.' FROM orders""",
)
def f13(spark, folder):
    """orders as a grid of plain texts: numbers restored, dates recognised, a gap turning integers into decimals."""
    orders = load(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("n/k").alias("mixed"),
    )
    raw = sheets.table_as_raw_rows(orders, F.lit("orders"), F.col("o_orderkey"))
    raw = raw.withColumn("cell_types", F.transform("cells", lambda _: F.lit("string")))
    columns = orders.limit(1).select(F.lit("orders").alias("sheet_id"), F.posexplode(F.array(*[F.lit(c) for c in orders.columns])).alias("col_idx", "column_name"))
    sizes = orders.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("orders").alias("sheet_id"), "row_count")
    catalog = profile.profile_columns(sheets.long_cells(spread(raw)), columns, sizes)
    return catalog.select("column_name", "data_type", "is_categorical", "description")


def sheet_list(spark, folder) -> DataFrame:
    """Sheets of the profiled tables; the row count comes from each table."""
    parts = [
        load(spark, folder, table).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(table).alias("sheet_id"), F.lit(table).alias("sheet_name"), F.lit(f"xlsx_{table}").alias("table_name"),
            F.lit(f"{table}.csv").alias("filename"), F.lit(i).alias("sheet_order"), "row_count",
        )
        for i, table in enumerate(PROFILED)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "s12_stored_catalog",
    f"WITH {CATALOG_SQL} SELECT 'xlsx_' || sheet_id AS table_name, 'sheet' AS table_group, column_name, data_type, count(*) OVER (PARTITION BY sheet_id)::BIGINT AS columns FROM catalog",
)
def s12_stored(spark, folder):
    """Tables and columns of the stored column catalog."""
    return lifecycle.catalog_listing(table_catalog(spark, folder), sheet_list(spark, folder))


SCHEMA_SQL = """
schema_texts AS (
  SELECT sheet_id, '-- Sheet: ' || sheet_id || ' (from ' || sheet_id || '.csv)' || chr(10) || 'xlsx_' || sheet_id || '(' || chr(10) ||
    string_agg('  "' || column_name || '" ' || data_type || CASE WHEN is_categorical THEN '  -- ' || description ELSE '' END, ',' || chr(10) ORDER BY col_idx)
    || chr(10) || ')' AS schema_text
  FROM catalog GROUP BY 1
)"""
SUMMARY_SQL = """
summaries AS (
  SELECT sheet_id, 'File: ' || sheet_id || '.csv' || chr(10) || 'Sheet: ' || sheet_id || chr(10) || 'Rows: ' || max(row_count) || chr(10) || 'Columns:' || chr(10) ||
    string_agg('- ' || column_name || ' (' || data_type || '): ' || description, chr(10) ORDER BY col_idx) AS text
  FROM catalog GROUP BY 1
)"""


@query("a11_schema_text", f"WITH {CATALOG_SQL}, {SCHEMA_SQL} SELECT sheet_id, schema_text FROM schema_texts")
def a11(spark, folder):
    return profile.schema_texts(table_catalog(spark, folder), sheet_list(spark, folder))


@query("a12_sheet_summary", f"WITH {CATALOG_SQL}, {SUMMARY_SQL} SELECT sheet_id, text FROM summaries")
def a12(spark, folder):
    return profile.sheet_summaries(table_catalog(spark, folder), sheet_list(spark, folder))


@query(
    "a14_session_scope",
    f"""WITH {CATALOG_SQL}, {SCHEMA_SQL}, placed AS (
  SELECT *, CASE WHEN sheet_id IN ('nation', 'region') THEN 's1' ELSE 's0' END AS session_id,
         list_position(['part', 'customer', 'orders', 'supplier', 'nation', 'region'], sheet_id) AS o FROM schema_texts)
SELECT session_id, md5(string_agg(schema_text, chr(10) || chr(10) ORDER BY o)) AS schema_md5, string_agg('xlsx_' || sheet_id, ',' ORDER BY 'xlsx_' || sheet_id) AS allowed
FROM placed GROUP BY 1""",
)
def a14(spark, folder):
    """Schema description and allowed tables of two sessions."""
    listed = sheet_list(spark, folder).withColumn("session_id", F.when(F.col("sheet_id").isin("nation", "region"), "s1").otherwise("s0"))
    texts = profile.schema_texts(table_catalog(spark, folder), listed)
    scoped = profile.session_schema(texts, listed)
    return scoped.select(
        "session_id", F.md5(F.col("schema_description").cast("binary")).alias("schema_md5"), F.array_join("allowed_tables", ",").alias("allowed")
    )


DISCOVERY_SQL = f"""
WITH {CATALOG_SQL}, {SUMMARY_SQL},
asked AS (
  SELECT p_partkey, 'total ' || CASE p_partkey % 3 WHEN 0 THEN 'retailprice of part' WHEN 1 THEN 'acctbal of customer' ELSE 'totalprice of orders' END
         || ' ' || p_name || ' ' || lower(p_type) AS question FROM part
),
{vectors_sql('qv', 'asked', 'p_partkey', 'question')},
{vectors_sql('sv', 'summaries', 'sheet_id', 'text')},
{top_k_sql('asked', 'p_partkey', 'summaries', 'sheet_id', 'qv', 'sv', 2)}"""


@query(
    "j2_discover_sheets",
    DISCOVERY_SQL + " SELECT question_id, point_id AS sheet_id, score, rank::BIGINT AS rank FROM ranked",
)
def j2(spark, folder):
    """Two nearest table descriptions for a question made from every part."""
    topic = F.when(F.col("p_partkey") % 3 == 0, "retailprice of part").when(F.col("p_partkey") % 3 == 1, "acctbal of customer").otherwise("totalprice of orders")
    questions = load(spark, folder, "part").select(
        F.col("p_partkey").alias("question_id"),
        F.concat(F.lit("total "), topic, F.lit(" "), "p_name", F.lit(" "), F.lower("p_type")).alias("question"),
    )
    found = discover_sheets(questions, settle(table_catalog(spark, folder)), settle(sheet_list(spark, folder)))
    return found.select("question_id", "sheet_id", "score", long("rank").alias("rank"))


@query(
    "f11_column_slugs",
    """WITH s AS (SELECT p_partkey, p_type, trim(regexp_replace(regexp_replace(lower(
  CASE p_partkey % 4 WHEN 0 THEN p_size || ' ' || p_name WHEN 1 THEN '  ' || p_name || ' ($) ' WHEN 2 THEN '??' ELSE 'Order' END
), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM part)
SELECT p_partkey, CASE WHEN s = '' THEN 'col' WHEN regexp_matches(s, '^[0-9]') THEN 'col_' || s WHEN s = 'order' THEN 'order_col' ELSE s END AS slug FROM s""",
)
def f11(spark, folder):
    n = F.col("p_partkey") % 4
    header = (
        F.when(n == 0, F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name"))
        .when(n == 1, F.concat(F.lit("  "), "p_name", F.lit(" ($) "))).when(n == 2, "??").otherwise("Order")
    )
    return load(spark, folder, "part").select("p_partkey", nm.column_slug(header).alias("slug"))


@query(
    "f12_table_names",
    """SELECT p_partkey, substr('xlsx_' || substr(replace(lower(p_name), ' ', '_'), 1, 32) || '_' || substr(sha256('s' || (p_partkey % 10) || ':' || p_partkey), 1, 10), 1, 63) AS table_name FROM part""",
)
def f12(spark, folder):
    part = load(spark, folder, "part")
    session = F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string"))
    return part.select("p_partkey", nm.table_name(session, F.col("p_name"), F.col("p_partkey").cast("string")).alias("table_name"))


@query(
    "w13_distinct_names",
    """WITH w AS (
  SELECT page_id, unnest(regexp_extract_all(lower(url), '[a-z]+')) AS word, unnest(range(0, len(regexp_extract_all(lower(url), '[a-z]+')))) AS pos FROM pages
), s AS (SELECT page_id, pos, CASE WHEN word IN ('select','from','where','table','order','group','by','insert','update','delete') THEN word || '_col' ELSE word END AS slug FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) AS k FROM s)
SELECT page_id, string_agg(slug || CASE WHEN k > 1 THEN '_' || k ELSE '' END, ',' ORDER BY pos) AS names FROM n GROUP BY 1""",
)
def w13(spark, folder):
    """Words of every address as column headers, de-duplicated in order."""
    words = F.regexp_extract_all(F.lower("url"), F.lit("([a-z]+)"), F.lit(1))
    headers = load(spark, folder, "pages").select("page_id", F.transform(words, nm.column_slug).alias("slugs"))
    return headers.select("page_id", let(F.col("slugs"), nm.distinct_names).alias("names")).select("page_id", F.array_join("names", ",").alias("names"))


@query(
    "f17_value_format",
    """SELECT o_orderkey, regexp_replace(regexp_replace(CAST(CAST(o_totalprice / 7 AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '\\.$', '') AS shown,
o_custkey::VARCHAR AS whole, CASE WHEN o_orderstatus = 'F' THEN 'None' ELSE o_orderstatus END AS status FROM orders""",
)
def f17(spark, folder):
    orders = load(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return orders.select(
        "o_orderkey", vl.display_value(F.col("o_totalprice") / 7, "double").alias("shown"),
        vl.display_value(F.col("o_custkey"), "bigint").alias("whole"), vl.display_value(status, "string").alias("status"),
    )


@query(
    "s3_sheet_grids",
    "SELECT 'nation' AS sheet_id, count(*)::BIGINT AS n, 3::BIGINT AS width FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region "
    "UNION ALL SELECT 'supplier', count(*), 4 FROM supplier",
)
def s3(spark, folder):
    """Several sheets stored as one raw table and read back, each handled on its own."""
    parts = [
        sheets.table_as_raw_rows(load(spark, folder, t), F.lit(t), F.col(k))
        for t, k in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"))
    ]
    path = shared_path(spark, "sheet-grids")
    parts[0].unionByName(parts[1]).unionByName(parts[2]).write.parquet(path)
    raw = read_sheet_grids(spark, path)
    return raw.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n"), long(F.max(F.size("cells"))).alias("width"))
