"""Text corpus: units, segmentation, chunks, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions import text as tx
from citewise.functions.hashing import hashed_vector, to_dense
from citewise.operators import chunking, segments
from citewise.sources.files import text_units
from suite.common import HEADING_SQL, LINES_SQL, Registry, load, long, source_lines, spread, vectors_sql

query = Registry()
Q, SQL = query.queries, query.sql


@query(
    "s1_text_units",
    "SELECT doc_id, 0::BIGINT AS base_char_offset, length(text)::BIGINT AS chars FROM documents "
    "WHERE trim(text, E' \\t\\n\\r') <> ''",
)
def s1(spark: SparkSession, folder: str) -> DataFrame:
    units = text_units(load(spark, folder, "documents"))
    return units.select("doc_id", long("base_char_offset").alias("base_char_offset"), long(F.length("text")).alias("chars"))


@query(
    "p4_blank_lines",
    f"WITH {LINES_SQL} SELECT page_no AS doc_id, count(*)::BIGINT AS filled FROM lines "
    "WHERE trim(text, E' \\t\\n\\r') <> '' GROUP BY 1",
)
def p4(spark, folder):
    lines = segments.page_lines(segments.text_pages(source_lines(spark, folder)))
    return lines.filter(~tx.is_blank(F.col("text"))).groupBy(F.col("page_no").alias("doc_id")).agg(F.count(F.lit(1)).alias("filled"))


@query(
    "f1_tokens",
    "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS tokens, "
    "md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS token_md5 FROM documents",
)
def f1(spark, folder):
    docs = load(spark, folder, "documents").withColumn("t", tx.tokens(F.col("text")))
    return docs.select("doc_id", long(F.size("t")).alias("tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("token_md5"))


def _hash_sql() -> str:
    return (
        f"WITH {vectors_sql('v', 'documents', 'doc_id', 'text')} "
        "SELECT doc_id, bucket::BIGINT AS bucket, round(weight, 6) AS weight FROM v WHERE weight <> 0"
    )


@query("f2_hash_embedding", _hash_sql())
def f2(spark, folder):
    docs = spread(load(spark, folder, "documents").select("doc_id", "text"))
    entries = docs.select("doc_id", F.inline_outer(hashed_vector(F.col("text")))).filter(F.col("bucket").isNotNull())
    return entries.select("doc_id", long("bucket").alias("bucket"), F.round("weight", 6).alias("weight"))


@query(
    "c3_dense_vectors",
    "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) "
    "SELECT doc_id, 384::BIGINT AS dim, CASE WHEN len(t) = 0 THEN 0.0 ELSE 1.0 END AS norm FROM t",
)
def c3(spark, folder):
    docs = spread(load(spark, folder, "documents").select("doc_id", "text"))
    dense = docs.select("doc_id", to_dense(hashed_vector(F.col("text"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return dense.select("doc_id", long(F.size("v")).alias("dim"), F.round(norm, 4).alias("norm"))


@query(
    "f6_headings",
    f"WITH {LINES_SQL} SELECT page_no AS doc_id, line_no::BIGINT AS line_no, trim(text, E' \\t\\n\\r') AS heading FROM lines "
    f"WHERE {HEADING_SQL}",
)
def f6(spark, folder):
    lines = segments.page_lines(segments.text_pages(source_lines(spark, folder)))
    found = lines.filter(tx.is_heading(F.col("text")))
    return found.select(F.col("page_no").alias("doc_id"), long("line_no").alias("line_no"), tx.strip(F.col("text")).alias("heading"))


@query(
    "f7_digit_collapse",
    f"WITH {LINES_SQL} SELECT regexp_replace(trim(text, E' \\t\\n\\r'), '[0-9]+', '#', 'g') AS pattern, "
    "count(*)::BIGINT AS n FROM lines GROUP BY 1",
)
def f7(spark, folder):
    lines = segments.page_lines(segments.text_pages(source_lines(spark, folder)))
    return lines.groupBy(tx.collapse_digits(F.col("text")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f9_pipe_rows",
    "SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderpriority LIKE '4%' THEN ' ' ELSE o_orderpriority END), ''), '(blank)') "
    "|| ' | ' || coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, '(blank)') AS line FROM orders",
)
def f9(spark, folder):
    orders = load(spark, folder, "orders")
    priority = F.when(F.col("o_orderpriority").startswith("4"), " ").otherwise(F.col("o_orderpriority"))
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return orders.select("o_orderkey", tx.pipe_row(F.array(priority, status)).alias("line"))


@query(
    "f10_line_numbers",
    "SELECT doc_id, (length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1)::BIGINT AS line FROM documents",
)
def f10(spark, folder):
    docs = load(spark, folder, "documents")
    middle = F.floor(F.length("text") / 2).cast("int")
    return docs.select("doc_id", long(tx.line_number_at(F.col("text"), middle)).alias("line"))


EDGES_SQL = f"""
WITH {LINES_SQL},
filled AS (SELECT * FROM lines WHERE trim(text, E' \\t\\n\\r') <> ''),
edges AS (
  SELECT doc_id, page_no,
         regexp_replace(trim(arg_min(text, line_no), E' \\t\\n\\r'), '[0-9]+', '#', 'g') AS top,
         regexp_replace(trim(arg_max(text, line_no), E' \\t\\n\\r'), '[0-9]+', '#', 'g') AS bottom
  FROM filled GROUP BY 1, 2
),
stacked AS (
  SELECT doc_id, 'top' AS edge, top AS pattern FROM edges UNION ALL SELECT doc_id, 'bottom', bottom FROM edges
),
patterns AS (SELECT doc_id, edge, pattern, count(*)::BIGINT AS pages FROM stacked GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


@query("a9_repeating_patterns", EDGES_SQL + " SELECT doc_id AS source, edge, pattern, pages FROM patterns")
def a9(spark, folder):
    found = segments.repeated_patterns(segments.page_edges(segments.text_pages(source_lines(spark, folder))))
    return found.select(F.col("doc_id").alias("source"), "edge", "pattern", "pages")


@query("u1_pattern_union", EDGES_SQL + " SELECT DISTINCT doc_id AS source, pattern FROM patterns")
def u1(spark, folder):
    found = segments.running_patterns(segments.text_pages(source_lines(spark, folder)))
    return found.select(F.col("doc_id").alias("source"), "pattern")


KEPT_SQL = (
    EDGES_SQL
    + f""",
kept AS (
  SELECT l.*, {HEADING_SQL} AS heading
  FROM lines l WHERE NOT EXISTS (
    SELECT 1 FROM patterns p WHERE p.doc_id = l.doc_id
      AND p.pattern = regexp_replace(trim(l.text, E' \\t\\n\\r'), '[0-9]+', '#', 'g'))
),
sectioned AS (
  SELECT *, last_value(CASE WHEN heading THEN trim(text, E' \\t\\n\\r') END IGNORE NULLS) OVER (
    PARTITION BY doc_id ORDER BY page_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM kept
),
segmented AS (
  SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id, page_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
  FROM sectioned
),
units AS (
  SELECT doc_id, page_no, segment, trim(string_agg(text, chr(10) ORDER BY line_no), E' \\t\\n\\r') AS text, max(section) AS section
  FROM segmented WHERE NOT heading GROUP BY 1, 2, 3
)"""
)


@query(
    "w4_strip_running_lines",
    KEPT_SQL + " SELECT page_no AS doc_id, count(*)::BIGINT AS lines_left, sum(length(text))::BIGINT AS chars FROM kept GROUP BY 1",
)
def w4(spark, folder):
    pages = segments.strip_running_lines(segments.text_pages(source_lines(spark, folder)))
    chars = F.aggregate("lines", F.lit(0), lambda acc, line: acc + F.length(line["text"]))
    kept = pages.filter(F.size("lines") > 0)
    return kept.select(F.col("page_no").alias("doc_id"), long(F.size("lines")).alias("lines_left"), long(chars).alias("chars"))


@query(
    "w5_sections",
    KEPT_SQL + " SELECT page_no AS doc_id, line_no::BIGINT AS line_no, section FROM sectioned",
)
def w5(spark, folder):
    pages = segments.mark_headings(segments.strip_running_lines(segments.text_pages(source_lines(spark, folder))))
    lines = segments.with_sections(pages)
    return lines.select(F.col("page_no").alias("doc_id"), long("line_no").alias("line_no"), "section")


@query(
    "c2_segments",
    KEPT_SQL + " SELECT doc_id AS source, page_no AS page, segment::BIGINT AS unit_no, section, md5(text) AS text_md5 FROM units WHERE text <> ''",
)
def c2(spark, folder):
    units = segments.segment_pages(segments.text_pages(source_lines(spark, folder)))
    return units.select(
        F.col("doc_id").alias("source"), F.col("page_start").alias("page"), long("unit_no").alias("unit_no"), "section",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


# Lines with a comma near the front stand for table rows: their cells are the comma-separated parts.
TABLE_LINES_SQL = f"""
WITH {LINES_SQL},
typed AS (
  SELECT *, CASE WHEN contains(substr(text, 1, 40), ',') THEN 'table' ELSE 'text' END AS kind,
         array_to_string([coalesce(nullif(trim(c, E' \\t\\n\\r'), ''), '(blank)') for c in string_split(text, ',')], ' | ') AS rendered
  FROM lines
),
flagged AS (
  SELECT *, CASE WHEN kind <> lag(kind) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) THEN 1 ELSE 0 END AS edge FROM typed
),
segmented AS (
  SELECT *, sum(edge) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS segment FROM flagged
),
raw_units AS (
  SELECT doc_id, page_no, segment, kind,
         trim(string_agg(CASE WHEN kind = 'table' THEN rendered ELSE text END, chr(10) ORDER BY line_no), E' \\t\\n\\r') AS text,
         arg_min(rendered, line_no) AS first_line
  FROM segmented GROUP BY 1, 2, 3, 4
),
filled AS (SELECT * FROM raw_units WHERE text <> ''),
led AS (
  SELECT *, coalesce(kind = 'text' AND length(text) < 80
             AND lead(kind) OVER w = 'table' AND lead(segment) OVER w = segment + 1, FALSE) AS lead_in
  FROM filled WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY segment)
),
folded AS (
  SELECT *, CASE WHEN kind = 'table' THEN lag(CASE WHEN lead_in THEN text END) OVER (PARTITION BY doc_id, page_no ORDER BY segment) END AS prefix FROM led
)
SELECT page_no AS doc_id, segment::BIGINT AS segment, kind, md5(CASE WHEN prefix IS NULL THEN text ELSE prefix || chr(10) || text END) AS text_md5,
       CASE WHEN kind = 'table' THEN md5(first_line) END AS header_md5
FROM folded WHERE NOT lead_in"""


@query("w7_table_lead_ins", TABLE_LINES_SQL)
def w7(spark, folder):
    pages = segments.text_pages(source_lines(spark, folder))
    kind = lambda line: F.substring(line["text"], 1, 40).contains(",")
    typed = pages.withColumn(
        "lines",
        F.transform(
            "lines",
            lambda line: line.withField("kind", F.when(kind(line), "table").otherwise("text"))
            .withField("cells", F.split(line["text"], ","))
            .withField("heading", F.lit(False)),
        ),
    )
    units = segments.assemble_segments(segments.with_segments(segments.with_sections(typed)))
    return units.select(
        F.col("page_no").alias("doc_id"), long("segment").alias("segment"),
        F.when(F.col("table_header").isNotNull(), "table").otherwise("text").alias("kind"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(F.col("table_header").cast("binary")).alias("header_md5"),
    )


@query(
    "w14_block_units",
    f"""WITH {LINES_SQL},
styled AS (SELECT *, length(text) < 60 AND trim(text, E' \\t\\n\\r') <> '' AS heading FROM lines),
sectioned AS (
  SELECT *, last_value(CASE WHEN heading THEN trim(text, E' \\t\\n\\r') END IGNORE NULLS) OVER (
    PARTITION BY page_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM styled)
SELECT page_no AS doc_id, line_no::BIGINT AS paragraph, section, md5(trim(text, E' \\t\\n\\r')) AS text_md5
FROM sectioned WHERE NOT heading AND trim(text, E' \\t\\n\\r') <> ''""",
)
def w14(spark, folder):
    lines = segments.page_lines(segments.text_pages(source_lines(spark, folder)))
    blocks = lines.select(
        F.col("page_no").alias("doc_id"), F.col("line_no").alias("block_no"), F.lit("paragraph").alias("kind"),
        F.when(F.length("text") < 60, "Heading 2").otherwise("Normal").alias("style"), "text",
        F.lit(None).cast("array<array<string>>").alias("rows"),
    )
    units = segments.block_units(blocks)
    return units.select("doc_id", long("paragraph_start").alias("paragraph"), "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "a15_slides",
    f"""WITH {LINES_SQL}
SELECT page_no AS doc_id, max(CASE WHEN line_no = 0 AND trim(text, E' \\t\\n\\r') <> '' THEN trim(text, E' \\t\\n\\r') END) AS title,
       md5(string_agg(trim(text, E' \\t\\n\\r'), chr(10) ORDER BY line_no)) AS text_md5
FROM lines WHERE trim(text, E' \\t\\n\\r') <> '' GROUP BY 1""",
)
def a15(spark, folder):
    lines = segments.page_lines(segments.text_pages(source_lines(spark, folder)))
    shapes = lines.select(
        F.lit("deck").alias("doc_id"), F.col("page_no").alias("slide_no"), F.col("line_no").alias("shape_no"),
        (F.col("line_no") == 0).alias("is_title"), "text", F.lit(None).cast("array<array<string>>").alias("rows"),
    )
    units = segments.slide_units(shapes)
    return units.select(F.col("slide_number").alias("doc_id"), F.col("slide_title").alias("title"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


# The packing rule in SQL: a text longer than a chunk is cut before every paragraph break; pieces of a chunk or more are cut again
# before every line break, then before every blank, then anywhere. Neighbouring pieces below the limit form a run, and a run is
# packed from left to right, each chunk reaching back at most the overlap.
BREAKS = ("chr(10) || chr(10)", "chr(10)", "' '")


def _level_sql(level: int, mark: str, size: int) -> str:
    """Segments that hold the mark fall into pieces; pieces that are still too long stay open for the next level."""
    return f"""
split{level} AS (
  SELECT o.doc_id, o.low, o.high, string_split(substr(b.body, o.low + 1, o.high - o.low), {mark}) AS parts
  FROM open{level - 1} o JOIN bodies b USING (doc_id)
),
edged{level} AS (
  SELECT doc_id, low, high, list_distinct([low] || list_transform(range(1, len(parts)), lambda i:
      low + list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length({mark})) || [high]) AS edges
  FROM split{level} WHERE len(parts) > 1
),
pieces{level} AS (
  SELECT doc_id, low, i, edges[i]::BIGINT AS a, edges[i + 1]::BIGINT AS b
  FROM (SELECT doc_id, low, list_sort(edges) AS edges, unnest(range(1, len(edges))) AS i FROM edged{level})
),
runs{level} AS (
  SELECT doc_id, list(a ORDER BY i) || [max(b)] AS cuts
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, low ORDER BY i) AS run FROM pieces{level} WHERE b - a < {size}) GROUP BY doc_id, low, run
),
open{level} AS (
  SELECT doc_id, a AS low, b AS high FROM pieces{level} WHERE b - a >= {size}
  UNION ALL SELECT doc_id, low, high FROM split{level} WHERE len(parts) = 1
)"""


def chunks_sql(size: int = 1200, overlap: int = 200) -> str:
    """CTEs ``bodies`` (doc_id, body) and ``chunks`` (doc_id, chunk_index, chunk, a, b) of documents; the WITH has to be RECURSIVE."""
    levels = ",".join(_level_sql(i, mark, size) for i, mark in enumerate(BREAKS, 1))
    return f"""
bodies AS (SELECT doc_id, text AS body FROM documents WHERE trim(text, E' \\t\\n\\r') <> ''),
open0 AS (SELECT doc_id, 0::BIGINT AS low, length(body)::BIGINT AS high FROM bodies WHERE length(body) > {size}),{levels},
runs AS (
  SELECT doc_id, cuts FROM runs1 UNION ALL SELECT doc_id, cuts FROM runs2 UNION ALL SELECT doc_id, cuts FROM runs3
  UNION ALL SELECT doc_id, range(low, high + 1) FROM open3
),
packed AS (
  SELECT doc_id, cuts, cuts[1] AS a, list_max(list_filter(cuts, lambda c: c <= cuts[1] + {size})) AS b FROM runs
  UNION ALL
  SELECT doc_id, cuts, a, list_max(list_filter(cuts, lambda c: c <= a + {size})) AS b FROM (
    SELECT doc_id, cuts, list_min(list_filter(cuts, lambda c: c >= greatest(b - {overlap}, list_min(list_filter(cuts, lambda d: d > b)) - {size}))) AS a
    FROM packed WHERE b < cuts[len(cuts)])
),
numbered AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_index, chunk
  FROM (SELECT p.doc_id, a, trim(substr(body, a + 1, b - a), E' \\t\\n\\r') AS chunk FROM packed p JOIN bodies USING (doc_id)) WHERE chunk <> ''
),
placed AS (
  SELECT n.doc_id, chunk_index, chunk, (strpos(body, chunk) - 1)::BIGINT AS a FROM numbered n JOIN bodies USING (doc_id) WHERE chunk_index = 0
  UNION ALL
  SELECT n.doc_id, n.chunk_index, n.chunk, (p.back + strpos(substr(body, p.back + 1), n.chunk) - 1)::BIGINT
  FROM (SELECT doc_id, chunk_index, greatest(0, a + length(chunk) - {overlap}) AS back FROM placed) p
  JOIN numbered n ON n.doc_id = p.doc_id AND n.chunk_index = p.chunk_index + 1 JOIN bodies b ON b.doc_id = n.doc_id
),
chunks AS (
  SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk, a, (a + length(chunk))::BIGINT AS b FROM placed
  UNION ALL SELECT doc_id, 0, trim(body, E' \\t\\n\\r'), 0, length(body) FROM bodies WHERE length(body) <= {size}
)"""


def _line_breaks(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


C1_SQL = f"""WITH RECURSIVE {chunks_sql()}
SELECT c.doc_id, chunk_index, a AS char_start, b AS char_end, (1 + {_line_breaks('substr(body, 1, a)')})::BIGINT AS line_start,
  (1 + {_line_breaks('substr(body, 1, greatest(b - 1, a))')})::BIGINT AS line_end, md5(chunk) AS text_md5
FROM chunks c JOIN bodies USING (doc_id)"""


def corpus_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select(
        "doc_id", "text", "source", F.concat("source", F.lit(".txt")).alias("filename"), F.lit("txt").alias("file_type")
    )
    return chunking.chunk_documents(text_units(spread(docs)), single_unit=True)


@query(
    "c1_short_documents",
    "SELECT doc_id, 1::BIGINT AS chunks, md5(trim(text, E' \\t\\n\\r')) AS text_md5, length(text)::BIGINT AS char_end "
    "FROM documents WHERE length(text) <= 1200 AND trim(text, E' \\t\\n\\r') <> ''",
)
def c1_short(spark, folder):
    """Documents that fit one chunk, out of the chunks of the whole corpus."""
    chunks = corpus_chunks(spark, folder)
    per_document = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("char_end").alias("char_end"), F.min_by("text", "chunk_index").alias("text")
    )
    short = per_document.filter(F.col("char_end") <= chunking.CHUNK_CHARS).filter(F.col("chunks") == 1)
    whole = load(spark, folder, "documents").filter(F.length("text") <= chunking.CHUNK_CHARS).select("doc_id")
    return short.join(whole, "doc_id", "left_semi").select(
        "doc_id", "chunks", F.md5(F.col("text").cast("binary")).alias("text_md5"), long("char_end").alias("char_end")
    )


@query(
    "c1_chunk_invariants",
    "SELECT doc_id, TRUE AS has_chunks, TRUE AS within_limit, TRUE AS indexes_consecutive, TRUE AS texts_match, "
    "0::BIGINT AS uncovered FROM documents WHERE trim(text, E' \\t\\n\\r') <> ''",
)
def c1_invariants(spark, folder):
    """Per document: sizes within the limit, text equal to its span, and no character but white space left out."""
    chunks = corpus_chunks(spark, folder)
    spans = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("char_count").alias("longest"), F.max("chunk_index").alias("last"),
        F.array_sort(F.collect_list(F.struct("char_start", "char_end", "text"))).alias("spans"),
    )
    joined = load(spark, folder, "documents").select("doc_id", F.col("text").alias("source_text")).join(spans, "doc_id")
    own = lambda s: tx.strip(F.substring(F.col("source_text"), s["char_start"] + 1, s["char_end"] - s["char_start"]))
    gaps = F.concat(
        F.transform(
            "spans",
            lambda s, i: F.substring(
                F.col("source_text"),
                F.coalesce(F.get("spans", i - 1)["char_end"], F.lit(0)) + 1,
                F.greatest(s["char_start"] - F.coalesce(F.get("spans", i - 1)["char_end"], F.lit(0)), F.lit(0)),
            ),
        ),
        F.array(F.substring(F.col("source_text"), F.element_at("spans", -1)["char_end"] + 1, F.length("source_text"))),
    )
    return joined.select(
        "doc_id",
        (F.col("n") > 0).alias("has_chunks"),
        (F.col("longest") <= chunking.CHUNK_CHARS).alias("within_limit"),
        (F.col("last") == F.col("n") - 1).alias("indexes_consecutive"),
        F.forall("spans", lambda s: own(s) == s["text"]).alias("texts_match"),
        long(F.length(tx.strip(F.array_join(gaps, "")))).alias("uncovered"),
    )


@query("c1_chunks", C1_SQL)
def c1(spark, folder):
    chunks = corpus_chunks(spark, folder)
    return chunks.select(
        "doc_id", "chunk_index", long("char_start").alias("char_start"), long("char_end").alias("char_end"),
        long("line_start").alias("line_start"), long("line_end").alias("line_end"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query("w8_w9_segment_chunks")
def w9(spark, folder):
    """Chunks of segmented volumes: table headers repeated, indexes running over each whole volume."""
    units = segments.segment_pages(segments.text_pages(source_lines(spark, folder)))
    chunks = chunking.chunk_documents(units, order=("page_start", "unit_no"))
    return chunks.select(F.col("doc_id").alias("source"), "chunk_index", long("page_start").alias("page"), "section", long("char_count").alias("char_count"))


@query(
    "w9_index_totals",
    KEPT_SQL
    + " SELECT doc_id AS source, count(*)::BIGINT AS chunks, (count(*) - 1)::BIGINT AS last_index FROM units "
    "WHERE text <> '' GROUP BY 1",
)
def w9_totals(spark, folder):
    """Running chunk index per volume, checked with a chunk size no unit exceeds."""
    units = segments.segment_pages(segments.text_pages(source_lines(spark, folder)))
    chunks = chunking.chunk_documents(units, size=1_000_000, overlap=0, order=("page_start", "unit_no"))
    return chunks.groupBy(F.col("doc_id").alias("source")).agg(
        F.count_distinct("chunk_index").alias("chunks"), long(F.max("chunk_index")).alias("last_index")
    )


@query("a13_chunk_counts", f"WITH RECURSIVE {chunks_sql()} SELECT doc_id, count(*)::BIGINT AS chunks FROM chunks GROUP BY 1")
def a13(spark, folder):
    return corpus_chunks(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
