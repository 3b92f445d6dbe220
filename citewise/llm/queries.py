"""Registered queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from citewise.llm import licenses
from citewise.llm.collocations import collocations
from citewise.llm.common import load
from citewise.llm.divergence import source_divergence
from citewise.llm.exact_duplicates import exact_duplicates
from citewise.llm.language import held_out, identify_language
from citewise.llm.licenses import scan_licenses
from citewise.llm.mixing import mixing_plan
from citewise.llm.near_duplicates import near_duplicates
from citewise.llm.neighbours import nearest
from citewise.llm.pieces import encode
from citewise.llm.repeats import remove_repeats
from citewise.llm.sharding import shard
from citewise.llm.tokens import section_tokens
from citewise.llm.topk import top_inner_products


def op1_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(load(spark, folder, "documents"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every whole text, a hash of their ids, and whether they spell the text again."""
    coded = encode(load(spark, folder, "documents").select("doc_id", "text"), with_decoded=True)
    same = F.coalesce(F.col("text"), F.lit("")) == F.coalesce(F.col("decoded"), F.lit(""))
    pieces = F.coalesce(F.col("pieces"), F.array().cast("array<int>"))
    return coded.select("doc_id", F.size(pieces).cast("bigint").alias("n_pieces"), F.xxhash64(pieces).alias("pieces_hash"), same.alias("round_trip"))


def op3_maximal_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of all documents that an earlier document already holds in strings of 50 bytes."""
    return remove_repeats(load(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest rows of every hundredth vector."""
    vectors = load(spark, folder, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    plan = mixing_plan(load(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return shard(load(spark, folder, "documents"), 8)


def op7_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every whole text, learnt from four fifths of the labelled documents."""
    docs = load(spark, folder, "documents")
    learnt = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify_language(docs.select("doc_id", "text"), learnt)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document; a token across a border counts where it begins."""
    return section_tokens(load(spark, folder, "documents")).drop("share")


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licences named in every document."""
    found = scan_licenses(load(spark, folder, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("known", ",").alias("known"), F.array_join("licenses", ",").alias("licenses"))


def op10_uniform_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth vector."""
    vectors = load(spark, folder, "embeddings")
    return top_inner_products(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op11_extendible_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts of all documents and the row of each that stays."""
    return exact_duplicates(load(spark, folder, "documents"))


def op12_dominance_skyband(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of the sources of every language, and the first 200 terms that stand out in each."""
    return source_divergence(load(spark, folder, "documents"))


def op13_prefix_free_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return collocations(load(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The stages of corpus_pipeline, one after the other."""
    return corpus_pipeline.run(spark, folder)


Q = {
    f.__name__: f
    for f in (
        op1_hyperminhash, op2_sentencepiece, op3_maximal_repeats, op4_adaptive_scan, op5_mixing, op6_splitters,
        op7_cross_parsing, op8_token_counts, op9_licenses, op10_uniform_threshold, op11_extendible_hash,
        op12_dominance_skyband, op13_prefix_free_parsing, pipeline,
    )
}


def _mixing_sql(weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3, seed: int = 0) -> str:
    turn = f"[{', '.join(map(str, weights))}]"
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, {ceiling} * sum(size)::BIGINT AS cap,
         {turn}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight
  FROM sized GROUP BY source
),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, source) AS place
  FROM sources WINDOW before AS (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
chosen AS (SELECT level FROM filled WHERE cap >= weight * level ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT level FROM chosen)) AS target FROM filled),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT d.doc_id, d.size, r.source_size, r.target,
       d.size * (floor(r.rate)::BIGINT
         + (('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < r.rate - floor(r.rate))::BIGINT) AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source"""


def _licenses_sql() -> str:
    known = ", ".join(f"('{sentence}', '{identifier}')" for identifier, sentence in licenses.SENTENCES.items())
    names = ", ".join(f"CASE WHEN contains(line, '|{'|'.join(ids)}|') THEN '{name}' END" for name, ids in licenses.RULES)
    return f"""
WITH cut AS (
  SELECT doc_id, rowid AS r, string_split_regex(text, '[.!?;:][ \\t\\r\\n]+|[\\r\\n]+') AS parts
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)
),
said AS (SELECT r, u.i AS place, trim(regexp_replace(lower(parts[u.i]), '[^a-z0-9]+', ' ', 'g')) AS sentence
         FROM cut, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u),
known(sentence, identifier) AS (VALUES {known}),
counted AS (
  SELECT r, count(*) FILTER (WHERE said.sentence <> '')::BIGINT AS n_sentences,
         coalesce(string_agg(identifier, '|' ORDER BY place) FILTER (WHERE identifier IS NOT NULL), '') AS ids
  FROM said LEFT JOIN known USING (sentence) GROUP BY r
),
lined AS (SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(ids, '') AS ids, '|' || coalesce(ids, '') || '|' AS line
          FROM cut LEFT JOIN counted USING (r))
SELECT doc_id, n_sentences, replace(ids, '|', ',') AS known, concat_ws(',', {names}) AS licenses FROM lined"""


TOP_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
  FROM clean q JOIN clean p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= 5"""

EXACT_SQL = r"""
WITH shaped AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM shaped WINDOW same AS (PARTITION BY t)"""

DIVERGENCE_SQL = r"""
WITH told AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
said AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM told),
kept AS (SELECT lang, term, count(*) AS total FROM said GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
held AS (SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS n FROM held GROUP BY lang, source),
every AS (
  SELECT g.lang, g.source, coalesce(s.n, 0)::HUGEINT AS n, coalesce(l.v, 0)::HUGEINT AS v, coalesce(l.n, 0)::HUGEINT AS ln
  FROM (SELECT DISTINCT lang, source FROM told) g LEFT JOIN sums s USING (lang, source) LEFT JOIN langs l USING (lang)
),
smooth AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 1) // (g.n + g.v) AS p,
         1 + 1000000000::HUGEINT * (k.total + 1) // (g.ln + g.v) AS q
  FROM every g JOIN kept k USING (lang) LEFT JOIN held h USING (lang, source, term)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM smooth a JOIN smooth b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM smooth WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
) WHERE part = 'pair' OR rank <= 200"""

COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
begun AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
said AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM begun, (VALUES (1), (2), (3)) AS sizes(size) WHERE i + size - 1 <= len(w)
),
counted AS (SELECT lang, size, phrase, count(*) AS f FROM said GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.size, k, x.f AS l, y.f AS r, 1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, part AS phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidates WHERE size = 3) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, q.phrase) AS rank, q.phrase, a, l, r, t.n, score::BIGINT AS score
  FROM weakest q JOIN totals t ON t.lang = q.lang LEFT JOIN held h ON h.lang = q.lang AND h.phrase = q.phrase
  WHERE q.size = 3 OR h.longer IS NULL OR 100 * h.longer < 50 * a
) WHERE rank <= 2000"""

SQL = {
    "op5_mixing": _mixing_sql(), "op9_licenses": _licenses_sql(), "op10_uniform_threshold": TOP_SQL, "op11_extendible_hash": EXACT_SQL,
    "op12_dominance_skyband": DIVERGENCE_SQL, "op13_prefix_free_parsing": COLLOCATION_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
