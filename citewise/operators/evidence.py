"""Selected chunks -> merged passages -> cited evidence text.

A question keeps only a handful of chunks, so the merge is a fold over that small array inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.labels import SOURCE_TYPE, chunk_source, location_label
from citewise.functions.text import let

MIN_OVERLAP_CHARS = 20
OVERLAP_WINDOW_CHARS = 400


def merge_point(left: Column, right: Column) -> Column:
    """0-based start of the new text of ``right`` when the end of ``left`` recurs near its beginning, else null.

    The longest such end counts. If an end of some length recurs, every shorter one does too, so its length is found
    by bisection.
    """

    def search(zone: Column) -> Column:
        longest = F.least(F.length(left), F.length(zone))

        def recurs(size: Column) -> Column:
            return F.instr(zone, F.right(left, size)) > 0

        def halve(bounds: Column, _: Column) -> Column:
            middle = F.shiftright(bounds["low"] + bounds["high"] + 1, 1)
            return let(
                recurs(middle),
                lambda found: F.struct(
                    F.when(found, middle).otherwise(bounds["low"]).alias("low"),
                    F.when(found, bounds["high"]).otherwise(middle - 1).alias("high"),
                ),
            )

        start = F.struct(F.lit(MIN_OVERLAP_CHARS).alias("low"), longest.alias("high"))
        steps = F.sequence(F.lit(1), F.lit(OVERLAP_WINDOW_CHARS.bit_length()))
        size = F.aggregate(steps, start, halve)["low"]
        confident = (longest >= MIN_OVERLAP_CHARS) & recurs(F.lit(MIN_OVERLAP_CHARS))
        return F.when(confident, let(size, lambda n: F.instr(zone, F.right(left, n)) + n - 1))

    return let(F.substring(right, 1, OVERLAP_WINDOW_CHARS), search)


def with_adjacency(chunks: DataFrame, document: str = "doc_id", within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``continues``: whether the next chunk of the same document (inside ``within``, such as a question) is the next in number."""
    order = Window.partitionBy(*within, document).orderBy("chunk_index")
    return chunks.withColumn("continues", F.coalesce(F.lead("chunk_index").over(order) == F.col("chunk_index") + 1, F.lit(False)))


def merge_adjacent(kept: DataFrame, document: str = "doc_id") -> DataFrame:
    """Join kept chunks that continue each other; one row per resulting passage.

    Input rows carry question_id, final_rank, score, ``document``, chunk_index, text and page_end; other columns keep
    the value of the first chunk of a passage.
    """
    names = [c for c in kept.columns if c not in ("question_id", document, "chunk_index")]
    row = F.struct(document, "chunk_index", *names)
    ordered = kept.groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    fields = [document, "chunk_index", *names]

    def extended(last: Column, nxt: Column, point: Column) -> Column:
        changed = {
            "text": F.concat(last["text"], F.substring(nxt["text"], point + 1, F.length(nxt["text"]))),
            "chunk_index": nxt["chunk_index"],
            "page_end": F.coalesce(nxt["page_end"], last["page_end"]),
            "score": F.greatest(last["score"], nxt["score"]),
            "final_rank": F.least(last["final_rank"], nxt["final_rank"]),
        }
        return F.struct(*[changed.get(f, last[f]).alias(f) for f in fields])

    def step(passages: Column, nxt: Column) -> Column:
        last = F.try_element_at(passages, F.lit(-1))
        follows = last[document].eqNullSafe(nxt[document]) & (nxt["chunk_index"] == last["chunk_index"] + 1)
        point = F.when(follows, merge_point(last["text"], nxt["text"]))
        return let(
            point,
            lambda p: F.when(
                p.isNotNull(),
                F.concat(F.slice(passages, 1, F.size(passages) - 1), F.array(extended(last, nxt, p))),
            ).otherwise(F.concat(passages, F.array(nxt))),
        )

    merged = ordered.select("question_id", F.aggregate("_rows", F.slice("_rows", 1, 0), step).alias("_passages"))
    # The outer form: the plain one would evaluate the fold again in a filter on its size; it is never empty here.
    return merged.select("question_id", F.inline_outer("_passages"))


def build_context(passages: DataFrame) -> DataFrame:
    """passages -> (question_id, context, sources) with blocks in rank order."""

    def field(name: str) -> Column:
        return F.col(name) if name in passages.columns else F.lit(None)

    label = location_label(
        field("page_start").cast("int"),
        field("page_end").cast("int"),
        field("slide_number").cast("int"),
        field("line_start").cast("int"),
        field("section").cast("string"),
    )
    block = F.concat(F.lit("[Source: "), F.col("filename"), label, F.lit("]\n"), F.col("text"))
    blocks = passages.select(
        "question_id", F.struct(F.col("final_rank"), block.alias("block"), chunk_source(field).alias("source")).alias("_b")
    )
    gathered = blocks.groupBy("question_id").agg(F.array_sort(F.collect_list("_b")).alias("_blocks"))
    return gathered.select(
        "question_id",
        F.array_join(F.transform("_blocks", lambda b: b["block"]), "\n\n").alias("context"),
        F.transform("_blocks", lambda b: b["source"]).cast(f"array<{SOURCE_TYPE}>").alias("sources"),
    )


def join_evidence(first: Column, second: Column) -> Column:
    """Document evidence followed by table evidence, either of which may be missing."""
    clean = [F.when(c != "", c) for c in (first, second)]
    return F.concat_ws("\n\n", *clean)


def join_sources(first: Column, second: Column) -> Column:
    empty = F.array().cast(f"array<{SOURCE_TYPE}>")
    return F.concat(F.coalesce(first, empty), F.coalesce(second, empty))
