"""Decoded lines, blocks and slide shapes -> document units.

``lines(doc_id, page_no, line_no, kind, text, cells, table_no)``: ``kind`` is ``text`` or ``table``; a table line holds
one row of ``cells``. Work is keyed by (document, block of pages), so one huge document spreads over many tasks and
its text is shuffled once; what crosses blocks travels as one small row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewise.functions.text import (
    SHORT_LEAD_IN_CHARS,
    collapse_digits,
    is_blank,
    is_heading,
    pipe_row,
    row_is_empty,
    split_lines,
    strip,
)
from citewise.plans.materialize import settle
from citewise.plans.scans import BLOCK, carry_forward

PAGE = ["doc_id", "page_no"]
PAGES_PER_BLOCK = 256


def text_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages(doc_id, page_no, text) -> page rows holding their decoded lines."""
    line = lambda value, position: F.struct(
        position.cast("int").alias("line_no"),
        F.lit("text").alias("kind"),
        value.alias("text"),
        F.lit(None).cast("array<string>").alias("cells"),
        F.lit(None).cast("int").alias("table_no"),
    )
    return pages.select(*PAGE, F.transform(split_lines(F.col(text)), line).alias("lines"))


def page_rows(lines: DataFrame) -> DataFrame:
    """lines table -> one row per page; a page is the unit that has to fit in memory."""
    line = F.struct("line_no", "kind", "text", "cells", "table_no")
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("lines"))


def page_lines(pages: DataFrame) -> DataFrame:
    """Page rows -> lines table. (The outer form keeps the lines from being built again to test their number.)"""
    return pages.select(*PAGE, F.inline_outer("lines")).filter(F.col("line_no").isNotNull())


def page_edges(pages: DataFrame) -> DataFrame:
    """Digit-collapsed first and last non-blank line of every page; reads each page row on its own."""
    filled = F.filter("lines", lambda line: ~is_blank(line["text"]))
    edges = pages.select(*PAGE, filled.alias("_filled")).filter(F.size("_filled") > 0)
    return edges.select(
        *PAGE,
        collapse_digits(F.element_at("_filled", 1)["text"]).alias("top"),
        collapse_digits(F.element_at("_filled", -1)["text"]).alias("bottom"),
    )


def repeated_patterns(edges: DataFrame) -> DataFrame:
    """(doc_id, edge, pattern, pages) for patterns opening or closing more than one page of a document."""
    stacked = edges.select(
        "doc_id", F.explode(F.create_map(F.lit("top"), "top", F.lit("bottom"), "bottom")).alias("edge", "pattern")
    )
    return (
        stacked.groupBy("doc_id", "edge", "pattern").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") > 1)
    )


def running_patterns(pages: DataFrame) -> DataFrame:
    """Distinct (doc_id, pattern) over both edges."""
    return repeated_patterns(page_edges(pages)).select("doc_id", "pattern").distinct()


def _blocked_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn(BLOCK, F.floor(F.col("page_no") / PAGES_PER_BLOCK))


def strip_running_lines(pages: DataFrame) -> DataFrame:
    """Drop running header and footer lines wherever they occur.

    Only (document, block, pattern) keys travel to find which patterns a block of pages holds; the page texts meet
    the few that matter to them.
    """
    blocked = _blocked_pages(pages)
    wanted = F.filter("lines", lambda line: (line["kind"] == "text") & ~is_blank(line["text"]))
    keys = blocked.select(
        "doc_id", BLOCK, F.explode_outer(F.array_distinct(F.transform(wanted, lambda x: collapse_digits(x["text"])))).alias("pattern")
    ).filter(F.col("pattern").isNotNull())
    hits = keys.distinct().join(settle(running_patterns(pages)), ["doc_id", "pattern"], "left_semi")
    per_block = hits.groupBy("doc_id", BLOCK).agg(F.collect_list("pattern").alias("_patterns"))
    joined = blocked.join(settle(per_block), ["doc_id", BLOCK], "left")
    kept = F.filter(
        "lines",
        lambda line: (line["kind"] != "text") | ~F.array_contains(F.col("_patterns"), collapse_digits(line["text"])),
    )
    lines = F.when(F.col("_patterns").isNull(), F.col("lines")).otherwise(kept)
    return joined.select(*PAGE, BLOCK, lines.alias("lines"))


def mark_headings(pages: DataFrame) -> DataFrame:
    """Add a ``heading`` flag to every line of a page row."""
    flagged = lambda line: line.withField("heading", (line["kind"] == "text") & is_heading(line["text"]))
    return pages.withColumn("lines", F.transform("lines", flagged))


def with_sections(pages: DataFrame) -> DataFrame:
    """Marked page rows -> lines with ``section``, the latest heading at or above the line across pages."""
    if BLOCK not in pages.columns:
        pages = _blocked_pages(pages)
    headings = F.filter("lines", lambda line: line["heading"])
    tail = strip(F.try_element_at(headings, F.lit(-1))["text"])
    tails = (
        pages.select("doc_id", BLOCK, "page_no", tail.alias("_tail"))
        .groupBy("doc_id", BLOCK)
        .agg(F.max_by("_tail", F.when(F.col("_tail").isNotNull(), F.col("page_no"))).alias("_tail"))
    )
    before = Window.partitionBy("doc_id").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("doc_id", BLOCK, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    lines = pages.select(*PAGE, BLOCK, F.inline_outer("lines")).filter(F.col("line_no").isNotNull())
    here = Window.partitionBy("doc_id", BLOCK).orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("heading"), strip(F.col("text"))), ignorenulls=True).over(here)
    joined = lines.withColumn("_own", own).join(carry, ["doc_id", BLOCK], "left")
    return joined.withColumn("section", F.coalesce("_own", "_carry")).drop("_own", "_carry")


def with_segments(lines: DataFrame) -> DataFrame:
    """Add ``segment``: a heading, a table edge or a new page opens the next one."""
    order = Window.partitionBy("doc_id", BLOCK, "page_no").orderBy("line_no")
    breaks = (
        F.col("heading")
        | (F.lag("kind").over(order) != F.col("kind"))
        | ((F.col("kind") == "table") & ~F.lag("table_no").over(order).eqNullSafe(F.col("table_no")))
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int"))
    return marked.withColumn("segment", F.sum("_break").over(running)).drop("_break")


def _ordered_text(order: str, value: Column, glue: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), glue)


def assemble_segments(lines: DataFrame) -> DataFrame:
    """One row per non-empty segment, short lead-ins folded into the table that follows them."""
    rendered = F.when(F.col("kind") == "table", pipe_row(F.col("cells"))).otherwise(F.col("text"))
    segments = (
        lines.filter(~F.col("heading"))
        .withColumn("_rendered", rendered)
        .groupBy("doc_id", BLOCK, "page_no", "segment", "kind")
        .agg(
            strip(_ordered_text("line_no", F.col("_rendered"), "\n")).alias("text"),
            F.min_by("_rendered", "line_no").alias("first_line"),
            F.max("section").alias("section"),
        )
        .filter(F.col("text") != "")
    )
    order = Window.partitionBy("doc_id", BLOCK, "page_no").orderBy("segment")
    table_next = (F.lead("kind").over(order) == "table") & (F.lead("segment").over(order) == F.col("segment") + 1)
    short = (F.col("kind") == "text") & (F.length("text") < SHORT_LEAD_IN_CHARS)
    marked = segments.withColumn("_lead_in", F.coalesce(short & table_next, F.lit(False)))
    previous = F.lag(F.when(F.col("_lead_in"), F.col("text"))).over(order)
    folded = marked.withColumn("_prefix", F.when(F.col("kind") == "table", previous)).filter(~F.col("_lead_in"))
    return folded.select(
        *PAGE,
        "segment",
        F.concat_ws("\n", "_prefix", "text").alias("text"),
        "section",
        F.when(F.col("kind") == "table", F.col("first_line")).alias("table_header"),
    )


def segment_pages(pages: DataFrame) -> DataFrame:
    """Page rows -> units(doc_id, unit_no, text, section, page_start, page_end, table_header).

    ``unit_no`` counts within the page; document order is (page_start, unit_no).
    """
    segments = assemble_segments(with_segments(with_sections(mark_headings(strip_running_lines(pages)))))
    return segments.select(
        "doc_id",
        F.col("segment").alias("unit_no"),
        "text",
        "section",
        F.col("page_no").alias("page_start"),
        F.col("page_no").alias("page_end"),
        "table_header",
    )


def segment_lines(lines: DataFrame) -> DataFrame:
    """lines table -> units."""
    return segment_pages(page_rows(lines))


def block_units(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, block_no, kind, style, text, rows array<array<string>>) -> one unit per non-empty block.

    ``Heading*`` and ``Title`` styles set the section and are consumed; positions count every block.
    """
    style = F.lower(F.coalesce("style", F.lit("")))
    paragraph = strip(F.coalesce("text", F.lit("")))
    table = F.array_join(F.transform(F.filter("rows", lambda r: ~row_is_empty(r)), pipe_row), "\n")
    body = F.when(F.col("kind") == "table", F.coalesce(table, F.lit(""))).otherwise(paragraph)
    is_head = (F.col("kind") != "table") & (style.startswith("heading") | (style == "title")) & (body != "")
    marked = blocks.select("doc_id", "block_no", body.alias("text"), is_head.alias("heading"))
    scanned = carry_forward(marked, ["doc_id"], ["block_no"], F.when(F.col("heading"), F.col("text")), "section")
    kept = scanned.filter(~F.col("heading") & (F.col("text") != ""))
    return kept.select(
        "doc_id",
        F.col("block_no").alias("unit_no"),
        "text",
        "section",
        F.col("block_no").alias("paragraph_start"),
        F.col("block_no").alias("paragraph_end"),
    )


def slide_units(shapes: DataFrame) -> DataFrame:
    """shapes(doc_id, slide_no, shape_no, is_title, text, rows) -> one unit per non-empty slide."""
    table = F.array_join(F.transform(F.filter("rows", lambda r: ~row_is_empty(r)), pipe_row), "\n")
    own_text = strip(F.coalesce("text", F.lit("")))
    part = F.concat_ws("\n", F.when(own_text != "", own_text), F.when(table != "", table))
    title = F.max(F.when(F.col("is_title") & (own_text != ""), own_text))
    slides = (
        shapes.withColumn("_part", part)
        .groupBy("doc_id", "slide_no")
        .agg(
            strip(_ordered_text("shape_no", F.when(F.col("_part") != "", F.col("_part")), "\n")).alias("text"),
            title.alias("section"),
        )
    )
    return slides.filter(F.col("text") != "").select(
        "doc_id",
        F.col("slide_no").alias("unit_no"),
        "text",
        "section",
        F.col("slide_no").alias("slide_number"),
        F.col("section").alias("slide_title"),
    )
