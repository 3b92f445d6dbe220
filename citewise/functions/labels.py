"""Citation labels and source structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def location_label(page_start, page_end, slide_number, line_start, section) -> Column:
    """`` (page a-b, slide n, line n, section: s)`` or an empty string."""
    has_range = page_end.isNotNull() & (page_end != 0) & (page_end != page_start)
    page = F.when(
        page_start.isNotNull(),
        F.concat(F.lit("page "), page_start.cast("string"), F.when(has_range, F.concat(F.lit("-"), page_end.cast("string"))).otherwise("")),
    )
    parts = F.concat_ws(
        ", ",
        page,
        F.concat(F.lit("slide "), slide_number.cast("string")),
        F.concat(F.lit("line "), line_start.cast("string")),
        F.when(_present(section), F.concat(F.lit("section: "), section)),
    )
    return F.when(parts == "", "").otherwise(F.concat(F.lit(" ("), parts, F.lit(")")))


def short_location(content_type, filename, sheet_name, page_start, slide_number, line_start, section) -> Column:
    """One-line identity of a stored point: a sheet label, or the file name with compact location bits."""
    bits = F.concat_ws(
        " ",
        F.coalesce(filename, F.lit("?")),
        F.concat(F.lit("p."), page_start.cast("string")),
        F.concat(F.lit("slide "), slide_number.cast("string")),
        F.concat(F.lit("line "), line_start.cast("string")),
        F.when(_present(section), F.concat(F.lit("sec='"), section, F.lit("'"))),
    )
    sheet = F.concat(F.lit("sheet '"), F.coalesce(sheet_name, F.lit("None")), F.lit("' ("), F.coalesce(filename, F.lit("None")), F.lit(")"))
    return F.when(content_type == "excel_sheet", sheet).otherwise(bits)


# The fields cited for one evidence block, in order.
SOURCE_FIELDS = {
    "filename": "string",
    "file_type": "string",
    "chunk_id": "string",
    "page_start": "int",
    "page_end": "int",
    "section": "string",
    "slide_number": "int",
    "slide_title": "string",
    "line_start": "int",
    "line_end": "int",
    "score": "double",
}
SOURCE_TYPE = (
    "struct<type:string,"
    + ",".join(f"{name}:{kind}" for name, kind in SOURCE_FIELDS.items())
    + ",sql:string,row_count:bigint>"
)


def chunk_source(field) -> Column:
    """Source struct of an evidence block; ``field(name)`` gives the column for each cited field."""
    cited = [field(name).cast(kind).alias(name) for name, kind in SOURCE_FIELDS.items()]
    return F.struct(
        F.lit(None).cast("string").alias("type"),
        *cited,
        F.lit(None).cast("string").alias("sql"),
        F.lit(None).cast("bigint").alias("row_count"),
    )


def query_source(sql: Column, row_count: Column) -> Column:
    """Source struct of a table answer: the query and how many rows it returned."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in SOURCE_FIELDS.items()]
    return F.struct(
        F.lit("structured_query").alias("type"), *empty, sql.alias("sql"), row_count.cast("bigint").alias("row_count")
    )


def display_source(source: Column) -> Column:
    """Human-readable line for one source struct, empty when it names nothing."""
    rows = source["row_count"].cast("string")
    plural = F.when(source["row_count"] == 1, "").otherwise("s")
    query = F.concat(F.lit("Source: database query ("), rows, F.lit(" row"), plural, F.lit(")"))
    bits = F.concat_ws(
        ", ",
        F.when(source["page_start"] != 0, F.concat(F.lit("page "), source["page_start"].cast("string"))),
        F.when(source["slide_number"] != 0, F.concat(F.lit("slide "), source["slide_number"].cast("string"))),
        F.when(_present(source["section"]), F.concat(F.lit("section: "), source["section"])),
    )
    document = F.concat(
        F.lit("Source: "), source["filename"], F.when(bits == "", "").otherwise(F.concat(F.lit(" ("), bits, F.lit(")")))
    )
    return (
        F.when(source["type"] == "structured_query", query).when(_present(source["filename"]), document).otherwise("")
    )
