"""Identifier rules for sheet columns and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewise.functions.text import let, strip

# Words that may not stand alone as a column name.
RESERVED_WORDS = ("select", "from", "where", "table", "order", "group", "by", "insert", "update", "delete")
TABLE_PREFIX = "xlsx_"
TABLE_SLUG_CHARS = 32
IDENTIFIER_CHARS = 63


def _slug(col: Column) -> Column:
    lowered = F.regexp_replace(F.lower(strip(col)), "[^a-z0-9_]", "_")
    return F.btrim(F.regexp_replace(lowered, "_+", "_"), F.lit("_"))


def column_slug(col: Column) -> Column:
    """Header text -> ``[a-z0-9_]`` identifier, before de-duplication."""

    def finish(slug: Column) -> Column:
        named = F.when(slug == "", "col").when(slug.rlike("^[0-9]"), F.concat(F.lit("col_"), slug)).otherwise(slug)
        return let(named, lambda n: F.when(n.isin(*RESERVED_WORDS), F.concat(n, F.lit("_col"))).otherwise(n))

    return let(_slug(col), finish)


def distinct_names(names: Column) -> Column:
    """De-duplicate an ordered array of slugs: a taken name gets the first free ``_2``, ``_3``, ... suffix."""

    def add(taken: Column, name: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(2), F.size(taken) + 2), lambda i: F.concat(name, F.lit("_"), i.cast("string"))
        )
        free = F.get(F.filter(numbered, lambda candidate: ~F.array_contains(taken, candidate)), F.lit(0))
        chosen = F.when(F.array_contains(taken, name), free).otherwise(name)
        return F.concat(taken, F.array(chosen))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def table_name(session_id: Column, sheet_name: Column, sheet_id: Column) -> Column:
    """``xlsx_{slug}_{10 hex}``."""
    slug = let(F.substring(_slug(sheet_name), 1, TABLE_SLUG_CHARS), lambda s: F.when(s == "", "sheet").otherwise(s))
    digest = F.substring(F.sha2(F.concat(session_id, F.lit(":"), sheet_id), 256), 1, 10)
    return F.substring(F.concat(F.lit(TABLE_PREFIX), slug, F.lit("_"), digest), 1, IDENTIFIER_CHARS)
