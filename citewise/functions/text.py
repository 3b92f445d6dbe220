"""Text expressions used by segmentation, chunking and reranking.

Python-style whitespace is used throughout: Spark's ``trim`` strips spaces only, so ``strip`` passes the full set
to ``btrim``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = f"[{WHITESPACE}]+"
# Fixed value: every line boundary a text decoder recognises.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# What a heading line looks like.
HEADING_PATTERN = r"^[A-Z0-9][A-Za-z0-9 ,.&/'\-]{2,79}$"
TITLE_CASE_PATTERN = r"^[^A-Za-z]*([A-Z][a-z]*([^A-Za-z]+|$))+$"
HEADING_MAX_CHARS = 80

BLANK_CELL = "(blank)"
CELL_SEPARATOR = " | "
SHORT_LEAD_IN_CHARS = 80


def let(value: Column, body) -> Column:
    """Bind ``value`` once and hand it to ``body``; keeps an expensive expression from being repeated."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Trim; texts whose first and last characters are not white space pass without being scanned."""

    def padded(char: Column) -> Column:
        return F.instr(F.lit(WHITESPACE), char) > 0

    return F.when(padded(F.left(col, F.lit(1))) | padded(F.right(col, F.lit(1))), F.btrim(col, F.lit(WHITESPACE))).otherwise(col)


def is_blank(col: Column) -> Column:
    return F.coalesce(F.ltrim(col, F.lit(WHITESPACE)) == "", F.lit(True))


def normalize(col: Column) -> Column:
    """Lower-case, collapse white space runs to one blank, trim."""
    return F.trim(F.regexp_replace(F.lower(col), WHITESPACE_RUN, " "))


def plain_blanks(col: Column) -> Column:
    """Every white space character as a blank."""
    return F.translate(col, WHITESPACE, " " * len(WHITESPACE))


def words(col: Column) -> Column:
    """Distinct whitespace-separated lower-case words, punctuation kept."""
    return F.array_distinct(F.filter(F.split(plain_blanks(F.lower(col)), " "), lambda w: w != ""))


def lexical_overlap(question: Column, passage: Column) -> Column:
    """Distinct words of the question that also stand in the passage; the passage is searched, not taken apart."""
    return let(spaced(passage), lambda padded: words_within(question, padded))


def spaced(passage: Column) -> Column:
    """The passage in lower case with single blanks between its words and around them."""
    return F.concat(F.lit(" "), plain_blanks(F.lower(passage)), F.lit(" "))


def words_within(question: Column, padded: Column) -> Column:
    """Distinct words of the question that stand in a ``spaced`` passage."""
    return F.size(F.filter(words(question), lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))))


def tokens(col: Column) -> Column:
    """Runs of ``[a-z0-9]`` in the lower-cased text."""
    return F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9]+)"), F.lit(1))


def split_lines(col: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    lines = F.split(col, LINE_BREAK)
    return let(lines, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def collapse_digits(col: Column) -> Column:
    return F.regexp_replace(strip(col), r"\p{Nd}+", "#")


def is_heading(col: Column) -> Column:
    def test(line: Column) -> Column:
        all_upper = line.rlike("[A-Z]") & ~line.rlike("[a-z]")
        return (
            (F.length(line) <= HEADING_MAX_CHARS)
            & ~line.rlike("[.,;:]$")
            & line.rlike(HEADING_PATTERN)
            & (all_upper | line.rlike(TITLE_CASE_PATTERN))
        )

    return F.coalesce(let(strip(col), test), F.lit(False))


def cell_text(col: Column) -> Column:
    return let(strip(F.coalesce(col, F.lit(""))), lambda c: F.when(c == "", BLANK_CELL).otherwise(c))


def pipe_row(cells: Column) -> Column:
    """Cells joined by `` | `` with blanks marked."""
    return F.array_join(F.transform(cells, cell_text), CELL_SEPARATOR)


def row_is_empty(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: ~is_blank(c))


def line_number_at(text: Column, offset: Column) -> Column:
    """1-based line holding the 0-based character ``offset``."""
    prefix = F.substring(text, F.lit(1), offset)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1
