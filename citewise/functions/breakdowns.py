"""Questions about a span of time, and questions that break a figure down by columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewise.functions.text import let, normalize, strip

MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
QUARTER_WORDS = ("first", "second", "third", "fourth")
DAY = r"(\d{4}-\d{2}-\d{2})"
YEAR = r"((?:19|20)\d{2})"
MONTH = r"(" + "|".join(MONTH_NAMES) + r")"
# Phrases of time, the more telling first: a span of days, a month, a quarter, since or before a day, a day, a year.
SPAN = rf"(?:between|from) {DAY} (?:and|to) {DAY}"
MONTH_OF_YEAR = rf"(?:in |during )?{MONTH},? {YEAR}"
QUARTER_OF_YEAR = rf"(?:in )?(?:the )?(?:q([1-4])|({'|'.join(QUARTER_WORDS)}) quarter)(?: of)? {YEAR}"
SINCE = rf"since {DAY}"
BEFORE = rf"before {DAY}"
ONE_DAY = rf"(?:on )?{DAY}"
ONE_YEAR = rf"\b(?:in |during )(?:the year )?{YEAR}\b"
PHRASES = (SPAN, MONTH_OF_YEAR, QUARTER_OF_YEAR, SINCE, BEFORE, ONE_DAY, ONE_YEAR)
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"
RANGE_TYPE = "struct<start:date,end:date>"

BY_PHRASE = r"\b(?:broken down by|grouped by|group by|for each|per|by)\s+(.+)$"
COUNT_PHRASE = r"how many|number of|count of|count\b"
AVERAGE_WORDS = r"\b(?:average|avg|mean)\b"
SUM_WORDS = r"\b(?:total|sum)\b"
GROUPING_TYPE = "struct<aggregate:string,column:string,keys:array<string>>"


def date_range(question: Column) -> Column:
    """struct(start, end) of the time a question names, the end being the first day that no longer counts; else null."""

    def day(text: Column) -> Column:
        return text.try_cast("date")

    def read(q: Column) -> Column:
        found = lambda phrase, i: F.regexp_extract(q, phrase, i)
        year_start = lambda year, month: day(F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01")))
        month = F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), found(MONTH_OF_YEAR, 1))
        named = F.array_position(F.array(*[F.lit(w) for w in QUARTER_WORDS]), found(QUARTER_OF_YEAR, 2))
        quarter = F.coalesce(found(QUARTER_OF_YEAR, 1).try_cast("int"), named)
        month_start = year_start(found(MONTH_OF_YEAR, 2), month)
        quarter_start = year_start(found(QUARTER_OF_YEAR, 3), quarter * 3 - 2)
        year = year_start(found(ONE_YEAR, 1), F.lit(1))
        one = day(found(ONE_DAY, 1))
        spans = (
            (day(found(SPAN, 1)), F.date_add(day(found(SPAN, 2)), 1)), (month_start, F.add_months(month_start, 1)),
            (quarter_start, F.add_months(quarter_start, 3)), (day(found(SINCE, 1)), day(F.lit(LAST_DAY))),
            (day(F.lit(FIRST_DAY)), day(found(BEFORE, 1))), (one, F.date_add(one, 1)), (year, F.add_months(year, 12)),
        )
        chosen = F.lit(None).cast(RANGE_TYPE)
        for phrase, (start, end) in reversed(list(zip(PHRASES, spans))):
            chosen = F.when(q.rlike(phrase), F.struct(start.alias("start"), end.alias("end")).cast(RANGE_TYPE)).otherwise(chosen)
        return chosen

    told = let(normalize(question), read)
    return F.when(told["start"].isNotNull() & told["end"].isNotNull(), told)


def without_dates(question: Column) -> Column:
    """The question without its phrase of time, so that nothing in it reads as a filter."""
    out = question
    for phrase in PHRASES:
        out = F.regexp_replace(out, f"(?i){phrase}", " ")
    return strip(F.regexp_replace(out, r"\s+", " "))


def asks_count(question: Column) -> Column:
    q = normalize(question)
    return q.rlike(rf"(?U){COUNT_PHRASE}") & ~q.rlike("unique|distinct")


def grouping(question: Column, columns: Column) -> Column:
    """struct(aggregate, column, keys) of a question that breaks a figure down, else null.

    Keys are the columns named behind "by", "per" or "for each", in the order they are named; COUNT has no column.
    """

    def read(q: Column) -> Column:
        by = F.regexp_extract(q, BY_PHRASE, 1)
        spoken = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(" "))
        bounded = lambda text: F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9 ]", " "), F.lit(" "))
        at = lambda text, c: F.instr(bounded(text), F.concat(F.lit(" "), spoken(c), F.lit(" ")))
        named = F.filter(F.transform(columns, lambda c: F.struct(at(by, c).alias("at"), c.alias("name"))), lambda k: k["at"] > 0)
        keys = F.transform(F.array_sort(named), lambda k: k["name"])
        head = F.regexp_replace(q, BY_PHRASE, "")
        target = F.get(F.filter(columns, lambda c: at(head, c) > 0), 0)
        aggregate = F.when(q.rlike(AVERAGE_WORDS), "AVG").when(q.rlike(SUM_WORDS), "SUM").when(q.rlike(COUNT_PHRASE), "COUNT")
        column = F.when(aggregate != "COUNT", target)
        known = q.rlike(BY_PHRASE) & (F.size(keys) > 0) & aggregate.isNotNull() & ((aggregate == "COUNT") | target.isNotNull())
        return F.when(known, F.struct(aggregate.alias("aggregate"), column.alias("column"), keys.alias("keys")).cast(GROUPING_TYPE))

    return let(F.rtrim(normalize(question), F.lit("?.! ")), read)


def _quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), name, F.lit('"'))


def grouping_sql(wanted: Column, table: Column) -> Column:
    keys = F.array_join(F.transform(wanted["keys"], _quoted), ", ")
    call = F.when(wanted["aggregate"] == "COUNT", "COUNT(*)").otherwise(F.concat(wanted["aggregate"], F.lit("("), _quoted(wanted["column"]), F.lit(")")))
    return F.concat(F.lit("SELECT "), keys, F.lit(", "), call, F.lit(" FROM "), table, F.lit(" GROUP BY "), keys, F.lit(" ORDER BY "), keys)


def ranged_sql(call: Column, table: Column, date_column: Column, span: Column, condition: Column) -> Column:
    """SELECT with a half-open range on the bare date column; condition is the text of a further filter or null."""
    start, end = (F.concat(F.lit("'"), span[side].cast("string"), F.lit("'")) for side in ("start", "end"))
    dates = F.concat(_quoted(date_column), F.lit(" >= "), start, F.lit(" AND "), _quoted(date_column), F.lit(" < "), end)
    return F.concat(F.lit("SELECT "), call, F.lit(" FROM "), table, F.lit(" WHERE "), F.concat_ws(" AND ", dates, condition))
