"""Cell values: numeric and date recognition, typed canonical form, display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewise.functions.text import let, strip

NUMERIC_TYPE = "decimal(38,4)"
# Which strings count as numbers.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
# Month names by their first three letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)"
)
# Date shapes accepted in text cells, each with the group numbers of year, month and day (0 = first).
CLOCK = r"(?:[t ,]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?\s*([ap]m)?\s*(?:z|utc|[+-]\d{2}:?\d{2})?)?$"
DATE_SHAPES = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", (1, 2, 3)),
    (r"^(\d{4})[-/.](\d{1,2})$", (1, 2, 0)),
    (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
    (r"^(\d{4})$", (1, 0, 0)),
    (r"^(0?[1-9]|1[0-2])[-/.](\d{1,2})[-/.](\d{4})$", (3, 1, 2)),
    (r"^(1[3-9]|2\d|3[01])[-/.](\d{1,2})[-/.](\d{4})$", (3, 2, 1)),
    (r"^(\d{1,2})(?:st|nd|rd|th)?[- ]?" + MONTH_NAME + r"[-., ]*(\d{4}|\d{2})$", (3, 2, 1)),
    (r"^" + MONTH_NAME + r"\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$", (3, 1, 2)),
    (r"^" + MONTH_NAME + r"[-., ]+(\d{4})$", (2, 1, 0)),
)


def is_number(col: Column) -> Column:
    return col.rlike(NUMBER_PATTERN)


def to_integer(col: Column) -> Column:
    return F.when(col.rlike(INTEGER_PATTERN), strip(col).try_cast("bigint"))


def is_integer(col: Column) -> Column:
    return to_integer(col).isNotNull()


def to_double(col: Column) -> Column:
    return F.when(is_number(col), strip(col).try_cast("double"))


def has_digit(col: Column) -> Column:
    return col.rlike(r"\p{Nd}")


def parse_timestamp(col: Column) -> Column:
    """Date text in one of the accepted shapes -> timestamp without zone, else null (month first when ambiguous)."""

    def month_number(name: Column) -> Column:
        named = F.floor((F.instr(F.lit(MONTHS), F.substring(name, 1, 3)) - 1) / 3) + 1
        return F.when(name.rlike("^[a-z]"), named.cast("string")).otherwise(name)

    def full_year(year: Column) -> Column:
        short = year.try_cast("int")
        return F.when(F.length(year) == 2, (short + F.when(short < 69, 2000).otherwise(1900)).cast("string")).otherwise(year)

    def read(text: Column) -> Column:
        clock = [F.regexp_extract(text, CLOCK, i) for i in range(1, 5)]
        hour = clock[0].try_cast("int")
        hour = F.when(clock[3] == "pm", hour % 12 + 12).when(clock[3] == "am", hour % 12).otherwise(hour)
        second = F.when(clock[2] == "", "00").otherwise(clock[2])
        time = F.when(clock[0] != "", F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), clock[1], second))

        def assemble(day_text: Column) -> Column:
            found = F.lit(None).cast("string")
            for shape, (year, month, day) in reversed(DATE_SHAPES):
                part = lambda i: F.regexp_extract(day_text, shape, i) if i else F.lit("1")  # noqa: B023, E731
                iso = F.concat_ws(
                    "-", full_year(part(year)), F.lpad(month_number(part(month)), 2, "0"), F.lpad(part(day), 2, "0")
                )
                found = F.when(day_text.rlike(shape), iso).otherwise(found)
            return F.concat_ws(" ", found, time).try_cast("timestamp_ntz")

        return let(F.regexp_replace(text, CLOCK, ""), assemble)

    return F.when(has_digit(col), let(F.lower(strip(col)), read))


def display_timestamp(ts: Column) -> Column:
    return ts.cast("string")


def display_float(col: Column) -> Column:
    """Shortest decimal text of a double: plain digits between 1e-4 and 1e16, exponent form outside."""

    def render(text: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
        exponent = F.regexp_extract(text, r"E(-?)(\d+)$", 2)
        signed = F.concat(
            F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", ""),
            F.lit("e"),
            F.when(text.contains("E-"), "-").otherwise("+"),
            F.lpad(exponent, 2, "0"),
        )
        size = F.abs(text.try_cast("double"))
        return (
            F.when(~text.contains("E"), text)
            .when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(signed)
        )

    return let(col.cast("string"), render)


def canonical_text(value: Column, data_type: Column) -> Column:
    """The stored form of a cell under its inferred type, as text; a cell that does not fit becomes null."""
    return (
        F.when(data_type == "INTEGER", strip(value).try_cast("bigint").cast("string"))
        .when(data_type == "NUMERIC", F.when(is_number(value), strip(value).try_cast("double").try_cast(NUMERIC_TYPE).cast("string")))
        .when(data_type == "BOOLEAN", value.try_cast("boolean").cast("string"))
        .when(data_type == "TIMESTAMP", parse_timestamp(value).cast("string"))
        .otherwise(value)
    )


def display_value(col: Column, kind: str) -> Column:
    """A result cell as evidence text: fractions rounded to four places without trailing zeros, the rest as is."""
    if kind.startswith("decimal") or kind in ("double", "float"):
        text = F.regexp_replace(F.regexp_replace(col.cast("decimal(38,4)").cast("string"), "0+$", ""), r"\.$", "")
        return F.coalesce(F.when(text == "-0", "0").otherwise(text), F.lit("None"))
    if kind == "boolean":
        return F.coalesce(F.initcap(col.cast("string")), F.lit("None"))
    if kind.startswith("timestamp"):
        return F.coalesce(display_timestamp(col), F.lit("None"))
    return F.coalesce(col.cast("string"), F.lit("None"))
