"""CSV records out of splittable line scans.

Whether a line begins inside a quoted cell depends on everything before it, so a file seems to need one reader. Here every
line is read where it lies and becomes a function of that one bit: it keeps it, flips it, or sets it. The functions
are combined along each split, one summary row per split is combined along its file, and only then are records
numbered and cut. No file is read by a single task unless it is a single split, and only lines of records that run over
several lines meet again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citewise.plans.materialize import settle

# Where a reader stands: inside an unquoted cell, at the start of a cell, inside quotes, just behind a closing quote.
IN_CELL, CELL_START, QUOTED, CLOSED = 0, 1, 2, 3
PLACE = ("split", "at", "part")


def _after_quote(state: Column) -> Column:
    """A quote opens a cell only at its start; inside quotes it closes, and a second one right behind is a quote again."""
    return F.when(state == CELL_START, QUOTED).when(state == QUOTED, CLOSED).when(state == CLOSED, QUOTED).otherwise(state)


def _after_text(state: Column, text: Column) -> Column:
    moved = F.when(F.endswith(text, F.lit(",")), CELL_START).otherwise(IN_CELL)
    return F.when((state == QUOTED) | (text == ""), state).otherwise(moved)


def ends_quoted(line: Column, begins_quoted: bool) -> Column:
    """Whether a quoted cell is open at the end of a line, folded over the texts between its quotes."""
    step = lambda state, text, quote: _after_text(F.when(quote, _after_quote(state)).otherwise(state), text)
    texts = F.transform(F.split(line, '"'), lambda text, i: F.struct(text.alias("text"), (i > 0).alias("quote")))
    start = F.lit(QUOTED if begins_quoted else CELL_START)
    folded = F.aggregate(texts, start, lambda state, x: step(state, x["text"], x["quote"]).cast("int"))
    return F.when(line.contains('"'), folded == QUOTED).otherwise(F.lit(begins_quoted))


def record_cells(record: Column) -> Column:
    """Cells of one whole record; a quote inside an unquoted cell is text, as is what follows a closing quote."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("cells"), F.lit("").alias("open"), F.lit(CELL_START).alias("state"))
    texts = F.transform(F.split(record, '"'), lambda text, i: F.struct(text.alias("text"), (i > 0).alias("quote")))

    def fold(held: Column, x: Column) -> Column:
        before, quote, text = held["state"], x["quote"], x["text"]
        state = F.when(quote, _after_quote(before)).otherwise(before)
        kept = quote & before.isin(IN_CELL, CLOSED)
        open_ = F.when(kept, F.concat(held["open"], F.lit('"'))).otherwise(held["open"])
        parts = F.split(text, ",")
        cut = (state != QUOTED) & (F.size(parts) > 1)
        closed = F.concat(held["cells"], F.array(F.concat(open_, parts[0])), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
        return F.struct(
            F.when(cut, closed).otherwise(held["cells"]).alias("cells"),
            F.when(cut, F.element_at(parts, -1)).otherwise(F.concat(open_, text)).alias("open"),
            _after_text(state, text).cast("int").alias("state"),
        )

    folded = F.aggregate(texts, start, fold, lambda held: F.concat(held["cells"], F.array(held["open"])))
    return F.when(record.contains('"'), folded).otherwise(F.split(record, ","))


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sheet_id, sheet_name, split, at, part, line, ending) of every physical line; lines end in LF, CR LF or CR."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("sheet_id"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("sheet_name"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.make_valid_utf8(F.col("value")).alias("value"),
    )
    head = (F.col("split") == 0) & F.startswith("value", F.lit("\ufeff"))
    first = Window.partitionBy("sheet_id", "split").orderBy("at")
    body = F.when(F.endswith("value", F.lit("\r")), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    parts = F.when(body.contains("\r"), F.split(body, "\r")).otherwise(F.array(body))
    cut = lines.withColumn("marked", head).withColumn("crlf", F.endswith("value", F.lit("\r")))
    cut = cut.select("sheet_id", "sheet_name", "split", "at", "marked", "crlf", F.size(parts).alias("parts"), F.posexplode(parts).alias("part", "line"))
    # a byte order mark is one only at the very start of a file
    starts = F.col("marked") & (F.col("part") == 0) & (F.row_number().over(first.orderBy("at", "part")) == 1)
    ending = F.when(F.col("part") < F.col("parts") - 1, "\r").when(F.col("crlf"), "\r\n").otherwise("\n")
    line = F.when(starts, F.expr("substring(line, 2)")).otherwise(F.col("line"))
    return cut.select("sheet_id", "sheet_name", "split", "at", "part", line.alias("line"), ending.alias("ending"))


def _composed(rows: DataFrame, keys: list[str], order: list[str], keeps: Column, sets: Column) -> DataFrame:
    """Add if_out and if_in: the bit before each row, had its key begun with it unset or set.

    A row sets the bit where ``sets`` is not null, and else keeps or flips it.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    flips = rows.withColumn("_flips", F.coalesce(F.sum((~keeps & sets.isNull()).cast("int")).over(before), F.lit(0)))
    marked = F.when(sets.isNotNull(), F.struct(sets.cast("int").alias("bit"), F.col("_flips").alias("flips")))
    told = flips.withColumn("_last", F.last(marked, ignorenulls=True).over(before))
    since = F.col("_flips") - F.coalesce(F.col("_last.flips"), F.lit(0))
    bit = lambda start: (F.coalesce(F.col("_last.bit"), F.lit(start)) + since) % 2 == 1
    return told.withColumn("if_out", bit(0)).withColumn("if_in", bit(1)).drop("_flips", "_last")


def csv_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(sheet_id, sheet_name, row_idx, record) of CSV files: whole records in file order, blank lines between them skipped.

    A quoted cell may hold line breaks of any kind and quotes as two quotes; with ``multi_line`` off every line is a
    record. A file that ends inside quotes ends its last record there. Rows are written once, so that all steps see the
    same splits.
    """
    lines = csv_lines(spark, path)
    out, in_ = (ends_quoted(F.col("line"), begins) if multi_line else F.lit(False) for begins in (False, True))
    lines = lines.withColumn("from_out", out).withColumn("from_in", in_)
    sets = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    told = _composed(lines, ["sheet_id", "split"], ["at", "part"], ~F.col("from_out") & F.col("from_in"), sets)
    blank = F.col("line").rlike(r"^[ \t]*$")
    upto = Window.partitionBy("sheet_id", "split").orderBy("at", "part")
    for name in ("out", "in"):
        told = told.withColumn(f"begun_{name}", F.sum((~F.col(f"if_{name}") & ~blank).cast("bigint")).over(upto))
        told = told.withColumn(f"end_{name}", F.when(F.col(f"if_{name}"), F.col("from_in")).otherwise(F.col("from_out")))
    told = settle(told)

    splits = told.groupBy("sheet_id", "split").agg(
        *[F.max_by(f"end_{n}", F.struct("at", "part")).alias(f"end_{n}") for n in ("out", "in")],
        *[F.max(f"begun_{n}").alias(f"n_{n}") for n in ("out", "in")],
    )
    sets = F.when(F.col("end_out") == F.col("end_in"), F.col("end_out"))
    splits = _composed(splits, ["sheet_id"], ["split"], ~F.col("end_out") & F.col("end_in"), sets)
    held = F.when(F.col("if_out"), F.col("n_in")).otherwise(F.col("n_out"))
    earlier = Window.partitionBy("sheet_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("sheet_id", "split", F.col("if_out").alias("opened"), F.coalesce(F.sum(held).over(earlier), F.lit(0)).alias("before"))

    told = told.join(splits, ["sheet_id", "split"])
    pick = lambda name: F.when(F.col("opened"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))
    lined = told.select(
        "sheet_id", "sheet_name", *PLACE, "line", "ending", pick("if").alias("inside"), pick("end").alias("open"),
        (F.col("before") + pick("begun") - 1).alias("row_idx"),
    )
    lined = lined.filter(F.col("inside") | ~blank)
    whole = lined.filter(~F.col("inside") & ~F.col("open"))
    pieces = lined.filter(F.col("inside") | F.col("open"))
    piece = F.struct(*PLACE, "line", "ending", "open")
    text = F.transform("pieces", lambda p: F.concat(p["line"], F.when(p["open"], p["ending"]).otherwise("")))
    joined = pieces.groupBy("sheet_id", "sheet_name", "row_idx").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    several = joined.select("sheet_id", "sheet_name", "row_idx", F.array_join(text, "").alias("record"))
    return whole.select("sheet_id", "sheet_name", "row_idx", F.col("line").alias("record")).unionByName(several)
