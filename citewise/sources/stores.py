"""Stored tables that change in place with plain Parquet folders: replaced units, removed owners, compacted files.

Rows are dealt to a bounded number of folders by hashes of their owner and of the unit that is replaced as a whole, so
neither owners nor units make folders of their own. A change reads and rewrites only the folders that hold touched rows,
by dynamic partition overwrite; all others keep their files. The list of touched folders, at most places x parts, is
all that passes through the driver. A table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.plans.materialize import settle

PLACE, PART = "place", "part"
FILE_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class Layout:
    """``owner`` columns name whose rows they are, ``unit`` columns what is replaced whole, ``row`` one row of a unit."""

    owner: tuple[str, ...]
    unit: tuple[str, ...]
    row: tuple[str, ...]
    places: int = 64
    parts: int = 16

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({PLACE: bucket(self.owner, self.places), PART: bucket(self.unit, self.parts)})


POINTS = Layout(("user_id", "session_id"), ("user_id", "session_id", "doc_id"), ("chunk_id",))
SHEET_ROWS = Layout(("sheet_id",), ("sheet_id",), ("_row_id",), parts=1)


def bucket(columns: Sequence[str | Column], buckets: int) -> Column:
    """0 to buckets - 1 from the texts of the columns, so that it does not hang on their number types."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.pmod(F.xxhash64(*texts), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _pieces(rows: DataFrame) -> list[tuple[int, int]]:
    """Folders that hold the rows; at most places x parts."""
    return sorted((r[PLACE], r[PART]) for r in rows.select(PLACE, PART).distinct().collect())


def _in_pieces(pieces: Sequence[tuple[int, int]]) -> Column:
    """A partition filter, one clause per place."""
    parts: dict[int, list[int]] = {}
    for place, part in pieces:
        parts.setdefault(place, []).append(part)
    clauses = [(F.col(PLACE) == place) & F.col(PART).isin(own) for place, own in parts.items()]
    return reduce(lambda a, b: a | b, clauses, F.lit(False))


def _rewrite(rows: DataFrame, path: str, sort: Sequence[str] = ()) -> None:
    """Replace the folders of the rows; large folders are split over tasks, small ones get one file."""
    dealt = rows.hint("rebalance", F.col(PLACE), F.col(PART))
    dealt = dealt.sortWithinPartitions(PLACE, PART, *sort) if sort else dealt
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(PLACE, PART).parquet(path)


def _drop(spark: SparkSession, path: str, pieces: Sequence[tuple[int, int]]) -> None:
    for place, part in pieces:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PLACE}={place}/{PART}={part}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(spark: SparkSession, path: str, layout: Layout | None = None, owner: Sequence | None = None) -> DataFrame:
    """Rows of a stored table; with an owner, only its folder is listed and its rows are kept."""
    rows = spark.read.parquet(path)
    if owner is not None:
        rows = rows.filter(F.col(PLACE) == bucket([F.lit(v) for v in owner], layout.places))
        for name, value in zip(layout.owner, owner):
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows.drop(PLACE, PART)


def replace_units(rows: DataFrame, path: str, layout: Layout, units: DataFrame | None = None) -> None:
    """Write rows so that each of their units holds them and nothing from before.

    ``units`` adds units that now have no rows. Equal row ids of a unit are written once. The rows are settled first, as
    what they cost to compute, such as vectors, is read twice. Writing the same rows again changes nothing.
    """
    spark = rows.sparkSession
    fresh = layout.placed(rows.dropDuplicates([*layout.unit, *layout.row]))
    if not _exists(spark, path):
        _rewrite(fresh, path, layout.row)
        return
    fresh = settle(fresh)
    named = fresh.select(*layout.unit, PLACE, PART).distinct()
    if units is not None:
        named = settle(named.unionByName(layout.placed(units.select(*layout.unit))).distinct())
    pieces = _pieces(named)
    before = spark.read.parquet(path).filter(_in_pieces(pieces))
    same = reduce(lambda a, b: a & b, [before[c].eqNullSafe(named[c]) for c in layout.unit])
    merged = before.join(named, same, "left_anti").unionByName(fresh.select(*before.columns))
    left = set(_pieces(merged)) if units is not None else set(pieces)
    _rewrite(merged, path, layout.row)
    _drop(spark, path, [p for p in pieces if p not in left])


def remove_owners(spark: SparkSession, path: str, layout: Layout, tombstones: DataFrame) -> int:
    """Take the rows of the tombstones' owners off the disk; the number of folders that were changed.

    Folders with such rows are found by a semi join that reads the owner columns of the owners' places only. The rest of
    each is written again, and a folder that holds nothing else is deleted. Owners without rows change nothing, nor does
    a second removal.
    """
    if not _exists(spark, path):
        return 0
    gone = settle(tombstones.select(*layout.owner).distinct().withColumn(PLACE, bucket(layout.owner, layout.places)))
    places = [r[PLACE] for r in gone.select(PLACE).distinct().collect()]
    rows = spark.read.parquet(path).filter(F.col(PLACE).isin(places))
    pieces = _pieces(rows.join(gone.drop(PLACE), list(layout.owner), "left_semi"))
    if not pieces:
        return 0
    kept = rows.filter(_in_pieces(pieces)).join(gone.drop(PLACE), list(layout.owner), "left_anti")
    left = set(_pieces(kept))
    if left:
        _rewrite(kept, path, layout.row)
    _drop(spark, path, [p for p in pieces if p not in left])
    return len(pieces)


def compact(spark: SparkSession, path: str, layout: Layout, file_bytes: int = FILE_BYTES) -> int:
    """Write folders with more files than their bytes need again; the number of folders that were changed."""
    rows = spark.read.parquet(path)
    files = rows.select(PLACE, PART, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    sized = files.groupBy(PLACE, PART).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    pieces = _pieces(sized.filter(F.col("files") > F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(file_bytes)))))
    if pieces:
        _rewrite(rows.filter(_in_pieces(pieces)), path, layout.row)
    return len(pieces)
