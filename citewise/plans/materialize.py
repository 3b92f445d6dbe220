"""Write an intermediate once when several branches of a plan read it, or when a join should know its true size.

Spark estimates an aggregate at the size of its input and would not broadcast it; once written, the file size counts:
under the broadcast threshold the side is broadcast, above it the join is shuffled and adaptive execution splits hot
keys. The copy is an ordinary Parquet table in the folder all executors share, so a lost executor costs a re-read.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()
SETTLED = "_settled_at"
_OPEN = threading.local()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the whole session is one local process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="citewise-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(local)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own part of the shared folder, which goes when its driver ends."""
    own = f"{shared_folder(spark)}/citewise-{spark.sparkContext.applicationId}"
    if own not in _FOLDERS:
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _FOLDERS.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of a finished write are of no more use: the written table is what later steps read."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def parts_for(spark: SparkSession, size: int | None, each: int) -> int:
    """Files for a table of this size: one for every ``each``, and two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, math.ceil((size or 0) / each))


def settle(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read back; ``parts`` bounds the files and tasks of the write.

    A small file costs more than its rows: on a local folder without Hadoop's native library an executor starts several
    processes for each. So a table whose size is known is not dealt to as many files as there are shuffle partitions.
    """
    spark = df.sparkSession
    path = shared_path(spark, "citewise")
    df = df.coalesce(parts) if parts else df
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    setattr(written, SETTLED, path)
    for made in getattr(_OPEN, "made", ()):
        made.append(written)
    return written


def settle_alone(make: Callable[[], DataFrame], parts: int | None = None) -> DataFrame:
    """What make gives, settled; whatever else was settled meanwhile is deleted, as only this result can need it."""
    made: list[DataFrame] = []
    _OPEN.made = [*getattr(_OPEN, "made", ()), made]
    try:
        result = settle(make(), parts)
    finally:
        _OPEN.made = _OPEN.made[:-1]
    for written in made[:-1]:
        discard(written)
    return result


def discard(written: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more, rather than at the end of the application."""
    path = written.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(written, SETTLED))
    path.getFileSystem(written.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
