"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm import words
from grainfold.session import scratch_path


def give_back() -> None:
    """What a Python worker holds and no longer uses goes back to the system: workers stay from stage to stage, and freed memory with them."""
    words.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work):
    """A function over the batches of a task that leaves no memory behind."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def tidy_group(work):
    """The same for a function over one group."""

    def run(group):
        try:
            return work(group)
        finally:
            give_back()

    return run


def tidy_groups(work):
    """The same for a function over two groups of one key."""

    def run(left, right):
        try:
            return work(left, right)
        finally:
            give_back()

    return run


def held_out(id_column: str) -> F.Column:
    """True for the third of the rows on which labels must not be learnt."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a table written inside go as soon as it is written, instead of when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def keep_in_folder(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and go on from its files, so lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._folder = path  # for discard
    return kept


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``keep_in_folder`` wrote, once everything that reads them is written itself."""
    for table in tables:
        folder = getattr(table, "_folder", None)
        if folder:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_narrow(df: DataFrame, name: str) -> DataFrame:
    """The same for a table of few bytes a row: at most two parts for each core of the cluster, so that small ones cost few tasks."""
    return keep_in_folder(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism), name)


BROADCAST_ROWS = 1_000_000  # counted rows of ids up to which a table is sent to the others instead of dealt by its key


def sent(df: DataFrame, rows: int) -> DataFrame:
    """The table marked for broadcast where its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under the names c0, c1, ..., so that working columns beside them cannot clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under their working names; whatever else a table holds cannot clash."""
    return df.select(*[F.col(quoted(source)).alias(name) for name, source in columns.items()])
