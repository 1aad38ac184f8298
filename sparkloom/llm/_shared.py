"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder as shared_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; any others, whatever they are called, are left behind."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it instead of computing it again, and it outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps, which it does once the driver's memory has no trace of them."""
    gc.collect()
    spark._jvm.System.gc()


#: Keys that join_counted() broadcasts at most, and rows that a key may have without being one of them.
HEAVY, LIGHT = 50_000, 1_000


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined with side (how: inner or left), which has one row a key and in column n how many of rows have it.

    A key of more than total / HEAVY rows is one of at most HEAVY keys, so that
    these travel as a broadcast of bounded size and their rows stay where they
    are; all others meet in a shuffle, with a bounded share of the rows a key.
    """
    total, most = side.agg(F.sum(n), F.max(n)).first()
    limit = max((total or 0) // HEAVY, LIGHT)
    if (most or 0) <= limit:
        return rows.join(side, keys, how)
    heavy = side.where(F.col(n) > limit)
    spread = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(side.where(F.col(n) <= limit), keys, how)
    return spread.unionByName(rest)


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What operators keep between tasks in a Python worker.
KEPT_IN_WORKER: dict[str, dict] = {}


def give_back() -> None:
    """Returns freed memory to the system: Arrow's, and what the C library holds between live blocks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let_go(owner: str) -> None:
    """Empties what other operators than owner have kept in this worker.

    A function of the module, which workers import: one that is made in another
    travels with a copy of the values that it names, here of an empty dict.
    """
    others = [kept for name, kept in KEPT_IN_WORKER.items() if name != owner and kept]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()
        give_back()


def in_worker(owner: str):
    """For functions over batches: lets go of what other operators have kept in this worker, and gives memory back after the task.

    Workers outlive a query's steps, and an executor's memory is the sum of its
    workers', idle ones included.
    """

    def wrap(run):
        def wrapped(batches):
            let_go(owner)
            try:
                yield from run(batches)
            finally:
                give_back()

        return wrapped

    return wrap
