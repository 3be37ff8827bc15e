"""Reading the tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint under spark.checkpoint.dir; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table under spark.checkpoint.dir: smaller than stored() for long tables of numbers."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A list of keys up to this many rows may be sent to every executor; a longer one is joined by a shuffle.
SHORT_LIST = 200_000


def if_short(keys: DataFrame) -> DataFrame:
    """Marks `keys` (rows of a few numbers) for a broadcast if they have been counted to be few."""
    return F.broadcast(keys) if keys.limit(SHORT_LIST + 1).count() <= SHORT_LIST else keys


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, with long keys as new expressions.

    A grouped table is dealt by its key already, and a join would take it as it
    stands; Spark splits a hot key of a join only if it has dealt both sides
    for that join itself.
    """
    return df.withColumns({key: F.expr(f"`{key}` ^ 0L") for key in keys})


def give_memory_back() -> None:
    """Returns what this worker has freed to the system; a worker lives on through the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def given_back(rows):
    """The same function on Arrow batches or groups; the task's memory is returned at its end."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_memory_back()

    return run


#: Rows of whole texts that a Python worker gets at once.
TEXTS_PER_BATCH = 512


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to TEXTS_PER_BATCH: the default of 10,000 is meant for short values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > TEXTS_PER_BATCH:
        spark.conf.set(key, str(TEXTS_PER_BATCH))
