"""What the operators share: word pattern, table reading, and tables written between stages."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.scratch import work_dir

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch while a table is written: texts are long, so fewer than Spark's 10,000.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


#: Bytes of a table that a join sends to every task; a larger one is joined by shuffle.
SENT_BYTES = 32 << 20


def sent_if_small(df: DataFrame, row_bytes: int, n: int | None = None) -> DataFrame:
    """df marked for broadcast where its rows of row_bytes in memory, n or fewer, are SENT_BYTES or less together.

    Without n the rows are counted, so df should be a stored table.
    """
    n = df.count() if n is None else n
    return F.broadcast(df) if n * row_bytes <= SENT_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, for results that are computed when the caller reads them."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def lean() -> None:
    """In a Python worker: Arrow buffers go back to the system when they are freed, and what earlier tasks freed goes back now."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim()


def trim() -> None:
    """Gives freed pages back to the system, so that workers that wait hold little; nothing where the C library can't."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again.

    Lineage ends there: a lost executor costs the tasks of the stage that reads the table, not the
    work that made it.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(before), BATCH_ROWS)))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)
