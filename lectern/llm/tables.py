"""Shared small steps: reading tables, cutting lineage, numbering rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of whole texts in an Arrow batch, where the session has Spark's own setting (10000).
BATCH_ROWS = "2000"


def small_batches(spark: SparkSession) -> None:
    """Keep Python workers small: whole texts are long rows. A setting of the session's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; only where all tasks run in this process may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or os.path.join(os.path.abspath(os.curdir), "spark-warehouse", "checkpoints")


def held(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the cluster shares, and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder that the cluster shares, and read from there.

    A checkpoint keeps the size that the plan before it was expected to have, which is the product of what it joins.
    In a loop that number doubles its digits each round and goes through every plan after it; a file has its own size.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reclaim(spark: SparkSession) -> None:
    """Shuffle files that nothing uses any more go when the driver's collector finds them, which a large heap may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def give_back() -> None:
    """Memory that this worker does not use any more goes back, as the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then unused memory goes back."""
    try:
        yield from batches
    finally:
        give_back()


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def bounded_sample(rows: DataFrame, key: str, most: int, salt: int) -> DataFrame:
    """All rows if they are at most `most`, else about that many: those whose key's hash falls in the share that gives them."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 40)) < int((1 << 40) * most / n))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with consecutive numbers from 0 in that order, without one task that sorts all rows.

    Rows are ranged over partitions and numbered within each; the driver sees
    one count for each partition.
    """
    part, within = f"{name}__part", f"{name}__row"
    ranged = held(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = sorted((r[part], r["count"]) for r in ranged.groupBy(part).count().collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    rows = ranged.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long")).drop(part, within)
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    return rows.withColumn(name, (base[F.col(part)] + F.col(within) - 1).cast("long")).drop(part, within)
