"""Resumable jobs: work on the rows of a stream, batch by batch, that does only what has changed and can be stopped anywhere.

Each batch writes its results to a folder of its own, replacing what an earlier try of the same batch left there, so a
batch that was cut off is done again without doubling a row. A row is worked on only if its key's latest result comes from
another source text; the hash of the source is kept with the result. What stands now is each key's row of its latest batch.

Defined results: a null key is a key; a null source has a hash of its own; of a batch's rows with one key the one with the greatest hash counts; an
empty stream writes nothing, and reading an empty job gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

HASH, BATCH = "source_hash", "batch"


def source_hash(*parts: Column) -> Column:
    """A hash of all parts, which tells null from empty."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def results(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """All rows that batches have written, or None before the first."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException:
        return None


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's row of its latest batch, without the batch's number."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(BATCH))
    return rows.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth", BATCH)


def run_incremental(stream: DataFrame, keys: list[str], source: list[str], work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep work's results for the stream's rows at path, redoing only rows whose source columns changed.

    work gets new and changed rows (with their source_hash) and returns rows that still have the keys and source_hash. path and
    checkpoint are folders that all executors share; started again on both, the job goes on where it stopped.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(HASH, source_hash(*[F.col(c) for c in source]))
        greatest = Window.partitionBy(*keys).orderBy(F.desc(HASH))
        rows = rows.withColumn("__nth", F.row_number().over(greatest)).where("__nth = 1").drop("__nth")
        done = results(spark, path)
        if done is not None:
            known = latest(done.where(F.col(BATCH) < number), keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(HASH).alias("__hash"))
            same = F.col(HASH) == F.col("__hash")
            for k in keys:
                same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
            rows = rows.join(known, same, "left_anti")
        work(rows).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def progress(rows: DataFrame, keys: list[str]) -> DataFrame:
    """batch, rows it wrote, and how many keys were done after it."""
    first = rows.groupBy(*keys).agg(F.min(BATCH).alias(BATCH)).groupBy(BATCH).agg(F.count("*").alias("new"))
    each = rows.groupBy(BATCH).agg(F.count("*").alias("rows")).join(first, BATCH, "left")
    so_far = Window.orderBy(BATCH)  # a row for each batch
    return each.select(BATCH, "rows", F.sum(F.coalesce("new", F.lit(0))).over(so_far).alias("done"))
