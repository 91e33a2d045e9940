"""A query over a job that keeps its results as its sources come in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.relational import shared_folder
from ..streaming import jobs
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(r"SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words, length(text) AS chars FROM conversations")
def incremental_job(spark: SparkSession, d: str) -> DataFrame:
    """The turns as a stream, each worked on once and kept in a table: its words and characters."""
    folder = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(read(spark, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")  # a pattern: the source takes folders or patterns, and the table may be one file
    work = lambda rows: rows.select("conv_id", "turn", jobs.HASH, F.coalesce(T.word_count(F.col("text")), F.lit(0)).alias("words"), F.length("text").cast("long").alias("chars"))
    jobs.run_incremental(stream, ["conv_id", "turn"], ["role", "text"], work, f"{folder}/out", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return jobs.latest(jobs.results(spark, f"{folder}/out"), ["conv_id", "turn"]).drop(jobs.HASH)
