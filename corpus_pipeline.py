"""A corpus pipeline of training-data operators, one after another over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import minhash, mixing, quality, secrets, sentencepiece
from lectern.llm.tables import held, read, remainder, shared_folder, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go."""
    small_batches(spark)
    learn = remainder(F.col("doc_id"), 3) != 1
    scored = quality.quality_scores(docs, read(spark, sf_dir, "labels"), learn, keep=COLUMNS)
    return scored.where("score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Five-word shingles, similarity 0.8 or more. Rows are compared each for its own text, also
    where they share a doc_id; of equal rows with one doc_id one stays, rows without doc_id or without words stay.
    """
    small_batches(spark)
    gone = held(minhash.to_drop(docs, shingle=5, percent=80).withColumnsRenamed({"id": "__id", "h": "__h"}))
    here = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    rest = docs.join(gone.hint("merge"), here, "left_anti").select(*COLUMNS)
    again = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h")).groupBy("__id", "__h").count().where("count > 1").select("__id", "__h")
    again = held(again)
    if again.limit(1).count():  # of rows with one doc_id and text the least by source, lang and n_chars stays
        one = rest.join(again.hint("merge"), here, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
        rest = rest.join(again.hint("merge"), here, "left_anti").union(one.select("doc_id", "text", "r.lang", "r.source", "r.n_chars"))
    return rest


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the values of secrets in them are masked, and n_chars follows the text."""
    small_batches(spark)
    return secrets.redact(docs.select(*COLUMNS), learned=secrets.learned_words(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or up to three times."""
    return mixing.apply_mix(docs.select(*COLUMNS), mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the pieces drawn for it."""
    small_batches(spark)
    return sentencepiece.encode(docs, keep=COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Stages sample and learn, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again in between."""
    folder = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
