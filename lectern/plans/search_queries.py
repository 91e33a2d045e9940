"""Queries over a stored search index of the documents, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, postings, retrieval
from ..operators.relational import hold, shared_folder
from .relational_queries import read

Q, SQL = {}, {}

ASKED = "the and of"
#: Partitions of these indexes, which are small.
BUCKETS = 16
PHRASES = '"of the" or "and the" -with'


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def indexed(rows: DataFrame, key: str) -> str:
    """A new index of rows' texts in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/index-{uuid.uuid4().hex}"
    postings.write_index(spread(rows), path, key=key, text="text", buckets=BUCKETS, files=2)
    return path


WORDS_SQL = r"w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)"


@query(f"""
WITH {WORDS_SQL}, p AS (SELECT doc_id, unnest(w) AS term FROM w)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM p GROUP BY term
""")
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have each word of the index, and how often."""
    index = spark.read.parquet(indexed(read(spark, d, "documents"), "doc_id"))
    return index.where("term <> ''").groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).cast("long").alias("hits"))


@query(rf"""
WITH {WORDS_SQL}, j AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM w)
SELECT doc_id FROM j WHERE contains(t, ' of the ') OR (contains(t, ' and the ') AND NOT list_contains(w, 'with'))
""")
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that match a query with phrases, an alternative and an excluded word, by positions in the index."""
    parsed = retrieval.parse_query(PHRASES)
    found = postings.lookup(spark, indexed(read(spark, d, "documents"), "doc_id"), postings.terms_of(parsed), BUCKETS)
    return postings.matched(found, parsed).select(F.col("key").alias("doc_id"))


@query(f"""
WITH {WORDS_SQL}, p AS (SELECT doc_id, w[i] AS t, i AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] IN ('the', 'and', 'of')),
l AS (SELECT doc_id, p, max(CASE WHEN t = 'the' THEN p END) OVER z AS a, max(CASE WHEN t = 'and' THEN p END) OVER z AS b, max(CASE WHEN t = 'of' THEN p END) OVER z AS c FROM p WINDOW z AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, least(a, b, c) AS start, min(p) AS p FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY ALL),
r AS (SELECT doc_id, round(CAST(sum(CAST(round(0.3::DOUBLE / greatest(1.0::DOUBLE, (p - start + 1) / 3.0::DOUBLE), 12) AS DECIMAL(20, 12))) AS DOUBLE), 9) AS cover FROM s GROUP BY doc_id)
SELECT doc_id, cover, CAST(row_number() OVER (ORDER BY cover DESC, doc_id) AS INTEGER) AS rank FROM r ORDER BY rank LIMIT 50
""")
def fts_cover_top50(spark: SparkSession, d: str) -> DataFrame:
    """The documents that have the asked words closest together."""
    found = postings.search(spark, indexed(read(spark, d, "documents"), "doc_id"), ASKED, buckets=BUCKETS)
    return found.select(F.col("key").alias("doc_id"), "cover", "rank")


@query()
def search_library(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over chunks by words and by vector, fused and grouped. Every chunk has a vector: chunks are dealt the stored ones in turn.

    Chunks are cut and indexed once; the words' leg reads the asked postings, and only the fused hits' texts are read again.
    """
    docs, vectors = read(spark, d, "documents"), read(spark, d, "embeddings")
    cut = hold(chunks.chunk_texts(spread(docs), keep=["doc_id", "lang", "source"]).withColumn("id", F.concat_ws(":", "doc_id", "seq")))
    words = postings.search(spark, indexed(cut, "id"), ASKED, buckets=BUCKETS).select(F.col("key").alias("id"), "rank")
    turn = (F.col("doc_id") * 7 + F.col("seq")) % F.lit(max(1, vectors.count()))
    of_chunks = cut.select("id", turn.alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id")
    near = retrieval.vector_leg(of_chunks, vectors.where("vec_id = 0"), key="id", vector="embedding")
    fused = retrieval.fuse([words, near.select("id", "rank")], "id")  # at most two legs' rows
    hits = cut.join(F.broadcast(fused), "id").select("id", F.col("source").alias("book"), F.col("doc_id").alias("unit"), F.col("doc_id").cast("string").alias("file"), F.lit("chapter").alias("source"), F.col("lang").alias("language"), "text", "score", "char_start", "char_end", "page_start", "page_end")
    return retrieval.grouped(hits, ASKED).select("place", "id", "book", "unit", "language", F.round("score", 9).alias("score"), T.snippet(F.col("text")).alias("snippet"))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as tasks can run: a small table's file may be read by one task otherwise."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
