"""The opN queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, capfilters, collocations, katz, minhash, mixing, quality, secrets, sentencepiece, substring, topk, toxicity, turns
from .tables import read, remainder


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn pieces of every text, and whether decoding gives the text back."""
    coded = sentencepiece.encode(read(spark, sf_dir, "documents"), keep=["doc_id"], lossless="lossless")
    return coded.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "lossless")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeated(read(spark, sf_dir, "documents")).drop("kept")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, keep=["doc_id"], learned=secrets.learned_words(docs))
    spans = F.col("secrets")
    counts = [secrets.count_of(spans, k).alias(f"n_{k}") for k in secrets.KINDS]
    base = secrets.digest(F.filter(spans, lambda s: s["kind"] != "guess"))
    return found.select("doc_id", *counts[:3], F.sha2(base, 256).alias("base_sha256"), secrets.digest(spans).alias("spans"), counts[3], secrets.prices(spans).alias("prices"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = remainder(F.col("doc_id"), 3) != 1
    scored = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", (~learn).alias("held_out"), "p_quality", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = remainder(F.col("doc_id"), 7) != 2
    scored = katz.katz_scores(read(spark, sf_dir, "documents"), train)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = remainder(F.col("doc_id"), 3) != 1
    scored = quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_capfilters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(read(spark, sf_dir, "embeddings"), limit=0.93)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), words=3, least=10, top=2000, share=50)


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return turns.repaired(rows, turns.damaged(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_substring": op3_substring,
    "op4_minhash": op4_minhash,
    "op5_ann": op5_ann,
    "op6_topk": op6_topk,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_katz": op9_katz,
    "op10_quality": op10_quality,
    "op11_capfilters": op11_capfilters,
    "op12_collocations": op12_collocations,
    "op13_turns": op13_turns,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_substring": r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 12] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)
), least AS (
  SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win
), covered AS (
  SELECT DISTINCT doc_id, i + j AS pos
  FROM (SELECT doc_id, i FROM windows JOIN least USING (win) WHERE first_doc < doc_id), range(0, 13) AS r(j)
), placed AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM texts
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM placed ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
""",
    "op4_minhash": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)
), near AS (
  SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT u AS doc_id, u AS r FROM near UNION SELECT n.v, r FROM reach JOIN near n ON n.u = reach.doc_id
), least AS (
  SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, t.doc_id) AS component_id, t.doc_id = coalesce(c, t.doc_id) AS kept
FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op11_capfilters": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT u AS vec_id, u AS r FROM near UNION SELECT n.v, r FROM reach JOIN near n ON n.u = reach.vec_id
), least AS (
  SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id
), links AS (
  SELECT u AS vec_id, count(*) AS n FROM near GROUP BY u
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, e.vec_id) AS component_id, e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN links USING (vec_id) LEFT JOIN least USING (vec_id)
""",
    "op12_collocations": r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spots, (VALUES (1), (2), (3)) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM candidates WHERE k = 3
  ) GROUP BY ALL
), left_over AS (
  SELECT c.* FROM candidates c LEFT JOIN longer g USING (lang, phrase) WHERE g.a IS NULL OR 100 * g.a < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, k, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:k], ' ') AS y FROM left_over, (VALUES (1), (2)) AS cs(c) WHERE c < k
), scored AS (
  SELECT cuts.*, p.f AS l, q.f AS r, (1000000 * CAST(a AS HUGEINT) * a) // (CAST(p.f AS HUGEINT) * q.f) AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
