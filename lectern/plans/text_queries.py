"""Text, retrieval, structure and alignment queries over the driver's tables, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, chunks, retrieval, structure
from ..operators import relational as R
from ..sources import html

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(r"""
WITH t AS (SELECT doc_id, text, length(text) - length(regexp_replace(text, '[^\x00-\x7f]', '', 'g')) AS other FROM documents)
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(length(text) - other AS BIGINT) AS ascii_chars,
  CAST(other AS BIGINT) AS other_chars, CAST(floor((length(text) - other) / 3.4 + other / 1.4 + 0.5) AS BIGINT) AS tokens FROM t
""")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    ascii_, other = T.ascii_counts(F.col("text"))
    return read(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), ascii_.cast("long").alias("ascii_chars"), other.cast("long").alias("other_chars"), T.estimate_tokens(ascii_, other).alias("tokens"))


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\xAD[ \t]*\r?\n[ \t]*', '', 'g'), '(\p{L})-[ \t]*\r?\n[ \t]*(\p{L})', '\1\2', 'g'),
  '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '\s+', ' ', 'g'))) AS cleaned FROM documents
""")
def clean_extracted(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(T.clean_extracted(F.col("text")), 256).alias("cleaned"))


@query()
def normalize_tts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(T.normalize_for_speech(F.col("text")), 256).alias("spoken"))


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z]')) AS BIGINT) AS latin, CAST(len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) AS BIGINT) AS cyrillic,
  CASE WHEN len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) > 20 AND len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) > 2 * len(regexp_extract_all(text, '[a-zA-Z]')) THEN 'bg'
    WHEN len(regexp_extract_all(text, '[a-zA-Z]')) > 20 AND len(regexp_extract_all(text, '[a-zA-Z]')) > 2 * len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) THEN 'en' ELSE 'und' END AS script_language FROM documents
""")
def infer_language_script(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.regexp_count(t, F.lit("[a-zA-Z]")).cast("long").alias("latin"), F.regexp_count(t, F.lit(r"[\x{0400}-\x{04ff}]")).cast("long").alias("cyrillic"), T.script_language(t).alias("script_language"))


@query()
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    guess = F.transform(F.array(T.words_of(F.col("text"))), T.guess_language)[0]
    docs = read(spark, d, "documents").select("doc_id", "lang", "text").withColumn("guess", guess)
    return docs.select("doc_id", "lang", "guess", F.when(F.length(F.trim("text")) >= 200, F.col("guess")).alias("detected"))


@query(r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, t, t[1:140] AS cut FROM f)
SELECT doc_id, CASE WHEN length(t) <= 140 THEN t ELSE cut[1:greatest(CASE WHEN strpos(cut, ' ') > 0 THEN 140 - strpos(reverse(cut), ' ') ELSE -1 END, 70)] || '…' END AS snippet FROM c
""")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("""
WITH s AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, round(CASE WHEN a = b THEN CASE WHEN length(a) > 0 THEN 1.0 ELSE 0.0 END WHEN length(a) = 0 OR length(b) = 0 OR abs(length(a) - length(b)) > greatest(length(a), length(b)) * (1 - CAST(0.7 AS DOUBLE)) THEN 0.0
  ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6)::DOUBLE AS similarity FROM s
""")
def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    name = F.split("p_name", " ")
    part = lambda i: F.coalesce(F.try_element_at(name, F.lit(i)), F.lit(""))
    return read(spark, d, "part").select("p_partkey", F.round(T.similarity(part(1), part(2)), 6).alias("similarity"))


@query(r"""
WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM conversations),
c AS (SELECT conv_id, word, count(*) FILTER (WHERE role = 'user') AS a, count(*) FILTER (WHERE role = 'assistant') AS b FROM w WHERE role IN ('user', 'assistant') GROUP BY 1, 2),
s AS (SELECT conv_id, CAST(sum(least(a, b)) AS BIGINT) AS shared, CAST(sum(a) AS BIGINT) AS in_a, CAST(sum(b) AS BIGINT) AS in_b FROM c GROUP BY 1)
SELECT conv_id, shared, in_a, in_b, round(CASE WHEN in_a > 0 THEN shared / in_a ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN in_b > 0 THEN shared / in_b ELSE 0 END, 6)::DOUBLE AS precision FROM s
""")
def fidelity(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "conversations").select("conv_id", "role", F.explode(T.words_of(F.col("text"))).alias("word"))
    out = R.multiset_overlap(words.where("role = 'user'"), words.where("role = 'assistant'"), "conv_id", "word")
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision")})


# ---- retrieval ----

ASKED = "the and of"


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
h AS (SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) AS BIGINT) AS hits FROM w WHERE list_has_all(w, ['the', 'and', 'of']))
SELECT doc_id, hits, CAST(row_number() OVER (ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM h ORDER BY rank LIMIT 50
""")
def keyword_top50(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_leg(read(spark, d, "documents"), ASKED, key="doc_id", text="text", by_hits=True)


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS exact FROM embeddings, q)
SELECT vec_id, round(exact, 6) AS distance, CAST(row_number() OVER (ORDER BY exact, vec_id) AS INTEGER) AS rank FROM s ORDER BY rank LIMIT 50
""")
def vector_top50(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return retrieval.vector_leg(vectors, vectors.where("vec_id = 0"), key="vec_id", vector="embedding")


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
h AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) AS hits FROM w WHERE list_has_all(w, ['the', 'and', 'of'])),
k AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank FROM h ORDER BY rank LIMIT 50),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS doc_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS distance FROM embeddings, q),
v AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS rank FROM s ORDER BY rank LIMIT 50)
SELECT coalesce(k.doc_id, v.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0), 9) AS score FROM k FULL JOIN v ON k.doc_id = v.doc_id
""")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse([keyword_top50(spark, d), vector_top50(spark, d).withColumnRenamed("vec_id", "doc_id")], "doc_id")
    return fused.select("doc_id", F.round("score", 9).alias("score"))


@query()
def chunk_plain(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_texts(read(spark, d, "documents"), keep=["doc_id"])


@query()
def chunk_paged(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth line end of a text stands for a page end. A match begins where the last one ended, or the text's end would be searched from each of its places."""
    paged = read(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\G((?:[^\n]*+\n){3}[^\n]*+)\n", "$1\f").alias("text"))
    return chunks.chunk_texts(paged, keep=["doc_id"], paged=True)


@query()
def split_llm_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_texts(read(spark, d, "documents"), chunks.llm_pieces, keep=["doc_id"])


@query()
def split_tts_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_texts(read(spark, d, "documents"), chunks.speech_pieces, keep=["doc_id"])


@query()
def expand_passage(spark: SparkSession, d: str) -> DataFrame:
    """Each document's second chunk with its neighbours."""
    cut = chunks.chunk_texts(read(spark, d, "documents"), keep=["doc_id"])
    return retrieval.expand_passages(cut, cut.where("seq = 1").select("doc_id", "seq"), unit="doc_id")


@query(r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), x AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
g AS (SELECT DISTINCT id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM w)), h AS (SELECT DISTINCT id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM x)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), m AS (SELECT id, count(*) AS n FROM h GROUP BY 1), p AS (SELECT g.id AS a_id, h.id AS b_id, count(*) AS shared FROM g JOIN h USING (g) GROUP BY 1, 2)
SELECT a_id, b_id, shared FROM p JOIN n ON n.id = a_id JOIN m ON m.id = b_id WHERE shared >= 3 AND shared >= 0.6 * least(n.n, m.n)
""")
def same_source_passage(spark: SparkSession, d: str) -> DataFrame:
    docs, marks = read(spark, d, "documents"), read(spark, d, "benchmark")
    return retrieval.passage_pairs(docs.select(F.col("doc_id").alias("id"), "text"), marks.select(F.col("item_id").alias("id"), "text"))


@query("""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, text FROM conversations WHERE role <> 'system'),
n AS (SELECT conv_id, turn AS seq, text FROM conversations WHERE length(text) > 60)
SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, CAST(coalesce(o.seq, n.seq) AS BIGINT) AS seq, CASE WHEN n.conv_id IS NULL THEN 'delete' WHEN o.conv_id IS NULL THEN 'insert' WHEN o.text = n.text THEN 'keep' ELSE 'replace' END AS action
FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.seq = n.seq
""")
def incremental_reindex(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    seq = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")
    old = turns.where("role <> 'system'").select("conv_id", seq.alias("seq"), "text")
    new = turns.where(F.length("text") > 60).select("conv_id", F.col("turn").alias("seq"), "text")
    return retrieval.reindex(old, new, ["conv_id", "seq"]).drop("new_text")


@query(r"""
WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '([a-z]+)\.', 1) AS ids FROM conversations), u AS (SELECT conv_id, turn, unnest(ids) AS cited, unnest(range(len(ids))) AS i FROM c),
f AS (SELECT conv_id, turn, cited, min(i) AS i FROM u GROUP BY 1, 2, 3), p AS (SELECT conv_id, turn, cited, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS place FROM f),
k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '([a-z]+)\.', 1)) AS cited FROM benchmark)
SELECT conv_id, turn, place, cited FROM p WHERE cited IN (SELECT cited FROM k)
""")
def verify_citations(spark: SparkSession, d: str) -> DataFrame:
    """A word before a full stop stands for a cited id; the catalog is those of the benchmark."""
    pattern = r"([a-z]+)\."
    catalog = read(spark, d, "benchmark").select(F.explode(T.citation_ids(F.col("text"), pattern)).alias("cited"))
    turns = read(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return retrieval.verify_citations(turns, catalog, key="key", text="text", pattern=pattern).select("key.*", "place", "cited")


# ---- structure ----


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks; the first line and lines of under 60 characters are headings; ten lines make a page."""
    lines = structure.line_blocks(read(spark, d, "documents"), "doc_id", "text")
    head = (F.col("block") == 0) | (F.length("text") < 60)
    return lines.select("doc_id", "block", "text", (F.floor(F.col("block") / 10) + 1).cast("int").alias("page"), F.lit(True).alias("included"), F.when(head, "SectionHeader").otherwise("Text").alias("type"), F.lit(1).alias("level"))


BLOCKS_SQL = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS block FROM documents),
b AS (SELECT doc_id, CAST(block AS INTEGER) AS block, text, CAST(block // 10 + 1 AS INTEGER) AS page, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words, block = 0 OR length(text) < 60 AS head FROM l WHERE trim(text) <> '')"""


@query(f"""
WITH {BLOCKS_SQL}, s AS (SELECT *, max(CASE WHEN head AND block > 0 THEN block END) OVER (PARTITION BY doc_id ORDER BY block) AS start, bool_or(head AND block > 0) OVER (PARTITION BY doc_id) AS cut FROM b)
SELECT doc_id, min(block) AS first_block, CASE WHEN NOT cut THEN 'Full Text' WHEN start IS NULL THEN 'Preface' ELSE arg_min(text, block) END AS title, count(*) AS blocks, CAST(sum(words) AS BIGINT) AS words, min(page) AS page_start, max(page) AS page_end
FROM s GROUP BY doc_id, start, cut HAVING start IS NOT NULL OR NOT cut OR sum(words) > 50
""")
def slice_at(spark: SparkSession, d: str) -> DataFrame:
    return structure.slices(blocks(spark, d), "doc_id", (F.col("type") == "SectionHeader") & (F.col("block") > 0))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, block, words, CAST(coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM b")
def cumulative_words(spark: SparkSession, d: str) -> DataFrame:
    return structure.cumulative_words(blocks(spark, d), "doc_id").select("doc_id", "block", "words", "words_before")


@query(f"""
WITH {BLOCKS_SQL}, c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(words) OVER (PARTITION BY doc_id) AS total FROM b)
SELECT doc_id, block, CAST(coalesce(lead(before) OVER (PARTITION BY doc_id ORDER BY block), total) - before - words AS BIGINT) AS words_to_next FROM c WHERE head
""")
def heading_catalog(spark: SparkSession, d: str) -> DataFrame:
    return structure.heading_words(blocks(spark, d), "doc_id", F.col("type") == "SectionHeader").select("doc_id", "block", "words_to_next")


@query(f"""
WITH {BLOCKS_SQL}, p AS (SELECT *, min(block) OVER (PARTITION BY doc_id, page) AS a, max(block) OVER (PARTITION BY doc_id, page) AS z FROM b)
SELECT doc_id, block, words <= 8 AND len(regexp_extract_all(text, '\\p{{L}}')) >= 3 AND NOT regexp_matches(text, '\\p{{Ll}}') AND block = z AND block > a AS closing FROM p
""".replace("\\\\", "\\"))
def closing_marks(spark: SparkSession, d: str) -> DataFrame:
    return structure.closing_marks(blocks(spark, d), "doc_id").select("doc_id", "block", "closing")


@query(f"WITH {BLOCKS_SQL}, x AS (SELECT doc_id, block, head, lag(head) OVER (PARTITION BY doc_id ORDER BY block) AS after FROM b) SELECT doc_id, block FROM x WHERE head AND NOT coalesce(after, FALSE)")
def merge_heading_only(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d)
    return structure.merge_heading_runs(rows.where("type = 'SectionHeader'"), rows, "doc_id")


@query()
def split_by_words(spark: SparkSession, d: str) -> DataFrame:
    return structure.parts_by_words(structure.cumulative_words(blocks(spark, d), "doc_id"), "doc_id", 500)


@query()
def detect_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return structure.detect_boundaries(blocks(spark, d), "doc_id")


# ---- alignment and time ----


@query()
def align_words_nw(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name against its type and name, as if misread."""
    part = read(spark, d, "part")
    words = part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "text"))
    seen = part.select("p_partkey", F.posexplode(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("at", "text")).withColumn("line", F.lit(0))
    return align.align_pages(words, seen, "p_partkey")


@query()
def align_sentences_dp(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of each label in order: the first half against the second."""
    rows = read(spark, d, "embeddings")
    group = Window.partitionBy("label", F.floor(F.col("vec_id") / 40))
    rows = rows.withColumn("n", F.count("*").over(group)).withColumn("r", F.row_number().over(group.orderBy("vec_id")))
    side = F.when(F.col("r") * 2 <= F.col("n"), "s").otherwise("t")
    return align.align_chapters(rows.select(F.concat_ws(":", "label", F.floor(F.col("vec_id") / 40)).alias("unit"), side.alias("side"), F.col("vec_id").alias("pos"), F.lit(1.0).alias("size"), F.col("embedding").alias("vec")), "unit")


@query("""
WITH c AS (SELECT o_custkey AS unit, o_orderkey AS seq, CAST(round(o_totalprice / 100) AS BIGINT) AS ms, 6000 AS total FROM orders),
t AS (SELECT *, sum(ms) OVER (PARTITION BY unit) AS s, count(*) OVER (PARTITION BY unit) AS n, max(seq) OVER (PARTITION BY unit) AS last, coalesce(sum(ms) OVER (PARTITION BY unit ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY unit ORDER BY seq) - 1 AS k FROM c),
u AS (SELECT *, CASE WHEN s > total THEN total::DOUBLE / s::DOUBLE ELSE 1.0::DOUBLE END AS scale, CASE WHEN s < total AND n > 1 THEN (total - s)::DOUBLE / (n - 1)::DOUBLE ELSE 0.0::DOUBLE END AS gap FROM t),
v AS (SELECT *, CAST(floor(before::DOUBLE * scale + gap * k + 0.5) AS BIGINT) AS start_ms FROM u)
SELECT unit, seq, start_ms, CASE WHEN seq = last THEN total::BIGINT ELSE greatest(start_ms + 1, CAST(floor((before + ms)::DOUBLE * scale + gap * k + 0.5) AS BIGINT)) END AS end_ms FROM v
""")
def build_sync_map(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("seq"), F.round(F.col("o_totalprice") / 100).cast("long").alias("ms"), F.lit(6000).alias("total"))
    return align.chunk_times(rows, "unit", "total").select("unit", "seq", "start_ms", "end_ms")


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return html.page_texts(read(spark, d, "pages"), keep=["page_id"])
