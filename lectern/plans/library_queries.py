"""Queries over chapters, editions, jobs and pages, each with its SQL.

Orders stand for chapters or jobs, items for their variants, events for logs and clicks, conversations for books of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import relational as R
from ..operators import structure
from .relational_queries import read
from .text_queries import blocks

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- index ----


@query("""
SELECT 'raw' AS kind, doc_id AS id, sha256(text) AS text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'chapter', conv_id * 1000 + turn, sha256(text) FROM conversations WHERE role <> 'system' AND text IS NOT NULL
UNION ALL SELECT 'translation', item_id, sha256(text) FROM benchmark WHERE text IS NOT NULL
""")
def index_units(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    chapters = read(spark, d, "conversations").where("role <> 'system'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    done = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return L.index_units(files, chapters, done).select("kind", "id", F.sha2("text", 256).alias("text"))


@query("""
SELECT c.c_custkey, n.n_name AS folder, n.n_regionkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n.n_name END IS DISTINCT FROM n.n_name OR c_custkey % 5 IS DISTINCT FROM n.n_regionkey AS changed FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
""")
def scope_refresh(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("folder"), F.col("n_regionkey").alias("owner"))
    kept = read(spark, d, "customer").withColumn("n_nationkey", F.col("c_nationkey")).join(nations.select("n_nationkey", F.col("folder").alias("f")), "n_nationkey")
    rows = kept.select("c_custkey", "n_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("f")).alias("folder"), (F.col("c_custkey") % 5).cast("int").alias("owner"))
    return L.scope_refresh(rows, nations, "n_nationkey", ["folder", "owner"]).select("c_custkey", "folder", "owner", "changed")


@query("""
WITH c AS (SELECT d.doc_id, source, n_chars, length(text) AS size FROM documents d ANTI JOIN (SELECT vec_id AS doc_id FROM embeddings WHERE vec_id % 3 <> 0) e USING (doc_id))
SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) // 32 AS INTEGER) AS batch, CAST(size AS DOUBLE) AS size FROM c
""")
def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a vector, in batches of 32 of a source; the stand-in model's vector is a text's length."""
    vectors = read(spark, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    pending = L.pending_batches(read(spark, d, "documents").join(vectors, "doc_id", "left"), "source", [F.col("n_chars"), F.col("doc_id")], "embedding")
    made = L.embedded(pending, "doc_id", "text", lambda texts: [[float(len(t))] for t in texts])
    return pending.select("doc_id", "batch").join(made, "doc_id").select("doc_id", "batch", F.element_at("vector", 1).cast("double").alias("size"))


@query("""
WITH r AS (SELECT o_custkey AS request, l_partkey AS chunk, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey), f AS (SELECT request, chunk, min(place) AS place FROM r GROUP BY 1, 2)
SELECT request, chunk, 'c_' || row_number() OVER (PARTITION BY request ORDER BY place) AS cited FROM f
""")
def citation_catalog(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).withColumns({"request": F.col("o_custkey"), "chunk": F.col("l_partkey")})
    return L.citation_catalog(hits, "request", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], "chunk")


@query("""
WITH s AS (SELECT source, list_sort(list_distinct(list(lang))) AS l FROM documents WHERE n_chars % 11 <> 0 GROUP BY 1)
SELECT source, CASE len(l) WHEN 0 THEN 'the question''s language' WHEN 1 THEN 'only ' || l[1] ELSE 'English first, of ' || array_to_string(l, ', ') END AS rule FROM s
""")
def search_language_rule(spark: SparkSession, d: str) -> DataFrame:
    scopes = read(spark, d, "documents").where("n_chars % 11 <> 0").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("l"))
    return scopes.select("source", L.language_rule(F.col("l")).alias("rule"))


@query("""
SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS files, sha256(string_agg('# file ' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS whole FROM documents GROUP BY source
""")
def text_stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Each source's files in order as one text, under a heading each."""
    return L.whole_digests(read(spark, d, "documents"), "source", "doc_id", "text")


# ---- editions and chapters ----

_STEP = """v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'translation' END AS kind, ['done', 'pending', 'done', 'failed', 'done', 'suspended', 'done'][o_orderkey % 7 + 1] AS status, o_orderkey % 11 <> 0 AS texts,
  CASE o_orderkey % 9 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' END AS pair_job, o_orderkey % 4 <> 0 AS paired, o_orderkey % 5 <> 0 AS current, CASE WHEN o_orderkey % 8 = 3 THEN 'queued' END AS link_job, o_orderkey % 6 AS matched, o_orderkey % 3 * 2 AS linked FROM orders)"""


@query(f"""
WITH {_STEP} SELECT CASE WHEN kind IS NULL THEN 'no-translation' WHEN status IN ('pending', 'translating') THEN 'translating' WHEN status = 'suspended' THEN 'translation-stopped' WHEN status = 'failed' THEN 'translation-failed' WHEN NOT texts THEN 'no-text'
  WHEN coalesce(pair_job IN ('queued', 'running'), FALSE) THEN 'pairing' WHEN NOT (paired AND current) AND pair_job = 'failed' THEN 'pair-failed' WHEN paired AND NOT current THEN 'outdated' WHEN NOT paired THEN 'unpaired' WHEN coalesce(link_job IN ('queued', 'running'), FALSE) THEN 'linking'
  WHEN matched > 0 AND linked >= matched THEN 'linked' ELSE 'paired' END AS step, count(*) AS chapters, CAST(sum(matched) AS BIGINT) AS matched FROM v GROUP BY 1
""")
def bilingual_step(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["done", "pending", "done", "failed", "done", "suspended", "done"])), (k % 7 + 1).cast("int"))
    step = L.bilingual_step(F.when(k % 13 != 0, "translation"), status, k % 11 != 0, F.when(k % 9 == 0, "running").when(k % 9 == 1, "failed"), k % 4 != 0, k % 5 != 0, F.when(k % 8 == 3, "queued"), k % 6, k % 3 * 2)
    return read(spark, d, "orders").groupBy(step.alias("step")).agg(F.count("*").alias("chapters"), F.sum(k % 6).alias("matched"))


_READY = "r AS (SELECT o_custkey AS key, o_orderkey, o_orderstatus <> 'P' AS done, o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 AS paired, o_orderkey % 2 = 0 AS linked FROM orders)"


@query(f"""
WITH {_READY} SELECT key, count(*) AS selected, count(*) FILTER (WHERE paired) AS paired, count(*) FILTER (WHERE paired AND linked) AS linked, coalesce(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), ',' ORDER BY o_orderkey) FILTER (WHERE NOT done), '') AS untranslated,
  coalesce(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), ',' ORDER BY o_orderkey) FILTER (WHERE done AND NOT paired), '') AS unpaired, coalesce(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), ',' ORDER BY o_orderkey) FILTER (WHERE paired AND NOT linked), '') AS unlinked FROM r GROUP BY key
""")
def bilingual_readiness(spark: SparkSession, d: str) -> DataFrame:
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") != "P"
    rows = read(spark, d, "orders").withColumn("key", F.col("o_custkey"))
    return L.readiness(rows, "key", F.lpad(k.cast("string"), 6, "0"), done, done & (k % 3 != 0), k % 2 == 0, order=k)


@query("""
WITH l AS (SELECT l_orderkey, list({'s': l_linestatus, 'n': l_linenumber}) AS pairs FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderstatus = 'F' AS translated, o_orderkey % 3 = 0 AS paired, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(len(list_filter(pairs, lambda p: p.s = 'F')), 0) ELSE 0 END::INTEGER AS matched_groups,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN coalesce(len(list_filter(pairs, lambda p: p.n > 2)), 0) ELSE 0 END::INTEGER AS linked_groups FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def bilingual_export_status(spark: SparkSession, d: str) -> DataFrame:
    pairs = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("n"))).alias("pairs"))
    rows = read(spark, d, "orders").withColumn("id", F.col("o_orderkey")).join(pairs, "id", "left")
    paired = F.col("id") % 3 == 0
    count = lambda f: F.coalesce(F.when(F.col("pairs").isNotNull(), F.size(F.filter("pairs", f))), F.lit(0))
    return rows.select("id", (F.col("o_orderstatus") == "F").alias("translated"), paired.alias("paired"), F.when(paired, count(lambda p: p["s"] == "F")).otherwise(0).alias("matched_groups"), F.when(paired & (F.col("id") % 2 == 0), count(lambda p: p["n"] > 2)).otherwise(0).alias("linked_groups"))


@query("""
WITH s AS (SELECT conv_id, turn, sha256(trim(text)) AS h, sha256(trim(text || CASE WHEN turn % 3 = 0 THEN 'x' ELSE ' ' END)) AS g FROM conversations) SELECT conv_id, turn FROM s WHERE h = g
""")
def current_references(spark: SparkSession, d: str) -> DataFrame:
    """Prepared editions whose stored hashes are those of the present texts; every third turn has changed since."""
    turns = read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("source"), "text", "turn")
    stored = turns.select("key", F.sha2(F.trim("text"), 256).alias("source_hash"), F.sha2(F.trim(F.concat("text", F.when(F.col("turn") % 3 == 0, "x").otherwise(" "))), 256).alias("target_hash"))
    return L.current_references(stored, turns.select("key", "source", F.col("source").alias("target")), "key").select("key.*")


@query("""
WITH p AS (SELECT o_custkey AS unit, o_orderkey AS pos, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 50 END AS a, o_orderkey % 50 + o_orderkey % 9 AS z, CASE o_orderkey % 4 WHEN 0 THEN 'missing' ELSE 'matched' END AS status FROM orders),
q AS (SELECT *, max(CASE WHEN a IS NOT NULL THEN z END) OVER (PARTITION BY unit ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT unit, pos, 'overlap' AS rule FROM q WHERE a < before UNION ALL SELECT unit, pos, 'empty' FROM q WHERE a IS NOT NULL AND z <= a UNION ALL SELECT unit, pos, 'outside' FROM q WHERE a IS NOT NULL AND z > 52
UNION ALL SELECT unit, pos, 'no-range' FROM q WHERE a IS NULL AND status = 'matched' UNION ALL SELECT unit, pos, 'range' FROM q WHERE a IS NOT NULL AND status = 'missing'
""")
def validate_bilingual(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    has = F.col("o_orderstatus") != "P"
    pairs = read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), k.alias("pos"), F.when(has, k % 50).alias("start"), F.when(has, k % 50 + k % 9).alias("end"), F.lit(52).alias("length"), F.when(k % 4 == 0, "missing").otherwise("matched").alias("status"))
    return L.violations(pairs, "unit", "pos")


@query("""
WITH RECURSIVE p AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role <> 'system'), r AS (
  SELECT conv_id, turn, i, 0 AS batch, n AS held FROM p WHERE i = 1
  UNION ALL SELECT p.conv_id, p.turn, p.i, r.batch + CAST(r.held > 0 AND r.held + p.n > 800 AS INTEGER), CASE WHEN r.held > 0 AND r.held + p.n > 800 THEN p.n ELSE r.held + p.n END FROM r JOIN p ON p.conv_id = r.conv_id AND p.i = r.i + 1
) SELECT conv_id, turn, batch FROM r
""")
def link_batches(spark: SparkSession, d: str) -> DataFrame:
    pairs = read(spark, d, "conversations").where("role <> 'system'").withColumn("n", F.length("text"))
    return L.link_batches(pairs, "conv_id", "turn", "n", most=800)


@query("""
SELECT o_orderkey AS chapter, coalesce(nullif(o_orderpriority, '1-URGENT'), 'chapter ' || o_orderkey) AS title, max(l_linestatus) AS state, count(*) AS variants FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag = 'R' AND trim(l_linestatus) <> '' GROUP BY 1, 2
""")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Selected chapters with a finished variant; a missing title falls back to the original one."""
    done = read(spark, d, "lineitem").where("l_returnflag = 'R' AND trim(l_linestatus) <> ''")
    title = F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")), F.concat(F.lit("chapter "), "o_orderkey"))
    rows = read(spark, d, "orders").where("o_orderstatus <> 'P'").join(done, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_orderkey").alias("chapter"), title.alias("title")).agg(F.max("l_linestatus").alias("state"), F.count("*").alias("variants"))


@query("""
SELECT conv_id, turn FROM conversations c WHERE CASE WHEN conv_id % 2 = 0 THEN turn IN (SELECT item_id FROM benchmark WHERE item_id < 4) ELSE role = 'user' END
""")
def output_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Books with a list of chapters take these, the others their selected ones."""
    turns = read(spark, d, "conversations")
    listed = read(spark, d, "benchmark").where("item_id < 4").select(F.col("item_id").alias("turn"))
    return turns.where("conv_id % 2 = 0").join(listed, "turn", "left_semi").select("conv_id", "turn").union(turns.where("conv_id % 2 <> 0 AND role = 'user'").select("conv_id", "turn"))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'N' AND CASE WHEN l_linenumber < 4 THEN NULL ELSE o_orderpriority END IS NULL")
def missing_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("l_linenumber") >= 4, F.col("o_orderpriority"))
    rows = read(spark, d, "lineitem").where("l_returnflag = 'N'").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where(title.isNull()).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.06) THEN NULL ELSE o_orderstatus END AS audio FROM orders")
def reset_dependents(spark: SparkSession, d: str) -> DataFrame:
    """The audio state of chapters with changed parts is cleared."""
    changed = read(spark, d, "lineitem").where("l_tax > 0.06").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    rows = read(spark, d, "orders").join(changed, "o_orderkey", "left")
    return R.update_where(rows, F.col("hit"), {"o_orderstatus": F.lit(None).cast("string")}).select("o_orderkey", F.col("o_orderstatus").alias("audio"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_linestatus = 'O' AND l_returnflag <> 'N') AS waiting FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def in_flight_inputs(spark: SparkSession, d: str) -> DataFrame:
    """How many inputs of an output are not settled yet; it is deferred until there are none."""
    inputs = read(spark, d, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    settled = (F.col("l_linestatus") != "O") | (F.col("l_returnflag") == "N")
    return L.ready_outputs(read(spark, d, "orders").where("o_orderstatus = 'F'"), inputs, "o_orderkey", settled).select("o_orderkey", "waiting")


@query("SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = conv_id * 10 + turn) ")
def digest_pending(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "labels").select(F.col("doc_id").alias("tag"))
    return read(spark, d, "conversations").where("role = 'user'").withColumn("tag", F.col("conv_id") * 10 + F.col("turn")).join(done, "tag", "left_anti").select("conv_id", "turn")


@query("SELECT event_id, user_id FROM events e WHERE event_type = 'error' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def unresolved_review(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return read(spark, d, "events").where("event_type = 'error'").join(pages, "user_id", "left_semi").select("event_id", "user_id")


@query("""
WITH f AS (SELECT o_custkey AS unit, list(o_orderkey ORDER BY o_orderkey) AS have FROM orders GROUP BY 1), w AS (SELECT unit, have, CASE unit % 4 WHEN 1 THEN have[2:] WHEN 2 THEN list_append(have, have[1]) WHEN 3 THEN list_append(have, -1) ELSE list_reverse(have) END AS ids FROM f), k AS (SELECT * FROM w WHERE list_sort(ids) = have)
SELECT unit, unnest(ids) AS id, CAST(unnest(range(len(ids))) AS INTEGER) AS position FROM k
""")
def reorder_files(spark: SparkSession, d: str) -> DataFrame:
    """Only a list that is a permutation of a book's files moves them."""
    files = read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("id"))
    have = files.groupBy("unit").agg(F.sort_array(F.collect_list("id")).alias("have"))
    first, kind = F.element_at("have", 1), F.col("unit") % 4
    ids = F.when(kind == 1, F.slice("have", F.lit(2), F.size("have"))).when(kind == 2, F.array_append("have", first)).when(kind == 3, F.array_append("have", F.lit(-1).cast("long"))).otherwise(F.reverse("have"))
    return L.reordered(files, have.select("unit", ids.alias("ids")), "unit", "id").select("unit", "id", "position")


@query("""
WITH m AS (SELECT o_custkey AS unit, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS t FROM orders)
SELECT unit, id, CAST(f AS INTEGER) AS "from", CAST(t AS INTEGER) AS "to" FROM m WHERE f <> t
""")
def moves_with_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The moves of a new order of files: all are staged before any is placed, so cycles do no harm, and no file that stays moves."""
    by = Window.partitionBy("unit")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("id"), "o_totalprice")
    rows = rows.withColumns({"from": F.row_number().over(by.orderBy("id")), "to": F.row_number().over(by.orderBy("o_totalprice", "id"))})
    return rows.where("`from` <> `to`").select("unit", "id", "from", "to")


@query("""
SELECT user_id AS book, CAST(count(*) AS BIGINT) AS editions, string_agg(event_type || ':' || event_id, ',' ORDER BY event_id) AS nested FROM events GROUP BY 1
""")
def group_by_book(spark: SparkSession, d: str) -> DataFrame:
    """Editions nested by book, in the order in which they came."""
    parts = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    rows = read(spark, d, "events").groupBy(F.col("user_id").alias("book")).agg(F.count("*").alias("editions"), parts.alias("p"))
    return rows.select("book", "editions", F.array_join(F.transform("p", lambda e: F.concat(e["event_type"], F.lit(":"), e["event_id"])), ",").alias("nested"))


@query("SELECT o_orderkey, o.o_custkey || ':' || coalesce(c.c_mktsegment, 'none') AS owed FROM orders o LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) c ON CAST(c.c_custkey AS VARCHAR) = CAST(o.o_custkey AS VARCHAR)")
def left_owed(spark: SparkSession, d: str) -> DataFrame:
    owed = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("key"), "c_mktsegment")
    rows = read(spark, d, "orders").withColumn("key", F.col("o_custkey").cast("string")).join(owed, "key", "left")
    return rows.select("o_orderkey", F.concat_ws(":", "key", F.coalesce("c_mktsegment", F.lit("none"))).alias("owed"))


@query("""
SELECT 'local' AS engine, s_name AS voice, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'en' END, 'bg') AS language FROM supplier WHERE s_acctbal > 0 AND coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'en' END, 'bg') = 'en'
UNION ALL SELECT 'cloud', c_name, 'en' FROM customer WHERE c_custkey % 10 = 0
""")
def voice_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Voices of all providers, with a default language, that can be used and speak the asked language."""
    local = read(spark, d, "supplier").where("s_acctbal > 0").select(F.lit("local").alias("engine"), F.col("s_name").alias("voice"), F.coalesce(F.when(F.col("s_suppkey") % 2 == 0, "en"), F.lit("bg")).alias("language"))
    cloud = read(spark, d, "customer").where("c_custkey % 10 = 0").select(F.lit("cloud").alias("engine"), F.col("c_name").alias("voice"), F.lit("en").alias("language"))
    return local.unionByName(cloud).where("language = 'en'")


# ---- pages ----

_LINES = """l AS (SELECT l_orderkey % 200 AS page, CASE WHEN l_partkey % 5 = 0 THEN '12 Words' WHEN l_partkey % 3 = 0 THEN 'an end.' WHEN l_partkey % 41 = 0 THEN ' ' ELSE 'plain words' END AS text,
  CASE WHEN l_orderkey % 4 = 0 THEN 100 ELSE l_partkey % 300 END AS x0, l_linenumber * 120 + l_suppkey % 40 AS y0, CASE WHEN l_orderkey % 4 = 0 THEN 800 ELSE l_partkey % 300 + CAST(l_quantity AS BIGINT) * 10 END AS x1, l_linenumber * 120 + l_suppkey % 40 + 30 AS y1 FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_partkey % 5 <> 0)"""


@query(f"""
WITH {_LINES}, b AS (SELECT * FROM l WHERE trim(text) <> '' AND y0 > 70 AND y1 < 900), s AS (SELECT page, count(*) AS n, count(*) FILTER (WHERE x1 - x0 > 500) AS wide, count(*) FILTER (WHERE regexp_matches(text, '[.!?]\\s*$')) AS ends, bool_or(regexp_matches(text, '^\\s*\\d{{1,3}}\\s+\\p{{L}}')) AS counters FROM b GROUP BY 1),
c AS (SELECT DISTINCT p.page FROM b p JOIN b q ON p.page = q.page AND p.x1 + 80 < q.x0 AND least(p.y1, q.y1) > greatest(p.y0, q.y0))
SELECT p.page, CASE WHEN coalesce(n >= 8 AND c.page IS NULL AND NOT counters AND wide / n >= 0.75 AND ends / n < 0.5, FALSE) THEN 'standard' ELSE 'ordered' END AS route FROM (SELECT DISTINCT page FROM l) p LEFT JOIN s USING (page) LEFT JOIN c ON c.page = p.page
""")
def route_page(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("l_partkey"), F.col("l_orderkey")
    items = read(spark, d, "lineitem").where((k % 4 != 0) | (p % 5 != 0))
    text = F.when(p % 5 == 0, "12 Words").when(p % 3 == 0, "an end.").when(p % 41 == 0, " ").otherwise("plain words")
    y0 = F.col("l_linenumber") * 120 + F.col("l_suppkey") % 40
    x1 = F.when(k % 4 == 0, 800).otherwise(p % 300 + F.col("l_quantity").cast("long") * 10)
    lines = items.select((k % 200).alias("page"), text.alias("text"), F.when(k % 4 == 0, 100).otherwise(p % 300).alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 30).alias("y1"))
    return L.routes(lines, "page")


@query("SELECT event_id, event_type = 'error' AND coalesce(value, 0) / 200 >= 0.15 AS garbled FROM events")
def is_garbled(spark: SparkSession, d: str) -> DataFrame:
    engine = F.when(F.col("event_type") == "error", "tesseract").otherwise("other")
    return read(spark, d, "events").select("event_id", L.is_garbled(engine, F.coalesce("value", F.lit(0.0)) / 200).alias("garbled"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'bul rus ukr srp mkd bel' WHEN 1 THEN 'chi_sim chi_tra jpn' ELSE '' END AS packs FROM nation")
def packs_for_script(spark: SparkSession, d: str) -> DataFrame:
    script = F.when(F.col("n_nationkey") % 3 == 0, "Cyrillic").when(F.col("n_nationkey") % 3 == 1, "Han").otherwise("unknown")
    return read(spark, d, "nation").select("n_nationkey", F.array_join(L.packs_for_script(script), " ").alias("packs"))


@query("""
WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS plain, event_type <> 'error' AND coalesce(lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id), FALSE) AS goes_on FROM events),
g AS (SELECT *, sum(CAST(NOT goes_on AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, bool_and(plain) AS plain FROM g GROUP BY user_id, g
""")
def page_groups(spark: SparkSession, d: str) -> DataFrame:
    return L.page_groups(read(spark, d, "events"), "user_id", "event_id", F.col("event_type") != "error")


@query("""
WITH n AS (SELECT conv_id, turn, left(text, 300) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), u AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM n WHERE n <= 5)
SELECT conv_id, turn, text FROM u WHERE upto <= 900
""")
def page_window(spark: SparkSession, d: str) -> DataFrame:
    return L.page_window(read(spark, d, "conversations"), "conv_id", "turn", "text", count=5, most_page=300, most=900)


@query(r"""
WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 3 <> 0), b AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN text || ' more' ELSE text || '   ' END AS text FROM conversations WHERE turn % 4 <> 0)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN length(regexp_replace(coalesce(b.text, ''), '\s+', '', 'g')) > length(regexp_replace(coalesce(a.text, ''), '\s+', '', 'g')) THEN b.text ELSE coalesce(a.text, b.text) END AS text FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn
""")
def merge_page_text(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    other = turns.where("turn % 4 <> 0").withColumn("text", F.concat("text", F.when(F.col("conv_id") % 2 == 0, " more").otherwise("   ")))
    return L.merged_pages(turns.where("turn % 3 <> 0"), other, ["conv_id", "turn"], "text")


@query(r"""
WITH w AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS words FROM conversations) SELECT conv_id, turn, words < 40 AND turn < max(turn) OVER (PARTITION BY conv_id) AS label_sized FROM w
""")
def label_sized(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("words", F.regexp_count("text", F.lit(r"\S+")))
    return L.label_sized(turns, "conv_id", "turn", "words", 40).select("conv_id", "turn", "label_sized")


@query()
def propose_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Detected boundaries of each file with title and page."""
    rows = blocks(spark, d)
    found = structure.detect_boundaries(rows, "doc_id").select("doc_id", "block")
    heads = rows.where("type = 'SectionHeader'")  # boundaries are headings; other blocks' texts stay where they are
    return found.join(heads.select("doc_id", "block", F.col("text").alias("title"), "page"), ["doc_id", "block"])


# ---- intake, jobs and sweeps ----


@query("""
WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN ' ' ELSE text[1:8] END AS title, text FROM conversations)
SELECT conv_id, turn, 'no title' AS error FROM r WHERE trim(title) = '' UNION ALL SELECT conv_id, turn, 'long title' FROM r WHERE length(title) > 6 UNION ALL SELECT conv_id, turn, 'no text' FROM r WHERE trim(text) = '' UNION ALL SELECT conv_id, turn, 'long text' FROM r WHERE length(text) > 400
""")
def http_json_api(spark: SparkSession, d: str) -> DataFrame:
    """What an intake of chapters refuses, with tight bounds."""
    turns = read(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    title = F.when(F.col("turn") % 5 == 0, " ").otherwise(F.substring("text", 1, 8))
    return L.api_errors(turns, "key", title, F.col("text"), most_title=6, most_text=400).select("key.*", "error")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 'queued' ELSE 'failed' END AS status FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def recovery_sweep(spark: SparkSession, d: str) -> DataFrame:
    workers = read(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey")).withColumn("alive", F.lit(True))
    jobs = read(spark, d, "orders").join(workers, "o_custkey", "left").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), (F.col("o_orderkey") % 5).alias("tries"), F.coalesce("alive", F.lit(False)).alias("alive"))
    return L.recovery_sweep(jobs, "status", "tries", F.col("alive")).select("o_orderkey", "status")


@query("SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) > 86400000000 * 3")
def ttl_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return L.expired(rows, "at", F.lit("2024-01-20 00:00:00").cast("timestamp"), 72).select("event_id")


# ---- filters of a chapter table ----

#: Choices of a filter panel, by name.
CHOICES = {
    "done": {"statuses": ["F", "P"]}, "one-file": {"file": 3}, "voice": {"voice": "2-HIGH"}, "stale": {"voice": L.STALE}, "readable": {"step": "readable"}, "pairing": {"step": "needs-pairing"}, "words": {"words_min": " 2000,5 ", "words_max": "9000"}, "no-bound": {"words_min": "-3", "minutes_max": "x"},
    "minutes": {"minutes_max": "1.5"}, "week": {"age": "week"}, "old": {"age": "older-month"}, "all": {"statuses": ["F"], "voice": "2-HIGH", "age": "older-week", "words_max": "12000", "minutes_min": "0"},
}
_STEPS = ["no-translation", "translating", "unpaired", "outdated", "pairing", "paired", "linking", "linked"]


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus AS status, CAST(o_totalprice / 10 AS BIGINT) AS words, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 400) * 500 END AS ms, o_orderkey % 5 AS file, o_orderkey % 3 <> 0 AS audio, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS voice, CASE WHEN o_orderkey % 4 = 0 THEN 1.25 ELSE 1.0 END AS speed,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 40 + 0.5 END AS age, ['no-translation', 'translating', 'unpaired', 'outdated', 'pairing', 'paired', 'linking', 'linked'][o_orderkey % 8 + 1] AS step FROM orders),
k AS (SELECT unnest(['done', 'one-file', 'voice', 'stale', 'readable', 'pairing', 'words', 'no-bound', 'minutes', 'week', 'old', 'all']) AS choice),
m AS (SELECT choice, o_orderkey, CASE choice WHEN 'done' THEN status IN ('F', 'P') WHEN 'one-file' THEN file = 3 WHEN 'voice' THEN audio AND voice = '2-HIGH' WHEN 'stale' THEN audio AND (voice IS NULL OR voice <> '2-HIGH' OR speed <> 1.0) WHEN 'readable' THEN step IN ('paired', 'linking', 'linked') WHEN 'pairing' THEN step IN ('unpaired', 'outdated', 'pairing')
  WHEN 'words' THEN words >= 2000.5 AND words <= 9000 WHEN 'no-bound' THEN TRUE WHEN 'minutes' THEN audio AND ms IS NOT NULL AND ms / 60000 <= 1.5 WHEN 'week' THEN audio AND age < 7 WHEN 'old' THEN audio AND age >= 30
  WHEN 'all' THEN status = 'F' AND audio AND voice = '2-HIGH' AND age >= 7 AND words <= 12000 AND ms IS NOT NULL END AS kept FROM c, k)
SELECT choice, count(*) AS chapters, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM m WHERE coalesce(kept, FALSE) GROUP BY choice
""")
def chapter_filters(spark: SparkSession, d: str) -> DataFrame:
    """How many chapters each choice of a filter panel keeps."""
    k = F.col("o_orderkey")
    now = F.lit("2024-06-30 12:00:00").cast("timestamp")
    made = F.timestamp_micros(F.unix_micros(now) - ((k % 40) * 2 + 1) * 43_200_000_000)
    chapters = read(spark, d, "orders").select(
        k, F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") / 10).cast("long").alias("words"), F.when(k % 7 != 0, (k % 400) * 500).alias("duration_ms"), (k % 5).cast("int").alias("file"), F.when(k % 3 != 0, "x.m4a").alias("audio"),
        F.when(k % 11 != 0, F.col("o_orderpriority")).alias("voice"), F.when(k % 4 == 0, 1.25).otherwise(1.0).alias("speed"), F.when(k % 13 != 0, made).alias("made_at"), F.element_at(F.array(*map(F.lit, _STEPS)), (k % 8 + 1).cast("int")).alias("step"),
    )
    kept = F.array(*[F.when(L.chapter_filter(choice, now, ("2-HIGH", 1.0)), name) for name, choice in CHOICES.items()])
    return chapters.select("o_orderkey", F.explode(F.array_compact(kept)).alias("choice")).groupBy("choice").agg(F.count("*").alias("chapters"), F.sum("o_orderkey").alias("keys"))
