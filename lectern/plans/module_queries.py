"""Queries of the library's smaller modules over the driver's tables, each with its SQL.

events stand for logs, cues and jobs; conversations for chats and chapters; labels for prepared editions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str):
    def register(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


# ---- projections and filters ----


@query("SELECT doc_id, substr(text, 201, 200) AS page, CAST(length(text) AS BIGINT) AS total, length(text) > 400 AS truncated FROM documents")
def text_page(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text").cast("long")
    return read(spark, d, "documents").select("doc_id", F.substring("text", 201, 200).alias("page"), n.alias("total"), (n > 400).alias("truncated"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS revision FROM documents")
def text_revision(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("revision"))


@query("SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN text END, CASE WHEN n_chars > 500 THEN source END, lang) AS shown FROM documents")
def effective_text(spark: SparkSession, d: str) -> DataFrame:
    shown = F.coalesce(F.when(F.col("lang") == "en", F.col("text")), F.when(F.col("n_chars") > 500, F.col("source")), F.col("lang"))
    return read(spark, d, "documents").select("doc_id", shown.alias("shown"))


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(month(o_orderdate) AS BIGINT) END, o_orderkey), o_orderkey) AS INTEGER) AS place FROM orders
""")
def file_reading_order(spark: SparkSession, d: str) -> DataFrame:
    position = F.when(F.col("o_orderstatus") == "F", F.month("o_orderdate").cast("long"))
    line = Window.partitionBy("o_custkey").orderBy(F.coalesce(position, F.col("o_orderkey")), "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(line).alias("place"))


@query("SELECT p.page_id, p.html IS NOT NULL AS has_html, d.text IS NOT NULL AS has_text FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id")
def has_text_flags(spark: SparkSession, d: str) -> DataFrame:
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return read(spark, d, "pages").join(texts, "page_id", "left").select("page_id", F.col("html").isNotNull().alias("has_html"), F.col("text").isNotNull().alias("has_text"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'purchase')")
def in_json_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "events").where("event_type = 'purchase'").select(F.get_json_object("props", "$.k").try_cast("long").alias("doc_id")).distinct()
    return read(spark, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_job, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50, FALSE) AS pending FROM events")
def pending_exports(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", k.isNotNull().alias("has_job"), F.coalesce(k.try_cast("int") >= 50, F.lit(False)).alias("pending"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"seen":true}' AS merged, '{"seen":true}' AS dropped FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("p", F.from_json("props", "k int")).where("p.k IS NOT NULL")
    merged = F.col("p").withField("seen", F.lit(True))
    return rows.select("event_id", F.to_json(merged).alias("merged"), F.to_json(merged.dropFields("k")).alias("dropped"))


@query("SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS at FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND event_type = 'error'")
def log_cursor(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("ts > TIMESTAMP '2024-01-15 00:00:00' AND event_type = 'error'").select("event_id", micros("ts").alias("at"))


@query("SELECT DISTINCT l_orderkey AS job FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'N' OR (l_quantity < 10 AND o_orderstatus = 'F')")
def owed_jobs(spark: SparkSession, d: str) -> DataFrame:
    items, orders = read(spark, d, "lineitem"), read(spark, d, "orders")
    rows = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where("l_returnflag = 'N' OR (l_quantity < 10 AND o_orderstatus = 'F')").select(F.col("l_orderkey").alias("job")).distinct()


@query("""
SELECT doc_id, CASE WHEN source LIKE '%web%' THEN 'page' WHEN n_chars > 2000 THEN 'book' ELSE 'note' END || ' (' || CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE coalesce(lang, 'unknown') END || ')' AS label FROM documents
""")
def edition_label(spark: SparkSession, d: str) -> DataFrame:
    form = R.first_rule([(F.col("source").like("%web%"), "page"), (F.col("n_chars") > 2000, "book")], "note")
    language = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").otherwise(F.coalesce("lang", F.lit("unknown")))
    return read(spark, d, "documents").select("doc_id", F.concat(form, F.lit(" ("), language, F.lit(")")).alias("label"))


@query("SELECT DISTINCT c_mktsegment FROM customer JOIN (VALUES ('building'), ('MACHINERY'), ('none')) v(k) ON lower(c_mktsegment) = lower(k)")
def case_insensitive_key(spark: SparkSession, d: str) -> DataFrame:
    asked = F.broadcast(spark.createDataFrame([("building",), ("MACHINERY",), ("none",)], "k string"))
    return read(spark, d, "customer").join(asked, F.lower("c_mktsegment") == F.lower("k")).select("c_mktsegment").distinct()


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 200")
def notes_scope(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").where("role = 'user'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(200).select("conv_id", "turn", "text")


_TAGS = r"(?i)</?(?:p|div|br|li|ul|h[1-6]|article|nav|footer|title)\b[^>]*>"


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '{_TAGS}', chr(10), 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[ \t\n\r]*\n[ \t\n\r]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM c
""")
def strip_html_regex(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("html", F.lit(_TAGS), F.lit("\n")), F.lit("<[^>]+>"), F.lit(" "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, F.lit("[ \t]+"), F.lit(" ")), F.lit("[ \t\n\r]*\n[ \t\n\r]*"), F.lit("\n"))
    return read(spark, d, "pages").select("page_id", F.btrim(t, F.lit(" \n")).alias("text"))


# ---- joins ----


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, c_name, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
LEFT JOIN part ON p_partkey = l_partkey AND p_size = l_linenumber * 7
""")
def join_hit_context(spark: SparkSession, d: str) -> DataFrame:
    items, orders, customers, parts = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    rows = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(parts, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_size") == F.col("l_linenumber") * 7), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus", "c_name", "p_name")


@query("""
SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unavailable' ELSE 'ready' END AS status FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.n_chars = length(d.text) AND d.lang = 'en'
""")
def prepared_pairs(spark: SparkSession, d: str) -> DataFrame:
    current = read(spark, d, "documents").where("n_chars = length(text) AND lang = 'en'").select("doc_id", F.lit("ready").alias("status"))
    return read(spark, d, "labels").join(current, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("unavailable")).alias("status"))


@query("""
SELECT 'file' AS side, page_id AS id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'row', doc_id FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages WHERE page_id IS NOT NULL)
""")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    files, rows = read(spark, d, "pages").select(F.col("page_id").alias("id")), read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    only = lambda a, b, side: a.where("id IS NOT NULL").join(b, "id", "left_anti").select(F.lit(side).alias("side"), "id")
    return only(files, rows, "file").unionByName(only(rows, files, "row"))


@query("""
SELECT CASE WHEN event_type IN ('click', 'view') THEN 'light' WHEN event_type = 'purchase' THEN 'heavy' ELSE 'other' END AS pool, count(*) AS running, count(DISTINCT user_id) AS owners FROM events WHERE value > 50 GROUP BY 1
""")
def pool_running(spark: SparkSession, d: str) -> DataFrame:
    pools = F.broadcast(spark.createDataFrame([("click", "light"), ("view", "light"), ("purchase", "heavy")], "event_type string, p string"))
    rows = read(spark, d, "events").where("value > 50").join(pools, "event_type", "left")
    return rows.groupBy(F.coalesce("p", F.lit("other")).alias("pool")).agg(F.count("*").alias("running"), F.count_distinct("user_id").alias("owners"))


@query("""
WITH a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, bool_and(a.i IS NOT NULL AND b.i IS NOT NULL AND a.p IS NOT DISTINCT FROM b.p) AS unchanged, count(*) AS places
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.i = b.i GROUP BY 1
""")
def redetect_unchanged(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    side = lambda status, name: read(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_custkey", place.alias("i"), F.struct(F.col("o_orderpriority").alias("p")).alias(name))
    both = side("F", "old").join(side("O", "new"), ["o_custkey", "i"], "full")
    return both.groupBy("o_custkey").agg(F.bool_and(F.coalesce(F.col("old").eqNullSafe(F.col("new")), F.lit(False))).alias("unchanged"), F.count("*").alias("places"))


# ---- aggregations ----


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) AS highest FROM events GROUP BY 1")
def latest_log(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("event_id").alias("highest"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def latest_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("SELECT lang, count(*) AS total, count(l.doc_id) AS saved, count(*) FILTER (WHERE l.doc_id IS NULL AND n_chars > 500) AS unresolved, count(*) = count(l.doc_id) AS complete FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def extraction_progress(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "labels").select("doc_id", F.lit(1).alias("seen"))
    rows = read(spark, d, "documents").join(seen, "doc_id", "left")
    total, saved = F.count("*"), F.count("seen")
    return rows.groupBy("lang").agg(total.alias("total"), saved.alias("saved"), F.count_if(F.col("seen").isNull() & (F.col("n_chars") > 500)).alias("unresolved"), (total == saved).alias("complete"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS ready, count(*) FILTER (WHERE quality = 0) AS attention, count(*) FILTER (WHERE toxic = 1) AS blocked, count(*) AS total FROM labels")
def library_counts(spark: SparkSession, d: str) -> DataFrame:
    flags = {"ready": "quality = 1 AND toxic = 0", "attention": "quality = 0", "blocked": "toxic = 1"}
    return read(spark, d, "labels").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in flags.items()], F.count("*").alias("total"))


@query("""
SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'A') THEN 'word' WHEN bool_and(l_returnflag = 'N') THEN 'chunk' ELSE 'sentence' END AS level,
  CAST(max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END) AS INTEGER) AS finest FROM lineitem GROUP BY 1
""")
def combine_levels(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    level = R.first_rule([(F.bool_and(flag == "A"), "word"), (F.bool_and(flag == "N"), "chunk")], "sentence")
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(level.alias("level"), F.max(F.when(flag == "A", 3).when(flag == "R", 2).otherwise(1)).alias("finest"))


@query("SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS duration, array_to_string(list_sort(list(DISTINCT l_returnflag)), ', ') AS voices, count(*) AS tracks FROM lineitem GROUP BY 1")
def lane_summary(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("duration"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("voices"), F.count("*").alias("tracks"))


@query("""
SELECT c_nationkey, array_to_string(list_slice(list(c_name ORDER BY c_custkey), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS names FROM customer GROUP BY 1
""")
def named_list(spark: SparkSession, d: str) -> DataFrame:
    """Only the first three names of a group are gathered."""
    rows = read(spark, d, "customer").withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "c_name")))), lambda x: x["c_name"])
    more = F.when(F.count("*") > 3, F.concat(F.lit(" and "), (F.count("*") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return rows.groupBy("c_nationkey").agg(F.concat(F.array_join(first, ", "), more).alias("names"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE role <> 'system' GROUP BY 1")
def ask_context(spark: SparkSession, d: str) -> DataFrame:
    """A chat's turns in order; a chat is what one request holds."""
    rows = read(spark, d, "conversations").where("role <> 'system' AND text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda t: t["text"]), "\n\n").alias("context"))


# ---- windows ----


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, CAST(coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice) END, 0) AS BIGINT) AS ms FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT *, sum(ms) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS e FROM c)
SELECT o_custkey, o_orderkey, CAST(e - ms AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms FROM e
""")
def chapter_markers(spark: SparkSession, d: str) -> DataFrame:
    ms = F.coalesce(F.when(F.col("o_orderpriority") != "5-LOW", F.round("o_totalprice")), F.lit(0.0)).cast("long")
    rows = read(spark, d, "orders").where("o_orderstatus = 'F'").withColumn("ms", ms)
    end = F.sum("ms").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("o_custkey", "o_orderkey", (end - F.col("ms")).alias("start_ms"), end.alias("end_ms"))


@query("""
WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(coalesce(value, 0) * 100000000) AS BIGINT) AS e FROM events),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM c)
SELECT user_id, event_id, 'cue' AS kind, CAST(greatest(s, coalesce(reached, s)) AS BIGINT) AS start_us, CAST(e AS BIGINT) AS end_us FROM r WHERE reached IS NULL OR e > reached
UNION ALL SELECT user_id, event_id, 'gap', CAST(reached AS BIGINT), CAST(s AS BIGINT) FROM r WHERE reached < s
""")
def transcript_segments(spark: SparkSession, d: str) -> DataFrame:
    start = micros("ts")
    end = start + F.round(F.coalesce("value", F.lit(0.0)) * 100000000).cast("long")
    rows = read(spark, d, "events").select("user_id", "event_id", start.alias("s"), end.alias("e"))
    before = Window.partitionBy("user_id").orderBy("s", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reached", F.max("e").over(before))
    # both kinds of segment of a cue at once, so that its row is made only once
    segment = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_us"), b.alias("end_us"))
    cue = F.when(F.col("reached").isNull() | (F.col("e") > F.col("reached")), segment("cue", F.greatest("s", "reached"), F.col("e")))
    gap = F.when(F.col("reached") < F.col("s"), segment("gap", F.col("reached"), F.col("s")))
    return rows.select("user_id", "event_id", F.explode(F.array_compact(F.array(cue, gap))).alias("x")).select("user_id", "event_id", "x.*")


@query("""
WITH g AS (SELECT user_id, event_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 86400000000, FALSE) AS new FROM events)
SELECT user_id, event_id, CAST(1 + sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM g
""")
def paragraph_groups(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(micros("ts") - F.lag(micros("ts")).over(line) >= 86_400_000_000, F.lit(False)).cast("int")
    rows = read(spark, d, "events").withColumn("new", new)
    return rows.select("user_id", "event_id", (F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)) + 1).alias("paragraph"))


@query("""
WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn, CAST(start AS BIGINT) AS char_start, CAST(coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn), total) AS BIGINT) AS char_end FROM s
""")
def next_boundary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    rows = R.running_total(rows, ["conv_id"], [F.col("turn")], "n", "char_start").withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
    following = F.lead("char_start").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", "char_start", F.coalesce(following, "total").alias("char_end"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS index FROM conversations WHERE role = 'user'")
def keep_inserted_chapters(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", place.alias("index"))


@query("""
WITH a AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS u FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS v FROM a WHERE u <= 2)
SELECT doc_id, lang, source, n_chars FROM b WHERE v <= 3
""")
def per_group_cap(spark: SparkSession, d: str) -> DataFrame:
    best = [F.desc("n_chars"), F.col("doc_id")]
    rows = read(spark, d, "documents").withColumn("u", F.row_number().over(Window.partitionBy("source", "lang").orderBy(*best))).where("u <= 2")
    return rows.withColumn("v", F.row_number().over(Window.partitionBy("source").orderBy(*best))).where("v <= 3").select("doc_id", "lang", "source", "n_chars")


@query("""
WITH c AS (SELECT conv_id, turn, substr(text, 1, 300) AS text, sum(least(length(text), 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, turn, text FROM c WHERE used <= 900
""")
def comment_tree(spark: SparkSession, d: str) -> DataFrame:
    used = F.sum(F.least(F.length("text"), F.lit(300))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return read(spark, d, "conversations").withColumn("used", used).where("used <= 900").select("conv_id", "turn", F.substring("text", 1, 300).alias("text"))


@query("SELECT doc_id, CAST(0 AS INTEGER) AS pos, quality AS value FROM labels UNION ALL SELECT doc_id, 1, toxic FROM labels")
def sentence_sequence(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").select("doc_id", F.posexplode(F.array("quality", "toxic")).alias("pos", "value"))
