"""Relational queries over the driver's tables, each with its SQL.

customer, orders and lineitem stand for owners, books and chapters; region and nation
for a folder tree; events for logs and downloads; conversations for chats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R

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


def folders(spark: SparkSession, d: str) -> DataFrame:
    """region and nation as one tree: r<key> at the top, n<key> below."""
    top = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    low = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return top.union(low)


FOLDERS_SQL = """folders AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
)"""


@query("""
WITH o AS (SELECT o_custkey, count(*) AS books, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending,
  count(DISTINCT o_orderpriority) AS kinds, max(o_orderdate) AS last_update FROM orders GROUP BY 1),
l AS (SELECT o_custkey, count(*) AS parts, count(*) FILTER (WHERE l_returnflag = 'R') AS failures, max(l_shipdate) AS last_log FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, c_name, coalesce(books, 0) AS books, coalesce(done, 0) AS done, coalesce(pending, 0) AS pending, coalesce(kinds, 0) AS kinds,
  coalesce(parts, 0) AS parts, coalesce(failures, 0) AS failures, CAST(epoch(greatest(coalesce(last_update, last_log), coalesce(last_log, last_update))) AS BIGINT) AS last_activity
FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey
""")
def library_overview(spark: SparkSession, d: str) -> DataFrame:
    orders, items = read(spark, d, "orders"), read(spark, d, "lineitem")
    own = orders.groupBy("o_custkey").agg(
        F.count("*").alias("books"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_distinct("o_orderpriority").alias("kinds"), F.max("o_orderdate").alias("last_update"),
    )
    parts = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("failures"), F.max("l_shipdate").alias("last_log"))
    own, parts = own.withColumnRenamed("o_custkey", "own"), parts.withColumnRenamed("o_custkey", "part")
    out = read(spark, d, "customer").join(own, F.col("c_custkey") == F.col("own"), "left").join(parts, F.col("c_custkey") == F.col("part"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("books", "done", "pending", "kinds", "parts", "failures")]
    return out.select("c_custkey", "c_name", *zero, F.unix_timestamp(F.greatest("last_update", "last_log")).alias("last_activity"))


@query("""
SELECT l_orderkey AS book, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_or(l_linestatus = 'O') THEN 'working'
  WHEN bool_and(l_returnflag = 'A') THEN 'ready' WHEN bool_or(l_returnflag = 'A') THEN 'partial' ELSE 'waiting' END AS status, count(*) AS children
FROM lineitem GROUP BY 1
""")
def book_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_linestatus") == "O", "busy").when(F.col("l_returnflag") == "A", "done").otherwise("idle")
    # a busy part that is also done must still count as done; so states are looked at one by one
    parts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), state.alias("s"), "l_returnflag", "l_linestatus")
    rules = [(F.bool_or(F.col("s") == "error"), "failed"), (F.bool_or(F.col("l_linestatus") == "O"), "working"), (F.bool_and(F.col("l_returnflag") == "A"), "ready"), (F.bool_or(F.col("l_returnflag") == "A"), "partial")]
    return parts.groupBy("book").agg(R.first_rule(rules, "waiting").alias("status"), F.count("*").alias("children"))


@query("""
SELECT l_orderkey AS book, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_or(l_returnflag = 'N') THEN 'working'
  WHEN bool_and(l_returnflag = 'A') THEN 'ready' WHEN bool_or(l_returnflag = 'A') THEN 'partial' ELSE 'waiting' END AS status, count(*) AS children
FROM lineitem GROUP BY 1
""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_returnflag").alias("flag"))
    return R.status_rollup(parts, "book", "flag", failed=["R"], working=["N"], done=["A"])


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90) AS ready, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INT) < 10) AS pending,
  count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS missing, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events
""")
def agg_index_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return read(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(k >= 90).alias("ready"), F.count_if(k < 10).alias("pending"), F.count_if(k.isNull()).alias("missing"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def agg_json_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) LIKE '%red%' AND lower(p_name) LIKE '%wid%' ORDER BY p_partkey DESC LIMIT 50")
def title_search_ilike(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part")
    return parts.where(R.like_all(F.col("p_name"), "RED wid")).orderBy(F.desc("p_partkey")).limit(50).select("p_partkey", "p_name", "p_brand")


@query(f"""
WITH RECURSIVE {FOLDERS_SQL}, up AS (
  SELECT id AS ancestor, id AS node, 0 AS depth FROM folders
  UNION ALL SELECT f.parent, up.node, up.depth + 1 FROM up JOIN folders f ON f.id = up.ancestor WHERE f.parent IS NOT NULL
) SELECT ancestor, node, depth FROM up
""")
def subtree_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.closure(folders(spark, d), "id", "parent")


@query(f"""
WITH RECURSIVE {FOLDERS_SQL}, up AS (
  SELECT id AS ancestor, id AS node, 0 AS depth FROM folders
  UNION ALL SELECT f.parent, up.node, up.depth + 1 FROM up JOIN folders f ON f.id = up.ancestor WHERE f.parent IS NOT NULL
) SELECT node, ancestor, name, CAST(row_number() OVER (PARTITION BY node ORDER BY depth DESC) AS INTEGER) AS place FROM up JOIN folders ON folders.id = ancestor
""")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    tree = folders(spark, d)
    up = R.closure(tree, "id", "parent").join(tree.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    return up.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("depth")))).select("node", "ancestor", "name", "place")


@query(f"""
WITH RECURSIVE {FOLDERS_SQL}, down AS (
  SELECT id AS node, name AS path, 0 AS depth FROM folders WHERE parent IS NULL
  UNION ALL SELECT f.id, down.path || '/' || f.name, down.depth + 1 FROM down JOIN folders f ON f.parent = down.node
) SELECT node, path, depth FROM down
""")
def folder_paths(spark: SparkSession, d: str) -> DataFrame:
    return R.paths(folders(spark, d), "id", "parent", "name")


@query("""
SELECT 'r' || n_regionkey AS ancestor, count(*) AS customers, count(*) FILTER (WHERE c_acctbal < 0) AS overdrawn, max(c_custkey) AS newest
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT 'n' || c_nationkey, count(*), count(*) FILTER (WHERE c_acctbal < 0), max(c_custkey) FROM customer GROUP BY 1
""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    tree = R.closure(folders(spark, d), "id", "parent")
    # per folder first: the closure then repeats sums, not customers
    own = read(spark, d, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("node")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("low"), F.max("c_custkey").alias("top"))
    return tree.join(own, "node").groupBy("ancestor").agg(F.sum("n").alias("customers"), F.sum("low").alias("overdrawn"), F.max("top").alias("newest"))


@query("""
SELECT 'r' || r_regionkey AS node, 'n' || n_nationkey AS target, n_regionkey <> r_regionkey AS allowed FROM region, nation
UNION ALL SELECT 'n' || n_nationkey, 'r' || r_regionkey, TRUE FROM region, nation
""")
def move_guard(spark: SparkSession, d: str) -> DataFrame:
    tree = folders(spark, d)
    top, low = tree.where("parent IS NULL").select(F.col("id").alias("node")), tree.where("parent IS NOT NULL").select(F.col("id").alias("target"))
    # a small fixed table of possible moves, both ways
    down = top.join(low, F.lit(True))
    moves = down.union(down.select(F.col("target"), F.col("node")))
    return R.allowed_moves(tree, "id", "parent", moves)


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS job, min(o_orderpriority) AS priority FROM orders GROUP BY 1")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    first = R.lowest_per(read(spark, d, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")])
    return first.select("o_custkey", F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("priority"))


@query("""
WITH q AS (SELECT o_orderpriority AS lane, o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS upto FROM orders)
SELECT lane, o_custkey, CAST(max(upto) AS BIGINT) AS work_until_done, count(*) AS items FROM q GROUP BY 1, 2
""")
def eta_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    queue = read(spark, d, "orders").select(F.col("o_orderpriority").alias("lane"), "o_custkey", F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("waits"), "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("chars"))
    return R.queue_eta(queue, "lane", "o_custkey", [F.col("waits"), F.col("o_orderdate"), F.col("o_orderkey")], "chars")


@query("SELECT source, lang, count(*) AS n, CAST(row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS INTEGER) AS place FROM documents GROUP BY 1, 2")
def group_mode_languages(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang")))


@query("SELECT l_orderkey, l_linestatus, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS done, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_discount > 0.05) AS stale FROM lineitem GROUP BY 1, 2")
def agg_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return R.counts_where(read(spark, d, "lineitem"), ["l_orderkey", "l_linestatus"], {"total": F.lit(True), "done": flag == "A", "failed": flag == "R", "stale": F.col("l_discount") > 0.05})


@query("""
SELECT o_orderpriority AS language, min(o_orderstatus) AS label, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
  count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_linestatus = 'O') AS running, count(DISTINCT o_orderkey) AS books
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def agg_translation_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("language")).agg(
        F.min("o_orderstatus").alias("label"), F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_linestatus") == "O").alias("running"), F.count_distinct("o_orderkey").alias("books"),
    )


@query("SELECT p_brand, p_type, min(p_name) AS label, count(*) AS total, count(*) FILTER (WHERE p_size > 25) AS done FROM part GROUP BY 1, 2")
def agg_variant_rollup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_name").alias("label"), F.count("*").alias("total"), F.count_if(F.col("p_size") > 25).alias("done"))


@query("SELECT user_id, event_type, count(*) AS n, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY 1, 2")
def agg_max_last(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"))


@query("SELECT conv_id, coalesce(max(turn) + 1, 0) AS next_index FROM conversations GROUP BY 1")
def agg_next_index(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.max("turn") + 1, F.lit(0)).alias("next_index"))


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS books, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("books"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT DISTINCT lang, source FROM documents WHERE text IS NOT NULL")
def select_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("lang", "source").distinct()


@query("SELECT 'original' AS kind, o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'variant', l_orderkey, l_linestatus FROM lineitem WHERE l_returnflag = 'R'")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.lit("original").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    b = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.lit("variant").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status"))
    return a.unionByName(b)


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.insert_ignore(old, read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 250000 THEN 'C' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus = 'O' AND o_totalprice > 250000 AS changed FROM orders")
def update_guarded(spark: SparkSession, d: str) -> DataFrame:
    claimed = R.update_where(read(spark, d, "orders"), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 250000), {"o_orderstatus": F.lit("C")})
    return claimed.select("o_orderkey", "o_orderstatus", "changed")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) AS returned FROM orders")
def delete_returning(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey")
    doomed = read(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    stay, gone = R.delete_returning(orders, doomed, ["o_orderkey"])
    return gone.withColumn("returned", F.lit(True)).unionByName(stay.withColumn("returned", F.lit(False)))


@query(r"SELECT page_id, CASE WHEN url LIKE 'http%' THEN regexp_replace(url, '^https?://[^/]+/', '') ELSE url END AS path FROM pages")
def migrate_regex_update(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", F.when(url.like("http%"), F.regexp_replace(url, "^https?://[^/]+/", "")).otherwise(url).alias("path"))


@query("SELECT c_custkey, coalesce(n_name, c_mktsegment) AS place FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    notes = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("place"))
    nations = read(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), "n_name")
    return R.update_from(notes, nations, "k", {"place": "n_name"}).select("c_custkey", "place")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)")
def not_exists_correlated(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000")
    return read(spark, d, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def not_in_guarded(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def exists_correlated(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return read(spark, d, "part").join(held, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'F'")
def join_left_variant(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem")
    return read(spark, d, "orders").join(items, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == "F"), "left").select("o_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT o_orderkey, c_name, count(l_linenumber) AS variants, count(s_suppkey) AS prepared FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1, 2
""")
def join_three_left(spark: SparkSession, d: str) -> DataFrame:
    orders, items = read(spark, d, "orders"), read(spark, d, "lineitem")
    out = orders.join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(items, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_returnflag") == "A"), "left")
    out = out.join(read(spark, d, "supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_acctbal") > 0), "left")
    return out.groupBy("o_orderkey", "c_name").agg(F.count("l_linenumber").alias("variants"), F.count("s_suppkey").alias("prepared"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS books, CAST((SELECT coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS cents FROM customer")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c"))
    return read(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("books"), F.coalesce("c", F.lit(0)).alias("cents"))


@query("""
SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS questions, count(*) FILTER (WHERE role = 'assistant') AS answers, arg_min(text, turn) FILTER (WHERE role = 'user') AS title,
  string_agg(text, chr(31) ORDER BY turn) FILTER (WHERE role = 'user') AS asked FROM conversations GROUP BY 1
""")
def question_list(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("role") == "user"
    asked = F.array_sort(F.collect_list(F.when(user, F.struct("turn", "text"))))
    out = read(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(user).alias("questions"), F.count_if(F.col("role") == "assistant").alias("answers"), asked.alias("q"))
    return out.select("conv_id", "questions", "answers", F.try_element_at("q", F.lit(1))["text"].alias("title"), F.when(F.size("q") > 0, F.array_join(F.transform("q", lambda x: x["text"]), "\x1f")).alias("asked"))


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user' AND contains(lower(text), 'the'))")
def conversation_filter(spark: SparkSession, d: str) -> DataFrame:
    hit = F.bool_or((F.col("role") == "user") & R.like_all(F.col("text"), "THE"))
    return read(spark, d, "conversations").groupBy("conv_id").agg(hit.alias("hit")).where("hit").select("conv_id")


@query("SELECT coalesce(value, w) AS value, coalesce(n, 0) AS count FROM (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1) FULL JOIN (SELECT unnest(['ECONOMY', 'no such type']) AS w) ON w = value")
def option_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.option_counts(read(spark, d, "part"), "p_type", ["ECONOMY", "no such type"])


@query("""
WITH m AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT l_suppkey, v[len(v) // 2 + 1] AS median, CAST(len(v) AS BIGINT) AS n FROM m
""")
def median_upper(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(R.upper_median("l_extendedprice").alias("median"), F.count("*").alias("n"))


@query("""
WITH m AS (SELECT l_suppkey AS g, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1), x AS (SELECT g, v[len(v) // 2 + 1] AS median, len(v) AS n FROM m),
d AS (SELECT l_suppkey AS g, l_orderkey, l_linenumber, l_quantity, median, n, abs(l_quantity - median) AS off FROM lineitem JOIN x ON g = l_suppkey),
y AS (SELECT g, list_sort(list(off)) AS v FROM d GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_quantity, median, v[len(v) // 2 + 1] AS mad, n >= 5 AND (median - l_quantity) / greatest(1.4826 * v[len(v) // 2 + 1], 0.02) > 1.2 AS outlier FROM d JOIN y USING (g)
""")
def mad_outlier(spark: SparkSession, d: str) -> DataFrame:
    rows = R.outliers_below(read(spark, d, "lineitem"), "l_suppkey", "l_quantity", limit=1.2)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "median", "mad", "outlier")


@query("""
WITH p AS (SELECT l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2),
u AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM p)
SELECT l_returnflag, min(l_quantity) AS weighted_median FROM u WHERE upto * 2 >= total GROUP BY 1
""")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_median(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS i, list(l_extendedprice) OVER (PARTITION BY l_orderkey) AS a FROM lineitem),
o AS (SELECT *, CASE WHEN len(a) > 1 THEN list_sort(a)[(len(a) - 1) // 2 + CASE WHEN i - 1 <= (len(a) - 1) // 2 THEN 2 ELSE 1 END] END AS others_median FROM r)
SELECT l_orderkey, l_linenumber, others_median, coalesce(v > greatest(3 * others_median, 60000), FALSE) AS oversized FROM o
""")
def leave_one_out_median(spark: SparkSession, d: str) -> DataFrame:
    return R.oversized(read(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", least=60000.0).select("l_orderkey", "l_linenumber", "others_median", "oversized")


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id FROM events), m AS (SELECT max(day) AS last FROM e)
SELECT CAST(day AS VARCHAR) AS day, event_type, count(*) AS fetches, count(DISTINCT user_id) AS users FROM e, m WHERE day > last - 30 GROUP BY 1, 2
""")
def download_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = rows.agg(F.max("day").alias("last"))  # one row
    return rows.join(F.broadcast(last), F.col("day") > F.date_sub("last", 30)).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count("*").alias("fetches"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def fetch_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT source, CAST(ceil(sum(n_chars) * 0.000015) AS BIGINT) AS cost, CAST(sum(n_chars) AS BIGINT) AS chars, bool_or(text IS NULL) AS partial FROM documents GROUP BY 1")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(F.ceil(F.sum("n_chars") * F.lit(0.000015)).cast("long").alias("cost"), F.sum("n_chars").alias("chars"), F.bool_or(F.col("text").isNull()).alias("partial"))


@query("""
SELECT event_id, user_id, coalesce(sum(1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS gap_us,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events
""")
def prev_cursor(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, d, "events").withColumn("one", F.lit(1).cast("long"))
    rows = R.running_total(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "one", "before")
    return rows.select("event_id", "user_id", "before", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(line).cast("timestamp"))).alias("gap_us"), F.lead("event_id").over(line).alias("next_event"))


@query("""
SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
WHERE e.event_type <> 'purchase'
""")
def asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    asks = events.where("event_type <> 'purchase'").select("user_id", "event_id", "ts")
    marks = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("last_purchase"))
    return R.as_of(asks, marks, "user_id", "ts", "start", ["last_purchase"]).select("event_id", "last_purchase")


@query("""
WITH s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) AS "end", l_returnflag FROM lineitem)
SELECT a.l_suppkey, a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R' AND a.start < b."end" AND b.start < a."end"
""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    pick = lambda flag: spans.where(F.col("l_returnflag") == flag)
    return R.overlapping(pick("A"), pick("R"), "l_suppkey", cell=64).select("l_suppkey", "a_id", "b_id")


@query("""
WITH m AS (SELECT max(ts) AS now FROM events)
SELECT event_id, CASE WHEN ts >= date_trunc('day', now) THEN 'today' WHEN ts >= date_trunc('day', now) - INTERVAL 1 DAY THEN 'yesterday' ELSE 'earlier' END AS bucket FROM events, m
""")
def day_bucket(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    now = F.broadcast(events.agg(F.date_trunc("day", F.max("ts")).alias("today")))  # one row
    bucket = F.when(F.col("ts") >= F.col("today"), "today").when(F.col("ts") >= F.col("today") - F.expr("INTERVAL 1 DAY"), "yesterday").otherwise("earlier")
    return events.join(now, F.lit(True)).select("event_id", bucket.alias("bucket"))


@query("""
SELECT user_id, event_type, count(*) AS n, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 9 END, event_type) AS INTEGER) AS place FROM events GROUP BY 1, 2
""")
def keyed_order(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array(F.lit("purchase"), F.lit("signup"))
    at = F.array_position(listed, F.col("event_type"))
    per = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.when(at > 0, at).otherwise(99), "event_type")))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice, o_orderkey) AS INTEGER) AS place FROM orders")
def multi_sort(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_totalprice", "o_orderkey")).alias("place"))


@query("""
WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, o_custkey, CAST(i AS INTEGER) AS index FROM n
""")
def reorder(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    given = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("ids"))
    placed = given.select(F.posexplode("ids").alias("index", "x")).select(F.col("x.o_orderkey").alias("o_orderkey"), "index")
    return orders.join(placed, "o_orderkey").select("o_orderkey", "o_custkey", "index")


@query("""
WITH s AS (SELECT doc_id, source, n_chars, sum(CAST(ceil(n_chars / 1800.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM documents)
SELECT doc_id, CAST(coalesce(o, 0) AS BIGINT) AS page_offset FROM s
""")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "documents").select("doc_id", "source", F.ceil(F.col("n_chars") / 1800.0).alias("pages"))
    return R.long_running_total(pages, ["source"], [F.col("doc_id")], "pages", "page_offset").select("doc_id", "page_offset")


@query("""
SELECT CASE WHEN html LIKE '%<article>%' THEN 'article' WHEN html LIKE '%<table%' THEN 'table' ELSE 'other' END AS category, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY 1
""")
def disk_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    kind = R.first_rule([(html.like("%<article>%"), "article"), (html.like("%<table%"), "table")], "other")
    return read(spark, d, "pages").groupBy(kind.alias("category")).agg(F.count("*").alias("files"), F.sum(F.length("html")).alias("size"))


@query("""
SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'attention' WHEN l.toxic = 1 THEN 'blocked' WHEN l.doc_id IS NULL THEN 'unseen' WHEN d.n_chars < 200 THEN 'noText' ELSE 'ready' END AS state
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def book_filter_state(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").join(read(spark, d, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    rules = [(F.col("quality") == 0, "attention"), (F.col("toxic") == 1, "blocked"), (F.col("seen").isNull(), "unseen"), (F.col("n_chars") < 200, "noText")]
    return rows.select("doc_id", R.first_rule(rules, "ready").alias("state"))
