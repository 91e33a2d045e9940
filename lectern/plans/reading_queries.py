"""Queries over blocks, sentences, cues and times, each with its SQL.

Turns of a conversation stand for blocks or chapters, orders for pairs and cues (their dates and prices for times), items for words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reading as G
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- blocks ----

_JOINED = """k AS (SELECT conv_id, turn, text, role <> 'system' AS verse, turn % 3 <> 0 AS line FROM conversations WHERE text <> '' AND turn % 7 <> 5),
p AS (SELECT *, lag(verse) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM k), s AS (SELECT *, CASE WHEN was IS NULL THEN '' WHEN line AND verse AND was THEN chr(10) ELSE chr(10) || chr(10) END AS sep FROM p),
b AS (SELECT *, CAST(coalesce(sum(length(sep) + length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(sep) AS BIGINT) AS start FROM s)"""


def block_rows(spark: SparkSession, d: str) -> DataFrame:
    kept = read(spark, d, "conversations").where("turn % 7 <> 5")
    return G.block_spans(kept, "conv_id", "turn", "text", F.col("role") != "system", F.col("turn") % 3 != 0)


@query(f"""WITH {_JOINED} SELECT conv_id, turn, start, start + length(text) AS "end", sha256(string_agg(sep || text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS joined FROM b""")
def join_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    spans = block_rows(spark, d)
    whole = G.joined_text(spans, "conv_id", "turn", "text").select("conv_id", F.sha2("text", 256).alias("joined"))
    return spans.select("conv_id", "turn", "start", "end").join(whole, "conv_id")


@query(r"""
WITH k AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations), s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN '' ELSE chr(10) || chr(10) END AS sep FROM k WHERE text <> '')
SELECT conv_id, sha256(string_agg(sep || text, '' ORDER BY turn)) AS joined, CAST(sum(length(sep || text)) AS BIGINT) AS length FROM s GROUP BY conv_id
""")
def normalize_blocks(spark: SparkSession, d: str) -> DataFrame:
    clean = read(spark, d, "conversations").withColumn("text", F.trim(F.regexp_replace("text", F.lit(r"\s+"), F.lit(" "))))
    spans = G.block_spans(clean, "conv_id", "turn", "text", F.lit(False), F.lit(False))
    return G.joined_text(spans, "conv_id", "turn", "text").select("conv_id", F.sha2("text", 256).alias("joined"), F.length("text").cast("long").alias("length"))


@query(f"""
WITH {_JOINED}, e AS (SELECT conv_id, turn AS page, start, start + length(text) AS z FROM b), w AS (SELECT conv_id, max(z) AS joined FROM e GROUP BY 1),
a AS (SELECT conv_id, turn AS ask, turn * 150 AS "offset", CASE WHEN conv_id % 2 = 0 THEN joined ELSE 900 END AS raw, joined FROM conversations JOIN w USING (conv_id)),
x AS (SELECT *, CASE WHEN raw = joined THEN "offset"::DOUBLE ELSE "offset"::DOUBLE / raw * joined END AS at FROM a)
SELECT conv_id, ask, CAST((SELECT max(page) FROM e WHERE e.conv_id = x.conv_id AND e.start <= x.at) AS BIGINT) AS page FROM x
""")
def page_at_offset(spark: SparkSession, d: str) -> DataFrame:
    spans = block_rows(spark, d).select("conv_id", "start", "end", F.col("turn").alias("page"))
    whole = spans.groupBy("conv_id").agg(F.max("end").alias("joined"))
    asks = read(spark, d, "conversations").join(whole, "conv_id").select("conv_id", F.col("turn").alias("ask"), (F.col("turn") * 150).alias("offset"), F.when(F.col("conv_id") % 2 == 0, F.col("joined")).otherwise(900).alias("raw"))
    return G.page_at(asks, spans, "conv_id", "offset", "raw").select("conv_id", "ask", "page")


# ---- sentences and tokens ----

_SENTENCES = rf"""m AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '([.!?…]["”’)]?[ \t\r\n]+)', '\1{G.CUT}', 'g'), '(\n[ \t\r\n]*\n[ \t\r\n]*)([^\p{{Ll}}\s{G.CUT}])', '\1{G.CUT}\2', 'g') AS t FROM conversations),
u AS (SELECT conv_id, turn, unnest(string_split(t, '{G.CUT}')) AS piece, unnest(range(len(string_split(t, '{G.CUT}')))) AS pos FROM m),
v AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, trim(piece, ' ' || chr(9) || chr(10) || chr(13)) AS sentence FROM u)"""


@query(f"""
WITH {_SENTENCES} SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS INTEGER) AS number, CAST(place + length(piece) - length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(13))) AS BIGINT) AS start,
  CAST(place + length(piece) - length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(13))) + length(sentence) AS BIGINT) AS "end", sentence FROM v WHERE sentence <> ''
""")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return G.sentences(read(spark, d, "conversations"), ["conv_id", "turn"], "text")


@query(rf"""
WITH m AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', '{G.CUT}\1{G.CUT}', 'g'), '{G.CUT}') AS t FROM conversations), u AS (SELECT conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS pos FROM m),
v AS (SELECT *, CAST(coalesce(sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u)
SELECT conv_id, turn, CAST(pos // 2 + 1 AS INTEGER) AS id, start, start + length(token) AS "end", token FROM v WHERE pos % 2 = 1
""")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return G.tokens(read(spark, d, "conversations"), ["conv_id", "turn"], "text")


@query(rf"""
WITH m AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', '{G.CUT}\1{G.CUT}', 'g'), '{G.CUT}') AS t FROM conversations), u AS (SELECT conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS pos FROM m),
v AS (SELECT *, CAST(coalesce(sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, lead(token) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS after FROM u)
SELECT conv_id, turn, CAST(pos // 2 + 1 AS INTEGER) AS id, token, after FROM v WHERE pos % 2 = 1 AND start >= 20 AND start + length(token) <= 120
""")
def pair_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens within characters 20 to 120 of a turn, each with what stands between it and the next one."""
    turns = read(spark, d, "conversations")
    rows = G.token_lists(turns, ["conv_id", "turn", "text"], "text").select("*", F.posexplode("spans").alias("pos", "s"))
    end = F.col("s.end").cast("int")
    following = F.coalesce(F.get("spans", F.col("pos") + 1)["start"].cast("int"), F.length("text"))
    after = F.substring("text", end + 1, following - end)
    return rows.where("s.start >= 20 AND s.`end` <= 120").select("conv_id", "turn", (F.col("pos") + 1).alias("id"), F.col("s.text").alias("token"), after.alias("after"))


@query(rf"""
WITH m AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', '{G.CUT}\1{G.CUT}', 'g'), '{G.CUT}') AS t FROM conversations), u AS (SELECT conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS pos FROM m),
v AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u), a AS (SELECT unnest(range(3)) AS anchor)
SELECT conv_id, turn, CAST(anchor AS BIGINT) AS anchor, string_agg(pos // 2 + 1, ',' ORDER BY pos) AS ids, string_agg(token, ' ' ORDER BY pos) AS text FROM v, a WHERE pos % 2 = 1 AND start < anchor * 40 + 25 AND start + length(token) > anchor * 40 + 10 GROUP BY ALL
""")
def word_highlight(spark: SparkSession, d: str) -> DataFrame:
    """The tokens under three anchors of each turn."""
    turns = read(spark, d, "conversations")
    anchors = turns.select("conv_id", "turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("anchor")).withColumns({"from": F.col("anchor") * 40 + 10, "to": F.col("anchor") * 40 + 25})
    rows = G.under_anchors(G.tokens(turns, ["conv_id", "turn"], "text"), anchors, ["conv_id", "turn"])
    return rows.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


# ---- cues ----

_WORDS = "w AS (SELECT user_id AS unit, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id * 400 AS s, event_id * 400 + 300 AS e, event_type || CASE WHEN event_type = 'error' THEN '.' ELSE '' END AS t, event_type = 'error' AS closing FROM events)"


def timed_words(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("event_id") * 400
    return read(spark, d, "events").select(F.col("user_id").alias("unit"), "event_id", ms.alias("s"), (ms + 300).alias("e"), F.concat("event_type", F.when(F.col("event_type") == "error", ".").otherwise("")).alias("t"))


@query(f"""
WITH RECURSIVE {_WORDS}, r AS (
  SELECT unit, i, s AS since, e, closing AND e - s >= 1200 AS closed, 0 AS g, t FROM w WHERE i = 1
  UNION ALL SELECT w.unit, w.i, CASE WHEN r.closed THEN w.s ELSE r.since END, w.e, w.closing AND w.e - CASE WHEN r.closed THEN w.s ELSE r.since END >= 1200, r.g + CAST(r.closed AS INTEGER), w.t FROM r JOIN w ON w.unit = r.unit AND w.i = r.i + 1
), c AS (SELECT unit, g, min(since) AS a, max(e) AS z, bool_or(closed) AS closed, max(g) OVER (PARTITION BY unit) AS top FROM r GROUP BY unit, g),
h AS (SELECT unit, g, CASE WHEN NOT closed AND g > 0 AND z - a < 1200 THEN g - 1 ELSE g END AS cue FROM c)
SELECT r.unit, CAST(h.cue AS INTEGER) AS cue, CAST(min(since) AS BIGINT) AS start_ms, CAST(max(e) AS BIGINT) AS end_ms, string_agg(t, ' ' ORDER BY i) AS text FROM r JOIN h USING (unit, g) GROUP BY r.unit, h.cue
""")
def sentence_cues(spark: SparkSession, d: str) -> DataFrame:
    return G.sentence_cues(timed_words(spark, d), "unit", ["event_id"], "s", "e", "t")


_CUES = "c AS (SELECT o_custkey AS unit, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS cue, o_orderkey * 10 AS start_ms, o_orderkey * 10 + 7 AS end_ms, (o_orderkey + 1) * 12 AS char_end FROM orders)"


def cue_rows(spark: SparkSession, d: str) -> DataFrame:
    cue = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), cue.alias("cue"), (k * 10).alias("start_ms"), (k * 10 + 7).alias("end_ms"), ((k + 1) * 12).alias("char_end"))


def asked_times(spark: SparkSession, d: str, times: int = 8) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("unit"), "event_id", (F.col("event_id") * times).alias("ms"))


@query(f"""
WITH {_CUES}, a AS (SELECT user_id AS unit, event_id, event_id * 8 AS ms FROM events)
SELECT event_id, coalesce((SELECT max(cue) FROM c WHERE c.unit = a.unit AND start_ms <= ms), (SELECT min(cue) FROM c WHERE c.unit = a.unit), -1) AS cue FROM a
""")
def cue_index_at(spark: SparkSession, d: str) -> DataFrame:
    return G.cue_at(asked_times(spark, d), cue_rows(spark, d), "unit", "ms").select("event_id", "cue")


@query(f"""
WITH {_CUES}, a AS (SELECT user_id AS unit, event_id, event_id * 8 AS ms FROM events), f AS (SELECT a.*, (SELECT max(cue) FROM c WHERE c.unit = a.unit AND start_ms <= ms) AS cue FROM a)
SELECT event_id, CASE WHEN ms < c.end_ms THEN c.cue ELSE -1 END AS word FROM f LEFT JOIN c ON c.unit = f.unit AND c.cue = f.cue
""")
def word_index_at(spark: SparkSession, d: str) -> DataFrame:
    return G.word_at(asked_times(spark, d), cue_rows(spark, d).withColumnRenamed("cue", "word"), "unit", "ms").select("event_id", "word")


@query(f"""
WITH {_CUES}, a AS (SELECT user_id AS unit, event_id, event_id * 9 AS ms FROM events)
SELECT event_id, (SELECT min(start_ms) FROM c WHERE c.unit = a.unit AND char_end > ms) AS at_ms FROM a
""")
def citation_time(spark: SparkSession, d: str) -> DataFrame:
    """When the first cue that ends after a character begins."""
    found = G.first_ending_after(asked_times(spark, d, 9), cue_rows(spark, d), "unit", "ms", "char_end", ["start_ms"])
    return found.select("event_id", F.col("start_ms").alias("at_ms"))


@query(f"""
WITH {_CUES}, a AS (SELECT user_id AS unit, event_id, event_id * 8 AS ms FROM events), n AS (SELECT a.*, (SELECT min(cue) FROM c WHERE c.unit = a.unit AND end_ms > ms) AS cue FROM a)
SELECT event_id, n.cue, c.start_ms * 2 AS double_ms FROM n LEFT JOIN c ON c.unit = n.unit AND c.cue = n.cue
""")
def next_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence that ends after a time, and twice its start."""
    found = G.first_ending_after(asked_times(spark, d), cue_rows(spark, d), "unit", "ms", "end_ms", ["cue", "start_ms"])
    return found.select("event_id", "cue", (F.col("start_ms") * 2).alias("double_ms"))


@query(f"""
WITH {_CUES} SELECT unit, count(*) AS cues, CAST(max(end_ms) AS BIGINT) AS total_ms, string_agg('c' || cue, ' ' ORDER BY cue) AS text, string_agg(start_ms || '-' || end_ms, ',' ORDER BY cue) AS map FROM c GROUP BY unit
""")
def synced_import(spark: SparkSession, d: str) -> DataFrame:
    """Cues to a text and its times."""
    parts = F.array_sort(F.collect_list(F.struct("cue", "start_ms", "end_ms")))
    rows = cue_rows(spark, d).groupBy("unit").agg(F.count("*").alias("cues"), F.max("end_ms").alias("total_ms"), parts.alias("p"))
    text = F.array_join(F.transform("p", lambda c: F.concat(F.lit("c"), c["cue"])), " ")
    times = F.array_join(F.transform("p", lambda c: F.concat(c["start_ms"], F.lit("-"), c["end_ms"])), ",")
    return rows.select("unit", "cues", "total_ms", text.alias("text"), times.alias("map"))


@query("""
WITH o AS (SELECT conv_id, turn, text FROM conversations WHERE turn < 6), n AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN text || '!' ELSE text END AS text FROM conversations WHERE turn < 5),
b AS (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.turn, n.turn) AS turn, o.text AS a, n.text AS b FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn),
k AS (SELECT conv_id, coalesce(min(CASE WHEN a IS NULL OR b IS NULL OR a <> b THEN turn END), max(turn) + 1) AS keep, count(a) AS held FROM b GROUP BY 1)
SELECT conv_id, CAST(keep AS BIGINT) AS keep, CAST(greatest(held - keep, 0) AS BIGINT) AS stale FROM k WHERE held > 0
""")
def drop_stale_prefix(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    new = turns.where("turn < 5").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 4 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return G.stale_prefix(turns.where("turn < 6"), new, "conv_id", "turn", "text")


# ---- times ----


@query("""
WITH p AS (SELECT o_custkey AS unit, o_orderkey * 10 AS place, CAST(floor(o_totalprice) AS BIGINT) AS ms FROM orders), a AS (SELECT user_id AS unit, event_id, event_id * 8 AS place FROM events),
x AS (SELECT a.*, (SELECT max(p.place) FROM p WHERE p.unit = a.unit AND p.place <= a.place) AS lo, (SELECT min(p.place) FROM p WHERE p.unit = a.unit AND p.place >= a.place) AS hi FROM a),
y AS (SELECT x.*, coalesce(lo, hi) AS l, coalesce(hi, lo) AS h FROM x)
SELECT event_id, CASE WHEN h > l THEN CAST(floor(b.ms + (c.ms - b.ms)::DOUBLE * (y.place - l) / (h - l) + 0.5) AS BIGINT) ELSE b.ms END AS result_ms FROM y LEFT JOIN p b ON b.unit = y.unit AND b.place = l LEFT JOIN p c ON c.unit = y.unit AND c.place = h
""")
def interpolate_ms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") * 10
    points = read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), k.alias("at"), k.alias("w"), F.floor("o_totalprice").cast("long").alias("ms"))
    asks = read(spark, d, "events").select(F.col("user_id").alias("unit"), "event_id", (F.col("event_id") * 8).alias("at"), (F.col("event_id") * 8).alias("w"))
    return G.interpolated(asks, points, "unit", "at", "w").select("event_id", "result_ms")


_PAIRS = """p AS (SELECT o_custkey AS unit, o_orderkey AS pair, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey * 10 END AS start_ms, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey * 10 + 9 END AS end_ms, o_orderstatus = 'F' AS matched FROM orders),
q AS (SELECT *, start_ms IS NOT NULL AS timed, lead(start_ms IS NOT NULL) OVER (PARTITION BY unit ORDER BY pair) AS follows FROM p), t AS (SELECT unit, max(pair) * 10 + 60 AS total FROM p GROUP BY 1),
a AS (SELECT user_id AS unit, event_id, event_id * 8 AS ms, total FROM events JOIN t ON t.unit = user_id), x AS (SELECT a.*, (SELECT max(pair) FROM q WHERE q.unit = a.unit AND timed AND start_ms <= ms) AS pair FROM a),
f AS (SELECT x.event_id, x.ms, CASE WHEN ms < q.end_ms OR follows OR (follows IS NULL AND ms <= total) THEN q.pair END AS pair FROM x LEFT JOIN q ON q.unit = x.unit AND q.pair = x.pair)"""


def pair_asks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, timed = F.col("o_orderkey"), F.col("o_orderstatus") != "P"
    pairs = read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), k.alias("pair"), F.when(timed, k * 10).alias("start_ms"), F.when(timed, k * 10 + 9).alias("end_ms"), (F.col("o_orderstatus") == "F").alias("matched"))
    total = pairs.groupBy("unit").agg((F.max("pair") * 10 + 60).alias("total"))
    return asked_times(spark, d).join(total, "unit"), pairs


@query(f"WITH {_PAIRS} SELECT event_id, pair FROM f")
def pair_at_time(spark: SparkSession, d: str) -> DataFrame:
    asks, pairs = pair_asks(spark, d)
    return G.pair_at(asks, pairs, "unit", "pair", "ms", "total", ["pair"]).select("event_id", "pair")


@query(f"WITH {_PAIRS} SELECT f.event_id, f.pair, f.pair * 11 AS other_ms FROM f JOIN q ON q.pair = f.pair WHERE q.matched")
def switch_narration(spark: SparkSession, d: str) -> DataFrame:
    """Where the other side's narration goes on: the start of the same matched pair there."""
    asks, pairs = pair_asks(spark, d)
    found = G.pair_at(asks, pairs, "unit", "pair", "ms", "total", ["pair", "matched"]).where("matched")
    return found.select("event_id", "pair", (F.col("pair") * 11).alias("other_ms"))


@query("""
WITH s AS (SELECT l_suppkey AS unit, l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS a, max(l_partkey + CAST(l_quantity AS BIGINT)) AS z FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
t AS (SELECT DISTINCT l_suppkey AS unit, l_partkey AS a, l_partkey + 3 AS z, l_partkey * 2 AS ta, l_partkey * 2 + 5 AS tz FROM lineitem WHERE l_linestatus = 'O')
SELECT s.unit, s.id, min(ta) AS to_start, max(tz) AS to_end FROM s JOIN t ON t.unit = s.unit AND t.a < s.z AND s.a < t.z GROUP BY 1, 2
""")
def map_span(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem")
    spans = items.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_partkey").alias("start"), F.max(F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    p = F.col("l_partkey")
    words = items.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("unit"), p.alias("start"), (p + 3).alias("end"), (p * 2).alias("to_start"), (p * 2 + 5).alias("to_end")).distinct()
    return G.mapped_spans(spans, words, "unit")


# ---- small text rules ----


@query("""
WITH u AS (SELECT p_partkey, p_name AS t, list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT)) AS c FROM part)
SELECT p_partkey, len(c) || '-' || lower(hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), c), lambda h, x: CAST((xor(h, x) * 16777619) % 4294967296 AS BIGINT)))) AS fingerprint FROM u
""")
def fingerprint_fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", G.fingerprint(F.col("p_name")).alias("fingerprint"))


@query(r"""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS title FROM conversations GROUP BY 1), t AS (SELECT c.conv_id, turn, regexp_replace(lower(title[1:12]), '[^\p{L}\p{N}]+', '', 'g') AS a, regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', '', 'g') AS b FROM conversations c JOIN f USING (conv_id))
SELECT conv_id, turn, a <> '' AND b <> '' AND (starts_with(b, a) OR starts_with(a, b)) AS repeats FROM t
""")
def title_repeats(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    titles = turns.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 12).alias("title"))
    return turns.join(titles, "conv_id").select("conv_id", "turn", G.title_repeats(F.col("title"), F.col("text")).alias("repeats"))


_COUNTED = ", ".join(f"CAST(len(list_filter(w, lambda x: regexp_matches(x, '\\p{{{s}}}'))) AS INTEGER) AS n{i}" for i, s in enumerate(G.SCRIPTS))


@query(rf"""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), n AS (SELECT doc_id, {_COUNTED} FROM w)
SELECT doc_id, CASE WHEN greatest(n0, n1, n2, n3, n4, n5) = 0 THEN NULL {" ".join(f"WHEN n{i} = greatest(n0, n1, n2, n3, n4, n5) THEN '{s}'" for i, s in enumerate(G.SCRIPTS))} END AS script FROM n
""")
def dominant_script(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", G.dominant_script(F.split("text", " ")).alias("script"))


@query(r"""
WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Scanner Pro ' WHEN 1 THEN 'C:\books\' || lang WHEN 2 THEN left(text, 130) ELSE trim(left(text, 20)) END AS author FROM documents)
SELECT doc_id, CASE WHEN length(trim(author)) BETWEEN 2 AND 120 AND NOT regexp_matches(trim(author), '(?i)^(user|admin|owner|unknown|author|microsoft|adobe|acrobat|word|pdf|scanner|hp|canon|epson|xerox)\b') AND NOT regexp_matches(trim(author), '[\\/]') AND NOT regexp_matches(trim(author), '(?i)\.pdf$') THEN trim(author) END AS author FROM a
""")
def author_clean(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    author = F.when(kind == 0, " Scanner Pro ").when(kind == 1, F.concat(F.lit("C:\\books\\"), "lang")).when(kind == 2, F.substring("text", 1, 130)).otherwise(F.trim(F.substring("text", 1, 20)))
    return read(spark, d, "documents").select("doc_id", G.clean_author(author).alias("author"))
