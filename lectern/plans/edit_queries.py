"""Queries over what stays valid after an edit, each with its SQL.

Conversations stand for books and pages, turns for blocks, orders for the pairs of a customer's chapter, and for groups of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import reading as G
from ..streaming.clicks import clicks
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str):
    def register(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query(r"""
WITH r AS (SELECT page_id, CASE WHEN page_id % 5 > 0 THEN url END AS referer, url || CASE WHEN page_id % 3 = 0 THEN '?a=1&from=mail%20' || (page_id % 7) WHEN page_id % 3 = 1 THEN '?from=' ELSE '' END AS url, CASE WHEN page_id % 2 = 0 THEN 'BG' END AS country, left(html, 9) AS agent FROM (SELECT page_id, regexp_replace(url, '[?#].*', '') AS url, html FROM pages) WHERE page_id % 4 > 0)
SELECT page_id, coalesce(country, '??') AS country, CASE page_id % 3 WHEN 0 THEN 'mail ' || (page_id % 7) WHEN 1 THEN '' ELSE coalesce(referer, '') END AS source, coalesce(agent, '') AS agent FROM r
""")
def click_events(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    tail = F.when(n % 3 == 0, F.concat(F.lit("?a=1&from=mail%20"), (n % 7).cast("string"))).when(n % 3 == 1, "?from=").otherwise("")
    pages = read(spark, d, "pages").withColumn("url", F.regexp_replace("url", "[?#].*", ""))
    requests = pages.select("page_id", F.when(n % 4 > 0, "GET").otherwise("HEAD").alias("method"), F.concat("url", tail).alias("url"), F.when(n % 5 > 0, F.col("url")).alias("referer"), F.when(n % 2 == 0, "BG").alias("country"), F.substring("html", 1, 9).alias("agent"))
    return clicks(requests)


@query(r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, text, least(length(text), 160) AS z, CASE WHEN turn % 4 = 1 THEN list_reverse(string_split(substr(text, 21, 140), ' ')) ELSE string_split(substr(text, 21, 140), ' ') END AS words, CAST((conv_id + turn) % 9 - 1 AS INTEGER) AS number FROM conversations),
r AS (SELECT conv_id, turn, -1 AS i, 20 AS a, 20 AS z FROM t
  UNION ALL SELECT conv_id, turn, i + 1, r.z + pt - 1, r.z + pt - 1 + length(word) FROM r JOIN t USING (conv_id, turn), LATERAL (SELECT t.words[i + 2] AS word) x, LATERAL (SELECT strpos(substr(t.text, r.z + 1), word) AS pt) y WHERE i < number AND i + 2 <= len(t.words) AND length(word) > 0 AND pt > 0 AND r.z + pt - 1 + length(word) <= t.z)
SELECT t.conv_id, t.turn, CAST(r.a AS BIGINT) AS start, CAST(r.z AS BIGINT) AS "end" FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn AND r.i = t.number AND t.number >= 0
""")
def transcript_word_range(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.substring("text", 21, 140), " ")
    words = F.when(F.col("turn") % 4 == 1, F.reverse(words)).otherwise(words)
    place = E.word_range(F.col("text"), F.lit(20), F.least(F.length("text"), F.lit(160)), words, ((F.col("conv_id") + F.col("turn")) % 9 - 1).cast("int"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", place.alias("at"))
    return rows.select("conv_id", "turn", F.col("at.start").cast("long").alias("start"), F.col("at.end").cast("long").alias("end"))


_WORDS = rf"""m AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', '{G.CUT}\1{G.CUT}', 'g'), '{G.CUT}') AS t FROM conversations), u AS (SELECT conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS pos FROM m),
v AS (SELECT *, CAST(coalesce(sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM u), w AS (SELECT conv_id, turn, a, a + length(token) AS z FROM v WHERE pos % 2 = 1)"""


@query(rf"""
WITH {_WORDS}, j AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS q, count(*) OVER (PARTITION BY conv_id) AS m,
  CASE WHEN turn = 1 THEN regexp_replace(text, '^[^ ]* ', '') WHEN turn = 2 THEN text || 'ing' ELSE text END AS text FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 0)),
o AS (SELECT conv_id, turn, text AS was, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
b AS (SELECT j.conv_id, j.turn, j.text, o.turn AS old, was, regexp_extract(was, '(?s)^(.* )', 1) AS hw, regexp_extract(j.text, '(?s)^(.* )', 1) AS hn FROM j JOIN o ON o.conv_id = j.conv_id AND o.p = j.q + n - m),
g AS (SELECT *, CASE WHEN ends_with(was, text) THEN length(was) - length(text) WHEN ends_with(hw, hn) THEN length(hw) - length(hn) ELSE 0 END AS gone FROM b)
SELECT g.conv_id, g.turn, sha256(text) AS digest, coalesce(string_agg(greatest(0, a - gone) || '-' || CASE WHEN z = length(was) THEN length(text) ELSE least(length(text), z - gone) END, ',' ORDER BY a), '') AS words
FROM g LEFT JOIN w ON w.conv_id = g.conv_id AND w.turn = g.old AND z > gone GROUP BY g.conv_id, g.turn, text
""")
def reconcile_blocks(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    spans = G.tokens(turns, ["conv_id", "turn"], "text").groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("words"))
    old = turns.select("conv_id", "turn", "text").join(spans, ["conv_id", "turn"], "left")
    text = F.when(F.col("turn") == 1, F.regexp_replace("text", "^[^ ]* ", "")).when(F.col("turn") == 2, F.concat("text", F.lit("ing"))).otherwise(F.col("text"))
    joined = turns.where("NOT (conv_id % 3 = 0 AND turn = 0)").select("conv_id", "turn", text.alias("text"))
    rows = E.shifted_words(old, joined, "conv_id", "turn", "text", "words")
    spans = F.array_join(F.transform("words", lambda w: F.concat_ws("-", w["start"].cast("string"), w["end"].cast("string"))), ",")
    return rows.select("conv_id", "turn", F.sha2("text", 256).alias("digest"), spans.alias("words"))


_SAID = """CASE o_orderkey % 23 WHEN 0 THEN '-' WHEN 1 THEN '1=2=3' WHEN 2 THEN ' = 1' WHEN 3 THEN '4 5 = -' WHEN 4 THEN '9 = 1' WHEN 5 THEN '' WHEN 6 THEN '- = 2' WHEN 7 THEN 'x = 1' ELSE '1, 2 2 = ' || (o_orderkey % 3 + 1) END"""


@query(rf"""
WITH k AS (SELECT o_custkey, o_orderkey, 'p' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pair, {_SAID} AS said FROM orders),
bad AS (SELECT DISTINCT o_custkey FROM k WHERE o_custkey % 11 = 3),
l AS (SELECT o_custkey, pair, 1 AS n, trim(said) AS said FROM k WHERE o_orderkey % 29 > 0 UNION ALL SELECT o_custkey, pair, 2, '2 = 3,1' FROM k WHERE o_orderkey % 2 = 0 AND o_orderkey % 29 > 0),
e AS (SELECT o_custkey, pair, n, CASE WHEN said IN ('-', '4 5 = -', '- = 2') OR regexp_matches(said, '^(1, 2 2|2) = [123](,1)?$') THEN NULL WHEN said = '' THEN 'no answer' WHEN said = '1=2=3' THEN 'form' WHEN said = '= 1' THEN 'empty side' ELSE 'token' END AS error,
  CASE WHEN said LIKE '1, 2 2 = %' THEN '1,2=' || right(said, 1) WHEN said = '2 = 3,1' THEN '2=3,1' END AS link FROM l),
g AS (SELECT o_custkey, pair, arg_min(error, n) FILTER (WHERE error IS NOT NULL) AS error, coalesce(string_agg(link, ';' ORDER BY n), '') AS links FROM e GROUP BY ALL),
a AS (SELECT k.o_custkey, k.pair, CASE WHEN k.o_custkey IN (FROM bad) THEN 'unknown pair' WHEN g.pair IS NULL THEN 'missing' ELSE error END AS error, links FROM k LEFT JOIN g ON g.o_custkey = k.o_custkey AND g.pair = k.pair)
SELECT o_custkey AS unit, pair, error, CASE WHEN error IS NULL THEN links END AS links FROM a
""")
def parse_links(spark: SparkSession, d: str) -> DataFrame:
    """Responses of a few lines a pair; some lines break the grammar, and every eleventh response names an unknown pair."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), "o_orderkey", F.concat(F.lit("p"), number.cast("string")).alias("pair"), F.expr(_SAID).alias("said"))
    line = F.concat("pair", F.lit(": "), "said", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\n\n  "), "pair", F.lit(":2 = 3,1 "))).otherwise(""))
    told = F.array_join(F.sort_array(F.collect_list(F.when(F.col("o_orderkey") % 29 > 0, F.struct("o_orderkey", line.alias("line")))))["line"], "\n")
    responses = rows.groupBy("unit").agg(told.alias("told")).select("unit", F.concat("told", F.when(F.col("unit") % 11 == 3, "\np0: -").otherwise("")).alias("raw"))
    pairs = rows.select("unit", "pair", F.array(F.lit(1), F.lit(2), F.lit(4)).alias("source"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("target"))
    found = E.parsed_links(responses, pairs, "unit")
    side = lambda x: F.array_join(x.cast("array<string>"), ",")
    return found.select("unit", "pair", "error", F.array_join(F.transform("links", lambda x: F.concat(side(x["source"]), F.lit("="), side(x["target"]))), ";").alias("links"))


_KIND = "CASE o_orderkey * 7919 % 1009 % 8 WHEN 0 THEN 'prose' WHEN 1 THEN 'heading' WHEN 2 THEN 'metadata' WHEN 3 THEN 'furniture' WHEN 4 THEN 'prose' ELSE 'verse' END"
_SECTION = "(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 3 - CASE WHEN o_orderkey % 19 = 0 THEN 3 ELSE 0 END) % 1000"
_BREAK = "CASE WHEN o_orderkey % 5 > 1 THEN 'line' ELSE 'paragraph' END"


@query(f"""
WITH RECURSIVE g AS (SELECT o_custkey AS unit, o_orderkey AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, {_KIND} AS kind, CAST(floor(({_SECTION}) / 6) AS INTEGER) AS section, {_BREAK} AS breaks FROM orders),
r AS (SELECT unit, CAST(0 AS BIGINT) AS i, -1 AS sec, false AS meta, NULL::VARCHAR AS fault, NULL::VARCHAR AS before FROM g WHERE i = 1
  UNION ALL SELECT g.unit, g.i, CASE WHEN kind = 'furniture' THEN sec ELSE section END,
    CASE WHEN kind = 'furniture' THEN meta WHEN kind = 'metadata' THEN true WHEN kind = 'heading' OR section <> sec THEN false WHEN kind = 'verse' AND before = 'prose' AND breaks = 'paragraph' THEN false ELSE meta END,
    CASE WHEN fault IS NOT NULL THEN 'old' WHEN kind = 'furniture' THEN NULL WHEN section < sec THEN 'earlier section' WHEN kind = 'verse' AND meta AND section = sec AND NOT (coalesce(before, '') = 'prose' AND breaks = 'paragraph') THEN 'metadata in verse' END, kind
  FROM r JOIN g ON g.unit = r.unit AND g.i = r.i + 1)
SELECT unit, place, CASE WHEN breaks = 'line' AND NOT coalesce(kind = 'verse' AND p.before = 'verse' AND p.was = section, false) THEN 'paragraph' ELSE breaks END AS break_before, nullif(fault, 'old') AS fault
FROM (SELECT *, lag(kind) OVER (PARTITION BY unit ORDER BY i) AS before, lag(section) OVER (PARTITION BY unit ORDER BY i) AS was FROM g) p JOIN (SELECT unit, i, fault FROM r) f USING (unit, i)
""")
def validate_semantic(spark: SparkSession, d: str) -> DataFrame:
    groups = read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("place"), F.expr(_KIND).alias("kind"), F.floor(F.expr(_SECTION) / 6).cast("int").alias("section"), F.expr(_BREAK).alias("breaks"))
    return E.semantic_order(groups, "unit", "place").select("unit", "place", "break_before", "fault")


@query(r"""
WITH RECURSIVE b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, CASE WHEN conv_id % 2 = 0 THEN role ELSE regexp_replace(text, '\s+', '', 'g') END AS t, CASE WHEN conv_id % 2 = 0 THEN NULL ELSE turn // 4 END AS page, role <> 'system' AS included FROM conversations),
s AS (SELECT conv_id, turn // 2 AS chapter, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1 AS j, t, page + CASE WHEN turn % 5 = 3 THEN 1 ELSE 0 END AS page, CASE WHEN turn % 3 > 0 THEN included END AS included FROM b),
c AS (SELECT conv_id, chapter, count(*) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY chapter) AS k FROM s GROUP BY conv_id, chapter),
f AS (SELECT c.*, CAST((SELECT list(b.i ORDER BY b.i) FROM b WHERE b.conv_id = c.conv_id AND (SELECT count(*) FROM s JOIN b x ON x.conv_id = s.conv_id AND x.i = b.i + s.j AND x.t = s.t AND x.page IS NOT DISTINCT FROM s.page AND coalesce(x.included = s.included, true) WHERE s.conv_id = c.conv_id AND s.chapter = c.chapter) = c.size) AS BIGINT[]) AS starts FROM c),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS cursor, NULL::BIGINT AS start FROM f WHERE k = 1
  UNION ALL SELECT r.conv_id, f.k, coalesce(pt + size, cursor), pt FROM r JOIN f ON f.conv_id = r.conv_id AND f.k = r.k + 1, LATERAL (SELECT coalesce(list_min(list_filter(f.starts, lambda x: x >= r.cursor)), f.starts[1]) AS pt) y)
SELECT conv_id, chapter, start, start + size AS "end" FROM f JOIN (SELECT conv_id, k, start FROM r) p USING (conv_id, k)
""")
def locate_saved(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of two turns; even conversations repeat their texts, and some saved pages have changed."""
    even, turn = F.col("conv_id") % 2 == 0, F.col("turn")
    blocks = read(spark, d, "conversations").select("conv_id", "turn", F.when(even, F.col("role")).otherwise(F.col("text")).alias("text"), F.when(~even, F.floor(turn / 4)).alias("page"), (F.col("role") != "system").alias("included"))
    saved = blocks.select("conv_id", "turn", F.floor(turn / 2).alias("chapter"), F.concat(F.lit(" "), "text").alias("text"), (F.col("page") + F.when(turn % 5 == 3, 1).otherwise(0)).alias("page"), F.when(turn % 3 > 0, F.col("included")).alias("included"))
    rows = E.located_chapters(blocks, saved, "conv_id", "chapter", "turn")
    return rows.select("conv_id", "chapter", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(rf"""
WITH {_WORDS}, n AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations), ch AS (SELECT conv_id, turn, text, k, 60 * k AS a, least(60 * k + 55, n) AS z FROM n, range(0, 4) x(k) WHERE 60 * k < n AND (turn + k) % 4 < 3),
cw AS (SELECT ch.conv_id, ch.turn, ch.k, w.a, w.z, w.a * 70 + 5 AS ams, w.z * 70 - 3 AS zms FROM ch JOIN w ON w.conv_id = ch.conv_id AND w.turn = ch.turn AND w.a >= ch.a AND w.z <= ch.z WHERE (w.a + ch.turn) % 3 = 0),
sp AS (SELECT conv_id, turn, text, i, 36 * i AS a, 36 * i + 25 AS z, regexp_matches(substr(text, 36 * i + 1, 25), '[\p{{L}}\p{{N}}]') AS spoken FROM n, range(0, 5) x(i)),
e AS (SELECT *, 0 AS side, a AS pt FROM sp UNION ALL SELECT *, 1, z FROM sp),
f AS (SELECT e.*, CASE WHEN NOT spoken THEN NULL WHEN side = 0 THEN coalesce((SELECT min(k) FROM ch WHERE ch.conv_id = e.conv_id AND ch.turn = e.turn AND ch.a <= pt AND pt < ch.z), (SELECT min(k) FROM ch WHERE ch.conv_id = e.conv_id AND ch.turn = e.turn AND ch.a >= pt AND NOT regexp_matches(substr(ch.text, CAST(pt + 1 AS BIGINT), CAST(ch.a - pt AS BIGINT)), '[\p{{L}}\p{{N}}]')))
  ELSE coalesce((SELECT min(k) FROM ch WHERE ch.conv_id = e.conv_id AND ch.turn = e.turn AND ch.a < pt AND pt <= ch.z), (SELECT max(k) FROM ch WHERE ch.conv_id = e.conv_id AND ch.turn = e.turn AND ch.z <= pt AND NOT regexp_matches(substr(ch.text, CAST(ch.z + 1 AS BIGINT), CAST(pt - ch.z AS BIGINT)), '[\p{{L}}\p{{N}}]'))) END AS k FROM e),
h AS (SELECT f.*, ch.a AS ca, ch.z AS cz FROM f LEFT JOIN ch USING (conv_id, turn, k)),
ws AS (SELECT h.conv_id, h.turn, i, side, CASE WHEN side = 0 THEN arg_min(ams, cw.a) ELSE arg_max(zms, cw.a) END AS ms FROM h JOIN cw ON cw.conv_id = h.conv_id AND cw.turn = h.turn AND cw.k = h.k
  WHERE CASE WHEN side = 0 THEN cw.z > pt AND NOT regexp_matches(substr(text, CAST(pt + 1 AS BIGINT), CAST(greatest(pt, cw.a) - pt AS BIGINT)), '[\p{{L}}\p{{N}}]') ELSE cw.a < pt AND NOT regexp_matches(substr(text, CAST(least(pt, cw.z) + 1 AS BIGINT), CAST(pt - least(pt, cw.z) AS BIGINT)), '[\p{{L}}\p{{N}}]') END GROUP BY h.conv_id, h.turn, i, side),
p AS (SELECT conv_id, turn, k, a AS p, a * 70 AS ms, -1 AS o FROM ch UNION ALL SELECT conv_id, turn, k, z, z * 70 + 40, 1000000 FROM ch UNION ALL SELECT conv_id, turn, k, a, ams, a * 2 FROM cw UNION ALL SELECT conv_id, turn, k, z, zms, z * 2 - 1 FROM cw),
lo AS (SELECT h.conv_id, h.turn, i, side, arg_max(p, o) AS p, arg_max(ms, o) AS ms FROM h JOIN p USING (conv_id, turn, k) WHERE p <= pt GROUP BY ALL), hi AS (SELECT h.conv_id, h.turn, i, side, arg_min(p, o) AS p, arg_min(ms, o) AS ms FROM h JOIN p USING (conv_id, turn, k) WHERE p >= pt GROUP BY ALL),
x AS (SELECT h.conv_id, h.turn, h.i, h.side, k, pt, ca, cz, text, ws.ms AS word, lo.p AS lp, lo.ms AS lms, hi.p AS hp, hi.ms AS hms,
  length(regexp_replace(substr(text, CAST(lo.p + 1 AS BIGINT), CAST(hi.p - lo.p AS BIGINT)), '\s', '', 'g')) AS span, length(regexp_replace(substr(text, CAST(lo.p + 1 AS BIGINT), CAST(pt - lo.p AS BIGINT)), '\s', '', 'g')) AS part
  FROM h LEFT JOIN ws USING (conv_id, turn, i, side) LEFT JOIN lo USING (conv_id, turn, i, side) LEFT JOIN hi USING (conv_id, turn, i, side)),
y AS (SELECT *, CASE WHEN k IS NULL THEN 'unavailable' WHEN side = 1 AND (pt >= cz OR NOT regexp_matches(substr(text, CAST(pt + 1 AS BIGINT), CAST(cz - pt AS BIGINT)), '[\p{{L}}\p{{N}}]')) THEN 'chunk-boundary' WHEN word IS NOT NULL THEN 'provider-word'
  WHEN side = 0 AND (ca <= pt AND NOT regexp_matches(substr(text, CAST(ca + 1 AS BIGINT), CAST(pt - ca AS BIGINT)), '[\p{{L}}\p{{N}}]')) THEN 'chunk-boundary' ELSE 'interpolated' END AS how FROM x),
z AS (SELECT *, CAST(CASE how WHEN 'chunk-boundary' THEN CASE side WHEN 0 THEN ca * 70 ELSE cz * 70 + 40 END WHEN 'provider-word' THEN word WHEN 'interpolated' THEN CASE WHEN span > 0 THEN floor(lms + (hms - lms) * part / span + 0.5) ELSE lms END END AS BIGINT) AS ms FROM y)
SELECT conv_id, turn, i, max(ms) FILTER (WHERE side = 0) AS start_ms, max(how) FILTER (WHERE side = 0) AS start_by, max(ms) FILTER (WHERE side = 1) AS end_ms, max(how) FILTER (WHERE side = 1) AS end_by FROM z GROUP BY conv_id, turn, i
""")
def span_timing(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 55 characters with a gap after each and one in four lost; a third of their words have times of their own."""
    turns = read(spark, d, "conversations")
    each = turns.select("conv_id", "turn", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).where("60 * k < n AND (turn + k) % 4 < 3")
    chunks = each.withColumns({"start": F.col("k") * 60, "end": F.least(F.col("k") * 60 + 55, F.col("n"))})
    words = G.tokens(turns, ["conv_id", "turn"], "text").where("(start + turn) % 3 = 0").select("conv_id", "turn", F.struct("start", "end", (F.col("start") * 70 + 5).alias("start_ms"), (F.col("end") * 70 - 3).alias("end_ms")).alias("w"))
    inside = (F.col("w.start") >= F.col("start")) & (F.col("w.end") <= F.col("end"))
    met = chunks.join(words, ["conv_id", "turn"], "left").groupBy("conv_id", "turn", "start", "end").agg(F.sort_array(F.collect_list(F.when(inside, F.col("w")))).alias("words"))
    chunk = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("start") * 70).cast("long").alias("start_ms"), (F.col("end") * 70 + 40).cast("long").alias("end_ms"), "words")
    lists = met.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    key = F.struct("conv_id", "turn").alias("unit")
    lanes = turns.join(lists, ["conv_id", "turn"], "left").select(key, "text", "chunks")
    i = F.col("i").cast("int")
    spans = turns.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("i")).withColumns({"start": i * 36, "end": i * 36 + 25})
    return E.edge_times(spans, lanes, "unit").select("unit.conv_id", "unit.turn", "i", "start_ms", "start_by", "end_ms", "end_by")
