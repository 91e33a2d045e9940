"""Queries over edited texts, placed blocks and cues, and layout trees, each with its SQL where SQL can express it.

The turns of a conversation stand for chapters, blocks and pages; what an edit changed, and where words stand, is made from them by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edited, placing
from ..sources import layout
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Words of a text whose blanks are single: word, start and end, and the span from first to last letter or digit.
WORDS_SQL = r"""split AS (SELECT *, string_split_regex(t, '[ \n]') AS ws FROM texts),
spots AS (SELECT * EXCLUDE (ws), unnest(ws) AS word, unnest(range(len(ws))) AS i, unnest(list_transform(range(len(ws)), lambda k: CAST(len(array_to_string(ws[1:k], ' ')) + CASE WHEN k > 0 THEN 1 ELSE 0 END AS INTEGER))) AS pos FROM split),
words AS (SELECT *, CAST(pos + length(word) - length(regexp_replace(word, '^[^\p{L}\p{N}]+', '')) AS INTEGER) AS s, CAST(pos + length(regexp_replace(word, '[^\p{L}\p{N}]+$', '')) AS INTEGER) AS e FROM spots WHERE regexp_matches(word, '[\p{L}\p{N}]'))"""


@query(rf"""
WITH texts AS (SELECT conv_id, turn, text AS t FROM conversations), {WORDS_SQL}, n AS (SELECT conv_id, turn, count(*) AS m FROM words GROUP BY ALL),
kept AS (SELECT conv_id, turn, m, round(m / (m + 2), 9) AS fit FROM n WHERE floor(round(2 * m + 2 - 1.2 * (m + 2), 9)) >= 2)
SELECT conv_id, turn, fit, CAST(0 AS INTEGER) AS start, CAST(5 AS INTEGER) AS "end", CAST(NULL AS INTEGER) AS to_start, CAST(NULL AS INTEGER) AS to_end FROM kept
UNION ALL SELECT conv_id, turn, fit, 6, 10, NULL, NULL FROM kept
UNION ALL SELECT conv_id, turn, fit, s + 11, e + 11, s, e FROM words JOIN kept USING (conv_id, turn)
""")
def align_texts_diff(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with other punctuation and two words typed in before it: where its words stand in the original."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text", F.concat(F.lit("Zzyzx qwrt "), F.translate("text", ".,", "!;")).alias("edited"))
    out = edited.edit_alignment(turns, ["conv_id", "turn"], "edited", "text").where("fit IS NOT NULL")
    return out.select("conv_id", "turn", F.round("fit", 9).alias("fit"), F.explode("edited_words").alias("w")).select("conv_id", "turn", "fit", "w.*")


def _line_spans(text: Column) -> Column:
    """The lines of a text as typed blocks: verse and notes in turn."""
    lines = F.split(text, "\n")
    start = F.transform(lines, lambda _, i: F.length(F.array_join(F.slice(lines, 1, i), "\n")) + F.when(i > 0, 1).otherwise(0))
    kind = lambda i: F.when(i % 2 == 0, "verse").otherwise("note")
    return F.transform(lines, lambda x, i: F.struct(start[i].alias("start"), (start[i] + F.length(x)).alias("end"), kind(i).alias("kind"), F.lit(None).cast("string").alias("break_before")))


@query(rf"""
WITH texts AS (SELECT conv_id, turn, text AS t FROM conversations), {WORDS_SQL}, n AS (SELECT conv_id, turn, count(*) AS m FROM words GROUP BY ALL),
kept AS (SELECT conv_id, turn, rtrim(t, chr(10) || ' ') AS t FROM n JOIN texts USING (conv_id, turn) WHERE floor(round(2 * m + 2 - 1.2 * (m + 2), 9)) >= 2),
cut AS (SELECT conv_id, turn, string_split(t, chr(10)) AS l FROM kept),
lines AS (SELECT conv_id, turn, unnest(l) AS line, unnest(range(len(l))) AS i, unnest(list_transform(range(len(l)), lambda k: len(array_to_string(l[1:k], ' ')) + CASE WHEN k > 0 THEN 1 ELSE 0 END)) AS pos FROM cut)
SELECT conv_id, turn, CAST(0 AS INTEGER) AS start, CAST(10 AS INTEGER) AS "end", 'prose' AS kind, 'Zzyzx qwrt' AS text FROM kept
UNION ALL SELECT conv_id, turn, CAST(12 + pos AS INTEGER), CAST(12 + pos + length(line) AS INTEGER), CASE WHEN i % 2 = 0 THEN 'verse' ELSE 'note' END, line FROM lines WHERE regexp_matches(line, '[\p{{L}}\p{{N}}]')
""")
def reader_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The typed lines of each turn after a paragraph was typed in before them: blocks over all of the edited text."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text", F.concat(F.lit("Zzyzx qwrt\n\n"), "text").alias("edited"), _line_spans(F.col("text")).alias("spans"))
    out = edited.reader_blocks(turns, ["conv_id", "turn"], "edited", "text", "spans").where("blocks IS NOT NULL")
    rows = out.select("conv_id", "turn", "text", F.explode("blocks").alias("b"))
    return rows.select("conv_id", "turn", "b.start", "b.end", "b.kind", F.substring("text", F.col("b.start") + 1, F.col("b.end") - F.col("b.start")).alias("text"))


def _seen_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of each conversation as a recogniser might give them: ten units a letter, a line a turn, every seventh word misread."""
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("page"), "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "word"))
    misread = F.when(F.col("i") % 7 == 3, F.concat(F.expr("left(word, length(word) - 1)"), F.lit("x"))).otherwise(F.col("word"))
    x = (F.col("i") * 200).cast("double")
    return turns.select("page", (F.col("turn") * 100000 + F.col("i")).alias("word"), misread.alias("text"), F.col("turn").cast("int").alias("line"), x.alias("x0"), (F.col("turn") * 30.0).alias("y0"), (x + F.length("word") * 10.0).alias("x1"), (F.col("turn") * 30.0 + 20).alias("y1"))


@query()
def place_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a block on its conversation's page of recognised words: its box, how many words were found, and which with doubt."""
    blocks = read(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("block"), "text")
    return placing.block_boxes(placing.place_blocks(blocks, _seen_words(spark, d), "page"), "page")


@query(r"""
WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations), lines AS (SELECT conv_id, turn, unnest(l) AS line, unnest(range(len(l))) AS i FROM t),
w AS (SELECT *, string_split(line, ' ') AS ws FROM lines), c AS (SELECT *, array_to_string(ws[2:4], ' ') AS cue, length(ws[1]) + 1 AS s FROM w WHERE len(ws) > 1),
f AS (SELECT *, s + length(cue) - length(regexp_replace(cue, '^[^\p{L}\p{N}]+', '')) AS a, s + length(regexp_replace(cue, '[^\p{L}\p{N}]+$', '')) AS b FROM c WHERE regexp_matches(cue, '[\p{L}\p{N}]'))
SELECT conv_id, CAST(turn * 1000 + i AS BIGINT) AS cue, CAST(turn AS INTEGER) AS page, CAST(least(10000, a * 10) AS INTEGER) AS x, CAST(least(10000, i * 30) AS INTEGER) AS y,
  CAST(least(10000, b * 10) - least(10000, a * 10) AS INTEGER) AS w, CAST(least(10000, i * 30 + 20) - least(10000, i * 30) AS INTEGER) AS h FROM f
""")
def rects_for_range(spark: SparkSession, d: str) -> DataFrame:
    """Words two to four of every line of a turn, on a page where a letter is ten units wide and a line thirty high: their rectangle."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    base = F.col("turn") * 100_000  # where the turn's text begins in the conversation's
    blocks = turns.select(
        "conv_id", F.col("turn").alias("block"), base.alias("start"), (base + F.length("text")).alias("end"), "text", F.col("turn").cast("int").alias("page"),
        F.array(F.lit(0.0), F.lit(0.0), F.lit(1e9), F.lit(1e9)).alias("box"),
    )
    spans = turns.select("conv_id", "turn", "text", F.posexplode(_line_spans(F.col("text"))).alias("line", "s"))
    spans = spans.withColumn("body", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    y = F.col("line") * 30.0
    lines = spans.select("conv_id", F.col("turn").cast("int").alias("page"), "line", F.col("body").alias("text"), F.array(F.lit(0.0), y, F.length("body") * 10.0, y + 20).alias("box"), F.transform(F.sequence(F.lit(0), F.length("body")), lambda i: i * 10.0).alias("edges"))
    words = F.split("body", " ")
    part = F.array_join(F.slice(words, 2, 3), " ")
    start = F.col("turn") * 100_000 + F.col("s.start") + F.length(words[0]) + 1
    cues = spans.where(F.size(words) > 1).select("conv_id", (F.col("turn") * 1000 + F.col("line")).alias("cue"), start.alias("start"), (start + F.length(part)).alias("end"), part.alias("said")).where(F.col("said").rlike(r"[\p{L}\p{N}]"))
    pages = turns.select("conv_id", F.col("turn").cast("int").alias("page"), F.lit(10000.0).alias("width"), F.lit(10000.0).alias("height"))
    out = placing.cue_rects(cues, blocks, lines, pages, "conv_id")
    return out.select("conv_id", "cue", F.explode("rects").alias("r")).select("conv_id", "cue", "r.*")


@query(r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Zzyzx qwrt ' || text END AS now, text AS old, string_split(text, chr(10)) AS l FROM conversations),
c AS (SELECT conv_id, turn, now, old, unnest(l) AS line, unnest(range(len(l))) AS i, unnest(list_transform(range(len(l)), lambda k: len(array_to_string(l[1:k], ' ')) + CASE WHEN k > 0 THEN 1 ELSE 0 END)) AS pos FROM t),
m AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '[ \n]'), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) AS m FROM conversations)
SELECT conv_id, turn, CAST(i AS INTEGER) AS cue, CAST(CASE WHEN now IS NULL THEN pos ELSE pos + length(line) - length(regexp_replace(line, '^[^\p{L}\p{N}]+', '')) END AS INTEGER) AS start,
  CAST(CASE WHEN now IS NULL THEN pos + length(line) ELSE pos + length(regexp_replace(line, '[^\p{L}\p{N}]+$', '')) END AS INTEGER) AS "end"
FROM c JOIN m USING (conv_id, turn) WHERE regexp_matches(line, '[\p{L}\p{N}]') AND (now IS NULL OR floor(round(2 * m + 2 - 1.2 * (m + 2), 9)) >= 2)
""")
def place_cues(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each turn as spoken cues, every second turn edited before it was spoken: where they stand in the original."""
    now = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Zzyzx qwrt "), "text"))
    turns = read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("unit"), now.alias("edited"), F.col("text").alias("original"), F.split("text", "\n").alias("cues"))
    return placing.placed_cues(turns, "unit", "edited", "original", "cues").select("unit.*", "cue", "start", "end")


def _trees(spark: SparkSession, d: str) -> DataFrame:
    """A layout tree of each conversation: a page a turn, a leaf a line, every second leaf within two groups."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    kind = F.when(F.col("i") == 0, "SectionHeader").when(F.col("i") % 5 == 4, "PageFooter").otherwise("Text")
    tag = F.when(F.col("i") == 0, "h2").otherwise("p")
    html = F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">"))
    leaf = F.to_json(F.struct(kind.alias("block_type"), html.alias("html")))
    group = lambda c: F.concat(F.lit('{"block_type":"ListGroup","children":['), c, F.lit("]}"))
    lines = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    blocks = lines.select("conv_id", "turn", "i", F.when(F.col("i") % 2 == 1, group(group(leaf))).otherwise(leaf).alias("json"))

    def joined(rows: DataFrame, keys: list[str], order: str, kind: str) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "json"))), lambda x: x["json"])
        return rows.groupBy(*keys).agg(F.concat(F.lit(f'{{"block_type":"{kind}","children":['), F.array_join(parts, ","), F.lit("]}")).alias("json"))

    return joined(joined(blocks, ["conv_id", "turn"], "i", "Page"), ["conv_id"], "turn", "Document")


@query(r"""
WITH t AS (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS page, string_split(text, chr(10)) AS l FROM conversations), u AS (SELECT conv_id, page, unnest(l) AS line, unnest(range(len(l))) AS i FROM t),
c AS (SELECT conv_id, page, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM u)
SELECT conv_id, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY page, i) - 1 AS INTEGER) AS block, CASE WHEN i = 0 THEN 'SectionHeader' WHEN i % 5 = 4 THEN 'PageFooter' ELSE 'Text' END AS type, text,
  CAST(CASE WHEN i = 0 THEN 2 END AS INTEGER) AS level, i = 0 OR i % 5 <> 4 AS included FROM c WHERE text <> ''
""")
def layout_tree(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of layout trees, nested to unlike depths, as rows."""
    return layout.layout_blocks(_trees(spark, d), "conv_id", "json").select("conv_id", "page", "block", "type", "text", "level", "included")
