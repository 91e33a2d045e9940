"""Queries over contents lists and structure plans made from the lines of documents, each with its SQL where SQL can express it.

A document is a book. Every fourth line stands for a heading, five lines make a page, and the contents list names every
second heading by its first words, with printed pages two behind the book's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contents, structure
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _heads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """entries and headings."""
    heads = _lines(spark, d).where(F.col("i") % 4 == 0)
    words = lambda n: F.array_join(F.slice(F.split("line", " "), 1, n), " ")
    page = F.floor(F.col("i") / 5).cast("int") + 3
    headings = heads.select("book", F.col("i").alias("block"), words(7).alias("text"), page.alias("page"))
    entries = heads.where(F.col("i") % 8 == 0).select("book", (F.col("i") / 8).cast("int").alias("entry"), F.concat((F.col("i") / 8 + 1).cast("int").cast("string"), F.lit(". "), words(5)).alias("title"), (page - 2).alias("page"))
    return entries, headings


HEADS_SQL = r"""l AS (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
h AS (SELECT book, CAST(i AS INTEGER) AS block, array_to_string(string_split(line, ' ')[1:7], ' ') AS text, CAST(i // 5 + 3 AS INTEGER) AS page FROM l WHERE i % 4 = 0),
e AS (SELECT book, CAST(i // 8 AS INTEGER) AS entry, (i // 8 + 1) || '. ' || array_to_string(string_split(line, ' ')[1:5], ' ') AS title, CAST(i // 5 + 1 AS INTEGER) AS page FROM l WHERE i % 8 = 0),
p AS (SELECT e.book, entry, block, e.page AS printed, h.page, regexp_replace(title, '^\s*\pN+\s*[.)]?\s+', '') AS a, regexp_replace(text, '^\s*\pN+\s*[.)]?\s+', '') AS b FROM e JOIN h USING (book)),
w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(a), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '\pN'))) AS t, list_distinct(list_filter(string_split_regex(lower(b), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '\pN'))) AS s,
  regexp_replace(lower(a), '[^\p{L}\p{N}]+', '', 'g') AS x, regexp_replace(lower(b), '[^\p{L}\p{N}]+', '', 'g') AS y FROM p),
c AS (SELECT book, entry, block, printed, page, len(t) AS n, CASE WHEN len(t) = 0 THEN 0.0 WHEN len(t) = 1 THEN CASE WHEN list_has_any(t, s) AND len(s) <= 3 THEN 1.0 ELSE 0.0 END
  WHEN length(x) >= 6 AND contains(y, x) AND length(y) <= length(x) * 1.5 + 3 THEN 1.0
  ELSE len(list_intersect(t, s)) / len(t) * CASE WHEN len(s) > 2 * len(t) + 3 THEN 0.6 ELSE 1.0 END END::DOUBLE AS similarity FROM w)"""


@query(f"WITH {HEADS_SQL} SELECT book, entry, block, page, round(similarity, 9) AS similarity FROM c WHERE similarity > 0")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike the titles of a book's contents list and its headings are."""
    entries, headings = _heads(spark, d)
    found = contents.candidates(entries.select("book", "entry", F.array("title").alias("titles")), headings, "book")
    return found.withColumn("similarity", F.round("similarity", 9))


@query(rf"""
WITH {HEADS_SQL}, named AS (SELECT book, entry, len(list_distinct(list_filter(string_split_regex(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '\pN')))) AS n FROM e),
r AS (SELECT c.*, row_number() OVER (PARTITION BY book, entry ORDER BY similarity DESC, block) AS k FROM c JOIN named USING (book, entry) WHERE similarity >= 0.75 AND named.n >= 2)
SELECT book, entry, printed, page FROM r WHERE k <= 6
""")
def find_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The headings that surely are an entry's, with the printed and the own page."""
    return contents.anchors(*_heads(spark, d), "book")


@query()
def locate_entries(spark: SparkSession, d: str) -> DataFrame:
    """The heading of each entry of the contents lists, the page it was expected on, and what to choose from otherwise."""
    return contents.locate_contents(*_heads(spark, d), "book")


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The plan, and the saved chapters: saved ones are four lines long, new ones four or eight in turn; every third is edited, every seventh gone from the text, and one is inserted."""
    ends = _lines(spark, d).groupBy("book").agg((F.max("i") + 1).alias("n"))
    end = lambda start, size: F.least(start + size, F.col("n")).cast("int")
    k = F.col("k")
    own = ends.select("book", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 4).cast("int") - 1)).alias("k"))
    title = F.concat(F.lit("Chapter "), k.cast("string"))
    there = k % 7 != 6
    saved = own.select(
        "book", k.cast("string").alias("id"), F.when(k >= 1, k + 1).otherwise(k).alias("index"), title.alias("title"), F.when(k % 3 == 0, F.concat(F.lit("edit "), k.cast("string"))).alias("edited"),
        F.lit(None).cast("int").alias("file"), F.when(there, (k * 4).cast("int")).alias("start"), F.when(there, end(k * 4, 4)).alias("end"), k.alias("page_start"), F.lit(False).alias("inserted"),
    )
    none = F.lit(None)
    note = ends.select("book", F.lit("note").alias("id"), F.lit(1).alias("index"), F.lit("A note").alias("title"), none.cast("string"), none.cast("int"), none.cast("int"), none.cast("int"), none.cast("int"), F.lit(True))
    saved = saved.union(note)
    # of each twelve lines the first four are one new chapter, the other eight another
    g = F.col("g")
    groups = ends.select("book", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 12).cast("int") - 1)).alias("g"))
    first = groups.select("book", (g * 2).alias("cut"), F.concat(F.lit("Chapter "), (g * 3).cast("string")).alias("title"), none.cast("int").alias("file"), (g * 12).cast("int").alias("start"), end(g * 12, 4).alias("end"), (g * 3).alias("page_start"), (g * 3).alias("page_end"))
    second = groups.where(g * 12 + 4 < F.col("n")).select("book", (g * 2 + 1).alias("cut"), F.concat(F.lit("Both "), g.cast("string")).alias("title"), none.cast("int").alias("file"), (g * 12 + 4).cast("int").alias("start"), end(g * 12 + 4, 8).alias("end"), (g * 3 + 1).alias("page_start"), (g * 3 + 2).alias("page_end"))
    n = F.col("id").try_cast("int")
    choices = saved.where("NOT inserted").where(n % 2 == 0).select("book", "id", F.when(n % 5 == 0, "drop").otherwise("keep").alias("choice"))
    return structure.structure_plan(saved, first.union(second), choices), saved


PLAN_SQL = r"""t AS (SELECT doc_id AS book, len(string_split(text, chr(10))) AS n FROM documents),
s AS (SELECT book, k, CAST(k AS VARCHAR) AS id, CASE WHEN k >= 1 THEN k + 1 ELSE k END AS idx, 'Chapter ' || k AS title, CASE WHEN k % 3 = 0 THEN 'edit ' || k END AS edited, CASE WHEN k % 7 <> 6 THEN k * 4 END AS s, CASE WHEN k % 7 <> 6 THEN least(k * 4 + 4, n) END AS e,
  CASE WHEN k % 2 = 0 THEN CASE WHEN k % 5 = 0 THEN 'drop' ELSE 'keep' END END AS choice FROM (SELECT book, n, unnest(range((n + 3) // 4)) AS k FROM t)),
g AS (SELECT book, n, unnest(range((n + 11) // 12)) AS g FROM t),
c AS (SELECT book, g * 2 AS cut, 'Chapter ' || g * 3 AS title, g * 12 AS s, least(g * 12 + 4, n) AS e, g * 3 AS p, g * 3 AS q FROM g UNION ALL SELECT book, g * 2 + 1, 'Both ' || g, g * 12 + 4, least(g * 12 + 12, n), g * 3 + 1, g * 3 + 2 FROM g WHERE g * 12 + 4 < n),
f AS (SELECT c.*, s.id, s.title AS old_title FROM c LEFT JOIN s ON s.book = c.book AND s.s = c.s AND s.e = c.e),
gone AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.book = s.book AND f.id = s.id)),
goal AS (SELECT o.book, o.id, o.idx, min(f.cut) AS goal FROM gone o JOIN f ON f.book = o.book AND f.id IS NULL AND ((f.s < o.e AND f.e > o.s) OR (o.s IS NULL AND f.p <= o.k AND o.k <= f.q)) WHERE o.edited IS NOT NULL AND o.choice = 'keep' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book, goal ORDER BY idx) AS r FROM goal),
verdict AS (SELECT o.book, o.id, o.title, o.edited, r.goal, CASE WHEN o.edited IS NULL THEN NULL WHEN o.choice IS NULL THEN 'undecided' WHEN o.choice = 'drop' THEN 'dropped' WHEN r.goal IS NULL THEN 'orphaned' WHEN r.r > 1 THEN 'colliding' ELSE 'carried' END AS edit FROM gone o LEFT JOIN ranked r USING (book, id)),
made AS (SELECT f.book, f.cut, f.id, f.title, f.old_title, CASE WHEN f.id IS NULL THEN 'new' ELSE 'kept' END AS kind, v.edited AS carried, row_number() OVER (PARTITION BY f.book ORDER BY f.cut) - 1 AS slot FROM f LEFT JOIN verdict v ON v.book = f.book AND v.goal = f.cut AND v.edit = 'carried'),
plan AS (SELECT book, CASE WHEN slot >= 1 THEN slot + 1 ELSE slot END AS place, kind, id, cut, title, old_title, CASE WHEN carried IS NOT NULL THEN 'carried' END AS edit, carried FROM made
  UNION ALL SELECT book, least(1, (SELECT count(*) FROM made m WHERE m.book = t.book)), 'kept', 'note', NULL, 'A note', 'A note', NULL, NULL FROM t
  UNION ALL SELECT book, NULL, 'removed', id, NULL, NULL, title, edit, NULL FROM verdict)"""


@query(f"WITH {PLAN_SQL} SELECT book, CAST(place AS INTEGER) AS place, kind, id, CAST(cut AS INTEGER) AS cut, title, old_title, edit, carried FROM plan")
def plan_structure(spark: SparkSession, d: str) -> DataFrame:
    """What new boundaries do to the saved chapters of each book: kept, new and removed ones, and what becomes of edits."""
    return _plan(spark, d)[0]


@query(f"""
WITH {PLAN_SQL}, was AS (SELECT book, id, row_number() OVER (PARTITION BY book ORDER BY idx) - 1 AS was FROM (SELECT book, id, idx FROM s UNION ALL SELECT book, 'note', 1 FROM t)),
x AS (SELECT plan.book, coalesce(kind = 'kept' AND place = was, FALSE) AS stays, coalesce(title = old_title, FALSE) AS titled FROM plan LEFT JOIN was ON was.book = plan.book AND was.id = plan.id)
SELECT book, bool_and(stays) AND bool_and(titled) AS unchanged, bool_and(stays) AND NOT bool_and(titled) AS renamed_only FROM x GROUP BY book
""")
def plan_changes(spark: SparkSession, d: str) -> DataFrame:
    """Whether the plan leaves a book as it is, or only renames its chapters."""
    return structure.plan_changes(*_plan(spark, d))
