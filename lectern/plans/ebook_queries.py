"""Queries over nested contents lists made from the lines of documents, each with its SQL.

A document is a book, a line a block. Every second line is named in the contents list: every twelfth as a part, every
fourth as a chapter in a file of its own, the others as sections in their chapter's file; some parts have no place, some entries no title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ebooks
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def book_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries, blocks and documents of the made-up books."""
    lines = read(spark, d, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("block", "text"))
    i = F.col("block")
    words = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    entries = lines.where(i % 2 == 0).select(
        "book", i.alias("entry"),
        F.when(i % 12 == 0, F.lit(None)).when(i % 4 == 0, i - i % 12).otherwise(i - i % 4).cast("int").alias("parent"),
        F.when(i % 14 == 0, "").otherwise(words).alias("title"), F.concat(F.lit("f"), F.floor(i / 4).cast("string")).alias("file"),
        F.when((i % 36 == 24), F.lit(None)).otherwise(i).cast("int").alias("start"),
    )
    documents = lines.where(i % 4 == 0).select("book", i.alias("start"), F.when(i % 8 == 0, words).alias("heading"))
    return entries, lines, documents


BOUNDARIES_SQL = r"""lines AS (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
e AS (SELECT book, i AS entry, CASE WHEN i % 12 = 0 THEN NULL WHEN i % 4 = 0 THEN i - i % 12 ELSE i - i % 4 END AS parent, CASE WHEN i % 14 = 0 THEN '' ELSE array_to_string(string_split(text, ' ')[1:5], ' ') END AS title,
  i // 4 AS file, CASE WHEN i % 36 = 24 THEN NULL ELSE i END AS start FROM lines WHERE i % 2 = 0),
n AS (SELECT book, i, sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) OVER (PARTITION BY book ORDER BY i) AS upto FROM lines),
c AS (SELECT p.book, p.entry, p.start, arg_min(k.start, k.entry) AS child, bool_or(k.file <> p.file) AS apart, count(k.entry) AS kids FROM e p LEFT JOIN e k ON k.book = p.book AND k.parent = p.entry GROUP BY ALL),
o AS (SELECT c.*, kids > 0 AND (start IS NULL OR (apart AND coalesce((SELECT max(upto) FROM n WHERE n.book = c.book AND n.i < c.child), 0) - coalesce((SELECT max(upto) FROM n WHERE n.book = c.book AND n.i < c.start), 0) < 150)) AS opens FROM c),
seen AS (SELECT book, entry, start, title FROM e WHERE parent IS NULL UNION ALL SELECT k.book, k.entry, k.start, k.title FROM seen s JOIN o ON o.book = s.book AND o.entry = s.entry AND o.opens JOIN e k ON k.book = s.book AND k.parent = s.entry)"""


@query(f"WITH RECURSIVE {BOUNDARIES_SQL} SELECT book, CAST(start AS INTEGER) AS start, title FROM seen WHERE start IS NOT NULL")
def epub_toc_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Where the books' chapters begin: the level of the contents list at which each is cut."""
    entries, blocks, _ = book_rows(spark, d)
    return ebooks.boundaries(entries, blocks)


@query(rf"""
WITH RECURSIVE {BOUNDARIES_SQL}, b AS (SELECT book, start, title FROM seen WHERE start IS NOT NULL), many AS (SELECT book FROM b GROUP BY book HAVING count(*) >= 2),
cuts AS (SELECT book, start, title, TRUE AS by_list FROM b JOIN many USING (book) UNION ALL
  SELECT book, i, CASE WHEN i % 8 = 0 THEN array_to_string(string_split(text, ' ')[1:5], ' ') ELSE 'Part ' || (i // 4 + 1) END, FALSE FROM lines WHERE i % 4 = 0 AND book NOT IN (SELECT book FROM many)),
p AS (SELECT *, row_number() OVER w AS piece, lead(start) OVER w AS stop FROM cuts WINDOW w AS (PARTITION BY book ORDER BY start)),
parts AS (SELECT p.book, p.piece, p.title, p.by_list, l.i, l.text, regexp_replace(lower(l.text), '[^\p{{L}}\p{{N}}]+', '', 'g') AS k FROM p JOIN lines l ON l.book = p.book AND l.i >= p.start AND (p.stop IS NULL OR l.i < p.stop)),
t AS (SELECT DISTINCT book, regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM b WHERE length(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g')) >= 4),
listing AS (SELECT book, piece FROM (SELECT *, EXISTS (SELECT 1 FROM t WHERE t.book = parts.book AND starts_with(parts.k, t.t)) AS hit FROM parts WHERE by_list) GROUP BY ALL HAVING count(*) FILTER (WHERE hit) >= 3 AND 2 * count(*) FILTER (WHERE hit) >= count(*)),
whole AS (SELECT p.book, p.piece, p.title, list(x.text ORDER BY x.i) FILTER (WHERE x.i IS NOT NULL) AS texts, coalesce(string_agg(x.k, '' ORDER BY x.i), '') AS k
  FROM p LEFT JOIN (SELECT * FROM parts ANTI JOIN listing USING (book, piece)) x USING (book, piece) GROUP BY ALL),
f AS (SELECT *, texts IS NULL OR k = regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g') AS bare FROM whole),
g AS (SELECT *, coalesce(count(*) FILTER (WHERE NOT bare) OVER (PARTITION BY book ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS chapter FROM f),
h AS (SELECT book, chapter, flatten(list(texts ORDER BY piece) FILTER (WHERE texts IS NOT NULL)) AS texts, max(title) FILTER (WHERE NOT bare) AS title, bool_or(NOT bare) AS whole FROM g GROUP BY ALL)
SELECT book, CAST(chapter AS INTEGER) AS chapter, CASE WHEN trim(left(CASE WHEN title <> '' THEN title ELSE texts[1] END, 200)) <> '' THEN trim(left(CASE WHEN title <> '' THEN title ELSE texts[1] END, 200)) ELSE 'Part ' || chapter END AS title,
  array_to_string(texts, chr(10) || chr(10)) AS text FROM h WHERE whole
""")
def epub_chapters(spark: SparkSession, d: str) -> DataFrame:
    """The chapters of the books, cut at their contents list, or by document where it gives too few places."""
    return ebooks.chapters(*book_rows(spark, d))
