"""Queries over the reading order of made-up pages, each with its SQL where SQL can express it.

An order of the shop is a page, its items the lines: in two columns where the order's number is even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ocr_order
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """lines and their order: down the columns, or across them where the page's number ends in six."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    items = items.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    two = k % 2 == 0
    row = F.when(two, F.floor((n - 1) / 2)).otherwise(n - 1).cast("int")
    x = F.when(two & (n % 2 == 0), 600).otherwise(50)
    lines = items.select(k.alias("page"), n.cast("long").alias("line"), F.concat(F.lit("line "), n).alias("text"), F.array(x, row * 25 + 100, x + 200, row * 25 + 120).alias("box"))
    kind = F.element_at(F.array(*map(F.lit, ["verse", "metadata", "prose", "verse"])), (k % 4 + 1).cast("int"))
    down = F.when(two, F.when(n % 2 == 0, 100).otherwise(0) + n).otherwise(n)
    at = F.when(k % 10 == 6, n).otherwise(down)
    order = items.select(k.alias("page"), F.lit(0).alias("group"), at.cast("int").alias("at"), n.cast("long").alias("line"), F.lit(0).alias("section"), kind.alias("kind"), F.lit("stanza").alias("break_before"))
    return lines, order


@query("""
WITH l AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), k AS (SELECT page, count(*) AS lines, CASE page % 4 WHEN 1 THEN 'metadata' WHEN 2 THEN 'prose' ELSE 'verse' END AS kind, list(n ORDER BY n) AS across, list(n ORDER BY n) FILTER (WHERE n % 2 = 1) AS odd, list(n ORDER BY n) FILTER (WHERE n % 2 = 0) AS even FROM l GROUP BY page),
s AS (SELECT *, page % 2 = 0 AND kind <> 'prose' AND even IS NOT NULL AS two, page % 10 = 6 AS mixed FROM k)
SELECT page, CAST(0 AS INTEGER) AS "group", kind, 'stanza' AS break_before, array_to_string(CASE WHEN two AND (NOT mixed OR lines < 3) THEN odd WHEN page % 2 = 0 AND NOT mixed THEN odd || coalesce(even, []) ELSE across END, ',') AS lines, two AND mixed AND lines >= 3 AS wrong FROM s
UNION ALL SELECT page, 1, kind, 'line', array_to_string(even, ','), FALSE FROM s WHERE two AND (NOT mixed OR lines < 3)
""")
def split_columns(spark: SparkSession, d: str) -> DataFrame:
    """The groups of pages whose lines stand in two columns, taken apart; those that go across the columns are wrong."""
    found = ocr_order.split_columns(*pages(spark, d), "page")
    return found.select("page", "group", "kind", "break_before", F.array_join("lines", ",").alias("lines"), F.col("fault").isNotNull().alias("wrong"))


@query("""
WITH g AS (SELECT conv_id AS page, turn AS "group", turn // 4 - CASE WHEN turn % 7 = 6 THEN 2 ELSE 0 END AS section, ['verse', 'metadata', 'prose', 'verse', 'heading', 'furniture', 'verse'][(conv_id + turn) % 7 + 1] AS kind, ['paragraph', 'line', 'stanza'][(conv_id * 3 + turn) % 3 + 1] AS break_before FROM conversations),
p AS (SELECT *, lag(kind) OVER w AS k, lag(section) OVER w AS s, coalesce(last_value(CASE WHEN kind <> 'furniture' THEN section END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS since FROM g WINDOW w AS (PARTITION BY page ORDER BY "group")),
q AS (SELECT *, coalesce(k = 'prose' AND break_before = 'paragraph', FALSE) AS quoted, CASE WHEN kind = 'furniture' THEN NULL WHEN kind = 'metadata' THEN TRUE WHEN kind = 'heading' OR section <> since OR (kind = 'verse' AND coalesce(k = 'prose' AND break_before = 'paragraph', FALSE)) THEN FALSE END AS event FROM p),
r AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY page ORDER BY "group" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ended FROM q)
SELECT page, "group", section, kind, CASE WHEN break_before = 'line' AND NOT coalesce(kind = 'verse' AND k = 'verse' AND s = section, FALSE) THEN 'paragraph' ELSE break_before END AS break_before,
  CASE WHEN kind <> 'furniture' AND section < since THEN 'earlier section' WHEN kind = 'verse' AND ended AND NOT quoted AND section = since THEN 'metadata within verse' END AS fault FROM r
""")
def validate_order(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as groups of a page: breaks put right, and what breaks the rules of sections, verse and metadata."""
    c, t = F.col("conv_id"), F.col("turn")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    kinds = ["verse", "metadata", "prose", "verse", "heading", "furniture", "verse"]
    section = F.floor(t / 4) - F.when(t % 7 == 6, 2).otherwise(0)
    groups = read(spark, d, "conversations").select(c.alias("page"), t.alias("group"), section.alias("section"), pick(kinds, (c + t) % 7).alias("kind"), pick(["paragraph", "line", "stanza"], (c * 3 + t) % 3).alias("break_before"))
    return ocr_order.semantic_order(groups, "page")
