"""Queries over Bulgarian numbers and texts as they are spoken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bulgarian
from .relational_queries import read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _under_thousand(n: str, gender: str) -> str:
    """DuckDB SQL of a number below a thousand: its words, the last two joined by и."""
    ones = {"m": "'един', 'два'", "f": "'една', 'две'"}[gender]
    small = f"[{ones}, 'три', 'четири', 'пет', 'шест', 'седем', 'осем', 'девет', 'десет', 'единадесет', 'дванадесет', 'тринадесет', 'четиринадесет', 'петнадесет', 'шестнадесет', 'седемнадесет', 'осемнадесет', 'деветнадесет']"
    tens = "['двадесет', 'тридесет', 'четиридесет', 'петдесет', 'шестдесет', 'седемдесет', 'осемдесет', 'деветдесет']"
    hundreds = "['сто', 'двеста', 'триста', 'четиристотин', 'петстотин', 'шестстотин', 'седемстотин', 'осемстотин', 'деветстотин']"
    words = f"list_filter([{hundreds}[{n} // 100], CASE WHEN {n} % 100 >= 20 THEN {tens}[{n} % 100 // 10 - 1] END, {small}[CASE WHEN {n} % 100 >= 20 THEN {n} % 10 ELSE {n} % 100 END]], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({words}) > 1 THEN array_to_string({words}[:-2], ' ') || ' и ' || {words}[-1] ELSE coalesce({words}[1], '') END"


@query(f"""
WITH n AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS n, CAST(o_orderkey // 1000000 % 1000 AS BIGINT) AS m, CAST(o_orderkey // 1000 % 1000 AS BIGINT) AS t, CAST(o_orderkey % 1000 AS BIGINT) AS r FROM orders),
w AS (SELECT *, CASE WHEN m = 1 THEN 'един милион' WHEN m > 1 THEN {_under_thousand("m", "m")} || ' милиона' END AS a, CASE WHEN t = 1 THEN 'хиляда' WHEN t > 1 THEN {_under_thousand("t", "f")} || ' хиляди' END AS b,
  CASE WHEN r > 0 THEN CASE WHEN n >= 1000 AND (r < 100 OR r % 100 = 0) THEN 'и ' ELSE '' END || {_under_thousand("r", "f")} END AS c FROM n)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'нула' ELSE concat_ws(' ', a, b, c) END AS words FROM w
""")
def bg_number_words(spark: SparkSession, d: str) -> DataFrame:
    """The number of each order in (feminine) words."""
    return read(spark, d, "orders").select("o_orderkey", bulgarian.cardinal(F.col("o_orderkey").cast("long"), "f").alias("words"))


@query()
def bg_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The documents as they are read aloud, each after its date, time and price."""
    n = F.col("doc_id")
    figures = lambda c, k: F.lpad(c.cast("string"), k, "0")
    day = F.concat(figures(n % 28 + 1, 2), F.lit("."), figures(n % 12 + 1, 2), F.lit("."), (n % 200 + 1850).cast("string"))
    head = F.concat(F.lit("На "), day, F.lit(" г. в "), figures(n % 24, 2), F.lit(":"), figures(n % 60, 2), F.lit(" ч. за "), n.cast("string"), F.lit(",50 лв. "))
    docs = read(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    # dealt out by key: of a file's parts only those that hold the middle of a row group have rows
    tasks = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    return bulgarian.spoken(docs.repartition(tasks, "doc_id"), "text", "spoken").select("doc_id", "spoken")
