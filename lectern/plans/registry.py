"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contents_queries, ebook_queries, edit_queries, edited_queries, job_queries, library_queries, module_queries, order_queries, reading_queries, relational_queries, search_queries, speech_queries, text_queries

_PARTS = (relational_queries, text_queries, module_queries, reading_queries, library_queries, edit_queries, search_queries, edited_queries, ebook_queries, contents_queries, order_queries, speech_queries, job_queries)

FLAGSHIP = "search_library"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.Q.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
