"""Layout trees: JSON documents whose pages hold blocks within blocks, to any depth, as flat rows.

A document is {"children": [page, ...]}, a page {"block_type": "Page", "children": [block, ...]} and a block either has
children or is a leaf with html. Each round opens the blocks of one level, so the rounds are as many as the
tree is deep, and each works on all documents at once; the JSON of a block is passed on as text, so no schema of nested
blocks is needed.

Defined results: a page is numbered by its place among the document's children, whether or not those before it are pages; blocks stand in the
tree's order; a block with an empty list of children gives nothing; a leaf without text goes; JSON that cannot be read,
or null, gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.relational import hold
from .html import page_texts

#: The types of blocks that belong to the text.
INCLUDED = ["Text", "SectionHeader", "ListItem", "Handwriting"]

_BLOCK = "block_type string, html string, text_kind string, break_before string, polygon array<array<double>>, section_hierarchy map<string,string>, children array<string>"


def layout_blocks(docs: DataFrame, key: str, tree: str) -> DataFrame:
    """key, page, block (its place in the document), type, kind, break_before, text, level, hierarchy, polygon and included of every leaf with text."""
    pages = docs.select(F.col(key).alias("key"), F.from_json(tree, "children array<string>")["children"].alias("children")).select("key", F.posexplode("children").alias("at", "body"))
    page = F.from_json("body", "block_type string, children array<string>")
    inner = pages.select("key", (F.col("at") + 1).alias("page"), page.alias("b")).where("b.block_type = 'Page'")
    level = hold(inner.select("key", "page", F.posexplode("b.children").alias("at", "body")).select("key", "page", F.array("at").alias("path"), F.from_json("body", _BLOCK).alias("b")))
    leaves = None
    while True:
        here = level.where("b.children IS NULL AND b IS NOT NULL")
        leaves = here if leaves is None else leaves.union(here)
        below = level.where("b.children IS NOT NULL").select("key", "page", "path", F.posexplode("b.children").alias("at", "body"))
        level = hold(below.select("key", "page", F.concat("path", F.array("at")).alias("path"), F.from_json("body", _BLOCK).alias("b")))
        if not level.limit(1).count():
            break
    texts = page_texts(leaves.select("key", "page", "path", "b", F.col("b.html").alias("html")), keep=["key", "page", "path", "b"])
    clean = F.when(F.col("b.text_kind") == "verse", T.format_verse(F.col("text"))).otherwise(T.clean_extracted(F.col("text")))
    rows = texts.select("key", "page", "path", "b", clean.alias("text")).where("text <> ''")
    header = F.col("b.block_type") == "SectionHeader"
    digit = F.regexp_extract(F.coalesce("b.html", F.lit("")), r"<h(\d)", 1)
    place = F.row_number().over(Window.partitionBy("key").orderBy("page", "path")) - 1  # one document's blocks
    return rows.select(
        F.col("key").alias(key), "page", place.alias("block"), F.col("b.block_type").alias("type"), F.col("b.text_kind").alias("kind"), "b.break_before", "text",
        F.when(header & (digit != ""), digit.cast("int")).alias("level"), F.col("b.section_hierarchy").alias("hierarchy"), "b.polygon", F.coalesce(F.col("b.block_type").isin(INCLUDED), F.lit(False)).alias("included"),
    )
