"""Chapter detection reads texts where they are: no text of a block meets others, and each way shuffles once."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import structure

SCHEMA = "unit long, block int, text string, page int, included boolean, type string, level int"


def blocks(spark):
    heads = {0: "Chapter 1 dawn breaks", 3: "Chapter 2 noon comes", 6: "Chapter 2 noon", 9: "Chapter 3 dusk falls"}
    return spark.createDataFrame([(u, i, heads.get(i, "some words of text") if u == 1 else f"line {i} of three", i + 1, True, "SectionHeader" if i in heads else "Text", 1) for u in (1, 2) for i in range(11)], SCHEMA)


def test_boundaries_by_number_and_level(spark):
    got = sorted(tuple(r) for r in structure.detect_boundaries(blocks(spark), "unit").collect())
    assert got == [(1, b, "numbered-headings") for b in (0, 6, 9)] + [(2, b, "heading-levels") for b in (0, 3, 6, 9)] or got == [(1, b, "numbered-headings") for b in (0, 3, 9)] + [(2, b, "heading-levels") for b in (0, 3, 6, 9)]


def test_each_way_shuffles_once(spark):
    for made in (structure.numbered_headings(blocks(spark), "unit"), structure.heading_levels(blocks(spark), "unit"), structure.heading_words(blocks(spark), "unit", F.col("type") == "SectionHeader").select("unit", "block", "words_to_next")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


@pytest.mark.parametrize("value", [None, "", " ", "\n\t ", "a", " a", "a ", " a  b\tc\n", "é\u00a0x\u2003y", "wörd. more, words-x  \ufeffé", "né" * 3000])
def test_word_count_by_ranges(spark, value):
    got = spark.createDataFrame([(value,)], "t string").select(T.word_count(F.col("t")), F.regexp_count("t", F.lit(T.WS.replace("[", "[^", 1) + "+"))).first()
    assert got[0] == got[1]
