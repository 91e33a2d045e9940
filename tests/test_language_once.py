"""Guessing a language cuts a text into words once, not once for each language."""

from lectern.plans import registry


def test_words_are_cut_once(spark):
    out = registry.QUERIES["detect_language"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    rows = out.collect()
    assert {r["guess"] for r in rows} - {None} and all(r["detected"] in (None, r["guess"]) for r in rows)
