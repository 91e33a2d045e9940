"""The pipeline's stages, one after another, each against what it was given."""

import re

import corpus_pipeline as pipeline
from lectern.llm import secrets, sentencepiece
from tests.llm.test_texts import components_plain, mix_targets, learned_plain

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {"start": docs.collect()}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        given[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == pipeline.COLUMNS
    ids = {n: [r["doc_id"] for r in rows] for n, rows in given.items()}
    text = {n: {r["doc_id"]: r["text"] for r in rows} for n, rows in given.items()}

    assert 0.6 * len(ids["start"]) < len(ids["quality"]) < len(ids["start"]) and set(ids["quality"]) < set(ids["start"])
    groups = components_plain(list(text["quality"].items()), 5, 80)
    assert sorted(ids["near_dedup"]) == sorted(i for i, (_, _, kept) in groups.items() if kept)
    assert sorted(ids["secrets"]) == sorted(ids["near_dedup"])
    learned = learned_plain(text["near_dedup"].values())
    for i, t in text["secrets"].items():
        before = text["near_dedup"][i]
        assert t == secrets.masked(before, secrets.scan(before, learned=learned)) and not [s for s in secrets.scan(t) if s.kind != "guess"]
    size = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"]))) for r in given["secrets"]}
    words, taken, largest = {}, {}, {}
    for s, n in size.values():
        words[s], largest[s] = words.get(s, 0) + n, max(largest.get(s, 0), n)
    for i in ids["mixing"]:
        s, n = size[i]
        taken[s] = taken.get(s, 0) + n
    for s, want in mix_targets(words).items():
        assert abs(taken.get(s, 0) - want) <= largest[s] + 1e-6
    assert sorted(ids["sentencepiece"]) == sorted(ids["mixing"])
    back = sentencepiece.decode(docs, keep=["doc_id"], name="back").collect()
    assert all(r["back"] == text["mixing"][r["doc_id"]] for r in back)


def test_repeated_ids_and_nulls(spark):
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (None, "no key", None, None, None), (2, None, "en", None, 0), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "None"]
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, docs.where("1 = 0"), SF).count() == 0
        stage(spark, docs, SF).collect()


def test_near_dedup_keeps_unlike_rows_of_one_id(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (1, "one two three four five six", "de", "b", 2), (2, "one two three four five six", "en", "a", 1), (2, "one two three four five six", "en", "a", 1), (3, None, "en", "a", 0), (3, None, "en", "a", 0), (4, "only here " * 3000, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "0 AS id", "1 AS h", "2 AS c", "3 AS __row")
    kept = pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == pipeline.COLUMNS
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect()) == [(1, "alpha"), (1, "one t"), (3, ""), (3, ""), (4, "only ")]
    for _, stage in pipeline.STAGES[1:]:
        stage(spark, docs, SF).collect()
