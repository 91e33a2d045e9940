"""The stored search index against searches of the texts themselves."""

import random
import re

import pytest

from lectern.operators import chunks, postings, retrieval
from lectern.plans import search_queries

SCHEMA = "id long, text string, key string, term string, positions int, bucket int"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def stands(w, tokens):
    return [i for i in range(len(w) - len(tokens) + 1) if w[i : i + len(tokens)] == tokens]


def plain(rows, query, most=50):
    """key and cover of the best rows, from their texts."""
    parsed = retrieval.parse_query(query)
    texts = {}
    for key, text in rows:
        if key is not None:
            texts.setdefault(key, []).append(words(text))
    found = []
    for key, (w, *_) in texts.items():
        hits = [a for a in parsed if all(bool(stands(w, tokens)) == wanted for wanted, tokens in a)]
        if hits:
            found.append((-round(retrieval.cover_rank(w, parsed), 9), key))
    return [(key, -cover) for cover, key in sorted(found)[:most]]


def texts(seed, n):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(["the", "The", "and", "of,", "cat", "dog.", "été", "x_y", "with"]) for _ in range(draw.randrange(0, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [*texts(1, 300), (900, None), (901, ""), (902, "the " * 30_000 + "end"), (None, "the and of")]
    path = str(tmp_path_factory.mktemp("index") / "postings")
    table = spark.createDataFrame([(i, t, "k", "t", 1, 2) for i, t in rows], SCHEMA)
    postings.write_index(table, path, key="id", text="text", buckets=16, files=3)
    return rows, path


@pytest.mark.parametrize("query", ["the", "the and of", '"the and"', '"of the" or "and the" -with', "cat -dog", "-the", "nowhere", "été or end", '"the cat and" dog', "the the", '"the the the"', "x y"])
def test_search_equals_the_texts(spark, index, query):
    rows, path = index
    got = [(r["key"], r["cover"]) for r in postings.search(spark, path, query, buckets=16).orderBy("rank").collect()]
    want = plain(rows, query)
    assert [k for k, _ in got] == [k for k, _ in want] and [c for _, c in got] == pytest.approx([c for _, c in want], rel=1e-9)


def test_only_the_asked_words_are_read(spark, index):
    plan = postings.lookup(spark, index[1], ["cat", "dog"], 16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term", plan)


def test_scope_empty_query_and_empty_table(spark, index, tmp_path):
    rows, path = index
    few = spark.createDataFrame([(i,) for i in range(0, 40)], "key long")
    got = [(r["key"], r["cover"]) for r in postings.search(spark, path, "the and", buckets=16, within=few).orderBy("rank").collect()]
    assert got == plain([r for r in rows if r[0] is not None and r[0] < 40], "the and")
    assert postings.search(spark, path, " -- ", buckets=16).count() == 0
    postings.write_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), key="id", text="text")


def test_rows_that_share_a_key_are_one_row(spark):
    table = spark.createDataFrame([(1, "a b", "k", "t", 1, 2), (1, "b c", "k", "t", 1, 2)], SCHEMA)
    assert {(r["term"], tuple(r["positions"])) for r in postings.postings(table, key="id", text="text").collect()} == {("a", (0,)), ("b", (0, 1)), ("c", (1,)), ("", ())}


def test_search_library_equals_a_plain_search(spark):
    """Both legs, the fusion and the grouping over chunks, by loops."""
    import numpy as np

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    cut = [r.asDict() | {"id": f"{r['doc_id']}:{r['seq']}"} for r in chunks.chunk_texts(docs, keep=["doc_id", "lang", "source"]).collect()]
    legs = [[key for key, _ in plain([(c["id"], c["text"]) for c in cut], search_queries.ASKED)]]
    q = vectors[0]
    far = sorted((1 - q @ v / np.sqrt((q @ q) * (v @ v)), c["id"]) for c in cut if (v := vectors.get((c["doc_id"] * 7 + c["seq"]) % len(vectors))) is not None)
    legs.append([key for _, key in far[:50]])
    score = {}
    for leg in legs:
        for rank, key in enumerate(leg, 1):
            score[key] = score.get(key, 0) + 1 / (60 + rank)
    hits = [{"id": c["id"], "book": c["source"], "unit": c["doc_id"], "file": str(c["doc_id"]), "source": "chapter", "language": c["lang"], "text": c["text"], "score": score[c["id"]], **{k: c[k] for k in ("char_start", "char_end", "page_start", "page_end")}} for c in cut if c["id"] in score]
    hits.sort(key=lambda h: (-h["score"], h["id"]))
    want = [(i + 1, h["id"], round(h["score"], 9)) for i, h in enumerate(retrieval.group_hits(hits, search_queries.ASKED, 12))]
    got = [(r["place"], r["id"], r["score"]) for r in search_queries.search_library(spark, sf).orderBy("place").collect()]
    assert got == want
