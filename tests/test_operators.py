"""Operators that SQL cannot express, against small cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align, chunks, library, reading, retrieval, structure
from lectern.operators import relational as R
from lectern.sources import html


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_chunks_have_true_offsets():
    text = ("A sentence of words here. " * 80 + "\n\n" + "Short one.\n \n" + "x" * 3000 + "\f" + "Last page! ") * 2
    found = chunks.drafts(text, chunks.feed_pages(text))
    assert all(c["text"] == text[c["char_start"] : c["char_end"]].replace("\f", "\n") for c in found)
    assert all(c["char_end"] - c["char_start"] <= chunks.TARGET + chunks.OVERLAP for c in found)
    covered = set().union(*(range(c["char_start"], c["char_end"]) for c in found))
    assert all(i in covered or text[i].isspace() for i in range(len(text)))
    assert [c["page_start"] for c in found] == sorted(c["page_start"] for c in found) and found[-1]["page_end"] == 3
    assert chunks.drafts("") == [] and chunks.drafts(" \n\n \f ") == []


def test_pages_from_blocks():
    text = "Alpha beta.\n\nGamma delta.\n\nEpsilon."
    page = chunks.block_pages(text, [{"text": "Alpha beta.", "page": 3, "included": True}, {"text": "no such", "page": 9, "included": True}, {"text": "Epsilon.", "page": 4, "included": True}])
    assert [page(0), page(15), page(len(text) - 1)] == [3, 3, 4]
    assert chunks.block_pages(text, []) is None


def test_pieces():
    assert chunks.llm_pieces("a\n\nb\n \nc", 6) == ["a\n\nb", "c"]
    long = "One two three. " * 30
    assert all(len(p) <= 100 for p in chunks.llm_pieces(long, 100)) and " ".join(chunks.llm_pieces(long, 100)).split() == long.split()
    assert chunks.speech_pieces("Title\n\n* * *\n\nHe left. She stayed there for a very long time indeed, and then she went home too.") == ["Title", "He left. She stayed there for a very long time indeed, and then she went home too."]
    assert chunks.locate("ab  c d", ["abc", "zz", "d"]) == [{"start": 0, "end": 5}, None, {"start": 6, "end": 7}]


def test_text_columns(spark):
    assert one(spark, T.clean_extracted, "Ein Wort­\n  teil und Zei-\n len,​  weiter ") == "Ein Wortteil und Zeilen, weiter"
    assert one(spark, T.normalize_for_speech, "# Head\n**bold** and *it* [link](u) ![i](u) see [12] [iv] https://x.y/z con-\nnect `code`  _em_ a_b_c") == "Head\nbold and it link see connect code em a_b_c"
    assert one(spark, lambda t: T.format_verse(t), " a  b \r\n c­ ") == "a b\nc"
    assert one(spark, T.snippet, "word " * 60) == ("word " * 28).strip() + "…"
    assert one(spark, T.roman, "XIV") == 14 and one(spark, T.roman, "12") == 12
    assert one(spark, T.is_title_like, "THE END") and not one(spark, T.is_title_like, "The End")
    assert one(spark, T.script_language, "Това е дълъг текст на кирилица, с букви") == "bg"


def hit(i, **more):
    base = {"id": str(i), "book": "b", "unit": "u", "file": "f", "source": "chapter", "language": "en", "text": f"text {i}", "score": 1.0, "char_start": 0, "char_end": 10, "page_start": None, "page_end": None}
    return base | more


def test_group_hits():
    far = {"char_start": 100, "char_end": 110}
    found = retrieval.group_hits([hit(1), hit(2, score=0.9), hit(3, score=0.8, **far), hit(4, score=0.7, char_start=200, char_end=210)], "q", 9)
    assert [h["id"] for h in found] == ["1", "3"]  # 2 overlaps 1; two of a unit
    assert len(retrieval.group_hits([hit(i, unit=i) for i in range(6)], "q", 9)) == 3  # three of a book
    assert len(retrieval.group_hits([hit(i, unit=i) for i in range(6)], "q", 9, book="b")) == 6
    pages = {"page_start": 1, "page_end": 2}
    raw, chapter = hit(1, unit="x", source="raw", text="same words here", **pages), hit(2, unit="y", score=0.5, text="Same words here.", **pages)
    (only,) = retrieval.group_hits([raw, chapter], "q", 9)
    assert only["id"] == "2" and only["score"] == 1.0  # the chapter takes the raw hit's place and score
    twin = hit(2, score=0.85, text="кирилица тук", **far)
    assert [h["id"] for h in retrieval.group_hits([hit(1), twin], "търсене", 9)] == ["2", "2"]  # a kept twin stays, too


def test_query_language(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick the fox"), (3, "brown dog")], "id int, t string")
    ids = lambda q: [r["id"] for r in df.where(retrieval.matches(F.col("t"), q)).orderBy("id").collect()]
    assert ids("quick fox") == [1, 2] and ids('"quick brown"') == [1] and ids("dog or brown") == [1, 3] and ids("fox -brown") == [2] and ids("") == []
    assert retrieval.cover_density([[1, 10], [2]]) > retrieval.cover_density([[1], [10]]) > retrieval.cover_density([[1], []]) == 0


def test_expand_passages(spark):
    rows = [(1, 0, 0, 10, "abcdefghij"), (1, 1, 8, 14, "ijklmn"), (1, 2, 20, 23, "xyz"), (1, 3, 30, 31, "q")]
    df = spark.createDataFrame(rows, "u int, seq int, char_start int, char_end int, text string")
    (r,) = retrieval.expand_passages(df, df.where("seq = 1").select("u", "seq"), unit="u").collect()
    assert r["text"] == "abcdefghijklmn\n\nxyz" and (r["char_start"], r["char_end"]) == (0, 23)


def found_boundaries(spark, rows):
    frame = spark.createDataFrame([(1, i, b["text"], b["page"], b["included"], b["type"], b["level"]) for i, b in enumerate(rows)], "unit int, block int, text string, page int, included boolean, type string, level int")
    found = structure.detect_boundaries(frame, "unit").orderBy("block").collect()
    return [r["block"] for r in found], found[0]["method"] if found else "none"


def test_boundaries(spark):
    block = lambda text, page, kind="Text", level=1: {"text": text, "page": page, "included": True, "type": kind, "level": level}
    body = [b for n in range(1, 5) for b in (block(f"Chapter {n}", n * 5, "SectionHeader"), block("some words " * 20, n * 5))]
    contents = [block(f"Chapter {n}", 1, "SectionHeader") for n in range(1, 5)]
    assert found_boundaries(spark, contents + body) == ([4, 6, 8, 10], "numbered-headings")
    levels = [b for t in ("A long heading", "Another long heading") for b in (block(t, 2, "SectionHeader"), block("x y z", 2))]
    assert found_boundaries(spark, levels) == ([0, 2], "heading-levels")
    assert found_boundaries(spark, [block("x", 1)]) == ([], "none")
    assert structure.longest_rising([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5]
    assert one(spark, T.roman, "XIV") == 14 and one(spark, T.roman, "12") == 12


def slow_align(model, seen, local):
    """The best total by trying every way, with memory."""
    from functools import cache

    a, b = [align.word_key(w) for w in model], [align.word_key(w) for w, _ in seen]

    @cache
    def best(i, j):
        if i == 0:
            return 0.0 if local else align.GAP * j
        ways = [best(i - 1, j) + align.GAP]
        if j:
            s = align.similarity(a[i - 1], b[j - 1])
            ways += [best(i, j - 1) + align.GAP, *([best(i - 1, j - 1) + s] if s >= align.MATCH else [])]
        if j > 1 and b[j - 2] and b[j - 1]:
            hyphen = seen[j - 2][0][-1:] in align._HYPHENS
            s = align.similarity(a[i - 1], b[j - 2] + b[j - 1])
            if (hyphen or seen[j - 2][1] == seen[j - 1][1]) and (s == 1 or (s >= align.MATCH and hyphen)):
                ways.append(best(i - 1, j - 2) + s)
        return max(ways)

    return max(best(len(a), j) for j in range(len(b) + 1)) if local else best(len(a), len(b))


def test_word_alignment_has_the_best_total():
    draw = np.random.default_rng(4)
    words = ["the", "cat", "mat", "con-", "tract", "contract", "sat", "—", "houses", "house"]
    for trial in range(60):
        model = [words[k] for k in draw.integers(0, len(words), draw.integers(1, 7))]
        seen = [(words[k], int(draw.integers(0, 2))) for k in draw.integers(0, len(words), draw.integers(1, 8))]
        local = bool(trial % 2)
        found = align.align_words(model, seen, local)
        at = [(i, two) for i, two, _ in found if i is not None]
        assert [i for i, _ in at] == sorted({i for i, _ in at})
        used = sum(2 if two else 1 for _, two in at)
        if local and at:
            first, last = at[0][0], at[-1][0] + (2 if at[-1][1] else 1)
            skipped = last - first - used
        else:
            skipped = 0 if local else len(seen) - used
        total = sum(s for i, _, s in found if i is not None) + align.GAP * (sum(i is None for i, _, _ in found) + skipped)
        assert total >= slow_align(model, seen, local) - 1e-6


def test_alignment():
    seen = [("Tbe", 0), ("quick", 0), ("bro-", 0), ("wn", 1), ("fox", 1)]
    found = align.align_words(["The", "quick", "brown", "fox"], seen)
    assert [(a, m) for a, m, _ in found] == [(None, False), (1, False), (2, True), (4, False)]
    edited = "The cat sat on the mat and then it slept for hours"
    original = "HEADER The cat sat on the mat and then it sleept for hours"
    spans = align.token_map(edited, original)
    assert [original[c:d] for _, _, c, d in spans] == original.split()[1:]
    assert align.token_map("entirely other words", edited) is None
    v = np.eye(4)
    steps = align.align_sentences(v[:3], v[[0, 2]], np.ones(3), np.ones(2))
    assert [(i, p, j, q) for i, p, j, q, _ in steps] == [(0, 1, 0, 1), (1, 1, 1, 0), (2, 1, 1, 1)]
    assert align.pair_status([(p, q, s) for _, p, _, q, s in steps]) == ["matched", "source-only", "matched"]
    assert align.pair_status([(1, 1, s) for s in (0.9, 0.91, 0.9, 0.92, 0.91, 0.2)])[-1] == "uncertain"


def test_html():
    page = "<html><head><title>t</title></head><body><p>One&nbsp;two<br>three</p><script>x</script><div>4 &amp; 5</div></body>"
    assert html.text_of(page) == "One two\nthree\n4 & 5" and html.text_of(None) is None and html.text_of("") == ""


def test_trees_and_scopes(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, up string")
    down = {(r["ancestor"], r["node"]) for r in R.closure(tree.where("id IN ('a', 'b', 'c')"), "id", "up").collect()}
    assert down == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("b", "c"), ("a", "c")}
    assert R.closure(tree, "id", "up", depth=3).count() > 0  # a cycle ends
    books = spark.createDataFrame([(1,), (2,)], "id int")
    assert R.in_scope(books, "id", books.where("1 = 0"), "id").count() == 0  # an empty scope is nothing
    bound = spark.createDataFrame([(" 1,5 ",), ("",), ("-2",), ("x",)], "t string").select(R.parse_bound(F.col("t")).alias("x"))
    assert [r["x"] for r in bound.collect()] == [1.5, None, None, None]


def test_keyword_leg_by_cover_density(spark):
    """Words that stand close together rank before words repeated far apart."""
    rows = [(1, "red " * 9 + "x " * 60 + "fox"), (2, "a red fox ran"), (3, "red only"), (4, "fox x red")]
    docs = spark.createDataFrame(rows, "id long, text string")
    ranks = lambda query, **how: [r["id"] for r in retrieval.keyword_leg(docs, query, key="id", text="text", **how).orderBy("rank").collect()]
    assert ranks("red fox") == [2, 4, 1]
    assert ranks("red fox", most=1) == [2]
    assert ranks("red fox", by_hits=True) == [1, 2, 4]
    assert ranks('"red fox"') == [2]
    assert ranks("red -fox") == [3]
    assert set(ranks("only or ran")) == {2, 3}


def test_closure_has_no_depth_limit(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(26)], "id int, parent int")
    assert R.closure(chain, "id", "parent").count() == 351
    moves = spark.createDataFrame([(0, 25), (25, 0), (3, 3)], "node int, target int")
    assert {(r["node"], r["target"]): r["allowed"] for r in R.allowed_moves(chain, "id", "parent", moves).collect()} == {(0, 25): False, (25, 0): True, (3, 3): False}
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, None), (5, 99)], "id int, parent int")
    pairs = {(r["node"], r["ancestor"]): r["depth"] for r in R.closure(cycle, "id", "parent").collect()}
    assert pairs == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 0, (2, 3): 1, (3, 3): 0, (3, 2): 1, (4, 4): 0, (5, 5): 0}


def test_vectors_rank_by_exact_distance(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0005]), (2, [1.0, 0.0004]), (3, [0.0, 1.0])], "id int, v array<double>")
    near = retrieval.vector_leg(rows, spark.createDataFrame([([1.0, 0.0],)], "v array<double>"), key="id", vector="v")
    assert [r["id"] for r in near.orderBy("rank").collect()] == [2, 1, 3]


def test_embedder_must_answer_every_text(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(40)], "id int, text string")
    assert library.embedded(rows, "id", "text", lambda ts: [[float(len(t))] for t in ts]).count() == 40
    with pytest.raises(Exception, match="gave 1 vectors"):
        library.embedded(rows, "id", "text", lambda ts: [[1.0]]).count()


def test_append_rows_in_batches(spark, tmp_path):
    library.append_rows(spark.range(450).coalesce(1), str(tmp_path / "t"))
    library.append_rows(spark.range(5).coalesce(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 455 and len(list((tmp_path / "t").glob("part-*"))) == 4


def test_reading_edge_cases(spark):
    texts = spark.createDataFrame([(1, 'One. "Two!" three\n\nand four.\n\nFive'), (2, ""), (3, None)], "doc int, text string")
    got = [(r["doc"], r["start"], r["end"], r["sentence"]) for r in reading.sentences(texts, ["doc"], "text").orderBy("doc", "number").collect()]
    assert got == [(1, 0, 4, "One."), (1, 5, 11, '"Two!"'), (1, 12, 28, "three\n\nand four."), (1, 30, 34, "Five")]
    assert [(r["id"], r["token"]) for r in reading.tokens(texts, ["doc"], "text").orderBy("doc", "id").collect()] == [(i + 1, w) for i, w in enumerate("One Two three and four Five".split())]
    print_ = spark.createDataFrame([("a",), ("",), ("é😀",)], "t string").select(reading.fingerprint(F.col("t")).alias("f"))
    assert [r["f"] for r in print_.collect()] == ["1-e40c292c", "0-811c9dc5", "3-%x" % _fnv([0xE9, 0xD83D, 0xDE00])]


def _fnv(units):
    h = 2166136261
    for u in units:
        h = (h ^ u) * 16777619 & 0xFFFFFFFF
    return h


def test_links_and_places_after_edits(spark):
    from lectern.operators import edits
    from lectern.streaming.clicks import clicks

    responses = spark.createDataFrame([(1, "p1: 1 = 2\n p2: - \np1: 2 = 1"), (2, "p1: 9 = 1"), (3, None), (4, "hello")], "unit int, raw string")
    pairs = spark.createDataFrame([(u, p, [1, 2], [1, 2]) for u, p in [(1, "p1"), (1, "p2"), (1, "p3"), (2, "p1"), (3, "p1"), (4, "p1")]], "unit int, pair string, source array<int>, target array<int>")
    got = {(r["unit"], r["pair"]): (r["error"], [(x["source"], x["target"]) for x in r["links"] or []]) for r in edits.parsed_links(responses, pairs, "unit").collect()}
    assert got == {(1, "p1"): (None, [([1], [2]), ([2], [1])]), (1, "p2"): (None, []), (1, "p3"): ("missing", []), (2, "p1"): ("token", []), (3, "p1"): ("missing", []), (4, "p1"): ("unknown pair", [])}
    # a refrain: the second chapter that says it is found at its second place, one that is gone nowhere
    blocks = spark.createDataFrame([(1, i, t, None, True) for i, t in enumerate(["la la", "one", "la  la", "two", ""])], "unit int, pos int, text string, page int, included boolean")
    saved = spark.createDataFrame([(1, 0, 0, "lala", None, None), (1, 0, 1, "one", None, True), (1, 1, 0, "la la", None, True), (1, 2, 0, "three", None, True), (1, 3, 0, "two", None, False), (2, 0, 0, "one", None, True)], "unit int, chapter int, pos int, text string, page int, included boolean")
    rows = edits.located_chapters(blocks, saved, "unit", "chapter", "pos").collect()
    assert {(r["unit"], r["chapter"]): (r["start"], r["end"]) for r in rows} == {(1, 0): (0, 2), (1, 1): (2, 3), (1, 2): (None, None), (1, 3): (None, None), (2, 0): (None, None)}
    # a joined page loses its first block and the next one's first word; its last word grows
    old = spark.createDataFrame([(1, 0, "hy", [(0, 2)]), (1, 1, "phen then more", [(0, 4), (5, 9), (10, 14)])], "unit int, pos int, text string, words array<struct<start:long,end:long>>")
    joined = spark.createDataFrame([(1, 1, "then moreover"), (2, 0, None)], "unit int, pos int, text string")
    rows = edits.shifted_words(old, joined, "unit", "pos", "text", "words").collect()
    assert {r["unit"]: [tuple(w) for w in r["words"]] for r in rows} == {1: [(0, 4), (5, 13)], 2: []}
    requests = spark.createDataFrame([("GET", "http://x/?a=1&from=a%2Bb#from=z", None, "r", None), ("HEAD", "http://x/", "BG", None, "q"), ("GET", None, "BG", None, "q"), ("GET", "http://x/#?from=z", "BG", "r", "q")], "method string, url string, country string, referer string, agent string")
    assert sorted(map(tuple, clicks(requests).select("country", "source", "agent").collect())) == [("??", "a+b", ""), ("BG", "", "q"), ("BG", "r", "q")]


def test_clicks_are_appended_once(spark, tmp_path):
    from lectern.streaming.clicks import append_clicks

    schema = "method string, url string, country string, referer string, agent string"
    made, out, marks = (str(tmp_path / n) for n in ("requests", "clicks", "marks"))
    for country in ("BG", "DE"):
        spark.createDataFrame([("GET", "http://x/?from=mail", country, None, "a"), ("HEAD", "http://x/", country, None, "a")], schema).write.mode("append").parquet(made)
        for _ in range(2):  # a restart without new requests adds nothing
            append_clicks(spark.readStream.schema(schema).parquet(made), out, marks, availableNow=True).awaitTermination(60)
    rows = spark.read.parquet(out).select("country", "source", "agent").collect()
    assert sorted(map(tuple, rows)) == [("BG", "mail", "a"), ("DE", "mail", "a")]
