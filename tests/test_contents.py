"""Contents lists against headings: similarity, page maps and placing."""

import random
import re

import pytest

from lectern.operators import contents as C

PAIRS = [
    ("The Carrot or the Stick: Motivation Direction", "The Carrot or the Stick:  Motivation Direction", 1), ("Chapter 1", "Chapter 1", 1), ("Chapter 1", "Chapter 2", 0.5),
    ("Self", "Self", 1), ("Self", "Self, other and the world at large", 0), ("3. Ethics of Inarticulacy", "ETHI CS OF INARTICULACY", 1), ("14. Rationalized Christianity", "RATIONALIZED CHRI STIANITY", 1),
    ("8. Descartes's Disengaged Reason", "DESCARTES 'S D ISENGAGED REASON", 1), ("3. Ethics of Inarticulacy", "3. ETHICS OF INARTICULACY", 1), ("3. Ethics of Inarticulacy", "4. MORAL SOURCES", 0), ("Notes", "Footnotes and endnotes", 0),
    ("", "Anything", 0), ("3.", "3.", 1), ("Any title", None, 0), (None, "x", 0),
]


def plain_similarity(title, heading):
    def strip(t):
        return re.sub(r"^\s*\d+\s*[.)]?\s+(?=\S)", "", t or "") or (t or "")

    a, b = strip(title), strip(heading)
    words = lambda t: list(dict.fromkeys(w for w in re.split(r"[\W_]+", t.lower()) if len(w) > 1 or re.search(r"\d", w)))
    t, h = words(a), words(b)
    both = sum(w in h for w in t)
    if len(t) < 2:
        return float(bool(t) and both == 1 and len(h) <= 3)
    x, y = (re.sub(r"[\W_]+", "", s.lower()) for s in (a, b))
    if len(x) >= 6 and x in y and len(y) <= len(x) * 1.5 + 3:
        return 1.0
    return both / len(t) * (0.6 if len(h) > 2 * len(t) + 3 else 1)


def test_similarity(spark):
    from pyspark.sql import functions as F

    draw = random.Random(1)
    pool = ["the", "a", "Motivation", "of", "Chapter", "3", "12.", "road", "Reason", "s", "é", "self"]
    pairs = [(a, b) for a, b, _ in PAIRS] + [tuple(" ".join(draw.choice(pool) for _ in range(draw.randrange(0, 8))) for _ in "ab") for _ in range(400)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", C.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    got = {r["i"]: r["s"] for r in rows}
    assert [got[i] for i in range(len(PAIRS))] == [w for *_, w in PAIRS]
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(plain_similarity(a, b)), (a, b)


def points(printed, page):
    return [(i, q, page(i, q)) for i, q in enumerate(printed)]


def test_the_true_chain_wins_over_headings_repeated_in_the_notes():
    found = C.page_map([(1, 3, 16), (1, 3, 538), (2, 25, 38), (2, 25, 539), (3, 53, 66), (3, 53, 543), (4, 91, 104), (4, 91, 548)])
    assert C.offsets(found) == "+13" and [e for e, _, _ in found[1]] == [1, 2, 3, 4]
    assert C.page_map([(1, 3, 16), (1, 3, 17), (1, 3, 18)]) is None and C.page_map([(1, 1, 6), (2, 9, 14)]) is None and C.page_map([]) is None


def test_a_drifting_offset_is_followed():
    found = C.page_map([(3, 3, 8), (4, 15, 20), (5, 19, 171), (6, 45, 50), (7, 89, 92), (8, 97, 100), (9, 145, 145)])
    assert len(found[1]) == 6 and [C.expected(found, p)[0] for p in (48, 92, 150)] == [53, 95, 150]
    assert C.offsets(found) == "+5 (p3–45), +3 (p89–97), 0 (p145+)"
    assert C.offsets(C.page_map(points([3, 15, 29, 45, 60, 96, 123, 124, 129, 133, 145, 155], lambda i, q: q + max(0, 6 - i)))) == "+6 at p3 drifting to 0 at p123"


def test_two_printed_pages_a_page_only_where_the_book_is_too_short():
    printed = [3, 23, 28, 37, 45, 54, 63, 71, 83, 89, 100, 111, 116, 138, 159, 179, 192, 237, 242, 249, 253, 261, 268, 275]
    spread = points(printed, lambda i, q: q // 2 + 34)
    assert "printed pages" not in C.offsets(C.page_map(spread))
    found = C.page_map(spread, 247)
    assert len(found[1]) == len(printed) and C.offsets(found) == "2 printed pages per PDF page, +34" and [C.expected(found, p)[0] for p in (46, 300)] == [57, 184]
    assert C.offsets(C.page_map(points([6 + i * 6 for i in range(20)], lambda i, q: q + (10 if q < 60 else 4)), 130)) == "+4"


HEADINGS = [(10, "Chapter 1", 5), (20, "Chapter 2", 9), (30, "Chapter 3", 13), (35, "Pattern Recognition", 16), (40, "Cliapter Fuor", 17), (50, "Chapter 5", 21)]
MAP = C.page_map([(14, 3, 5), (15, 7, 9), (16, 11, 13)])


def placed(entries, headings=HEADINGS, found=MAP):
    asked = [(page, {b: s for b, t, _ in headings if (s := max(plain_similarity(x, t) for x in titles)) > 0}) for titles, page in entries]
    return C.place_entries(asked, [(b, p) for b, _, p in headings], found)


def test_entries_are_placed_near_their_page_and_in_order():
    assert [p[0] for p in placed([(["Chapter 1", "Chapter One"], 3), (["Chapter 2"], 7)])] == [10, 20]
    assert placed([(["Chapter 4", "Chapter Four"], 15)]) == [(None, 17, [30, 35, 40, 50])]
    assert [p[0] for p in placed([(["Chapter 3"], 11), (["Chapter 1"], 3)])] == [30, None]


def test_before_the_first_anchor_the_search_is_wider():
    front = [(2, "Contents", 1), (4, "Acknowledgments", 3), (6, "Introduction", 7), *HEADINGS]
    assert placed([(["Introduction"], 1)], front)[0][0] == 6
    assert not C.expected(MAP, 1)[1] and C.expected(MAP, 7)[1]


def test_the_nearest_headings_are_offered_where_running_heads_fill_the_pages():
    heads = [(page * 10 + k, "INTRODUCTION TO THE EDITION", page) for page in (13, 14, 15, 16, 17) for k in range(3)] + [(180, "Ackn0wledgments", 18)]
    offered = placed([(["Acknowledgments"], 15)], [*heads, *HEADINGS[:0]])[0][2]
    assert len(offered) == 12 and offered[-1] == 180


def test_without_a_map_titles_alone_place():
    assert placed([(["Chapter 2"], None), (["Chapter Four"], None)], found=None) == [(20, None, []), (None, None, [30, 50])]


def test_books_as_rows(spark):
    books = [(1, 0), (2, 100)]
    entries = [(b, i, t, None, p) for b, shift in books for i, (t, p) in enumerate([("Chapter 1", 3), ("Chapter 2", 7), ("Chapter 3", 11), ("Chapter 4", 15)])] + [(3, 0, "Alone here", None, None), (None, 0, "x y", None, 1)]
    headings = [(b, n, t, p + shift) for b, shift in books for n, t, p in HEADINGS] + [(4, 1, "No list", 1)]
    e = spark.createDataFrame(entries, "book int, entry int, title string, titles array<string>, page int")
    h = spark.createDataFrame(headings, "book int, block int, text string, page int")
    out = {(r["book"], r["entry"]): (r["heading"], r["expected"], r["offered"]) for r in C.locate_contents(e, h, "book").collect()}
    assert [out[2, i][0] for i in range(4)] == [10, 20, 30, None] and out[2, 3] == (None, 117, [35, 40, 50]) and out[3, 0] == (None, None, [])
    assert C.locate_contents(e.limit(0), h, "book").count() == 0 and C.locate_contents(e, h.limit(0), "book").where("heading IS NOT NULL").count() == 0
