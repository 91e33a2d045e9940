"""Blocks on recognised words, and rectangles of cues."""

import random
import re
import unicodedata

import pytest

from lectern.operators import placing
from lectern.operators.align import similarity


def line(n, *words):
    x, out = 100, []
    for w in words:
        out.append((w, n, (x, n * 30, x + len(w) * 10, n * 30 + 20)))
        x += len(w) * 10 + 10
    return out


def test_words_that_were_not_seen_stay_without_a_place():
    placed = placing.place_page(["Беше тъмна нощ", "Ново заглавие"], line(0, "Беше", "нощ"))
    assert [w["x0"] for w in placed if not w["seen"]] == [None] * 3
    assert [w["seen"] for w in placed if w["block"] == 0] == [[0], [], [1]]


def test_blocks_are_placed_each_for_itself():
    placed = placing.place_page(["Right poem", "Left poem"], line(0, "Left", "poem") + line(1, "Right", "poem"))
    assert [w["seen"] for w in placed] == [[2], [3], [0], [1]]


def test_a_spaced_heading_is_placed_on_whole_words():
    placed = placing.place_page(["П Е С Н И Н А Ф И Л Е К"], line(2, "ПЕСНИ", "НА", "ФИЛЕК"))
    assert [w["text"] for w in placed] == ["П Е С Н И", "Н А", "Ф И Л Е К"] and [w["seen"] for w in placed] == [[0], [1], [2]]


def test_a_joined_word_takes_both_halves():
    placed = placing.place_page(["обособена част"], line(0, "обо-") + line(1, "собена", "част"))
    assert placed[0]["seen"] == [0, 1] and (placed[0]["x0"], placed[0]["y0"], placed[0]["y1"]) == (100, 0, 50)


def test_words_outside_the_page_or_without_a_box_take_no_part():
    seen = line(0, "one", "two") + [("three", 0, (5, 5, 5, 9)), ("four", 0, (float("nan"), 0, 1, 1))]
    assert [w["seen"] for w in placing.place_page(["one two three four"], seen, 135, 50)] == [[0], [], [], []]


def key(word):
    return "".join(c for c in unicodedata.normalize("NFD", word).lower() if unicodedata.category(c)[0] in "LN")


def best_local(model, seen):
    """The best total of a local alignment, cell by cell."""
    n, m = len(model), len(seen)
    keys = [key(w) for w, _ in seen]
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = score[i - 1][0] - 0.3
        for j in range(1, m + 1):
            ways = [score[i - 1][j] - 0.3, score[i][j - 1] - 0.3]
            s = similarity(key(model[i - 1]), keys[j - 1])
            if s >= 0.7:
                ways.append(score[i - 1][j - 1] + s)
            score[i][j] = max(ways)
    return max(score[n])


def test_placed_words_reach_the_best_total():
    draw = random.Random(5)
    for _ in range(40):
        pool = ["alpha", "beta", "gamma", "delta", "epsilon", "zetas", "thetax"]
        model = [draw.choice(pool) for _ in range(draw.randrange(1, 9))]
        seen = [(draw.choice(pool), k, (k, 0, k + 1, 1)) for k in range(draw.randrange(1, 12))]
        placed = placing.place_page([" ".join(model)], seen)
        taken = [w["seen"][0] for w in placed if w["seen"]]
        total = sum(w["score"] for w in placed if w["seen"]) - 0.3 * (len(placed) - len(taken)) - (0.3 * (taken[-1] - taken[0] + 1 - len(taken)) if taken else 0)
        assert taken == sorted(set(taken)) and total == pytest.approx(best_local([w["text"] for w in placed], [s[:2] for s in seen]))


LINES = ["The first line of print,", "the second holds more words", "and the third ends it.", "A fourth line follows on", "and the last one is here."]


def laid(text=None):
    lines = [(t, [100, 30 * i, 100 + 10 * len(t), 30 * i + 20], [100 + 10 * k for k in range(len(t) + 1)]) for i, t in enumerate(LINES)]
    return placing.BlockLines(" ".join(LINES) if text is None else text, lines)


def rects(needle, text=None, **how):
    body = " ".join(LINES) if text is None else text
    at = body.index(needle)
    return laid(text).rects(at, at + len(needle))


def test_a_range_in_a_line_is_trimmed_to_its_characters():
    assert rects("second holds") == [[100 + 40, 30, 100 + 160, 50]]


def test_a_range_over_lines_has_a_rectangle_each_and_a_tall_one_three():
    assert [r[1] for r in rects("print, the second")] == [0, 30]
    tall = rects(" ".join(LINES))
    assert len(tall) == 3 and tall[1] == [100, 30, 100 + 270, 110]


def test_a_repeated_word_is_placed_where_it_stands():
    text = " ".join(LINES)
    at = text.index("the third")
    assert laid().rects(at, at + 3) == [[140, 60, 170, 80]]


def test_marks_and_broken_words_do_not_matter():
    lines = [("Marked bold and bro-", [0, 0, 200, 20], None), ("ken words", [0, 30, 90, 50], None)]
    text = "**Marked** bold and broken words"
    block = placing.BlockLines(text, lines)
    assert block.rects(text.index("broken"), len(text)) == [[0, 0, 200, 20], [0, 30, 90, 50]]


def test_a_text_that_is_hardly_there_is_not_found():
    text = "Something else entirely, that nobody printed on this page at all"
    assert laid(text).rects(0, len(text)) is None
    assert placing.BlockLines("text", []).rects(0, 4) is None


def cue_table(spark, cues, blocks, lines, pages, **how):
    c = spark.createDataFrame(cues, "u long, cue int, start int, end int")
    b = spark.createDataFrame(blocks, "u long, block int, start int, end int, text string, page int, box array<double>")
    n = spark.createDataFrame(lines, "u long, page int, line int, text string, box array<double>, edges array<double>")
    p = spark.createDataFrame(pages, "u long, page int, width double, height double")
    return {(r["u"], r["cue"]): [tuple(x) for x in r["rects"]] for r in placing.cue_rects(c, b, n, p, "u", **how).collect()}


def test_cues_of_rows(spark):
    text = "One line here"
    blocks = [(1, i, 20 * i, 20 * i + 13, text, 3 + i // 4, [0.0, 100.0 * (i % 4), 500.0, 100.0 * (i % 4) + 90]) for i in range(8)] + [(1, 8, 900, 913, text, 3, None), (1, 9, 950, 963, text, 77, [0.0, 0.0, 1.0, 1.0])]
    lines = [(1, 3, 0, text, [0.0, 10.0, 130.0, 30.0], [10.0 * k for k in range(14)]), (1, 3, 1, "other", [0.0, 900.0, 50.0, 920.0], None)]
    pages = [(1, 3, 1000.0, 1000.0), (1, 4, 1000.0, 500.0)]
    cues = [(1, 0, 4, 8), (1, 1, 0, 33), (1, 2, 0, 200), (1, 3, 905, 910), (1, 4, 955, 960), (2, 0, 0, 5), (1, 5, 13, 20)]
    got = cue_table(spark, cues, blocks, lines, pages)
    assert got[1, 0] == [(3, 400, 100, 400, 200)]
    assert got[1, 1] == [(3, 0, 100, 1300, 200), (3, 0, 1000, 5000, 900)]
    assert got[1, 2] == [(3, 0, 100, 5000, 3800), (4, 0, 0, 5000, 7800)]  # eight blocks: a box for each page
    assert [got[k] for k in ((1, 3), (1, 4), (2, 0), (1, 5))] == [[]] * 4
    assert cue_table(spark, cues, blocks, lines, pages, lines_only=True)[1, 1] == [(3, 0, 100, 1300, 200)]
    assert cue_table(spark, cues, [], [], []) == {k: [] for k in got} and cue_table(spark, [], blocks, lines, pages) == {}


def test_cues_of_an_edited_text(spark):
    old = "It was the best of tirnes, it was the worst of times. The end came soon after that."
    new = "It was the best of times, it was the worst of times. Typed in by hand. The end came soon after that."
    cues = ["It was the best of times,", "it was the worst of times.", "Typed in by hand.", "nowhere at all", "The end came soon after that."]
    rows = [(1, new, old, cues), (2, None, old, ["best of tirnes", "worst"]), (3, "All of it was rewritten by someone", old, ["rewritten by", "the worst of"]), (4, new, old, None)]
    table = spark.createDataFrame(rows, "u long, now string, old string, cues array<string>")
    got = {(r["u"], r["cue"]): old[r["start"] : r["end"]] for r in placing.placed_cues(table, "u", "now", "old", "cues").collect()}
    assert got == {(1, 0): "It was the best of tirnes", (1, 1): "it was the worst of times", (1, 4): "The end came soon after that", (2, 0): "best of tirnes", (2, 1): "worst", (3, 1): "the worst of"}


def test_blocks_of_rows(spark):
    blocks = spark.createDataFrame([(1, 5, "alpha beta"), (1, 2, "gamma delta"), (2, 1, "alone"), (3, 1, None)], "page long, block long, text string")
    words = [(1, i, t, n, *map(float, box)) for i, (t, n, box) in enumerate(line(0, "gamma", "deltx") + line(1, "alpha", "beta"))]
    seen = spark.createDataFrame(words, "page long, word long, text string, line int, x0 double, y0 double, x1 double, y1 double")
    out = {(r["page"], r["block"]): r for r in placing.block_boxes(placing.place_blocks(blocks, seen, "page"), "page").collect()}
    assert (out[1, 5]["y0"], out[1, 5]["found"], out[1, 5]["doubtful"]) == (30.0, 2, []) and (out[1, 2]["found"], out[1, 2]["doubtful"]) == (2, ["delta"])
    assert out[2, 1]["x0"] is None and out[2, 1]["words"] == 1 and (3, 1) not in out
    assert placing.place_blocks(blocks.limit(0), seen, "page").count() == 0


def test_the_letters_bound_never_exceeds_the_distance():
    import numpy as np

    from lectern.operators.align import _unshared, edit_distance

    draw = random.Random(8)
    words = ["".join(draw.choice("abcdéя") for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    bound = _unshared(np.array(words), np.array(words), 4)
    assert all(bound[i, j] <= edit_distance(x, y) for i, x in enumerate(words) for j, y in enumerate(words))
    assert re.fullmatch(r"[^\W_]+", words[0])
