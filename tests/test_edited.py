"""Edited texts: kept and replaced words, spans carried across, and blocks of edited texts."""

import random

import pytest

from lectern.operators import edited as E

ORIGINAL = "THE RAVEN 17\n\nOnce upon a midnight dreary, while I pon-\ndered, weak and weary, over many a quaint\nand curious volume of forgotten lore.\n\n1 A footnote that the print carries at the foot of the page, long enough to matter."


def carry(words, start, end):
    spots = [to for (a, b), to in words if b > start and a < end and to]
    return (min(s for s, _ in spots), max(e for _, e in spots)) if spots else None


def to_original(now, needle, old=ORIGINAL):
    found = E.aligned(now, old)
    at = now.index(needle)
    span = carry(found.edited, at, at + len(needle))
    return span and old[span[0] : span[1]]


def test_words_are_their_letters_and_digits():
    assert E.tokens("«Hello,» — said THE-Raven 17.").keys == ["hello", "said", "theraven", "17"]
    assert E.tokens("«Hello,»").span(0) == (1, 6)


def test_unchanged_text_is_its_own_image():
    found = E.aligned(ORIGINAL, ORIGINAL)
    assert found.fit == 1 and all(a == b for a, b in found.edited + found.original)


@pytest.mark.parametrize("old, new, asked, want", [
    ("pon-\ndered", "pondered", "pondered", "pon-\ndered"),
    ("curious", "furious", "and furious volume", "and curious volume"),
    ("curious", "furious", "furious", "curious"),
    ("THE RAVEN 17\n\n", "", "forgotten lore", "forgotten lore"),
    ("forgotten lore.", "forgotten lore, as the poet wrote.", "as the poet wrote", None),
    ("forgotten lore.", "forgotten lore, as the poet wrote.", "volume of forgotten lore, as the poet wrote.", "volume of forgotten lore"),
])
def test_spans_go_to_their_origin(old, new, asked, want):
    assert to_original(ORIGINAL.replace(old, new), asked) == want


def test_dropped_text_goes_nowhere():
    now = ORIGINAL.replace("THE RAVEN 17\n\n", "")
    at = ORIGINAL.index("THE RAVEN 17")
    assert carry(E.aligned(now, ORIGINAL).original, at, at + 12) is None
    comma = ORIGINAL.index(",")
    assert carry(E.aligned(ORIGINAL, ORIGINAL).edited, comma, comma + 1) is None


def test_rewrites_and_empty_texts_are_refused(monkeypatch):
    assert E.aligned("Rewritten by hand, so the print says something else now.", ORIGINAL) is None
    assert E.aligned("", ORIGINAL) is None and E.aligned(ORIGINAL, None) is None
    monkeypatch.setattr(E, "CELLS", 10)
    assert E.aligned("a a a a a b c c c c c", "a a a a a b b b c c c c c") is not None  # equal ends need no table
    assert E.aligned("x a b a b a b a b y", "y b a b a b a b a x") is None


def test_a_cleanup_pass_is_followed():
    scanned = "F0 REWO R D\n\nThe qu1ck brown fox jum-\nped over the lazy d0g. 23\n\nIt was the best of tirnes, it was the worst of times."
    cleaned = "FOREWORD\n\nThe quick brown fox jumped over the lazy dog.\n\nIt was the best of times, it was the worst of times."
    assert E.aligned(cleaned, scanned).fit >= E.KEPT
    assert to_original(cleaned, "quick brown fox jumped over the lazy dog", scanned) == "qu1ck brown fox jum-\nped over the lazy d0g"
    assert to_original(cleaned, "best of times", scanned) == "best of tirnes"


def longest_common(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], before + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def test_random_edits_keep_order_and_as_much_as_can_be_kept():
    draw = random.Random(3)
    refused = 0
    for size in [*range(1, 60), 300, 300]:
        old = [draw.choice("abcdefghijkl") * draw.choice([1, 2, 3]) for _ in range(size)]
        now = []
        for w in old:
            r = draw.random()
            now += [] if r < 0.06 else [w + "x"] if r < 0.12 else [w, draw.choice("yz")] if r < 0.16 else [w]
        found = E.aligned(" ".join(now), " ".join(old))
        if found is None:
            refused += 1
            continue
        text = [" ".join(now), " ".join(old)]
        same = [(a, b) for a, b in found.edited if b and text[0][slice(*a)] == text[1][slice(*b)]]
        assert all(p[1][0] < q[1][0] for p, q in zip(same, same[1:]))
        best = longest_common(now, old) / len(now)
        assert found.fit <= best + 1e-9 and found.fit >= best - 0.05
        assert sum(b is not None for _, b in found.original) >= found.fit * len(now)
    assert refused < 10


def test_common_subsequence_is_longest():
    import numpy as np

    draw = random.Random(4)
    for _ in range(200):
        x, y = ([draw.randrange(4) for _ in range(draw.randrange(12))] for _ in "xy")
        pairs = E._common(np.array(x, int), np.array(y, int))
        assert len(pairs) == longest_common(x, y) and all(x[i] == y[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_long_chapter_with_scattered_corrections():
    draw = random.Random(7)
    old = [f"w{draw.randrange(400)}" for _ in range(40_000)]
    now = [w + "x" if draw.random() < 0.3 else w for w in old]
    found = E.aligned(" ".join(now), " ".join(old))
    assert 0.65 < found.fit < 0.75


def test_rows_null_texts_and_clashing_columns(spark):
    rows = [(1, ORIGINAL.replace("curious", "furious"), ORIGINAL, "x"), (2, None, ORIGINAL, "x"), (3, ORIGINAL, "", "x"), (4, "one " * 5, "one " * 5, None)]
    table = spark.createDataFrame(rows, "id long, edited string, original string, fit string")
    out = {r["id"]: r for r in E.edit_alignment(table, ["id"], "edited", "original").collect()}
    assert out[2]["fit"] is None and out[3]["edited_words"] is None and out[4]["fit"] == 1
    want = E.aligned(rows[0][1], rows[0][2])
    assert [((w["start"], w["end"]), (w["to_start"], w["to_end"]) if w["to_start"] is not None else None) for w in out[1]["edited_words"]] == want.edited
    assert E.edit_alignment(table.limit(0), ["id"], "edited", "original").count() == 0


def test_carried_as_a_column(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, ORIGINAL.replace("curious", "furious"), ORIGINAL)], "id long, edited string, original string")
    at = ORIGINAL.index("and curious volume")
    out = E.edit_alignment(table, ["id"], "edited", "original").select(E.carried(F.col("edited_words"), F.lit(at), F.lit(at + 18)).alias("s"), E.carried(F.col("edited_words"), F.lit(at + 3), F.lit(at + 4)).alias("none")).first()
    assert tuple(out["s"]) == (at, at + 18) and out["none"] is None


def block(start, end, kind="verse", mark=None):
    return {"start": start, "end": end, "kind": kind, "break_before": mark}


def test_cover_leaves_no_word_out_and_overlaps_nothing():
    draw = random.Random(9)
    for _ in range(300):
        text = "".join(draw.choice(["ab ", "cd. ", "e\n", "\n\n", " \n \n", "f"]) for _ in range(draw.randrange(1, 30))).strip()
        marks = sorted(draw.sample(range(len(text) + 1), min(len(text) + 1, draw.choice([2, 4, 6]))))
        blocks = [block(a, b, draw.choice(["prose", "verse", "note"])) for a, b in zip(marks[::2], marks[1::2])]
        out = E.cover(text, blocks)
        assert all(x["end"] <= y["start"] for x, y in zip(out, out[1:])) and all(x["start"] < x["end"] for x in out)
        left = "".join(c for i, c in enumerate(text) if not any(b["start"] <= i < b["end"] for b in out))
        assert not left.strip(), (text, blocks, out)
        for b in out:
            if b["kind"] == "prose":
                assert "\n\n" not in text[b["start"] : b["end"]]


def test_typed_in_text_falls_to_its_neighbours():
    text = "«Kept words here.» typed on.\n\nA paragraph typed in.\n\nSecond block."
    a, b = text.index("Kept"), text.index("Second")
    out = E.cover(text, [block(a, a + 15), block(b, b + 12)])
    assert [(text[x["start"] : x["end"]], x["kind"]) for x in out] == [("«Kept words here.» typed on.", "verse"), ("A paragraph typed in.", "prose"), ("Second block.", "verse")]


def test_a_word_two_blocks_claim_goes_to_the_later():
    out = E.cover("pondered weak and weary", [block(0, 8), block(0, 23, "prose")])
    assert [(x["start"], x["end"], x["kind"]) for x in out] == [(0, 23, "prose")]


def test_reader_blocks_of_rows(spark):
    old = "A heading\n\nSome prose that goes on for a while here.\n\nA verse line\nanother verse line"
    spans = [block(0, 9, "heading", "page"), block(11, 52, "prose"), block(54, 85, "verse", "line")]
    rows = [(1, "  A heading\n\nSome prose that went on for a while here. More.\n\nA verse line\nanother verse line", old, spans), (2, None, old, spans), (3, "Nothing of it is left at all now", old, spans)]
    kind = f"id long, now string, old string, spans {E.BLOCKS}"
    out = {r["id"]: r for r in E.reader_blocks(spark.createDataFrame(rows, kind), ["id"], "now", "old", "spans").collect()}
    text = out[1]["text"]
    assert [(text[b["start"] : b["end"]], b["kind"], b["break_before"]) for b in out[1]["blocks"]] == [("A heading", "heading", "page"), ("Some prose that went on for a while here. More.", "prose", None), ("A verse line\nanother verse line", "verse", "line")]
    assert out[2]["text"] == old and len(out[2]["blocks"]) == 3 and out[3]["blocks"] is None
