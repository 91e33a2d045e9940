"""Rules of reading order, margin numbers and cut words, on small pages."""

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import ocr_order as O


def test_order_violations(spark):
    lines = spark.createDataFrame([(1, 1, [0, 0, 300, 20]), (1, 2, [500, 0, 800, 20]), (1, 3, [0, 30, 300, 50]), (1, 4, [0, 60, 300, 80]), (2, 1, [0, 0, 300, 20])], "page int, line int, box array<int>")
    order = [(1, 0, 1, 0, "prose"), (1, 0, 2, 0, "prose"), (1, 1, 3, 1, "prose"), (1, 2, 3, 0, "prose"), (1, 3, 9, 0, "furniture"), (2, 0, 1, 0, "prose")]
    order = spark.createDataFrame(order, "page int, group int, line int, section int, kind string")
    found = {(r["page"], r["rule"], r["group"], r["line"]) for r in O.order_violations(lines, order, ["page"]).collect()}
    assert found == {(1, "omitted", None, 4), (1, "invented", 3, 9), (1, "repeated", 2, 3), (1, "columns", 0, 2), (1, "section", 2, None)}
    assert O.order_violations(lines.where("page = 2"), order.where("page = 2"), ["page"]).count() == 0
    assert O.order_violations(lines.limit(0), order.limit(0), ["page"]).count() == 0


def test_verse_counters(spark):
    rows = [(1, 1, "First line of verse", [140, 0, 400, 20]), (1, 2, "second line", [142, 25, 400, 45]), (1, 3, "5 the fifth line", [110, 50, 400, 70]), (1, 4, "7 not a counter", [110, 75, 400, 95]), (1, 5, "10 alone", [500, 75, 600, 95]), (1, 6, None, None)]
    lines = spark.createDataFrame(rows, "page int, line int, text string, box array<int>")
    (r,) = O.verse_counters(lines, ["page"]).collect()
    assert (r["line"], r["number"], r["margin"], r["rest"]) == (3, 5, 142, "the fifth line")


def test_join_continuations(spark):
    rows = [
        ("a", 1, 1, "paragraph", None, "It was won-", True), ("a", 2, 1, "paragraph", None, "derful to see", False),
        ("a", 3, 1, "paragraph", None, "an end-", True), ("a", 4, 1, "paragraph", None, "ing", False), ("a", 4, 2, "heading", None, "Head-", True),
        ("a", 5, 1, "paragraph", None, "line stays", False), ("b", 1, 1, "paragraph", "verse", "as ver-", True), ("b", 2, 1, "paragraph", None, "se does", None),
    ]
    blocks = spark.createDataFrame(rows, "unit string, page int, block int, type string, kind string, text string, continues boolean")
    got = [(r["page"], r["text"]) for r in O.join_continuations(blocks, "unit").orderBy("unit", "page", "block").collect()]
    assert got == [(1, "It was wonderful"), (2, "to see"), (3, "an ending"), (4, "Head-"), (5, "line stays"), (1, "as ver-"), (2, "se does")]


def test_block_type(spark):
    df = spark.createDataFrame([(" Section-Header",), ("List item",), ("BODY",), ("table",)], "t string")
    assert [r[0] for r in df.select(O.block_type(F.col("t"))).collect()] == ["heading", "list_item", "paragraph", "other"]


BOXES = {1: [50, 100, 200, 120], 2: [600, 100, 800, 120], 3: [50, 125, 200, 145], 4: [600, 125, 800, 145]}


def parts(kind, ids, boxes=None, texts=None):
    found = O.split_group(kind, "paragraph", [(i, (texts or {}).get(i, "some text"), np.array((boxes or BOXES)[i])) for i in ids])
    return [(k, b, ids_, fault is not None) for k, b, ids_, fault in found]


def test_groups_in_columns_are_taken_apart():
    assert parts("verse", [1, 3, 2, 4]) == [("verse", "paragraph", [1, 3], False), ("verse", "line", [2, 4], False)]
    assert parts("metadata", [1, 3, 2, 4]) == [("metadata", "paragraph", [1, 3], False), ("metadata", "paragraph", [2, 4], False)]
    assert parts("metadata", [1, 2, 3, 4]) == [("metadata", "paragraph", [1, 3], False), ("metadata", "paragraph", [2, 4], False)]
    assert parts("prose", [1, 2]) == [("prose", "paragraph", [1, 2], False)]
    assert parts("furniture", [1, 2]) == [("furniture", "paragraph", [1], False), ("furniture", "paragraph", [2], False)]


def test_verse_that_goes_back_to_the_left_is_a_fault():
    assert parts("verse", [1, 2, 3, 4]) == [("verse", "paragraph", [1, 2, 3, 4], True)] and parts("verse", [2, 1]) == [("verse", "paragraph", [2, 1], True)]


def test_a_line_across_both_columns_keeps_metadata_whole():
    wide = BOXES | {5: [50, 150, 800, 170]}
    assert parts("metadata", [1, 3, 5], wide) == [("metadata", "paragraph", [1, 3, 5], False)]


def test_signs_at_the_edge_are_furniture():
    boxes = BOXES | {9: [980, 100, 990, 120]}
    assert parts("prose", [1, 9, 3], boxes, {9: "|"}) == [("prose", "paragraph", [1, 3], False), ("furniture", "paragraph", [9], False)]
    assert parts("prose", [9], boxes, {9: " "}) == [("furniture", "paragraph", [9], False)]


def test_split_columns_of_rows(spark):
    lines = spark.createDataFrame([(p, i, "text", b) for p in (1, 2) for i, b in BOXES.items()], "page int, line long, text string, box array<int>")
    order = [(1, 0, at, line, 3, "verse", "stanza") for at, line in enumerate([1, 3, 2, 4])] + [(2, 5, 0, 1, 0, "prose", "paragraph"), (2, 7, 0, 99, 0, "prose", "paragraph")]
    order = spark.createDataFrame(order, "page int, group int, at int, line long, section int, kind string, break_before string")
    out = [tuple(r) for r in O.split_columns(lines, order, "page").orderBy("page", "group").collect()]
    assert out == [(1, 0, 3, "verse", "stanza", [1, 3], None), (1, 1, 3, "verse", "line", [2, 4], None), (2, 0, 0, "prose", "paragraph", [1], None)]
    assert O.split_columns(lines, order.limit(0), "page").count() == 0


def test_interleaved_columns(spark):
    lines = spark.createDataFrame([(1, i, b) for i, b in BOXES.items()], "page int, line int, box array<int>")
    found = {}
    for name, ids in (("across", [[1], [2], [3], [4]]), ("down", [[1, 3], [2, 4]])):
        rows = [(1, g, i, 0, "verse") for g, group in enumerate(ids) for i in group]
        found[name] = [tuple(r) for r in O.order_violations(lines, spark.createDataFrame(rows, "page int, group int, line int, section int, kind string"), ["page"]).collect()]
    assert found == {"across": [(1, "interleaved", 0, 1)], "down": []}


def faults(spark, groups):
    rows = spark.createDataFrame([(1, n, s, k, b) for n, (s, k, b) in enumerate(groups)], "page int, group int, section int, kind string, break_before string")
    out = O.semantic_order(rows, "page").orderBy("group").collect()
    return [r["fault"] for r in out], [r["break_before"] for r in out]


def test_semantic_order(spark):
    verse, notes, prose = (0, "verse", "paragraph"), (0, "metadata", "paragraph"), (0, "prose", "paragraph")
    assert faults(spark, [verse, notes, verse])[0] == [None, None, "metadata within verse"]
    assert faults(spark, [verse, notes, (1, "verse", None)])[0] == [None] * 3
    assert faults(spark, [verse, notes, prose, verse, (0, "verse", "line")])[0] == [None] * 5
    assert faults(spark, [verse, notes, prose, (0, "verse", "line")])[0][3] == "metadata within verse"
    assert faults(spark, [(0, "metadata", None), (0, "heading", None), verse])[0] == [None] * 3
    assert faults(spark, [(1, "verse", None), (0, "furniture", None), (0, "verse", None)])[0] == [None, None, "earlier section"]
    for kind in ("heading", "prose"):
        assert faults(spark, [(0, kind, "paragraph"), (0, "verse", "line"), (0, "verse", "line"), (0, "verse", "stanza")])[1] == ["paragraph", "paragraph", "line", "stanza"]
    assert faults(spark, [(0, "verse", None), (1, "verse", "line")])[1] == [None, "paragraph"]


def test_columns_are_found_by_a_sweep(spark):
    import random

    from lectern.operators import library as L

    draw = random.Random(4)
    rows = [(p, float(draw.randrange(0, 900)), float(draw.randrange(0, 900))) for p in range(150) for _ in range(draw.randrange(1, 6))]
    rows = [(p, x, y, x + draw.choice([0, 40, 300]), y + draw.choice([0, 5, 30, 300]), "other") for p, x, y in rows] + [(None, 0.0, 0.0, 5.0, 5.0, "x")]
    table = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, y string")
    got = {r["page"] for r in L.pages_with_columns(table, "page").collect()}
    want = {a[0] for a in rows for b in rows if a[0] == b[0] and a[3] + 80 < b[1] and min(a[4], b[4]) > max(a[2], b[2])}
    assert got == want and len(want) > 20
    assert "Join" not in L.pages_with_columns(table, "page")._jdf.queryExecution().executedPlan().toString()


def test_whole_digests(spark):
    import hashlib

    from lectern.operators import library as L

    rows = [("a", i, f"text {i}" * 50) for i in range(30)] + [("b", 1, None), (None, 1, "x"), (None, 2, "y")]
    got = {r["u"]: tuple(r)[1:] for r in L.whole_digests(spark.createDataFrame(rows, "u string, n int, t string").repartition(5), "u", "n", "t").collect()}
    for unit in ("a", "b", None):
        own = [(n, t or "") for u, n, t in rows if u == unit]
        whole = "\n\n".join(f"# file {n}\n{t}" for n, t in own)
        assert got[unit] == (sum(len(t) for _, t in own), len(own), hashlib.sha256(whole.encode()).hexdigest())
