"""Layout trees against a recursive walk."""

import json
import random
import re

from lectern.sources import layout


def walk(node, page, out):
    if node.get("children") is not None:
        for child in node["children"]:
            walk(child, page, out)
        return
    text = re.sub(r"\s+", " ", re.sub("<[^>]*>", "", node.get("html") or "")).strip()
    if text:
        level = re.search(r"<h(\d)", node["html"])
        out.append((page, node["block_type"], text, int(level[1]) if level and node["block_type"] == "SectionHeader" else None, node["block_type"] in ("Text", "SectionHeader", "ListItem", "Handwriting")))


def plain(doc):
    out = []
    for at, page in enumerate(doc["children"]):
        if page["block_type"] == "Page" and page.get("children"):
            for block in page["children"]:
                walk(block, at + 1, out)
    return [(b, *row) for b, row in enumerate(out)]


def made(draw, depth=0):
    if depth < 6 and draw.random() < 0.35:
        return {"block_type": "Group", "html": "", "children": [made(draw, depth + 1) for _ in range(draw.randrange(0, 4))]}
    kind = draw.choice(["Text", "SectionHeader", "ListItem", "PageFooter", "Picture", "Handwriting"])
    tag = "h3" if kind == "SectionHeader" and draw.random() < 0.8 else "p"
    return {"block_type": kind, "html": draw.choice([f"<{tag}>Word {draw.randrange(99)}  and <b>more</b></{tag}>", f"<{tag}> </{tag}>"]), "section_hierarchy": {"1": "/page/0"}, "polygon": [[0, 1], [2, 3.5]], "children": None}


def test_trees_of_any_depth(spark):
    draw = random.Random(2)
    docs = [(i, {"children": [{"block_type": draw.choice(["Page", "Page", "Other"]), "children": [made(draw) for _ in range(draw.randrange(0, 6))]} for _ in range(4)]}) for i in range(25)]
    rows = [(i, json.dumps(d), 1) for i, d in docs] + [(90, None, 1), (91, "not json", 1), (92, "{}", 1), (93, '{"children": []}', 1)]
    table = spark.createDataFrame(rows, "id long, tree string, page int")
    out = {}
    for r in layout.layout_blocks(table, "id", "tree").collect():
        out.setdefault(r["id"], []).append((r["block"], r["page"], r["type"], r["text"], r["level"], r["included"]))
        assert r["polygon"] == [[0.0, 1.0], [2.0, 3.5]] and r["hierarchy"] == {"1": "/page/0"}
    assert {i: sorted(v, key=lambda x: x[0]) for i, v in out.items()} == {i: p for i, d in docs if (p := plain(d))}
    assert layout.layout_blocks(table.limit(0), "id", "tree").count() == 0


def test_verse_keeps_its_lines(spark):
    leaf = {"block_type": "Text", "html": "<p>One  line<br>another</p>", "text_kind": "verse", "break_before": "line"}
    tree = json.dumps({"children": [{"block_type": "Page", "children": [leaf, {**leaf, "text_kind": None}]}]})
    out = [(r["kind"], r["break_before"], r["text"]) for r in layout.layout_blocks(spark.createDataFrame([(1, tree)], "id long, t string"), "id", "t").orderBy("block").collect()]
    assert out == [("verse", "line", "One line\nanother"), (None, "line", "One line another")]
