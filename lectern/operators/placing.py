"""Where recognised blocks and spoken cues stand on a page: boxes of words, and rectangles of ranges of text.

A page's words and a block's lines are bounded units: each is one task's step. Defined results: a word or line without
a whole box takes no part; a page without words leaves its blocks unplaced; a block without a box, or on a page of
unknown size, gives no rectangles; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import DOUBT, Likeness, align_words, word_key
from .chunks import locate_parts
from .edited import carried, edit_alignment
from .relational import portions

#: Words that may join to one seen word; the key and window of a resynchronisation, and the least share that must be found; rectangles of a cue; slack of a box.
JOINED, KEY, WINDOW, FOUND, MOST, SLACK = 16, 8, 64, 0.6, 4, 2.0

# ---- blocks on recognised words ----


def units(text: str, keys: set[str]) -> list[tuple[str, int, int]]:
    """The words of a text (word, start, end); words that together read as one key are one, the longest such run."""
    words = [(m.start(), m.end(), word_key(m[0])) for m in re.finditer(r"\S+", text)]
    longest = max(map(len, keys), default=0)
    out, i = [], 0
    while i < len(words):
        last, joined = i, words[i][2]
        for j in range(i + 1, min(i + JOINED, len(words)) if joined else 0):
            if not words[j][2]:
                break
            joined += words[j][2]
            if len(joined) > longest:
                break
            if joined in keys:
                last = j
        out.append((text[words[i][0] : words[last][1]], words[i][0], words[last][1]))
        i = last + 1
    return out


def place_page(blocks: list[str], seen: list[tuple[str, int, tuple[float, float, float, float]]], width: float | None = None, height: float | None = None) -> list[dict]:
    """Words of the blocks in order, each with the seen words (text, line, box) it takes; a seen word is taken once."""

    def whole(box: tuple[float, ...]) -> bool:
        inside = width is None or height is None or (box[0] >= 0 and box[1] >= 0 and box[2] <= width and box[3] <= height)
        return all(map(math.isfinite, box)) and box[0] < box[2] and box[1] < box[3] and inside

    free = [i for i, s in enumerate(seen) if whole(s[2])]
    keys = {i: word_key(seen[i][0]) for i in free}
    # the page's words are compared once for all blocks
    alike = Likeness(list(keys.values()))
    alike.of([word_key(w) for text in blocks for w in (text or "").split()], [])
    out = []
    for block, text in enumerate(blocks):
        words = units(text or "", {keys[i] for i in free})
        found = align_words([w for w, _, _ in words], [seen[i][:2] for i in free], local=True, alike=alike)
        taken = set()
        for at, ((word, start, end), (hit, merged, score)) in enumerate(zip(words, found)):
            indices = [] if hit is None else [free[hit], free[hit + 1]] if merged else [free[hit]]
            taken.update(indices)
            x0, y0, x1, y1 = zip(*(seen[i][2] for i in indices)) if indices else [(None,)] * 4
            out.append({"block": block, "at": at, "text": word, "start": start, "end": end, "seen": indices, "x0": min(x0), "y0": min(y0), "x1": max(x1), "y1": max(y1), "score": score if indices else None})
        free = [i for i in free if i not in taken]
    return out


_BOX = ["x0", "y0", "x1", "y1"]


def place_blocks(blocks: DataFrame, seen: DataFrame, page: str) -> DataFrame:
    """page and the words of its blocks with their boxes. blocks: (page, block, text), in the order of block; seen: (page, word, text, line, x0, y0, x1, y1), in the order of word."""
    kind = blocks.schema[page].dataType.simpleString()
    order = blocks.schema["block"].dataType.simpleString()
    schema = f"`{page}` {kind}, block {order}, at int, text string, start int, end int, seen array<int>, x0 double, y0 double, x1 double, y1 double, score double"
    kinds = [("at", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("seen", pa.list_(pa.int32())), *[(c, pa.float64()) for c in (*_BOX, "score")]]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("block"), b.sort_by("word")
        texts, lines, *box = (b.column(c).to_pylist() for c in ("text", "line", *_BOX))
        nan = lambda x: math.nan if x is None else x
        rows = place_page(a.column("text").to_pylist(), [(t or "", int(n), tuple(map(nan, x))) for t, n, *x in zip(texts, lines, *box)])
        numbers = a.column("block").combine_chunks().take(pa.array([r["block"] for r in rows], pa.int64()))
        pages = pa.array([key[0].as_py()] * len(rows), key[0].type)
        return pa.table([pages, numbers, *[pa.array([r[c] for r in rows], t) for c, t in kinds]], names=[page, "block", *[c for c, _ in kinds]])

    asked = blocks.select(page, "block", "text")
    words = seen.select(page, "word", "text", "line", *[F.col(c).cast("double").alias(c) for c in _BOX])
    return asked.groupBy(page).cogroup(words.groupBy(page)).applyInArrow(run, schema)


def block_boxes(placed: DataFrame, page: str) -> DataFrame:
    """page, block, its box, its words and how many were found, and the words that were found with doubt, in order."""
    sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    doubt = F.array_sort(F.collect_list(F.when(F.col("score") < DOUBT, F.struct("at", "text"))))
    return placed.groupBy(page, "block").agg(*sides, F.count("*").alias("words"), F.count("score").alias("found"), F.transform(doubt, lambda d: d["text"]).alias("doubtful"))


# ---- rectangles of ranges ----

_SIGN = re.compile(r"[^\W_]")


def _signs(text: str) -> tuple[str, list[int]]:
    """The letters and digits of a text in lower case, and where each stands."""
    at = [m.start() for m in _SIGN.finditer(text)]
    return "".join(text[i].lower()[:1] for i in at), at


def resynchronised(block: str, lines: str) -> np.ndarray:
    """For each character of block its place in lines, always forward; -1 where it has none."""
    out = np.full(len(block), -1, np.int64)
    i = j = 0
    while i < len(block) and j < len(lines):
        if block[i] == lines[j]:
            out[i] = j
            i, j = i + 1, j + 1
            continue
        probe = block[i : i + KEY]
        at = lines.find(probe, j, j + WINDOW + len(probe))
        i, j = (i, at) if at >= 0 else (i + 1, j)
    return out


class BlockLines:
    """A block's text laid over the lines under it: (text, box, edges of its characters or none) each."""

    def __init__(self, text: str, lines: list[tuple[str, list[float], list[float] | None]]) -> None:
        self.lines = lines
        signs, self.places = _signs(text)
        line_signs, where = _signs("".join(t for t, _, _ in lines))
        to = resynchronised(signs, line_signs)
        self.found = (to >= 0).sum() >= FOUND * min(len(signs), len(line_signs)) and bool(lines)
        self.at = np.where(to >= 0, np.array([*where, 0])[to], -1)  # place in the lines' joined text
        self.ends = np.cumsum([len(t) for t, _, _ in lines])

    def rects(self, start: int, end: int) -> list[list[float]] | None:
        """Boxes of text[start:end]: one a line, or first line, middle and last line; None if nothing of it was found."""
        span = self.at[bisect_left(self.places, start) : bisect_left(self.places, end)]
        span = span[span >= 0]
        if not self.found or not len(span):
            return None
        out = []
        for n in range(*np.searchsorted(self.ends, [span[0], span[-1]], "right") + [0, 1]):
            text, box, edges = self.lines[n]
            first = self.ends[n] - len(text)
            a, b = max(span[0] - first, 0), min(span[-1] + 1 - first, len(text))
            if edges:
                x = sorted(edges[min(i, len(edges) - 1)] for i in (a, b))
                box = [x[0], box[1], x[1], box[3]]
            if len(text):
                out.append(list(box))
        if len(out) > 3:
            inner = np.array(out[1:-1])
            out = [out[0], [*inner[:, :2].min(0), *inner[:, 2:].max(0)], out[-1]]
        return out


RECT = "struct<page:int,x:int,y:int,w:int,h:int>"
_RECTS = pa.list_(pa.struct([(k, pa.int32()) for k in ("page", "x", "y", "w", "h")]))


def _scaled(page: int, box: list[float], width: float, height: float) -> dict:
    x0, y0, x1, y1 = (int(max(0, min(10_000, np.floor(v / (s or 1) * 10_000 + 0.5)))) for v, s in zip(box, (width, height, width, height)))
    return {"page": page, "x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}


def _covered(rects: Column) -> Column:
    def edge(pick, value):
        return pick(F.transform(rects, value))

    x, y = edge(F.array_min, lambda r: r["x"]), edge(F.array_min, lambda r: r["y"])
    w, h = edge(F.array_max, lambda r: r["x"] + r["w"]) - x, edge(F.array_max, lambda r: r["y"] + r["h"]) - y
    return F.struct(F.element_at(rects, 1)["page"].alias("page"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def cue_rects(cues: DataFrame, blocks: DataFrame, lines: DataFrame, pages: DataFrame, unit: str, *, lines_only: bool = False) -> DataFrame:
    """unit, cue and rects of each cue, at most MOST: beyond that a box for each block, then for each page.

    cues: (unit, cue, start, end) in the unit's text; blocks: (unit, block, start, end, text, page, box: x0, y0, x1, y1);
    lines: (unit, page, line, text, box, edges); pages: (unit, page, width, height). Where a block's text is not found in the lines
    under it, its own box stands for it, unless lines_only.
    """
    b = blocks.select(F.col(unit).alias("u"), "block", F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("text").alias("body"), F.col("page").alias("p"), F.col("box").alias("outer"))
    b = b.where("outer IS NOT NULL")
    n = lines.select(F.col(unit).alias("v"), F.col("page").alias("q"), "line", F.col("text").alias("t"), F.col("box").cast("array<double>").alias("box"), F.col("edges").cast("array<double>").alias("edges"))
    middle = [(F.col("box")[i] + F.col("box")[i + 2]) / 2 for i in (0, 1)]
    inside = [middle[i].between(F.col("outer")[i] - SLACK, F.col("outer")[i + 2] + SLACK) for i in (0, 1)]
    under = b.join(n, (F.col("u") == F.col("v")) & (F.col("p") == F.col("q")) & inside[0] & inside[1])
    under = under.groupBy("u", "block").agg(F.array_sort(F.collect_list(F.struct("line", "t", "box", "edges"))).alias("under"))
    c = cues.select(F.col(unit).alias("w"), "cue", "start", "end")
    asked = c.join(b.select("u", "block", "lo", "hi"), (F.col("u") == F.col("w")) & (F.col("hi") > F.col("start")) & (F.col("end") > F.col("lo")))
    asked = asked.groupBy("u", "block").agg(F.collect_list(F.struct("cue", (F.greatest("start", "lo") - F.col("lo")).alias("from"), (F.least("end", "hi") - F.col("lo")).alias("to"))).alias("asked"))
    size = pages.select(F.col(unit).alias("u"), F.col("page").alias("p"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    rows = asked.join(b, ["u", "block"]).join(size, ["u", "p"]).join(under, ["u", "block"], "left").select("u", "block", "p", "body", F.col("outer").cast("array<double>").alias("outer"), "width", "height", "asked", "under")
    kinds = [rows.schema[k].dataType.simpleString() for k in ("u", "block")]
    cue = cues.schema["cue"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out: list[tuple] = []
            for at, row in enumerate(batch.to_pylist()):
                laid = BlockLines(row["body"] or "", [(x["t"] or "", x["box"], x["edges"]) for x in row["under"] or []])
                for ask in row["asked"]:
                    rects = laid.rects(ask["from"], ask["to"]) or ([] if lines_only else [row["outer"]])
                    out.append((at, ask["cue"], [_scaled(row["p"], r, row["width"], row["height"]) for r in rects]))
            take = pa.array([o[0] for o in out], pa.int64())
            asked_type = batch.schema.field("asked").type.value_type.field("cue").type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([o[1] for o in out], asked_type), pa.array([o[2] for o in out], _RECTS)], names=["u", "block", "cue", "rects"])

    found = rows.mapInArrow(run, f"u {kinds[0]}, block {kinds[1]}, cue {cue}, rects array<{RECT}>").where(F.size("rects") > 0)
    parts = found.groupBy("u", "cue").agg(F.array_sort(F.collect_list(F.struct("block", "rects"))).alias("parts"))
    every = F.flatten(F.transform("parts", lambda p: p["rects"]))
    of_blocks = F.transform("parts", lambda p: _covered(p["rects"]))
    numbers = F.array_distinct(F.transform(of_blocks, lambda r: r["page"]))
    of_pages = F.slice(F.transform(numbers, lambda p: _covered(F.filter(of_blocks, lambda r: r["page"] == p))), 1, MOST)
    capped = F.when(F.size(every) <= MOST, every).when(F.size("parts") <= MOST, of_blocks).otherwise(of_pages)
    out = c.join(parts.withColumnRenamed("cue", "__cue"), (F.col("u") == F.col("w")) & (F.col("cue") == F.col("__cue")), "left")
    return out.select(F.col("w").alias(unit), "cue", F.coalesce(capped, F.array().cast(f"array<{RECT}>")).alias("rects"))


def placed_cues(texts: DataFrame, unit: str, edited: str, original: str, cues: str) -> DataFrame:
    """unit, cue (from 0), start and end in the original text of each cue that has a place there.

    cues: texts in the order they were spoken. A cue that stands in the edited text goes to the original through the
    alignment; one that only the original still has is found there; the others, and words typed in, have no place.
    """
    rows = texts.select(F.col(unit).alias("u"), F.col(edited).alias("now"), F.col(original).alias("old"), F.col(cues).alias("cues"))
    here = locate_parts(rows, text="now", parts="cues", keep=["u"]).withColumnRenamed("spans", "in_now")
    there = locate_parts(rows, text="old", parts="cues", keep=["u"]).withColumnRenamed("spans", "in_old")
    words = edit_alignment(rows, ["u"], "now", "old").select("u", "edited_words")
    spans = here.join(there, "u").join(words, "u").select("u", "edited_words", F.posexplode(F.arrays_zip("in_now", "in_old")).alias("cue", "at"))
    span = F.when(F.col("at.in_now").isNotNull(), carried(F.col("edited_words"), F.col("at.in_now.start"), F.col("at.in_now.end"))).otherwise(F.col("at.in_old"))
    return spans.select(F.col("u").alias(unit), "cue", span.alias("s")).where("s IS NOT NULL").select(unit, "cue", "s.start", "s.end")
