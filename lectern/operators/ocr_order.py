"""Reading order of a page's recognised lines: queries that return what breaks its rules, margin numbers of verse, words cut at page ends.

Boxes are arrays (left, top, right, bottom) in thousandths of the page. Lines meet only other lines of their page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import upper_median

GAP = 100
NARROW = 450


def beside(a: str, b: str) -> Column:
    """Two boxes share over half of the lower one's height, with a gap between columns."""
    edge = lambda side, i: F.col(f"{side}.box")[i]
    shared = F.least(edge(a, 3), edge(b, 3)) - F.greatest(edge(a, 1), edge(b, 1))
    height = F.least(edge(a, 3) - edge(a, 1), edge(b, 3) - edge(b, 1))
    gap = F.greatest(edge(a, 0) - edge(b, 2), edge(b, 0) - edge(a, 2))
    return (shared > height / 2) & (gap > GAP)


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}") == F.col(f"{b}.{k}")
    return out


def _left_of(left: Column, right: Column) -> Column:
    shared = F.least(left[3], right[3]) - F.greatest(left[1], right[1])
    return (right[0] - left[2] > GAP) & (shared > F.least(left[3] - left[1], right[3] - right[1]) / 2)


def _under(top: Column, bottom: Column) -> Column:
    return (bottom[1] > top[1]) & (bottom[1] - top[3] < F.greatest(top[3] - top[1], bottom[3] - bottom[1]))


def _besides(boxes: np.ndarray) -> np.ndarray:
    """Which of the boxes stand beside which."""
    x0, y0, x1, y1 = boxes.T
    shared = np.minimum(y1[:, None], y1) - np.maximum(y0[:, None], y0)
    height = np.minimum((y1 - y0)[:, None], y1 - y0)
    gap = np.maximum(x0[:, None] - x1, x0 - x1[:, None])
    return (shared > height / 2) & (gap > GAP)


def _free_cut(boxes: np.ndarray) -> float | None:
    """Where lines of one group part in two columns: half way between two lines beside each other, if no line crosses and the columns are far enough apart."""
    near = _besides(boxes) & (boxes[:, None, 0] < boxes[None, :, 0])
    for a, b in np.argwhere(near):
        cut = (boxes[a, 2] + boxes[b, 0]) / 2
        left, right = boxes[:, 2] <= cut, boxes[:, 0] >= cut
        if (left | right).all() and boxes[right, 0].min() - boxes[left, 2].max() > GAP:
            return cut
    return None


def _in_columns(boxes: np.ndarray) -> tuple[list[int], int | None]:
    """Where verse goes on in the next column to the right, and the first line that goes back to the left instead (then nothing is split)."""
    near = _besides(boxes)
    starts, floor = [0], -np.inf
    for i, box in enumerate(boxes):
        if (box[0] + box[2]) / 2 < floor:
            return [0], i
        beside_ = starts[-1] + np.flatnonzero(near[i, starts[-1] : i])
        if len(beside_):
            other = boxes[beside_[0]]
            if box[0] < other[0]:
                return [0], i
            starts.append(i)
            floor = (other[2] + box[0]) / 2
    return starts, None


def _is_edge(text: str, box: np.ndarray) -> bool:
    return box[2] - box[0] <= 20 and (box[0] >= 975 or box[2] <= 25) and len(text.strip()) <= 1


def split_group(kind: str, break_before: str, lines: list[tuple[int, str, np.ndarray]]) -> list[tuple[str, str, list[int], str | None]]:
    """A group's parts (kind, break before, lines, fault): furniture a line each, single signs at a page's edge as furniture, verse and metadata by column."""
    if kind == "furniture":
        return [(kind, break_before, [i], None) for i, _, _ in lines]
    edge = [x[0] for x in lines if _is_edge(x[1], x[2])]
    body = [x for x in lines if x[0] not in edge]
    out: list[tuple[str, str, list[int], str | None]] = []
    ids, boxes = [i for i, _, _ in body], np.array([b for *_, b in body], float).reshape(-1, 4)
    cut = _free_cut(boxes) if kind == "metadata" and body else None
    if cut is not None:
        left = boxes[:, 2] <= cut
        out = [(kind, break_before, [i for i, x in zip(ids, left) if x], None), (kind, "paragraph", [i for i, x in zip(ids, left) if not x], None)]
    elif body and kind in ("verse", "metadata"):
        starts, back = _in_columns(boxes)
        parts = [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]
        then = "line" if kind == "verse" else "paragraph"
        out = [(kind, break_before if n == 0 else then, part, None if back is None else f"goes back to the left at line {ids[back]}") for n, part in enumerate(parts)]
    elif body:
        out = [(kind, break_before, ids, None)]
    return out + [("furniture", "paragraph", [i], None) for i in edge]


def split_columns(lines: DataFrame, order: DataFrame, page: str) -> DataFrame:
    """page, group (from 0), section, kind, break_before, lines and fault: the order's groups, those in several columns taken apart.

    lines: page, line, text, box; order: page, group, at, line, section, kind, break_before. Lines that the page does not have go.
    """
    rows = order.join(lines.select(page, "line", "text", "box"), [page, "line"])
    one = F.struct("group", "at", "line", "text", F.col("box").cast("array<double>").alias("box"), "section", "kind", "break_before")
    pages = rows.groupBy(page).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    kind = pages.schema[page].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for at, listed in enumerate(batch.column(1).to_pylist()):
                groups: dict[int, list[dict]] = {}
                for row in listed:
                    groups.setdefault(row["group"], []).append(row)
                n = 0
                for group in groups.values():
                    for part in split_group(group[0]["kind"], group[0]["break_before"], [(r["line"], r["text"] or "", np.array(r["box"])) for r in group]):
                        out.append((n, group[0]["section"], *part))
                        of.append(at)
                        n += 1
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(list(c), t) for c, t in zip(columns, types)]], names=[page, "group", "section", "kind", "break_before", "lines", "fault"])

    return pages.mapInArrow(run, f"`{page}` {kind}, group int, section int, kind string, break_before string, lines array<bigint>, fault string")


def semantic_order(groups: DataFrame, page: str) -> DataFrame:
    """groups (page, group, section, kind, break_before) with break_before put right, and fault where their order breaks a rule.

    A line's break stands only between verse and verse of one section. Sections do not go back. Metadata or
    a footnote ends the verse of its section, until a heading, or prose followed by verse in a paragraph of its own, begins anew.
    """
    line = Window.partitionBy(page).orderBy("group")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    kind, text = F.col("kind"), F.col("kind") != "furniture"
    before = lambda c: F.lag(c).over(line)
    goes_on = (kind == "verse") & (before("kind") == "verse") & (before("section") == F.col("section"))
    breaks = F.when((F.col("break_before") == "line") & ~F.coalesce(goes_on, F.lit(False)), "paragraph").otherwise(F.col("break_before"))
    last_section = F.coalesce(F.last(F.when(text, F.col("section")), ignorenulls=True).over(past), F.lit(-1))
    quoted = F.coalesce((before("kind") == "prose") & (F.col("break_before") == "paragraph"), F.lit(False))
    rows = groups.withColumn("__from", last_section).withColumn("__quoted", quoted).withColumn("__break", breaks)
    event = F.when(~text, F.lit(None)).when(kind.isin("metadata", "footnote"), True).when((kind == "heading") | (F.col("section") != F.col("__from")) | ((kind == "verse") & F.col("__quoted")), False)
    rows = rows.withColumn("__event", event).withColumn("__ended", F.coalesce(F.last("__event", ignorenulls=True).over(past), F.lit(False)))
    cut = (kind == "verse") & F.col("__ended") & ~F.col("__quoted") & (F.col("section") == F.col("__from"))
    fault = F.when(text & (F.col("section") < F.col("__from")), "earlier section").when(cut, "metadata within verse")
    return rows.withColumn("break_before", F.col("__break")).withColumn("fault", fault).drop("__from", "__quoted", "__break", "__event", "__ended")


def order_violations(lines: DataFrame, order: DataFrame, page: list[str]) -> DataFrame:
    """page, rule, group and line of everything wrong with an order of lines; no rows: the order is good.

    lines: page, line, box. order: page, group, line, section, kind. Rules: omitted (a line without place),
    invented (a place without line), repeated, columns (two lines of a group stand side by side; the
    later one is named), interleaved (four groups of one line each, in turn from two columns: the first is named)
    and section (a group goes back to an earlier section; furniture doesn't count).
    """
    ids = [*page, "line"]
    nothing = F.lit(None).cast("int")

    def told(rows: DataFrame, rule: str, group: Column, line: Column) -> DataFrame:
        return rows.select(*page, F.lit(rule).alias("rule"), group.cast("int").alias("group"), line.cast("int").alias("line"))

    out = told(lines.join(order, ids, "left_anti"), "omitted", nothing, F.col("line"))
    out = out.union(told(order.join(lines, ids, "left_anti"), "invented", F.col("group"), F.col("line")))
    again = order.groupBy(*ids).agg(F.count("*").alias("n"), F.max("group").alias("group")).where("n > 1")
    out = out.union(told(again, "repeated", F.col("group"), F.col("line")))
    placed = order.select(*page, "group", "line").join(lines.select(*ids, "box"), ids)
    pairs = placed.alias("a").join(placed.alias("b"), _same([*page, "group"], "a", "b") & (F.col("a.line") < F.col("b.line")) & beside("a", "b"))
    columns = pairs.select(*[F.col(f"b.{c}").alias(c) for c in (*page, "group", "line")]).distinct()
    out = out.union(told(columns, "columns", F.col("group"), F.col("line")))
    singles = placed.groupBy(*page, "group").agg(F.count("*").alias("n"), F.first("line").alias("line"), F.first("box").alias("box"))
    nexts = Window.partitionBy(*page).orderBy("group")
    four = singles.select("*", *[F.lead(F.when(F.col("n") == 1, F.col("box")), k).over(nexts).alias(f"b{k}") for k in (1, 2, 3)]).where("n = 1")
    a, b, c, d = F.col("box"), F.col("b1"), F.col("b2"), F.col("b3")
    crossing = _left_of(a, b) & _left_of(c, d) & _under(a, c) & _under(b, d)
    out = out.union(told(four.where(crossing), "interleaved", F.col("group"), F.col("line")))
    before = Window.partitionBy(*page).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = order.where("kind <> 'furniture'").select(*page, "group", "section").distinct()
    back = groups.withColumn("highest", F.max("section").over(before)).where("section < highest")
    return out.union(told(back, "section", F.col("group"), nothing))


def verse_counters(lines: DataFrame, page: list[str]) -> DataFrame:
    """page, line, number, margin and rest (the text without the number) of numbers in the margin of verse.

    A number is a multiple of five before text with a letter, on a narrow line that stands 12 to 60
    left of at least two narrow lines near it (0.6 to 6 of its heights away) that have no number; margin is the upper median of their starts.
    """
    width = lambda side: F.col(f"{side}.box")[2] - F.col(f"{side}.box")[0]
    number = F.regexp_extract("text", r"^\s*(\d{1,9})\s+(?=[^\n]*\p{L})", 1).try_cast("int")
    asks = lines.withColumn("number", number).where((F.col("number") > 0) & (F.col("number") % 5 == 0))
    plain = lines.where(~F.rlike("text", F.lit(r"^\s*\d")))
    indent = F.col("o.box")[0] - F.col("c.box")[0]
    away = F.abs(F.col("o.box")[1] - F.col("c.box")[1])
    height = F.col("c.box")[3] - F.col("c.box")[1]
    near = (width("c") <= NARROW) & (width("o") <= NARROW) & indent.between(12, 60) & (away >= height * 0.6) & (away <= height * 6)
    met = asks.alias("c").join(plain.alias("o"), _same(page, "c", "o") & near)
    met = met.select(*[F.col(f"c.{k}").alias(k) for k in (*page, "line", "number", "text")], F.col("o.box")[0].alias("start"))
    found = met.groupBy(*page, "line", "number", "text").agg(F.count("*").alias("n"), upper_median("start").alias("margin")).where("n >= 2")
    return found.select(*page, "line", "number", "margin", F.regexp_replace("text", r"^\s*\d+\s+", "").alias("rest"))


def join_continuations(blocks: DataFrame, unit: str) -> DataFrame:
    """blocks (unit, page, block, type, kind, text, continues) with a word that a page end cuts put together on the first page.

    A block that had no more than the word's end goes. Verse and headings stay as they are.
    """
    line = Window.partitionBy(unit).orderBy("page", "block")
    rows = blocks
    for c in ("page", "type", "kind", "text"):
        rows = rows.withColumn(f"__{c}", F.lead(c).over(line))
    fixed = lambda kind, type_: (F.coalesce(F.col(kind), F.lit("")) == "verse") | (F.coalesce(F.col(type_), F.lit("")) == "heading")
    cut = F.col("continues") & (F.col("__page") == F.col("page") + 1) & F.rlike("text", F.lit(r"\p{L}-$")) & ~fixed("kind", "type") & ~fixed("__kind", "__type")
    rows = rows.withColumn("__cut", F.coalesce(cut, F.lit(False)))
    rows = rows.withColumn("__head", F.coalesce(F.lag("__cut").over(line), F.lit(False)))
    rows = rows.where(~F.col("__head") | F.contains("text", F.lit(" ")))
    own = F.when(F.col("__head"), F.expr("substring(text, instr(text, ' ') + 1)")).otherwise(F.col("text"))
    whole = F.concat(F.regexp_replace(own, "-$", ""), F.substring_index("__text", " ", 1))
    return rows.withColumn("text", F.when(F.col("__cut"), whole).otherwise(own)).select(*blocks.columns)


def block_type(raw: Column) -> Column:
    """heading, list_item, paragraph or other, from the names that recognisers use."""
    name = F.regexp_replace(F.lower(F.trim(raw)), r"[\s-]+", "_")
    return (
        F.when(name.isin("heading", "header", "title", "section_header"), "heading")
        .when(name.isin("list_item", "listitem", "list", "item"), "list_item")
        .when(name.isin("paragraph", "text", "body", "para"), "paragraph")
        .otherwise("other")
    )
