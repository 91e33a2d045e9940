"""A book's printed table of contents against its headings: which heading an entry means, and how pages are numbered.

Titles are compared with headings by a join within the book; a book's anchors are then chained, and its entries placed in
order, one book at a time. Defined results: an entry without a title matches nothing; without a printed page it is
placed by its title alone, before the next entry whose page is known; a book with fewer than LEAST chained anchors has no page
map; rows with a null book take no part; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Similarity of an anchor and of a match near its page, how far the second best must be, pages an offset may drift, anchors of a map and of an entry, headings offered.
SURE, LIKELY, MARGIN, DRIFT, LEAST, MOST, OFFERED = 0.75, 0.6, 0.15, 4, 3, 6, 12
#: Pages around an expected one: near and far, between anchors and outside them.
INSIDE, OUTSIDE = (2, 4), (4, 6)


def title_words(text: Column) -> Column:
    """The different words of two signs or more, or with a digit."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) | w.rlike(r"\p{N}")))


def _unnumbered(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^\s*\p{N}+\s*[.)]?\s+(?=\S)", "")
    return F.when(bare != "", bare).otherwise(text)


def similarity(title: Column, heading: Column) -> Column:
    """The share of a title's words that a heading has, numbers before them aside.

    A heading far longer than the title counts less, a title of one word is found only in short headings, and
    a title that a heading spells with other spaces counts full.
    """
    a, b = (_unnumbered(F.coalesce(x, F.lit(""))) for x in (title, heading))
    t, h = title_words(a), title_words(b)
    n, m = F.size(t), F.size(h)
    both = F.size(F.array_intersect(t, h))
    share = both / n
    x, y = (F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "") for s in (a, b))
    spelt = (F.length(x) >= 6) & F.contains(y, x) & (F.length(y) <= F.length(x) * 1.5 + 3)
    long_ = F.when(m > 2 * n + 3, share * 0.6).otherwise(share)
    return F.when(n == 0, 0.0).when(n == 1, F.when((both == 1) & (m <= 3), 1.0).otherwise(0.0)).when(spelt, 1.0).otherwise(long_)


def candidates(entries: DataFrame, headings: DataFrame, unit: str) -> DataFrame:
    """unit, entry, block, page and the best similarity over the entry's titles, where there is any. entries: (unit, entry, titles); headings: (unit, block, text, page)."""
    e = entries.select(F.col(unit).alias("u"), "entry", F.explode("titles").alias("title"))
    h = headings.select(F.col(unit).alias("v"), "block", "text", F.col("page").alias("at"))
    near = e.join(h, F.col("u") == F.col("v")).select("u", "entry", "block", "at", similarity(F.col("title"), F.col("text")).alias("similarity")).where("similarity > 0")
    return near.groupBy(F.col("u").alias(unit), "entry", "block", F.col("at").alias("page")).agg(F.max("similarity").alias("similarity"))


def anchors(entries: DataFrame, headings: DataFrame, unit: str) -> DataFrame:
    """unit, entry, printed, page: the headings that are surely an entry's, a few for each with a printed page. entries: (unit, entry, title, page)."""
    titled = entries.where(F.col("page").isNotNull() & (F.size(title_words(F.col("title"))) >= 2))
    near = candidates(titled.select(unit, "entry", F.array("title").alias("titles")), headings, unit).where(F.col("similarity") >= SURE)
    best = Window.partitionBy(unit, "entry").orderBy(F.desc("similarity"), "block")
    few = near.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= MOST).select(F.col(unit).alias("__u"), F.col("entry").alias("__e"), F.col("page").alias("__p"))
    printed = titled.select(unit, "entry", F.col("page").alias("printed"))
    return printed.join(few, (F.col(unit) == F.col("__u")) & (F.col("entry") == F.col("__e"))).select(unit, "entry", "printed", F.col("__p").alias("page"))


Point = tuple[int, int, int]  # entry, printed page, page


def longest_chain(points: list[Point], per_page: int) -> list[Point]:
    """The longest chain of points, sorted by printed page, of different entries whose pages do not go back and whose offset drifts little from one to the next."""
    if not points:
        return []
    entry, printed, page = np.array(points).T
    offset = page - printed / per_page
    length, before = np.ones(len(points), int), np.full(len(points), -1)
    for j in range(1, len(points)):
        fits = (entry[:j] != entry[j]) & (page[:j] <= page[j]) & (np.abs(offset[:j] - offset[j]) <= DRIFT)
        if fits.any():
            i = int(np.where(fits, length[:j], 0).argmax())
            length[j], before[j] = length[i] + 1, i
    at, chain = int(length.argmax()), []
    while at >= 0:
        chain.append(points[at])
        at = before[at]
    return chain[::-1]


def page_map(points: Iterable[Point], pages: int | None = None) -> tuple[int, list[Point]] | None:
    """Printed pages a page, and the chain; two are tried only if the printed pages run past the book's own."""
    sorted_ = sorted(points, key=lambda p: (p[1], p[2]))
    if len(sorted_) < LEAST:
        return None
    rates = (1, 2) if pages is not None and sorted_[-1][1] > pages else (1,)
    rate, chain = max(((r, longest_chain(sorted_, r)) for r in rates), key=lambda x: (len(x[1]), -x[0]))
    return (rate, chain) if len(chain) >= LEAST else None


def expected(found: tuple[int, list[Point]], printed: int) -> tuple[int, bool]:
    """The page of a printed page number, by the last anchor at or before it (else the first), and whether it lies between anchors."""
    rate, chain = found
    _, q, p = [chain[0], *(a for a in chain if a[1] <= printed)][-1]
    return int(np.floor(p + (printed - q) / rate + 0.5)), chain[0][1] <= printed <= chain[-1][1]


def offsets(found: tuple[int, list[Point]]) -> str:
    """The map in a few words: one offset, a few with their pages, or the first and the last."""
    rate, chain = found
    runs: list[list[int]] = []
    for _, q, p in chain:
        offset = int(np.floor(p - q / rate + 0.5))
        if runs and runs[-1][0] == offset:
            runs[-1][2] = q
        else:
            runs.append([offset, q, q])
    sign = lambda n: f"+{n}" if n > 0 else str(n)
    if len(runs) == 1:
        text = sign(runs[0][0])
    elif len(runs) > 3:
        text = f"{sign(runs[0][0])} at p{runs[0][1]} drifting to {sign(runs[-1][0])} at p{runs[-1][1]}"
    else:
        text = ", ".join(f"{sign(o)} (p{a}{'+' if i == len(runs) - 1 else f'–{b}'})" for i, (o, a, b) in enumerate(runs))
    return text if rate == 1 else f"{rate} printed pages per PDF page, {text}"


def place_entries(entries: list[tuple[int | None, dict[int, float]]], headings: list[tuple[int, int]], found: tuple[int, list[Point]] | None) -> list[tuple[int | None, int | None, list[int]]]:
    """For each entry its heading's block or None, its expected page, and otherwise the blocks to choose from.

    entries, in order: printed page, and the similar headings (block: similarity); headings: (block, page) in order.
    A heading is an entry's if it is similar enough and clearly the best of those near the expected page, after the one before.
    """
    pages = dict(headings)
    ceilings: list[int | None] = []
    ahead = None
    for printed, _ in reversed(entries):
        ceilings.append(ahead)
        if printed is not None and found:
            ahead = expected(found, printed)[0]
    out: list[tuple[int | None, int | None, list[int]]] = []
    last = -1
    for (printed, likes), ceiling in zip(entries, reversed(ceilings)):
        page = None
        if printed is not None and found:
            page, inside = expected(found, printed)
            near, far = INSIDE if inside else OUTSIDE
            close = [b for b, p in headings if abs(p - page) <= near]
            pool = close if len(close) >= 2 else [b for b, p in headings if abs(p - page) <= far]
        else:
            pool = [b for b, p in headings if ceiling is None or p <= ceiling]
        pool = [b for b in pool if b > last]
        ranked = sorted((b for b in pool if likes.get(b, 0) > 0), key=lambda b: (-likes[b], b))
        best = ranked[0] if ranked else None
        clear = len(ranked) < 2 or likes[ranked[1]] <= likes[best] - MARGIN or pages[ranked[1]] == pages[best]
        if best is not None and clear and likes[best] >= (SURE if page is None else LIKELY):
            out.append((best, page, []))
            last = best
            continue
        if page is not None:
            few = sorted(pool, key=lambda b: (abs(pages[b] - page), b))[:OFFERED]
        else:
            few = ranked[:OFFERED] or pool[:OFFERED]
        out.append((None, page, sorted(few)))
    return out


def locate_contents(entries: DataFrame, headings: DataFrame, unit: str, pages: DataFrame | None = None) -> DataFrame:
    """unit, entry, heading (the block of its heading, or null), expected (page) and offered (blocks to choose from).

    entries: (unit, entry, title, titles, page); titles: the spellings a heading may agree with, null for the title
    alone; headings: (unit, block, text, page); pages: (unit, pages) of the book, if known.
    """
    titles = F.coalesce("titles", F.array("title")) if "titles" in entries.columns else F.array("title")
    listed = entries.where(F.col(unit).isNotNull()).select(unit, "entry", "title", titles.alias("titles"), F.col("page").cast("int").alias("page"))
    likes = candidates(listed, headings, unit).groupBy(unit, "entry").agg(F.collect_list(F.struct("block", "similarity")).alias("likes"))
    points = anchors(listed, headings, unit).groupBy(unit).agg(F.collect_list(F.struct("entry", "printed", F.col("page").cast("int").alias("page"))).alias("points"))
    heads = headings.groupBy(F.col(unit).alias(unit)).agg(F.array_sort(F.collect_list(F.struct(F.col("block").cast("long").alias("block"), F.col("page").cast("int").alias("page")))).alias("heads"))
    own = listed.join(likes, [unit, "entry"], "left").groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("entry", "page", "likes"))).alias("entries"))
    books = own.join(heads, unit, "left").join(points, unit, "left")
    size = F.lit(None).cast("int").alias("pages")
    if pages is not None:
        books, size = books.join(pages.select(unit, F.col("pages").cast("int").alias("pages")), unit, "left"), F.col("pages")
    books = books.select(unit, "entries", "heads", "points", size)
    kinds = [listed.schema[c].dataType.simpleString() for c in (unit, "entry")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, entry, out = [], [], []
            for at, row in enumerate(batch.to_pylist()):
                found = page_map([(p["entry"], p["printed"], p["page"]) for p in row["points"] or []], row["pages"])
                asked = [(e["page"], {x["block"]: x["similarity"] for x in e["likes"] or []}) for e in row["entries"]]
                out += place_entries(asked, [(h["block"], h["page"]) for h in row["heads"] or []], found)
                entry += [e["entry"] for e in row["entries"]]
                of += [at] * len(asked)
            kind = batch.schema.field("entries").type.value_type.field("entry").type
            heading, page, offered = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(entry, kind), pa.array(heading, pa.int64()), pa.array(page, pa.int32()), pa.array(offered, pa.list_(pa.int64()))], names=[unit, "entry", "heading", "expected", "offered"])

    return books.mapInArrow(run, f"`{unit}` {kinds[0]}, entry {kinds[1]}, heading bigint, expected int, offered array<bigint>")


def salvage_json(response: str) -> object | None:
    """The JSON in an answer: fenced, or from the first to the last brace or bracket; None if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", response, re.S)
    for text in [*([fenced[1]] if fenced else []), response]:
        for opening, closing in ("{}", "[]"):
            a, b = text.find(opening), text.rfind(closing)
            if 0 <= a < b:
                try:
                    return json.loads(text[a : b + 1])
                except ValueError:
                    continue
    return None
