"""What stays valid after an edit: words of a cue, word spans of joined pages, saved chapters, word links, reading order, edges in time.

Offsets are code points from 0, ends exclusive; ``unit`` names the book, chapter or page that rows belong to.
Every join and window is by unit; only the order of one book's saved chapters is folded in one row.

Defined results: null texts count as empty; units without rows on the other side give null or empty results as each
function states; rows that are equal in unit and position are undefined, since a position names one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_range(text: Column, start: Column, end: Column, words: Column, number: Column) -> Column:
    """struct(start, end) of the word of this number (from 0) in the span from start to end of a text.

    The words are searched for in turn, each after the one before. Null if there are fewer words, if one on the way is
    empty, null or not found, or if one ends beyond the span.
    """

    def search(at: Column, word: Column) -> Column:
        found = F.call_function("locate", word, text, at["end"] + 1) - 1
        stop = found + F.length(word)
        return F.when((F.length(word) > 0) & (found >= at["end"]) & (stop <= end), F.struct(found.alias("start"), stop.alias("end")))

    first = start.cast("int")
    asked = F.slice(words, F.lit(1), F.greatest(number.cast("int") + 1, F.lit(0)))
    return F.when((number >= 0) & (F.size(words) > number), F.aggregate(asked, F.struct(first.alias("start"), first.alias("end")), search))


def shifted_words(old: DataFrame, joined: DataFrame, unit: str, order: str, text: str, words: str) -> DataFrame:
    """unit, order, text and words of the joined blocks: the old blocks' word spans as they lie in the joined text.

    Joining pages may take whole blocks or first words from a page's head and lengthen its last word. Blocks
    are paired from the page's end; a joined block without an old one has no words.
    """
    line, page = Window.partitionBy(unit).orderBy(order), Window.partitionBy(unit)

    def placed(df: DataFrame, place: str) -> DataFrame:
        return df.withColumn(place, F.row_number().over(line) - F.count("*").over(page))  # 0 is the last one

    before = placed(old, "__p").select(F.col(unit).alias("__u"), "__p", F.coalesce(text, F.lit("")).alias("__old"), F.col(words).alias("__words"), F.count("*").over(page).alias("__n"))
    after = placed(joined, "__q").select(unit, order, F.coalesce(text, F.lit("")).alias(text), "__q", F.count("*").over(page).alias("__m"))
    # more blocks than before: the first ones pair, and the last ones stay alone
    lined = after.withColumn("__q", F.col("__q") + F.col("__m"))
    both = lined.join(before.withColumn("__p", F.col("__p") + F.col("__n")), (lined[unit] == F.col("__u")) & (F.col("__q") + F.greatest(F.col("__n") - F.col("__m"), F.lit(0)) == F.col("__p")), "left")
    head = lambda c: F.regexp_extract(c, "(?s)^(.* )", 1)
    was, now = F.col("__old"), F.col(text)
    gone = F.when(F.endswith(was, now), F.length(was) - F.length(now)).when(F.endswith(head(was), head(now)), F.length(head(was)) - F.length(head(now))).otherwise(0)

    def moved(w: Column) -> Column:
        stop = F.when(w["end"] == F.length(was), F.length(now)).otherwise(F.least(F.length(now), w["end"] - gone))
        return F.struct(F.greatest(F.lit(0), w["start"] - gone).cast("long").alias("start"), stop.cast("long").alias("end"))

    kept = F.transform(F.filter("__words", lambda w: w["end"] > gone), moved)
    return both.select(unit, order, text, F.coalesce(kept, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias(words))


def parsed_links(responses: DataFrame, pairs: DataFrame, unit: str) -> DataFrame:
    """unit, pair, links and error: each pair's word links as read from the unit's response, or its first fault.

    responses: unit, raw, with lines ``p1: 1 2 = 3`` (numbers of source and target tokens), ``p1: -`` (no links) and ``p1: 4 = -`` (not linked).
    pairs: unit, pair (p1, p2, ...), source and target (arrays of the token numbers they hold). A line for
    an unknown pair spoils its unit. Faults: unknown pair, missing, no answer, form, empty side, token.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    numbers = r"^\d+(?:[\s,]+\d+)*$"
    lines = responses.select(unit, F.posexplode(F.split(F.coalesce("raw", F.lit("")), "\n")).alias("line", "said")).withColumn("said", trim(F.col("said"))).where("said <> ''")
    lines = lines.select(unit, "line", F.regexp_extract("said", r"^(p\d+):\s*(.*)$", 1).alias("pair"), F.regexp_extract("said", r"^(p\d+):\s*(.*)$", 2).alias("answer"))
    sides = F.split("answer", "=", -1)
    lines = lines.withColumns({"left": trim(F.get(sides, F.lit(0))), "right": trim(F.get(sides, F.lit(1))), "sides": F.size(sides)})
    read = lambda c: F.array_distinct(F.transform(F.split(c, r"[\s,]+"), lambda n: n.try_cast("long")))
    unlinked = (F.col("right") == "-") & F.col("left").rlike(numbers) | (F.col("left") == "-") & F.col("right").rlike(numbers)
    fits = lambda mine, all_: F.size(F.array_except(mine, F.col(all_).cast("array<bigint>"))) == 0
    both = pairs.select(unit, "pair", "source", "target").join(lines, [unit, "pair"], "left")
    fault = (
        F.when(F.col("line").isNull(), "missing")
        .when(F.col("answer") == "", "no answer")
        .when(F.col("answer") == "-", None)
        .when(F.col("sides") != 2, "form")
        .when((F.col("left") == "") | (F.col("right") == ""), "empty side")
        .when(unlinked, None)
        .when(~fits(read(F.col("left")), "source") | ~fits(read(F.col("right")), "target"), "token")
    )
    link = F.when(fault.isNull() & (F.col("answer") != "-") & ~unlinked, F.struct("line", read(F.col("left")).alias("source"), read(F.col("right")).alias("target")))
    found = both.groupBy(unit, "pair").agg(F.min_by(fault, F.when(fault.isNotNull(), F.coalesce("line", F.lit(-1)))).alias("error"), F.sort_array(F.collect_list(link)).alias("links"))
    spoilt = lines.join(pairs, [unit, "pair"], "left_anti").select(unit).distinct().withColumn("spoilt", F.lit(True))
    error = F.when(F.col("spoilt"), "unknown pair").otherwise(F.col("error"))
    plain = F.transform("links", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target")))
    return found.join(spoilt, unit, "left").select(unit, "pair", F.when(error.isNull(), plain).alias("links"), error.alias("error"))


def semantic_order(groups: DataFrame, unit: str, order: str) -> DataFrame:
    """groups (kind, section, breaks) with break_before as it may stand, and the fault of each unit's first wrong group.

    A line break before a group holds only between verses of one section; else it is a paragraph's. Sections
    must not go back, and verse must not go on after metadata or a footnote, unless a heading, a new section or a
    passage quoted in prose begins. Furniture of the page is passed over.
    """
    line = Window.partitionBy(unit).orderBy(order)
    kind, section, breaks = F.col("kind"), F.col("section"), F.col("breaks")
    verse = kind == "verse"
    goes_on = verse & (F.lag("kind").over(line) == "verse") & (F.lag("section").over(line) == section)
    quotes = verse & (F.lag("kind").over(line) == "prose") & (breaks == "paragraph")
    rows = groups.withColumns({"break_before": F.when((breaks == "line") & ~F.coalesce(goes_on, F.lit(False)), "paragraph").otherwise(breaks), "__quotes": F.coalesce(quotes, F.lit(False))})
    real = kind != "furniture"
    earlier = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    was = F.last(F.when(real, section), ignorenulls=True).over(earlier)
    rows = rows.withColumn("__was", was).withColumn("__new", real & (F.coalesce("__was", F.lit(-1)) != section))
    # true: metadata came; false: something that ends it
    sign = F.when(kind.isin("metadata", "footnote"), True).when(real & ((kind == "heading") | F.col("__new") | F.col("__quotes")), False)
    rows = rows.withColumn("__sign", sign).withColumn("__open", F.coalesce(F.last("__sign", ignorenulls=True).over(earlier), F.lit(False)))
    fault = F.when(real & (section < F.coalesce("__was", F.lit(-1))), "earlier section").when(verse & F.col("__open") & ~F.col("__new") & ~F.col("__quotes"), "metadata in verse")
    rows = rows.withColumn("__fault", fault)
    first = F.count("__fault").over(earlier) == 0
    return rows.withColumn("fault", F.when(first, F.col("__fault"))).drop("__quotes", "__was", "__new", "__sign", "__open", "__fault")


def located_chapters(blocks: DataFrame, saved: DataFrame, unit: str, chapter: str, order: str) -> DataFrame:
    """unit, chapter, start and end: the run of blocks that equals a saved chapter's in text (but for white space), page and inclusion.

    Each chapter is searched for after the one before it, then from the top; null if nowhere. An
    unknown inclusion equals any. A run is found as a shift that all blocks of a chapter agree in: one join and one count.
    """
    squeezed = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")
    here = blocks.select(F.col(unit).alias("__u"), (F.row_number().over(Window.partitionBy(unit).orderBy(order)) - 1).alias("__i"), squeezed.alias("__t"), F.col("page").alias("__page"), F.col("included").alias("__in"))
    want = saved.select(unit, chapter, (F.row_number().over(Window.partitionBy(unit, chapter).orderBy(order)) - 1).alias("__j"), squeezed.alias("__s"), "page", "included")
    sizes = want.groupBy(unit, chapter).agg(F.count("*").cast("int").alias("size"))
    agrees = (F.col(unit) == F.col("__u")) & (F.col("__s") == F.col("__t")) & F.col("page").eqNullSafe(F.col("__page"))
    met = want.join(here, agrees).where(F.coalesce(F.col("included") == F.col("__in"), F.lit(True)))
    shifts = met.groupBy(unit, chapter, (F.col("__i") - F.col("__j")).alias("start")).agg(F.count("*").alias("n"))
    starts = shifts.join(sizes, [unit, chapter]).where("n = size AND start >= 0").groupBy(unit, chapter).agg(F.sort_array(F.collect_list("start")).alias("starts"))
    each = sizes.join(starts, [unit, chapter], "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))
    books = each.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct(chapter, "size", "starts"))).alias("all"))

    def place(so_far: Column, c: Column) -> Column:
        later = F.filter(c["starts"], lambda s: s >= so_far["cursor"])
        at = F.coalesce(F.get(later, F.lit(0)), F.get(c["starts"], F.lit(0)))
        return F.struct(F.coalesce(at + c["size"], so_far["cursor"]).alias("cursor"), F.concat(so_far["found"], F.array(at)).alias("found"))

    found = F.aggregate("all", F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("found")), place, lambda x: x["found"])
    rows = books.select(unit, F.explode(F.arrays_zip("all", found.alias("found"))).alias("x"))
    return rows.select(unit, F.col(f"x.all.{chapter}").alias(chapter), F.col("x.found").alias("start"), (F.col("x.found") + F.col("x.all.size")).alias("end"))


def edge_times(spans: DataFrame, lanes: DataFrame, unit: str) -> DataFrame:
    """spans (start, end) with start_ms, start_by, end_ms and end_by: when a narrated lane reaches them, and how that is known.

    lanes: unit, text, chunks: those found in the text, in order, as structs of start, end, start_ms, end_ms and words (the same four).
    By "provider-word" (a word's own time), "chunk-boundary" (the chunk begins or ends there, also at its last word),
    "interpolated" (by characters other than white space between known points of the chunk), or "unavailable": no chunk there, or
    a span without letters and digits.
    """
    text = F.col("__text")

    def silent(a: Column, b: Column) -> Column:
        return (a <= b) & ~F.substring(text, a + 1, F.greatest(b - a, F.lit(0))).rlike(r"[\p{L}\p{N}]")

    def first(items: Column) -> Column:
        return F.get(items, F.lit(0))

    def weight(a: Column) -> Column:
        return F.length(F.regexp_replace(F.substring(text, F.lit(1), a), r"\s", ""))

    def points(c: Column) -> Column:
        at = lambda x, edge: F.struct(x[edge].alias("at"), x[edge + "_ms"].alias("ms"))
        inner = F.flatten(F.transform(c["words"], lambda w: F.array(at(w, "start"), at(w, "end"))))
        return F.concat(F.array(at(c, "start")), inner, F.array(at(c, "end")))

    def between(known: Column, a: Column) -> Column:
        low = first(F.reverse(F.filter(known, lambda p: p["at"] <= a)))
        high = first(F.filter(known, lambda p: p["at"] >= a))
        span = weight(high["at"]) - weight(low["at"])
        part = (high["ms"] - low["ms"]) * (weight(a) - weight(low["at"])) / F.nullif(span, F.lit(0))
        return F.when(span > 0, F.floor(low["ms"] + part + 0.5)).otherwise(low["ms"])

    a, z = F.col("start"), F.col("end")
    rows = spans.join(lanes.select(unit, F.coalesce("text", F.lit("")).alias("__text"), F.col("chunks").alias("__chunks")), unit, "left")
    rows = rows.withColumn("__spoken", ~silent(a, z)).withColumns(
        {
            "__a": F.coalesce(first(F.filter("__chunks", lambda c: (c["start"] <= a) & (a < c["end"]))), first(F.filter("__chunks", lambda c: (c["start"] >= a) & silent(a, c["start"])))),
            "__z": F.coalesce(first(F.filter("__chunks", lambda c: (c["start"] < z) & (z <= c["end"]))), first(F.reverse(F.filter("__chunks", lambda c: (c["end"] <= z) & silent(c["end"], z))))),
        }
    )
    ca, cz = F.col("__a"), F.col("__z")
    rows = rows.withColumns(
        {
            "__wa": first(F.filter(ca["words"], lambda w: (w["end"] > a) & silent(a, F.greatest(a, w["start"])))),
            "__wz": first(F.reverse(F.filter(cz["words"], lambda w: (w["start"] < z) & silent(F.least(z, w["end"]), z)))),
            "__bounds": (z >= cz["end"]) | silent(z, cz["end"]),
        }
    )
    wa, wz = F.col("__wa"), F.col("__wz")

    def edge(chunk: Column, cases: list[tuple[Column, Column, str]], by_points: Column) -> tuple[Column, Column]:
        none = ~F.coalesce("__spoken", F.lit(False)) | chunk.isNull()
        ms, by = F.when(none, None), F.when(none, "unavailable")
        for holds, value, name in cases:
            ms, by = ms.when(holds, value), by.when(holds, name)
        return ms.otherwise(by_points).cast("long"), by.otherwise("interpolated")

    start_ms, start_by = edge(ca, [(wa.isNotNull(), wa["start_ms"], "provider-word"), (silent(ca["start"], a), ca["start_ms"], "chunk-boundary")], between(points(ca), a))
    end_ms, end_by = edge(cz, [(F.col("__bounds"), cz["end_ms"], "chunk-boundary"), (wz.isNotNull(), wz["end_ms"], "provider-word")], between(points(cz), z))
    return rows.select(*spans.columns, start_ms.alias("start_ms"), start_by.alias("start_by"), end_ms.alias("end_ms"), end_by.alias("end_by"))
