"""Blocks, sentences, tokens, cues and times of reading texts: spans, prefix sums and as-of lookups."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import _listed
from .relational import as_of, running_total

#: A private character that marks a cut where SQL cuts the same texts.
CUT = ""
MIN_CUE_MS = 1200
CLOSING = r"[.!?…]+[\"'»”’)\]]*$"


# ---- blocks ----


def block_spans(blocks: DataFrame, unit: str, order: str, text: str, verse: Column, line: Column) -> DataFrame:
    """Blocks with text, each with what stands before it (sep) and its span in the unit's joined text.

    verse: whether a block is verse; line: whether it begins on a new line only. Leave out excluded blocks first.
    """
    rows = blocks.where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("__verse", F.coalesce(verse, F.lit(False)))
    before = F.lag("__verse").over(Window.partitionBy(unit).orderBy(order))
    sep = F.when(before.isNull(), "").when(line & F.col("__verse") & before, "\n").otherwise("\n\n")
    rows = rows.withColumn("sep", sep).withColumn("__n", (F.length("sep") + F.length(text)).cast("long"))
    rows = running_total(rows, [unit], [F.col(order)], "__n", "__before")
    start = (F.col("__before") + F.length("sep")).cast("long")
    return rows.withColumn("start", start).withColumn("end", (start + F.length(text)).cast("long")).drop("__verse", "__n", "__before")


def joined_text(spans: DataFrame, unit: str, order: str, text: str) -> DataFrame:
    """unit and text: the blocks of block_spans in a row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat("sep", text).alias("t"))))
    return spans.groupBy(unit).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def page_at(asks: DataFrame, spans: DataFrame, unit: str, offset: str, raw_length: str) -> DataFrame:
    """asks with the page at an offset; an offset into a raw text of another length is scaled first."""
    whole = spans.groupBy(unit).agg(F.max("end").alias("__joined"))
    same = (F.col("__joined") == F.col(raw_length)) | (F.col(raw_length) <= 0)
    scaled = F.when(same, F.col(offset).cast("double")).otherwise(F.col(offset) / F.col(raw_length) * F.col("__joined"))
    left = asks.join(whole, unit).withColumn("__at", scaled)
    return as_of(left, spans.withColumn("start", F.col("start").cast("double")), unit, "__at", "start", ["page"]).drop("__at", "__joined")


# ---- sentences and tokens ----


_CLOSED = re.compile(r"[.!?…][\"”’)]?[ \t\r\n]+")
_BLANK_LINE = re.compile(r"\n[ \t\r\n]*\n[ \t\r\n]*")
_TOKEN = re.compile(r"\w+")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
SPANS = "array<struct<start:bigint,end:bigint,text:string>>"


def sentence_spans(text: str | None) -> list[dict]:
    """Where sentences stand: cut after a closing mark, and at a blank line unless the next word begins in lower case."""
    text = text or ""
    cuts = {m.end() for m in _CLOSED.finditer(text)}
    for m in _BLANK_LINE.finditer(text):
        after = text[m.end() : m.end() + 1]
        if after and after not in "\x0b\f" and unicodedata.category(after) != "Ll":
            cuts.add(m.end())
    out = []
    for start, end in pairwise(sorted(cuts | {0, len(text)})):
        body = text[start:end].strip(" \t\r\n")
        if body:
            at = text.index(body, start)
            out.append({"start": at, "end": at + len(body), "text": body})
    return out


def token_spans(text: str | None) -> list[dict]:
    return [{"start": m.start(), "end": m.end(), "text": m[0]} for m in _TOKEN.finditer(text or "")]


def sentences(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, number (from 0), start, end and sentence of each row's text; a null text has none."""
    rows = _listed(texts, keys, [text], sentence_spans, SPANS, _SPANS, "spans")
    rows = rows.select(*keys, F.posexplode("spans").alias("number", "s"))
    return rows.select(*keys, "number", "s.start", "s.end", F.col("s.text").alias("sentence"))


def token_lists(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep and spans (start, end and text of runs of letters and digits, in order) of each row's text."""
    return _listed(texts, keep, [text], token_spans, SPANS, _SPANS, "spans")


def tokens(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, id (from 1), start, end and token: runs of letters and digits."""
    rows = token_lists(texts, keys, text).select(*keys, F.posexplode("spans").alias("pos", "s"))
    return rows.select(*keys, (F.col("pos") + 1).alias("id"), "s.start", "s.end", F.col("s.text").alias("token"))


def under_anchors(words: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, anchor, ids and text: the tokens (id, start, end, token) that an anchor's span (from, to) touches, in order."""
    met = words.join(anchors, keys).where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")))
    parts = F.array_sort(F.collect_list(F.struct("id", "token")))
    rows = met.groupBy(*keys, "anchor").agg(parts.alias("p"))
    return rows.select(*keys, "anchor", F.transform("p", lambda t: t["id"]).alias("ids"), F.array_join(F.transform("p", lambda t: t["token"]), " ").alias("text"))


# ---- cues ----


def sentence_cues(words: DataFrame, unit: str, order: list[str], start: str, end: str, text: str) -> DataFrame:
    """unit, cue (from 0), start_ms, end_ms and text: words up to a closing mark that make MIN_CUE_MS; a short rest joins the cue before.

    A unit's words pass one task in order, a batch at a time; a cue is given out when the next one ends.
    """
    names = [f"o{i}" for i in range(len(order))]
    rows = words.select(F.col(unit).alias("u"), *[F.col(o).alias(n) for o, n in zip(order, names)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(text).alias("t"), F.coalesce(F.rlike(text, F.lit(CLOSING)), F.lit(False)).alias("closing"))
    rows = rows.repartition("u").sortWithinPartitions("u", *names, "s", "e", "t").select("u", "s", "e", "t", "closing")
    fields = [unit, "cue", "start_ms", "end_ms", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, n = False, None, 0
        held: list | None = None  # the cue before, which a short rest may join
        cue: list | None = None  # start, end, words
        out: list[tuple] = []

        def put(x: list) -> None:
            nonlocal n
            out.append((at, n, x[0], x[1], " ".join(x[2]).strip(" ")))
            n += 1

        def end_unit() -> None:
            nonlocal held, cue
            if held and cue and cue[1] - cue[0] < MIN_CUE_MS:
                held, cue = [held[0], cue[1], held[2] + cue[2]], None
            for x in (held, cue):
                if x:
                    put(x)
            held = cue = None

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, s, e, t, closing in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or key != at:
                    if begun:
                        end_unit()
                    begun, at, n = True, key, 0
                cue = cue or [s, e, []]
                cue[1] = e
                cue[2].append(t or "")
                if closing and cue[1] - cue[0] >= MIN_CUE_MS:
                    if held:
                        put(held)
                    held, cue = cue, None
            yield _cue_batch(out, kind, fields)
            out.clear()
        if begun:
            end_unit()
            yield _cue_batch(out, kind, fields)

    return rows.mapInArrow(run, f"`{unit}` {rows.schema['u'].dataType.simpleString()}, cue int, start_ms bigint, end_ms bigint, text string")


def _cue_batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (kind, pa.int32(), pa.int64(), pa.int64(), pa.string()))], names)


def cue_at(asks: DataFrame, cues: DataFrame, unit: str, ms: str) -> DataFrame:
    """asks with cue: the last that starts by then; before the first it is 0, without any -1."""
    found = as_of(asks, cues, unit, ms, "start_ms", ["cue"])
    any_ = cues.select(unit).distinct().withColumn("__any", F.lit(0))
    return found.join(any_, unit, "left").withColumn("cue", F.coalesce("cue", "__any", F.lit(-1))).drop("__any")


def word_at(asks: DataFrame, words: DataFrame, unit: str, ms: str) -> DataFrame:
    """asks with word: the last that starts by then if it lasts until after it, else -1."""
    found = as_of(asks, words, unit, ms, "start_ms", ["word", "end_ms"])
    return found.withColumn("word", F.when(F.col(ms) < F.col("end_ms"), F.col("word")).otherwise(-1)).drop("end_ms")


def first_ending_after(asks: DataFrame, spans: DataFrame, unit: str, offset: str, end: str, values: list[str]) -> DataFrame:
    """asks with values of the first span that ends after the offset; null if none does."""
    turned = spans.withColumn("__end", -F.col(end))
    return as_of(asks.withColumn("__at", -F.col(offset) - 1), turned, unit, "__at", "__end", values).drop("__at")


def stale_prefix(old: DataFrame, new: DataFrame, unit: str, index: str, text: str) -> DataFrame:
    """unit, keep and stale: how many of the first old texts equal the new ones at their place, and how many old ones lie beyond."""
    o, n = old.select(unit, index, F.col(text).alias("__o")), new.select(unit, index, F.col(text).alias("__n"))
    both = o.join(n, [unit, index], "full")
    differs = F.min(F.when(F.col("__o").isNull() | F.col("__n").isNull() | (F.col("__o") != F.col("__n")), F.col(index)))
    per = both.groupBy(unit).agg(F.coalesce(differs, F.max(index) + 1).cast("long").alias("keep"), F.count("__o").alias("__all"))
    return per.where("__all > 0").select(unit, "keep", F.greatest(F.col("__all") - F.col("keep"), F.lit(0)).alias("stale"))


# ---- times ----


def interpolated(asks: DataFrame, points: DataFrame, unit: str, at: str, weight: str) -> DataFrame:
    """asks with ms: linear in weight between the nearest known points (at, weight, ms) of the unit, and at a point its own."""
    low = as_of(asks, points.withColumns({"a_ms": F.col("ms"), "a_w": F.col(weight)}), unit, at, "at", ["a_ms", "a_w"])
    turned = points.withColumn("__t", -F.col("at")).withColumns({"b_ms": F.col("ms"), "b_w": F.col(weight)})
    both = as_of(low.withColumn("__at", -F.col(at)), turned, unit, "__at", "__t", ["b_ms", "b_w"]).drop("__at")
    a_ms, a_w = F.coalesce("a_ms", "b_ms"), F.coalesce("a_w", "b_w")
    b_ms, b_w = F.coalesce("b_ms", "a_ms"), F.coalesce("b_w", "a_w")
    between = F.floor(a_ms + (b_ms - a_ms) * (F.col(weight) - a_w) / F.nullif(b_w - a_w, F.lit(0)) + 0.5)
    return both.withColumn("result_ms", F.when(b_w > a_w, between).otherwise(a_ms).cast("long")).drop("a_ms", "a_w", "b_ms", "b_w")


def pair_at(asks: DataFrame, pairs: DataFrame, unit: str, order: str, ms: str, total: str, values: list[str]) -> DataFrame:
    """asks (with the unit's total) with values of the pair that sounds then: in a gap the one before, unless a pair without times follows it."""
    line = Window.partitionBy(unit).orderBy(order)
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    rows = pairs.withColumn("__timed", timed).withColumn("__next", F.lead("__timed").over(line)).where("__timed")
    found = as_of(asks, rows.withColumn("__end", F.col("end_ms")), unit, ms, "start_ms", [*values, "__end", "__next"])
    holds = (F.col(ms) < F.col("__end")) | F.coalesce("__next", F.lit(False)) | (F.col("__next").isNull() & (F.col(ms) <= F.col(total)))
    return found.withColumns({v: F.when(holds, F.col(v)) for v in values}).drop("__end", "__next")


def mapped_spans(spans: DataFrame, tokens_: DataFrame, unit: str) -> DataFrame:
    """unit, id, to_start and to_end: what the tokens (start, end, to_start, to_end) that a span touches map to, as one span."""
    from .relational import overlapping

    ends = tokens_.withColumn("id", F.struct("to_start", "to_end"))
    met = overlapping(spans, ends, unit)
    return met.groupBy(unit, F.col("a_id").alias("id")).agg(F.min("b_id.to_start").alias("to_start"), F.max("b_id.to_end").alias("to_end")).where("to_start IS NOT NULL")


# ---- small text rules ----


def fingerprint(text: Column) -> Column:
    """The length and the 32-bit FNV-1a hash of a text's UTF-16 units, in hexadecimal."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    units = F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(F.array(F.floor((p - 0x10000) / 1024) + 0xD800, (p - 0x10000) % 1024 + 0xDC00))))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda t, u: (t.bitwiseXOR(u) * 16777619).bitwiseAND(0xFFFFFFFF))
    return F.concat(F.size(units).cast("string"), F.lit("-"), F.lower(F.hex(h)))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), F.lit(r"[^\p{L}\p{N}]+"), F.lit(""))


def title_repeats(title: Column, text: Column) -> Column:
    """Whether the first line is the title, or either begins with the other; marks and case aside."""
    a, b = _plain(title), _plain(F.substring_index(text, "\n", 1))
    return (a != "") & (b != "") & (F.startswith(b, a) | F.startswith(a, b))


# Scripts in the order in which ties are decided.
SCRIPTS = ("Cyrillic", "Latin", "Greek", "Han", "Arabic", "Hebrew")


def dominant_script(words: Column) -> Column:
    """The script that most of the words have a letter of; null without any."""
    counts = F.array(*[F.struct(F.size(F.filter(words, _has(s))).alias("n"), F.lit(-i).alias("first"), F.lit(s).alias("script")) for i, s in enumerate(SCRIPTS)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["script"])


def _has(script: str):
    return lambda w: F.rlike(w, F.lit(rf"\p{{Is{script}}}"))


# What stands first where an author field holds no person.
_NOT_A_PERSON = r"(?i)^(user|admin|owner|unknown|author|microsoft|adobe|acrobat|word|pdf|scanner|hp|canon|epson|xerox)\b"


def clean_author(author: Column) -> Column:
    """The author if it reads like a person's name, else null."""
    a = F.trim(author)
    bad = F.rlike(a, F.lit(_NOT_A_PERSON)) | F.rlike(a, F.lit(r"[\\/]")) | F.rlike(a, F.lit(r"(?i)\.pdf$"))
    return F.when(F.length(a).between(2, 120) & ~bad, a)
