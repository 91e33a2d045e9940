"""Edited texts against the texts they were edited from, word by word, and what is carried across.

Words are runs of non-blanks, compared by their letters and digits alone. Runs of three words that each text has
once, in the longest order both share, pin the texts to each other; between pins a longest common
subsequence keeps what it can. Words that were replaced take the word, or run of words, that they resemble
most, in order. An alignment that keeps too little of the edited text is refused.

The tables are quadratic in a stretch between two pins only. Defined results: a text that is null or
has no words is not aligned, nor are texts with a stretch of more than CELLS pairs of unpinned words; spans count code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import rising_chain, similarity
from .relational import portions

#: The share of words an edit must keep, how alike a word and its correction are (alone, or as a run of up to RUN words), and how far ahead one is sought.
KEPT, CORRECTED, JOINED, RUN, AHEAD = 0.6, 0.5, 0.7, 6, 16
PIN = 3
#: Pairs of words in a stretch between two pins, at most.
CELLS = 16_000_000

Span = tuple[int, int]
_WORD, _SIGN = re.compile(r"\S+"), re.compile(r"[^\W_]")


@dataclass
class Tokens:
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)

    def span(self, at: int, n: int = 1) -> Span:
        return self.starts[at], self.ends[at + n - 1]


def tokens(text: str) -> Tokens:
    """The words of a text, each from its first to its last letter or digit."""
    out = Tokens()
    for word in _WORD.finditer(text):
        signs = [m.start() for m in _SIGN.finditer(word[0])]
        if signs:
            out.starts.append(word.start() + signs[0])
            out.ends.append(word.start() + signs[-1] + 1)
            out.keys.append("".join(c for c in unicodedata.normalize("NFD", word[0]).lower() if unicodedata.category(c)[0] in "LN"))
    return out


def _common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]] | None:
    """Index pairs of a longest common subsequence; None if the table would be too large."""
    lo, most = 0, min(len(x), len(y))
    differ = np.flatnonzero(x[:most] != y[:most])
    lo = int(differ[0]) if len(differ) else most
    x, y = x[lo:], y[lo:]
    most = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:most] != y[::-1][:most])
    tail = int(differ[0]) if len(differ) else most
    n, m = len(x) - tail, len(y) - tail
    pairs = [(i, i) for i in range(lo)] + [(lo + n + i, lo + m + i) for i in range(tail)]
    if not n or not m:
        return pairs
    if n * m > CELLS:
        return None
    best = np.zeros((n + 1, m + 1), np.int16 if min(n, m) < 2**15 else np.int32)
    for i in range(n):
        row = best[i + 1]
        np.maximum(best[i, 1:], best[i, :-1] + (y[:m] == x[i]), out=row[1:])
        np.maximum.accumulate(row, out=row)
    i, j = n, m
    while i and j:
        if x[i - 1] == y[j - 1] and best[i, j] == best[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            pairs.append((lo + i, lo + j))
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i -= 1
    return sorted(pairs)


def _pins(old: list[str], now: list[str]) -> list[tuple[int, int]]:
    """(now, old) places of runs of PIN words that each side has once, in a longest order both share."""
    runs = [list(zip(*(side[k:] for k in range(PIN)))) for side in (now, old)]
    once = [{run for run, n in Counter(r).items() if n == 1} for r in runs]
    where = {run: j for j, run in enumerate(runs[1]) if run in once[1]}
    return rising_chain([(i, where[run]) for i, run in enumerate(runs[0]) if run in once[0] and run in where])


@dataclass
class Alignment:
    """fit: the share of the edited words that are kept; edited, original: of each word of that side its own span and the other side's (or None)."""

    fit: float
    edited: list[tuple[Span, Span | None]]
    original: list[tuple[Span, Span | None]]


def aligned(edited: str | None, original: str | None) -> Alignment | None:
    now, old = tokens(edited or ""), tokens(original or "")
    n, m = len(now.keys), len(old.keys)
    budget = int(np.floor(round(n + m - 2 * KEPT * n, 9)))
    if not n or not m or budget < 0:
        return None
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(k, len(ids)) for k in side.keys], np.int64) for side in (now, old))
    kept: list[tuple[int, int]] = []
    at = (0, 0)
    for i, j in [*_pins(old.keys, now.keys), (n, m)]:
        between = _common(x[at[0] : i], y[at[1] : j])
        if between is None:
            return None
        budget -= (i - at[0]) + (j - at[1]) - 2 * len(between)
        if budget < 0:
            return None
        kept += [(at[0] + a, at[1] + b) for a, b in between]
        if i < n:
            kept.append((i, j))
        at = (i + 1, j + 1)
    forward: list[Span | None] = [None] * n
    backward: list[Span | None] = [None] * m
    for i, j in kept:
        forward[i], backward[j] = old.span(j), now.span(i)
    for (i0, j0), (i1, j1) in zip([(-1, -1), *kept], [*kept, (n, m)]):
        if i1 - i0 > 1 and j1 - j0 > 1:
            _replaced(now, old, range(i0 + 1, i1), range(j0 + 1, j1), forward, backward)
    return Alignment(len(kept) / n, [(now.span(i), forward[i]) for i in range(n)], [(old.span(j), backward[j]) for j in range(m)])


def _replaced(now: Tokens, old: Tokens, added: range, removed: range, forward: list[Span | None], backward: list[Span | None]) -> None:
    """Each added word takes the removed word or run it resembles most, in order; one that resembles none stands for all that was removed."""
    whole = old.span(removed.start, len(removed))
    at = removed.start
    for i in added:
        best: tuple[float, int, int] | None = None
        for j in range(at, min(removed.stop, at + AHEAD)):
            for size in range(1, min(RUN, removed.stop - j) + 1):
                score = similarity(now.keys[i], "".join(old.keys[j : j + size]))
                if score >= (CORRECTED if size == 1 else JOINED) and (best is None or score > best[0]):
                    best = score, j, size
        if best is None:
            forward[i] = whole
            continue
        _, j, size = best
        forward[i] = old.span(j, size)
        backward[j : j + size] = [now.span(i)] * size
        at = j + size


WORDS = "array<struct<start:int,end:int,to_start:int,to_end:int>>"
_WORDS = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "to_start", "to_end")]))


def edit_alignment(pairs: DataFrame, keys: list[str], edited: str, original: str) -> DataFrame:
    """keys, fit, and the words of both sides with where they went; fit and words are null for texts that are not aligned."""

    def listed(words: list[tuple[Span, Span | None]]) -> list[dict]:
        return [{"start": a[0], "end": a[1], "to_start": b and b[0], "to_end": b and b[1]} for a, b in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            k = batch.num_columns - 2
            found = [aligned(a.as_py(), b.as_py()) for a, b in zip(batch.column(k), batch.column(k + 1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array([f and f.fit for f in found], pa.float64()), *[pa.array([f and listed(getattr(f, side)) for f in found], _WORDS) for side in ("edited", "original")]],
                names=[*batch.schema.names[:k], "fit", "edited_words", "original_words"],
            )

    rows = pairs.select(*keys, F.col(edited).alias("__edited"), F.col(original).alias("__original"))
    schema = pairs.select(*keys).schema.add("fit", "double")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(run, f"{kinds}, edited_words {WORDS}, original_words {WORDS}")


def carried(words: Column, start: Column, end: Column) -> Column:
    """The other side's span (start, end) of a span: from the first to the last of its words' spans; null if none of its words went anywhere."""
    touched = F.filter(words, lambda w: (w["end"] > start) & (w["start"] < end) & w["to_start"].isNotNull())
    span = F.struct(F.array_min(F.transform(touched, lambda w: w["to_start"])).alias("start"), F.array_max(F.transform(touched, lambda w: w["to_end"])).alias("end"))
    return F.when(F.size(touched) > 0, span)


# ---- blocks of a text that was edited ----

_BLANK_LINE = re.compile(r"\n[ \t]*\n")


def paragraphs(text: str, start: int, end: int) -> list[Span]:
    """Stretches of text[start:end] between blank lines, without white space around them."""
    out, at = [], start
    for a, b in [*((start + m.start(), start + m.end()) for m in _BLANK_LINE.finditer(text[start:end])), (end, end)]:
        body = text[at:a]
        if body.strip():
            out.append((at + len(body) - len(body.lstrip()), at + len(body.rstrip())))
        at = b
    return out


def cover(text: str, blocks: list[dict]) -> list[dict]:
    """Blocks (start, end, kind, break_before, in order) over all of a text.

    A block ends where the next begins. Text between two blocks joins the one before it, else the one after
    it, if no blank line parts them; a paragraph of its own becomes prose. Prose is cut at blank lines.
    """
    out: list[dict] = []

    def parted(a: int, b: int) -> bool:
        return bool(_BLANK_LINE.search(text[a:b]))

    def between(start: int, end: int, after: dict | None) -> None:
        found = paragraphs(text, start, end)
        for k, (a, b) in enumerate(found):
            if k == 0 and out and not parted(out[-1]["end"], a):
                out[-1]["end"] = b
            elif k == len(found) - 1 and after and not parted(b, after["start"]):
                after["start"] = a
            else:
                out.append({"start": a, "end": b, "kind": "prose", "break_before": None})

    at = 0
    limits = [b["start"] for b in blocks[1:]] + [len(text)]
    for block, limit in zip(blocks, limits):
        one = block | {"start": max(block["start"], at), "end": min(block["end"], limit)}
        if one["start"] < one["end"]:
            end = one["end"]
            between(at, one["start"], one)
            out.append(one)
            at = end
    between(at, len(text), None)
    cut = []
    for block in out:
        parts = paragraphs(text, block["start"], block["end"]) if block["kind"] == "prose" else [(block["start"], block["end"])]
        cut += [block | {"start": a, "end": b, "break_before": block["break_before"] if i == 0 else None} for i, (a, b) in enumerate(parts)]
    return cut


BLOCKS = "array<struct<start:int,end:int,kind:string,break_before:string>>"
_BLOCKS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("break_before", pa.string())]))


def reader_blocks(texts: DataFrame, keys: list[str], edited: str, original: str, spans: str) -> DataFrame:
    """keys, text (the edited one, trimmed) and blocks over all of it.

    spans: the original's typed blocks (start, end, kind, break_before), in order. Null blocks: the edit
    kept too little, or nothing of any block. A null edited text leaves the original and its blocks as they are.
    """
    names = [f"__{i}" for i in range(len(keys))]
    rows = texts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(edited).alias("__edited"), F.col(original).alias("__text"), F.col(spans).alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            k = len(names)
            out_text, out_blocks = [], []
            for now, old, typed in zip(*(c.to_pylist() for c in batch.columns[k:])):
                if now is None:
                    out_text.append(old)
                    out_blocks.append(typed)
                    continue
                text = now.strip()
                found = aligned(now, old)
                lead = len(now) - len(now.lstrip())
                mapped = []
                for block in typed or [] if found else []:
                    spots = [to for (a, b), to in found.original if b > block["start"] and a < block["end"] and to]
                    if spots:
                        mapped.append(block | {"start": min(s for s, _ in spots) - lead, "end": max(e for _, e in spots) - lead})
                out_text.append(text)
                out_blocks.append(cover(text, mapped) if mapped else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out_text, pa.string()), pa.array(out_blocks, _BLOCKS)], names=[*names, "text", "blocks"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(run, f"{kinds}, text string, blocks {BLOCKS}")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "text", "blocks")
