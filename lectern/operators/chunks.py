"""Chunking of whole texts with true offsets, as functions over Arrow batches.

Where one chunk ends depends on where the last one did, so a text is cut in one go;
texts are independent of each other.  Offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import portions

TARGET, OVERLAP = 1400, 250
_GAP = re.compile(r"(?:\n\s*\n|\f)+")
_STOP = re.compile(r"[.!?][ \n]")
_PARAGRAPH = re.compile(r"\n\s*\n")


def _last_stop(text: str, lo: int, hi: int, stops: list[int]) -> int:
    """The last sentence end in text[lo:hi] whose blank is inside, or -1; stops: all of them in the text."""
    at = bisect_right(stops, hi - 2) - 1
    return stops[at] if at >= 0 and stops[at] >= lo else -1


def bounds(text: str, target: int = TARGET) -> list[tuple[int, int]]:
    """Spans of whole segments, packed up to target; an over-long segment is cut at a sentence end in its second half."""
    stops = [m.start() for m in _STOP.finditer(text)]
    pieces, last = [], 0
    for start, end in [m.span() for m in _GAP.finditer(text)] + [(len(text), len(text))]:
        at = last
        while start - at > target:
            stop = _last_stop(text, at, at + target, stops)
            cut = stop + 1 if stop - at > target / 2 else at + target
            pieces.append((at, cut))
            at = cut
        if start > at:
            pieces.append((at, start))
        last = end
    packed: list[tuple[int, int]] = []
    for a, b in pieces:
        if not text[a:b].strip():
            continue
        if packed and b - packed[-1][0] <= target:
            packed[-1] = (packed[-1][0], b)
        else:
            packed.append((a, b))
    return packed


def drafts(text: str, page_of: Callable[[int], int] | None = None, target: int = TARGET, overlap: int = OVERLAP) -> list[dict]:
    """Chunks: text, char_start, char_end, page_start, page_end; each but the first starts at a sentence of the one before."""
    stops = [m.start() for m in _STOP.finditer(text)]
    out = []
    for i, (start, end) in enumerate(bounds(text, target)):
        if i:
            stop = _last_stop(text, max(0, start - overlap), start, stops)
            start = stop + 2 if stop >= 0 else start
        part = text[start:end]
        a, b = start + len(part) - len(part.lstrip()), end - (len(part) - len(part.rstrip()))
        if b > a:
            pages = (page_of(a), page_of(b - 1)) if page_of else (None, None)
            out.append({"text": text[a:b].replace("\f", "\n"), "char_start": a, "char_end": b, "page_start": pages[0], "page_end": pages[1]})
    return out


def feed_pages(text: str) -> Callable[[int], int] | None:
    """Page of an offset, form feeds being page ends; None without any."""
    feeds = [m.start() for m in re.finditer("\f", text)]
    return (lambda offset: bisect_left(feeds, offset) + 1) if feeds else None


def block_pages(text: str, blocks: list[dict] | None) -> Callable[[int], int] | None:
    """Page of an offset by where included blocks (text, page, included) begin, in order; blocks not found are passed over."""
    marks: list[tuple[int, int]] = []
    cursor = 0
    for block in blocks or []:
        probe = (block["text"] or "").strip()[:64] if block["included"] else ""
        at = text.find(probe, cursor) if probe else -1
        if at < 0:
            continue
        if not marks or marks[-1][1] != block["page"]:
            marks.append((at, block["page"]))
        cursor = at + len(probe)
    starts = [a for a, _ in marks]
    return (lambda offset: marks[max(0, bisect_right(starts, offset) - 1)][1]) if marks else None


_CHUNKS = "array<struct<text:string,char_start:int,char_end:int,page_start:int,page_end:int>>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("page_start", pa.int32()), ("page_end", pa.int32())]))


def _listed(df: DataFrame, keep: list[str], inputs: list[str], cut: Callable[..., list], schema: str, kind: pa.DataType, name: str) -> DataFrame:
    from pyspark.sql.types import StructType

    out = StructType(df.select(*keep).schema.fields + StructType.fromDDL(f"{name} {schema}").fields)
    n = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = zip(*[c.to_pylist() for c in batch.columns[-n:]], strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-n], pa.array([cut(*r) for r in rows], kind)], out.names)

    return df.select(*keep, *[F.col(c).alias(f"__{i}") for i, c in enumerate(inputs)]).mapInArrow(run, out)


def chunk_texts(df: DataFrame, *, text: str = "text", keep: list[str], paged: bool = False, blocks: str | None = None, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """keep, seq and the chunk's columns, a row per chunk. Null texts have none.

    paged: form feeds end pages; blocks: a column of located blocks that give the pages.
    """

    def cut(value: str | None, located: list[dict] | None = None) -> list[dict]:
        value = value or ""
        page_of = feed_pages(value) if paged else block_pages(value, located) if blocks else None
        return drafts(value, page_of, target, overlap)

    listed = _listed(df, keep, [text] + ([blocks] if blocks else []), cut, _CHUNKS, _ARROW, "chunks")
    return listed.select(*keep, F.posexplode("chunks").alias("seq", "c")).select(*keep, "seq", "c.*")


def llm_pieces(text: str | None, most: int = 2500) -> list[str]:
    """Paragraphs packed up to most characters; a longer one is cut at a sentence end in the second half."""
    out: list[str] = []
    current = ""
    for paragraph in filter(None, (p.strip() for p in _PARAGRAPH.split(text or ""))):
        if current and (len(paragraph) > most or len(current) + len(paragraph) + 2 > most):
            out.append(current)
            current = ""
        if len(paragraph) <= most:
            current = f"{current}\n\n{paragraph}" if current else paragraph
            continue
        while len(paragraph) > most:
            stop = max(paragraph.rfind(mark, 0, most) for mark in (". ", "! ", "? "))
            cut = stop + 1 if stop > most / 2 else most
            out.append(paragraph[:cut].strip())
            paragraph = paragraph[cut:].strip()
        out += [paragraph] if paragraph else []
    return out + ([current] if current else [])


_SENTENCE = re.compile(r"[^.!?]+(?:[.!?]+|$)")
_SAYABLE = re.compile(r"[^\W_]")


def speech_pieces(text: str | None, most: int = 240, least: int = 40) -> list[str]:
    """Sentences of each paragraph; short ones join a neighbour, over-long ones are cut between words; nothing unsayable."""
    out: list[str] = []
    for paragraph in (" ".join(p.split()) for p in _PARAGRAPH.split(text or "")):
        if not _SAYABLE.search(paragraph):
            continue
        units: list[str] = []
        for sentence in [s.strip() for s in _SENTENCE.findall(paragraph)] or [paragraph]:
            line = ""
            for word in sentence.split() if len(sentence) > most else []:
                if line and len(line) + 1 + len(word) > most:
                    units.append(line)
                    line = word
                else:
                    line = f"{line} {word}" if line else word
            units += [line] if line else [sentence] if sentence and len(sentence) <= most else []
        merged: list[str] = []
        for unit in units:
            short = merged and min(len(merged[-1]), len(unit)) < least
            if short and len(merged[-1]) + 1 + len(unit) <= most:
                merged[-1] += " " + unit
            else:
                merged.append(unit)
        out += merged
    return out


def split_texts(df: DataFrame, cut: Callable[[str | None], list[str]], *, text: str = "text", keep: list[str]) -> DataFrame:
    """keep, seq and piece: each text cut by llm_pieces, speech_pieces or the like."""
    return _listed(df, keep, [text], cut, "array<string>", pa.list_(pa.string()), "pieces").select(*keep, F.posexplode("pieces").alias("seq", "piece"))


def locate(text: str | None, parts: list[str] | None) -> list[dict | None]:
    """Where each part stands in the text, one after another, white space aside; None for one that isn't there."""
    places = [i for i, c in enumerate(text or "") if not c.isspace()]
    flat = "".join((text or "")[i] for i in places)
    out: list[dict | None] = []
    cursor = 0
    for part in parts or []:
        probe = "".join(part.split())
        at = flat.find(probe, cursor) if probe else -1
        out.append(None if at < 0 else {"start": places[at], "end": places[at + len(probe) - 1] + 1})
        cursor = at + len(probe) if at >= 0 else cursor
    return out


def locate_parts(df: DataFrame, *, text: str, parts: str, keep: list[str]) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return _listed(df, keep, [text, parts], locate, "array<struct<start:int,end:int>>", kind, "spans")
