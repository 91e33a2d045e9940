"""Secret scans: fixed patterns, and guess costs of values where credentials stand.

Three patterns always count (kinds assign, access and hex).  Beyond them, a
value in a credential context - after a word for a secret and a sign for "is", in a
bearer header, or as the password in an address - is priced: dynamic programming finds
the segmentation into words, dates, repeats, sequences, keyboard walks and
brute-forced characters that takes the fewest guesses.  A value that
takes at least 10 ** ``least`` guesses is a secret, too (kind guess).  Ordinary words are cheap by a
fixed list (COMMON_WORDS, then ``wordlist``, about 5,000, English) and by the corpus' own words, ranked by how often they stand
outside credential contexts (``learned_words``), in whatever languages it has: a secret that is repeated, but
only ever as a secret, is not learned. A word that is in neither may count.
Base matches stay whatever their price; a guess span goes only if one base value covers all
of it, so that a value whose head alone is a base match is found, and masked, whole.

Offsets are code points, ends exclusive.  Defined results: a null or empty text
has no spans; whole texts are read, whatever their length, and the price takes time
in proportion to the value; rows with the same key are scanned each for itself;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .tables import held, tidy
from .wordlist import WORDS

LEAST = 10.0
#: Learned words at most, the times a word must stand somewhere, and the letters it may have.
LEARNED, TIMES, LONGEST = 1 << 16, 5, 24
MASK = "<redacted>"
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # a run of under 24 fails as a whole
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Where a credential's value follows; the value is the last group. Key words follow anything but a letter or digit, or start a camelCase part.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|(?:client[ _-]?)?secret(?:[ _-]?(?:access[ _-]?)?key)?|token|credentials?|authorization|(?:api|access|private|signing)[ _-]?key|auth)"""
    r"""["']?\s{0,3}(?:[:=]>?|:=|->|\bis\b)\s{0,3}["']?([^\s"'<>]{6,})"""
    r"""|\bbearer\s{1,3}([A-Za-z0-9+/_.~=-]{6,})|://[^\s/:@]{1,256}:([^\s/:@]{6,})@""",
    re.I | re.A,
)
#: One of these (in lower case) is in every context; a fast first look.
_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key", "bearer", "://")
_BASE_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Common words of passwords, most common first.
COMMON_WORDS = """
password admin user login welcome letmein monkey dragon master secret test root pass guest default change
changeme hello love iloveyou princess sunshine football baseball shadow superman batman michael jordan
summer winter spring autumn monday friday january october company server database system access token key
example sample dummy demo placeholder qwerty abc temp temporary backup public private house blue green red
black white star angel baby flower money happy freedom whatever trust ninja hunter killer soccer hockey
charlie thomas robert daniel jessica ashley computer internet
""".split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS + WORDS))}
_LONGEST_WORD = max(map(len, RANK))
_LEET = str.maketrans("4@830175$", "aabeoltss")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    value_end: int
    log10_guesses: float


def _runs(low: str) -> Iterator[tuple[int, int, float]]:
    """Repeats, sequences and keyboard walks of three characters or more, with log10 of their guesses."""
    n = len(low)
    for holds, many in ((lambda a, b: a == b, 40), (lambda a, b: ord(b) - ord(a) == 1, 80), (lambda a, b: ord(a) - ord(b) == 1, 80), (lambda a, b: (a, b) in _NEXT, 180)):
        i = 0
        while i < n - 1:
            j = i
            while j < n - 1 and holds(low[j], low[j + 1]):
                j += 1
            if j - i >= 2:
                yield i, j + 1, math.log10(many * (j + 1 - i))
            i = max(j, i + 1)


def guess_cost(value: str, learned: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of value. learned: words of the corpus, with their rank from 1."""
    longest = max(_LONGEST_WORD, LONGEST) if learned else _LONGEST_WORD
    low = value.lower()
    if len(low) != len(value):
        low = value
    plain, n = low.translate(_LEET), len(value)
    ways: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _runs(low):
        ways.setdefault(j, []).append((i, cost))
    for i in range(n):
        m = _DATE.match(value, i)
        if m:
            ways.setdefault(m.end(), []).append((i, math.log10(120 if m.end() - i == 4 else 365 * 120)))
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = RANK.get(plain[i:j])
            if learned and (own := learned.get(low[i:j]) or learned.get(plain[i:j])):
                rank = min(rank or own, own)
            if rank:
                twists = (value[i:j] != low[i:j]) + (plain[i:j] != low[i:j])
                ways.setdefault(j, []).append((i, math.log10(rank * (1 + 3 * twists) + 1)))
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        c = value[j - 1]
        one = 10 if c.isdigit() else 26 if c.isalpha() else 33
        best[j] = best[j - 1] + math.log10(one)
        for i, cost in ways.get(j, ()):
            best[j] = min(best[j], best[i] + cost + 0.3)  # a segment more makes about two orders more to try
    return best[n]


_LETTERS = re.compile(rf"[^\W\d_]{{3,{LONGEST}}}(?![^\W\d_])")


def counted_words(text: str, into: Counter) -> None:
    """Add the words of a text (whole runs of letters, in lower case) that stand outside credential contexts."""
    low = text.lower()
    if any(h in low for h in _HINTS):
        parts, at = [], 0
        for a, b in sorted(m.span(m.lastindex) for m in [*CONTEXT.finditer(text), *ASSIGN.finditer(text)]):
            if b > at:
                parts.append(text[at : max(a, at)])
                at = b
        low = "\n".join([*parts, text[at:]]).lower()
    into.update(_LETTERS.findall(low))


def learned_words(df: DataFrame, *, text: str = "text", most: int = LEARNED, times: int = TIMES) -> dict[str, int]:
    """The most frequent words of all texts, with their rank from 1: all that stand at least so many times, at most about `most`.

    Words are counted by batch, then over all; only a histogram of counts and the words above the count that it
    gives, both bounded, come to the driver.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for t in batch.column(0):
                counted_words(t.as_py() or "", words)
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    counts = held(df.select(F.col(text).alias("__text")).mapInArrow(lambda batches: tidy(found(batches)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times))
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    room, least = most, None
    for r in counts.groupBy(step.alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect():  # a few hundred bins
        room -= r["words"]
        if room < 0:
            break
        least = r["bin"]
    top = counts.where(step >= least).collect() if least is not None else []  # at most `most` words
    return {r["word"]: i + 1 for i, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["word"])))}


def scan(text: str, least: float = LEAST, learned: dict[str, int] | None = None) -> list[Span]:
    """All spans of a text, by start, then by kind as listed in KINDS."""
    found, low = [], text.lower()
    if any(h in low for h in _BASE_HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append(Span("assign", m.start(), m.end(), m.start(2), m.end(2), guess_cost(m[2], learned)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append(Span("access", m.start(), m.end(), m.start(), m.end(), guess_cost(m[0], learned)))
    for m in HEX.finditer(text):
        found.append(Span("hex", m.start(), m.end(), m.start(), m.end(), guess_cost(m[0], learned)))
    if any(h in low for h in _HINTS):
        taken = [(s.value_start, s.value_end) for s in found]
        at = 0
        while m := CONTEXT.search(text, at):
            start, end = m.span(m.lastindex)
            at = start  # a rejected value may itself begin a context: authorization: bearer ...
            end -= len(m[m.lastindex]) - len(m[m.lastindex].rstrip(".,;:!?)]}"))
            if end - start < 6:
                continue
            if any(a <= start and end <= b for a, b in taken):
                at = end
                continue
            cost = guess_cost(text[start:end], learned)
            if cost >= least:
                found.append(Span("guess", start, end, start, end, cost))
                at = end
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def masked(text: str, spans: list[Span], mask: str = MASK) -> str:
    """The text with mask in place of each span's value; overlapping values become one."""
    out, at = [], 0
    for a, b in sorted((s.value_start, s.value_end) for s in spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("value_start", IntegerType()), StructField("value_end", IntegerType()), StructField("log10_guesses", DoubleType()),
]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("log10_guesses", pa.float64())]))


def find_secrets(df: DataFrame, *, text: str = "text", keep: list[str], least: float = LEAST, name: str = "secrets", learned: dict[str, int] | None = None) -> DataFrame:
    """The columns in keep and each text's spans, ordered. learned: learned_words of the corpus."""
    sent = df.sparkSession.sparkContext.broadcast(learned)  # at most LEARNED words
    schema = df.select(*keep).schema.add(name, SPANS)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [[s._asdict() for s in scan(t.as_py() or "", least, sent.value)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _ARROW)], schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(lambda batches: tidy(scanned(batches)), schema)


def redact(df: DataFrame, *, text: str = "text", least: float = LEAST, mask: str = MASK, learned: dict[str, int] | None = None) -> DataFrame:
    """df with every secret's value masked in the text column; null texts stay null. learned: learned_words of the corpus."""
    sent = df.sparkSession.sparkContext.broadcast(learned)  # at most LEARNED words
    names, at = df.columns, df.columns.index(text)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            spans = [scan(t.as_py() or "", least, sent.value) for t in column]
            if any(spans):
                texts = [masked(t.as_py(), s, mask) if s else t.as_py() for t, s in zip(column, spans, strict=True)]
                batch = batch.set_column(at, names[at], pa.array(texts, pa.string()))
            yield batch

    return df.mapInArrow(lambda batches: tidy(changed(batches)), df.schema)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def prices(spans: Column) -> Column:
    """log10 of each span's guesses, to one place, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.format_string("%.1f", s["log10_guesses"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
