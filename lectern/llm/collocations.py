"""Phrases whose words come together more often than apart, by language.

Texts are cut into pieces at punctuation and line ends, and identical pieces are counted once, with their
multiplicity.  Each word of a piece gives the window of up to `words` words that it begins, with the
piece's multiplicity.  Equal windows are added up, some hundred thousand at a time, and packed by the hash of their first two words,
so that a shuffle partition (a hash bucket) gets all occurrences of the phrases of two words and
more that begin so.  In each bucket DuckDB adds the windows up, on its own scratch file and with bounded memory,
and gives the phrases that are frequent enough; its word counts are added up across buckets.  The counts
of a phrase's two parts are then looked up by requests that are shuffled to where the counts are.

The score of a phrase with count a, cut into parts with counts l and r, is floor(1000000 * a * a / (l * r)), in whole
numbers; it is exact for counts up to 10 ** 16.

Defined results: a null text has no pieces; a null language is ``und``; equal rows count each; of cuts with equal scores the
first counts; of equally good phrases the first in byte order; a language without candidates has no rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import csv
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import held
from .words import _TABLE, buffers, mix, rolling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a text is cut into pieces, and what words of a piece are made of.
CUTS, BLANKS = r"[.,;:!?\x0A-\x0D]", " \t"
#: Parts of a language's candidates that are ranked each for itself first.
SALTS = 64
#: What DuckDB may hold in memory in a task.
MEMORY = "256MB"
#: Windows that a task adds up and packs at a time.
PACKED = 400_000
_FIRST = "split_part(head, ' ', 1)"


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece and times of the different pieces of all texts."""
    cut = F.split(F.translate(F.col(text), UPPER, LOWER), CUTS)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode(cut).alias("piece"))
    rows = rows.select("lang", F.btrim("piece", F.lit(BLANKS)).alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("times"))


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] as strings; empty where end is not beyond start."""
    sizes = np.maximum(ends - starts, 0)
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    inner = np.arange(at[-1], dtype=np.int64) + np.repeat(starts - at[:-1], sizes)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(data[inner]))


def windows(column: pa.Array, words: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each word of each piece: the piece's index, the word and the next as one string, and up to words - 2 more (empty if none)."""
    at, data = buffers(column)
    data, at = data[at[0] : at[-1]], at - at[0]
    n = len(data)
    inside = (data != 0x20) & (data != 0x09)
    first = np.zeros(n + 1, bool)  # where a piece begins
    first[at[:-1]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[first[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[np.flatnonzero(first[1:])] = False
    ends = np.flatnonzero(inside & ~after) + 1
    piece = np.searchsorted(at, starts, "right") - 1
    if len(starts) > 1 and (~inside).sum() and ((starts[1:] - ends[:-1])[piece[1:] == piece[:-1]] != 1).any() or (data == 0x09).any():
        # words one space apart: the first blank after each word stays, as a space
        keep = inside.copy()
        keep[ends[ends < n]] = True
        moved = np.concatenate(([0], np.cumsum(keep)))
        data = np.where(inside, data, 0x20).astype(np.uint8)[keep]
        starts, ends = moved[starts], moved[ends]
    last = np.searchsorted(piece, piece, "right") - 1  # the piece's last word
    i = np.arange(len(starts))
    head = _slices(data, starts, ends[np.minimum(i + 1, last)])
    third = np.minimum(i + 2, len(starts) - 1) if len(starts) else i
    rest = _slices(data, starts[third], np.where(i + 2 <= last, ends[np.minimum(i + words - 1, last)], 0))
    return piece, head, rest


def _packed(rows: list[pa.Table], parts: int) -> Iterator[tuple[int, bytes]]:
    """A packet for each part: its windows, equal ones added up, as compressed lines."""
    table = pa.concat_tables(rows).group_by(["part", "lang", "head", "rest"], use_threads=False).aggregate([("times", "sum")])
    part = table["part"].to_numpy()
    packer = zstandard.ZstdCompressor(level=6)
    times = pc.binary_join_element_wise(table["times_sum"].cast(pa.string()), "", "\n")
    lines = pc.binary_join_element_wise(table["lang"], table["head"], table["rest"], times, "\t")
    lines = lines.take(pa.array(np.argsort(part, kind="stable"))).combine_chunks()
    at, data = buffers(lines)
    ends = at[np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))]
    for p in np.unique(part).tolist():
        yield p, packer.compress(data[ends[p] : ends[p + 1]])


def _windowed(counted: DataFrame, words: int, parts: int) -> DataFrame:
    """part, bytes and packet: the windows of counted pieces, dealt by language and first two words and packed many to a row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.Table] = []
        n = 0

        def taken() -> pa.RecordBatch:
            part, packet = zip(*_packed(rows, parts))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(packet, pa.binary())], ["part", "packet"])

        for batch in batches:
            piece, head, rest = windows(batch.column(1), words)
            lang = batch.column(0).dictionary_encode()
            marks = np.array([zlib.crc32(x.encode()) for x in lang.dictionary.to_pylist()], np.uint64)
            at, data = buffers(head)
            hashes = mix(rolling(_TABLE[data], at[:-1], at[1:]) + marks[lang.indices.to_numpy()][piece])
            part = (hashes % np.uint64(parts)).astype(np.int32)
            times = batch.column(2).to_numpy(zero_copy_only=False)[piece]
            rows.append(pa.table({"part": part, "lang": lang.take(pa.array(piece)).cast(pa.string()), "head": head, "rest": rest, "times": times}))
            n += len(part)
            if n >= PACKED:
                yield taken()
                n = 0
        if n:
            yield taken()

    return counted.select("lang", "piece", "times").mapInArrow(found, "part int, packet binary")


def count_phrases(packets: DataFrame, words: int, least: int, parts: int) -> DataFrame:
    """lang, k, phrase and f: phrases of 2 and more words with f >= least, and words (k = 1) with the counts of their buckets."""
    types = {"lang": pa.string(), "head": pa.string(), "rest": pa.string(), "times": pa.int64()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        unpacker = zstandard.ZstdDecompressor()

        def unpacked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packet in batch.column(1):
                    lines = unpacker.decompress(packet.as_py())
                    table = csv.read_csv(pa.BufferReader(lines), csv.ReadOptions(use_threads=False, column_names=list(types)), csv.ParseOptions(delimiter="\t", quote_char=False), csv.ConvertOptions(column_types=types, strings_can_be_null=False))
                    yield from table.to_batches()

        rows = unpacked()
        head = next(rows, None)
        if head is None:
            return
        with tempfile.TemporaryDirectory() as scratch:  # DuckDB's own spill, gone with the task
            con = duckdb.connect(os.path.join(scratch, "bucket.duckdb"), config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})
            all_ = pa.RecordBatchReader.from_batches(head.schema, chain([head], rows))  # noqa: F841  (DuckDB reads it by its name)
            con.execute("CREATE TABLE counts AS SELECT lang, head, rest, CAST(sum(times) AS BIGINT) AS f FROM all_ GROUP BY ALL")
            asked = [
                f"SELECT lang, 1 AS k, {_FIRST} AS phrase, CAST(sum(f) AS BIGINT) AS f FROM counts GROUP BY ALL",
                f"SELECT lang, 2 AS k, head AS phrase, CAST(sum(f) AS BIGINT) AS f FROM counts WHERE contains(head, ' ') GROUP BY ALL HAVING sum(f) >= {least}",
            ]
            for k in range(3, words + 1):
                part = "rest" if words == 3 else f"array_to_string(string_split(rest, ' ')[1:{k - 2}], ' ')"
                long_ = "" if words == 3 else f"AND len(string_split(rest, ' ')) >= {k - 2}"
                asked.append(f"SELECT lang, {k} AS k, head || ' ' || {part} AS phrase, CAST(sum(f) AS BIGINT) AS f FROM counts WHERE rest <> '' {long_} GROUP BY ALL HAVING sum(f) >= {least}")
            for sql in asked:
                for part in con.sql(sql).to_arrow_reader(20_000):
                    yield part.cast(pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())]))
            con.close()

    return packets.repartitionById(parts, "part").mapInArrow(found, "lang string, k int, phrase string, f bigint")


def _within(words: Column, lengths: Column, top: Column) -> Column:
    """All runs of lengths words, shorter than top."""
    sizes = F.filter(lengths, lambda k: k < top)
    return F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), top - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))))


def collocations(docs: DataFrame, words: int = 3, least: int = 10, top: int = 2000, share: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first top phrases of 2 to words words that occur least times or more.

    A phrase goes if it lies inside a longer candidate with share percent of its count or more.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = held(count_phrases(_windowed(pieces(docs, text, lang), words, parts), words, least, parts))
    single = counted.where("k = 1").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    single = held(single.select("lang", F.lit(1).alias("k"), "phrase", "f"))
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    many = counted.where("k > 1")
    split = F.split("phrase", " ")

    inner = _within(split, F.array(*[F.lit(k) for k in range(2, max(words, 3))]), F.col("k"))
    longer = many.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = many.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("f")))

    def part(lo: Column, n: Column) -> Column:
        return F.array_join(F.slice(split, lo, n), " ")

    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.array(F.struct((c * 2).alias("ask"), part(F.lit(1), c).alias("part")), F.struct((c * 2 + 1).alias("ask"), part(c + 1, F.col("k") - c).alias("part")))))
    asked = left.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "k", "a", "cut.ask", F.col("cut.part").alias("part"))
    known = single.where(F.col("f") >= least).union(many.select("lang", "k", "phrase", "f")).select("lang", F.col("phrase").alias("part"), "f")
    answers = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "k", "a").agg(F.map_from_entries(F.collect_list(F.struct("ask", "f"))).alias("f"))

    a = "CAST(a AS DECIMAL(16,0))"
    score = f"CAST((CAST(1000000 AS DECIMAL(7,0)) * {a} * {a}) DIV (CAST(f[c * 2] AS DECIMAL(19,0)) * CAST(f[c * 2 + 1] AS DECIMAL(19,0))) AS BIGINT)"
    scores = F.expr(f"transform(sequence(1, k - 1), c -> struct({score} AS score, c AS c, f[c * 2] AS l, f[c * 2 + 1] AS r))")
    best = answers.select("lang", "phrase", "a", F.array_min(scores).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
