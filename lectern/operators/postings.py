"""A stored search index: where each word stands in each row of a table, and searches that read only the asked words.

The index is a Parquet table (term, key, positions) in partitions by the hash of the term, each file sorted by
term and key. It is written once; a search reads the partitions of its words, and of their
files the row groups that can hold them. Rows are dealt to files by key as well, so that the postings of a very common word are
many files' and no task's alone. Each row also has a posting of the empty term, so that
queries that only exclude words can be answered.

Matching and ranking use positions alone. A phrase stands where its words' positions, each less its place in the phrase, meet.
The cover density of a row sums 0.1 * terms / max(1, extent / terms) over its shortest spans that hold every wanted term.

Defined results: a null or empty text has only the empty term; rows with a null key are not indexed; rows that share a key count as
one row, whose texts' positions are merged; a query without words finds nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .relational import portions
from .retrieval import LEG, parse_query

#: Partitions of the index by term; files that one partition is dealt to, at least.
BUCKETS, FILES = 64, 8
#: Bytes of words that are put in order at a time.
PORTION = 1 << 22

Parsed = list[list[tuple[bool, list[str]]]]


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _listed(batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """term, key and positions of a batch of rows key, words."""
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = batch.column(1).flatten().dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64) * batch.num_rows + row  # the rows of a term stand together
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(at[order], pa.int32()))
    of = code[starts]
    yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(of // batch.num_rows)), batch.column(0).take(pa.array(of % batch.num_rows)), positions], names)
    none = pa.ListArray.from_arrays(pa.array(np.zeros(batch.num_rows + 1), pa.int32()), pa.array([], pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array([""] * batch.num_rows), batch.column(0), none], names)


def postings(rows: DataFrame, *, key: str, text: str) -> DataFrame:
    """term, key and positions (ascending, from 0) of every word of every row.

    A row's words are put in order where the row is; postings meet only where rows share a key, which the keys alone tell.
    """
    own = rows.where(F.col(key).isNotNull())
    words = own.select(F.col(key).alias("key"), T.words_of(F.col(text)).alias("words"))
    schema = StructType(StructType.fromDDL("term string").fields + words.select("key").schema.fields + StructType.fromDDL("positions array<int>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, PORTION):
            if batch.num_rows:
                yield from _listed(batch, schema.names)

    listed = words.mapInArrow(run, schema)
    if not own.groupBy(key).count().where("count > 1").limit(1).count():
        return listed
    return listed.groupBy("term", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))


def write_index(rows: DataFrame, path: str, *, key: str, text: str, buckets: int = BUCKETS, files: int = FILES) -> None:
    """Write the index of rows to path (a folder all executors share)."""
    listed = postings(rows, key=key, text=text).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # parts enough that all of a shuffle's tasks have some, however large the index; Spark puts small ones together
    deals = max(files, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    dealt = listed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(deals))).sortWithinPartitions("bucket", "term", "key")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def terms_of(parsed: Parsed) -> list[str]:
    return list(dict.fromkeys(t for a in parsed for _, ts in a for t in ts))


def lookup(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """term, key and positions of the asked terms: partitions and row groups of others are not read."""
    numbers = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), buckets)).collect()  # the terms of one query
    index = spark.read.parquet(path)
    return index.where(F.col("bucket").isin(*{r[0] for r in numbers}) & F.col("term").isin(*terms)).select("term", "key", "positions")


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p + by) if by else positions


def _starts(tokens: list[str]) -> Column:
    """Where a phrase stands in a row: its words' positions, each less its place in the phrase, in common."""
    none = F.array().cast("array<int>")
    at = [_moved(F.coalesce(F.element_at("at", t), none), -i) for i, t in enumerate(tokens)]
    found = at[0]
    for more in at[1:]:
        found = F.array_intersect(found, more)
    return found


def matched(found: DataFrame, parsed: Parsed) -> DataFrame:
    """key and at (a map of the asked terms to positions) of the rows that match; found: the postings of all asked terms and the empty one."""
    rows = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # a query's terms at most
    any_of = F.lit(False)
    for alternative in parsed:
        all_of = F.lit(True)
        for wanted, tokens in alternative:
            holds = F.size(_starts(tokens)) > 0
            all_of &= holds if wanted else ~holds
        any_of |= all_of
    return rows.where(any_of)


def cover_ranks(rows: DataFrame, parsed: Parsed) -> DataFrame:
    """key and cover of matched rows: the cover density of each alternative's wanted words, summed, to nine places."""
    total = None
    for alternative in parsed:
        wanted = [(tokens, i) for ok, tokens in alternative if ok for i in range(len(tokens))]
        if not wanted:
            continue
        n = len(wanted)
        marks = F.array(*[F.struct(F.lit(k).alias("k"), _moved(_starts(tokens), i).alias("ps")) for k, (tokens, i) in enumerate(wanted)])
        stands = rows.select("key", F.explode(marks).alias("m")).select("key", "m.k", F.explode("m.ps").alias("p"))
        so_far = Window.partitionBy("key").orderBy("p", "k").rowsBetween(Window.unboundedPreceding, 0)  # one row's words
        last = [F.max(F.when(F.col("k") == k, F.col("p"))).over(so_far) for k in range(n)]
        full = stands.select("key", "p", *[c.alias(f"l{k}") for k, c in enumerate(last)]).dropna()
        start = F.least(*[F.col(f"l{k}") for k in range(n)]) if n > 1 else F.col("l0")
        spans = full.select("key", "p", start.alias("start")).groupBy("key", "start").agg(F.min("p").alias("p"))
        part = F.lit(0.1 * n) / F.greatest(F.lit(1.0), (F.col("p") - F.col("start") + 1) / F.lit(float(n)))
        ranked = spans.groupBy("key").agg(F.sum(F.round(part, 12).cast("decimal(20,12)")).alias("cover"))
        total = ranked if total is None else total.union(ranked)
    none = rows.select("key", F.lit(0).cast("decimal(20,12)").alias("cover"))
    total = none if total is None else total.union(none)
    return total.groupBy("key").agg(F.round(F.sum("cover").cast("double"), 9).alias("cover"))


def search(spark: SparkSession, path: str, query: str, *, buckets: int = BUCKETS, most: int = LEG, within: DataFrame | None = None) -> DataFrame:
    """The best matching rows by cover density: key, cover and rank (from 1), ties to the smaller key. within: keys (column key) to search."""
    parsed = parse_query(query)
    terms = terms_of(parsed)
    if not terms:
        return lookup(spark, path, [""], buckets).where("false").select("key", F.lit(0.0).alias("cover"), F.lit(0).alias("rank"))
    only_excluding = any(not any(ok for ok, _ in a) for a in parsed)
    found = lookup(spark, path, [*terms, ""] if only_excluding else terms, buckets)
    if within is not None:
        found = found.join(within.select("key"), "key", "left_semi")
    best = cover_ranks(matched(found, parsed), parsed).orderBy(F.desc("cover"), "key").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cover"), "key")))  # at most `most` rows
