"""Exact top-k by integer inner product with a three-phase uniform threshold.

A vector's components become floor(scale * x).  The dimensions are cut into
``lists`` groups; a group's partial score is one local list.  Queries are packed in
blocks and vectors in chunks, and each block meets each chunk in a task of its own:

1. Each chunk gives every query the k best entries of each of its local lists,
   scored in full.  The k-th best of these is a safe cutoff for the query: the k-th best of all is no lower.
2. The cutoffs go back to the query blocks.  A total that reaches the cutoff has a
   partial score of at least cutoff / lists in some list, so only entries that
   reach this in a list are collected; the rest of a chunk is not looked at again.
3. Collected entries are resolved exactly, and those under the cutoff dropped;
   each chunk passes on its k best, from which the k best of all are ranked.

Ties go to the smaller id throughout.  Defined results: vectors that are null or hold a
null or non-finite component take no part, also not as queries; of vectors of
different length the shorter counts as padded with zeros; rows that share an id
are candidates each for itself, never for their own id, and search once (with the least
vector); scores beyond 64 bits stop at the bounds; fewer candidates than k give them all; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import held

SCALE = 1024
LISTS = 4
#: Queries in a block; vectors in a chunk.
BLOCK, CHUNK = 512, 4096


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _packed(rows: DataFrame, scale: int) -> DataFrame:
    """ids, dim and data (whole numbers, as doubles) of chunks of rows id, v."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                x = np.floor(_matrix(part.column(1)) * scale)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy(zero_copy_only=False).tobytes()]), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()])], ["ids", "dim", "data"])

    return rows.mapInArrow(found, "ids binary, dim int, data binary")


def _unpacked(ids: bytes, dim: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids_ = np.frombuffer(ids, np.int64)
    return ids_, np.frombuffer(data, np.float64).reshape(len(ids_), dim)


def _partials(q: np.ndarray, v: np.ndarray, lists: int) -> np.ndarray:
    """Partial scores: list, query, vector. Exact: in doubles where all sums stay under 2**53, else in whole numbers."""
    dim = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, v))
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(dim, 1) >= 2**53:
        to_int = np.frompyfunc(int, 1, 1)
        q, v = to_int(q), to_int(v)
    cuts = np.linspace(0, dim, lists + 1).astype(int)
    return np.stack([q[:, a:b].dot(v[:, a:b].T) if b > a else np.zeros((len(q), len(v))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, score long"


def _rows(qi: np.ndarray, vi: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    if score.dtype == object:
        score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score], np.int64)
    return pd.DataFrame({"query_id": qi, "vec_id": vi, "score": score.astype(np.int64)})


def _first(batches: Iterator[pd.DataFrame], k: int, lists: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            (qi, q), (vi, v) = _unpacked(r.q_ids, r.q_dim, r.q_data), _unpacked(r.ids, r.dim, r.data)
            p = _partials(q, v, lists)
            own = qi[:, None] == vi[None, :]
            out = []
            for one in p:
                one = np.where(own, -np.inf, one.astype(np.float64))
                m = min(k, one.shape[1])
                out.append(np.argpartition(-one, m - 1, axis=1)[:, :m])
            at = np.concatenate(out, axis=1)
            row = np.repeat(np.arange(len(qi)), at.shape[1])
            pair = np.unique(row * len(vi) + at.ravel())
            row, at = pair // len(vi), pair % len(vi)
            mine = ~own[row, at]
            row, at = row[mine], at[mine]
            total = p.sum(axis=0)[row, at]
            yield _best(qi[row], vi[at], total, k)


def _best(qi: np.ndarray, vi: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query."""
    rows = _rows(qi, vi, score).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return rows[rows.groupby("query_id").cumcount() < k]


def _second(batches: Iterator[pd.DataFrame], k: int, lists: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            (qi, q), (vi, v) = _unpacked(r.q_ids, r.q_dim, r.q_data), _unpacked(r.ids, r.dim, r.data)
            cut = np.frombuffer(r.cutoffs, np.float64)
            p = _partials(q, v, lists)
            # a whole number's share of the cutoff, rounded down, so that nothing is missed
            reach = np.zeros(p.shape[1:], bool)
            for one in p:
                reach |= one.astype(np.float64) >= np.floor(cut / lists)[:, None]
            reach &= qi[:, None] != vi[None, :]
            row, at = np.nonzero(reach)
            total = p.sum(axis=0)[row, at]
            high = total.astype(np.float64) >= cut[row]
            yield _best(qi[row[high]], vi[at[high]], total[high], k)


def top_k(vectors: DataFrame, query_filter: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = SCALE, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id and score; query_filter: a condition on key."""
    spark = vectors.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = usable(vectors, key, vector)
    chunks = _packed(rows, scale).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))
    queries = usable(vectors.where(query_filter), key, vector).groupBy("id").agg(F.min("v").alias("v"))
    queries = held(queries)
    blocks = max(1, -(-queries.count() // BLOCK))
    packed = held(_packed(queries.repartition(blocks, "id").sortWithinPartitions("id"), scale))
    packed = packed.select(F.xxhash64("ids").alias("block"), F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))

    def met(left: DataFrame) -> DataFrame:
        """Each block with each chunk: blocks go to every salt, a chunk is in one."""
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        return left.join(chunks.hint("shuffle_hash"), "salt")

    first = met(packed).select("q_ids", "q_dim", "q_data", "ids", "dim", "data").mapInPandas(lambda b: _first(b, k, lists), _FOUND)
    known = _ranked(first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
    cutoff = known.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("cut"))
    # beyond 2**53 doubles are not exact; a slightly lower cutoff is still safe
    cutoff = cutoff.withColumn("cut", F.when(F.abs("cut") >= 2.0**53, F.col("cut") - F.abs("cut") * 1e-14).otherwise(F.col("cut")))

    def with_cutoffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The packed queries again, with each one's cutoff in the same order."""
        for batch in batches:
            x = np.floor(_matrix(batch.column(1)) * scale)
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (batch.column(0).to_numpy(zero_copy_only=False).tobytes(), x.tobytes(), batch.column(2).to_numpy(zero_copy_only=False).tobytes())] + [pa.array([x.shape[1]], pa.int32())], ["q_ids", "q_data", "cutoffs", "q_dim"])

    cut = queries.join(cutoff, "id", "left").select("id", "v", F.coalesce("cut", F.lit(float("-inf"))).alias("cut"))
    cut = held(cut.repartition(blocks, "id").mapInArrow(with_cutoffs, "q_ids binary, q_data binary, cutoffs binary, q_dim int"))
    second = met(cut).select("q_ids", "q_dim", "q_data", "cutoffs", "ids", "dim", "data").mapInPandas(lambda b: _second(b, k, lists), _FOUND)
    return _ranked(second, k).select("query_id", "rank", "vec_id", "score")
