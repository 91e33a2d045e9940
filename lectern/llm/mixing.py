"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is its share of all words by weight, at most ``most``
times its own words; what a source cannot take is shared by the others by
weight again.  A document is wanted target / source size times.  It is taken the
whole part of that, and the fraction left over is rounded by pivotal sampling:
two fractional documents of a source trade probability, keeping their expected words
together, until one of them is settled at 0 or 1; the other goes on to the
next.  Large documents go first, each in one direction against all smaller ones, so that no large one is left to the
end.  So every document keeps its own probability, and a source's words miss
the target by at most one document's size: of about twice the median document's, unless the smaller
documents of a block cannot make up for a large one.

Trading runs in blocks of at most about ``block`` documents, which split any
large source; each block leaves at most one unsettled document, and these meet
in blocks again, ``fan_in`` at a time, until each source has one left, which is
drawn.  All draws come from the seed, the source and the block, so reruns agree.

Defined results: null, empty and blank texts have size 0 and are never taken;
a null source is a source of its own, ordered last; repeated rows count, and are taken,
each for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import held, numbered
from .words import WORD, seeded

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 4096
FAN_IN = 256
SEED = 29


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, budget: float = 1.0) -> DataFrame:
    """For each source: its number, source_size, n_docs and target.

    sizes: rows with source and size. weights: by the sources' order, repeating.
    The shared level rises until no source above its cap is left out; each round
    is one small aggregation over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "source_id")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    per = held(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level != before:
        before = level
        over = F.col("cap") < F.col("weight") * F.lit(level)
        capped, free = per.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        level = max(level, (budget * total - (capped or 0.0)) / free)
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return per.select("source", "source_id", "source_size", "n_docs", target.alias("target"))


def _settled(p: np.ndarray) -> np.ndarray:
    """Probabilities within rounding of 0 or 1 are 0 or 1."""
    return np.where((p < 1e-12) | (p > 1 - 1e-12), np.round(p), p)


def directed(size: np.ndarray, p: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Settle each large row (over twice the median) against all smaller ones at once; sizes descend.

    Its direction is drawn once, up with its own probability. It then moves all the way to 1 or 0, and each smaller row gives, or
    takes, so many words that its own expectation stays. It stays between only if the smaller rows cannot bear that much.
    """
    p = p.copy()
    open_ = (p > 0) & (p < 1)
    most = 2 * np.median(size[open_]) if open_.any() else 0.0
    for j in np.flatnonzero(open_ & (size > most)):
        if not 0 < p[j] < 1:
            continue
        i = j + 1 + np.flatnonzero((p[j + 1 :] > 0) & (p[j + 1 :] < 1) & (size[j + 1 :] < size[j]))
        bear = np.minimum(p[i] / (1 - p[j]), (1 - p[i]) / p[j]) * size[i]
        part = min(1.0, size[j] / bear.sum()) if len(i) else 0.0
        words = bear * part
        step = 1 - p[j] if draw.random() < p[j] else -p[j]
        p[i] = _settled(np.clip(p[i] - step * words / size[i], 0, 1))
        p[j] = _settled(p[j] + step * min(1.0, words.sum() / size[j]))
    return p


def pivotal(size: np.ndarray, p: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """Settle probabilities in pairs at 0 or 1; the place of the one that is left between, or -1. Sizes descend."""
    p, left = directed(size, p, draw), -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if left < 0:
            left = i
            continue
        a, b, j = size[left], size[i], left
        up = min((1 - p[j]) * a, p[i] * b)  # words that may move from i to j
        down = min(p[j] * a, (1 - p[i]) * b)
        moved = up if draw.random() * (up + down) < down else -down
        p[j] += moved / a
        p[i] -= moved / b
        p[j], p[i] = _settled(p[j]), _settled(p[i])
        left = j if 0 < p[j] < 1 else i if 0 < p[i] < 1 else -1
    return p, left


def mix(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, budget: float = 1.0, seed: int = SEED, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: key, size, source_size, target, copies and taken (words)."""
    sizes = held(documents.select(F.col(key), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    per = targets(sizes, weights, most, budget)
    rows = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).select(sizes[key], "size", "source_size", "target", "source_id", "n_docs")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.when(F.abs(wanted - F.round(wanted)) < 1e-9, F.round(wanted)).otherwise(wanted)
    whole = F.floor(wanted)
    blocks = F.ceil(F.col("n_docs") / block)
    rows = rows.select(
        key, "size", "source_size", "target", "source_id", whole.alias("whole"),
        F.when(F.col("size") > 0, wanted - whole).otherwise(0.0).alias("p"),
        F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), blocks).alias("block"),
    )
    schema = rows.schema

    def settle(last: bool, level: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            order = pd.DataFrame({"size": -group["size"], "key": group[key].astype(str)}).sort_values(["size", "key"], kind="stable").index
            group = group.loc[order]
            draw = np.random.default_rng(seeded(seed, int(group["source_id"].iloc[0]), level, int(group["block"].iloc[0])))
            p, left = pivotal(group["size"].to_numpy(np.float64), group["p"].to_numpy(), draw)
            if last and left >= 0:
                p[left] = float(draw.random() < p[left])
            group["p"] = p
            return group

        return run

    most_blocks = per.agg(F.max(F.ceil(F.col("n_docs") / block))).first()[0] or 1
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    done, left, level = [], rows, 0
    while True:
        last = most_blocks <= 1
        settled = held(left.where(fractional).groupBy("source_id", "block").applyInPandas(settle(last, level), schema))
        done += [left.where(~fractional), settled.where(~fractional)] if level == 0 else [settled.where(~fractional)]
        if last:
            break
        left = settled.where(fractional).withColumn("block", F.floor(F.col("block") / fan_in))
        most_blocks, level = -(-most_blocks // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select(key, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(documents: DataFrame, mixed: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Each document as often as the mix takes it. Rows that share a key are taken equally often, the most that any of them was drawn."""
    copies = mixed.where("copies > 0").groupBy(key).agg(F.max("copies").cast("int").alias("__copies")).withColumnRenamed(key, "__key")
    joined = documents.join(copies, documents[key].eqNullSafe(F.col("__key")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[documents[c] for c in documents.columns])
