"""Quality classifier: hashed word n-gram logistic regression trained by FTRL.

A text's features are its words, its pairs of neighbouring words, the shapes
of its words (letter case, digits, marks) alone, in pairs and in threes, and how much of its
word pairs, long ones and lines it repeats, all hashed into one weight table of 2**bits
numbers.  Counts are damped by log1p and each text's vector has length one.

Training takes all labelled texts, or about ``max_rows`` of them by a hash of
their key if there are more, in ``shards`` tasks; each task runs follow-the-regularised-
leader over its own rows and the shards' weights are averaged feature by
feature.  Scoring is one pass over the texts, a sparse dot product each.

Defined results: a null or empty text has only the constant feature and gets the prior's
score; rows whose label is null or not 0/1 teach nothing; repeated rows are
scored (and teach) once for each row; without any usable label every score is
0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded_sample
from .words import Words, mix, windows, words

BITS = 18
MAX_ROWS = 16_384
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5

_CLASS = np.full(256, 5, np.uint8)  # 0 upper, 1 lower, 2 digit, 3 sentence mark, 4 other mark, 5 other byte
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 4
_CLASS[list(b".,;:!?'\"-()")] = 3


def _shapes(w: Words) -> np.ndarray:
    """A small number for each word: which classes of bytes it has, how many marks, its first and last byte."""
    kind = _CLASS[w.data]
    shape = np.zeros(len(w.starts), np.int64)
    for c, most in ((0, 2), (1, 1), (2, 2), (3, 3), (4, 3), (5, 1)):
        sums = np.concatenate(([0], np.cumsum(kind == c, dtype=np.int64)))
        shape = shape * 4 + np.minimum(sums[w.ends] - sums[w.starts], most)
    if len(shape):
        shape = (shape * 8 + kind[w.starts]) * 8 + kind[w.ends - 1]
    return shape.astype(np.uint64)


def _repeated(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts, the share of its keys that it has had before, and how many keys."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    total = np.bincount(doc, minlength=n)
    return np.bincount(d[again], minlength=n) / np.maximum(total, 1), total


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's texts as sparse vectors of length one: row, feature, value, by row."""
    n, doc = w.hi - w.lo, w.doc - w.lo
    h = w.hashes()
    s = mix(_shapes(w) + np.uint64(1))
    found = [(doc, h, 0.5)]
    for keys, k, salt, weight in ((h, 2, 2, 0.5), (s, 1, 3, 1.0), (s, 2, 4, 1.0), (s, 3, 5, 1.0)):
        g, at = windows(keys, w.first, k)
        found.append((doc[at], mix(g + np.uint64(salt)), weight))
    rows = [np.repeat(np.arange(n), 3)]
    g, at = windows(h, w.first, 2)
    pairs, total = _repeated(g, doc[at], n)
    g, at = windows(h, w.first, 5)
    fives, _ = _repeated(g, doc[at], n)
    length = np.log2(total + 1).astype(np.int64) // 2
    extra = np.stack([np.zeros(n, np.int64), 1000 + (pairs * 20).astype(np.int64) * 16 + length, 100_000 + (fives * 20).astype(np.int64)], axis=1)
    keys = [mix(extra.ravel().astype(np.uint64) + np.uint64(77))]
    values = [np.tile(np.array([0.3, 0.6, 0.6]), n)]
    for d, g, weight in found:
        # the counts of a group of features make a vector of that length
        code = (d.astype(np.uint64) << np.uint64(40)) | (g & np.uint64((1 << bits) - 1))
        distinct, counts = np.unique(code, return_counts=True)
        row = (distinct >> np.uint64(40)).astype(np.int64)
        value = np.log1p(counts)
        norm = np.sqrt(np.bincount(row, value * value, minlength=n))
        rows.append(row)
        keys.append(distinct)
        values.append(weight * value / norm[row])
    row, feature, value = np.concatenate(rows), (np.concatenate(keys) & np.uint64((1 << bits) - 1)).astype(np.int64), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, size: int, alpha: float = ALPHA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.l1, self.l2 = alpha, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((BETA + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        at, which = np.unique(at, return_inverse=True)  # two features may share a place
        x = np.bincount(which, x)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def vectors(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's features and values, in order."""
    for w in words(texts):
        row, feature, value = features(w, bits)
        cuts = np.searchsorted(row, np.arange(w.hi - w.lo + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield feature[a:b], value[a:b]


def train(labelled: DataFrame, key: str, text: str, label: str, *, bits: int = BITS, shards: int = SHARDS) -> np.ndarray:
    """The weight table learnt from labelled rows, a bounded sample."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("k", F.lit(5)), F.lit(shards)))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["k", "y"], key=lambda c: pd.util.hash_array(c.to_numpy()) if c.name == "k" else c, kind="stable")
        model, y = Ftrl(1 << bits), group["y"].to_numpy()
        seen = list(vectors(pa.array(group["t"].tolist(), pa.string()), bits))
        for _ in range(EPOCHS):
            for (at, x), label_ in zip(seen, y, strict=True):
                model.learn(at, x, label_)
        w = model.weights()
        at = np.flatnonzero(w)
        return pd.DataFrame({"f": at, "w": w[at] * len(group), "n": np.full(len(at), len(group))})

    learnt = rows.repartition(shards, "shard").groupBy("shard").applyInPandas(learn, "f long, w double, n long")
    out = np.zeros(1 << bits)
    # each shard counts by its rows, also where it has no weight; at most 2**bits rows come back
    sizes = rows.groupBy("shard").count().agg(F.sum("count")).first()[0]
    for r in learnt.groupBy("f").agg(F.sum("w").alias("w")).orderBy("f").collect():
        out[r["f"]] = r["w"] / sizes
    return out


def score(df: DataFrame, weights: np.ndarray, text: str, *, keep: list[str], name: str = "score") -> DataFrame:
    """The columns in keep, and the probability of label 1 as column name."""
    bits = int(np.log2(len(weights)))
    schema = df.select(*keep).schema.add(name, "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for w in words(batch.column(batch.num_columns - 1)):
                row, feature, value = features(w, bits)
                out[w.lo : w.hi] = np.bincount(row, weights[feature] * value, minlength=w.hi - w.lo)
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*keep, name])

    # the text goes last, under a name of its own, since it may also be a column to keep
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(scored, schema)


def quality_scores(documents: DataFrame, labels: DataFrame, learn_from: Column | None = None, *, key: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None, **options: int) -> DataFrame:
    """Every row of documents with its score.

    learn_from: a condition on key; rows of labels for which it doesn't hold teach nothing.
    keep: the columns to return beside ``score`` (the key alone, if not given).
    """
    taught = labels.select(key, label)
    if learn_from is not None:
        taught = taught.where(learn_from)
    # choose the bounded sample by key first, so that only its texts move
    bound = options.pop("max_rows", MAX_ROWS)
    sample = bounded_sample(taught.where(F.col(label).isin(0, 1)), key, bound, 3)
    weights = train(documents.select(key, text).join(F.broadcast(sample), key), key, text, label, **options)
    return score(documents, weights, text, keep=keep or [key])
