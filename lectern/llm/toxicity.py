"""Toxicity by a classifier chain.

The chain goes through the judged categories in a fixed order.  Each category has a
linear (logistic) model over hashed words and word beginnings and over the
probabilities that the chain gave the categories before.  A model learns with
out-of-fold probabilities of the earlier categories: those that models made which
had not seen the row.  So training and scoring feed a model the same kind of
numbers.

Training takes all labelled texts, or about ``max_rows`` of them by a hash of
their key if there are more.  The folds' models are trained in separate tasks.  Scoring is
one pass over the whole texts.

Defined results: a null or empty text has no word features and gets the chain's
prior; a label that is null or not 0/1 keeps the row out of training;
repeated rows are scored, and teach, once for each row; without any usable
label all probabilities are 0.5; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import Ftrl
from .tables import bounded_sample
from .words import _TABLE, Words, mix, rolling, words

BITS = 18
MAX_ROWS = 16_384
FOLDS = 3
EPOCHS = 4
ALPHA, L1, L2 = 1.0, 0.005, 0.1
#: Word beginnings of so many bytes are features, too.
BEGINNINGS = (4, 5, 6)


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The different features of each text of the chunk (which should be in lower case): row, feature, by row."""
    values = _TABLE[w.data]
    size = w.ends - w.starts
    keys, doc = [rolling(values, w.starts, w.ends)], [w.doc]
    for n in BEGINNINGS:
        at = size >= n
        keys.append(mix(rolling(values, w.starts[at], w.starts[at] + n) + np.uint64(n)))
        doc.append(w.doc[at])
    row = (np.concatenate(doc) - w.lo).astype(np.uint64)
    code = np.unique((row << np.uint64(bits)) | (np.concatenate(keys) & np.uint64((1 << bits) - 1)))
    return (code >> np.uint64(bits)).astype(np.int64), (code & np.uint64((1 << bits) - 1)).astype(np.int64)


def weight(counts: np.ndarray) -> np.ndarray:
    """What a feature of a text with so many features weighs: long texts are damped, but less than to length one."""
    return 1.0 / np.maximum(counts, 16) ** 0.25


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Model:
    """Weights of the hashed features, the constant and the earlier categories."""

    def __init__(self, bits: int, earlier: int) -> None:
        self.bits, self.earlier, self.ftrl = bits, earlier, Ftrl((1 << bits) + 1 + earlier, ALPHA, L1, L2)

    def learn(self, rows: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> np.ndarray:
        tail = np.arange(1 << self.bits, (1 << self.bits) + 1 + self.earlier)
        order = np.random.default_rng(11).permutation(len(rows))
        # the rarer label weighs more, by the root of how much rarer it is
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 0.5
        cost = np.where(y == 1, max(1.0, (1 - share) / share) ** 0.5, max(1.0, share / (1 - share)) ** 0.5)
        for _ in range(EPOCHS):
            for i in order:
                x = np.concatenate((np.full(len(rows[i]), weight(np.array(len(rows[i])))), [1.0], 0.2 * logit(before[i])))
                self.ftrl.learn(np.concatenate((rows[i], tail)), x, y[i], cost[i])
        return self.ftrl.weights()


def predict(row: np.ndarray, feature: np.ndarray, before: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    n = len(before)
    counts = np.bincount(row, minlength=n)
    z = np.bincount(row, weights[feature], minlength=n) * weight(counts) + weights[1 << bits]
    for k in range(before.shape[1]):
        z = z + weights[(1 << bits) + 1 + k] * 0.2 * logit(before[:, k])
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sparse(texts: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(row + w.lo, feature) for w in words(pa.array(texts, pa.string()), lower=True) for row, feature in [features(w, bits)]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def learner(c: int, bits: int, folds: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For category c: trains the model of the rows outside fold `model`, or of all (model = folds)."""

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        model, group = int(group["model"].iloc[0]), group.sort_values([f"y{c}", "k", "t"], kind="stable", na_position="first")
        row, feature = _sparse(group["t"].tolist(), bits)
        cuts = np.searchsorted(row, np.arange(len(group) + 1))
        before = np.stack(group["before"].tolist()) if c else np.zeros((len(group), 0))
        mine = group["fold"].to_numpy() != model
        at = np.flatnonzero(mine)
        w = Model(bits, c).learn([feature[cuts[i] : cuts[i + 1]] for i in at], before[at], group[f"y{c}"].to_numpy()[at])
        if model == folds:
            used = np.flatnonzero(w)
            return pd.DataFrame({"id": "", "place": used, "value": w[used]})
        p = predict(row, feature, before, w, bits)
        return pd.DataFrame({"id": group["id"].to_numpy()[~mine], "place": -1, "value": p[~mine]})

    return learn


def train(labelled: DataFrame, key: str, text: str, categories: list[str], *, bits: int = BITS, folds: int = FOLDS) -> list[np.ndarray]:
    """The chain's weights, one array for each category, from labelled rows, a bounded sample."""
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)])
    for i in range(len(categories)):
        rows = rows.where(F.col(f"y{i}").isin(0, 1))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("k", F.lit(9)), F.lit(folds)))
    chain: list[np.ndarray] = []
    for c in range(len(categories)):
        done = list(chain)
        if c == 0:
            rows = rows.withColumn("id", F.sha2(F.concat_ws("\x00", "k", "t"), 256)).withColumn("before", F.array().cast("array<double>"))
        last = c == len(categories) - 1
        models = F.array(*[F.lit(m) for m in ([] if last else range(folds))], F.lit(folds))
        out = rows.withColumn("model", F.explode(models)).repartition(folds + 1, "model").groupBy("model").applyInPandas(learner(c, bits, folds), "id string, place long, value double").collect()  # a bounded sample's rows, and at most 2**bits
        w = np.zeros((1 << bits) + 1 + c)
        for r in out:
            if r["place"] >= 0:
                w[r["place"]] = r["value"]
        chain = [*done, w]
        if not last:
            oof = rows.sparkSession.createDataFrame([(r["id"], r["value"]) for r in out if r["place"] < 0], "id string, p double").groupBy("id").agg(F.avg("p").alias("p"))
            rows = rows.join(oof, "id", "left").withColumn("before", F.array_append("before", F.coalesce("p", F.lit(0.5)))).drop("p")
    return chain


def score(df: DataFrame, chain: list[np.ndarray], text: str, names: list[str], *, keep: list[str], bits: int = BITS) -> DataFrame:
    """The columns in keep, and each category's probability under its name."""
    schema = df.select(*keep).schema
    for n in names:
        schema = schema.add(n, "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(chain)))
            for w in words(batch.column(batch.num_columns - 1), lower=True):
                row, feature = features(w, bits)
                for k, weights in enumerate(chain):
                    out[w.lo : w.hi, k] = predict(row, feature, out[w.lo : w.hi, :k], weights, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(out[:, k]) for k in range(len(chain)))], [*keep, *names])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(scored, schema)


def toxicity_scores(documents: DataFrame, labels: DataFrame, learn_from: Column | None = None, *, key: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("quality", "toxic"), names: tuple[str, ...] = ("p_quality", "score"), **options: int) -> DataFrame:
    """Every row of documents with the chain's probability for each category."""
    taught = labels.select(key, *categories)
    if learn_from is not None:
        taught = taught.where(learn_from)
    for c in categories:
        taught = taught.where(F.col(c).isin(0, 1))
    sample = bounded_sample(taught, key, options.pop("max_rows", MAX_ROWS), 7)
    chain = train(documents.select(key, text).join(F.broadcast(sample), key), key, text, list(categories), **options)
    return score(documents, chain, text, list(names), keep=[key], bits=options.get("bits", BITS))
