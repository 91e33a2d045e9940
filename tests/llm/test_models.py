"""The classifiers' training and the guess cost against plain versions."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import quality, secrets, toxicity
from lectern.llm.words import words

SCHEMA = "doc_id long, text string, score double, id string, k string"
TEXTS = [f"{a} {b} {c} {'!' * (i % 3)} word{i % 11}" for i, (a, b, c) in enumerate((x, y, z) for x in ("good", "BAD", "fine") for y in ("idiot", "day", "to you") for z in ("again", "and again", "1 2 3", "..."))]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, "x", "y") for i, t in enumerate(texts)], SCHEMA)


class Plain:
    """FTRL over dictionaries."""

    def __init__(self, alpha, l1, l2):
        self.z, self.n, self.alpha, self.l1, self.l2 = {}, {}, alpha, l1, l2

    def w(self, i):
        z = self.z.get(i, 0.0)
        return 0.0 if abs(z) <= self.l1 else (math.copysign(self.l1, z) - z) / ((quality.BETA + math.sqrt(self.n.get(i, 0.0))) / self.alpha + self.l2)

    def p(self, x):
        return 1 / (1 + math.exp(-sum(self.w(i) * v for i, v in x.items())))

    def learn(self, x, y, cost=1.0):
        p, old = self.p(x), {i: self.w(i) for i in x}
        for i, v in x.items():
            g, n = cost * (p - y) * v, self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * old[i]
            self.n[i] = n + g * g


def added(at, x):
    out = {}
    for i, v in zip(at.tolist(), x.tolist(), strict=True):
        out[i] = out.get(i, 0.0) + v
    return out


def test_quality_against_plain(spark):
    texts = [*TEXTS, None, "", "long " * 20_000, TEXTS[0]]
    y = {i: int("BAD" not in TEXTS[i]) for i in range(0, len(TEXTS), 2)}
    labels = spark.createDataFrame([(i, v) for i, v in y.items()], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs_of(spark, texts), labels, shards=1, bits=12).collect()}
    x = [added(*v) for v in quality.vectors(pa.array(texts, pa.string()), 12)]
    order = pd.DataFrame({"i": list(y), "h": pd.util.hash_array(np.array([str(i) for i in y], object))}).sort_values("h", kind="stable")["i"]
    model = Plain(quality.ALPHA, quality.L1, quality.L2)
    for _ in range(quality.EPOCHS):
        for i in order:
            model.learn(x[i], y[i])
    assert len(got) == len(texts)
    for i, s in got.items():
        assert s == pytest.approx(model.p(x[i]))
    assert got[len(texts) - 1] == got[0]


def test_toxicity_against_plain(spark):
    texts = [*TEXTS, None, "", "idiot " * 20_000, TEXTS[0]]
    labels = [(i, int("BAD" not in t), int("idiot" in t)) for i, t in enumerate(TEXTS) if i % 3]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["p_quality"], r["score"]) for r in toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits=12, folds=3).collect()}
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)), F.lit(3)).alias("f")).collect()}
    size, chars = 1 << 12, [set() for _ in texts]
    for w in words(pa.array(texts, pa.string()), lower=True):
        for row, feature in zip(*toxicity.features(w, 12), strict=True):
            chars[row + w.lo].add(int(feature))

    def x_of(i, before):
        weight = 1 / max(len(chars[i]), 16) ** 0.25
        x = dict.fromkeys(chars[i], weight) | {size: 1.0}
        for k, p in enumerate(before):
            p = min(max(p, 1e-6), 1 - 1e-6)
            x[size + 1 + k] = 0.2 * math.log(p / (1 - p))
        return x

    def trained(rows, c, before):
        rows = sorted(rows, key=lambda r: (r[1 + c], str(r[0]), texts[r[0]]))
        share = sum(r[1 + c] for r in rows) / len(rows)
        cost = {1: max(1.0, (1 - share) / share) ** 0.5, 0: max(1.0, share / (1 - share)) ** 0.5}
        model = Plain(toxicity.ALPHA, toxicity.L1, toxicity.L2)
        order = np.random.default_rng(11).permutation(len(rows))
        for _ in range(toxicity.EPOCHS):
            for j in order:
                model.learn(x_of(rows[j][0], before.get(rows[j][0], [])), rows[j][1 + c], cost[rows[j][1 + c]])
        return model

    unseen = {}
    for f in range(3):
        model = trained([r for r in labels if folds[r[0]] != f], 0, {})
        unseen |= {r[0]: [model.p(x_of(r[0], []))] for r in labels if folds[r[0]] == f}
    first, second = trained(labels, 0, {}), trained(labels, 1, unseen)
    assert len(got) == len(texts)
    for i, (p, s) in got.items():
        want = first.p(x_of(i, []))
        assert p == pytest.approx(want, abs=1e-9) and s == pytest.approx(second.p(x_of(i, [want])), abs=1e-9)


def every_cost(value):
    """The cheapest of all segmentations, each written out."""
    low = value.lower()
    plain = low.translate(secrets._LEET)
    runs = {(i, j): c for i, j, c in sorted(secrets._runs(low), key=lambda r: -r[2])}

    def segments(i):
        yield i + 1, math.log10(10 if value[i].isdigit() else 26 if value[i].isalpha() else 33)
        for j in range(i + 1, len(value) + 1):
            if (i, j) in runs:
                yield j, runs[i, j] + 0.3
            m = secrets._DATE.match(value, i)
            if m and m.end() == j:
                yield j, math.log10(120 if j - i == 4 else 365 * 120) + 0.3
            rank = secrets.RANK.get(plain[i:j]) if j - i >= 3 else None
            if rank:
                yield j, math.log10(rank * (1 + 3 * ((value[i:j] != low[i:j]) + (plain[i:j] != low[i:j]))) + 1) + 0.3

    def least(i):
        return min((c + least(j) for j, c in segments(i)), default=0.0) if i < len(value) else 0.0

    return least(0)


@pytest.mark.parametrize("value", ["password", "P4ssw0rd!", "aaaa1234", "qwertyui", "2024-01-31", "the2021x", "zyxwv$$$", "Hello12/3", "kX9vR2pLq7", "19991231a", "", "é日本abc"])
def test_guess_cost_is_the_least_of_all(value):
    assert secrets.guess_cost(value) == pytest.approx(every_cost(value))
