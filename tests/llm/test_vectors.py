"""Vector searches against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score double, v string, rank int, node int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.0, "v", 3, 4) for i, v in rows], SCHEMA)


def vectors(n, dim, seed, scale=1.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)).astype(np.float32) * scale
    x[n // 3 : n // 2] = x[0]  # many rows with one vector
    return [(i, [float(a) for a in v]) for i, v in enumerate(x)]


ODD = [(5000, None), (5001, [1.0, None, 2.0]), (5002, [float("nan"), 1.0]), (5003, [float("inf"), 1.0]), (None, [1.0, 2.0])]


def exact(rows, is_query, k, measure):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if is_query(q):
            scored = sorted((-measure(v, w), i) for i, w in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def int_dot(v, w):
    return sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, w))


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_top_k(spark, scale):
    rows = vectors(300, 7, 1, scale) + ODD + [(5100, [0.0] * 7), (5200, [1.5]), (5300, [])]
    got = {}
    for r in topk.top_k(table(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == exact(rows, lambda i: i % 20 == 0, 10, int_dot)
    few = table(spark, rows[:4])
    assert topk.top_k(few, F.col("vec_id") % 20 == 0, k=10).count() == 3
    assert topk.top_k(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("table_bytes", [ann.TABLE_BYTES, 0])
def test_ann_recall(spark, table_bytes):
    rows = vectors(900, 12, 2) + ODD + [(5100, [0.0] * 12), (5200, [1.5])]
    rows = [(i, [x * (1 + (i or 0) % 3) for x in v] if v and i and i < 5000 else v) for i, v in rows]
    want = exact([r for r in rows if r[0] != 5100], lambda i: i % 20 == 0, 20, lambda v, w: sum(a * b for a, b in zip(v, w)))
    got = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, table_bytes=table_bytes).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    true = {q: dict(w) for q, w in want.items()}
    for q, found in got.items():
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        assert all(s == pytest.approx(true[q][i]) for i, s in found if i in true[q])
    assert ann.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(table(spark, rows[:4]), F.col("vec_id") % 20 == 0, table_bytes=table_bytes)
    assert few.count() == 3
    opposite = [(0, [1.0, 2.0]), (7, [-1.0, -2.0])]
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(table(spark, opposite), F.col("vec_id") % 20 == 0, table_bytes=table_bytes).collect()] == [(7, -5.0)]


def test_ann_outliers(spark):
    """A vector opposite to all others, and a small group far from the rest, get k rows each, too."""
    draw = np.random.default_rng(9)
    x = draw.normal(size=(3000, 8)) * 0.02 + np.eye(8)[0]
    x[1000] = -np.eye(8)[0]
    x[2000:2005] = draw.normal(size=(5, 8)) * 0.02 - np.eye(8)[1] - np.eye(8)[0]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))]
    asked = [1000, 2000, 2004, 2500]
    got = {q: {} for q in asked}
    for r in ann.nearest(table(spark, rows), F.col("vec_id").isin(asked), k=20).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    assert {q: len(found) for q, found in got.items()} == dict.fromkeys(asked, 20)
    assert all(set(range(2000, 2005)) - {q} <= set(got[q]) for q in (2000, 2004))
    want = exact(rows, lambda i: i in asked, 20, lambda v, w: sum(a * b for a, b in zip(v, w)))
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in asked]) >= 0.9
