"""A search whose table fits walks the lists within its tasks: no round of Spark jobs a step, the same rows as the plain greedy search."""

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import ann


def test_search_by_the_table_has_no_rounds(spark, monkeypatch):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(3).normal(size=(300, 6)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rounds = []
    monkeypatch.setattr(ann, "neighbour_graph", lambda *a, _made=ann.neighbour_graph, **k: rounds.append("built") or rounds.append(_made(*a, **k)) or rounds[-1])
    monkeypatch.setattr(ann, "reclaim", lambda _: rounds.append("round"))
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    after = rounds[[isinstance(r, str) for r in rounds].index(False) + 1 :]
    assert after == []  # rounds while the graph is built only
    x = np.array([v for _, v in rows], np.float32).astype(float)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    want = [(q, b) for q in range(0, 300, 20) for b in np.argsort(-scores[q])[:5].tolist()]
    assert len(set(want) & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.95 * len(want) and len(got) == len(want)


def test_lists_by_place():
    import pyarrow as pa

    table = ann.Table(np.array([30, 10, 20, 40]), np.zeros((4, 2), np.float32))
    lists = ann.Lists(pa.table({"at": [40, 10], "near": pa.array([[10, 20], [30]], pa.list_(pa.int64()))}), table)
    assert [lists.of(np.array([p])).tolist() for p in range(4)] == [[2], [], [], [0, 1]]
    assert lists.of(np.array([3, 0])).tolist() == [0, 1, 2]
