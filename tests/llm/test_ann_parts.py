"""Beyond the table, a part is sent each vector it asks for once, however many of its meetings ask for it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import Broadcast
from pyspark.sql import functions as F

from lectern.llm import ann

DIM = 9


def packed(ids, x):
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "g"])
    return next(ann._packed(iter([batch]), DIM))


def test_packed_vectors_keep_their_scale():
    x = np.random.default_rng(1).normal(size=(40, DIM)).astype(np.float32) * np.float32(10.0) ** np.arange(-20, 20)[:, None].astype(np.float32)
    x[3, :-1] = 0
    column = pa.chunked_array([packed(list(range(40)), x).column(1).slice(2, 5), packed(list(range(40)), x).column(1).slice(7)])
    back = ann._unpacked(column, DIM)
    assert (np.abs(back - x[2:]) <= np.abs(x[2:, :-1]).max(axis=1, keepdims=True) / 1024).all() and (back[:, -1] == x[2:, -1]).all()


def test_parts_are_sent_vectors_once(spark):
    asked = spark.createDataFrame([(i % 3, i % 7) for i in range(500)], "part long, node long")
    nodes = spark.createDataFrame([(i, bytearray(b"x")) for i in range(9)], "node long, g binary")
    sent = sorted((r["of"], r["node"]) for r in ann._sent(asked, nodes, 4).collect())
    assert sent == [(p, n) for p in range(3) for n in range(7)]


def test_meetings_of_a_part_offer_what_beats_the_lists():
    x = np.random.default_rng(2).normal(size=(6, DIM)).astype(np.float32)
    sent = pa.Table.from_batches([packed([5, 3, 9, 1, 7, 2], x)]).append_column("worst", pa.array([-9.0] * 5 + [99.0], pa.float32()))
    meetings = pa.table({"at": pa.array([1, 1, 1, 4, 4, 4, 4], pa.int64()), "who": pa.array([5, 3, 3, 9, 5, 2, 3], pa.int64())})
    got = {(r["a"], r["b"]): r["s"] for r in ann._met(DIM)(meetings, sent).to_pylist()}
    at = {n: r for n, r in zip([5, 3, 9, 1, 7, 2], x)}
    assert set(got) == {(a, b) for a in (5, 3, 9) for b in (5, 3, 9, 2) if a != b}
    assert all(abs(s - at[a] @ at[b]) < 0.02 for (a, b), s in got.items())


def test_the_table_is_sent_once(spark, monkeypatch):
    """All rounds and steps read one broadcast; their functions do not hold the vectors."""

    class Seen(Exception):
        pass

    def graph(nodes, dim, count, table, **_):
        raise Seen(table)

    monkeypatch.setattr(ann, "neighbour_graph", graph)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)], "vec_id long, embedding array<float>")
    with pytest.raises(Seen) as seen:
        ann.nearest(rows, F.col("vec_id") % 4 == 0, k=2)
    sent = seen.value.args[0]
    assert isinstance(sent, Broadcast)
    assert sent.value.ids.tolist() == list(range(1, 9)) and sent.value.data.shape == (8, 3)
    assert np.allclose((sent.value.data**2).sum(axis=1), 1) and np.allclose(sent.value.of(np.array([8]))[0, :2], np.array([8, 1]) / 65**0.5)
