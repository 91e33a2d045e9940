"""Python objects are made for a small portion of a batch at a time, however many rows the batch has."""

import pyarrow as pa
import pytest

from lectern.operators.relational import PORTION, portions
from lectern.plans import registry

SMALL = "/root/testdata/sf0.01"


def test_portions_keep_rows_and_order():
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3, 4]), pa.array(["a" * 50, None, "b" * 1000, "", "c" * 50])], ["n", "text"])
    out = list(portions(iter([batch, batch.slice(0, 0)]), 200))
    assert pa.Table.from_batches(out).to_pylist() == batch.to_pylist()
    assert all(b.nbytes <= 200 or b.num_rows == 1 for b in out) and len(out) > 2


@pytest.mark.parametrize("name", ["same_source_passage", "span_timing", "align_texts_diff", "chunk_plain", "chunk_paged", "rects_for_range", "split_llm_chunks", "reader_blocks"])
def test_large_batches_are_taken_in_portions(spark, monkeypatch, name):
    frame = type(spark.range(0))
    ran = []

    def kept(self, run, schema, *a, f=frame.mapInArrow, **b):
        ran.append((self, run))
        return f(self, run, schema, *a, **b)

    monkeypatch.setattr(frame, "mapInArrow", kept)
    registry.QUERIES[name](spark, SMALL)
    monkeypatch.undo()
    large = 0
    for rows, run in ran:
        whole = rows.toArrow().combine_chunks().to_batches()
        if whole and whole[0].nbytes > PORTION:
            large += 1
            assert len(list(run(iter(whole[:1])))) >= 2
    assert large
