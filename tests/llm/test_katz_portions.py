"""Blocks leave a task of the Katz model in portions, not all at once."""

import numpy as np
import pyarrow as pa

from lectern.llm import katz


class Rows:
    """Gives the function that would run over Arrow batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def in_portions(batches, most):
    blocks = [[len(b) for b in x.column(1).to_pylist()] for x in batches]
    assert all(sum(x[:-1]) < most for x in blocks)
    return len(blocks) > 3


def test_blocks_leave_in_portions(monkeypatch):
    monkeypatch.setattr(katz, "PORTION", 4000)
    none = np.zeros(0, np.int64)
    model = katz.Unigrams(0, 0, np.zeros(7, np.int64), 0, none, none)
    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 900, 400)) for _ in range(20)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array([True] * 20), pa.array(texts)], ["id", "train", "text"])
    dealt = list(katz._token_blocks(Rows(), model, 16, 3)(iter([rows])))
    assert in_portions(dealt, 4000) and sum(b.num_rows for b in dealt) == 16
    sums = list(katz._sums(model, 16, 3)(iter(dealt)))
    assert in_portions(sums, 4000) and [b for x in sums for b in x.column(0).to_pylist()] == list(range(16))
