"""Near duplicates among vectors against all pairs."""

import numpy as np
import pytest

from lectern.llm import capfilters

SCHEMA = "vec_id long, embedding array<float>, label int, class string, filter int, times double, v string"


def plain(rows, limit):
    good = [(n, i, np.array(v, float), g) for n, (i, v, g) in enumerate(rows) if v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {n: set() for n, *_ in good}
    for a, (n, _, v, g) in enumerate(good):
        for m, _, w, h in good[:a]:
            k = max(len(v), len(w))
            p, q = np.pad(v, (0, k - len(v))), np.pad(w, (0, k - len(w)))
            if g == h and p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= limit:
                near[n].add(m)
                near[m].add(n)
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in near.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        named = [rows[m][0] for m in seen if rows[m][0] is not None]
        name = min(named) if named else None
        out.append((i, len(near.get(n, ())), name, i is not None and name == i))
    return sorted(out, key=repr)


def families(n, dim, seed, spread):
    """Random vectors; a third are unlike near copies of one, others copies in pairs, and some equal."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    x[: n // 3] = x[0] + draw.normal(size=(n // 3, dim)) * spread
    for i in range(n // 2, n - 10, 9):
        x[i + 1] = x[i] + draw.normal(size=dim) * spread
    x[-6:] = x[-7]
    return [(int(i), [float(a) for a in v.astype(np.float32)], int(i) % 7 == 0 and i > n // 2) for i, v in enumerate(x)]


def found(spark, rows, limit=0.93):
    table = spark.createDataFrame([(i, v, None if g is None else int(g), "x", 1, 0.5, "v") for i, v, g in rows], SCHEMA)
    return sorted(map(tuple, capfilters.near_duplicates(table, limit=limit).collect()), key=repr)


@pytest.mark.parametrize("block, sent", [(1024, 1 << 16), (32, 1 << 16), (32, 0)])
def test_links_and_components_equal_all_pairs(spark, monkeypatch, block, sent):
    monkeypatch.setattr(capfilters, "BLOCK", block)  # small blocks: a filter is cut, its blocks meet pairwise
    monkeypatch.setattr(capfilters, "SENT", sent)
    rows = families(360, 64, 5, 0.22)
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [float("nan")] * 64, 1), (904, [1.0, None], 1), (905, rows[0][1], None), (None, rows[0][1], 0), (None, None, None), (3, rows[5][1], 0), (3, rows[200][1], 0)]
    assert found(spark, rows + odd) == plain(rows + odd, 0.93)


def test_few_components_shorter_vectors_and_large_numbers(spark):
    rows = [(i, [1.0, 0.01 * i], 1) for i in range(60)] + [(100, [5.0], 1), (101, [3e38, 1e37], 1), (102, [-1.0, 0.0], 1), (103, [1e-40, 0.0], 1)]
    assert found(spark, rows) == plain(rows, 0.93)


def test_empty_table_and_nothing_usable(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1), (2, [1.0], None)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_pairs_at_the_limit_share_a_filter():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = draw.normal(size=x.shape)
    y -= (x * y).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1)[:, None]
    code = capfilters.Code(64)
    pairs = [set(zip(*map(np.ndarray.tolist, code.decode(z)))) for z in (x, y)]
    assert len({row for row, _ in pairs[0] & pairs[1]}) == len(x)
    per_row = np.bincount(code.decode(x)[0], minlength=len(x))
    assert per_row.min() >= capfilters.LEAST and per_row.mean() < 45
