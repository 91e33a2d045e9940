"""A page's words are compared once for all its blocks, many pairs at a time, and as each pair alone."""

import random

import numpy as np
import pytest

from lectern.operators import align, placing


def some_words(r, n, shortest, longest):
    return ["".join(r.choices("abcdeé𝔘", k=r.randrange(shortest, longest))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "cells", "rough"), [(9, 16_000_000, 1 << 20), (64, 16_000_000, 100), (90, 16_000_000, 1 << 20), (12, 2_000, 300)])
def test_likeness_is_that_of_each_pair(monkeypatch, longest, cells, rough):
    monkeypatch.setattr(align, "CELLS", cells)
    monkeypatch.setattr(align, "ROUGH", rough)
    r = random.Random(longest)
    ys = [*some_words(r, 60, 0, longest), "", "abcde", "a"]
    alike = align.Likeness(ys)
    for n in (30, 3, 30):
        xs = [*some_words(r, n, 0, longest), *(y[:-1] + "x" for y in ys[:9]), ys[3], ""]
        against = r.sample(ys, 20)
        assert alike.of(xs, against).tolist() == [[align._units(x, y) for y in against] for x in xs]
    assert align.Likeness([]).of(["a"], []).shape == (1, 0) and alike.of([], ys).shape == (0, len(ys))


def test_a_page_compares_few_words_one_pair_at_a_time(monkeypatch):
    r, asked, true = random.Random(4), [], align.edit_distance
    texts = [" ".join("".join(r.choices("etaoinsr", k=r.randrange(3, 10))) for _ in range(90)) for _ in range(6)]
    seen = [((w[:-1] + "x" if i % 7 == 3 else w), n, (i, n, i + 1, n + 1)) for n, t in enumerate(texts) for i, w in enumerate(t.split())]
    align.similarity.cache_clear()
    monkeypatch.setattr(align, "edit_distance", lambda a, b: asked.append(1) or true(a, b))
    placed = placing.place_page(texts, seen)
    doubtful = sum(w["score"] is not None and w["score"] < 1 for w in placed)
    assert 0 < len(asked) <= doubtful
    assert sum(w["score"] is not None for w in placed) > 0.9 * len(seen)


def test_pages_of_odd_rows(spark):
    blocks = spark.createDataFrame([(None, 1, "alpha beta"), ("a", 2, "gamma"), ("b", None, "delta"), ("b", 1, "delta")], "page string, block int, text string")
    seen = spark.createDataFrame([(None, 0, "alpha", 0, 0.0, 0.0, 1.0, 1.0), (None, 1, None, 0, 1.0, 0.0, 2.0, 1.0), ("b", 0, "delta", 0, 0.0, 0.0, 1.0, None), ("b", 1, "delta", 0, 2.0, 0.0, 3.0, 1.0), ("c", 0, "more", 0, 0.0, 0.0, 1.0, 1.0)], "page string, word int, text string, line int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page"], r["block"], r["at"]): (r["text"], r["seen"], r["x0"], r["y1"], r["score"]) for r in placing.place_blocks(blocks, seen, "page").collect()}
    none = ([], None, None, None)
    assert got == {(None, 1, 0): ("alpha", [0], 0.0, 1.0, 1.0), (None, 1, 1): ("beta", *none), ("a", 2, 0): ("gamma", *none), ("b", 1, 0): ("delta", [1], 2.0, 1.0, 1.0), ("b", None, 0): ("delta", *none)}
    assert not np.isnan([v[2] or 0 for v in got.values()]).any()
