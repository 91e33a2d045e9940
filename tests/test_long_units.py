"""Units too long for one table or one row: sentence alignment, cues, batches, spans."""

import random

import numpy as np
import pytest

from lectern.operators import align, library, reading


def total(steps):
    return sum(-align.SKIP * (p + q) if not p or not q else s - align.BASE - align.MERGE_COST * (p + q - 2) for _, p, _, q, s in steps)


def best_total(source, target, ss, ts):
    """Cell by cell."""

    def group(v, size, i, k):
        s = (v[i : i + k] * size[i : i + k, None]).sum(0)
        return s / max(np.linalg.norm(s), 1e-12)

    n, m = len(source), len(target)
    best = np.full((n + 1, m + 1), -np.inf)
    best[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            for p in range(5):
                for q in range(5):
                    if i + p > n or j + q > m or (p, q) == (0, 0) or min(p, q) > 2 or (min(p, q) == 0 and p + q > 1):
                        continue
                    gain = -align.SKIP if not p or not q else group(source, ss, i, p) @ group(target, ts, j, q) - align.BASE - align.MERGE_COST * (p + q - 2)
                    best[i + p, j + q] = max(best[i + p, j + q], best[i, j] + gain)
    return best[n, m]


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_sentence_alignment_reaches_the_best_total(monkeypatch):
    monkeypatch.setattr(align, "GAIN", 10.0)  # nothing is put out of a group
    draw = np.random.default_rng(3)
    for n, m in [(0, 3), (3, 0), (1, 1), (5, 7), (9, 6), (8, 8)] * 3:
        base = draw.normal(size=(max(n, m, 1), 6))
        s, t = unit(base[:n] + draw.normal(size=(n, 6)) * 0.3) if n else np.zeros((0, 6)), unit(base[:m] + draw.normal(size=(m, 6)) * 0.3) if m else np.zeros((0, 6))
        ss, ts = draw.integers(1, 30, n).astype(float), draw.integers(1, 30, m).astype(float)
        steps = align.align_sentences(s, t, ss, ts)
        assert total(steps) == pytest.approx(best_total(s, t, ss, ts))
        assert sum(p for _, p, *_ in steps) == n and sum(x[3] for x in steps) == m


def test_long_chapters_are_cut_at_sure_pairs(monkeypatch):
    monkeypatch.setattr(align, "CELLS", 400)
    draw = np.random.default_rng(4)
    v = unit(draw.normal(size=(150, 16)))
    extra = unit(draw.normal(size=(10, 16)))
    target = np.vstack((extra, v))
    steps = align.align_sentences(v, target, np.ones(150), np.ones(160))
    assert {(i, j) for i, p, j, q, _ in steps if p == q == 1} >= {(i, i + 10) for i in range(5, 150)}
    far = align.align_sentences(unit(np.eye(60)), unit(np.eye(60)[::-1]), np.ones(60), np.ones(60))
    assert sum(p for _, p, *_ in far) == 60 and sum(x[3] for x in far) == 60


def test_a_chapter_beyond_the_old_limit():
    draw = np.random.default_rng(5)
    v = unit(draw.normal(size=(1600, 8)))
    steps = align.align_sentences(v, v, np.ones(1600), np.ones(1600))
    assert [(i, p, j, q) for i, p, j, q, _ in steps] == [(i, 1, i, 1) for i in range(1600)]


def plain_cues(words):
    out, cue = [], None
    for s, e, t in words:
        cue = [cue[0] if cue else s, e, (cue[2] if cue else []) + [t]]
        if t[-1:] in ".!?" and e - cue[0] >= reading.MIN_CUE_MS:
            out.append(cue)
            cue = None
    if cue:
        if out and cue[1] - cue[0] < reading.MIN_CUE_MS:
            out[-1] = [out[-1][0], cue[1], out[-1][2] + cue[2]]
        else:
            out.append(cue)
    return [(n, s, e, " ".join(t)) for n, (s, e, t) in enumerate(out)]


def test_cues_of_long_units(spark):
    draw = random.Random(2)
    rows = []
    for u in ["a", "b", None, "d"]:
        for n in range(3000 if u == "a" else draw.randrange(1, 9)):
            rows.append((u, n, n * 400, n * 400 + draw.choice([100, 350]), draw.choice(["one", "two.", "three", "four!"])))
    table = spark.createDataFrame(rows, "u string, n int, s long, e long, t string").repartition(3)
    got = {}
    for r in reading.sentence_cues(table, "u", ["n"], "s", "e", "t").collect():
        got.setdefault(r["u"], []).append((r["cue"], r["start_ms"], r["end_ms"], r["text"]))
    for u in ["a", "b", None, "d"]:
        assert sorted(got[u]) == plain_cues([r[2:] for r in rows if r[0] == u])
    assert reading.sentence_cues(table.limit(0), "u", ["n"], "s", "e", "t").count() == 0


def test_batches_of_long_units(spark):
    draw = random.Random(3)
    rows = [(u, n, draw.randrange(0, 900)) for u in (1, 2, None) for n in range(2000 if u == 1 else 5)]
    got = {(r["u"], r["n"]): r["batch"] for r in library.link_batches(spark.createDataFrame(rows, "u int, n int, size int"), "u", "n", "size", most=1000).collect()}
    for u in (1, 2, None):
        batch, held = 0, 0
        for _, n, size in [r for r in rows if r[0] == u]:
            if held > 0 and held + size > 1000:
                batch, held = batch + 1, 0
            held += size
            assert got[u, n] == batch
    with pytest.raises(Exception, match="too long"):
        library.link_batches(spark.createDataFrame([(1, 1, 13_000)], "u int, n int, size int"), "u", "n", "size").collect()


def test_spans_of_rows_that_share_a_key_and_of_odd_texts(spark):
    rows = [(1, "One. Two!"), (1, "Three? four"), (2, None), (3, ""), (4, "A\x07b. ­c\n\nd\n\nE…\" F"), (5, "word " * 50_000 + "end.")]
    table = spark.createDataFrame(rows, "doc long, text string")
    out = sorted((r["doc"], r["start"], r["end"], r["sentence"]) for r in reading.sentences(table, ["doc"], "text").collect() if r["doc"] < 5)
    assert out == [(1, 0, 4, "One."), (1, 0, 6, "Three?"), (1, 5, 9, "Two!"), (1, 7, 11, "four"), (4, 0, 4, "A\x07b."), (4, 5, 10, "­c\n\nd"), (4, 12, 15, 'E…"'), (4, 16, 17, "F")]
    assert reading.tokens(table, ["doc"], "text").where("doc = 5").count() == 50_001
    assert "Exchange" not in reading.tokens(table, ["doc"], "text")._jdf.queryExecution().executedPlan().toString()


def test_running_totals_of_large_groups(spark):
    from pyspark.sql import functions as F

    from lectern.operators import relational

    draw = random.Random(6)
    rows = [(draw.choice(["big"] * 8 + ["small", None]), n, draw.choice([1, 5, None])) for n in range(3000)]
    table = spark.createDataFrame(rows, "g string, n int, v long").repartition(7)
    got = {r["n"]: r["before"] for r in relational.long_running_total(table, ["g"], [F.col("n")], "v", "before").collect()}
    sums = {}
    for g, n, v in rows:
        assert got[n] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    assert relational.long_running_total(table.limit(0), ["g"], [F.col("n")], "v", "before").count() == 0
