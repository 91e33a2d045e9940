"""The Katz model against a plain version with dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import katz
from lectern.llm.tables import remainder

SCHEMA = "doc_id long, text string, train string, lang string"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def plain(rows, order):
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = {i: tokens(t) for i, t in rows}
    counts, histories = [Counter() for _ in range(order)], Counter()  # counts[k]: by (history of k words, word)

    def grams(i):
        padded = ["<s>"] * (order - 1) + docs[i]
        return [tuple(padded[j : j + order]) for j in range(len(docs[i]))]

    for i in train:
        for g in grams(i):
            for k in range(order):
                counts[k][g[order - 1 - k :]] += 1
                histories[g[order - 1 - k : -1]] += 1
    n, v = sum(counts[0].values()), len(counts[0])

    def d_of(c):
        many = Counter(c.values())
        return katz.discounts(__import__("numpy").array([many[r] for r in range(7)]))

    d = [d_of(c) for c in counts]
    disc = lambda k, c: d[k][c] * c if c <= 5 else c
    seen = sum(disc(0, c) for c in counts[0].values()) / (n + 1)
    after = defaultdict(list)
    for c in counts[1:]:
        for g in c:
            after[g[:-1]].append(g[-1])

    def p(h, w):
        k = len(h)
        c = counts[k][(*h, w)]
        if k == 0:
            return disc(0, c) / (n + 1) if c else 1 - seen
        if c:
            return disc(k, c) / (histories[h] + 1)
        if not histories[h]:
            return p(h[1:], w)
        left = 1 - sum(disc(k, counts[k][(*h, x)]) for x in after[h]) / (histories[h] + 1)
        return left / (1 - sum(p(h[1:], x) for x in after[h])) * p(h[1:], w)

    for h in list(after)[:20] + list(after)[-20:]:  # exactly normalised: all words and the unknown
        assert sum(p(h, g[-1]) for g in counts[0]) + p(h, "never met") == pytest.approx(1)
    out = {}
    for i, ts in docs.items():
        base = sum(math.log10((counts[0][w,] + 1) / (n + v + 1)) for w in ts)
        out[i] = (i in train, len(ts), sum(counts[0][w,] > 0 for w in ts), n, base, sum(math.log10(p(g[:-1], g[-1])) for g in grams(i)))
    return out


@pytest.mark.parametrize("order, frequent", [(2, 3), (2, 65_000), (3, 3), (3, 65_000), (4, 2), (4, 65_000)])
def test_against_plain(spark, order, frequent):
    words = "the of A a and To Übung x-ray zebra kilo lima mike".split()
    rows = []
    for i in range(60):
        text = " ".join(words[(i * 7 + j * j * 3 + j // 5) % len(words)] for j in range(i % 23 * 3))
        rows.append((i, text + (" rare%d" % (i // 3) if i % 2 else "\n\tend")))
    rows += [(100, None), (101, ""), (102, "  \n "), (103, "only new words here"), (104, "the of A a " * 400)]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA).repartition(3)
    got = katz.katz_scores(df, remainder(F.col("doc_id"), 7) != 2, order=order, frequent=frequent).collect()
    want = plain(rows, order)
    assert len(got) == len(want)
    for r in got:
        train, n, known, total, base, score = want[r["doc_id"]]
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (train, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert katz.katz_scores(empty, F.lit(True)).count() == 0
    df = spark.createDataFrame([(1, "a b", "", ""), (1, "a", "", ""), (1, "a", "", ""), (None, "a", "", ""), (None, None, "", "")], SCHEMA)
    got = sorted(katz.katz_scores(df, F.lit(True)).collect(), key=lambda r: (r["n_tokens"], str(r["doc_id"])))
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(None, 1, 1, 10), (1, 2, 2, 10), (1, 2, 2, 10), (None, 2, 2, 10), (1, 3, 3, 10)]
    assert got[1]["score"] == got[2]["score"] == pytest.approx(got[3]["score"]) and got[1]["base_score"] == pytest.approx(math.log10(5 / 14) + math.log10(6 / 14))
    got = katz.katz_scores(df, F.lit(False)).collect()
    assert len(got) == 5 and all(r["train_tokens"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in got)
