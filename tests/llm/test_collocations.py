"""Phrases against a plain count."""

import random
import re
from collections import Counter

import pytest

from lectern.llm import collocations

SCHEMA = "doc_id long, text string, lang string, piece string, f int, phrase string, n int"


def plain(rows, words, least, top, share):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, words + 1):
                    if i + k <= len(w):
                        f[lang, w[i : i + k]] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = []
    by_lang = {}
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= share * a and (lang, w) in inside:
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(seed, count):
    draw = random.Random(seed)
    words = ['say "so"', '"', "the", "The", "cat", "dog", "é", "ß", "x'y", " ", "a-b", "of", "日本", "on", "in"]
    rows = []
    for _ in range(count):
        bits = []
        for _ in range(draw.randrange(0, 30)):
            bits.append(draw.choice(words) if draw.random() < 0.7 else "new york city" if draw.random() < 0.7 else "ad hoc")
            bits.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", " \r\n"]))
        rows.append(("".join(bits), draw.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + rows[:5] + [(None, "en"), ("", "en"), (" \t ", None), ("...", "de")]


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, t, lang, "p", 1, "q", 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, collocations.collocations(table, **how).collect()))


@pytest.mark.parametrize("words, least, top, share", [(3, 10, 2000, 50), (2, 3, 7, 50), (4, 4, 2000, 60), (5, 3, 40, 30)])
def test_phrases_equal_a_plain_count(spark, words, least, top, share):
    rows = texts(words, 150)
    assert found(spark, rows, words=words, least=least, top=top, share=share) == plain(rows, words, least, top, share)


def test_long_texts_hot_phrase_and_many_tasks(spark):
    rows = [("hot pair " * 20000, "en")] + [("hot pair again", "en")] * 50 + [(f"word{i} " * 300, "en") for i in range(40)]
    assert found(spark, rows) == plain(rows, 3, 10, 2000, 50)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    many = 1_234_567_890_123
    monkeypatch.setattr(collocations, "pieces", lambda docs, *_: spark.createDataFrame([("en", "a b x", many), ("en", "b", 10**12), ("en", "a", 7)], "lang string, piece string, times long"))
    rows = {r["phrase"]: tuple(r)[3:] for r in collocations.collocations(spark.range(1)).collect()}
    n = 3 * many + 10**12 + 7
    assert rows == {"a b x": (many, many + 7, many, n, 10**6 * many // (many + 7))}


def test_windows_of_pieces():
    import pyarrow as pa

    piece, head, rest = collocations.windows(pa.array(["zero", "a\t b  c d", "", "é f"]).slice(1), 3)
    assert list(zip(piece.tolist(), head.to_pylist(), rest.to_pylist())) == [(0, "a b", "c"), (0, "b c", "d"), (0, "c d", ""), (0, "d", ""), (2, "é f", ""), (2, "f", "")]
