"""Queries that have no SQL, held against plain loops over the smallest tables."""

import hashlib
import re
import unicodedata

import pytest

from lectern.functions import text as T
from lectern.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def by(found, *keys):
    out = {}
    for r in found:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def plain_chunks(text, target=1400, overlap=250):
    """The greedy packing of segments between blank lines or page ends, character by character."""
    segments, last = [], 0
    for m in [*re.finditer(r"(?:\n\s*\n|\f)+", text), None]:
        stop = m.start() if m else len(text)
        at = last
        while stop - at > target:
            window = text[at : at + target]
            marks = [i for i in range(len(window) - 1) if window[i] in ".!?" and window[i + 1] in " \n"]
            cut = at + marks[-1] + 1 if marks and marks[-1] > target / 2 else at + target
            segments.append((at, cut))
            at = cut
        segments.append((at, stop))
        last = m.end() if m else 0
    packed = []
    for a, b in segments:
        if text[a:b].strip():
            if packed and b - packed[-1][0] <= target:
                packed[-1][1] = b
            else:
                packed.append([a, b])
    out = []
    for n, (a, b) in enumerate(packed):
        if n:
            before = text[max(0, a - overlap) : a]
            marks = [i for i in range(len(before) - 1) if before[i] in ".!?" and before[i + 1] in " \n"]
            a = max(0, a - overlap) + marks[-1] + 2 if marks else a
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())
        if a < b:
            out.append((a, b))
    return out


@pytest.mark.parametrize("name", ["chunk_plain", "chunk_paged"])
def test_chunks(spark, docs, name):
    found = by(rows(spark, name), "doc_id")
    for i, text in docs.items():
        if name == "chunk_paged":
            text = re.sub(r"((?:[^\n]*\n){3}[^\n]*)\n", "\\1\f", text)
        own = sorted(found.get((i,), []), key=lambda r: r["seq"])
        assert [(r["char_start"], r["char_end"]) for r in own] == plain_chunks(text), i
        for n, r in enumerate(own):
            assert r["seq"] == n and r["text"] == text[r["char_start"] : r["char_end"]].replace("\f", "\n")
            if name == "chunk_paged" and "\f" in text:
                assert (r["page_start"], r["page_end"]) == (text[: r["char_start"]].count("\f") + 1, text[: r["char_end"] - 1].count("\f") + 1)


@pytest.mark.parametrize("name, most", [("split_llm_chunks", 2500), ("split_tts_chunks", 240)])
def test_pieces_hold_the_text_and_keep_their_size(spark, docs, name, most):
    found = by(rows(spark, name), "doc_id")
    for i, text in docs.items():
        own = [r["piece"] for r in sorted(found.get((i,), []), key=lambda r: r["seq"])]
        flat = lambda t: re.sub(r"\s+", "", t)
        if name == "split_llm_chunks":
            assert flat("".join(own)) == flat(text)
        else:
            letters = lambda t: re.sub(r"[\W_]+", "", t)
            assert letters("".join(own)) == letters(text)
        assert all(len(p) <= most or " " not in p for p in own) and all(p == p.strip() and p for p in own)


def test_passages(spark, docs):
    for r in rows(spark, "expand_passage"):
        spans = plain_chunks(docs[r["doc_id"]])[:3]
        text, done = "", -1
        for a, b in spans:
            part = docs[r["doc_id"]][a:b].replace("\f", "\n")
            text = part if done < 0 else text + (part[done - a :] if a < done else "\n\n" + part)
            done = max(done, b)
        assert r["seq"] == 1 and r["text"] == text and (r["char_start"], r["char_end"]) == (spans[0][0], done)
    assert {r["doc_id"] for r in rows(spark, "expand_passage")} == {i for i, t in docs.items() if len(plain_chunks(t)) > 1}


def blocks_of(text):
    return [(n, line) for n, line in enumerate(text.split("\n")) if line.strip()]


def test_parts_by_words(spark, docs):
    found = {(r["doc_id"], r["block"]): r["part"] for r in rows(spark, "split_by_words")}
    want = {}
    for i, text in docs.items():
        part = words = 0
        for n, line in blocks_of(text):
            want[i, n] = part + 1
            words += len(line.split())
            if words >= 500:
                part, words = part + 1, 0
    assert found == want


@pytest.mark.parametrize("name", ["detect_boundaries", "propose_boundaries"])
def test_boundaries_are_headings_of_their_text(spark, docs, name):
    for r in rows(spark, name):
        lines = dict(blocks_of(docs[r["doc_id"]]))
        line = lines[r["block"]]
        assert r["block"] == 0 or len(line) < 60
        if name == "propose_boundaries":
            assert r["title"] == line and r["page"] == r["block"] // 10 + 1


def test_languages(spark, docs):
    for r in rows(spark, "detect_language"):
        words = re.findall(r"[^\W_]+", docs[r["doc_id"]].lower())
        counts = [(sum(w in c.split() for w in words), -n, lang) for n, (lang, c) in enumerate(T._COMMON.items())]
        best = max(counts)
        assert r["guess"] == (best[2] if best[0] else None)
        assert r["detected"] == (r["guess"] if len(docs[r["doc_id"]].strip(" ")) >= 200 else None)


def test_speech(spark, docs):
    """The texts of one line, without marks that the rules rewrite, are spoken as they are."""
    found = {r["doc_id"]: r["spoken"] for r in rows(spark, "normalize_tts")}
    plain = {i: t for i, t in docs.items() if t and not re.search(r"[*_`#\[\]<]|https?:|-\n|\n\n\n|[^\S \n]", t)}
    assert len(plain) > 20
    for i, t in plain.items():
        lines = "\n".join(line.strip() for line in re.sub(r"[ \t]+", " ", t).split("\n")).strip()
        assert found[i] == hashlib.sha256(lines.encode()).hexdigest()


def key(word):
    return "".join(c for c in unicodedata.normalize("NFD", word).lower() if unicodedata.category(c)[0] in "LN")


def test_placed_blocks(spark):
    """Words that are seen exactly once, unspoilt, are found where they stand."""
    turns = by(spark.read.parquet(f"{SF}/conversations.parquet").collect(), "conv_id")
    for r in rows(spark, "place_blocks"):
        own = {t["turn"]: t["text"].split() for t in turns[(r["page"],)]}
        words = own[r["block"]]
        seen = [key(w if i % 7 != 3 else w[:-1] + "x") for ws in own.values() for i, w in enumerate(ws)]
        sure = [i for i, w in enumerate(words) if i % 7 != 3 and len(key(w)) > 3 and seen.count(key(w)) == 1]
        assert 0.9 * len(words) <= r["words"] <= len(words)  # words that read as one seen word are one
        if len(words) > 20 and len(sure) > 0.5 * len(words):
            assert r["found"] >= 0.6 * r["words"] and r["y0"] <= r["block"] * 30.0 <= r["y1"]


def test_aligned_words(spark):
    """Each name stands, word for word, at the end of what was seen: all of it is found, in order."""
    parts = {r["p_partkey"]: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for (i,), own in by(rows(spark, "align_words_nw"), "p_partkey").items():
        own = sorted(own, key=lambda r: r["at"])
        seen = f"{parts[i]['p_type']} {parts[i]['p_name']}".split(" ")
        places = [r["seen_at"] for r in own]
        assert all(r["score"] == 1.0 and not r["merged"] for r in own) and places == sorted(places)
        assert [key(seen[p]) for p in places] == [key(w) for w in parts[i]["p_name"].split(" ")]
