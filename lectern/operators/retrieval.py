"""Search over chunks: keyword and vector legs, rank fusion, grouping and passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunks import _listed

LEG, RRF = 50, 60
PER_UNIT, PER_BOOK = 2, 3


# ---- keyword leg ----


def parse_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-style query as alternatives of (wanted, words in a row): AND by default, "phrases", or, -not."""
    alternatives: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus:
            alternatives.append([])
            continue
        tokens = re.findall(r"[^\W_]+", phrase or word)
        if tokens:
            alternatives[-1].append((not minus, tokens))
    return [a for a in alternatives if a]


def _holds(words: Column, joined: Column, tokens: list[str]) -> Column:
    if len(tokens) == 1:
        return F.array_contains(words, tokens[0])
    return F.contains(joined, F.lit(" " + " ".join(tokens) + " "))


def matches(text: Column, query: str) -> Column:
    """Whether a text matches the query; a query without words matches nothing."""
    words = T.words_of(text)
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    any_of = F.lit(False)
    for alternative in parse_query(query):
        all_of = F.lit(True)
        for wanted, tokens in alternative:
            hit = _holds(words, joined, tokens)
            all_of &= hit if wanted else ~hit
        any_of |= all_of
    return any_of


def cover_density(positions: list[list[int]]) -> float:
    """Sum over the shortest spans that hold every term of 0.1 * terms / extent, extents growing with words between."""
    events = sorted((p, t) for t, ps in enumerate(positions) for p in ps)
    if not events or any(not ps for ps in positions):
        return 0.0
    last: dict[int, int] = {}
    rank, end_of_last = 0.0, -1
    for p, t in events:
        last[t] = p
        if len(last) == len(positions):
            start = min(last.values())
            if start > end_of_last:
                extent = max(1.0, (p - start + 1) / len(positions))
                rank += 0.1 * len(positions) / extent
                end_of_last = start
    return rank


def _positions(words: list[str], tokens: list[str]) -> list[list[int]]:
    """Where each token of a phrase stands, of whole occurrences of the phrase only."""
    n = len(tokens)
    starts = [i for i in range(len(words) - n + 1) if words[i : i + n] == tokens]
    return [[i + j for i in starts] for j in range(n)]


def cover_rank(words: list[str], query: list[list[tuple[bool, list[str]]]]) -> float:
    """Cover density of the wanted words, summed over the alternatives of a query."""
    terms = [[tokens for wanted, tokens in alternative if wanted] for alternative in query]
    return sum(cover_density([ps for tokens in t for ps in _positions(words, tokens)]) for t in terms)


def keyword_leg(chunks: DataFrame, query: str, *, key: str, text: str, most: int = LEG, by_hits: bool = False) -> DataFrame:
    """The best matching rows by cover density, or by how often they have the query's words: key, hits and rank (from 1)."""
    parsed = parse_query(query)
    wanted = list(dict.fromkeys(t for a in parsed for ok, ts in a if ok for t in ts))
    words = T.words_of(F.col(text))
    hits = F.size(F.filter(words, lambda w: w.isin(*wanted))) if wanted else F.lit(0)
    rows = chunks.where(matches(F.col(text), query)).select(key, hits.cast("long").alias("hits"), words.alias("__words"))
    if by_hits:
        order = [F.desc("hits"), F.col(key)]
        rows = rows.drop("__words")
    else:
        order = [F.desc("__cover"), F.col(key)]
        schema = rows.select(key, "hits").schema.add("__cover", "double")

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                covers = [float(cover_rank(w.as_py() or [], parsed)) for w in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covers, pa.float64())], schema.names)

        rows = rows.mapInArrow(ranked, schema)
    best = rows.orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(key, "hits", "rank")  # at most `most` rows


# ---- vector leg ----


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_leg(vectors: DataFrame, query: DataFrame, *, key: str, vector: str, most: int = LEG) -> DataFrame:
    """The rows nearest to the one query vector (a DataFrame of one row): key, distance and rank."""
    asked = F.broadcast(query.select(F.col(vector).alias("__q")).limit(1))  # one row
    near = vectors.where(F.col(vector).isNotNull()).join(asked, F.lit(True)).select(key, (1 - cosine(F.col(vector), F.col("__q"))).alias("distance"))
    best = near.orderBy("distance", key).limit(most)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))  # at most `most` rows
    return ranked.withColumn("distance", F.round("distance", 6))  # ranked by the exact distance


def fuse(legs: list[DataFrame], key: str, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion: key and the sum of 1 / (k + rank) over the legs that have it."""
    out = None
    for i, leg in enumerate(legs):
        one = leg.select(key, (1.0 / (F.lit(float(k)) + F.col("rank"))).alias(f"s{i}"))
        out = one if out is None else out.join(one, key, "full")
    total = F.lit(0.0)
    for i in range(len(legs)):
        total = total + F.coalesce(f"s{i}", F.lit(0.0))
    return out.select(key, total.alias("score"))


# ---- grouping the fused hits ----

_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[a-zA-Z]")


def _is_cyrillic(text: str) -> bool:
    cyrillic, latin = len(_CYRILLIC.findall(text or "")), len(_LATIN.findall(text or ""))
    return cyrillic > latin


def _chars(a: dict, b: dict) -> bool:
    return a["char_start"] < b["char_end"] and b["char_start"] < a["char_end"]


def _pages(a: dict, b: dict) -> bool:
    spans = [a["page_start"], a["page_end"], b["page_start"], b["page_end"]]
    return all(x is not None and x == x for x in spans) and a["page_start"] <= b["page_end"] and b["page_start"] <= a["page_end"]


def same_passage(a: dict, b: dict) -> bool:
    """Whether two hits are the same printed passage: same file, pages and (nearly) words."""
    if a["book"] != b["book"] or not a["file"] or a["file"] != b["file"] or not _pages(a, b):
        return False
    x, y = (re.findall(r"[^\W_]+", h["text"].lower()) for h in (a, b))
    if x and x == y:
        return True
    grams = [{tuple(w[i : i + 8]) for i in range(len(w) - 7)} for w in (x, y)]
    shared = len(grams[0] & grams[1])
    return shared >= 3 and shared >= 0.6 * min(map(len, grams))


def group_hits(hits: list[dict], query: str, limit: int, book: object = None) -> list[dict]:
    """Hits by score, with few of one unit and book, in the query's script, each passage once.

    A hit has id, book, unit, file, source (raw, chapter, translation), language, text, score,
    char_start, char_end, page_start and page_end. book: the one book searched, whose caps are lifted.
    """
    script = _is_cyrillic(query)
    ranked = sorted(hits, key=lambda h: -h["score"])
    units: dict[object, list[dict]] = {}
    for hit in ranked:
        kept = units.setdefault(hit["unit"], [])
        most = limit if book is not None and hit["book"] == book else PER_UNIT
        same_kind = lambda g, h=hit: (g["source"], g["language"]) == (h["source"], h["language"])
        if not kept or (len(kept) < most and all(same_kind(g) and not _chars(g, hit) for g in kept)):
            kept.append(hit)
    chosen: list[dict] = []
    for unit, kept in units.items():
        top = kept[0]
        twin = None
        if _is_cyrillic(top["text"]) != script:
            twin = next((h for h in ranked if h is not top and h["unit"] == unit and not _chars(h, top) and h["score"] >= 0.8 * top["score"] and _is_cyrillic(h["text"]) == script), None)
        chosen += [twin or top, *kept[1:]]
    chosen.sort(key=lambda h: -h["score"])
    out: list[dict] = []
    per_book: dict[object, int] = {}
    for hit in chosen:
        other = {"raw": "chapter", "chapter": "raw"}.get(hit["source"])
        at = next((i for i, o in enumerate(out) if o["source"] == other and same_passage(o, hit)), None)
        if at is not None:
            if hit["source"] == "chapter":
                out[at] = {**hit, "score": out[at]["score"]}
            continue
        most = limit if book is not None and hit["book"] == book else PER_BOOK
        if per_book.get(hit["book"], 0) < most and len(out) < limit:
            out.append(hit)
            per_book[hit["book"]] = per_book.get(hit["book"], 0) + 1
    return out


def grouped(hits: DataFrame, query: str, limit: int = 12, book: object = None) -> DataFrame:
    """group_hits over the (at most two legs of) fused hits: the same columns and place."""
    names = hits.columns
    schema = hits.select("*").schema.add("place", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.astype(object).where(b.notna(), None).to_dict("records")]
        rows.sort(key=lambda r: (-r["score"], str(r["id"])))
        out = group_hits(rows, query, limit, book)
        yield pd.DataFrame([{**h, "place": i + 1} for i, h in enumerate(out)], columns=[*names, "place"])

    return hits.coalesce(1).mapInPandas(run, schema)


# ---- passages ----


def expand_passages(chunks: DataFrame, wanted: DataFrame, *, unit: str, before: int = 1, after: int = 1) -> DataFrame:
    """For each wanted (unit, seq) its chunk and neighbours as one text: overlaps go, gaps become blank lines."""
    w = wanted.select(F.col(unit).alias("__u"), F.col("seq").alias("__s"))
    near = chunks.join(w, (F.col(unit) == F.col("__u")) & (F.col("seq") >= F.col("__s") - before) & (F.col("seq") <= F.col("__s") + after))
    parts = near.groupBy(unit, "__s").agg(F.array_sort(F.collect_list(F.struct("seq", "char_start", "char_end", "text"))).alias("p"))

    def add(state: Column, x: Column) -> Column:
        done = state["to"]
        more = F.when(done < 0, x["text"]).when(x["char_start"] < done, F.substring(x["text"], done - x["char_start"] + 1, F.length(x["text"]))).otherwise(F.concat(F.lit("\n\n"), x["text"]))
        return F.struct(F.greatest(done, x["char_end"]).alias("to"), F.concat(state["text"], more).alias("text"))

    merged = F.aggregate("p", F.struct(F.lit(-1).alias("to"), F.lit("").alias("text")), add)
    return parts.select(unit, F.col("__s").alias("seq"), F.element_at("p", 1)["char_start"].alias("char_start"), F.array_max(F.transform("p", lambda x: x["char_end"])).alias("char_end"), merged["text"].alias("text"))


def shingle_list(text: str | None, n: int = 8) -> list[str]:
    """Different runs of n lower-case words."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))


def passage_pairs(a: DataFrame, b: DataFrame, *, least: int = 3, share: float = 0.6, n: int = 8) -> DataFrame:
    """Pairs of (id, text) rows of two tables with at least `least` common n-word runs and `share` of the smaller set."""
    def grams(d: DataFrame, p: str) -> DataFrame:
        listed = _listed(d, ["id"], ["text"], lambda text: shingle_list(text, n), "array<string>", pa.list_(pa.string()), "g")
        return listed.select(F.col("id").alias(f"{p}_id"), F.size("g").cast("long").alias(f"{p}_n"), F.explode("g").alias("g"))

    met = grams(a, "a").join(grams(b, "b"), "g").groupBy("a_id", "b_id").agg(F.count("*").alias("shared"), F.max("a_n").alias("a_n"), F.max("b_n").alias("b_n"))
    return met.where((F.col("shared") >= least) & (F.col("shared") >= share * F.least("a_n", "b_n"))).select("a_id", "b_id", "shared")


# ---- index maintenance ----


def reindex(old: DataFrame, new: DataFrame, keys: list[str], *, text: str = "text") -> DataFrame:
    """What becomes of each (unit, seq): keep (same text), replace, delete or insert."""
    o = old.select(*keys, F.col(text).alias("old_text"), F.lit(True).alias("in_old"))
    n = new.select(*keys, F.col(text).alias("new_text"), F.lit(True).alias("in_new"))
    both = o.join(n, keys, "full")
    action = F.when(F.col("in_new").isNull(), "delete").when(F.col("in_old").isNull(), "insert").when(F.col("old_text").eqNullSafe(F.col("new_text")), "keep").otherwise("replace")
    return both.select(*keys, action.alias("action"), "new_text")


def source_hash(text: Column, *parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(2).alias("version"), text.alias("text"), *parts)), 256)


def verify_citations(answers: DataFrame, catalog: DataFrame, *, key: str, text: str, pattern: str = r"\[(c_[0-9]+)\]") -> DataFrame:
    """The cited ids that the catalog (column cited) has, in order: key, place (of all cited ids) and cited."""
    cited = answers.select(key, F.posexplode(T.citation_ids(F.col(text), pattern)).alias("place", "cited"))
    return cited.join(catalog.select("cited").distinct(), "cited", "left_semi").select(key, "place", "cited")
