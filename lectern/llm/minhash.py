"""MinHash near-dedup by a signature-coordinate inverted join.

Rows are sets of word shingles.  Equal sets are one class.  A class's signature has
``coords`` minima, and classes are posted under (coordinate, value) pairs:

1. Counting.  A coordinate whose value no other class has can't match.  Two classes
   that match in at least ``matches`` coordinates are both left with that many live ones;
   all others end here.
2. Prefixes.  A class is posted under its rarest live coordinates only, as many as it has
   above ``matches - 1``: of two classes that match in ``matches``, one of these is common to both.
3. Collisions.  In each posting list every class meets the list's leader, the
   class with the most live coordinates (in a group of near copies that is the copy
   with the fewest changes), and the coordinates they share are counted.  Pairs with ``matches`` or more are confirmed on the full
   sets, and confirmed links make components.
4. The rest.  A leader's family is all classes of the lists it leads, so classes that could be
   linked are in a family together.  In families that hold more than one component, a class
   whose shingles are too often its own can't be linked to any other and ends here.  Of
   what is left, the classes outside the family's main component count collisions with the
   classes of other components, in blocks of at most ``CELL`` by ``CELL`` that split any large family.
   Counting goes through the coordinates a few at a time and skips whatever can no longer reach ``matches``; what reaches it is
   confirmed on the full sets, and each class gets one link for each component it is linked to.

Nothing is capped: what the leaders leave open, step 4 settles.  A pair at exactly the
similarity limit misses ``matches`` with a probability of at most 1e-6 (see matches_for).

Keys are whole numbers (of any other type, only those that Spark casts to one).

Defined results: lower-casing is for A-Z; a text with fewer words than the shingle has one
shingle, all its words; null, empty and blank texts have no shingles and no links; a
null key keeps its row, without links; rows with one key are linked each for its own text, and
the key joins what they are linked with; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import held
from .words import Words, mix, rolling, seeded, windows, words

COORDS = 64
#: Classes on either side of a comparison of components.
CELL = 512
#: Parts of a long list or a large family; coordinates counted at a time.
SALTS, STRIDE = 16, 8
_SALT = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.array([seeded(41, i) | 1 for i in range(COORDS)], np.uint64)


def matches_for(percent: int, coords: int = COORDS, missed: float = 1e-6) -> int:
    """The most coordinates that may be asked for if a pair at the limit is to be missed with at most that probability."""
    p, below, least = percent / 100, 0.0, 0
    while True:
        below += math.comb(coords, least) * p**least * (1 - p) ** (coords - least)
        if below > missed:
            return max(1, least)
        least += 1


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a chunk, sorted by text and hash: hashes, bounds."""
    h = w.hashes()
    g, at = windows(h, w.first, k)
    doc = w.doc[at] - w.lo
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = rolling(mix(h), w.first[short], w.first[short + 1])
        g, doc = np.concatenate((g, whole)), np.concatenate((doc, short))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))[: len(g)]
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(w.hi - w.lo + 1))


def sketches(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """id, h (of the text), n (set size), one and two (hashes of the whole set) and sig (coords little-endian 32-bit minima)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(2), lower=True):
                g, at = shingle_sets(w, k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.zeros((w.hi - w.lo, COORDS), np.uint32)
                for c in range(COORDS) if len(full) else ():
                    x = g * _FACTORS[c]
                    x ^= x >> np.uint64(32)
                    x *= np.uint64(0xBF58476D1CE4E5B9)
                    sig[full, c] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at[:-1][full])
                one, two = rolling(g, at[:-1], at[1:]), rolling(mix(g ^ _SALT), at[:-1], at[1:])
                raw = sig.tobytes()
                rows = [raw[i : i + 4 * COORDS] for i in range(0, len(raw), 4 * COORDS)]
                yield pa.RecordBatch.from_arrays([*(c.slice(w.lo, w.hi - w.lo) for c in batch.columns[:2]), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(rows, pa.binary())], ["id", "h", "n", "one", "two", "sig"])

    return hashed(df, key, text).mapInArrow(found, "id long, h long, n long, one long, two long, sig binary")


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, h and text: rows with one key are told apart by a hash of their texts."""
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def packed_sets(df: DataFrame, k: int) -> DataFrame:
    """id and set (sorted little-endian 64-bit shingle hashes) of rows id, text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), lower=True):
                g, at = shingle_sets(w, k)
                rows = [g[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(rows, pa.binary())], ["id", "set"])

    return df.mapInArrow(found, "id long, set binary")


def _postings(live: DataFrame) -> DataFrame:
    """Rows id, sig, ... exploded to one row per coordinate: c and v."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
                at = np.repeat(np.arange(len(sig)), COORDS)
                # coordinate and value in one number
                cv = (np.tile(np.arange(COORDS, dtype=np.int64), len(sig)) << 32) | sig.ravel()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(cv)], ["id", "cv"])

    return live.select("id", "sig").mapInArrow(found, "id long, cv long")


def _exploded(sets: DataFrame) -> DataFrame:
    """id and h, a row for each shingle."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(x.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h)], ["id", "h"])

    return sets.select("id", "set").mapInArrow(found, "id long, h long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of different hashes are as similar as that."""
    both = np.concatenate((x, y))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Of pairs a, b those that match in enough coordinates, confirmed on the full sets."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDS) for i in (2, 3))
            ok = (x == y).sum(axis=1) >= matches
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def with_both(rows: DataFrame, of: DataFrame, column: str) -> DataFrame:
        a = of.select(F.col("id").alias("a"), F.col(column).alias("x"))
        b = of.select(F.col("id").alias("b"), F.col(column).alias("y"))
        return rows.join(a, "a").join(b, "b").select("a", "b", "x", "y")

    near = held(with_both(pairs, sigs, "sig").mapInArrow(close, "a long, b long"))
    return held(with_both(near, sets, "set").mapInArrow(linked, "a long, b long"))


def _several(families: DataFrame) -> DataFrame:
    """Families (rows a: the leader, id, component) with more than one component, and each's main component, size and size of the main one.

    The few figures of a family go to several parts of its rows, so that a large family is no single task's.
    """
    sizes = families.groupBy("a", "component").agg(F.count("*").alias("many"))
    main = sizes.groupBy("a").agg(F.max(F.struct("many", -F.col("component"), "component"))["component"].alias("main"), F.sum("many").alias("all"), F.max("many").alias("most")).where("all > most")
    main = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("all") > CELL, SALTS - 1).otherwise(0))))
    large = main.where("salt > 0").select(F.col("a").alias("large")).distinct()
    rows = families.join(large.hint("merge"), F.col("a") == F.col("large"), "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = rows.union(families.join(large.hint("merge"), F.col("a") == F.col("large"), "left_anti").withColumn("salt", F.lit(0)))
    return rows.join(main.hint("merge"), ["a", "salt"]).drop("salt")


def _reaching(x: np.ndarray, sigs: np.ndarray, matches: int) -> np.ndarray:
    """Which signatures match x in enough coordinates, counted STRIDE at a time; those that can no longer reach it are skipped."""
    left, have = np.arange(len(sigs)), np.zeros(len(sigs), np.int64)
    for c in range(0, COORDS, STRIDE):
        have += (sigs[left, c : c + STRIDE] == x[c : c + STRIDE]).sum(axis=1)
        stay = have + (COORDS - c - STRIDE) >= matches
        left, have = left[stay], have[stay]
        if not len(left):
            break
    return left


def _cross_links(families: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links a, b between components of one family, at least one for each class and component that have any; sets: id, sig and set."""
    rows = families.withColumn("ups", F.ceil((F.col("all") - F.col("most")) / CELL)).withColumn("downs", F.ceil(F.col("all") / CELL))
    up = F.pmod(F.xxhash64("id"), F.col("ups"))
    down = F.pmod(F.xxhash64("id", F.lit(1)), F.col("downs"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = rows.where("component <> main").withColumn("up", up).withColumn("down", every("downs")).withColumn("asks", F.lit(True))
    told = rows.withColumn("down", down).withColumn("up", every("ups")).withColumn("asks", F.lit(False))
    names = ["a", "up", "down", "asks", "id", "component"]
    cells = asks.select(*names).union(told.select(*names)).join(sets, "id")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        left, right = cell[cell["asks"]], cell[~cell["asks"]]
        out = []
        if len(left) and len(right):
            sigs = np.frombuffer(b"".join(right["sig"]), np.uint32).reshape(-1, COORDS)
            theirs = [np.frombuffer(x, np.uint64) for x in right["set"]]
            ids, comps = right["id"].to_numpy(), right["component"].to_numpy()
            for i, c, sig, x in zip(left["id"], left["component"], left["sig"], left["set"], strict=True):
                x, linked = np.frombuffer(x, np.uint64), set()
                for j in _reaching(np.frombuffer(sig, np.uint32), sigs, matches):
                    if comps[j] != c and comps[j] not in linked and _alike(x, theirs[j], percent):
                        linked.add(comps[j])
                        out.append((i, ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return cells.groupBy("a", "up", "down").applyInPandas(compare, "a long, b long")


def grouped(documents: DataFrame, *, key: str, text: str, shingle: int, percent: int, by_key: bool) -> DataFrame:
    """A row for each of documents: id, h, n (set size), component, the smallest id linked, and group, a number for each component (null without key or shingles).

    by_key: whether rows of one key are linked by it.
    """
    matches = matches_for(percent)
    sketch = held(sketches(documents, key, text, shingle))
    usable = sketch.where("n > 0 AND id IS NOT NULL")
    made = usable.groupBy("n", "one", "two").agg(F.min(F.struct("id", "h")).alias("rep"), F.first("sig").alias("sig"))
    classes = held(made.select(F.monotonically_increasing_id().alias("c"), "n", "one", "two", "rep", "sig"))
    nodes = classes.select(F.col("c").alias("id"), "n", "sig")

    lists = _postings(nodes)
    shared = lists.groupBy("cv").agg(F.count("*").alias("many")).where("many > 1")
    mine = lists.join(shared.hint("merge"), "cv").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("many", "cv"))).alias("mine"))
    alive = mine.withColumn("alive", F.size("mine")).where(F.col("alive") >= matches)
    prefix = held(alive.select("id", "alive", F.slice("mine", F.lit(1), F.col("alive") - (matches - 1)).alias("prefix")))
    live = held(prefix.select("id", "alive").join(nodes.hint("merge"), "id"))

    posts = prefix.select("id", "alive", F.explode("prefix").alias("p")).select("id", "alive", "p.cv", "p.many")
    # a long list's leader goes to several parts of it
    posts = posts.withColumn("salt", F.when(F.col("many") > CELL, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0))
    leader = posts.groupBy("cv").agg(F.min(F.struct(-F.col("alive"), F.col("id").alias("lead"))).alias("best"), F.count("*").alias("here"), F.first("many").alias("many")).where("here > 1")
    leader = leader.select("cv", F.col("best.lead").alias("a"), F.explode(F.sequence(F.lit(0), F.when(F.col("many") > CELL, SALTS - 1).otherwise(0))).alias("salt"))
    met = posts.join(leader.hint("merge"), ["cv", "salt"]).where("id <> a").select("a", F.col("id").alias("b"))
    pairs = held(met.distinct())

    reps = live.select("id").join(classes.select(F.col("c").alias("id"), "rep"), "id").select(F.col("id").alias("c"), F.col("rep.id").alias("id"), F.col("rep.h").alias("h"))
    texts = hashed(documents, key, text).join(reps.hint("merge"), ["id", "h"]).select(F.col("c").alias("id"), "text")
    sets = packed_sets(texts, shingle)
    if usable.groupBy("id", "h").count().where("count > 1").limit(1).count():  # the same row twice
        sets = sets.dropDuplicates(["id"])
    sets = held(sets)
    links = _confirmed(pairs, live, sets, matches, percent)
    found = components(links)

    families = pairs.select("a", F.col("b").alias("id")).union(pairs.select("a", F.col("a").alias("id")).distinct())
    families = held(families.join(found.hint("merge"), "id", "left").select("a", "id", F.coalesce("component", "id").alias("component")))
    rest = held(_several(families).select("a", "id", "component"))
    shingles = _exploded(sets.join(rest.select("id").distinct().hint("merge"), "id", "left_semi"))
    common = shingles.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h")
    able = shingles.join(common.hint("merge"), "h").groupBy("id").agg(F.count("*").alias("s"))
    able = able.join(live.select("id", "n").hint("merge"), "id").where(100 * F.col("s") >= percent * F.col("n")).select("id")
    rest = held(_several(rest.join(able.hint("merge"), "id").select("a", "id", "component")))
    links = links.union(_cross_links(rest, live.select("id", "sig").join(sets.hint("merge"), "id"), matches, percent))

    owner = classes.select("c", F.col("rep.id").alias("least"), "n", "one", "two")
    s = usable.select("id", "h", "n", "one", "two").alias("s")
    same = (F.col("s.n") == owner["n"]) & (F.col("s.one") == owner["one"]) & (F.col("s.two") == owner["two"])
    rows = held(s.join(owner.hint("merge"), same).select("s.id", "s.h", "s.n", "c", "least"))
    if by_key:
        several = rows.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("high")).where("a < high").select("id", "a")
        links = links.union(rows.join(several.hint("merge"), "id").select("a", F.col("c").alias("b")).where("a <> b").distinct())
    found = components(held(links))
    least = found.join(classes.select(F.col("c").alias("id"), "rep.id").toDF("id", "doc"), "id")
    least = least.join(least.groupBy("component").agg(F.min("doc").alias("lowest")).hint("merge"), "component").select(F.col("id").alias("c"), "lowest", F.col("component").alias("top"))
    linked = rows.join(least.hint("merge"), "c", "left").select("id", "h", "n", F.coalesce("lowest", "least").alias("component"), F.coalesce("top", "c").alias("group"))
    none = F.lit(None).cast("long")
    return linked.union(sketch.where("n = 0 OR id IS NULL").select("id", "h", "n", none, none))


def near_duplicates(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id and kept for every row; links need 100 * intersection >= percent * union."""
    rows = grouped(documents, key=key, text=text, shingle=shingle, percent=percent, by_key=True)
    out = rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def to_drop(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id and h (xxhash64 of the text) of the rows that go if one row of each group of near copies stays: the one with the smallest key (then hash).

    Rows of one key are compared each for its own text; those with equal text count once.
    """
    rows = held(grouped(documents, key=key, text=text, shingle=shingle, percent=percent, by_key=False).where("group IS NOT NULL"))
    stays = rows.groupBy("group").agg(F.min(F.struct("id", "h")).alias("first"))
    return rows.join(stays.hint("merge"), "group").where((F.col("id") != F.col("first.id")) | (F.col("h") != F.col("first.h"))).select("id", "h").distinct()
