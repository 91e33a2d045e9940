"""Substring dedup over a compacted De Bruijn graph of word windows.

The edges of the graph are the windows of k consecutive words.  Neighbouring windows
that share their least inner m-word gram (their minimiser) form a path without
branches of their own; such a path is one row: minimiser, hash of all its words,
text, first window, number of windows.  Equal windows have equal minimisers at equal
places, so a window can only repeat where its path's minimiser does.  The rows meet
by minimiser in one shuffle:

* a minimiser of one document only: none of its windows repeats; the rows end here;
* equal paths (all words): the path with the smallest coordinate (document, place) is the source of the
  others, which are settled as a whole;
* different paths with one minimiser: the graph branches inside them.  The first of each
  is expanded into single windows, which are matched by a join on their hashes.

Then paths and windows that follow one another both in a text and in its source are
compacted into long spans.  Each span is verified at its source's coordinates: the
source's text gives a digest of the span's words, and only a text with that digest at its own
coordinates loses words.

Copies within one Arrow batch are settled before the shuffle, so a passage that a third of all
documents share sends a row or so from each batch.  Settled rows are dealt out by
text, not by minimiser.

A text is known by its key and, only where a key has different texts, a 64-bit hash of the text: rows that
share a key are one document as a source (they never cover each other), but each loses what is
repeated in its own text.

Keys are whole numbers (of any other type, only those that Spark casts to one).

Defined results: null, empty and blank texts have no words; a text with fewer
than k words has no window; windows that repeat only within one document stay; rows with a null key
keep all words and cover nobody's; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import held
from .words import Words, mix, rolling, windows, words

K, GRAM = 13, 5
#: The texts' column: a name of its own, so that all joins below can share one shuffle of it.
TEXT = "__text"
_SALT = np.uint64(0x5851F42D4C957F2D)


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of width grams, the index of the least one (the first, if equal)."""
    n = len(grams) - width + 1
    best = np.arange(n)
    least = grams[:n].copy()
    for i in range(1, width):
        smaller = grams[i : i + n] < least
        least[smaller] = grams[i : i + n][smaller]
        best[smaller] = np.flatnonzero(smaller) + i
    return best


def paths(hashes: np.ndarray, first: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, ...]:
    """Minimiser, path hash, first window and number of windows of each path in a chunk of texts."""
    grams, _ = windows(hashes, np.array([0, len(hashes)]), gram)  # also across texts; such are not used
    n = len(hashes) - k + 1
    if n < 1:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    at = np.arange(n)
    whole = at + k <= np.repeat(first[1:], np.diff(first))[:n]  # windows within one text
    best = minimisers(grams, k - gram + 1)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (best[1:] != best[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    start, size = start[whole[start]], size[whole[start]]
    place = best[start]
    # where the minimiser stands in the path is part of what must be equal
    span = rolling(mix(hashes ^ _SALT), start, start + size + k - 1) ^ mix((place - start).astype(np.uint64) + _SALT)
    return grams[place], span, start, size


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def texts_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """doc, v and __text: v tells the texts of one key apart and is 0 where the key has one text alone."""
    rows = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias(TEXT))
    hashes = rows.where("doc IS NOT NULL").select("doc", F.xxhash64(TEXT).alias("h")).groupBy("doc").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = held(hashes.where("low < high").select("doc"))
    if not several.limit(1).count():
        return rows.select("doc", F.lit(0).cast("long").alias("v"), TEXT)
    marked = rows.join(several.withColumn("several", F.lit(True)).hint("merge"), "doc", "left")
    return marked.select("doc", F.when(F.col("several"), F.xxhash64(TEXT)).otherwise(F.lit(0)).cast("long").alias("v"), TEXT)


_PATH = "m long, span long, doc long, v long, start int, size int, covered boolean, src_doc long, src_v long, src_start int"
_NAMES = [c.split()[0] for c in _PATH.split(", ")]


def _path_rows(texts: DataFrame, k: int, gram: int) -> DataFrame:
    """One row per path; covered: an equal path with a smaller document was met in the same batch, and is its source."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts = []
            for w in words(batch.column(2)):
                m, span, start, size = paths(w.hashes(), w.first, k, gram)
                doc = w.doc[start]
                parts.append((m, span, ids[doc], vs[doc], start - w.first[doc - w.lo], size))
            if not parts:
                continue
            m, span, doc, v, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, v, doc, span, m))
            m, span, doc, v, start, size = (x[order] for x in (m, span, doc, v, start, size))
            head = np.ones(len(m), bool)
            head[1:] = (m[1:] != m[:-1]) | (span[1:] != span[:-1])
            new = head.copy()  # rows with one key and text are one
            new[1:] |= (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (start[1:] != start[:-1])
            source = np.flatnonzero(head)[np.cumsum(head) - 1]
            covered = doc > doc[source]
            of = lambda x: np.where(covered, x[source], 0)[new]
            yield pa.RecordBatch.from_arrays(
                [_signed(m[new]), _signed(span[new]), pa.array(doc[new]), pa.array(v[new]), _ints(start[new]), _ints(size[new]), pa.array(covered[new]), pa.array(of(doc)), pa.array(of(v)), _ints(of(start))],
                _NAMES,
            )

    return texts.mapInArrow(found, _PATH)


_STEP = 1 << 16


def _settled(t: pa.Table) -> pa.Table:
    """Of whole minimisers' rows sorted by covered, m, span, doc, v, start: the covered ones, and (covered is false) those to expand."""
    done = t.filter(t["covered"])
    t = t.filter(pc.invert(t["covered"]))
    m, span, doc, v, start = (t[c].to_numpy() for c in ("m", "span", "doc", "v", "start"))
    if not len(m):
        return done
    new_m = np.append(True, m[1:] != m[:-1])
    new_span = new_m | np.append(True, span[1:] != span[:-1])
    group, run = np.cumsum(new_m) - 1, np.cumsum(new_span) - 1
    heads, run_heads = np.flatnonzero(new_m), np.flatnonzero(new_span)
    several = (np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads))[group]
    branching = (np.add.reduceat(new_span, heads) > 1)[group]
    source = run_heads[run]
    covered = several & (doc > doc[source])
    for name, x in (("covered", covered), ("src_doc", doc[source]), ("src_v", v[source]), ("src_start", start[source])):
        t = t.set_column(t.schema.get_field_index(name), name, pa.array(x))
    return pa.concat_tables([done, t.filter(pa.array(covered | (several & branching)))])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_settled over sorted batches. Only the rows of the last minimiser wait for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
        if rest.num_rows < _STEP:
            continue
        m, flag = rest["m"].to_numpy(), rest["covered"].to_numpy()
        if flag[-1]:
            cut = rest.num_rows
        else:
            other = np.flatnonzero((m != m[-1]) | (flag != flag[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from _settled(rest.slice(0, cut)).to_batches()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield from _settled(rest).combine_chunks().to_batches()


def repeated(texts: DataFrame, *, k: int = K, gram: int = GRAM) -> DataFrame:
    """Paths that repeat, of rows doc, v and __text: doc, v, start, size (windows), covered, src_doc, src_v and src_start.

    covered: all the path's windows start in the source document, which is smaller, too;
    the others are the first of their kind but branch, so that single windows may repeat.
    """
    rows = _path_rows(texts, k, gram)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, F.when(F.col("covered"), F.xxhash64("doc", "v", "start")).otherwise(F.xxhash64("m")))
    return dealt.sortWithinPartitions("covered", "m", "span", "doc", "v", "start").mapInArrow(_settle, _PATH).drop("m", "span")


def _window_rows(joined: DataFrame, k: int) -> DataFrame:
    """Single windows of the paths in `open` (structs of start and size) of each text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            flat = lists.flatten()
            start, size = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for w in words(batch.column(2)):
                h = w.hashes()
                p = slice(bounds[w.lo], bounds[w.hi])
                base = np.repeat(w.first[:-1], np.diff(bounds[w.lo : w.hi + 1])) + start[p]
                at = np.repeat(base - (np.cumsum(size[p]) - size[p]), size[p]) + np.arange(size[p].sum())
                doc = w.doc[at]
                one, two = rolling(mix(h), at, at + k), rolling(mix(h ^ _SALT), at, at + k)
                yield pa.RecordBatch.from_arrays([_signed(one), _signed(two), pa.array(ids[doc]), pa.array(vs[doc]), _ints(at - w.first[doc - w.lo])], ["one", "two", "doc", "v", "start"])

    return joined.mapInArrow(found, "one long, two long, doc long, v long, start int")


_SPAN = "doc long, v long, start int, size int, src_doc long, src_v long, src_start int"


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by hashes, document and place, those that a smaller document has, with the first such as source."""
    last = None
    for batch in batches:
        one, two, doc, v, start = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))
        first = [x[at] for x in (doc, v, start)]
        if last is not None and len(one) and last[:2] == (one[0], two[0]):  # the run goes on from the batch before
            run = at == 0
            for x, y in zip(first, last[2:], strict=True):
                x[run] = y
        if len(one):
            last = (one[-1], two[-1], *(x[-1] for x in first))
        hit = np.flatnonzero(doc > first[0])
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(v[hit]), _ints(start[hit]), _ints(np.ones(len(hit))), pa.array(first[0][hit]), pa.array(first[1][hit]), _ints(first[2][hit])], [c.split()[0] for c in _SPAN.split(", ")])


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc, v and marks (start, size, src_doc, src_v, src_start) to spans: marks that go on where the last one ended, here and in the source, are one."""
    for batch in batches:
        many = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        flat = batch.column(2).flatten()
        start, size, doc, v, src = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False) for i in range(5))
        row = np.repeat(np.arange(len(many)), many)
        order = np.lexsort((start, row))
        row, start, size, doc, v, src = (x[order] for x in (row, start, size, doc, v, src))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (start[1:] != start[:-1] + size[:-1]) | (src[1:] != src[:-1] + size[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(size, at) if len(at) else size
        owner = pa.array(row[at])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), _ints(start[at]), _ints(total), pa.array(doc[at]), pa.array(v[at]), _ints(src[at])], [c.split()[0] for c in _SPAN.split(", ")])


def _joined_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words of a chunk with one blank after each, and where each starts (and the last one's blank ends)."""
    size = w.ends - w.starts + 1
    at = np.append(0, np.cumsum(size))
    data = np.append(w.data, np.uint8(32))[np.repeat(w.starts - at[:-1], size) + np.arange(at[-1])]
    data[at[1:] - 1] = 32
    return data, at


def _digest(data: np.ndarray) -> bytes:
    return hashlib.blake2b(data.tobytes(), digest_size=16).digest()


def _source_digests(joined: DataFrame, k: int) -> DataFrame:
    """For texts with `asked` (structs of src_start and size): the digest of each such span's words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(3).to_pylist()
            for w in words(batch.column(2)):
                data, at = _joined_words(w)
                rows, start, size, digest = [], [], [], []
                for i in range(w.lo, w.hi):
                    base = w.first[i - w.lo]
                    for a in asked[i]:
                        s, n = a["src_start"], a["size"]
                        rows.append(i)
                        start.append(s)
                        size.append(n)
                        digest.append(_digest(data[at[base + s] : at[base + s + n + k - 1]]))
                owner = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())], ["src_doc", "src_v", "src_start", "size", "digest"])

    return joined.mapInArrow(found, "src_doc long, src_v long, src_start int, size int, digest binary")


def spans(texts: DataFrame, *, k: int = K, gram: int = GRAM) -> DataFrame:
    """Long repeated spans of rows doc, v and __text, with the digest of the words at the source's coordinates."""
    found = repeated(texts, k=k, gram=gram)
    mark = F.struct("start", "size", "src_doc", "src_v", "src_start")
    per_text = held(found.groupBy("doc", "v").agg(F.collect_set(F.when(F.col("covered"), mark)).alias("closed"), F.collect_set(F.when(~F.col("covered"), F.struct("start", "size"))).alias("open")))
    opened = per_text.where(F.size("open") > 0).select("doc", "v", "open")
    single = _window_rows(texts.join(opened.hint("merge"), ["doc", "v"]).select("doc", "v", TEXT, "open"), k)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = single.repartition(n, "one", "two").sortWithinPartitions("one", "two", "doc", "v", "start").mapInArrow(_again, _SPAN)
    gone = gone.groupBy("doc", "v").agg(F.collect_set(F.struct("start", "size", "src_doc", "src_v", "src_start")).alias("single"))
    none = F.array().cast(per_text.schema["closed"].dataType)
    closed = per_text.where(F.size("closed") > 0).select("doc", "v", "closed")
    marks = closed.join(gone.hint("merge"), ["doc", "v"], "full").select("doc", "v", F.concat(F.coalesce("closed", none), F.coalesce("single", none)).alias("marks"))
    long = marks.mapInArrow(_compacted, _SPAN)
    asked = long.select(F.col("src_doc").alias("doc"), F.col("src_v").alias("v"), "src_start", "size").distinct()
    asked = asked.groupBy("doc", "v", F.shiftright("src_start", 12).alias("part")).agg(F.collect_list(F.struct("src_start", "size")).alias("asked"))
    true = _source_digests(texts.join(asked.hint("merge"), ["doc", "v"]).select("doc", "v", TEXT, "asked"), k)
    return long.join(true.hint("merge"), ["src_doc", "src_v", "src_start", "size"])


def drop_repeated(documents: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, gram: int = GRAM) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and kept, the words that stay joined by one blank."""
    texts = texts_of(documents, key, text)
    known = texts.where("doc IS NOT NULL")
    per_text = spans(known, k=k, gram=gram).groupBy("doc", "v").agg(F.collect_list(F.struct("start", "size", "digest")).alias("spans"))
    joined = known.join(per_text.hint("merge"), ["doc", "v"], "left").select("doc", TEXT, "spans")
    joined = joined.unionByName(texts.where("doc IS NULL").select("doc", TEXT), allowMissingColumns=True)
    schema = documents.select(F.col(key).cast("long").alias(key)).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(2).to_pylist()
            for w in words(batch.column(1)):
                data, at = _joined_words(w)
                change = np.zeros(len(w.starts) + 1, np.int32)
                for i in range(w.lo, w.hi):
                    base = w.first[i - w.lo]
                    for s in marked[i] or ():
                        a, b = base + s["start"], base + s["start"] + s["size"] + k - 1
                        if _digest(data[at[a] : at[b]]) == s["digest"]:
                            change[a] += 1
                            change[b] -= 1
                stay = np.cumsum(change)[:-1] == 0
                left = data[np.repeat(stay, np.diff(at))]
                ends = np.append(0, np.cumsum(np.where(stay, np.diff(at), 0)))[w.first]
                texts_ = [left[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                n_words = np.diff(w.first)
                n_gone = n_words - np.diff(np.append(0, np.cumsum(stay))[w.first])
                sha = [hashlib.sha256(t).hexdigest() for t in texts_]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(n_words.astype(np.int64)), pa.array(n_gone.astype(np.int64)), pa.array(sha), pa.array(texts_, pa.binary()).cast(pa.string())], schema.names)

    return joined.mapInArrow(kept, schema)
