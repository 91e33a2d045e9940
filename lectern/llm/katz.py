"""Katz backoff language model over n-grams of a given order: counting, discounting and scoring.

p_k(w | h) = d_k(c(h, w)) * c(h, w) / (c(h) + 1)   if the n-gram of length k was met in training
           = alpha(h) * p_(k-1)(w | h less its first word)   otherwise
p_1(w)     = d_1(c(w)) * c(w) / (N + 1)            if the word was met in training
           = 1 - all of the above                  for all unknown words together

The d are Good-Turing (Katz) discounts for counts up to 5, from all counts of counts of that length.
One pseudo-count for each history keeps something for unmet words even where no
count is discounted; alpha(h) is exactly what is left divided by the shorter n-grams' probability of the
words not met after h, so each history's probabilities add up to 1.  A history that was not met
backs off at once.  The history of a text's first word is start marks.

How it runs: n-grams are counted where they are scored.  Tokens go to tables partitioned
by word (by pair for the most common words, at most ``frequent``, whose counts are a bounded broadcast table),
packed in compressed column blocks, so that all n-grams that end alike meet; each partition counts its n-grams of all lengths over
training documents and scores its tokens as far as their longest n-gram met.  What a history has left over needs sums over its partitions: these
and the held-out tokens that back off meet in a second shuffle, by the history's last word (last two where that one is common), where
also the shorter history's count is; the recursion is a sum over the lengths backed off from.  The
sums of each document meet by document, in blocks again.  Counts of counts travel with the blocks, so that
every discount rests on all of the corpus.

Keys are whole numbers (of any other type, only those that Spark casts to one).

Defined results: a null or empty text has the end token only; each row is scored for itself, also where rows share a
key or have none (rows equal in key and text get the same scores, and each teaches); with no training document every token is
unknown with probability 1; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import give_back, held, tidy
from .words import mix, words

ORDER = 3
FREQUENT = 1 << 18  # words whose counts all tasks know: 6 MB at most
DISCOUNTED = 5
START, END = 0, 1  # symbols; the frequent words follow, and then all others by hash
_RARE = np.uint64(1 << 63)
#: What is kept of another word's hash where it stands in a history: of a million such words, any two agree with a chance of 0.2 %.
_HISTORY = np.uint64((1 << 48) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Buckets for each shuffle partition: one bucket at a time is in memory.
BUCKETS = 1
#: Tokens packed at a time.
STEP = 2_200_000
#: Bytes of blocks that leave a task at once: Spark keeps what comes together outside its heap, too.
PORTION = 2 << 20


def _planes(c: np.ndarray) -> tuple[str, np.ndarray]:
    """All numbers' first bytes, then all second bytes and so on, as small numbers then take little."""
    return c.dtype.str, np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T)


def _whole(kind: str, planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).ravel().view(kind)


def bundle(parts: list[tuple[str, tuple[np.ndarray, ...]]]) -> bytes:
    """Named lists of columns, compressed together."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps([(name, [_planes(c) for c in columns]) for name, columns in parts], 5))


def unbundled(block: bytes) -> list[tuple[str, list[tuple[str, np.ndarray]]]]:
    """The parts of a bundle; _whole makes columns of them."""
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(block))


def pack(*columns: np.ndarray) -> bytes:
    return bundle([("", columns)])


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    return tuple(_whole(*c) for c in unbundled(block)[0][1])


def portions(blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows bucket and block, some PORTION bytes at a time."""
    some: list[tuple[int, bytes]] = []

    def rows() -> pa.RecordBatch:
        which, packed = zip(*some, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "block"])

    size = 0
    for one in blocks:
        some.append(one)
        size += len(one[1])
        if size >= PORTION:
            yield rows()
            some.clear()
            size = 0
    if some:
        yield rows()


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """A group's blocks, one after another."""
    for batch in batches:
        for block in batch.column(batch.schema.get_field_index("block")):
            yield block.as_py()


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for counts r = 0..5 (d[0] is unused) from n[r], how many types have count r (r up to 6).

    The cut-off goes down from 5 until all discounts are in (0, 1]; without any there is no discount.
    """
    for k in range(DISCOUNTED, 0, -1):
        if not n[1 : k + 2].all():
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        if tail < 1:
            d = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - tail) / (1 - tail)
            if ((d > 0) & (d <= 1)).all():
                return np.concatenate(([1.0], d, np.ones(DISCOUNTED - k)))
    return np.ones(DISCOUNTED + 1)


class Unigrams:
    """N, V, the frequent words' counts, and p(w) by count."""

    def __init__(self, total: int, types: int, n: np.ndarray, ends: int, frequent: np.ndarray, counts: np.ndarray) -> None:
        self.total, self.types = total, types
        # symbols go by rank, so that most are small numbers
        order = np.lexsort((frequent, -counts))
        keys, counts = frequent[order].view(np.uint64), counts[order]
        by_key = np.argsort(keys)
        self.keys, self.rank = keys[by_key], by_key.astype(np.uint64)
        self.counts = np.concatenate(([ends, ends], counts))  # of START as a history, END and the frequent words
        self.d = discounts(n)
        r = np.arange(1, DISCOUNTED + 1)
        self.unknown = (1 + (n[r] * (1 - self.d[r]) * r).sum()) / (total + 1)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return hashes | _RARE
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.rank[at] + np.uint64(2), hashes | _RARE)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.where(c <= DISCOUNTED, c, 0)] * c / (self.total + 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.types + 1))


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different words, ascending, and their counts."""
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, count, len(key)).astype(np.int64)


def _bins(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c) * 16).astype(np.int32)


def _tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for one group of rows at a time, whose memory goes back before the next."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from tidy(run(batches))

    return one


def count_unigrams(df: DataFrame, frequent: int) -> Unigrams:
    """From rows id, train, text. Only bounded results come to the driver: sums, a histogram of counts, and at most `frequent` words that occur twice or more."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> Iterator[tuple[int, bytes]]:
            key, count = _counted(parts)
            to = (mix(key) % np.uint64(buckets)).astype(np.int32)
            for b in range(buckets):
                there = np.flatnonzero(to == b)
                if len(there):
                    yield b, pack(np.diff(key[there], prepend=np.uint64(0)), _small(count[there]))

        for batch in batches:
            parts += [np.unique(w.hashes(), return_counts=True) for w in words(batch.column(0), lower=True)]
            parts.append((np.array([END], np.uint64), np.array([batch.num_rows])))
            if len(parts) > 64:
                parts = [_counted(parts)]
            if len(parts[0][0]) > STEP:
                yield from portions(dealt())
                parts = []
        if parts:
            yield from portions(dealt())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, c = _counted([(np.cumsum(k, dtype=np.uint64), n) for k, n in map(unpack, blocks_of(batches))])
        end = key == END
        often = (c > 1) & ~end
        bins, n = np.unique(_bins(c[often]), return_counts=True)
        row = [int(c.sum()), len(c), int(c[end].sum()), [int((c == r).sum()) for r in range(1, DISCOUNTED + 2)], bins.tolist(), n.tolist(), pack(key[often], c[often])]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), pa.int64(), pa.int64(), longs, pa.list_(pa.int32()), longs, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["total", "types", "ends", "n", "bins", "sizes", "block"])

    kinds = "total long, types long, ends long, n array<long>, bins array<int>, sizes array<long>, block binary"
    counts = held(df.where("train").select("text").mapInArrow(lambda batches: tidy(found(batches)), "bucket int, block binary").groupBy("bucket").applyInArrow(_tidied(summed), kinds))
    ofs = [F.sum(F.col("n")[r]) for r in range(DISCOUNTED + 1)]
    total, types, ends, *n = counts.agg(F.sum("total"), F.sum("types"), F.sum("ends"), *ofs).first()
    # all words from some count on, at most `frequent`: found by a histogram of counts with few bins
    bins = counts.select(F.explode(F.arrays_zip("bins", "sizes")).alias("b")).groupBy(F.col("b.bins").alias("bin")).agg(F.sum("b.sizes").alias("n")).orderBy(F.desc("bin")).collect()
    room, least = frequent, None
    for b in bins:
        room -= b["n"]
        if room < 0:
            break
        least = b["bin"]

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                key, c = unpack(block.as_py())
                up = _bins(c) >= least
                yield pa.RecordBatch.from_arrays([pa.array(key[up].view(np.int64)), pa.array(c[up])], ["w", "c"])

    none = np.zeros(0, np.int64)
    top = counts.select("block").mapInArrow(upper, "w long, c long").toArrow() if least is not None else {"w": none, "c": none}
    return Unigrams(total or 0, types or 0, np.array([0, *(x or 0 for x in n)]), ends or 0, *(np.array(top[c], np.int64) for c in "wc"))


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _pack_symbols(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Frequent words' ranks as their length in bits and the bits after the first, length by length; other words' hashes as they are. What is in order goes as steps."""
    rare = x >= _RARE
    small, large = x[~rare].astype(np.uint32), x[rare]
    steps = np.array([bool((c[1:] >= c[:-1]).all()) for c in (small, large)], np.uint8)
    small, large = (np.diff(c, prepend=c.dtype.type(0)) if step else c for c, step in zip((small, large), steps))
    width = np.frexp(small.astype(np.float64))[1].astype(np.uint8)
    tails = [np.packbits((small[width == w][:, None] >> np.arange(w - 1, dtype=np.uint32)).astype(np.uint8) & 1) for w in range(2, int(width.max(initial=0)) + 1)]
    return steps, np.packbits(rare), width, np.concatenate([np.zeros(0, np.uint8), *tails]), large


#: Columns that _pack_symbols makes.
PARTS = 5


def _unpack_symbols(n: int, steps: np.ndarray, bits: np.ndarray, width: np.ndarray, tails: np.ndarray, large: np.ndarray) -> np.ndarray:
    small = (width > 0).astype(np.uint64)
    at = 0
    for w in range(2, int(width.max(initial=0)) + 1):
        here = np.flatnonzero(width == w)
        size = -(-len(here) * (w - 1) // 8)
        tail = np.unpackbits(tails[at : at + size], count=len(here) * (w - 1)).reshape(len(here), w - 1)
        small[here] = tail.astype(np.uint64) @ (np.uint64(1) << np.arange(w - 1, dtype=np.uint64)) + np.uint64(1 << (w - 1))
        at += size
    small, large = (np.cumsum(c, dtype=np.uint64) if step else c for c, step in zip((small, large), steps))
    is_rare = np.unpackbits(bits, count=n).astype(bool)
    x = np.empty(n, np.uint64)
    x[~is_rare], x[is_rare] = small, large
    return x


def _token_blocks(df: DataFrame, model: Unigrams, buckets: int, order: int) -> DataFrame:
    """bucket, block: the tokens (word, the order - 1 words before it, document) of rows id, train, text."""

    def flush(parts: list[tuple[np.ndarray, ...]], ids: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        w, doc, *hs = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        bucket = (mix(np.where(w < _RARE, w * _SPREAD + hs[0], w)) % np.uint64(buckets)).astype(np.uint32)
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        del bucket
        for b in np.flatnonzero(np.diff(cuts)):
            at = by_bucket[cuts[b] : cuts[b + 1]]
            at = at[np.lexsort((hs[0][at], w[at]))]
            heads = np.flatnonzero(np.append(True, w[at][1:] != w[at][:-1]))
            runs = np.diff(np.append(heads, len(at))).astype(np.uint32)
            docs, place = np.unique(doc[at], return_inverse=True)
            steps = np.diff(ids[docs].view(np.uint64), prepend=np.uint64(0))  # keys are often in order
            yield int(b), pack(_small(runs), _small(place), steps, train[docs], *(x for c in (w[at][heads], *(h[at] for h in hs)) for x in _pack_symbols(c)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, train, size = [], [], [], 0
        for batch in batches:
            base = sum(map(len, ids))
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            train.append(batch.column(1).to_numpy(zero_copy_only=False))
            for x in words(batch.column(2), lower=True):
                s = model.symbols(x.hashes())
                # each text: its words and an end; histories are these moved by one, two ...
                n = np.diff(x.first) + 1
                w = np.full(len(s) + len(n), END, np.uint64)
                ends = np.cumsum(n) - 1
                inner = np.ones(len(w), bool)
                inner[ends] = False
                w[inner] = s
                place = np.arange(len(w)) - np.repeat(ends - n + 1, n)
                past = np.where(w >= _RARE, w & _HISTORY | _RARE, w)
                hs = []
                for back in range(1, order):
                    h = np.full_like(w, START)
                    h[back:] = np.where(place[back:] >= back, past[:-back], np.uint64(START))
                    hs.append(h)
                parts.append((w, np.repeat(np.arange(x.lo, x.hi, dtype=np.int32) + np.int32(base), n), *hs))
                size += len(w)
            if size >= STEP:
                yield from portions(flush(parts, np.concatenate(ids), np.concatenate(train)))
                parts, ids, train, size = [], [], [], 0
        if parts:
            yield from portions(flush(parts, np.concatenate(ids), np.concatenate(train)))

    return df.select("id", "train", "text").mapInArrow(lambda batches: tidy(found(batches)), "bucket int, block binary")


def _contexts(hs: list[np.ndarray]) -> list[np.ndarray]:
    """A number for the last 1, 2 ... words of a history: the symbol itself for one word, a hash for more."""
    out = [hs[0]]
    for h in hs[1:]:
        out.append(mix(out[-1] * _SPREAD + h) | _RARE)
    return out


def _home(hs: list[np.ndarray]) -> np.ndarray:
    """Where a history's sums meet: by its last word, or its last two if that one is common and there are two."""
    return mix(hs[0]) if len(hs) == 1 else mix(np.where(hs[0] < _RARE, hs[0] * _SPREAD + hs[1], hs[0]))


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where in it each group begins."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def _by_value(at: np.ndarray, c: np.ndarray, n: int) -> list[np.ndarray]:
    """For r = 1..5: how often c is r at each of n places."""
    return [_small(np.bincount(at[c == r], minlength=n)) for r in range(1, DISCOUNTED + 1)]


def _sums(model: Unigrams, buckets: int, order: int):
    """One bucket's tokens to blocks for the second shuffle: by document, by history, and counts of counts for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, hss, docs, ids, trains, base = [], [], [], [], [], 0
        for block in blocks_of(batches):
            runs, place, steps, t, *packed = unpack(block)
            i = np.cumsum(steps, dtype=np.uint64).view(np.int64)
            ws.append(np.repeat(_unpack_symbols(len(runs), *packed[:PARTS]), runs))
            hss.append([_unpack_symbols(len(ws[-1]), *packed[PARTS * j : PARTS * j + PARTS]) for j in range(1, order)])
            docs.append(place.astype(np.int32) + np.int32(base))
            ids.append(i)
            trains.append(t)
            base += len(i)
        w, doc, ids, train = (np.concatenate(x) for x in (ws, docs, ids, trains))
        hs = [np.concatenate(x) for x in zip(*hss, strict=True)]
        del ws, hss, docs, trains
        at = np.lexsort((*reversed(hs), w))
        w, doc, hs = w[at], doc[at], [h[at] for h in hs]
        del at
        ids, local = np.unique(ids, return_inverse=True)
        taught, doc, n = train[doc], local.astype(np.int32)[doc], len(ids)
        # for each length: where its n-grams begin, each token's n-gram, and how often training has it
        heads, gram, count = [], [], []
        new = np.append(True, w[1:] != w[:-1])
        for k in range(order):
            if k:
                new[1:] |= hs[k - 1][1:] != hs[k - 1][:-1]
            heads.append(np.flatnonzero(new))
            gram.append(np.cumsum(new, dtype=np.int32) - 1)
            count.append(np.add.reduceat(taught, heads[-1], dtype=np.int64))
        word = w[heads[0]]
        common = word < _RARE
        count[0][common] = model.counts[word[common].astype(np.int64)]
        p_word = model.p(count[0])
        # known here of the score: the longest n-gram met, and the count of the next token's history
        c = count[-2][gram[-2]]
        part = np.where((c > 0) & (w != END), -np.log10(c + 1.0), 0.0)
        part[hs[0] == START] -= np.log10(model.counts[0] + 1.0)
        sums = [np.bincount(doc, model.base(count[0])[gram[0]], n), None, _small(np.bincount(doc, minlength=n)), _small(np.bincount(doc, count[0][gram[0]] > 0, n).astype(np.int64))]
        out: list[list] = [[] for _ in range(buckets)]  # what goes to each bucket
        open_ = np.arange(len(w))  # the tokens that no longer n-gram has matched
        for k in range(order - 1, 0, -1):
            c = count[k][gram[k][open_]]
            part[open_] += np.where(c > DISCOUNTED, np.log10(np.maximum(c, 1)), 0.0)
            sums += _by_value(doc[open_], c, n)
            # tokens that back off from a history, or rest on a shorter one
            asks = open_[c == 0] if k == order - 1 else open_
            if len(asks):
                whose, *mine = doc[asks], *(h[asks] for h in hs[:k])
                o, first = _grouped(*mine, whose)
                size = np.diff(np.append(first, len(o))) if k < order - 1 else np.zeros(len(first), np.int64)
                lost = np.add.reduceat((count[k][gram[k][asks]] == 0)[o], first, dtype=np.int64)
                first = o[first]
                mine = [h[first] for h in mine]
                _deal(out, f"u{k}", _home(mine), mine, ids[whose[first]], _small(size), _small(lost))
            open_ = open_[c == 0]
            # by history and by counts up to 5 or more, of the n-gram and of the shorter one that ends it: how many types, and both counts' sums
            met = count[k] > 0
            start = heads[k][met]
            mine, c, less = [h[start] for h in hs[:k]], count[k][met], count[k - 1][gram[k - 1][start]]
            if len(start):
                code = (np.minimum(c, DISCOUNTED + 1) * 8 + np.minimum(less, DISCOUNTED + 1)).astype(np.uint8)
                o, first = _grouped(*mine, code)
                types, c, less = np.diff(np.append(first, len(o))), np.add.reduceat(c[o], first), np.add.reduceat(less[o], first)
                first = o[first]
                mine = [h[first] for h in mine]
                _deal(out, f"h{k}", _home(mine), mine, code[first], types, c, less)
        part[open_] += np.log10(p_word[gram[0][open_]])
        sums[1] = np.bincount(doc, part, n)
        _deal(out, "d", mix(ids.view(np.uint64)), [], ids, *sums)
        counts = tuple(np.bincount(np.minimum(c[c > 0], DISCOUNTED + 2), minlength=DISCOUNTED + 3) for c in count[1:])
        # what is packed is not needed any more
        del w, doc, hs, taught, gram, heads, part, sums, open_
        out.reverse()
        yield from portions((b, bundle([*out.pop(), ("n", counts)])) for b in range(buckets))

    return _tidied(run)


def _deal(out: list[list], kind: str, home: np.ndarray, symbols: list[np.ndarray], *columns: np.ndarray) -> None:
    """Add to each bucket's parts the rows that have their home there."""
    to = home % np.uint64(len(out))
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(len(out) + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        mine = [c[at] for c in columns]
        if kind[0] == "h":
            mine = _thin(*mine)
        out[b].append((kind, (*mine, *(x for h in symbols for x in _pack_symbols(h[at])))))


def _thin(code: np.ndarray, types: np.ndarray, c: np.ndarray, less: np.ndarray) -> list[np.ndarray]:
    """Sums that the types' number does not give are kept only where a count is over 5."""
    return [code, _small(types), _small(c[code >> 3 > DISCOUNTED]), _small(less[code & 7 > DISCOUNTED])]


def _thick(code: np.ndarray, types: np.ndarray, c: np.ndarray, less: np.ndarray) -> list[np.ndarray]:
    """Count, sum of counts, shorter count and sum of those; a count of 6 stands for 6 and more."""
    out = []
    for r, big in ((code >> 3, c), (code & 7, less)):
        total = r * types.astype(np.int64)
        total[r > DISCOUNTED] = big
        out += [r, total]
    return out


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """The value at each wanted key; keys are sorted."""
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _finish(model: Unigrams, homes: int, order: int):
    """One bucket of documents and of histories: id, base, score, tokens, known, to be added up by id, in blocks by the id's home."""
    r = np.arange(1, DISCOUNTED + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(kind: str, columns: int, back: int = 0) -> list[np.ndarray]:
            """The kind's columns, and the last words of its histories."""
            rows = []
            for planes in parts.pop(kind, ()):
                x = [_whole(*c) for c in planes]
                rows.append([*(_thick(*x[:columns]) if kind[0] == "h" else x[:columns]), *(_unpack_symbols(len(x[0]), *x[columns + PARTS * j : columns + PARTS * j + PARTS]) for j in range(back))])
            return [np.concatenate(x) for x in zip(*rows, strict=True)]

        parts: dict[str, list] = {}
        for block in blocks_of(batches):
            for kind, planes in unbundled(block):
                parts.setdefault(kind, []).append(planes)
        tables = [[_whole(*c) for c in planes] for planes in parts["n"]]
        d = [model.d, *(discounts(np.sum(x, axis=0)) for x in zip(*tables, strict=True))]  # by length less one
        out = []  # id, base, score, tokens, known
        docs = of("d", 4 + DISCOUNTED * (order - 1) + 1)
        if docs:
            ids, at = np.unique(docs[0], return_inverse=True)
            base, score, tokens, known, *by_count = (np.bincount(at, x, len(ids)) for x in docs[1:])
            for i, k in enumerate(range(order - 1, 0, -1)):
                score = score + np.log10(d[k][r] * r) @ np.array(by_count[i * DISCOUNTED : (i + 1) * DISCOUNTED])
            out.append((ids, base, score, tokens, known))
        shorter, totals = np.zeros(0, np.uint64), np.zeros(0)
        for k in range(1, order):
            hist = of(f"h{k}", 4, k)
            keys, free = np.zeros(0, np.uint64), np.zeros(0)
            total = free
            if hist:
                count, c, less_count, less, *mine = hist
                mine = _contexts(mine)
                keys, pick, at = np.unique(mine[-1], return_index=True, return_inverse=True)
                total = np.bincount(at, c, len(keys))
                left = 1 + np.bincount(at, np.append(1 - d[k], 0)[count] * c, len(keys))
                if k == 1:
                    whole = model.total
                else:
                    under = mine[-2][pick]
                    whole = _looked_up(shorter, totals, under, 0.0)
                    if k == 2:  # a common word's count is in the broadcast table
                        near = under < _RARE
                        whole[near] = model.counts[under[near].astype(np.int64)]
                p = np.bincount(at, np.append(d[k - 1], 1)[less_count] * less, len(keys)) / (whole + 1)
                free = np.log10(left / (1 - p))
            asked = of(f"u{k}", 3, k)
            if asked:
                who, rests, lost = asked[:3]
                key = _contexts(asked[3:])[-1]
                # an unmet history backs off as it is
                value = lost * _looked_up(keys, free, key, 0.0) - rests * _looked_up(keys, np.log10(total + 1), key, 0.0)
                ids, at = np.unique(who, return_inverse=True)
                zero = np.zeros(len(ids))
                out.append((ids, zero, np.bincount(at, value, len(ids)), zero, zero))
            shorter, totals = keys, total
        if out:
            ids, *sums = _added(out)
            dealt: list[list] = [[] for _ in range(homes)]
            _deal(dealt, "s", mix(ids.view(np.uint64)), [], ids, *sums)
            yield from portions((b, bundle(x)) for b, x in enumerate(dealt) if x)

    return _tidied(run)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums by id."""
    ids, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(ids, return_inverse=True)
    return ids, *(np.bincount(at, v, len(ids)) for v in values)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sums of one bucket's documents."""
    ids, base, score, tokens, known = _added([unpack(b) for b in blocks_of(batches)])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, base, score, tokens.astype(np.int64), known.astype(np.int64))], ["id", "base", "score", "tokens", "known"])


def katz_scores(documents: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", order: int = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """Per document: key, train, n_tokens, n_known, train_tokens, base_score and score (both log10).

    train: which documents the model learns from, a condition on key; order: the longest n-grams, 2 or more.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    own = F.col(key).cast("long")
    several = documents.select(own.alias("id")).groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).count() > 0
    # rows are named by their key where that tells them apart, else by key and text together
    name = F.xxhash64(key, text) if several else own
    rows = documents.select(name.alias("id"), train.alias("train"), F.col(text).alias("text"))
    model = count_unigrams(rows, frequent)
    spread = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = _token_blocks(rows, model, BUCKETS * spread, order)
    sums = tokens.groupBy("bucket").applyInArrow(_sums(model, BUCKETS * spread, order), "bucket int, block binary")
    parts = sums.groupBy("bucket").applyInArrow(_finish(model, max(1, spread // 4), order), "bucket int, block binary")
    out = parts.groupBy("bucket").applyInArrow(_merged, "id long, base double, score double, tokens long, known long")
    if several:
        named = documents.select(F.col(key), name.alias("name"))
        copies = named.groupBy("name").agg(F.count("*").alias("copies"))
        each = out.join(copies, out["id"] == copies["name"]).select("name", *[(F.col(c) / F.col("copies")).cast(out.schema[c].dataType).alias(c) for c in ("base", "score", "tokens", "known")])
        out = named.join(each, "name").drop("name")
    else:
        out = out.withColumnRenamed("id", key)
    return out.select(key, train.alias("train"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
