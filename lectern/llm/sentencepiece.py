"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

The lattice of a text has a node between any two characters and an edge for
each vocabulary piece that spells the characters between two nodes; a character
without a piece of its own gets one edge that spells its UTF-8 bytes.  The
forward pass adds up the probability of all segmentations that end at a node;
the backward pass draws one segmentation from the end to the start, so each
comes with exactly its share of the probability (up to 2**-32).  Between two bytes
that stand side by side in no piece of the vocabulary no edge passes (so before a
blank, about a line end, and between most letters and marks): there the lattice falls apart into one for
each word, and the forward pass runs once for each different word that a task keeps.

The draws depend on the seed, the row's key and the word's place alone: the
same key and text give the same pieces in any partitioning.  The vocabulary's
merge ranks give the piece weights: a piece of rank r has weight
1 / (r + 1) ** alpha.  Large alpha comes near the best segmentation.

As in the vocabulary's own convention a text starts with one added blank, which
decoding takes off.  A literal U+2581 is spelt in bytes, so decoding gives back
every text exactly.  Defined results: a null text has null pieces and decodes
to null; an empty text has no pieces; a null key counts as an empty text; rows
with the same key and text get the same pieces; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .tables import tidy
from .words import _TABLE, buffers, inverse_powers, mix, powers, rolling

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 17
BLANK = "▁"

#: Bytes of text that one pass works on, unless one text alone is longer.
CHUNK = 1 << 19
#: Lattice edges that a task keeps for words met before.
KEPT_EDGES = 4_000_000

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def vocabulary(path: str = MODEL) -> tuple[list[str], list[int]]:
    """Pieces by id (byte and control pieces are empty strings) and the ids of the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte = [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[1:-1], 16)] = i
        pieces.append("" if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else piece)
    return pieces, of_byte


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Sampler:
    """Draws segmentations. Lattices of words met before are kept in one table, the edges ordered by the node they end at."""

    def __init__(self, pieces: list[str], of_byte: list[int], alpha: float) -> None:
        self.size, self.of_byte = len(pieces), np.array(of_byte)
        ranked = [(p.replace(BLANK, " "), i) for i, p in enumerate(pieces) if p]
        self.longest = max((len(p) for p, _ in ranked), default=1)
        text = mix(_points("".join(p for p, _ in ranked)).astype(np.uint64) + _C1)
        sizes = np.array([len(p) for p, _ in ranked])
        starts = np.cumsum(sizes) - sizes
        keys = rolling(text, starts, starts + sizes)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in ranked])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        # whether a longer piece may begin like this
        self.begins = np.zeros(1 << 22, bool)
        for n in range(1, self.longest):
            at = starts[sizes > n]
            self.begins[rolling(text, at, at + n) >> np.uint64(42)] = True
        # bytes that stand side by side in some piece, the second at the start of a character
        self.joined = np.zeros((256, 256), bool)
        for p, _ in ranked:
            x = np.frombuffer(p.encode(), np.uint8)
            self.joined[x[:-1], x[1:]] = True
        self.joined[:, 0x80:0xC0] = True
        self.joined = self.joined.ravel()
        # a word of so many characters has no sum too small for a number
        self.linear = int(690 / max(alpha * np.log(10 * self.size), 1e-6))
        self.ranks, self.alpha = np.append(np.arange(1.0, self.size + 1), 10.0 * self.size), alpha
        self.known = np.zeros(0, np.uint64)  # hashes of the words of the table, sorted
        self.row = np.zeros(0, np.int64)  # their places in the table
        self.met = np.zeros(0, np.int64)  # of each word of the table: chunks that had it
        self.begin = np.zeros(0, np.int64)  # its first node
        self.end = np.zeros(0, np.int64)  # its last node
        self.first = np.zeros(0, np.int64)  # of each node: the first edge that ends there
        self.upto = np.zeros(0, np.uint32)  # of each edge: the largest draw for it; likelier edges of a node come first
        self.length = np.zeros(0, np.int16)
        self.piece = np.zeros(0, np.int32)

    def edges(self, points: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in words of these characters, as (start character, length, piece); stop: where each character's word stops."""
        n = len(points)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + _C1) * powers(n), dtype=np.uint64)))
        back = inverse_powers(n)
        at, found = np.arange(n), []
        for length in range(1, self.longest + 1):
            at = at[at + length <= stop[at]]
            h = mix((sums[at + length] - sums[at]) * back[at] + np.uint64(length))
            hit = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
            true = self.keys[place] == h[hit]
            found.append((at[hit[true]], np.full(int(true.sum()), length), self.ids[place[true]]))
            if length == 1:  # characters without a piece of their own
                alone = np.ones(n, bool)
                alone[found[0][0]] = False
                spelt = np.flatnonzero(alone)
                found.append((spelt, np.ones(len(spelt), np.int64), self.size + points[spelt]))
            at = at[self.begins[h >> np.uint64(42)]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def weight(self, piece: np.ndarray, logs: bool) -> np.ndarray:
        table = -self.alpha * np.log(self.ranks) if logs else self.ranks**-self.alpha
        return table[np.minimum(piece, self.size)]

    def learn(self, points: np.ndarray, sizes: np.ndarray) -> None:
        """Forward-filter the lattices of new words, given as their characters in a row, and add them to the table."""
        n, stops = len(points), np.cumsum(sizes)
        word = np.repeat(np.arange(len(sizes)), sizes)
        start, length, piece = self.edges(points, stops[word])
        # words have one node more than characters; edges in order of their end node's distance from the word's start
        offset = start - (stops - sizes)[word[start]] + length
        node = start + word[start] + length
        order = np.argsort(node, kind="stable")
        order = order[np.argsort(offset[order].astype(np.uint16) if sizes.max() < 65536 else offset[order], kind="stable")]
        length, piece, node, offset = length[order], piece[order], node[order], offset[order]
        first = (stops - sizes) + np.arange(len(sizes))
        # sums of the probability of all segmentations; all words' nodes at one distance at a time
        logs = sizes.max() > self.linear
        weight = self.weight(piece, logs)
        total = np.full(n + len(sizes), -np.inf if logs else 0.0)
        total[first] = 0.0 if logs else 1.0
        share = np.empty(len(node))
        cuts = np.searchsorted(offset, np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            ends = node[a:b]
            heads = np.flatnonzero(np.diff(ends, prepend=-1))
            at = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, b - a)))
            if logs:
                v = total[ends - length[a:b]] + weight[a:b]
                top = np.maximum.reduceat(v, heads)
                v = np.exp(v - top[at])
            else:
                v = total[ends - length[a:b]] * weight[a:b]
            sums = np.add.reduceat(v, heads)
            total[ends[heads]] = top + np.log(sums) if logs else sums
            share[a:b] = v / sums[at]
        # by node, likelier edges first; a node's edges differ in length
        bits = int(self.longest).bit_length()
        rank = ((1.0 - share) * (2.0 ** (32 - bits) - 1)).astype(np.uint64)
        order = np.argsort(node.astype(np.uint64) << np.uint64(32) | rank << np.uint64(bits) | length.astype(np.uint64))
        node, length, piece, share = node[order], length[order], piece[order], share[order]
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        many = np.diff(np.append(heads, len(node)))
        # add up each node's shares one after another, so that no other word matters to the rounding
        for k in range(1, int(many.max(initial=1))):
            at = heads[many > k] + k
            share[at] += share[at - 1]
        upto = np.minimum(share * 2.0**32, 2.0**32 - 1).astype(np.uint32)
        upto[heads + many - 1] = 0xFFFFFFFF
        edge = np.searchsorted(node, np.arange(n + len(sizes)))
        nodes, edges = len(self.first), len(self.upto)
        self.begin = np.append(self.begin, first + nodes)
        self.end = np.append(self.end, first + sizes + nodes)
        self.first = np.append(self.first, edge + edges)
        self.upto = np.append(self.upto, upto)
        self.length = np.append(self.length, length.astype(np.int16))
        self.piece = np.append(self.piece, piece.astype(np.int32))

    def forget(self) -> None:
        """Keep the words that most chunks had, up to half of the table."""
        edges = np.append(self.first, len(self.upto))
        cost = edges[self.end + 1] - edges[self.begin]
        likely = np.argsort(-self.met, kind="stable")
        stay = np.sort(likely[np.cumsum(cost[likely]) <= KEPT_EDGES // 2])
        nodes = self.end[stay] - self.begin[stay] + 1
        at = np.repeat(self.begin[stay] - (np.cumsum(nodes) - nodes), nodes) + np.arange(nodes.sum())
        many = edges[at + 1] - edges[at]
        edge = np.repeat(edges[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.first = np.cumsum(many) - many
        self.upto, self.length, self.piece = self.upto[edge], self.length[edge], self.piece[edge]
        self.end = np.cumsum(nodes) - 1
        self.begin = self.end - nodes + 1
        self.met = self.met[stay]
        new = np.full(len(cost), -1)
        new[stay] = np.arange(len(stay))
        self.known, self.row = self.known[new[self.row] >= 0], new[self.row][new[self.row] >= 0]

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in the table of each word data[start:end]; new words are learnt."""
        hashes, one, which = np.unique(rolling(_TABLE[data], starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, hashes)
        here = np.zeros(len(hashes), bool)
        here[place < len(self.known)] = self.known[place[place < len(self.known)]] == hashes[place < len(self.known)]
        new = np.flatnonzero(~here)
        if len(new):
            if len(self.upto) > KEPT_EDGES:
                self.forget()
                return self.rows(data, starts, ends)
            a, size = starts[one[new]], (ends - starts)[one[new]]
            spelling = data[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            letters = np.add.reduceat((spelling & 0xC0) != 0x80, np.cumsum(size) - size)
            had = len(self.begin)
            points = _points(spelling.tobytes().decode()).astype(np.int64)
            short = letters <= self.linear
            for some in (short, ~short):
                if some.any():
                    self.learn(points[np.repeat(some, letters)], letters[some])
            new = np.concatenate((new[short], new[~short]))
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
            known, row = np.append(self.known, hashes[new]), np.append(self.row, np.arange(had, had + len(new)))
            order = np.argsort(known)
            self.known, self.row = known[order], row[order]
            place = np.searchsorted(self.known, hashes)
        row = self.row[place]
        self.met[row] += 1
        return row[which]

    def draw(self, data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of one segmentation of each text data[bounds[i]:bounds[i + 1]], all in a row, and how many each has.

        Texts, if not empty, begin with the added blank.
        """
        n = len(bounds) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        cut = np.empty(len(data), bool)
        cut[1:] = ~self.joined[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        word = self.rows(data, starts, np.append(starts[1:], len(data)))
        counts = np.diff(np.searchsorted(starts, bounds))
        doc = np.repeat(np.arange(n), counts)
        place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            state = mix(seeds[doc] + place.astype(np.uint64) * _C1)
        node, begin = self.end[word], self.begin[word]
        todo, drawn = np.arange(len(word)), []
        steps = np.zeros(len(word), np.int64)
        while len(todo):
            state = mix(state + _C2)
            aim = (state >> np.uint64(32)).astype(np.uint32)
            edge = self.first[node]
            on = np.flatnonzero(aim > self.upto[edge])
            while len(on):
                edge[on] += 1
                on = on[aim[on] > self.upto[edge[on]]]
            drawn.append((todo, self.piece[edge]))
            steps[todo] += 1
            node = node - self.length[edge]
            left = np.flatnonzero(node > begin)
            todo, node, begin, state = todo[left], node[left], begin[left], state[left]
        last = np.cumsum(steps) - 1
        out = np.empty(int(steps.sum()), np.int64)
        for i, (which, piece) in enumerate(drawn):
            out[last[which] - i] = piece
        by_word = np.append(0, np.cumsum(steps))
        ids, wide = self.spelt(out)
        at = np.append(0, np.cumsum(wide))[by_word[np.append(0, np.cumsum(counts))]]
        return ids, np.diff(at)

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As draw, for texts without the added blank."""
        return self.draw(*blanked(pa.array(texts, pa.string())), seeds)

    def spelt(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes of characters in place of characters, and how many ids each has become."""
        at = np.flatnonzero(out >= self.size)
        if not len(at):
            return out, np.ones(len(out), np.int64)
        c = out[at] - self.size
        width = np.select([c < 0x80, c < 0x800, c < 0x10000], [1, 2, 3], 4)
        wide = np.ones(len(out), np.int64)
        wide[at] = width
        ids = np.repeat(out, wide)
        begin = (np.cumsum(wide) - wide)[at]
        for i in range(4):
            here = width > i
            rest = (width - 1 - i)[here] * 6
            lead = np.select([width[here] == 1, width[here] == 2, width[here] == 3], [0, 0xC0, 0xE0], 0xF0)
            ids[begin[here] + i] = self.of_byte[(c[here] >> rest) + lead if i == 0 else (c[here] >> rest & 0x3F) + 0x80]
        return ids, wide


def _chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about CHUNK bytes of text each."""
    upto = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, "right")))
        yield lo, hi
        lo = hi


def blanked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, each (if not empty) with a blank added in front, and the bounds of each."""
    at, data = buffers(texts)
    full = np.diff(at) > 0
    data = np.insert(data[at[0] : at[-1]], (at[:-1] - at[0])[full], 32)
    return data, at - at[0] + np.append(0, np.cumsum(full))


class Speller:
    """The text of piece ids."""

    def __init__(self, pieces: list[str], of_byte: list[int]) -> None:
        byte = {i: bytes([b]) for b, i in enumerate(of_byte)}
        spelling = [byte.get(i) or p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.data = np.frombuffer(b"".join(spelling), np.uint8)
        self.width = np.array([len(x) for x in spelling])
        self.begin = np.cumsum(self.width) - self.width

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of rows of ids, counts[i] ids each, without the blank added in front."""
        texts, ends = [], np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            x = ids[a:b]
            w = self.width[x]
            stop = np.cumsum(w)
            at = np.arange(stop[-1] if len(x) else 0) + np.repeat(self.begin[x] - (stop - w), w)
            texts.append(self.data[at].tobytes()[1:])
        return texts

    def spells(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether each row of ids decodes to data[bounds[i]:bounds[i + 1]], byte for byte."""
        w = self.width[ids]
        ends = np.append(0, np.cumsum(w))
        if not np.array_equal(ends[np.append(0, np.cumsum(counts))], bounds):
            rows = zip(self.texts(ids, counts), bounds[:-1], bounds[1:], strict=True)
            return np.array([x == data[a:b].tobytes()[1:] for x, a, b in rows], bool)
        back = self.data[np.arange(ends[-1]) + np.repeat(self.begin[ids] - ends[:-1], w)]
        wrong = np.append(0, np.cumsum(back != data))
        return np.diff(wrong[bounds]) == 0


def encode(df: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, alpha: float = ALPHA, seed: int = SEED, model: str = MODEL, name: str = "pieces", lossless: str | None = None) -> DataFrame:
    """The columns in keep (the key alone, if not given) and the ids of one drawn segmentation of each text.

    lossless: if given, the name of one more column: whether decoding these ids gives the text back.
    """
    keep = keep or [key]
    pieces, of_byte = vocabulary(model)
    schema = df.select(*keep).schema.add(name, ArrayType(IntegerType()))
    if lossless:
        schema = schema.add(lossless, "boolean")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, speller = Sampler(pieces, of_byte, alpha), Speller(pieces, of_byte)
        for batch in batches:
            column, seeds = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            for lo, hi in _chunks(column):
                part = column.slice(lo, hi - lo)
                data, bounds = blanked(part.fill_null(""))
                ids, counts = sampler.draw(data, bounds, seeds[lo:hi])
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)), mask=part.is_null())]
                if lossless:
                    out.append(pa.array(speller.spells(ids, counts, data, bounds)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-2]), *out], schema.names)

    seeds = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed))
    return df.select(*keep, F.col(text).alias("__text"), seeds.alias("__seed")).mapInArrow(lambda batches: tidy(drawn(batches)), schema)


def decode(df: DataFrame, *, pieces_col: str = "pieces", keep: list[str] | None = None, model: str = MODEL, name: str = "text") -> DataFrame:
    """The columns in keep and the text that the ids spell. Ids outside the vocabulary raise an error."""
    keep = keep or []
    pieces, of_byte = vocabulary(model)
    schema = df.select(*keep).schema.add(name, "string")

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(pieces, of_byte)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            missing = np.asarray(lists.is_null())
            texts = speller.texts(lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = [None if m else t for m, t in zip(missing, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return df.select(*keep, F.col(pieces_col).alias("__pieces")).mapInArrow(spelt, schema)
