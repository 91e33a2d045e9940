"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Nodes are the different vectors; rows with equal vectors are one node's members.  For the graph,
vectors get one more component that makes them equally long, so that
inner products order them as distances do.

Building: random hyperplanes give each node first neighbours among about ``leaf`` nodes
of its own cell (a dense cell is cut at random).  One more tree cuts all nodes at random, so
that a node alone in its cells has a first list, too.  Then each round joins the
graph with its reverse, so that a node's neighbours and a sample of those it is a
neighbour of meet at that node and are compared with each other: neighbours
of neighbours.  What beats a node's list goes into it.  Rounds end when few
lists change.

Search: a query starts from its node's list and from a fixed set of more than k entry nodes,
and expands, again and again, the unexpanded nodes among its ``width`` best, until there are none.  The final scores are
inner products of the original vectors in double precision.

Vectors are looked up in a table that goes to each task while it and the lists of neighbours have at most
``table_bytes``; a query then walks the lists within its task. Beyond that, meetings (or queries) are dealt to parts of a bounded number of nodes, and each part is sent every vector
it asks for once, with components in half precision of the vector's largest; a step of all queries is a round of joins.  Both ways compare the same pairs.

Defined results: vectors that are null, all zero (or empty) or hold a null or non-finite
component take no part; vectors shorter than the longest count as padded with zeros; rows
that share an id are candidates each for itself, never for their own id, and search once
(with the least vector); ties go to the smaller id; fewer candidates than k give
them all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import held, reclaim, stored
from .topk import _matrix, usable
from .words import mix

NEIGHBOURS, REVERSE, OFFERED = 40, 40, 12
TREES, LEAF, ROUNDS, STILL = 6, 128, 8, 0.08
WIDTH, ENTRIES = 100, 12
TABLE_BYTES = 64 << 20
#: Nodes, and queries, of a part that is sent its vectors; offers of a part before the same ones are merged.
PART, ASKING, MERGED = 32768, 2048, 1 << 22


class Table:
    """Vectors by id."""

    def __init__(self, ids: np.ndarray, data: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, self.data = ids[order], data[order]

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[np.searchsorted(self.ids, ids)]


class Lists:
    """Each node's neighbours, as places in a table of vectors."""

    def __init__(self, near: pa.Table, table: Table) -> None:
        at, lists = np.searchsorted(table.ids, near["at"].to_numpy()), near["near"].combine_chunks()
        sizes = np.zeros(len(table.ids) + 1, np.int64)
        sizes[at + 1] = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.starts = np.cumsum(sizes)
        of = np.repeat(at, sizes[at + 1])
        self.who = np.searchsorted(table.ids, lists.flatten().to_numpy()).astype(np.int32)[np.argsort(of, kind="stable")]

    def of(self, places: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.who[self.starts[p] : self.starts[p + 1]] for p in places])).astype(np.int64)


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), dim)


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """node, g: the largest component, the one that makes vectors equally long, and the others as shares of the largest."""
    for batch in batches:
        x = _floats(batch.column(1), dim)
        most = np.abs(x[:, :-1]).max(axis=1, initial=0)
        most = np.where(most > 0, most, 1).astype(np.float32)
        ends = np.stack((most, x[:, -1]), axis=1).astype(np.float32)
        data = np.concatenate((ends.view(np.uint8), np.ascontiguousarray(x[:, :-1] / most[:, None], np.float16).view(np.uint8)), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in data], pa.binary())], ["node", "g"])


def _unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    size = 8 + 2 * (dim - 1)
    data = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[np.frombuffer(c.buffers()[1], np.int32)[c.offset] :][: len(c) * size] for c in column.chunks if len(c)]).reshape(-1, size)
    ends = np.ascontiguousarray(data[:, :8]).view(np.float32)
    body = np.ascontiguousarray(data[:, 8:]).view(np.float16).astype(np.float32) * ends[:, :1]
    return np.concatenate((body, ends[:, 1:]), axis=1)


def _sent(asked: DataFrame, nodes: DataFrame, spread: int) -> DataFrame:
    """of and the nodes' columns: each node that a part asks for (rows part, node), once."""
    return asked.select(F.col("part").alias("of"), "node").repartition(spread, "node").distinct().join(nodes.hint("shuffle_hash"), "node")


def _merged(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """The different pairs among offers."""
    a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return [(a[first], b[first], s[first])]


def _met(dim: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Offers of a part's meetings: rows at, who; its nodes: rows node, g, worst."""

    def run(meetings: pa.Table, sent: pa.Table) -> pa.Table:
        ids = sent["node"].to_numpy()
        order = np.argsort(ids)
        ids, x, worst = ids[order], _unpacked(sent["g"], dim)[order], sent["worst"].to_numpy()[order]
        at, who = meetings["at"].to_numpy(), meetings["who"].to_numpy()
        order = np.lexsort((who, at))
        at, who = at[order], who[order]
        once = np.concatenate(([True], (at[1:] != at[:-1]) | (who[1:] != who[:-1])))
        at, place = at[once], np.searchsorted(ids, who[once])
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
        found: list[tuple[np.ndarray, ...]] = []
        n = 0
        for one in np.split(place, starts[1:-1]):
            found.append(_offers(ids[one], x[one], worst[one]))
            n += len(found[-1][0])
            if n > MERGED:
                found = _merged(found)
                n = 0
        a, b, s = _merged(found)[0]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "s": pa.array(s.astype(np.float32))})

    return run


def _best_of(sims: np.ndarray, most: int) -> np.ndarray:
    m = min(most, sims.shape[1])
    return np.argpartition(-sims, m - 1, axis=1)[:, :m]


def _lists(rows: DataFrame, k: int, spread: int) -> DataFrame:
    """The k best different b of each a."""
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    best = rows.repartition(spread, "a").groupBy("a", "b").agg(F.max("s").alias("s"))
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def _cells(nodes: DataFrame, dim: int, count: int, spread: int) -> DataFrame:
    """First neighbours: a, b, s from random cells of the nodes."""
    bits = min(24, max(1, int(np.ceil(np.log2(max(2, count / LEAF))))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(5).normal(size=(dim, TREES * bits)).astype(np.float32)
        for batch in batches:
            x = _floats(batch.column(1), dim)
            side = (x @ planes > 0).reshape(len(x), TREES, bits)
            code = (side << np.arange(bits)).sum(axis=2).astype(np.int64)
            # one more tree by hash alone, which a node far from all others shares with some, too
            anyhow = mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(max(1, -(-count // LEAF)))
            code = np.concatenate((code, anyhow.astype(np.int64)[:, None]), axis=1)
            for t in range(TREES + 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code[:, t] * (TREES + 1) + t)], ["node", "g", "cell"])

    placed = nodes.select("node", "g").mapInArrow(coded, "node long, g binary, cell long")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / LEAF).alias("parts"))
    placed = placed.join(parts.hint("merge"), "cell").withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.col("parts")))

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        ids, x = group["node"].to_numpy(), np.frombuffer(b"".join(group["g"]), np.float32).reshape(-1, dim)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        at = _best_of(s, OFFERED)
        a, b, s = np.repeat(ids, at.shape[1]), ids[at].ravel(), np.take_along_axis(s, at, 1).ravel()
        return pd.DataFrame({"a": a, "b": b, "s": s})[a != b]

    return placed.groupBy("cell", "part").applyInPandas(compared, "a long, b long, s float")


def _offers(ids: np.ndarray, x: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one meeting that beat the first one's list."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    at = _best_of(s, OFFERED)
    s = np.take_along_axis(s, at, 1)
    good = s > worst[:, None]
    return np.repeat(ids, good.sum(axis=1)), ids[at[good]], s[good]


def _sampled_reverse(graph: DataFrame, most: int, seed: int) -> DataFrame:
    order = Window.partitionBy("b").orderBy(F.xxhash64("a", "b", F.lit(seed)), "a")
    return graph.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(F.col("b").alias("at"), F.col("a").alias("who"))


def neighbour_graph(nodes: DataFrame, dim: int, count: int, table: Broadcast[Table] | None, *, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """a, b, s, r: the k nearest found of each node, of rows node, g (dim floats of equal length)."""
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graph = stored(_lists(_cells(nodes, dim, count, spread), k, spread))
    small = held(nodes.mapInArrow(lambda batches: _packed(batches, dim), "node long, g binary")) if table is None else None
    parts = max(-(-count // PART), 2 * nodes.sparkSession.sparkContext.defaultParallelism)
    for i in range(rounds):
        reclaim(nodes.sparkSession)
        meetings = graph.select(F.col("a").alias("at"), F.col("b").alias("who")).union(_sampled_reverse(graph, reverse, i))
        worst = graph.where(F.col("r") == k).select(F.col("a").alias("node"), F.col("s").alias("worst"))
        if table is not None:
            met = meetings.distinct().join(worst, F.col("who") == F.col("node"), "left").groupBy("at").agg(F.collect_list("who").alias("ids"), F.collect_list(F.coalesce("worst", F.lit(-9.0))).alias("worst"))
        else:
            dealt = meetings.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)))
            known = small.join(worst, "node", "left").select("node", "g", F.coalesce("worst", F.lit(-9.0)).cast("float").alias("worst"))
            sent = _sent(dealt.select("part", F.col("who").alias("node")), known, spread)
            offered = dealt.groupBy("part").cogroup(sent.groupBy("of")).applyInArrow(_met(dim), "a long, b long, s float")

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for j in range(batch.num_rows):
                    ids = batch.column(1)[j].values.to_numpy()
                    out.append(_offers(ids, table.value.of(ids), batch.column(2)[j].values.to_numpy()))
                if out:
                    a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], ["a", "b", "s"])

        if table is not None:
            offered = met.mapInArrow(joined, "a long, b long, s float")
        old = graph.select("a", "b", "s").withColumn("old", F.lit(1))
        both = old.unionByName(offered.withColumn("old", F.lit(0))).repartition(spread, "a")
        order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
        graph = stored(both.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("old").alias("old")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k))
        new, total = graph.agg(F.count_if(F.col("old") == 0), F.count("*")).first()
        graph = graph.drop("old")
        if not total or new / total < STILL:
            break
    return graph


def _merge(ids: np.ndarray, scores: np.ndarray, done: np.ndarray, new: np.ndarray, new_scores: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """A query's state after an expansion: ids, scores, done and the nodes to expand next."""
    ids, scores, done = np.concatenate((ids, new)), np.concatenate((scores, new_scores)), np.concatenate((done, np.zeros(len(new), bool)))
    order = np.lexsort((ids, -scores))[: 2 * width]
    ids, scores, done = ids[order], scores[order], done[order]
    fresh = ~done[:width]
    opened = ids[:width][fresh]
    done = done.copy()
    done[:width] = True
    return ids, scores, done, opened


def _walked(table: Table, lists: Lists, doors: np.ndarray, q: int, g: np.ndarray, width: int) -> np.ndarray:
    """The best places found for the query at place q, from the doors' places and its own list on."""
    ids = doors[doors != q]
    scores, done, opened = table.data[ids] @ g, np.zeros(len(ids), bool), np.array([q])
    while len(opened):
        new = lists.of(opened)
        new = new[~np.isin(new, ids) & (new != q)]
        ids, scores, done, opened = _merge(ids, scores, done, new, table.data[new] @ g, width)
    return ids


_STATE = "q long, ids array<long>, scores array<float>, done array<boolean>, open array<long>"
_ARROW_STATE = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())), ("done", pa.list_(pa.bool_())), ("open", pa.list_(pa.int64()))])


def _expanded(r: dict, new: np.ndarray, s: np.ndarray, width: int) -> dict:
    """A query's row after it met the new nodes."""
    ids, scores, done, opened = _merge(np.array(r["ids"], np.int64), np.array(r["scores"], np.float32), np.array(r["done"], bool), new, s.astype(np.float32), width)
    return {"q": r["q"], "ids": ids, "scores": scores, "done": done, "open": opened}


def _stepped(dim: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The state of a part's queries after a step: rows q, ids, scores, done, new, g; the nodes they meet: rows node, g."""

    def run(asked: pa.Table, sent: pa.Table) -> pa.Table:
        table = Table(sent["node"].to_numpy(), _unpacked(sent["g"], dim)) if sent.num_rows else None
        out = []
        for batch in asked.to_batches(64):
            rows = []
            for r in batch.to_pylist():
                new = np.array(r["new"] or [], np.int64)
                s = table.of(new) @ np.frombuffer(r["g"], np.float32) if len(new) else np.zeros(0)
                rows.append(_expanded(r, new, s, width))
            out.append(pa.RecordBatch.from_pylist(rows, _ARROW_STATE))
        return pa.Table.from_batches(out, _ARROW_STATE)

    return run


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int, table: Broadcast[Table] | None, *, width: int = WIDTH, entries: int = ENTRIES, reverse: int = REVERSE) -> DataFrame:
    """q, node: the up to 2 * width best nodes found of each query node (rows node, g; g as the query's own vector is to be compared), at least min(entries, nodes) - 1."""
    links = graph.select(F.col("a").alias("at"), F.col("b").alias("who")).union(_sampled_reverse(graph, reverse, -1)).distinct()
    near = links.groupBy("at").agg(F.collect_list("who").alias("near"))
    # all queries meet the entry nodes: their vectors and lists go to each task
    fixed = nodes.orderBy(F.xxhash64("node"), "node").limit(entries).collect()
    doors, door_g = np.array([r["node"] for r in fixed], np.int64), np.frombuffer(b"".join(r["g"] for r in fixed), np.float32).reshape(-1, dim)
    if table is not None:
        sent = nodes.sparkSession.sparkContext.broadcast(Lists(near.toArrow(), table.value))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, lists = table.value, sent.value
            at_doors = np.searchsorted(known.ids, doors)
            for batch in batches:
                places = np.searchsorted(known.ids, batch.column(0).to_numpy())
                found = [_walked(known, lists, at_doors, p, g, width) for p, g in zip(places, _floats(batch.column(1), dim), strict=True)]
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))), pa.array(known.ids[np.concatenate(found)])], ["q", "node"])

        out = held(queries.select("node", "g").repartition(nodes.sparkSession.sparkContext.defaultParallelism, "node").mapInArrow(walk, "q long, node long"))
        sent.unpersist()
        return out
    near = held(near)
    is_door = F.col("at").isin(doors.tolist())
    near_doors = F.broadcast(held(near.where(is_door)))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                other = doors != q
                rows.append({"q": q, "ids": doors[other], "scores": door_g[other] @ np.frombuffer(g, np.float32), "done": np.zeros(other.sum(), bool)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())), ("done", pa.list_(pa.bool_()))]))

    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = held(nodes.mapInArrow(lambda batches: _packed(batches, dim), "node long, g binary"))
    small_queries = held(queries.select(F.col("node").alias("q"), "g"))
    parts = max(-(-small_queries.count() // ASKING), 2 * nodes.sparkSession.sparkContext.defaultParallelism)
    begin = queries.select("node", "g").mapInArrow(begun, "q long, ids array<long>, scores array<float>, done array<boolean>")
    state = begin.join(near, F.col("q") == F.col("at"), "left").select("q", "ids", "scores", "done", F.coalesce("near", F.array().cast("array<long>")).alias("found"))
    while True:
        reclaim(nodes.sparkSession)
        fresh = state.withColumn("new", F.array_except(F.array_remove(F.array_distinct("found"), F.col("q")), F.col("ids"))).drop("found")
        fresh = fresh.join(small_queries, "q").withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)))
        sent = _sent(fresh.select("part", F.explode("new").alias("node")), small, spread)
        state = held(fresh.groupBy("part").cogroup(sent.groupBy("of")).applyInArrow(_stepped(dim, width), _STATE))
        opened = state.select("q", F.explode("open").alias("at"))
        if not opened.limit(1).count():
            return state.select("q", F.explode("ids").alias("node"))
        lists = opened.where(~is_door).join(near, "at").select("q", "near").union(opened.where(is_door).join(near_doors, "at").select("q", "near"))
        found = lists.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("found"))
        state = state.drop("open").join(found, "q", "left").withColumn("found", F.coalesce("found", F.array().cast("array<long>")))


def nearest(vectors: DataFrame, query_filter: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, table_bytes: int = TABLE_BYTES, width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id and score; query_filter: a condition on key."""
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    rows = held(usable(vectors, key, vector).withColumn("norm", norm).where("norm > 0"))
    most, dim = rows.agg(F.max("norm"), F.max(F.size("v"))).first()
    most, dim = float(most or 1.0), int(dim or 0)

    # rows with equal vectors, padded, are one node
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
    rows = rows.withColumn("v", padded)
    members = held(rows.join(rows.groupBy("v").agg(F.min("id").alias("node")), "v").select("id", "node", "v", "norm"))

    def lengthened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = _matrix(batch.column(1)), batch.column(2).to_numpy()
            x = np.concatenate((v / np.sqrt(most), np.sqrt(np.maximum(0, 1 - n / most))[:, None]), axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "g"])

    # a node is named by one of its rows' ids; rows that share an id may be in several
    one = members.where("id = node").groupBy("node").agg(F.min("v").alias("v"), F.min_by("norm", "v").alias("norm"))
    nodes = held(one.mapInArrow(lengthened, "node long, g binary"))
    count = nodes.count()
    table = None
    if count * 4 * (dim + 1 + NEIGHBOURS + REVERSE) <= table_bytes:
        got = nodes.toArrow()
        # one broadcast for all rounds and steps: in their functions it would be sent, and kept by the driver, once for each
        table = nodes.sparkSession.sparkContext.broadcast(Table(got["node"].to_numpy(), np.concatenate([np.zeros((0, dim + 1), np.float32), *(_floats(c, dim + 1) for c in got["g"].chunks)])))
        del got
    graph = neighbour_graph(nodes, dim + 1, count, table)
    asking = held(members.withColumnRenamed("id", key).where(query_filter).withColumnRenamed(key, "id").groupBy("id").agg(F.min_by("node", "v").alias("node"), F.min("v").alias("qv")))
    # a query's own vector has nothing to lengthen it
    flat = asking.groupBy("node").agg(F.min("qv").alias("v")).withColumn("norm", F.lit(most))
    found = search(graph, nodes, flat.mapInArrow(lengthened, "node long, g binary"), dim + 1, table, width=max(width, k + 1 + ENTRIES), entries=k + 1 + ENTRIES)
    if table is not None:
        table.unpersist()  # the rows found are stored
    found = found.union(asking.select("node", "node")).distinct()

    # final scores on the original vectors; then the members of the best nodes
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    pairs = found.join(one.select("node", "v"), "node").join(flat.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q")
    by_node = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    best = pairs.select("q", "node", dot.alias("score")).withColumn("r", F.row_number().over(by_node)).where(F.col("r") <= k + 1)
    few = members.withColumn("m", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("m") <= k + 1).select("id", "node")
    out = asking.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(best, "q").join(few, "node").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")

