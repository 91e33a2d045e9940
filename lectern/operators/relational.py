"""Rollups, trees, guarded writes and filters of a document library, as DataFrame functions."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---- filters and projections ----


def like_all(column: Column, query: str, most: int = 8) -> Column:
    """Whether the column has each of the query's first words, letter case aside; % and _ are plain characters."""
    held = F.lit(True)
    for word in query.split()[:most]:
        held &= F.contains(F.lower(column), F.lit(word.lower()))
    return held


def in_scope(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose column is among ids; no ids means no rows."""
    return df.join(ids.select(F.col(id_column).alias("__scope")), F.col(column) == F.col("__scope"), "left_semi")


def parse_bound(text: Column) -> Column:
    """A typed lower or upper bound: trimmed, a comma may be the decimal mark; empty, negative or no number is none."""
    number = F.trim(F.regexp_replace(text, ",", ".")).try_cast("double")
    return F.when(number >= 0, number)


def age_bucket(at: Column, now: Column) -> Column:
    """day, week, older or month by elapsed time."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)
    day = 86_400
    return F.when(seconds < day, "day").when(seconds < 7 * day, "week").when(seconds < 30 * day, "older").when(at.isNotNull(), "month")


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds; rule order matters."""
    out = None
    for held, name in rules:
        out = F.when(held, name) if out is None else out.when(held, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def status_rollup(children: DataFrame, by: str, status: str, *, failed: list[str], working: list[str], done: list[str]) -> DataFrame:
    """One status per parent: any failed child, else any at work, else all done, else some done, else waiting."""
    has = lambda names: F.bool_or(F.col(status).isin(names))
    rules = [(has(failed), "failed"), (has(working), "working"), (F.bool_and(F.col(status).isin(done)), "ready"), (has(done), "partial")]
    return children.groupBy(by).agg(first_rule(rules, "waiting").alias("status"), F.count("*").alias("children"))


# ---- writes as DataFrame steps ----


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those new rows whose keys it lacks; of new rows with one key the first by all columns."""
    first = Window.partitionBy(*keys).orderBy(*new.columns)
    one = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """All rows, with values set where the condition holds, and whether it held (changed)."""
    held = F.coalesce(condition, F.lit(False))
    out = df.withColumn("changed", held)
    return out.withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in values.items()})


def delete_returning(df: DataFrame, doomed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays, and what a delete by keys returns."""
    return df.join(doomed, keys, "left_anti"), df.join(doomed, keys, "left_semi")


def update_from(df: DataFrame, other: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """df with columns filled from other's row of that key, where there is one."""
    named = other.select(F.col(key), *[F.col(v).alias(f"__{c}") for c, v in values.items()])
    out = df.join(named, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in values}).drop(*[f"__{c}" for c in values])


# ---- aggregates ----


def counts_where(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def upper_median(column: str) -> Column:
    """The element at floor(n / 2) in order: of two middle ones the greater."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{column})")


def outliers_below(df: DataFrame, by: str, value: str, *, scale: float = 1.4826, floor: float = 0.02, limit: float = 4.0, least: int = 5) -> DataFrame:
    """Rows with median and mad of their group, and whether they lie more than limit robust deviations under the median."""
    middle = df.groupBy(by).agg(upper_median(value).alias("median"), F.count(value).alias("n"))
    off = df.join(middle, by).withColumn("off", F.abs(F.col(value) - F.col("median")))
    mad = off.groupBy(by).agg(upper_median("off").alias("mad"))
    out = off.drop("off").join(mad, by)
    far = (F.col("median") - F.col(value)) / F.greatest(F.lit(scale) * F.col("mad"), F.lit(floor)) > limit
    return out.withColumn("outlier", (F.col("n") >= least) & far)


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Per group the first value in order at which half of the weight is reached."""
    per = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    up_to = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("upto", F.sum("w").over(up_to)).withColumn("all", F.sum("w").over(Window.partitionBy(*by)))
    return per.where(F.col("upto") * 2 >= F.col("all")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def oversized(df: DataFrame, by: str, value: str, *, times: float = 3.0, least: float = 6000.0) -> DataFrame:
    """Rows flagged where value exceeds max(times * upper median of the group's others, least).

    Taking a value out of the sorted group moves the median by at most one place,
    so each row reads one of two elements by its own rank.
    """
    group = Window.partitionBy(by)
    ranked = df.withColumn("__r", F.row_number().over(group.orderBy(value)) - 1).withColumn("__n", F.count("*").over(group))
    middle = F.floor((F.col("__n") - 1) / 2)
    ranked = ranked.withColumn("__at", middle)
    low = F.max(F.when(F.col("__r") == F.col("__at"), F.col(value))).over(group)
    high = F.max(F.when(F.col("__r") == F.col("__at") + 1, F.col(value))).over(group)
    others = F.when(F.col("__r") <= F.col("__at"), high).otherwise(low)
    out = ranked.withColumn("others_median", F.when(F.col("__n") > 1, others))
    flag = F.col(value) > F.greatest(F.lit(times) * F.col("others_median"), F.lit(least))
    return out.withColumn("oversized", F.coalesce(flag, F.lit(False))).drop("__r", "__n", "__at")


def lowest_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def queue_eta(queue: DataFrame, lane: str, owner: str, order: list[Column], amount: str) -> DataFrame:
    """For each owner in a lane: the amount of work up to its last item, in queue order."""
    rows = long_running_total(queue, [lane], order, amount, "__before")
    return rows.withColumn("__upto", F.col("__before") + F.coalesce(amount, F.lit(0))).groupBy(lane, owner).agg(F.max("__upto").alias("work_until_done"), F.count("*").alias("items"))


def option_counts(values: DataFrame, column: str, chosen: list[str]) -> DataFrame:
    """Counts of each value; chosen values that do not occur are listed with 0."""
    spark = values.sparkSession
    wanted = spark.createDataFrame([(c,) for c in chosen], "value string")
    counts = values.groupBy(F.col(column).alias("value")).count()
    return counts.join(wanted, "value", "full").select("value", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def multiset_overlap(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """Per group the recall and precision of b's items (with repeats) against a's."""
    x = a.groupBy(by, item).agg(F.count("*").alias("n_a"))
    y = b.groupBy(by, item).agg(F.count("*").alias("n_b"))
    both = x.join(y, [by, item], "full").na.fill(0, ["n_a", "n_b"])
    out = both.groupBy(by).agg(F.sum(F.least("n_a", "n_b")).alias("shared"), F.sum("n_a").alias("in_a"), F.sum("n_b").alias("in_b"))
    share = lambda total: F.when(F.col(total) > 0, F.col("shared") / F.col(total)).otherwise(F.lit(0.0))
    return out.withColumns({"recall": share("in_a"), "precision": share("in_b")})


# ---- trees ----


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; only where all tasks run in this process may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or os.path.abspath("spark-warehouse/checkpoints")


def hold(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the cluster shares, and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Bytes of a batch's rows that are Python objects at a time: lists and dicts of words take some hundred times the text.
PORTION = 1 << 18


def portions(batches: Iterator[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in order, in batches of at most so many bytes; a longer row stands alone."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= most:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from portions(iter((batch.slice(0, half), batch.slice(half))), most)


def closure(tree: DataFrame, node: str, parent: str, depth: int | None = None) -> DataFrame:
    """ancestor, node, depth: each node with itself and all above it, at any depth (or up to the one given); in a cycle every ancestor counts once, nearest first."""
    pairs = tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    up = pairs.where("parent IS NOT NULL").select(F.col("node").alias("ancestor"), F.col("parent").alias("above"))
    out = step = pairs.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    known = tree.select(F.col(node).alias("above")).distinct()
    up = hold(up.join(known, "above", "left_semi"))
    steps = 0
    while depth is None or steps < depth:
        higher = step.join(up, "ancestor").select(F.col("above").alias("ancestor"), "node", (F.col("depth") + 1).alias("depth"))
        step = hold(higher.join(out, ["ancestor", "node"], "left_anti"))
        if not step.limit(1).count():
            break
        out, steps = out.unionByName(step), steps + 1
    return out


def paths(tree: DataFrame, node: str, parent: str, name: str, sep: str = "/") -> DataFrame:
    """node, path (names from the root) and depth."""
    steps = closure(tree, node, parent)
    names = tree.select(F.col(node).alias("ancestor"), F.col(name).alias("__name"))
    parts = steps.join(names, "ancestor").groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("__name").alias("name")))).alias("p"))
    return parts.select("node", F.array_join(F.transform("p", lambda x: x["name"]), sep).alias("path"), (F.size("p") - 1).alias("depth"))


def allowed_moves(tree: DataFrame, node: str, parent: str, moves: DataFrame) -> DataFrame:
    """moves (node, target) with allowed: a node must not go below itself."""
    below = closure(tree, node, parent).select(F.col("ancestor").alias("__a"), F.col("node").alias("__n"))
    hit = moves.join(below, (F.col("node") == F.col("__a")) & (F.col("target") == F.col("__n")), "left")
    return hit.select("node", "target", F.col("__a").isNull().alias("allowed"))


# ---- order ----


def running_total(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """The sum of value over the rows before this one in its group."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def long_running_total(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """running_total for groups that may hold a large share of all rows.

    Rows are ranged over partitions by group and order; each group's part of a partition is summed for itself, and
    the sums of a group's earlier parts, a row each, are added. Rows with equal group and order may stand in either order.
    """
    keys = [F.col(b) for b in by]
    # equal places may part, too, so that no value of the order fills a partition
    ranged = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = hold(ranged.repartitionByRange(*keys, *order, F.col("__tie")).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy(*by, "__part").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = ranged.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    parts = parts.withColumn("__base", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).where("__base <> 0")
    base = parts.select(*[F.col(b).alias(f"__{i}") for i, b in enumerate(by)], F.col("__part").alias("__p"), "__base")
    same = F.col("__part") == F.col("__p")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__{i}"))
    total = F.coalesce(F.sum(value).over(within), F.lit(0))
    rows = ranged.withColumn(name, total).join(base, same, "left")
    return rows.withColumn(name, F.col(name) + F.coalesce("__base", F.lit(0))).select(*df.columns, name)


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, start: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row of that group that starts no later; both sides meet in one sort."""
    marks = right.select(F.col(by), F.col(start).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c != by])
    asks = left.select(F.col(by), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), *[c for c in left.columns if c != by])
    line = Window.partitionBy(by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("__last", F.last("__v", ignorenulls=True).over(line))
    return both.where("__side = 1").select(*left.columns, *[F.col("__last")[v].alias(v) for v in values])


def overlapping(a: DataFrame, b: DataFrame, by: str, cell: int = 1000) -> DataFrame:
    """Pairs of half-open spans (id, start, end) of one group that overlap; spans meet in cells, so no group is paired whole."""
    cells = lambda d, p: d.select(F.col(by), F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))).alias("__cell"))
    x, y = cells(a.where("end > start"), "a"), cells(b.where("end > start"), "b")
    met = x.join(y, [by, "__cell"]).where("a_start < b_end AND b_start < a_end")
    # a pair that shares several cells counts in the first of them
    return met.where(F.floor(F.greatest("a_start", "b_start") / cell) == F.col("__cell")).drop("__cell")
