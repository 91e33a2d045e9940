"""Connected components of a graph given as links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every id in links.

    Each round gives a node the least label around it and then that label's own
    label, so that long chains shrink by half; every round is stored.  All steps
    are joins and minima, which Spark splits where one node has many links.
    """
    both = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).where("u <> v").distinct())
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "id"))
    while True:
        of_v = labels.select(F.col("id").alias("v"), F.col("label").alias("near"))
        near = both.join(of_v.hint("merge"), "v").groupBy("u").agg(F.min("near").alias("near"))
        step = labels.join(near.hint("merge"), labels["id"] == near["u"]).select("id", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("top"))
        new = stored(step.join(up.hint("merge"), "low", "left").select("id", "label", F.least("low", F.coalesce("top", "low")).alias("new")))
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
