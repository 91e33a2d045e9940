"""Stateful streams: throughput over a sliding span, and sessions that a newer run fences off.

Both are beyond what a batch query needs; they run over any stream with the named columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds: how far back rates look, after what silence they start anew, shortest step; samples and span that a rate needs.
SPAN, IDLE, STEP, SAMPLES, LEAST = 600.0, 300.0, 0.25, 3, 30.0


def add_sample(samples: list[tuple[float, float]], at: float, done: float) -> list[tuple[float, float]]:
    """Samples (seconds, work so far) with one more."""
    if samples and (at - samples[-1][0] > IDLE or done < samples[-1][1]):
        samples = []
    if samples and at - samples[-1][0] < STEP:
        return samples
    return [s for s in [*samples, (at, done)] if at - s[0] <= SPAN]


def rate(samples: list[tuple[float, float]]) -> float | None:
    """Work a second, if there are enough samples over enough time."""
    span = samples[-1][0] - samples[0][0] if samples else 0.0
    return (samples[-1][1] - samples[0][1]) / span if len(samples) >= SAMPLES and span >= LEAST else None


def throughput(events: DataFrame, key: str, at: str, done: str, delay: str = "10 minutes") -> DataFrame:
    """key, at and rate after each batch; events: key, an event time, and the work done so far."""
    rows = events.withWatermark(at, delay).select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(done).cast("double").alias("done"))

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        samples = list(zip(*state.get)) if state.exists else []
        last = None
        for batch in batches:
            for r in batch.sort_values("at").itertuples():
                last = r.at
                samples = add_sample(samples, r.at.timestamp(), r.done)
        state.update(([a for a, _ in samples], [b for _, b in samples]))
        yield pd.DataFrame({"key": [group[0]], "at": [last], "rate": [rate(samples)]})

    return rows.groupBy("key").applyInPandasWithState(update, "key string, at timestamp, rate double", "at array<double>, done array<double>", "update", GroupStateTimeout.NoTimeout)


def fenced(events: DataFrame, key: str, token: str) -> DataFrame:
    """Events of each key's newest run only: a run with a smaller token than one seen before is left out."""
    schema = events.schema

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        for batch in batches:
            highest = int(batch[token].max())
            newest = highest if newest is None else max(newest, highest)
            yield batch[batch[token] >= newest][schema.names]
        if newest is not None:
            state.update((newest,))

    return events.groupBy(key).applyInPandasWithState(update, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def log_after(events: DataFrame, at: str, after: str) -> DataFrame:
    """Rows of a log after a cursor; with a streaming source the checkpoint is the cursor from then on."""
    return events.where(F.col(at) > F.lit(after).cast("timestamp"))
