"""Stateful mechanisms as Structured Streaming: pacing of requests by origin,
an attempt budget, first-seen URLs, and an incremental library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """One row per key within the watermark: repeated requests are not made."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def paced(stream: DataFrame, gap_seconds: float) -> DataFrame:
    """Requests (origin, id, at) with the time at which each may start: at
    least `gap_seconds` after the one before it of the same origin. State is
    one number per origin."""
    schema = "origin string, id long, at timestamp, start timestamp"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (float("-inf"),)
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        starts = []
        for at in rows["at"]:
            last = max(at.timestamp(), last + gap_seconds)
            starts.append(pd.Timestamp(last, unit="s"))
        state.update((last,))
        yield pd.DataFrame({"origin": key[0], "id": rows["id"], "at": rows["at"], "start": starts})

    return stream.groupBy("origin").applyInPandasWithState(step, schema, "last double", "append", "NoTimeout")


def budgeted(stream: DataFrame, limit: int) -> DataFrame:
    """Attempts (job, id) with whether each is within the job's budget."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (used,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("id", kind="stable")
        number = range(used + 1, used + len(rows) + 1)
        state.update((used + len(rows),))
        yield pd.DataFrame({"job": key[0], "id": rows["id"], "attempt": list(number), "allowed": [n <= limit for n in number]})

    return stream.groupBy("job").applyInPandasWithState(step, "job string, id long, attempt long, allowed boolean", "used long", "append", "NoTimeout")


def by_window(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Event-time counts; late rows beyond the watermark don't count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def upsert_each_batch(target: str, key: str, order: str):
    """A foreachBatch function: the newest record of each key joins the
    library at `target`, which readers see before or after, never between."""
    from ..operators.incremental import upsert
    from ..sources.sinks import publish

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        state = spark.read.parquet(target) if known else batch.limit(0)
        publish(upsert(state, batch, key, order), target)

    return write
