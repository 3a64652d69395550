"""Streaming jobs: folder watch, sessions, budgets, once-only events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, folder: str, glob: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "500 milliseconds"):
    """New files of a folder in micro-batches, which also debounce bursts of changes."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", "length", "content", F.md5("content").alias("hash"))
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def sessions(events: DataFrame, by: str, at: str, gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts per key: a quiet gap ends one. Works on streams and tables."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def spend_windows(events: DataFrame, by: str, at: str, cost: str, length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Cost per key in sliding windows."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(by, F.window(at, length, slide).alias("w")).agg(F.sum(cost).alias("spent")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spent")


def once(events: DataFrame, key: str, at: str, retention: str = "14 days") -> DataFrame:
    """Each key once within the retention."""
    return events.withWatermark(at, retention).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def burst_flush(events: DataFrame, by: str, at: str, most: int = 10, quiet_ms: int = 180_000) -> DataFrame:
    """(by, turns, why): a buffer per key, flushed when ``most`` turns are in it or after a quiet time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            if held:
                yield pd.DataFrame({by: [key[0]], "turns": [held], "why": ["quiet"]})
            return
        full = 0
        for b in batches:
            held += len(b)
        full, held = divmod(held, most)
        state.update((held,))
        state.setTimeoutDuration(quiet_ms)
        if full:
            yield pd.DataFrame({by: [key[0]] * full, "turns": [most] * full, "why": ["full"] * full})

    kind = dict(events.dtypes)[by]
    return events.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, turns long, why string", "held long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def allow_requests(events: DataFrame, by: str, at: str, most: int, window_s: int) -> DataFrame:
    """(by, at, admitted): sliding-window rate limit over a stream; refused requests do not count."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        for b in batches:
            out = []
            for t in sorted(b[at]):
                s = t.timestamp()
                recent = [r for r in recent if r > s - window_s]
                out.append(len(recent) < most)
                if out[-1]:
                    recent.append(s)
            yield pd.DataFrame({by: key[0], at: sorted(b[at]), "admitted": out})
        state.update((recent,))

    kind = dict(events.dtypes)[by]
    return events.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {at} timestamp, admitted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)
