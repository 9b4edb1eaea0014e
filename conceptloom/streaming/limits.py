"""Stateful operators over event streams: first-hit rate windows, and windowed counts with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S, LIMIT = 60, 600
RESULT = "key long, event_id long, hit long, allowed boolean, retry_after long"


def _fold(rows: pd.DataFrame, start: float | None, hits: int, window_s: int, limit: int) -> tuple[list[tuple], float | None, int]:
    """Pass rows in time order through the window that starts at a key's first hit."""
    out = []
    for key, event, at in zip(rows["key"], rows["event_id"], rows["at"], strict=True):
        if start is None or at - start >= window_s:
            start, hits = at, 0
        hits += 1
        ok = limit <= 0 or hits <= limit
        out.append((key, event, hits, ok, 0 if ok else max(1, int(window_s - (at - start)))))
    return out, start, hits


def _keyed(events: DataFrame, key: str, time: str, event: str) -> DataFrame:
    return events.select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("event_id"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at"), F.col(time).alias("ts"))


def first_hit_windows(events: DataFrame, window_s: int = WINDOW_S, limit: int = LIMIT, key: str = "user_id", time: str = "ts", event: str = "event_id") -> DataFrame:
    """``key``, ``event_id``, ``hit`` (its number in the window), ``allowed``, ``retry_after`` (seconds) for a table of events.

    A window starts at a key's first hit and not on the clock, so each depends on the one before: a fold over a key's sorted
    events, which Spark hands over in portions, so that a task holds one portion of a key and not all of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, hits = None, None, 0
        for pdf in batches:
            out: list[tuple] = []
            for name, rows in pdf.groupby("key", sort=False):
                if name != current:
                    current, start, hits = name, None, 0
                more, start, hits = _fold(rows, start, hits, window_s, limit)
                out += more
            yield pd.DataFrame(out, columns=["key", "event_id", "hit", "allowed", "retry_after"])

    sorted_ = _keyed(events, key, time, event).where("key IS NOT NULL AND at IS NOT NULL").repartition("key").sortWithinPartitions("key", "at", "event_id").drop("ts")
    return sorted_.mapInPandas(run, RESULT)


def first_hit_stream(events: DataFrame, window_s: int = WINDOW_S, limit: int = LIMIT, key: str = "user_id", time: str = "ts", event: str = "event_id") -> DataFrame:
    """The same over a stream; a key's state is dropped once its window has passed without a hit."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, hits = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out, start, hits = _fold(rows, start, hits, window_s, limit)
        state.update((float(start), int(hits)))
        state.setTimeoutDuration(2 * window_s * 1000)
        yield pd.DataFrame(out, columns=["key", "event_id", "hit", "allowed", "retry_after"])

    return _keyed(events, key, time, event).where("key IS NOT NULL AND at IS NOT NULL").drop("ts").groupBy("key").applyInPandasWithState(run, RESULT, "start double, hits long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """``start``, ``event_type``, ``events``, ``total`` per clock window; on a stream, events later than ``late`` are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """``key``, ``start``, ``last``, ``events``: runs of a key's events with less than ``gap`` between them."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events"), F.max(time).alias("last")).select(key, F.col("w.start").alias("start"), "last", "events")


def stale_on_release(mappings: DataFrame, releases: DataFrame) -> DataFrame:
    """Mappings (a stream or a table) joined with the versions in force (``source``, ``version``): ``is_stale`` where they differ."""
    now = releases.select("source", F.col("version").alias("current"))
    return mappings.join(now, "source", "left").withColumn("is_stale", F.coalesce(F.col("object_source_version") != F.col("current"), F.lit(False)))
