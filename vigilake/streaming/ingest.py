"""Structured Streaming: ingestion into the ledger, consumer cooldown with state, and event-time statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilake.operators.stats import nearest_rank
from vigilake.sources.ledger import record_batch


def ingest(ingress: DataFrame, root: str, checkpoint: str, now_ms: int):
    """Start a query that records each batch of a message stream in the ledger, at least once and idempotently."""
    writer = ingress.writeStream.foreachBatch(record_batch(root, now_ms)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def cooldown_stream(tracks: DataFrame, cooldown_ms: int = 30_000) -> DataFrame:
    """Rows (event_id, ingress_id, source, track_id, timestamp_ms) with `taken`: whether the event takes its track, by
    the anchored cooldown. The state is one anchor and its delivery for each track, and expires with the watermark.

    Rows must come in order of time up to the watermark's delay; within a batch a track's rows are sorted.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["timestamp_ms", "event_id"])
        anchor, holder = state.get if state.exists else (None, None)
        taken = []
        for event_id, ingress_id, now in rows[["event_id", "ingress_id", "timestamp_ms"]].itertuples(index=False):
            token = f"{event_id}\0{ingress_id}"
            if anchor is None or now - anchor >= cooldown_ms:
                anchor, holder = int(now), token
            taken.append(holder == token)
        state.update((anchor, holder))
        state.setTimeoutTimestamp(max(anchor + cooldown_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[["event_id", "ingress_id", "source", "track_id", "timestamp_ms"]].assign(taken=taken)

    timed = tracks.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", f"{cooldown_ms} milliseconds")
    return timed.groupBy("source", "track_id").applyInPandasWithState(
        fold,
        "event_id string, ingress_id string, source string, track_id bigint, timestamp_ms bigint, taken boolean",
        "anchor bigint, holder string",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def first_deliveries(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events (with ts) without repeats of an event id that come within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_stats(samples: DataFrame, width: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Tumbling event-time windows of a stream (source_id, ts, total_us): results, and the 50th and 95th percentile."""
    windowed = samples.withWatermark("ts", delay).groupBy("source_id", F.window("ts", width))
    made = windowed.agg(F.count("*").alias("completed"), nearest_rank("total_us", 50).alias("p50"), nearest_rank("total_us", 95).alias("p95"))
    return made.select("source_id", F.col("window.start").alias("window_start"), "completed", "p50", "p95")
