"""Cooldowns: independent for each track (consumer), coupled across a frame's tracks (publisher), and a rate limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators.folds import carried, folded, sliced, within

#: Gaps in a slice of a key's rows, in which the row before each is looked up, and stretches that one fold goes through.
SLICES, STRETCHES = 256, 256


def _stretches(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Rows with `_stretch`, a number that grows wherever a row lies `gap` or more behind the one before it.

    Whatever state a fold over a key holds with a window of `gap`, it is spent at such a place, so stretches can be
    folded on their own. They are numbered in slices of time, each of which knows the last row and the count before it.
    """
    w = within(keys, at)
    rows = carried(sliced(rows, at, SLICES * gap), keys, {"_end": F.max(at)}, {"_end": F.max})
    before = F.coalesce(F.lag(at).over(w), F.col("_end"))
    rows = rows.withColumn("_fresh", F.coalesce(F.col(at) - before >= gap, F.lit(True)).cast("long"))
    rows = carried(rows, keys, {"_sum": F.sum("_fresh")}, {"_sum": F.sum})
    number = F.sum("_fresh").over(w) + F.coalesce("_sum", F.lit(0))
    return rows.withColumn("_stretch", number).drop("_fresh", "_slice", "_end", "_sum")


def _anchors(times, gap: int):
    """The anchors of a sorted array of times: the first, and each time `gap` or more after the last anchor."""
    return F.aggregate(
        times,
        F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(t))).otherwise(acc),
    )


def consumer_cooldown(tracks: DataFrame, cooldown_ms: int = 30_000) -> DataFrame:
    """(event_id, decision) from rows (event_id, ingress_id, source, track_id, timestamp_ms), one for each track of an
    event, or one with a null track for an event without tracks.

    An event runs if it has no tracks, if one of its tracks isn't cooling, or if a cooling track was taken by the same
    delivery (event_id and ingress_id). A track cools for `cooldown_ms` from the time it was taken, whatever comes.
    """
    keys = ["source", "track_id"]
    tracked = _stretches(tracks.where("track_id IS NOT NULL"), keys, "timestamp_ms", cooldown_ms)
    times = tracked.groupBy(*keys, "_stretch").agg(
        F.array_sort(F.collect_set("timestamp_ms")).alias("times"),
    )
    anchors = times.select(*keys, "_stretch", F.explode(_anchors(F.col("times"), cooldown_ms)).alias("anchor"))
    # of the events at an anchor's very time, the lowest takes the track
    at = tracked.join(anchors.withColumnRenamed("anchor", "timestamp_ms"), [*keys, "_stretch", "timestamp_ms"], "left_semi")
    takers = at.groupBy(*keys, "_stretch", F.col("timestamp_ms").alias("anchor"))
    takers = takers.agg(F.min(F.struct("event_id", "ingress_id")).alias("taker"))
    w = Window.partitionBy(*keys, "_stretch").orderBy("timestamp_ms", F.col("event_id").isNotNull())
    marks = takers.withColumnRenamed("anchor", "timestamp_ms")
    both = tracked.unionByName(marks, allowMissingColumns=True)
    holder = F.last("taker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    judged = both.withColumn("_holder", holder).where("event_id IS NOT NULL")
    same = F.struct("event_id", "ingress_id") == F.col("_holder")
    ran = judged.select("event_id", same.alias("runs"))
    ran = ran.unionByName(tracks.where("track_id IS NULL").select("event_id", F.lit(True).alias("runs")))
    decision = F.when(F.bool_or(F.coalesce("runs", F.lit(False))), "RUN").otherwise("SKIP")
    return ran.groupBy("event_id").agg(decision.alias("decision"))


def publisher_cooldown(frames: DataFrame, cooldown_ms: int) -> DataFrame:
    """Frames (source_id, frame_id, now_ms, objects) with `published`.

    A frame is published if it has objects on whose tracks the state changes (NEW, LOST or DEAD, ids from 0), or one
    whose track was never stamped or `cooldown_ms` or longer ago; then all its tracks are stamped. Frames without
    objects, and all frames if there is no cooldown, are published without stamps.

    A fold over several tracks of one source, whose state is the stamps. Wherever no frame comes for as long as a
    cooldown, all stamps are spent, so the stretches between such places are folded on their own; of a source that never
    pauses only the state is held. All of a frame's columns come back; repeated rows are frames each, and so are rows
    without a source.
    """
    if cooldown_ms <= 0:
        return frames.withColumn("published", F.lit(True))
    kept = _stretches(frames, ["source_id"], "now_ms", cooldown_ms)
    kept = kept.select(
        "source_id",
        F.floor(F.col("_stretch") / STRETCHES).alias("part"),  # old stamps do no harm in the stretches after theirs
        "frame_id",
        "now_ms",
        F.transform("objects", lambda o: o["track_id"]).alias("tracks"),
        F.transform("objects", lambda o: o["track_state"]).alias("states"),
        F.struct(*frames.columns).alias("frame"),
    )

    def advance(stamped: dict[int, int], part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for now, tracks, states in part[["now_ms", "tracks", "states"]].itertuples(index=False):
            tracks = [] if tracks is None else list(tracks)
            edge = any(t >= 0 and s in (0, 2, 3) for t, s in zip(tracks, states if tracks else [], strict=True))
            due = not tracks or edge or any(t not in stamped or now - stamped[t] >= cooldown_ms for t in tracks)
            if due and tracks:
                stamped |= dict.fromkeys(tracks, now)
            out.append(due)
        for track in [t for t, at in stamped.items() if now - at >= cooldown_ms]:
            del stamped[track]  # spent
        return part[["frame"]].assign(published=out)

    schema = kept.select("frame", F.lit(True).alias("published")).schema
    decided = folded(kept, ["source_id", "part"], ["now_ms", "frame_id"], dict, advance, schema)
    return decided.select("frame.*", "published")


def rate_limit(frames: DataFrame, min_gap_ns: int) -> DataFrame:
    """Frames that lie at least `min_gap_ns` after the last one kept of their source; 0 keeps all, and of frames at one
    time all are kept or none. Stretches between pauses are folded on their own; the state is the last time kept."""
    if min_gap_ns <= 0:
        return frames
    parted = _stretches(frames, ["source_id"], "pts_ns", min_gap_ns)
    times = parted.select("source_id", F.floor(F.col("_stretch") / STRETCHES).alias("part"), "pts_ns").distinct()

    def advance(last: list[int], part: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for now in part["pts_ns"].tolist():
            kept.append(not last or now - last[0] >= min_gap_ns)
            if kept[-1]:
                last[:] = [now]
        return part.loc[kept, ["source_id", "pts_ns"]]

    schema = times.select("source_id", "pts_ns").schema
    found = folded(times, ["source_id", "part"], ["pts_ns"], list, advance, schema).withColumnsRenamed({"source_id": "of", "pts_ns": "at"})
    return frames.join(found, F.col("source_id").eqNullSafe(F.col("of")) & (F.col("pts_ns") == F.col("at")), "left_semi")
