"""Operators whose state outlives a micro-batch: tracker, publisher cooldown, guard, generations, as-of look-up, display.

Each is a processor of `transformWithStateInPandas`, so sessions need the RocksDB state store (STORE). State is kept by
key in the query's checkpoint: a query that is killed resumes from it. The first four take a key's rows as they arrive,
sorted within a micro-batch; the last two hold rows back until the watermark has passed them, and so take them in order
of time however they arrive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from vigilake.operators import motion, tracking

#: The setting that these operators need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


# ---------------------------------------------------------------- as rows arrive


class _Tracking(StatefulProcessor):
    """The living tracks of one source and generation."""

    def __init__(self, settings: tracking.Settings, schema: StructType):
        self.settings, self.schema = settings, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState(
            "tracker",
            "frame bigint, next_id bigint, many array<int>, mean binary, cov binary, known binary, width int, height int, last_pts bigint",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames, last = tracking.Frames(self.settings), None
        if self.held.exists():
            *values, width, height, last = self.held.get()
            state = dict(zip(("frame", "next_id", "many", "mean", "cov", "known"), values, strict=True))
            frames = tracking.Frames(self.settings, (width, height), tracking.Tracker.of_state(self.settings, state))
        part = _sorted(rows, ["pts_ns"])
        late = (part["pts_ns"] < last).to_numpy() if last is not None else np.zeros(len(part), bool)
        arrow = pa.RecordBatch.from_pandas(part, schema=to_arrow_schema(self.schema), preserve_index=False)
        if late.any():
            untracked = tracking.Frames(tracking.Settings(low=float("inf")))
            yield untracked.rows(arrow.filter(pa.array(late))).to_pandas()
            arrow = arrow.filter(pa.array(~late))
        if arrow.num_rows:
            made = frames.rows(arrow)
            state = frames.tracker.state()
            shape = [None if x is None else int(x) for x in frames.shape]
            self.held.update((*state.values(), *shape, int(part["pts_ns"].iloc[-1])))
            yield made.to_pandas()

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, settings: tracking.Settings = tracking.Settings()) -> DataFrame:
    """`tracking.track` over a stream: the same rows, however the frames are dealt to micro-batches.

    The state is a source's and generation's living tracks (means, covariances, ids, ages), so it grows with what is in
    view and not with the stream. A frame before its key's last one comes too late: its detections come back without
    tracks and it changes nothing.
    """
    rows = frames.select(*tracking.FRAME).withColumn("generation", F.col("generation").cast("long"))
    processor = _Tracking(settings, rows.schema)
    return rows.groupBy("source_id", "generation").transformWithStateInPandas(processor, tracking.SCHEMA, "append", "None")


class _Publishing(StatefulProcessor):
    """When each track of one source was last published."""

    def __init__(self, cooldown_ms: int):
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamps = handle.getMapState("stamps", "track_id int", "at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = _sorted(rows, ["now_ms", "frame_id"])
        stamped = {track: at for (track,), (at,) in self.stamps.iterator()}
        before, out = dict(stamped), []
        for now, objects in part[["now_ms", "objects"]].itertuples(index=False):
            objects = [] if objects is None else list(objects)
            tracks = [o["track_id"] for o in objects]
            edge = any(o["track_id"] >= 0 and o["track_state"] in (0, 2, 3) for o in objects)
            due = not tracks or edge or any(t not in stamped or now - stamped[t] >= self.cooldown for t in tracks)
            if due:
                stamped |= dict.fromkeys(tracks, int(now))
            out.append(due)
        end = int(part["now_ms"].iloc[-1])
        for track, at in stamped.items():
            if end - at >= self.cooldown:  # spent: as good as never stamped
                if track in before:
                    self.stamps.removeKey((track,))
            elif before.get(track) != at:
                self.stamps.updateValue((track,), (at,))
        yield part[["source_id", "frame_id", "now_ms"]].assign(published=out)

    def close(self) -> None:
        pass


def publisher_stream(frames: DataFrame, cooldown_ms: int) -> DataFrame:
    """`cooldown.publisher_cooldown` over a stream: (source_id, frame_id, now_ms, published).

    The state is one stamp for each track of a source that was published within the cooldown; spent ones go with the
    micro-batch. Micro-batches have to follow one another in time; within one, frames are sorted.
    """
    rows = frames.select("source_id", "frame_id", "now_ms", F.transform("objects", lambda o: F.struct(o["track_id"].cast("int").alias("track_id"), o["track_state"].cast("int").alias("track_state"))).alias("objects"))
    out = "source_id string, frame_id bigint, now_ms bigint, published boolean"
    if cooldown_ms <= 0:
        return rows.select("source_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("now_ms").cast("long").alias("now_ms"), F.lit(True).alias("published"))
    return rows.groupBy("source_id").transformWithStateInPandas(_Publishing(cooldown_ms), out, "append", "None")


def _media_time() -> list[Column]:
    """pts_ns and whether it is known: a null among pandas' integers would make doubles of them all."""
    pts = F.col("pts_ns").cast("long")
    return [F.coalesce(pts, F.lit(0)).alias("pts_ns"), pts.isNotNull().alias("known")]


class _Guarding(StatefulProcessor):
    """The greatest media time that was let through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "pts_ns bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = _sorted(rows, ["seq"])
        high, out = self.high.get()[0] if self.high.exists() else None, []
        for pts, known in part[["pts_ns", "known"]].itertuples(index=False):
            if not known:
                out.append("no_pts")
            elif high is None or pts > high:
                high = int(pts)
                out.append("published")
            else:
                out.append("duplicate_pts" if pts == high else "stale_pts")
        if high is not None:
            self.high.update((high,))
        yield part[["source_id", "generation", "seq"]].assign(outcome=out)

    def close(self) -> None:
        pass


def guard_stream(frames: DataFrame) -> DataFrame:
    """`timeline.guard` of all sources and generations over a stream: (source_id, generation, seq, outcome).

    The state is one media time for each source and generation. Rows arrive in order of `seq` over micro-batches.
    """
    rows = frames.select("source_id", F.col("generation").cast("long").alias("generation"), F.col("seq").cast("long").alias("seq"), *_media_time())
    out = "source_id string, generation bigint, seq bigint, outcome string"
    return rows.groupBy("source_id", "generation").transformWithStateInPandas(_Guarding(), out, "append", "None")


class _Counting(StatefulProcessor):
    """A source's generation, its last media time, and the cause of its last reset if nothing came after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "generation bigint, pts_ns bigint, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = _sorted(rows, ["seq"])
        generation, last, kind = self.cursor.get() if self.cursor.exists() else (1, None, None)
        out = []
        for pts, known, discont in part[["pts_ns", "known", "discont"]].itertuples(index=False):
            pts = int(pts) if known else None
            now = "discont" if discont else None
            if now is None and pts is not None and last is not None and pts < last:
                now = "rollback"
            generation += now is not None and now != kind
            kind = now
            last = last if pts is None else pts
            out.append(generation)
        self.cursor.update((generation, last, kind))
        yield part[["source_id", "seq"]].assign(generation=out)

    def close(self) -> None:
        pass


def generation_stream(buffers: DataFrame) -> DataFrame:
    """`timeline.generations` over a stream: (source_id, seq, generation), with one cursor a source as state."""
    discont = F.coalesce(F.col("discont").cast("boolean"), F.lit(False)).alias("discont")
    rows = buffers.select("source_id", F.col("seq").cast("long").alias("seq"), *_media_time(), discont)
    return rows.groupBy("source_id").transformWithStateInPandas(_Counting(), "source_id string, seq bigint, generation bigint", "append", "None")


# ---------------------------------------------------------------- in order of time


class _InOrder(StatefulProcessor):
    """Rows (at, side, row) that wait until the watermark is beyond them, and what their successors need of them.

    `row` and the memory are JSON, in which doubles come back as they were. Sides sort a moment's rows.
    """

    #: Units of `at` in a millisecond.
    per_ms = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, side int, row string")
        self.memory = handle.getValueState("memory", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True)
        self.waiting.appendList([(int(a), int(s), r) for a, s, r in part[["at", "side", "row"]].itertuples(index=False)])
        self.handle.registerTimer(int(part["at"].min()) // self.per_ms + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted(r for r in held if r[0] // self.per_ms < passed)
        if not due:
            return
        later = [r for r in held if r[0] // self.per_ms >= passed]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later) // self.per_ms + 1)
        else:
            self.waiting.clear()
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else None
        memory, out = self.advance(key, memory, due)
        self.memory.update((json.dumps(memory),))
        if len(out):
            yield out

    def close(self) -> None:
        pass


def _waiting_rows(frame: DataFrame, keys: list[str], at: str, side: int, per_ms: int) -> DataFrame:
    others = [c for c in frame.columns if c not in keys]
    ts = F.timestamp_millis(F.floor(F.col(at) / per_ms).cast("long"))
    return frame.select(*keys, F.col(at).cast("long").alias("at"), F.lit(side).alias("side"), F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("row"), ts.alias("_ts"))


class _AsOf(_InOrder):
    def __init__(self, keys: list[str], horizon: int, per_ms: int):
        self.keys, self.horizon, self.per_ms = keys, horizon, per_ms

    def advance(self, key, memory, due) -> tuple:
        latest, out = memory, []  # (at, row) of the last right row
        for at, side, row in due:
            if side == 0:
                latest = [at, row]
            else:
                out.append((*key, row, latest[1] if latest and at - latest[0] <= self.horizon else None))
        return latest, pd.DataFrame(out, columns=[*self.keys, "row", "found"])


def asof_stream(left: DataFrame, right: DataFrame, keys: list[str], at: str, horizon: int, per_ms: int = 1000, delay: str = "10 seconds") -> DataFrame:
    """`timeline.asof_within` of two streams: each left row with `found`, the latest right row of its keys within the
    horizon, or null. `per_ms` says how many units of `at` are a millisecond.

    Rows wait for the watermark, `delay` behind the greatest time seen; what is later than that is dropped. The state of
    a key are the rows that wait and the last right row. Of right rows at one time the greatest in JSON counts.
    """
    rows = _waiting_rows(right, keys, at, 0, per_ms).unionByName(_waiting_rows(left, keys, at, 1, per_ms)).withWatermark("_ts", delay)
    kinds = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    made = rows.groupBy(*keys).transformWithStateInPandas(_AsOf(keys, horizon, per_ms), f"{kinds}, row string, found string", "append", "EventTime")
    left_kind, right_kind = (", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name not in keys) for x in (left, right))
    made = made.withColumn("row", F.from_json("row", left_kind)).withColumn("found", F.from_json("found", right_kind))
    return made.select(*keys, "row.*", "found")


class _Showing(_InOrder):
    """The filters of a source's and generation's tracks, and its last frame."""

    per_ms = 1_000_000

    def __init__(self, horizon_ns: int, moves: bool):
        self.horizon, self.moves = horizon_ns, moves

    def advance(self, key, memory, due) -> tuple:
        memory = memory or {"at": None, "objects": [], "runs": {}}
        out = []
        for at, side, row in due:
            if side == 0:
                if at != memory["at"]:  # of frames at one time the first counts
                    memory = self.observed(memory, at, json.loads(row)["objects"] or [])
            elif memory["at"] is not None and at - memory["at"] <= self.horizon:
                out += [(*key, at, *shown) for o in memory["objects"] if (shown := self.shown(o, at, memory["at"]))]
        return memory, pd.DataFrame(out, columns=SHOWN)

    def observed(self, memory: dict, at: int, objects: list[dict]) -> dict:
        runs, seen = {}, []
        for o in objects:
            if o["track_state"] not in (0, 1) or not (o["x2"] > o["x1"] and o["y2"] > o["y1"]) or str(o["track_id"]) in runs:
                continue
            measured = np.array([(o["x1"] + o["x2"]) / 2, (o["y1"] + o["y2"]) / 2, o["x2"] - o["x1"], o["y2"] - o["y1"]])
            named = (o["class_name"], o["class_id"])
            if o["track_id"] >= 0:
                run = motion.Run.of_state(self.horizon, memory["runs"].get(str(o["track_id"])))
                run.add(at, memory["at"], named, measured)
                runs[str(o["track_id"])] = run.state()
                p, v, many = run.p.tolist(), run.v.tolist(), run.seen
            else:
                p, v, many = measured.tolist(), [0.0] * 4, 1
            seen.append({"track_id": o["track_id"], "class_name": o["class_name"], "box": measured.tolist(), "p": p, "v": v, "seen": many})
        return {"at": at, "objects": seen, "runs": runs}  # a track that this frame hasn't ends its run

    def shown(self, o: dict, at: int, seen_at: int) -> tuple | None:
        moving = self.moves and o["seen"] > 1 and at > seen_at
        age = (at - seen_at) / 1e9
        x, y, w, h = [p + age * v for p, v in zip(o["p"], o["v"], strict=True)] if moving else o["box"]
        edges = (x - w / 2, y - h / 2, x + w / 2, y + h / 2)
        if not (w > 0 and h > 0 and edges[2] > 0 and edges[3] > 0 and edges[0] < 1 and edges[1] < 1):
            return None
        cut = tuple(min(max(e, 0.0), 1.0) for e in edges)
        return (o["track_id"], o["class_name"], *cut, moving, cut != edges)


SHOWN = ["source_id", "generation", "display_ns", "track_id", "class_name", "x1", "y1", "x2", "y2", "predicted", "clipped"]


def predict_stream(frames: DataFrame, displays: DataFrame, horizon_ns: int = 300_000_000, motion: bool = True, delay: str = "2 seconds") -> DataFrame:
    """`motion.predict` of a stream of tracked frames and a stream of display times: the same rows.

    The state of a source and generation are the rows that wait for the watermark, its last frame's objects, and the
    filters of the tracks in it.
    """
    keys = ["source_id", "generation"]
    sides = [x.withColumn("generation", F.col("generation").cast("long")) for x in (frames.select(*keys, "pts_ns", "objects"), displays.select(*keys, "pts_ns"))]
    rows = _waiting_rows(sides[0], keys, "pts_ns", 0, 1_000_000).unionByName(_waiting_rows(sides[1], keys, "pts_ns", 1, 1_000_000))
    out = "source_id string, generation bigint, display_ns bigint, track_id int, class_name string, x1 double, y1 double, x2 double, y2 double, predicted boolean, clipped boolean"
    return rows.withWatermark("_ts", delay).groupBy(*keys).transformWithStateInPandas(_Showing(horizon_ns, motion), out, "append", "EventTime")
