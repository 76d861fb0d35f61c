"""Short-horizon motion: a constant-velocity filter for each track's box axes, and prediction between observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators.folds import carried, sliced, within
from vigilake.operators.timeline import asof_within

PROCESS_NOISE = MEASUREMENT_NOISE = 1e-4
AXES = ("cx", "cy", "w", "h")
#: The time of a frame that there is none before.
NEVER = -(2**63)
#: Horizons in a slice of a source's frames, in which the frame before each is looked up.
SLICES = 256


def observations(frames: DataFrame, horizon_ns: int) -> DataFrame:
    """Objects of tracked frames as rows with the state of their track's filter after them: `seen`, the observations in
    its run, and p and v (place and speed) of each axis. A run ends at a change of class, a frame without the track, a
    gap above the horizon, an unusable box, a lost state.

    Of one frame's objects with equal ids the first counts; lost and dead objects and boxes without area don't. Objects
    without a track (a negative id) are shown as they are: each is a run of its own, as often as it occurs.
    """
    rows = frames.select("source_id", "generation", "pts_ns", "objects", F.col("pts_ns").alias("_at"))
    before = F.lag("pts_ns").over(within(["source_id", "generation"], "_at"))
    slices = carried(sliced(rows, "_at", SLICES * horizon_ns), ["source_id", "generation"], {"_end": F.max("pts_ns")}, {"_end": F.max})
    rows = slices.withColumn("_before", F.coalesce(before, "_end")).drop("_slice", "_end", "_at")
    rows = rows.select("source_id", "generation", "pts_ns", "_before", F.posexplode("objects").alias("place", "o"))
    rows = rows.select("source_id", "generation", "pts_ns", "_before", "place", "o.*")
    usable = F.col("track_state").isin(0, 1) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    rows = rows.where(usable)
    key = ["source_id", "generation", "track_id", "pts_ns"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    tracked = rows.where("track_id >= 0").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    box = {"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}
    columns = ["source_id", "generation", "track_id", "pts_ns", "class_name", "class_id", *[v.cast("double").alias(k) for k, v in box.items()]]
    states = ", ".join(f"{axis}_p double, {axis}_v double" for axis in AXES)
    # no null, as one among pandas' integers would make doubles of them all
    tracked = tracked.select(*columns, F.coalesce(F.col("_before").cast("long"), F.lit(NEVER)).alias("_before"))
    kinds = ", ".join(f"{n} {t}" for n, t in tracked.dtypes)
    tracks = ["source_id", "generation", "track_id"]
    ordered = tracked.repartition(*tracks).sortWithinPartitions(*tracks, "pts_ns")
    followed = ordered.mapInPandas(_follower(horizon_ns, tracks), f"{kinds}, seen int, {states}").drop("_before")
    alone = rows.where("track_id < 0").select(*columns, F.lit(1).alias("seen"))
    alone = alone.select("*", *[c for axis in AXES for c in (F.col(axis).alias(f"{axis}_p"), F.lit(0.0).alias(f"{axis}_v"))])
    return followed.unionByName(alone)


class Run:
    """The filters of one track's axes in its present run: place, speed and their covariance (a, b; b, d)."""

    def __init__(self, horizon_ns: int):
        self.horizon, self.at, self.named, self.seen = horizon_ns, None, None, 0

    def state(self) -> dict:
        """What the next observation needs, as plain values."""
        return {"at": self.at, "named": self.named, "seen": self.seen, "p": self.p.tolist(), "v": self.v.tolist(), "a": self.a, "b": self.b, "d": self.d}

    @classmethod
    def of_state(cls, horizon_ns: int, state: dict | None) -> Run:
        run = cls(horizon_ns)
        if state is not None:
            run.at, run.named, run.seen = state["at"], tuple(state["named"]), state["seen"]
            run.p, run.v = np.array(state["p"]), np.array(state["v"])
            run.a, run.b, run.d = state["a"], state["b"], state["d"]
        return run

    def add(self, at: int, before, named: tuple, measured: np.ndarray) -> None:
        goes_on = self.at is not None and before == self.at and at - self.at <= self.horizon and named == self.named
        if not goes_on:
            self.p, self.v, self.seen = measured.copy(), np.zeros(len(AXES)), 0
            self.a, self.b, self.d = MEASUREMENT_NOISE, 0.0, 1.0  # alike for all axes
        else:
            state = _step((at - self.at) / 1e9, measured, self.p, self.v, self.a, self.b, self.d)
            self.p, self.v, self.a, self.b, self.d = state
        self.at, self.named, self.seen = at, named, self.seen + 1


def _step(dt, measured, p, v, a, b, d):
    """A filter's numbers after an observation, `dt` seconds after the one before."""
    square = dt * dt
    p = p + dt * v
    a = a + 2 * dt * b + square * d + PROCESS_NOISE * square * square / 4
    b, d = b + dt * d + PROCESS_NOISE * square * dt / 2, d + PROCESS_NOISE * square
    gain, speed = a / (a + MEASUREMENT_NOISE), b / (a + MEASUREMENT_NOISE)
    return p + gain * (measured - p), v + speed * (measured - p), (1 - gain) * a, ((1 - gain) * b + b - speed * a) / 2, d - speed * b


def _follower(horizon_ns: int, tracks: list[str]):
    """Rows in order of their track and time with the state of their run's filter: the runs of a batch advance side by
    side, all their second observations, all their third, and so on; only the last row's state goes to the next batch."""
    names = [*tracks, "class_name", "class_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in batches:
            n = len(part)
            if not n:
                continue
            # the row before the batch stands at 0
            first = held["row"] if held else part[[*names, "pts_ns"]].iloc[0]
            same = np.ones(n, bool)
            for c in names:
                codes = pd.factorize(np.concatenate([np.array([first[c]], object), part[c].to_numpy(object)]))[0]
                same &= codes[1:] == codes[:-1]
            at = np.concatenate([[first["pts_ns"]], part["pts_ns"].to_numpy()]).astype(np.int64)
            gap = at[1:] - at[:-1]
            goes_on = np.concatenate([[False], same & (part["_before"].to_numpy(np.int64) == at[:-1]) & (gap <= horizon_ns)])
            if held is None:
                goes_on[1] = False
            measured = np.concatenate([np.zeros((1, len(AXES))), part[list(AXES)].to_numpy(np.float64)])
            p, v, seen = measured.copy(), np.zeros_like(measured), np.ones(n + 1, np.int64)
            a, b, d = (np.full((n + 1, 1), x) for x in (MEASUREMENT_NOISE, 0.0, 1.0))  # alike for all axes
            if held:
                for x, value in zip((p, v, a, b, d, seen), held["state"], strict=True):
                    x[0] = value
            places = np.arange(n + 1)
            nth = places - np.maximum.accumulate(np.where(goes_on, 0, places))
            order = np.argsort(nth, kind="stable")
            for rows in np.split(order, np.cumsum(np.bincount(nth)))[1:-1]:
                before = rows - 1
                dt = gap[before][:, None] / 1e9
                p[rows], v[rows], a[rows], b[rows], d[rows] = _step(dt, measured[rows], *(x[before] for x in (p, v, a, b, d)))
                seen[rows] = seen[before] + 1
            held = {"row": part[[*names, "pts_ns"]].iloc[-1], "state": [x[-1].copy() for x in (p, v, a, b, d, seen)]}
            states = {f"{axis}_{name}": x[1:, k] for k, axis in enumerate(AXES) for name, x in (("p", p), ("v", v))}
            yield part.assign(seen=seen[1:].astype(np.int32), **states)

    return run


def predict(frames: DataFrame, displays: DataFrame, horizon_ns: int = 300_000_000, motion: bool = True) -> DataFrame:
    """For each display time (source_id, generation, pts_ns) and each track of the latest frame at or before it within
    the horizon: the box, carried forward if the track was seen twice in a row, clipped to the unit square, and whether
    it was predicted or clipped. Boxes wholly outside are left out.

    Each observation carries its filter's state, so a run of any length is folded once.
    """
    obs = observations(frames, horizon_ns)
    latest = frames.select("source_id", "generation", "pts_ns").distinct()
    shown = asof_within(displays.select("source_id", "generation", "pts_ns"), latest, ["source_id", "generation"], "pts_ns", horizon_ns)
    shown = shown.where(F.col("found").isNotNull()).select("source_id", "generation", F.col("pts_ns").alias("display_ns"), F.col("found.pts_ns").alias("pts_ns"))
    told = obs.join(shown, ["source_id", "generation", "pts_ns"])
    age = (F.col("display_ns") - F.col("pts_ns")) / F.lit(1e9)
    moving = F.lit(motion) & (F.col("seen") > 1) & (F.col("display_ns") > F.col("pts_ns"))
    for axis in AXES:
        told = told.withColumn(f"_{axis}", F.when(moving, F.col(f"{axis}_p") + age * F.col(f"{axis}_v")).otherwise(F.col(axis)))
    x1, x2 = F.col("_cx") - F.col("_w") / 2, F.col("_cx") + F.col("_w") / 2
    y1, y2 = F.col("_cy") - F.col("_h") / 2, F.col("_cy") + F.col("_h") / 2
    inside = (F.col("_w") > 0) & (F.col("_h") > 0) & (x2 > 0) & (y2 > 0) & (x1 < 1) & (y1 < 1)
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return told.where(inside).select(
        "source_id",
        "generation",
        "display_ns",
        "track_id",
        "class_name",
        unit(x1).alias("x1"),
        unit(y1).alias("y1"),
        unit(x2).alias("x2"),
        unit(y2).alias("y2"),
        moving.alias("predicted"),
        ((x1 < 0) | (y1 < 0) | (x2 > 1) | (y2 > 1)).alias("clipped"),
    )
