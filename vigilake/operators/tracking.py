"""Multi-object tracking: three rounds of association by overlap, an eight-dimensional constant-velocity filter for each
track, and the tracks' lifecycle, as a fold over the frames of a source and generation (BoT-SORT, without appearance)."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vigilake.operators.detect import iou
from vigilake.operators.folds import float32
from vigilake.session import shared_folder

# The filter's standard deviations as shares of a box, of its place and of its speed, and the greatest costs
# of the second and third round and of a tracked and a lost box that are one object.
PLACE, SPEED = 1 / 20, 1 / 160
SECOND, THIRD, DUPLICATE = 0.5, 0.7, 0.15
NEW, MATCHED = 0, 1
STATS = ("n_input", "n_filtered", "n_high", "n_low", "matched_first", "matched_second", "n_new", "n_lost", "n_removed")


@dataclass(frozen=True)
class Settings:
    """Scores that split detections and open tracks, the first round's greatest cost, and how long lost tracks live."""

    low: float = 0.1
    high: float = 0.6
    new: float = 0.7
    match: float = 0.8
    occluded_below: float = 0.5
    buffer: int = 30
    frame_rate: int = 30
    fuse_scores: bool = True
    by_class: bool = False

    @property
    def lost_frames(self) -> int:
        return max(1, max(1, self.buffer) * max(1, self.frame_rate) // 30)


# ---------------------------------------------------------------- column expressions


def score_split(detection: Column, settings: Settings = Settings()) -> Column:
    """`high`, `low`, or null for a detection that takes no part: no area, or a score of at most the low bound."""
    area = (detection["x2"] > detection["x1"]) & (detection["y2"] > detection["y1"])
    score = detection["confidence"]
    return F.when(area & (score > settings.high), "high").when(area & (score > settings.low), "low")


def fused_cost(cost: Column, score: Column) -> Column:
    """A cost with the detection's score taken into it."""
    return 1 - (1 - cost) * score


def same_class(a: Column, b: Column) -> Column:
    """Whether two classes can be one object's; a negative one fits any."""
    return (a < 0) | (b < 0) | (a == b)


def source_warp(warp: list[Column], scale: Column, pad_left: Column, pad_top: Column) -> list[Column]:
    """An affine map on the model's canvas as the same map in source coordinates."""
    a, b, c, d, e, f = warp
    return [a, b, (a * pad_left + b * pad_top + c - pad_left) / scale, d, e, (d * pad_left + e * pad_top + f - pad_top) / scale]


def duplicate_tracks(tracked: DataFrame, lost: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, track_id, which) of the tracks to drop: of a tracked and a lost one (track_id, box, age) that overlap
    nearly wholly, the younger; at equal age the tracked one. Frames are the join key."""
    pairs = tracked.alias("t").join(lost.alias("l"), keys).where(1 - iou(F.col("t.box"), F.col("l.box")) < DUPLICATE)
    older = F.col("t.age") > F.col("l.age")
    which = F.when(older, "lost").otherwise("tracked").alias("which")
    return pairs.select(*keys, F.when(older, F.col("l.track_id")).otherwise(F.col("t.track_id")).alias("track_id"), which).distinct()


# ---------------------------------------------------------------- the filter


class Tracks:
    """Tracks side by side: states, covariances, and what is known of each."""

    def __init__(self, mean=None, cov=None, known=None):
        self.mean = np.zeros((0, 8), np.float32) if mean is None else mean
        self.cov = np.zeros((0, 8, 8), np.float32) if cov is None else cov
        #: track id, class, first and last frame
        self.known = np.zeros((0, 4), np.int64) if known is None else known

    def __len__(self):
        return len(self.mean)

    def take(self, rows) -> Tracks:
        return Tracks(self.mean[rows], self.cov[rows], self.known[rows])

    def plus(self, other: Tracks) -> Tracks:
        pairs = ((self.mean, other.mean), (self.cov, other.cov), (self.known, other.known))
        return Tracks(*[np.concatenate(p) for p in pairs])

    def boxes(self) -> np.ndarray:
        half = self.mean[:, 2:4] / 2
        return np.concatenate((self.mean[:, :2] - half, self.mean[:, :2] + half), axis=1)


def centred(boxes: np.ndarray) -> np.ndarray:
    size = np.maximum(boxes[:, 2:] - boxes[:, :2], np.float32(1e-3))
    return np.concatenate((boxes[:, :2] + size / 2, size), axis=1)


def _spread(mean: np.ndarray, place: float, speed: float) -> np.ndarray:
    """Variances of a state's numbers, from the box's size."""
    size = np.maximum(mean[:, 2:4], np.float32(1e-3))
    places, speeds = size * np.float32(place), size * np.float32(speed)
    return np.concatenate((places, places, speeds, speeds), axis=1) ** 2


_DIAGONAL = np.arange(8)


def begun(boxes: np.ndarray, known: np.ndarray) -> Tracks:
    mean = np.hstack([centred(boxes), np.zeros((len(boxes), 4), np.float32)]).astype(np.float32)
    return Tracks(mean, _spread(mean, 2 * PLACE, 10 * SPEED)[:, :, None] * np.eye(8, dtype=np.float32), known)


def predicted(tracks: Tracks) -> Tracks:
    if not len(tracks):
        return tracks
    mean, cov = tracks.mean.copy(), tracks.cov.copy()
    mean[:, :4] += mean[:, 4:]  # each number moves by its speed
    cov[:, :4] += cov[:, 4:]
    cov[:, :, :4] += cov[:, :, 4:]
    cov[:, _DIAGONAL, _DIAGONAL] += _spread(tracks.mean, PLACE, SPEED)
    return Tracks(mean, cov, tracks.known)


def corrected(tracks: Tracks, boxes: np.ndarray) -> Tracks:
    """The tracks after a measurement each; where the filter can't be solved, the measurement is taken as it is."""
    if not len(tracks):
        return tracks
    seen = centred(boxes)
    inner = tracks.cov[:, :4, :4].copy()
    inner[:, _DIAGONAL[:4], _DIAGONAL[:4]] += _spread(tracks.mean, PLACE, SPEED)[:, :4]
    try:
        gain = np.linalg.solve(inner.transpose(0, 2, 1), tracks.cov[:, :, :4].transpose(0, 2, 1)).transpose(0, 2, 1)
    except np.linalg.LinAlgError:  # one of them can't be: each by itself
        return _one_by_one(tracks, boxes)
    mean = tracks.mean + (gain @ (seen - tracks.mean[:, :4])[:, :, None])[:, :, 0]
    return Tracks(float32(mean), float32(tracks.cov - gain @ tracks.cov[:, :4, :]), tracks.known)


def _one_by_one(tracks: Tracks, boxes: np.ndarray) -> Tracks:
    if len(tracks) > 1:
        parts = [corrected(tracks.take([k]), boxes[[k]]) for k in range(len(tracks))]
        return reduce(Tracks.plus, parts)
    mean = tracks.mean.copy()
    mean[:, :4] = centred(boxes)
    return Tracks(mean, tracks.cov, tracks.known)


def warped(tracks: Tracks, warp: np.ndarray | None) -> Tracks:
    """The tracks under the affine map (m00, m01, m02, m10, m11, m12): each pair of a state's numbers is turned, the
    centre is moved too."""
    if warp is None or not len(tracks):
        return tracks
    m = np.asarray(warp, np.float64)
    turn = np.kron(np.eye(4), m[[0, 1, 3, 4]].reshape(2, 2))
    mean = tracks.mean @ turn.T
    mean[:, :2] += m[[2, 5]]
    return Tracks(float32(mean), float32(turn @ tracks.cov @ turn.T), tracks.known)


# ---------------------------------------------------------------- association


def overlap_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - IoU of all boxes of `a` with all of `b`."""
    if not len(a) or not len(b):
        return np.ones((len(a), len(b)))
    common = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    np.maximum(common, 0, out=common)
    both = common[:, :, 0] * common[:, :, 1]
    sides = [np.maximum(x[:, 2:] - x[:, :2], 0) for x in (a, b)]
    union = (sides[0][:, 0] * sides[0][:, 1])[:, None] + (sides[1][:, 0] * sides[1][:, 1])[None, :] - both
    return np.where(union > 0, 1 - both / np.where(union > 0, union, 1), 1.0)


def _pair_costs(a: np.ndarray, row: np.ndarray, b: np.ndarray, column: np.ndarray) -> np.ndarray:
    """`overlap_cost` of the boxes of `a` and `b` that `row` and `column` pair."""
    first, second = a[row], b[column]
    common = np.minimum(first[:, 2:], second[:, 2:]) - np.maximum(first[:, :2], second[:, :2])
    np.maximum(common, 0, out=common)
    both = common[:, 0] * common[:, 1]
    areas = [(x := np.maximum(y[:, 2:] - y[:, :2], 0))[:, 0] * x[:, 1] for y in (a, b)]
    union = areas[0][row] + areas[1][column] - both
    return np.where(union > 0, 1 - both / np.where(union > 0, union, 1), 1.0)


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of the least total cost, where a row and a column that stay alone cost half of `limit` each.

    Rows and columns that are each other's only candidate are a pair, and those without a candidate stay alone. The rest
    goes to `_least_total`.
    """
    open_pairs = cost <= limit
    if not open_pairs.any():
        return []
    in_row, in_column = open_pairs.sum(axis=1), open_pairs.sum(axis=0)
    rows, columns = np.nonzero(open_pairs)
    only = (in_row[rows] == 1) & (in_column[columns] == 1)
    pairs = list(zip(rows[only].tolist(), columns[only].tolist(), strict=True))
    if not only.all():
        rows, columns = np.unique(rows[~only]), np.unique(columns[~only])
        pairs += [(int(rows[r]), int(columns[c])) for r, c in _least_total(cost[np.ix_(rows, columns)], limit)]
    return sorted(pairs)


def _least_total(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Shortest augmenting paths with potentials; a row may take a column of its own, at what it costs to stay alone."""
    n, m = cost.shape
    alone = np.full((n, n), np.inf)
    np.fill_diagonal(alone, 0.0)
    cost = np.concatenate((cost.astype(np.float64) - limit, alone), axis=1)
    u, v = np.zeros(n), np.zeros(n + m)
    row_of, column_of = np.full(n + m, -1), np.full(n, -1)
    for first in range(n):
        best, via, done = np.full(n + m, np.inf), np.full(n + m, -1), np.zeros(n + m, bool)
        row, length = first, 0.0
        while True:
            reach = length + cost[row] - u[row] - v
            better = ~done & (reach < best)
            best[better], via[better] = reach[better], row
            column = int(np.argmin(np.where(done, np.inf, best)))
            length = best[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        slack = length - best[done]
        u[first] += length
        held = done & (row_of >= 0)
        u[row_of[held]] += length - best[held]
        v[done] -= slack
        while True:
            row = via[column]
            row_of[column] = row
            column_of[row], column = column, column_of[row]
            if row == first:
                break
    return [(r, int(c)) for r, c in enumerate(column_of) if c < m and cost[r, c] <= 1e-12]


class Tracker:
    """The tracks of one source and generation; `update` takes a frame's detections."""

    def __init__(self, settings: Settings = Settings()):
        self.settings, self.frame, self.next_id = settings, 0, 1
        self.tracked, self.lost, self.fresh = Tracks(), Tracks(), Tracks()

    def _cost(self, tracks: Tracks, boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, fuse: bool) -> np.ndarray:
        cost = overlap_cost(tracks.boxes(), boxes)
        if fuse and self.settings.fuse_scores:
            cost = 1 - (1 - cost) * scores[None, :]
        if self.settings.by_class:
            a, b = tracks.known[:, 1][:, None], classes[None, :]
            cost = np.where((a < 0) | (b < 0) | (a == b), cost, 2.0)
        return cost

    def update(self, boxes, scores, classes, warp=None):
        """(track ids, states, occluded, counters) by the detections' places; -1 where a detection has no track."""
        s = self.settings
        self.frame += 1
        boxes, scores, classes = float32(boxes).reshape(-1, 4), float32(scores), np.asarray(classes, np.int64)
        ids, states = np.full(len(boxes), -1), np.zeros(len(boxes), np.int64)
        usable = (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1]) & (scores > np.float32(s.low))
        high = np.flatnonzero(usable & (scores > np.float32(s.high)))
        low = np.flatnonzero(usable & ~(scores > np.float32(s.high)))

        n_tracked = len(self.tracked)
        pool = self.tracked.plus(self.lost)
        pool.mean[n_tracked:, 6:] = 0  # a lost box keeps its size
        pool, fresh = warped(predicted(pool), warp), warped(self.fresh, warp)
        after, matched = Tracks(), {}
        measured = [np.zeros((0, 4), np.float32)]  # the boxes that the tracks in `after` were matched with

        def round_of(pool: Tracks, places: np.ndarray, limit: float, fuse: bool) -> np.ndarray:
            """Match tracks with detections; the tracks that found one."""
            nonlocal after
            if not len(pool) or not len(places):
                return np.zeros(len(pool), bool)
            pairs = assign(self._cost(pool, boxes[places], scores[places], classes[places], fuse), limit)
            rows, found = [r for r, _ in pairs], [int(places[c]) for _, c in pairs]
            out = np.zeros(len(pool), bool)
            if not pairs:
                return out
            hit = pool.take(rows)
            hit.known[:, 1], hit.known[:, 3] = classes[found], self.frame
            hit = corrected(hit, boxes[found])
            after = after.plus(hit) if len(after) else hit
            measured.append(boxes[found])
            ids[found], states[found] = hit.known[:, 0], MATCHED
            matched.update(dict.fromkeys(found, True))
            out[rows] = True
            return out

        hit = round_of(pool, high, s.match, True)
        first, missed = int(hit.sum()), np.flatnonzero(~hit)
        left, waiting = pool.take(missed[missed < n_tracked]), pool.take(missed[missed >= n_tracked])
        hit = round_of(left, low, SECOND, False)
        second, left = int(hit.sum()), left.take(np.flatnonzero(~hit))
        free = np.array([p for p in high if p not in matched], np.int64)
        hit = round_of(fresh, free, THIRD, True)
        removed = int((~hit).sum())

        over = self.frame - waiting.known[:, 3] > s.lost_frames
        if over.any():
            removed += int(over.sum())
            waiting = waiting.take(np.flatnonzero(~over))
        now_lost = left.plus(waiting) if len(left) else waiting

        opens = [int(p) for p in high if p not in matched and scores[p] >= np.float32(s.new)]
        names = np.arange(self.next_id, self.next_id + len(opens))
        self.next_id += len(opens)
        ids[opens], states[opens] = names, NEW
        known = np.column_stack([names, classes[opens], np.full((len(opens), 2), self.frame)]).astype(np.int64)
        born = begun(boxes[opens], known)
        if self.frame == 1:
            after, born = after.plus(born), Tracks()
            measured.append(boxes[opens])

        # of a tracked track, where it was measured, and a lost one in the same place the longer-lived stays
        self.tracked, self.lost, self.fresh = after, now_lost, born
        if len(after) and len(now_lost):
            same = overlap_cost(np.concatenate(measured), now_lost.boxes()) < DUPLICATE
            if same.any():
                ages = [t.known[:, 3] - t.known[:, 2] for t in (after, now_lost)]
                older = ages[0][:, None] > ages[1][None, :]
                self.tracked = after.take(np.flatnonzero(~(same & ~older).any(axis=1)))
                self.lost = now_lost.take(np.flatnonzero(~(same & older).any(axis=0)))
        counters = (len(boxes), len(high) + len(low), len(high), len(low), first, second, len(opens), len(left), removed)
        return ids, states, (ids >= 0) & (scores < np.float32(s.occluded_below)), counters


    def state(self) -> dict:
        """What the next frame needs, as plain values: counters, and the tracks' numbers as bytes."""
        pools = (self.tracked, self.lost, self.fresh)
        stacked = reduce(Tracks.plus, pools)
        raw = {name: getattr(stacked, name).tobytes() for name in ("mean", "cov", "known")}
        return {"frame": self.frame, "next_id": self.next_id, "many": [len(p) for p in pools], **raw}

    @classmethod
    def of_state(cls, settings: Settings, state: dict) -> Tracker:
        made = cls(settings)
        made.frame, made.next_id = state["frame"], state["next_id"]
        shapes = {"mean": (np.float32, (-1, 8)), "cov": (np.float32, (-1, 8, 8)), "known": (np.int64, (-1, 4))}
        stacked = Tracks(*[np.frombuffer(bytes(state[k]), kind).reshape(shape) for k, (kind, shape) in shapes.items()])
        ends = np.cumsum([0, *state["many"]])
        made.tracked, made.lost, made.fresh = (stacked.take(slice(a, b)) for a, b in zip(ends, ends[1:], strict=False))
        return made


#: What the operator takes of a frame, and what it gives for each.
FRAME = ("source_id", "generation", "pts_ns", "width", "height", "detections", "warp")
_OBJECT = "struct<class_id:int,confidence:double,x1:double,y1:double,x2:double,y2:double,track_id:int,track_state:int,occluded:boolean>"
SCHEMA = f"source_id string, generation bigint, pts_ns bigint, objects array<{_OBJECT}>, " + ", ".join(f"{c} bigint" for c in STATS)
_KEPT = ("class_id", "confidence", "x1", "y1", "x2", "y2")
_MADE = {"track_id": pa.int32(), "track_state": pa.int32(), "occluded": pa.bool_()}
KEY = ["source_id", "generation"]
#: Frames in a chunk, those before it over which its tracker gathers its state, chunks at most in a task, and chunks
#: of a range in which frames are sorted.
CHUNK, LEAD, LANES, RANGE = 4_096, 1_024, 256, 16
#: How often chunks that began from another state than the one before ended in run again side by side; then one by one.
ROUNDS = 3


#: A frame's width or height that is null.
_NO_SIZE = np.iinfo(np.int64).min


def _sizes(wide: list, high: list) -> np.ndarray:
    return np.array([[_NO_SIZE if x is None else x for x in side] for side in (wide, high)], np.int64).T.reshape(-1, 2)


def _told(part: pa.RecordBatch, ends: np.ndarray, kept: dict, columns: list, stats: np.ndarray) -> pa.RecordBatch:
    """SCHEMA's columns for frames, of their detections' columns and what the tracker says of each, and the counters."""
    kinds = {"class_id": pa.int32()}
    values = [kept[c].cast(kinds.get(c, pa.float64())) for c in _KEPT]
    values += [pa.array(c).cast(kind) for c, kind in zip(columns, _MADE.values(), strict=True)]
    objects = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, [*_KEPT, *_MADE]))
    return pa.RecordBatch.from_arrays(
        [*[part.column(c) for c in FRAME[:3]], objects, *[pa.array(np.ascontiguousarray(c)) for c in stats.T]], names=[*FRAME[:3], "objects", *STATS]
    )


class Frames:
    """A key's tracker, begun anew where the source's size changes. `exact` says whether its ids are the key's own: they
    are from the key's first frame and from a change of size on."""

    def __init__(self, settings: Settings, shape=None, tracker: Tracker | None = None, exact: bool = True):
        self.settings, self.shape, self.tracker, self.exact = settings, shape, tracker, exact

    def rows(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """SCHEMA's columns for rows of FRAME's columns, in order of time; a frame without detections has none."""
        return self.told(part)[0]

    def told(self, part: pa.RecordBatch) -> tuple[pa.RecordBatch, list[bool]]:
        """`rows`, and whether each frame's ids are exact."""
        detections = part.column("detections")
        sizes = np.asarray(detections.value_lengths().fill_null(0), np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = detections.drop_null().flatten()
        kept = {c: flat.field(flat.type.get_field_index(c)) for c in _KEPT}
        numbers = {c: v.to_numpy(zero_copy_only=False) for c, v in kept.items()}
        boxes = np.column_stack([float32(numbers[c]) for c in ("x1", "y1", "x2", "y2")])
        wide, high = (part.column(c).to_pylist() for c in ("width", "height"))
        made, counters, exact = [], [], []
        for k, warp in enumerate(part.column("warp").to_pylist()):
            if (wide[k], high[k]) != self.shape:
                self.exact = self.exact or self.shape is not None
                self.shape, self.tracker = (wide[k], high[k]), Tracker(self.settings)
            own = slice(ends[k], ends[k + 1])
            scale = float32([wide[k], high[k], wide[k], high[k]])
            found = self.tracker.update(
                boxes[own] * scale, numbers["confidence"][own], numbers["class_id"][own], warp if warp is not None and len(warp) == 6 else None
            )
            made.append(found[:3])
            counters.append(found[3])
            exact.append(self.exact)
        columns = [np.concatenate(c) for c in zip(*made, strict=True)]
        return _told(part, ends, kept, columns, np.asarray(counters, np.int64)), exact

    # ------------------------------------------------------------ from chunk to chunk

    def state(self) -> bytes:
        return pickle.dumps((self.shape, self.exact, self.tracker and self.tracker.state()))

    @classmethod
    def of_state(cls, settings: Settings, state: bytes) -> Frames:
        shape, exact, tracker = pickle.loads(state)
        return cls(settings, shape, tracker and Tracker.of_state(settings, tracker), exact)

    def names(self) -> tuple[list[int], int]:
        """The living tracks' ids and the next one's."""
        if self.tracker is None:
            return [], 1
        t = self.tracker
        return np.concatenate([p.known[:, 0] for p in (t.tracked, t.lost, t.fresh)]).tolist(), t.next_id

    def digest(self) -> str:
        """Of all that what follows depends on: the ids are only names, and frames count from here."""
        h = hashlib.sha256(repr((self.shape, self.tracker is None)).encode())
        if self.tracker is not None:
            for p in (self.tracker.tracked, self.tracker.lost, self.tracker.fresh):
                known = np.column_stack([p.known[:, 1], p.known[:, 2:] - self.tracker.frame])
                for x in (p.mean, p.cov, known):
                    h.update(repr(x.shape).encode() + np.ascontiguousarray(x).tobytes())
        return h.hexdigest()


def _least_total_of(cost: list[list[float]], limit: float) -> list[tuple[int, int]]:
    """`_least_total` of a few rows and columns, in the same steps over plain numbers."""
    n, m, inf = len(cost), len(cost[0]), float("inf")
    cost = [[x - limit for x in row] + [0.0 if k == r else inf for k in range(n)] for r, row in enumerate(cost)]
    u, v, row_of, column_of = [0.0] * n, [0.0] * (n + m), [-1] * (n + m), [-1] * n
    columns = range(n + m)
    for first in range(n):
        best, via, done = [inf] * (n + m), [-1] * (n + m), [False] * (n + m)
        row, length = first, 0.0
        while True:
            own, least, column = cost[row], inf, -1
            for c in columns:
                if done[c]:
                    continue
                reach = length + own[c] - u[row] - v[c]
                if reach < best[c]:
                    best[c], via[c] = reach, row
                if best[c] < least:
                    least, column = best[c], c
            length, done[column] = best[column], True
            if row_of[column] < 0:
                break
            row = row_of[column]
        u[first] += length
        for c in columns:
            if done[c]:
                if row_of[c] >= 0:
                    u[row_of[c]] += length - best[c]
                v[c] -= length - best[c]
        while True:
            row = via[column]
            row_of[column] = row
            column_of[row], column = column, column_of[row]
            if row == first:
                break
    return [(r, c) for r, c in enumerate(column_of) if c < m and cost[r][c] <= 1e-12]


class Lanes:
    """Trackers of many chunks side by side: a step takes a frame of each, and all their tracks are advanced together. A
    lane's tracks are those that a `Tracker` of its own would have, to the last bit: pools are in order of lanes, and
    within a lane in the tracker's order. A track's `known` has its lane as a fifth number."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.frame, self.next_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shape, self.shaped, self.exact = np.zeros((0, 2), np.int64), np.zeros(0, bool), np.zeros(0, bool)
        self.tracked = self.lost = self.fresh = self._none()

    @staticmethod
    def _none() -> Tracks:
        return Tracks(known=np.zeros((0, 5), np.int64))

    @staticmethod
    def _merged(*parts: Tracks) -> Tracks:
        """The parts' tracks by lane, those of a lane in the parts' order."""
        parts = [p for p in parts if len(p)]
        if len(parts) < 2:
            return parts[0] if parts else Lanes._none()
        both = reduce(Tracks.plus, parts)
        return both.take(np.argsort(both.known[:, 4], kind="stable"))

    def opened(self, frames: Frames) -> int:
        """A new lane with the state of `frames`."""
        lane, t = len(self.frame), frames.tracker
        self.frame, self.next_id = np.append(self.frame, t.frame if t else 0), np.append(self.next_id, t.next_id if t else 1)
        self.shape, self.shaped = np.vstack([self.shape, _sizes(*[[x] for x in frames.shape or (None, None)])]), np.append(self.shaped, frames.shape is not None)
        self.exact = np.append(self.exact, frames.exact)
        for name in ("tracked", "lost", "fresh"):
            pool = getattr(t, name) if t else Tracks()
            known = np.column_stack([pool.known, np.full(len(pool), lane)]).astype(np.int64)
            setattr(self, name, self._merged(getattr(self, name), Tracks(pool.mean, pool.cov, known)))
        return lane

    def frames_of(self, lane: int) -> Frames:
        """The lane's state as one of its own."""
        if not self.shaped[lane]:
            return Frames(self.settings, exact=bool(self.exact[lane]))
        t = Tracker(self.settings)
        t.frame, t.next_id = int(self.frame[lane]), int(self.next_id[lane])
        for name in ("tracked", "lost", "fresh"):
            pool = getattr(self, name)
            a, b = np.searchsorted(pool.known[:, 4], [lane, lane + 1])
            setattr(t, name, Tracks(pool.mean[a:b], pool.cov[a:b], np.ascontiguousarray(pool.known[a:b, :4])))
        shape = tuple(None if x == _NO_SIZE else int(x) for x in self.shape[lane])
        return Frames(self.settings, shape, t, bool(self.exact[lane]))

    def told(self, part: pa.RecordBatch, lanes: np.ndarray, cuts: list[int], before: Callable[[int, int], None]) -> tuple[pa.RecordBatch, np.ndarray]:
        """`Frames.told` of rows in steps, which `cuts` part: a step has one row at most of a lane, and its rows go to `before` first."""
        detections = part.column("detections")
        sizes = np.asarray(detections.value_lengths().fill_null(0), np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = detections.drop_null().flatten()
        kept = {c: flat.field(flat.type.get_field_index(c)) for c in _KEPT}
        numbers = {c: v.to_numpy(zero_copy_only=False) for c, v in kept.items()}
        shapes = _sizes(*[part.column(c).to_pylist() for c in ("width", "height")])
        scale = float32(np.where(shapes == _NO_SIZE, np.nan, shapes))[:, [0, 1, 0, 1]]
        boxes = np.column_stack([float32(numbers[c]) for c in ("x1", "y1", "x2", "y2")]).reshape(-1, 4) * np.repeat(scale, sizes, axis=0)
        scores, classes = float32(numbers["confidence"]), np.asarray(numbers["class_id"], np.int64)
        column = part.column("warp")
        warps = column.to_pylist() if column.null_count < len(column) else None
        ids, states = np.full(len(boxes), -1), np.zeros(len(boxes), np.int64)
        stats, exact = np.zeros((part.num_rows, len(STATS)), np.int64), np.zeros(part.num_rows, bool)
        for a, b in zip(cuts, cuts[1:], strict=False):
            before(a, b)
            here, own = lanes[a:b], slice(ends[a], ends[b])
            self._begin_anew(here, shapes[a:b])
            exact[a:b] = self.exact[here]
            moved = {int(here[k - a]): warps[k] for k in range(a, b) if warps[k] is not None and len(warps[k]) == 6} if warps else {}
            at = np.repeat(here, sizes[a:b])
            stats[a:b] = self.update(here, at, boxes[own], scores[own], classes[own], moved, ids[own], states[own])
            stats[a:b, 0] = sizes[a:b]
        occluded = (ids >= 0) & (scores < np.float32(self.settings.occluded_below))
        return _told(part, ends, kept, [ids, states, occluded], stats), exact

    def _begin_anew(self, lanes: np.ndarray, shapes: np.ndarray) -> None:
        """Lanes whose frames have another size than before have a tracker of no frame."""
        other = ~self.shaped[lanes] | (self.shape[lanes] != shapes).any(axis=1)
        if not other.any():
            return
        anew = lanes[other]
        self.exact[anew] |= self.shaped[anew]
        self.shape[anew], self.shaped[anew], self.frame[anew], self.next_id[anew] = shapes[other], True, 0, 1
        for name in ("tracked", "lost", "fresh"):
            pool = getattr(self, name)
            gone = np.isin(pool.known[:, 4], anew)
            if gone.any():
                setattr(self, name, pool.take(np.flatnonzero(~gone)))

    def _pairs(self, tracks: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a track and a detection of one lane, as places in both (given by their lanes; detections of a lane
        are side by side), in order of the tracks."""
        many = np.bincount(found, minlength=len(self.frame))
        first = np.zeros(len(self.frame), np.int64)
        if len(found):
            heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            first[found[heads]] = heads
        c = many[tracks]
        row = np.repeat(np.arange(len(tracks)), c)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c) + first[tracks][row]

    def _assigned(self, row: np.ndarray, column: np.ndarray, cost: np.ndarray, limit: float, n: int, m: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`assign` in each lane, over pairs as of `_pairs`; `of` has the rows' lanes."""
        near = np.flatnonzero(cost <= limit)
        r, c = row[near], column[near]
        in_row, in_column = np.bincount(r, minlength=n), np.bincount(c, minlength=m)
        alone = in_column[c] == 1
        only = alone & (in_row[r] == 1)
        rows, columns = [r[only]], [c[only]]
        # a row whose columns are no other row's takes the first of its least costs
        theirs = ~only & (np.bincount(r, weights=~alone, minlength=n)[r] == 0)
        if theirs.any():
            order = np.lexsort((c[theirs], cost[near[theirs]], r[theirs]))
            r1, c1 = r[theirs][order], c[theirs][order]
            head = np.concatenate([[True], r1[1:] != r1[:-1]]) & (cost[near[theirs]][order].astype(np.float64) - limit <= 0)
            rows.append(r1[head])
            columns.append(c1[head])
        rest = np.flatnonzero(~only & ~theirs)
        if len(rest):
            lane = of[r[rest]]
            cuts = [0, *(np.flatnonzero(lane[1:] != lane[:-1]) + 1).tolist(), len(rest)]
            start = np.searchsorted(row, r[rest])  # a row's pairs stand side by side, for all columns of its lane
            r2, c2, at, base = r[rest].tolist(), c[rest].tolist(), start.tolist(), column[start].tolist()
            more_r, more_c = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                of_row = dict(zip(r2[a:b], at[a:b], strict=True))
                its_rows, its_columns = sorted(of_row), sorted(set(c2[a:b]))
                places = [of_row[x] + y - base[a] for x in its_rows for y in its_columns]
                values, w = cost[places].tolist(), len(its_columns)
                for x, y in _least_total_of([values[k : k + w] for k in range(0, len(values), w)], limit):
                    more_r.append(its_rows[x])
                    more_c.append(its_columns[y])
            rows.append(np.array(more_r, np.int64))
            columns.append(np.array(more_c, np.int64))
        rows, columns = np.concatenate(rows), np.concatenate(columns)
        order = np.argsort(rows, kind="stable")
        return rows[order], columns[order]

    def update(self, lanes, at, boxes, scores, classes, warps, ids, states) -> np.ndarray:
        """A frame of each of `lanes`: `at` has its detections' lanes. Fills `ids` and `states`; gives the counters."""
        s, k = self.settings, len(self.frame)
        self.frame[lanes] += 1
        usable = (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1]) & (scores > np.float32(s.low))
        high = np.flatnonzero(usable & (scores > np.float32(s.high)))
        low = np.flatnonzero(usable & ~(scores > np.float32(s.high)))
        counted = lambda which: np.bincount(which, minlength=k)[lanes]

        idle = [self._none()] * 3
        pools = [self.tracked, self.lost, self.fresh]
        if len(lanes) < k:  # the others' tracks wait
            now = np.zeros(k, bool)
            now[lanes] = True
            on = [now[p.known[:, 4]] for p in pools]
            idle = [p.take(np.flatnonzero(~x)) for p, x in zip(pools, on, strict=True)]
            pools = [p.take(np.flatnonzero(x)) for p, x in zip(pools, on, strict=True)]
        lost = Tracks(pools[1].mean.copy(), pools[1].cov, pools[1].known)
        lost.mean[:, 6:] = 0  # a lost box keeps its size
        both = pools[0].plus(lost)
        order = np.argsort(both.known[:, 4], kind="stable")
        pool, was_lost, fresh = predicted(both.take(order)), order >= len(pools[0]), pools[2]
        if warps:
            pool, fresh = self._warped(pool, warps), self._warped(fresh, warps)
        free = np.ones(len(boxes), bool)
        after, measured = [], []

        def round_of(pool: Tracks, places: np.ndarray, limit: float, fuse: bool) -> np.ndarray:
            """Match tracks with detections; the tracks that found one."""
            out = np.zeros(len(pool), bool)
            if not len(pool) or not len(places):
                return out
            row, column = self._pairs(pool.known[:, 4], at[places])
            found = places[column]
            cost = _pair_costs(pool.boxes(), row, boxes, found)
            if fuse and s.fuse_scores:
                cost = 1 - (1 - cost) * scores[found]
            if s.by_class:
                a, b = pool.known[row, 1], classes[found]
                cost = np.where((a < 0) | (b < 0) | (a == b), cost, 2.0)
            row, column = self._assigned(row, column, cost, limit, len(pool), len(places), pool.known[:, 4])
            if not len(row):
                return out
            found, hit = places[column], pool.take(row)
            hit.known[:, 1], hit.known[:, 3] = classes[found], self.frame[hit.known[:, 4]]
            after.append(corrected(hit, boxes[found]))
            measured.append(boxes[found])
            ids[found], states[found], free[found], out[row] = hit.known[:, 0], MATCHED, False, True
            return out

        hit = round_of(pool, high, s.match, True)
        first = counted(pool.known[hit, 4])
        left, waiting = pool.take(np.flatnonzero(~hit & ~was_lost)), pool.take(np.flatnonzero(~hit & was_lost))
        hit = round_of(left, low, SECOND, False)
        second, left = counted(left.known[hit, 4]), left.take(np.flatnonzero(~hit))
        hit = round_of(fresh, high[free[high]], THIRD, True)
        removed = counted(fresh.known[~hit, 4])
        over = self.frame[waiting.known[:, 4]] - waiting.known[:, 3] > s.lost_frames
        if over.any():
            removed = removed + counted(waiting.known[over, 4])
            waiting = waiting.take(np.flatnonzero(~over))
        now_lost = self._merged(left, waiting)

        opens = high[free[high] & (scores[high] >= np.float32(s.new))]
        opens = opens[np.argsort(at[opens], kind="stable")]
        of = at[opens]
        names = self.next_id[of] + np.arange(len(of)) - np.searchsorted(of, of)
        self.next_id += np.bincount(of, minlength=k)
        ids[opens], states[opens] = names, NEW
        born = begun(boxes[opens], np.column_stack([names, classes[opens], self.frame[of], self.frame[of], of]).astype(np.int64))
        at_once = self.frame[of] == 1
        if at_once.any():
            after.append(born.take(np.flatnonzero(at_once)))
            measured.append(boxes[opens[at_once]])
            born = born.take(np.flatnonzero(~at_once))

        # of a tracked track, where it was measured, and a lost one in the same place the longer-lived stays
        seen = reduce(Tracks.plus, after) if after else self._none()
        order = np.argsort(seen.known[:, 4], kind="stable")
        seen = seen.take(order)
        if len(seen) and len(now_lost):
            row, column = self._pairs(seen.known[:, 4], now_lost.known[:, 4])
            same = np.flatnonzero(_pair_costs(np.concatenate(measured)[order], row, now_lost.boxes(), column) < DUPLICATE)
            if len(same):
                row, column = row[same], column[same]
                ages = [t.known[:, 3] - t.known[:, 2] for t in (seen, now_lost)]
                older = ages[0][row] > ages[1][column]
                stays = [np.ones(len(t), bool) for t in (seen, now_lost)]
                stays[0][row[~older]], stays[1][column[older]] = False, False
                seen, now_lost = seen.take(np.flatnonzero(stays[0])), now_lost.take(np.flatnonzero(stays[1]))
        self.tracked, self.lost, self.fresh = (self._merged(a, b) for a, b in zip(idle, (seen, now_lost, born), strict=True))
        counts = (counted(at[high]) + counted(at[low]), counted(at[high]), counted(at[low]), first, second, counted(of), counted(left.known[:, 4]), removed)
        return np.column_stack([np.zeros(len(lanes), np.int64), *counts])

    def _warped(self, tracks: Tracks, warps: dict) -> Tracks:
        """Each lane's tracks under its warp."""
        parts, ends = [], np.searchsorted(tracks.known[:, 4], np.arange(len(self.frame) + 1))
        for lane in np.unique(tracks.known[:, 4]).tolist():
            parts.append(warped(tracks.take(slice(ends[lane], ends[lane + 1])), warps.get(lane)))
        return reduce(Tracks.plus, parts) if parts else tracks


#: A chunk's row in the table of chunks, which stands beside its frames' rows.
_CHUNK = "begin_digest string, end_digest string, begin_ids array<bigint>, begin_next bigint, end_ids array<bigint>, end_next bigint, end_exact boolean, end_state binary"


def _run_chunks(settings: Settings, schema: pa.Schema):
    """Frames' rows (FRAME, _chunk, _lead, _step) in order of _step, of many chunks side by side, as rows of SCHEMA, and one
    for each chunk. A row with `_state` stands before a chunk's others and is what its tracker begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, of, begun = Lanes(settings), {}, []

        def padded(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def note(lane: int) -> None:
            """What a chunk begins with."""
            state = lanes.frames_of(lane)
            begun[lane] = (state.digest(), *state.names())

        def told(part: pa.RecordBatch, at: np.ndarray, leads: np.ndarray) -> pa.RecordBatch | None:
            steps, waiting = part.column("_step").to_numpy(), np.array([b is None for b in begun])

            def before(a: int, b: int) -> None:
                for lane in at[a:b][~leads[a:b] & waiting[at[a:b]]].tolist():
                    note(lane)
                    waiting[lane] = False

            made, exact = lanes.told(part, at, [0, *(np.flatnonzero(steps[1:] != steps[:-1]) + 1).tolist(), len(steps)], before)
            own = pa.array(np.flatnonzero(~leads))
            if not len(own):
                return None
            made = made.append_column("_chunk", part.column("_chunk")).append_column("_exact", pa.array(exact)).take(own)
            return padded(dict(zip(made.schema.names, made.columns, strict=True)))

        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in (*KEY, "_chunk")], strict=True))
            leads, states = np.asarray(batch.column("_lead").to_pylist(), bool), batch.column("_state")
            heads = np.asarray(states.is_valid())
            for k, name in enumerate(names):
                if name not in of:
                    # without a state or frames before, these are the key's first
                    start = Frames.of_state(settings, states[k].as_py()) if heads[k] else Frames(settings, exact=not leads[k])
                    of[name] = lanes.opened(start)
                    begun.append(None)
            at, own = np.array([of[n] for n in names], np.int64), np.flatnonzero(~heads)
            for k in np.flatnonzero(heads).tolist():
                note(of[names[k]])
            if len(own):
                part = batch if len(own) == len(names) else batch.take(pa.array(own))
                rows = told(part, at[own], leads[own])
                if rows is not None:
                    yield rows
        for name, lane in of.items():
            if begun[lane] is None:
                note(lane)
            state = lanes.frames_of(lane)
            values = (*name, *begun[lane], *state.names(), state.exact, state.state(), state.digest())
            columns = [*KEY, "_chunk", "begin_digest", "begin_ids", "begin_next", "end_ids", "end_next", "end_exact", "end_state", "end_digest"]
            yield padded({n: pa.array([v], schema.field(n).type) for n, v in zip(columns, values, strict=True)})

    return run


def _named(chunks: DataFrame) -> DataFrame:
    """Chunks with `names`, a map from the ids that their trackers began with to the key's, and `shift`, from the ids that
    they gave to the key's. The ids are handed on from chunk to chunk, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, following = None, [], 1
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["source_id"], r["generation"]) != key:
                    key, ids, following = (r["source_id"], r["generation"]), r["begin_ids"], r["begin_next"]
                names, shift = dict(zip(r["begin_ids"], ids, strict=True)), following - r["begin_next"]
                if r["end_exact"]:
                    ids, following = r["end_ids"], r["end_next"]
                else:
                    ids, following = [names[i] if i < r["begin_next"] else i + shift for i in r["end_ids"]], r["end_next"] + shift
                out.append({"source_id": key[0], "generation": key[1], "_chunk": r["_chunk"], "names": list(names.items()), "begin_next": r["begin_next"], "shift": shift})
            yield pa.RecordBatch.from_pylist(out, made) if out else pa.RecordBatch.from_pylist([], made)

    kinds = "source_id string, generation bigint, _chunk int, names map<bigint,bigint>, begin_next bigint, shift bigint"
    made = pa.schema([
        ("source_id", pa.string()), ("generation", pa.int64()), ("_chunk", pa.int32()), ("names", pa.map_(pa.int64(), pa.int64())),
        ("begin_next", pa.int64()), ("shift", pa.int64()),
    ])
    rows = chunks.select(*KEY, "_chunk", "begin_ids", "begin_next", "end_ids", "end_next", "end_exact")
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "_chunk").mapInArrow(run, kinds)


def track(frames: DataFrame, settings: Settings = Settings(), chunk: int = CHUNK, lead: int = LEAD, rounds: int = ROUNDS) -> DataFrame:
    """Frames (source_id, generation, pts_ns, width, height, detections in shares of the frame, and warp, six numbers in
    source pixels or null) with `objects`, the detections in their order with track ids and states, and counters.

    Detections without a track have id -1. A source's frames of one generation are a fold, in order of time, whose state is
    its living tracks; another size of the frame begins it anew. Ids run from 1 in each.

    The fold runs in chunks side by side, LANES at most in a task. What lived long ago has no effect once it is lost, so a
    chunk's tracker gathers its state over the frames before it, and that state is compared with the one that the chunk
    before ended in, to the last bit. Where they differ, the chunk runs again from the right state; what differs still after
    `rounds` of this runs in one task a key. So the result is that of the plain fold.
    """
    spark, root = frames.sparkSession, shared_folder(frames.sparkSession, "tracker")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    rows = kept(frames.select(*FRAME).withColumn("generation", F.col("generation").cast("long")), "frames")
    many, slots = max(1, -(-rows.count() // chunk)), spark.sparkContext.defaultParallelism
    # ranges of the frames' order, of several chunks each; frames of one time are in the order of their other columns
    rows = rows.repartitionByRange(max(min(many, slots), -(-many // RANGE)), *KEY, "pts_ns")
    rows = rows.sortWithinPartitions(*KEY, "pts_ns", "width", "height", "detections", "warp")
    rows = kept(rows.withColumn("_row", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumns({"_range": F.shiftright("_row", 33), "_place": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_all"))
    ranges = ranges.withColumn("_width", F.ceil(F.col("_all") / F.greatest(F.lit(1), F.round(F.col("_all") / chunk))))
    preceding = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.withColumn("_before", F.coalesce(F.sum(F.ceil(F.col("_all") / F.col("_width"))).over(preceding), F.lit(0)))
    part = F.floor(F.col("_place") / F.col("_width"))
    rows = rows.join(F.broadcast(ranges), "_range").withColumns({
        "_chunk": (F.col("_before") + part).cast("int"), "_step": F.col("_place") - part * F.col("_width"),
        "_n": F.least(F.col("_width"), F.col("_all") - part * F.col("_width")), "_lead": F.lit(False), "_state": F.lit(None).cast("binary"),
    })

    # the frames before a chunk: the last ones of the chunk before it, if that ends with the same key
    columns = [*FRAME, "_row", "_chunk", "_lead", "_step", "_state"]
    before = rows.where(F.col("_step") >= F.col("_n") - lead)
    before = before.withColumns({"_chunk": F.col("_chunk") + 1, "_lead": F.lit(True), "_step": F.col("_step") - F.col("_n")}).select(columns)
    rows = rows.select(columns)
    here = rows.select(*KEY, "_chunk").distinct()
    before = before.alias("b").join(F.broadcast(here.alias("h")), reduce(and_, [F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*KEY, "_chunk")]), "left_semi")
    tasks = min(many, slots * -(-many // (slots * LANES)))

    kinds = f"{SCHEMA}, _chunk int, _exact boolean, {_CHUNK}"
    run = _run_chunks(settings, to_arrow_schema(StructType.fromDDL(kinds)))

    def ran(dealt: DataFrame, name: str) -> DataFrame:
        dealt = dealt.repartitionById(tasks, F.col("_chunk") % tasks).sortWithinPartitions("_step", "_chunk", *KEY)
        return kept(dealt.mapInArrow(run, kinds), name)

    made = ran(rows.unionByName(before), "made-0")
    told, chunks = made.where("end_digest IS NULL"), made.where("end_digest IS NOT NULL")
    for k in range(1, rounds + 2):
        w = Window.partitionBy(*KEY).orderBy("_chunk")
        joined = chunks.withColumns({"_end": F.lag("end_digest").over(w), "_state": F.lag("end_state").over(w)})
        wrong = joined.where("_end <> begin_digest").select(*KEY, "_chunk", "_state")
        if wrong.isEmpty():
            break
        if k > rounds:  # all from the first one on, as one chunk
            wrong = wrong.groupBy(*KEY).agg(F.min_by("_state", "_chunk").alias("_state"), F.min("_chunk").alias("_chunk"))
        wrong = kept(wrong, f"wrong-{k}")
        on = lambda a, b: reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in KEY])
        of = F.col("r._chunk") == F.col("w._chunk") if k <= rounds else F.col("r._chunk") >= F.col("w._chunk")
        names = wrong.select(*KEY, "_chunk").alias("w")
        step = F.col("r._step" if k <= rounds else "r._row").alias("_step")
        again = rows.alias("r").join(F.broadcast(names), on("r", "w") & of).select(*[F.col(f"r.{c}") for c in rows.columns if c not in ("_chunk", "_step")], F.col("w._chunk"), step)
        heads = wrong.withColumns({"_lead": F.lit(False), "_step": F.lit(-1).cast("long")})
        made = ran(again.unionByName(heads, allowMissingColumns=True), f"made-{k}")
        stays = lambda x: x.alias("r").join(F.broadcast(names), on("r", "w") & of, "left_anti")  # noqa: E731, B023
        told = stays(told).unionByName(made.where("end_digest IS NULL"))
        chunks = stays(chunks).unionByName(made.where("end_digest IS NOT NULL"))

    named = _named(chunks).alias("n")
    same = reduce(and_, [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*KEY, "_chunk")])
    found = told.alias("t").join(named, same)
    begun = lambda i: F.when(i < F.col("n.begin_next"), F.element_at("n.names", i.cast("long"))).otherwise(i + F.col("n.shift"))
    own = lambda o: o.withField("track_id", F.when(F.col("t._exact") | (o["track_id"] < 0), o["track_id"]).otherwise(begun(o["track_id"])).cast("int"))
    return found.select(*[f"t.{c}" for c in FRAME[:3]], F.transform("t.objects", own).alias("objects"), *[f"t.{c}" for c in STATS])


def tracker_totals(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """The counters' sums."""
    return tracked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in STATS])
