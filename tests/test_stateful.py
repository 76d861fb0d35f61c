"""Operators with state over micro-batches against their batch forms, over several dealings and a restart."""

import math
import random

import pytest

from vigilake.operators import cooldown, motion, timeline, tracking
from vigilake.streaming import stateful

DETECTION = "struct<class_id:int,confidence:double,x1:double,y1:double,x2:double,y2:double>"
FRAME = f"source_id string, generation bigint, pts_ns bigint, width int, height int, detections array<{DETECTION}>, warp array<double>"
EPOCH_MS = 1_700_000_000_000


@pytest.fixture(scope="module")
def store(spark):
    spark.conf.set(*stateful.STORE)
    yield spark
    spark.conf.unset(stateful.STORE[0])


def streamed(spark, tmp_path, schema, parts, build, name, restart=False):
    """The rows of a stream over `parts`, each one micro-batch; with `restart` the query is started anew for each."""
    folder, check = tmp_path / f"{name}-in", tmp_path / f"{name}-check"
    folder.mkdir()
    out = tmp_path / f"{name}-out"

    def run():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        query = build(rows).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(check))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for k, part in enumerate(parts):
        staged = tmp_path / f"{name}-{k}"
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(staged))
        next(staged.glob("part-*")).rename(folder / f"{k:04}.json")
        if restart:
            run()
    if not restart:
        run()
    return spark.read.schema(build(spark.readStream.schema(schema).json(str(folder))).schema).json(str(out))


def cut(rows, sizes):
    rows, out = list(rows), []
    for n in sizes:
        out.append(rows[:n])
        rows = rows[n:]
    return [p for p in [*out, rows] if p]


def scene(seed, frames=60):
    rng = random.Random(seed)
    rows = []
    for source in "ab":
        walkers = [[rng.random() * 0.8, rng.random() * 0.8, (rng.random() - 0.5) / 40, (rng.random() - 0.5) / 40] for _ in range(5)]
        for k in range(frames):
            found = []
            for n, w in enumerate(walkers):
                w[0], w[1] = w[0] + w[2], w[1] + w[3]
                if rng.random() < 0.85:
                    found.append((n % 2, round(rng.choice([0.95, 0.8, 0.65, 0.3]), 2), w[0], w[1], w[0] + 0.1, w[1] + 0.15))
            warp = [1.0, 0.0, 1.0, 0.0, 1.0, -1.0] if k % 13 == 5 else None
            rows.append((source, 1, k * 33_000_000 + 10**18, 640 if k < 45 else 320, 360, found or None, warp))
    return sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize("restart, sizes", [(False, [120]), (True, [1, 39, 7])])
def test_tracker_stream_matches_batch(store, tmp_path, restart, sizes):
    rows = scene(4)
    batch = sorted(map(str, tracking.track(store.createDataFrame(rows, FRAME)).collect()))
    shuffled = [random.Random(1).sample(part, len(part)) for part in cut(rows, sizes)]
    got = streamed(store, tmp_path, FRAME, shuffled, stateful.track_stream, "track", restart)
    assert sorted(map(str, got.collect())) == batch and len(batch) == 120
    ids = {o.track_id for r in got.collect() for o in r.objects}
    assert len(ids) > 6


def test_late_frames_change_nothing(store, tmp_path):
    rows = [r for r in scene(5, 20) if r[0] == "a"]
    late = rows[3]
    whole = streamed(store, tmp_path, FRAME, [rows[:3] + rows[4:10], rows[10:]], stateful.track_stream, "whole").collect()
    again = streamed(store, tmp_path, FRAME, [rows[:3] + rows[4:10], [late], rows[10:]], stateful.track_stream, "late").collect()
    more = [r for r in again if r.pts_ns == late[2]]
    assert sorted(map(str, whole)) == sorted(str(r) for r in again if r.pts_ns != late[2])
    assert len(more) == 1 and {o.track_id for o in more[0].objects} == {-1} and len(more[0].objects) == len(late[5])


PUB = "source_id string, frame_id bigint, now_ms bigint, objects array<struct<track_id:int,track_state:int>>"


@pytest.mark.parametrize("restart, sizes", [(False, [400]), (True, [13, 150])])
def test_publisher_stream_matches_batch(store, tmp_path, restart, sizes):
    rng = random.Random(2)
    rows, now = [], EPOCH_MS
    for k in range(400):
        now += rng.choice([0, 40, 200, 900, 4_000])
        objects = [(rng.randrange(-1, 6), rng.choice([0, 2] if rng.random() < 0.03 else [1])) for _ in range(rng.choice([0, 1, 1, 1, 2, 2]))]
        rows.append((rng.choice("xy"), k, now, objects or rng.choice([[], None])))
    frames = store.createDataFrame(rows, PUB)
    want = {r.frame_id: r.published for r in cooldown.publisher_cooldown(frames, 9_000).collect()}
    got = streamed(store, tmp_path, PUB, cut(rows, sizes), lambda s: stateful.publisher_stream(s, 9_000), "pub", restart).collect()
    assert {r.frame_id: r.published for r in got} == want and len(got) == 400 and 50 < sum(want.values()) < 350


def test_publisher_state_stays_small(store, tmp_path):
    """Of ten thousand tracks only those of the last cooldown are held."""
    rows = [("x", k, EPOCH_MS + 10 * k, [(k, 1)]) for k in range(10_000)]
    streamed(store, tmp_path, PUB, cut(rows, [4_000, 4_000]), lambda s: stateful.publisher_stream(s, 1_000), "small")
    state = store.read.format("statestore").option("path", str(tmp_path / "small-check")).option("stateVarName", "stamps").load()
    assert 0 < state.count() <= 100


SEEN = "source_id string, seq bigint, pts_ns bigint, generation bigint, discont boolean"


def arrivals(seed):
    rng = random.Random(seed)
    out = []
    for k in range(300):
        pts = None if rng.random() < 0.1 else 10**18 + (k - rng.choice([0, 0, 0, 1, 5])) * 40 + rng.choice([0, 0, 40])
        out.append((rng.choice("pq"), k, pts, k // 90, rng.random() < 0.05 or None))
    return out


@pytest.mark.parametrize("restart, sizes", [(False, [300]), (True, [1, 120])])
def test_guard_and_generations_match_batch(store, tmp_path, restart, sizes):
    rows = arrivals(3)
    frames = store.createDataFrame(rows, SEEN)
    for name, build, column, want in (
        ("guard", stateful.guard_stream, "outcome", timeline.guard(frames)),
        ("generations", stateful.generation_stream, "generation", timeline.generations(frames.drop("generation"))),
    ):
        got = streamed(store, tmp_path, SEEN, cut(rows, sizes), build, name, restart)
        assert {r.seq: r[column] for r in got.collect()} == {r.seq: r[column] for r in want.collect()}
        assert got.select(column).distinct().count() > 2


SIDES = "side string, key string, at bigint, id bigint"


@pytest.mark.parametrize("restart", [False, True])
def test_asof_stream_matches_batch(store, tmp_path, restart):
    rng = random.Random(8)
    rows = [(rng.choice(["l", "r"]), rng.choice("uv"), (EPOCH_MS + 50 * k) * 1000 + rng.choice([-120_000, 0, 90_000, 1]), k) for k in range(200)]
    end = [("l", key, (EPOCH_MS + 10**7) * 1000, -1) for key in "uv"]

    def sides(frame):
        left = frame.where("side = 'l'").select("key", "at", F.col("id").alias("lid"))
        return left, frame.where("side = 'r'").select("key", "at", F.col("id").alias("rid"))

    from pyspark.sql import functions as F

    build = lambda s: stateful.asof_stream(*sides(s), ["key"], "at", 150_000, delay="1 seconds")
    got = streamed(store, tmp_path, SIDES, [*cut(rows, [70, 1, 60]), end], build, "asof", restart).collect()
    want = timeline.asof_within(*sides(store.createDataFrame(rows, SIDES)), ["key"], "at", 150_000).collect()
    assert {r.lid: r.found and r.found.rid for r in got if r.lid >= 0} == {r.lid: r.found and r.found.rid for r in want}
    assert len({r.found is None for r in want}) == 2


OBJECT = "struct<class_name:string,class_id:int,x1:double,y1:double,x2:double,y2:double,track_id:int,track_state:int>"
SHOW = f"side string, source_id string, generation bigint, pts_ns bigint, objects array<{OBJECT}>"


@pytest.mark.parametrize("restart", [False, True])
def test_predict_stream_matches_batch(store, tmp_path, restart):
    rng, ms = random.Random(6), 1_000_000
    rows = []
    for k in range(80):
        at = (EPOCH_MS + 90 * k + (500 if k > 40 else 0)) * ms + rng.randrange(1000)
        objects = []
        for t in range(-1, 5):
            if rng.random() < 0.9:
                x, y = 0.1 * t + 0.004 * k, 0.3 + 0.1 * math.sin(k / 9)
                objects.append(("a" if t != 3 or k < 30 else "b", 0, x, y, x + 0.1, y + rng.choice([0.1, 0.1, 0.0]), t, rng.choice([0, 1, 1, 1, 2])))
        rows.append(("f", rng.choice(["c", "d"]), 1, at, objects))
        rows += [("d", s, 1, at + d * ms, None) for s in "cd" for d in (0, 33, 66)]
    end = [("d", s, 1, (EPOCH_MS + 10**6) * ms, None) for s in "cd"]
    sides = lambda f: (f.where("side = 'f'").drop("side"), f.where("side = 'd'").drop("side", "objects"))
    got = streamed(store, tmp_path, SHOW, [*cut(rows, [90, 3, 130]), end], lambda s: stateful.predict_stream(*sides(s)), "show", restart)
    want = motion.predict(*sides(store.createDataFrame(rows, SHOW)))
    key = lambda r: (r.source_id, r.display_ns, r.track_id, r.class_name, r.predicted, r.clipped, *[round(r[c], 9) for c in ("x1", "y1", "x2", "y2")])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and want.where("predicted").count() > 100
