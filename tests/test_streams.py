import pytest

from vigilake.operators import cooldown, motion, stats, timeline

TRACKS = "event_id string, ingress_id string, source string, track_id int, timestamp_ms bigint"


def runs(spark, rows, ms=30_000):
    return {r.event_id: r.decision for r in cooldown.consumer_cooldown(spark.createDataFrame(rows, TRACKS), ms).collect()}


def test_consumer_cooldown(spark):
    rows = [
        ("a", "1", "c", 1, 0), ("b", "2", "c", 1, 10_000), ("c", "3", "c", 1, 20_000), ("c", "3", "c", 2, 20_000),
        ("d", "4", "c", None, 21_000), ("e", "5", "c", 1, 30_000), ("f", "6", "c", 1, 59_999),
    ]
    assert runs(spark, rows) == {"a": "RUN", "b": "SKIP", "c": "RUN", "d": "RUN", "e": "RUN", "f": "SKIP"}


def test_redelivery_runs_again(spark):
    assert runs(spark, [("a", "1", "c", 1, 0), ("a", "1", "c", 1, 5_000)]) == {"a": "RUN"}


PUB = "source_id string, frame_id bigint, now_ms bigint, objects array<struct<track_id:int,track_state:int>>"


def published(spark, rows, ms):
    frames = spark.createDataFrame([("c", k, now, objects) for k, (now, objects) in enumerate(rows)], PUB)
    return [r.published for r in cooldown.publisher_cooldown(frames, ms).orderBy("frame_id").collect()]


def test_publisher_cooldown(spark):
    rows = [
        (1000, [(1, 1)]), (2000, [(1, 1)]), (31000, [(1, 1)]), (32000, [(2, 0)]), (33000, [(1, 1), (3, 0)]), (34000, [(-1, 0)]), (35000, [(-1, 0)]),
    ]
    assert published(spark, rows, 30_000) == [True, False, True, True, True, True, False]
    assert published(spark, [(36000, [(1, 1)]), (37000, [(1, 1)])], 0) == [True, True]
    assert published(spark, [(1000, [(1, 1)]), (2000, [(1, 2)]), (3000, [(2, 3)])], 30_000) == [True] * 3


def test_guard(spark):
    s = 1_000_000_000
    rows = [(0, "a", None, 1), (1, "b", s, 1), (2, "a", s, 2), (3, "a", s, 1), (4, "a", s, 1), (5, "a", s // 2, 1)]
    frames = spark.createDataFrame(rows, "seq int, source_id string, pts_ns bigint, generation bigint")
    got = [r.outcome for r in timeline.guard(frames, generation=1, source="a").orderBy("seq").collect()]
    assert got == ["no_pts", "wrong_source", "wrong_generation", "published", "duplicate_pts", "stale_pts"]


def test_generations(spark):
    rows = [(1, 2, False), (2, 2, False), (3, 20, False), (4, 1, False), (5, 2, True), (6, 3, False)]
    frames = spark.createDataFrame([("a", *r) for r in rows], "source_id string, seq int, pts_ns bigint, discont boolean")
    assert [r.generation for r in timeline.generations(frames).orderBy("seq").collect()] == [1, 1, 1, 2, 3, 3]


def test_history(spark):
    rows = [("a", 1, k * 10_000_000) for k in range(70)]
    frames = spark.createDataFrame(rows, "source_id string, generation bigint, pts_ns bigint")
    got = [r.depth for r in timeline.history_depth(frames).orderBy("pts_ns").collect()]
    assert got[-1] == 64 and got[:3] == [1, 2, 3]


def test_asof_agrees_with_a_scan(spark):
    left = [(k % 3, (k * 37) % 1000, k) for k in range(200)]
    right = [(k % 3, (k * 53) % 1000, k) for k in range(100)]
    l = spark.createDataFrame(left, "key int, at bigint, lid int")  # noqa: E741
    r = spark.createDataFrame(right, "key int, at bigint, rid int")

    def scan(key, at, horizon):
        found = [(t, i) for k, t, i in right if k == key and at - horizon <= t <= at]
        return max(found)[1] if found else None

    got = {x.lid: x.found.rid if x.found else None for x in timeline.asof_within(l, r, ["key"], "at", 60).collect()}
    assert got == {i: scan(k, t, 60) for k, t, i in left}
    got = {x.lid: x.found.rid if x.found else None for x in timeline.asof(l, r, ["key"], "at", 100).collect()}
    assert got == {i: scan(k, t, 10**9) for k, t, i in left}


def test_window_summary(spark):
    import random

    rng, s = random.Random(3), 1_000_000
    at = sorted(rng.sample(range(10 * s, 14 * s), 25))
    rows = [(t, *[rng.randrange(1000) for _ in range(5)]) for t in at]
    schema = "completed_at_us bigint, queue_us bigint, device_us bigint, output_copy_us bigint, postprocess_us bigint, total_us bigint"
    r = stats.summarize(spark.createDataFrame(rows, schema), 10 * s, 14 * s, 9 * s, 30, 5).first()
    edges = [9 * s, *at, 14 * s]
    assert r.completed_fps == 25 / 4 and r.longest_gap_us == max(b - a for a, b in zip(edges, edges[1:], strict=False))
    for k, name in enumerate(("queue", "device", "output_copy", "postprocess", "total"), 1):
        values = sorted(x[k] for x in rows)
        for p in (50, 95):
            assert r[f"{name}_p{p}"] == values[-(-25 * p // 100) - 1]


FRAME = (
    "source_id string, generation bigint, pts_ns bigint, objects array<struct<class_name:string,class_id:int,x1:double,"
    "y1:double,x2:double,y2:double,track_id:int,track_state:int>>"
)
MS = 1_000_000


def shown(spark, seen, at_ms, **options):
    """Boxes of one track seen with its centre at x, at times in ms."""
    rows = [("a", 1, t * MS, [("p", 0, x - 0.05, 0.4, x + 0.05, 0.6, 1, 1)]) for t, x in seen]
    frames = spark.createDataFrame(rows, FRAME)
    displays = spark.createDataFrame([("a", 1, at_ms * MS)], "source_id string, generation bigint, pts_ns bigint")
    return motion.predict(frames, displays, **options).collect()


def filtered(seen, at_ms):
    """A centre by the matrix form of the filter, as a check on the operator's own."""
    import numpy as np

    (t0, x0), *more = seen
    state, cov = np.array([x0, 0.0]), np.diag([1e-4, 1.0])
    for t, x in more:
        dt = (t - t0) / 1e3
        move = np.array([[1, dt], [0, 1]])
        state, cov = move @ state, move @ cov @ move.T + 1e-4 * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
        gain = cov[:, 0] / (cov[0, 0] + 1e-4)
        state, cov = state + gain * (x - state[0]), cov - np.outer(gain, cov[0])
        t0 = t
    return state[0] + (at_ms - t0) / 1e3 * state[1]


def test_motion_matches_the_matrix_form(spark):
    seen = [(0, 0.30), (90, 0.33), (210, 0.35), (280, 0.41)]
    box = shown(spark, seen, 330)[0]
    assert (box.x1 + box.x2) / 2 == pytest.approx(filtered(seen, 330)) and box.predicted
    still = shown(spark, seen, 330, motion=False)[0]
    assert (still.x1 + still.x2) / 2 == pytest.approx(0.41) and not still.predicted
    one = shown(spark, seen[:1], 200)[0]
    assert (one.x1 + one.x2) / 2 == pytest.approx(0.30) and not one.predicted
    gap = [(0, 0.3), (100, 0.4), (420, 0.6)]
    again = shown(spark, gap, 500)[0]
    assert (again.x1 + again.x2) / 2 == pytest.approx(0.6) and not again.predicted
    assert not shown(spark, seen, 281 + 300)
    edge = [(0, 0.7), (150, 0.92)]
    cut = shown(spark, edge, 180)[0]
    assert cut.x2 == 1.0 and cut.clipped and not shown(spark, edge, 400)


def test_untracked_objects_and_long_runs(spark):
    import time

    objects = [("p", 0, 0.1, 0.1, 0.2, 0.2, -1, 0), ("p", 0, 0.3, 0.1, 0.4, 0.2, -1, 0), ("p", 0, 0.5, 0.1, 0.6, 0.2, 4, 1)]
    frames = spark.createDataFrame([("a", 1, 5, objects)], FRAME)
    displays = spark.createDataFrame([("a", 1, 5)], "source_id string, generation bigint, pts_ns bigint")
    assert sorted(r.track_id for r in motion.predict(frames, displays).collect()) == [-1, -1, 4]
    frames = spark.range(10_000).selectExpr(
        "'a' AS source_id", "1L AS generation", f"id * {30 * MS} AS pts_ns",
        "array(named_struct('class_name', 'p', 'class_id', 0, 'x1', 0.1D, 'y1', 0.1D, 'x2', 0.2D, 'y2', 0.2D, 'track_id', 1, 'track_state', 1)) AS objects",
    )
    began = time.perf_counter()
    assert motion.predict(frames, frames.select("source_id", "generation", "pts_ns")).count() == 10_000
    assert time.perf_counter() - began < 60


def test_slices_change_nothing(spark):
    rows = [(f"s{k % 2}", k, (k * 7919) % 50 if k % 9 else None, k % 11 == 0, k % 4 // 3) for k in range(200)]
    frames = spark.createDataFrame(rows, "source_id string, seq bigint, pts_ns bigint, discont boolean, generation int")
    for operator in (timeline.guard, lambda f, **o: timeline.generations(f.drop("generation"), **o)):
        one, many = (sorted(map(str, operator(frames, arrivals=n).select("seq", c).collect())) for n in (10**9, 7) for c in [operator(frames).columns[-1]])
        assert one == many
