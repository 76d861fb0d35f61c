import numpy as np
import pytest

from vigilake.operators import tracking
from vigilake.operators.tracking import Settings, Tracker


def least_total(cost, limit, row=0, used=frozenset()):
    """The best total of cost - limit over all ways to pair rows with columns."""
    if row == len(cost):
        return 0.0
    return min([least_total(cost, limit, row + 1, used)] + [
        cost[row][c] - limit + least_total(cost, limit, row + 1, used | {c}) for c in range(len(cost[0])) if c not in used
    ])


def test_assignment_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cost = rng.random((rng.integers(1, 5), rng.integers(1, 6)))
        pairs = tracking.assign(cost, 0.6)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        assert sum(cost[r, c] - 0.6 for r, c in pairs) == pytest.approx(least_total(cost.tolist(), 0.6))
    assert tracking.assign(np.zeros((0, 3)), 0.5) == []


def test_filter_matches_the_one_dimensional_form():
    """Without a warp every number and its speed form a filter of their own."""
    boxes = np.array([[10, 20, 50, 100]], np.float32)
    tracks = tracking.begun(boxes, np.zeros((1, 4), np.int64))
    x, p = np.array([30.0, 0.0]), np.diag([(2 * 40 / 20) ** 2, (10 * 40 / 160) ** 2])
    for moved in (3, 7, 6):
        boxes = boxes + np.float32([moved, 0, moved, 0])
        tracks = tracking.corrected(tracking.predicted(tracks), boxes)
        move = np.array([[1, 1], [0, 1]])
        x, p = move @ x, move @ p @ move.T + np.diag([(40 / 20) ** 2, (40 / 160) ** 2])
        gain = p[:, 0] / (p[0, 0] + (40 / 20) ** 2)
        x, p = x + gain * (float(boxes[0, 0] + boxes[0, 2]) / 2 - x[0]), p - np.outer(gain, p[0])
    assert tracks.mean[0, [0, 4]] == pytest.approx(x, rel=1e-3)


def test_warp_and_its_coordinates():
    tracks = tracking.begun(np.array([[0, 0, 10, 20]], np.float32), np.zeros((1, 4), np.int64))
    turned = tracking.warped(tracks, [0, 1, 5, 1, 0, 7])  # swaps the axes and moves
    assert turned.mean[0, :4].tolist() == [15, 12, 20, 10]
    assert np.allclose(np.diag(turned.cov[0])[[0, 1]], np.diag(tracks.cov[0])[[1, 0]])
    assert tracking.warped(tracks, None) is tracks


def one(x, score=0.95):
    return [[x, 50, x + 60, 150]], [score], [0]


def test_lifecycle():
    none = ([], [], [])
    t = Tracker(Settings(buffer=2))
    seen = [t.update(*f) for f in (one(100), one(104), none, one(112))]
    assert [(list(s[0]), list(s[1])) for s in seen] == [([1], [0]), ([1], [1]), ([], []), ([1], [1])]
    assert seen[2][3][-2:] == (1, 0)  # lost, not removed
    for _ in range(2):
        last = t.update(*none)
    assert last[3][-1] == 0 and t.update(*none)[3][-1] == 1 and len(t.lost) == 0

    t = Tracker()
    t.update(*one(100))
    both = lambda a, b: (one(a)[0] + one(b)[0], [0.9, 0.9], [0, 0])
    assert [list(x) for x in t.update(*both(101, 400))[:2]] == [[1, 2], [1, 0]]  # a later track waits for a second look
    assert [list(x) for x in t.update(*both(102, 402))[:2]] == [[1, 2], [1, 1]]
    assert list(t.update(*both(103, 800))[0]) == [1, 3] and t.update(*one(104))[3][-1] == 1  # which the third never gets

    t = Tracker()
    t.update(*one(100))
    low = t.update(*one(101, 0.3))
    assert list(low[0]) == [1] and bool(low[2][0]) and low[3][5] == 1  # by the second round
    assert list(t.update(*one(300, 0.65))[0]) == [-1]  # too weak to open a track


def test_frames_in_order_and_new_geometry(spark):
    schema = (
        "source_id string, generation bigint, pts_ns bigint, width int, height int, "
        "detections array<struct<class_id:int,confidence:double,x1:double,y1:double,x2:double,y2:double>>, warp array<double>"
    )
    box = lambda x: [(0, 0.9, x, 0.1, x + 0.2, 0.5)]
    rows = [("a", 1, k, 640 if k < 4 else 320, 360, box(0.1 + 0.01 * k), None) for k in (3, 1, 0, 2, 5, 4)] + [("b", 1, 0, 640, 360, [], None), ("b", 2, 0, 640, 360, None, None)]
    got = tracking.track(spark.createDataFrame(rows, schema)).orderBy("source_id", "generation", "pts_ns").collect()
    assert [[(o.track_id, o.track_state) for o in r.objects] for r in got] == [[(1, 0)], [(1, 1)], [(1, 1)], [(1, 1)], [(1, 0)], [(1, 1)], [], []]
    assert tracking.track(spark.createDataFrame([], schema)).count() == 0
