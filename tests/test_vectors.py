"""Vector search against brute force: exact, with ties and odd vectors, and by inverted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.operators import vectors


def brute(points, queries, k):
    def score(a, b):
        if a is None or b is None or len(a) != len(b) or not np.any(a) or not np.any(b):
            return None
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)

    out = set()
    for q, v in queries:
        ranked = sorted(((score(p, v), i) for i, p in points), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        out |= {(q, i, s, n) for n, (s, i) in enumerate(ranked[:k], 1)}
    return out


def rows(found):
    return {(r.query_id, r.event_id, None if r.score is None else round(r.score, 9), r["rank"]) for r in found.collect()}


@pytest.mark.parametrize("block, limit", [(256, 1 << 30), (4, 0), (1, 1 << 30)])
def test_blocks_match_brute_force(spark, monkeypatch, block, limit):
    """Whatever the blocks, and whether queries are broadcast."""
    rng = np.random.default_rng(1)
    base = rng.integers(-3, 4, (40, 8)).astype(float)
    points = [(f"e{k:03}", base[k % 40].tolist() if k % 50 else None) for k in range(300)] + [("z", [0.0] * 8), ("y", base[0].tolist())]
    queries = [(k, base[k].tolist()) for k in range(11)] + [(90, None), (91, [0.0] * 8)]
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
    p = spark.createDataFrame([(i, v, "x") for i, v in points], "event_id string, vector array<double>, label string").repartition(5)
    q = spark.createDataFrame(queries, "query_id int, query array<double>")
    found = vectors.block_top_k(p, q, 12, block)
    assert rows(found) == brute(points, queries, 12) and {r.label for r in found.collect()} == {"x"}
    assert vectors.block_top_k(p.limit(0), q, 3).count() == vectors.block_top_k(p, q.limit(0), 3).count() == 0


def clustered(spark, n=6_000, groups=60):
    rng = np.random.default_rng(7)
    middles = rng.normal(0, 1, (groups, 32))
    made = middles[rng.integers(0, groups, n)] + rng.normal(0, 0.25, (n, 32))
    return spark.createDataFrame([(k, v) for k, v in enumerate(made.tolist())], "event_id int, vector array<double>").repartition(4)


def test_lists_find_nearly_all_and_read_few(spark, monkeypatch):
    points = clustered(spark).cache()
    queries = points.where("event_id % 50 = 0").select(F.col("event_id").alias("query_id"), F.col("vector").alias("query")).cache()
    centres = vectors.fit_lists(points, 64)
    index = vectors.index_lists(points, centres).cache()
    assert index.count() == 6_000 and index.select("event_id").distinct().count() == 6_000
    exact = vectors.block_top_k(points, queries, 10).cache()
    for parts in (16_384, 40):  # whole lists, and lists in parts
        monkeypatch.setattr(vectors, "PART_POINTS", parts)
        found = vectors.list_top_k(index, queries, centres, 10, 8).cache()
        assert vectors.recall(found, exact) >= 0.9
        scores = {(r.query_id, r.event_id): round(r.score, 9) for r in exact.collect()}
        assert all(scores.get((r.query_id, r.event_id), round(r.score, 9)) == round(r.score, 9) for r in found.collect())
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    read = sum(sizes.get(r["list"], 0) for r in vectors.probes(queries, centres, 8).collect())
    assert read < 0.2 * 6_000 * queries.count()
    all_lists = vectors.list_top_k(index, queries, centres, 10, 64)
    assert vectors.recall(all_lists, exact) == 1.0


def test_lists_of_odd_points(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, None])], "event_id int, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id int, query array<double>")
    centres = vectors.fit_lists(points, 2)
    index = vectors.index_lists(points, centres)
    assert {r.event_id: r["list"] == -1 for r in index.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    got = [(r.query_id, r.event_id, r.score is None) for r in vectors.list_top_k(index, queries, centres, 3, 1).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, False), (7, 2, True), (7, 3, True), (8, 2, True), (8, 3, True), (8, 5, True)]
    assert len(vectors.fit_lists(points.limit(0), 2)) == 0
