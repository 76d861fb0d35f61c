"""Centroid clustering by ball-tree filtering, exact in integers.

Vectors become integers once. Each task arranges its vectors in chunks of CHUNK rows as metric trees: a ball has its
range of rows, its centre, radius, count and componentwise sum. A round sends the centroids, a few rows whatever the
input's size, through every tree. Where the triangle inequality leaves one centroid for a ball, its count and sum go to
that centroid whole; otherwise its two halves are asked with the centroids that are left, and leaves compare exactly.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.storage import discard, written

#: Rows of a tree and of its leaves at most.
CHUNK, LEAF = 4_096, 128
#: Components beyond this magnitude are refused: the square of a distance has to fit a long.
LARGEST = 2**27
#: Up to this magnitude products add up exactly in doubles.
EXACT_IN_DOUBLES = 2**20
#: The radius is widened by this part, so that rounding never excludes a centroid.
MARGIN = 1e-9

TREE = "vec_ids binary, missing binary, vectors binary, lo binary, hi binary, sums binary, radii binary, children binary"


def build_tree(vectors: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of rows in which each ball is a range, and the balls: lo, hi, sums, radii and the first of two children
    (-1 for a leaf). A ball is halved at the median of its widest component; the children of a ball follow one another."""
    order = np.arange(len(vectors))
    lo, hi, sums, radii, children = [0], [len(vectors)], [], [], []
    at = 0
    while at < len(lo):
        rows = order[lo[at] : hi[at]]
        own = vectors[rows]
        total = own.sum(axis=0)
        sums.append(total)
        off = own - total / len(rows)
        radii.append(float(np.sqrt(np.einsum("ij,ij->i", off, off).max())))
        spread = own.max(axis=0) - own.min(axis=0)
        if len(rows) <= LEAF or not spread.any():
            children.append(-1)
        else:
            half = len(rows) // 2
            order[lo[at] : hi[at]] = rows[np.argpartition(own[:, int(spread.argmax())], half)]
            children.append(len(lo))
            lo += [lo[at], lo[at] + half]
            hi += [lo[at] + half, hi[at]]
        at += 1
    balls = {"lo": lo, "hi": hi, "sums": np.stack(sums), "radii": radii, "children": children}
    return order, {k: np.asarray(v, np.float64 if k == "radii" else np.int64) for k, v in balls.items()}


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The exact squared distance of each vector from each centroid, as longs."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_DOUBLES:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        out = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)
        return out.astype(np.int64)
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        off = vectors - c
        out[:, k] = np.einsum("ij,ij->i", off, off)
    return out


def assigned(vectors: np.ndarray, balls: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple]:
    """(lo, hi, clusters, ball) over ranges of rows that cover the tree: a whole ball with its one cluster, or a leaf
    with a cluster for each row and no ball. Ties go to the smaller number."""
    numbers = centroids.astype(np.float64)
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        at, left = todo.pop()
        lo, hi = int(balls["lo"][at]), int(balls["hi"][at])
        centre = balls["sums"][at] / (hi - lo)
        away = np.sqrt(((numbers[left] - centre) ** 2).sum(axis=1))
        reach = 2 * balls["radii"][at] + MARGIN * (1 + away.min() + balls["radii"][at] + np.abs(centre).max())
        left = left[away <= away.min() + reach]  # the others are farther from all of the ball's vectors than the nearest
        if len(left) == 1:
            yield lo, hi, int(left[0]), at
        elif balls["children"][at] < 0:
            yield lo, hi, left[squared_distances(vectors[lo:hi], centroids[left]).argmin(axis=1)], None
        else:
            child = int(balls["children"][at])
            todo += [(child, left), (child + 1, left)]


def _integers(size: int, scale: int):
    """The rows of valid vectors as chunks, each with its tree."""

    def tree_of(ids: list, vectors: np.ndarray) -> pa.RecordBatch:
        if np.abs(vectors).max(initial=0) > LARGEST:
            raise ValueError(f"a vector's component is beyond {LARGEST} / {scale}: distances would pass 64 bits")
        whole = vectors.astype(np.int64)
        order, balls = build_tree(whole)
        missing = np.array([i is None for i in ids], bool)[order]
        ids = np.array([i or 0 for i in ids], np.int64)[order]
        values = [ids, missing, whole[order].astype(np.int32), *[balls[k] for k in ("lo", "hi", "sums", "radii", "children")]]
        names = [part.split()[0] for part in TREE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            ids += batch.column(0).to_pylist()
            parts.append(np.floor(rows.astype(np.float64) * scale))
            while len(ids) >= CHUNK:
                held = np.concatenate(parts)
                yield tree_of(ids[:CHUNK], held[:CHUNK])
                ids, parts = ids[CHUNK:], [held[CHUNK:]]
        if ids:
            yield tree_of(ids, np.concatenate(parts))

    return run


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(ids, missing, vectors, balls) of each row of the forest."""
    for batch in batches:
        for row in range(batch.num_rows):
            raw = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
            balls = {k: np.frombuffer(raw[k], np.int64) for k in ("lo", "hi", "children")}
            balls |= {"radii": np.frombuffer(raw["radii"]), "sums": np.frombuffer(raw["sums"], np.int64).reshape(-1, size)}
            vectors = np.frombuffer(raw["vectors"], np.int32).astype(np.int64).reshape(-1, size)
            yield np.frombuffer(raw["vec_ids"], np.int64), np.frombuffer(raw["missing"], bool), vectors, balls


def _totals(centroids: np.ndarray):
    """One row a task and centroid: how many vectors it got, and their sum."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, [[0] * size for _ in range(k)]
        for _, _, vectors, balls in _trees(batches, size):
            n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
            for lo, hi, cluster, ball in assigned(vectors, balls, centroids):
                if ball is not None:
                    n[cluster] += hi - lo
                    total[cluster] += balls["sums"][ball]
                else:
                    n += np.bincount(cluster, minlength=k)
                    np.add.at(total, cluster, vectors[lo:hi])
            for c in np.flatnonzero(n):  # Python's integers, as a task may have any number of chunks
                counts[c] += int(n[c])
                sums[c] = list(map(operator.add, sums[c], total[c].tolist()))
        got = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(got, pa.int32()), "n": pa.array([counts[c] for c in got], pa.int64()),
             "total": pa.array([[str(x) for x in sums[c]] for c in got], pa.list_(pa.string()))}
        )

    return run


def _members(centroids: np.ndarray):
    """One row a vector: its id, its cluster and its squared distance from that centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, missing, vectors, balls in _trees(batches, centroids.shape[1]):
            cluster, distance = np.empty(len(ids), np.int32), np.empty(len(ids), np.int64)
            for lo, hi, own, _ in assigned(vectors, balls, centroids):
                cluster[lo:hi] = own
            for c in np.unique(cluster):
                distance[cluster == c] = squared_distances(vectors[cluster == c], centroids[[c]])[:, 0]
            yield pa.RecordBatch.from_pydict(
                {"vec_id": pa.array(ids, pa.int64(), mask=missing), "cluster": cluster, "distance": distance}
            )

    return run


def _valid(vector: Column, size: int) -> Column:
    """Whether there are `size` components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, finite), F.lit(False))


def cluster(
    rows: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per valid vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    A vector is valid with exactly `size` components, none null or non-finite; a component x becomes floor(scale x). The
    first centroids are the `k` vectors whose ids have the smallest SHA-256 of `<seed>:<id>`, in that order, vectors of
    one id in the order of their components. Each of `rounds` rounds assigns all vectors to the nearest centroid (the
    smaller number at ties) and moves each centroid that has any to the floor of their mean; one last round assigns.

    Fewer vectors than `k` make as many centroids; a centroid without vectors stays where it is, and repeated rows count
    each time. A vector with a null id belongs to a cluster but never begins one. No valid vector, or none with an id,
    and an empty table give no rows. Other columns aren't read. A component beyond LARGEST / `scale` is an error, as
    squared distances would pass 64 bits.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    kept = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("v")).where(_valid(F.col("v"), size))
    forest = written(kept.mapInArrow(_integers(size, scale), TREE), "forest")

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.where("vec_id IS NOT NULL").select(order.alias("order"), "v").orderBy("order", "v").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        discard(forest)
        return spark.createDataFrame([], out)
    centroids = np.floor(np.array([r["v"] for r in starts]) * scale).astype(np.int64)

    for _ in range(rounds):
        totals = forest.mapInArrow(_totals(centroids), "cluster int, n long, total array<string>")
        sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
        centroids = centroids.copy()
        for row in totals.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # at most k rows
            centroids[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]

    members = written(forest.mapInArrow(_members(centroids), "vec_id long, cluster int, distance long"), "members")
    discard(forest)
    inertia = {r["cluster"]: r["d"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}

    def of_cluster(values: dict[int, object], kind: str) -> Column:
        pairs = [F.lit(x) for c, value in values.items() for x in (c, value)]
        return F.element_at(F.create_map(*pairs), F.col("cluster")).cast(kind)

    sha = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in inertia}
    whole = reduce(operator.add, inertia.values(), 0)
    return members.select(
        "vec_id", "cluster", "distance", of_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"), of_cluster(sha, "string").alias("centroid_sha256"),
    )
