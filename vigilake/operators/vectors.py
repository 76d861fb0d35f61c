"""Vector search: exact by blocks of queries against chunks of points, and approximate by inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points of a chunk, and queries of a block.
CHUNK, BLOCK = 4_096, 256
#: Bytes of query vectors that are broadcast at most; more are joined to the chunks by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Found rows that a task holds over all blocks before it hands them on.
HELD_ROWS = 2_000_000
#: Points of a list that meet in one task, and points that the lists' centres are fitted on at most.
PART_POINTS, SAMPLE_POINTS = 16_384, 50_000
#: Digits to which scores are compared: beyond these the order of additions shows.
DIGITS = 12


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column and whether each is one; a null or zero vector, or one with nulls, isn't."""
    rows = column.to_pylist()
    size = max((len(r) for r in rows if r is not None), default=0)
    ok = np.array([r is not None and len(r) == size and None not in r for r in rows], bool)
    out = np.zeros((len(rows), size))
    if ok.any():
        out[ok] = np.array([r for r, o in zip(rows, ok, strict=True) if o], np.float64)
    norms = np.sqrt((out * out).sum(axis=1))
    ok &= norms > 0
    out[ok] /= norms[ok, None]
    return out, ok


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest scores of each row; ties go to the lower `order`."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = np.nonzero(np.ones(scores.shape, bool))
    by = np.lexsort((order[column], -scores[row, column], row))
    row, column = row[by], column[by]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def _places(ids: pa.Array) -> np.ndarray:
    """Each id's place in the order of ids."""
    out = np.empty(len(ids), np.int64)
    out[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def _kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def _scored(points: tuple, asked: pa.Array, asks: np.ndarray, fit: np.ndarray, k: int) -> pa.Table:
    """The k best of `points` (ids, unit vectors, whether each is one; and the ids' order) for each query, as (query_id,
    event_id, score). A query or point without a direction has no score."""
    (ids, x, good), places = points
    scores = np.round(asks @ x.T, DIGITS) if asks.shape[1] == x.shape[1] else np.full((len(asks), len(x)), -np.inf)
    scores[:, ~good] = -np.inf
    scores[~fit] = -np.inf
    row, column = _best(scores, places, k)
    found = scores[row, column]
    return pa.table({
        "query_id": asked.take(pa.array(row)), "event_id": ids.take(pa.array(column)),
        "score": pa.array(found, mask=np.isinf(found)),
    })


def _cut(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query."""
    score = found["score"].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
    query = pa.compute.rank(found["query_id"].combine_chunks(), tiebreaker="dense").to_numpy()
    order = np.lexsort((_places(found["event_id"].combine_chunks()), -score, query))
    ranked = query[order]
    nth = np.arange(len(order)) - np.searchsorted(ranked, ranked)
    return found.take(pa.array(order[nth < k]))


def _blocks_of(queries: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(b, asked, asks) rows of about `block` queries each, and their bytes."""
    many = queries.count()
    size = queries.select(F.max(F.size("query"))).first()[0] or 0
    b = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-many // block))))
    rows = queries.groupBy(b.alias("b")).agg(F.collect_list(F.struct("query_id", "query")).alias("rows"))
    return rows.select("b", F.col("rows.query_id").alias("asked"), F.col("rows.query").alias("asks")), many * max(0, size) * 8


def block_top_k(points: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, event_id, the points' other columns but the vector, score, rank): for each of `queries` (query_id,
    query) the k points most alike by cosine, ties to the lower event_id.

    Points go in chunks and queries in blocks; each pair of these is one matrix product, from which k rows a query leave.
    A task keeps k rows for each query over all its chunks. Event ids are unique; vectors without a direction, or of
    another length, have a null score and come last.
    """
    kind, asked_kind = _kind(points, "event_id"), _kind(queries, "query_id")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                lists = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1))
                yield pa.RecordBatch.from_arrays([ids, lists], names=["ids", "vectors"])

    made = points.select("event_id", F.col("vector").cast("array<double>").alias("vector"))
    chunks = made.mapInArrow(chunked, f"ids array<{kind}>, vectors array<array<double>>")
    blocks, size = _blocks_of(queries.select("query_id", F.col("query").cast("array<double>").alias("query")), block)
    met = chunks.crossJoin(F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks)  # rows are chunks and blocks

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = {}, 0, None
        for batch in batches:
            for n in range(batch.num_rows):
                ids, vectors, b, asked, asks = (batch.column(c)[n] for c in range(5))
                if last is None or last[0] is not ids and not last[0].equals(ids):
                    x, good = _matrix(vectors.values)
                    last = (ids, (ids.values, x, good), _places(ids.values))
                y, fit = _matrix(asks.values)
                found = _scored((last[1], last[2]), asked.values, y, fit, k)
                b = b.as_py()
                before = held.get(b)
                held[b] = found if before is None else _cut(pa.concat_tables([before, found]), k)
                rows += len(held[b]) - (0 if before is None else len(before))
            if rows > HELD_ROWS:
                for table in held.values():
                    yield from table.to_batches()
                held, rows = {}, 0
        for table in held.values():
            yield from table.to_batches()

    found = met.mapInArrow(scored, f"query_id {asked_kind}, event_id {kind}, score double")
    return _ranked(found, points, k)


def _ranked(found: DataFrame, points: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "event_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    others = [c for c in points.columns if c not in ("event_id", "vector")]
    if others:
        top = top.join(points.select("event_id", *others), "event_id")
    return top.select("query_id", "event_id", *others, "score", "rank")


# ---------------------------------------------------------------- inverted lists


def fit_lists(points: DataFrame, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centres of `lists` lists, by spherical k-means over at most SAMPLE_POINTS points, those of the lowest hash
    of their id. The sample decides which list a point is in, never whether it is in the index."""
    sample = points.select(F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("event_id", F.lit(seed))).limit(SAMPLE_POINTS)
    x, ok = _matrix(pa.array([r[0] for r in sample.collect()]))
    x = x[ok]
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else np.zeros((0, 0))
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1) if len(centres) else np.zeros(0, int)
        for c in range(len(centres)):
            mean = x[own == c].sum(axis=0)
            size = np.sqrt((mean * mean).sum())
            if size > 0:
                centres[c] = mean / size
    return centres


def index_lists(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every point as (list, part, event_id, vector): the list of its nearest centre, -1 for a vector without a
    direction, and a part of the list, by hash, so that no list meets in one task."""
    kind = _kind(points, "event_id")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _matrix(batch.column(1))
            own = np.full(len(x), -1)
            if len(centres) and x.shape[1] == centres.shape[1]:
                own = np.where(ok, (x @ centres.T).argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), batch.column(1)], names=["list", "event_id", "vector"])

    made = points.select("event_id", F.col("vector").cast("array<double>").alias("vector"))
    return made.mapInArrow(assigned, f"list int, event_id {kind}, vector array<double>")


def probes(queries: DataFrame, centres: np.ndarray, probe: int) -> DataFrame:
    """(query_id, query, list) of the `probe` lists whose centres are most alike to each query, and the list -1."""
    kind = _kind(queries, "query_id")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, _ = _matrix(batch.column(1))
            wanted = np.argsort(-(y @ centres.T), axis=1, kind="stable")[:, :probe] if len(centres) and y.shape[1] == centres.shape[1] else np.zeros((len(y), 0), int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[*w, -1] for w in wanted.tolist()], pa.list_(pa.int32()))], names=["query_id", "query", "lists"]
            )

    made = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    made = made.mapInArrow(nearest, f"query_id {kind}, query array<double>, lists array<int>")
    return made.select("query_id", "query", F.explode("lists").alias("list"))


def list_top_k(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probe: int) -> DataFrame:
    """(query_id, event_id, score, rank) of the k most alike points in each query's `probe` lists, scored exactly.

    Lists of over PART_POINTS points are dealt out in parts by hash, and each of their queries goes to all parts. A task
    gets a part's points, then its queries, and gives k rows for each of these.
    """
    kind, asked_kind = _kind(index, "event_id"), _kind(queries, "query_id")
    parts = index.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PART_POINTS)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int")
    held = index.join(F.broadcast(parts), "list").select("list", part.alias("part"), F.lit(0).alias("side"), "event_id", "vector")  # a row a list
    asked = probes(queries, centres, probe).join(F.broadcast(parts), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "query_id", F.col("query").alias("vector"))
    both = held.unionByName(asked, allowMissingColumns=True).select("list", "part", "side", "event_id", "query_id", "vector")
    both = both.repartition("list", "part").sortWithinPartitions("list", "part", "side")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                rows, key = batch.slice(lo, hi - lo), tuple(keys[lo, :2])
                if key != at:
                    at, points, ready = key, [], None
                if keys[lo, 2] == 0:
                    points.append(rows.select(["event_id", "vector"]))
                    ready = None
                    continue
                if not points:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(points).combine_chunks()
                    ids = table["event_id"].combine_chunks()
                    ready = ((ids, *_matrix(table["vector"].combine_chunks())), _places(ids))
                for first in range(0, rows.num_rows, BLOCK):
                    some = rows.slice(first, BLOCK)
                    y, fit = _matrix(some.column("vector"))
                    yield from _scored(ready, some.column("query_id"), y, fit, k).to_batches()

    found = both.mapInArrow(searched, f"query_id {asked_kind}, event_id {kind}, score double")
    return _ranked(found, index.select("event_id"), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows (query_id, event_id) of `exact` that `found` has."""
    hit = exact.select("query_id", "event_id").join(found.select("query_id", "event_id", F.lit(1).alias("hit")), ["query_id", "event_id"], "left")
    return hit.agg(F.count("hit") / F.greatest(F.count("*"), F.lit(1))).first()[0]
