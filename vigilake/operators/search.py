"""Hybrid search: attributes and vectors, fused, then checked against the cases as they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.ids import norm
from vigilake.operators.cases import EventQuery, event_cases, recheck, select_events, shown_confidence, shown_verdict

#: Candidates that the vector path contributes, and that a fused list holds.
CANDIDATES = 100


def _checked(k: int) -> int:
    if not 1 <= k <= CANDIDATES:
        raise ValueError(f"top_k is 1 to {CANDIDATES}")
    return k


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a constant vector, in double precision; null for vectors of length zero."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, wanted, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    size = norm(vector) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when(size > 0, dot / size)


def vector_top_k(points: DataFrame, query: list[float], k: int, where: dict | None = None) -> DataFrame:
    """The k points most alike, after equality conditions on their payload. Each task keeps k rows; no sort of all."""
    for field, value in (where or {}).items():
        points = points.where(F.col(field) == value)
    scored = points.withColumn("score", cosine(F.col("vector"), query)).drop("vector")
    return scored.orderBy(F.desc("score"), "event_id").limit(_checked(k))


def attribute_search(events: DataFrame, detections: DataFrame, query: EventQuery, k: int) -> DataFrame:
    """Events that meet the conditions, latest first, each with score 1."""
    found = select_events(events, detections, query).orderBy(F.desc("timestamp_ms"), "event_id").limit(_checked(k))
    return found.select("event_id", F.lit(1.0).alias("score"))


def fuse(attribute: DataFrame, embedded: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Both lists as one: found by both, half of each score; by one, that score; four decimals, best first."""
    a = attribute.select("event_id", F.col("score").alias("a"))
    b = embedded.select("event_id", F.col("score").alias("b"))
    both = a.join(b, "event_id", "full_outer")
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(0.5) * F.col("a") + F.lit(0.5) * F.col("b"))
    score = F.round(score.otherwise(F.coalesce("a", "b")).cast("double"), 4)
    tag = F.when(F.col("a").isNull(), "embed").when(F.col("b").isNull(), "attribute").otherwise("both")
    fused = both.select("event_id", score.alias("score"), tag.alias("matched_by"))
    return fused.orderBy(F.desc("score"), "event_id").limit(k)


def fuse_all(attribute: DataFrame, embedded: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """`fuse` for many questions at once: the list of `attribute` (at most CANDIDATES rows, broadcast) with each query's
    rows of `embedded` (query_id, event_id, score), as (query_id, event_id, score, matched_by, rank)."""
    a = attribute.orderBy(F.desc("score"), "event_id").limit(CANDIDATES).select("event_id", F.col("score").alias("a"))
    a = queries.select("query_id").distinct().crossJoin(F.broadcast(a))
    b = embedded.select("query_id", "event_id", F.col("score").alias("b"))
    both = a.unionByName(b, allowMissingColumns=True).groupBy("query_id", "event_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(0.5) * F.col("a") + F.lit(0.5) * F.col("b"))
    score = F.round(score.otherwise(F.coalesce("a", "b")).cast("double"), 4)
    tag = F.when(F.col("a").isNull(), "embed").when(F.col("b").isNull(), "attribute").otherwise("both")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "event_id")
    fused = both.select("query_id", "event_id", score.alias("score"), tag.alias("matched_by"))
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_events(
    events: DataFrame,
    detections: DataFrame,
    evidence: DataFrame,
    reviews: DataFrame,
    points: DataFrame,
    query: EventQuery,
    vector: list[float] | None,
    top_k: int = 10,
) -> DataFrame:
    """The attribute path takes top_k under the conditions, the vector path CANDIDATES without them; what they find is
    fused, joined to the cases, checked against the conditions again, and only then cut to top_k.

    Without a query vector the search is by attributes alone. Candidates are at most 200 rows, so they are broadcast to
    every side before its children are nested: the ledger is filtered where it is read, and only the candidates' rows
    are shuffled.
    """
    found = attribute_search(events, detections, query, top_k)
    if vector is None:
        fused = found.withColumn("matched_by", F.lit("attribute"))
    else:
        fused = fuse(found, vector_top_k(points, vector, CANDIDATES).select("event_id", "score"))
    fused = F.broadcast(fused)
    sides = [side.join(fused.select("event_id"), "event_id", "left_semi") for side in (events, detections, evidence, reviews)]
    hydrated = recheck(event_cases(*sides).join(fused, "event_id"), query)
    shown = hydrated.select(
        "event_id",
        "source",
        "timestamp_ms",
        "event_type",
        shown_verdict().alias("verdict"),
        shown_confidence().alias("confidence"),
        "score",
        "matched_by",
    )
    return shown.orderBy(F.desc("score"), F.desc("timestamp_ms"), "event_id").limit(_checked(top_k))
