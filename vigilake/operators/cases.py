"""Event cases: listing, nesting, projections, review history and referential checks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The verdicts and evidence states of a review.
VERDICTS = ("compliant", "violation", "uncertain")
EVIDENCE_STATES = ("available", "missing")


@dataclass(frozen=True)
class EventQuery:
    """Optional conditions, all of which must hold, and a page. Times include both ends."""

    source: str | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    event_type: str | None = None
    status: str | None = None
    verdict: str | None = None
    class_name: str | None = None
    limit: int = 20
    offset: int = 0

    def __post_init__(self):
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("limit is 1 to 100, offset 0 or more")

    def conditions(self, verdict: Column | None = None) -> list[Column]:
        """The conditions on columns of events that are set."""
        equal = {"source": self.source, "event_type": self.event_type, "status": self.status}
        found = [F.col(k) == v for k, v in equal.items() if v is not None]
        if self.verdict is not None:
            found.append((F.col("verdict") if verdict is None else verdict) == self.verdict)
        if self.start_ms is not None:
            found.append(F.col("timestamp_ms") >= self.start_ms)
        if self.end_ms is not None:
            found.append(F.col("timestamp_ms") <= self.end_ms)
        return found


def select_events(events: DataFrame, detections: DataFrame, query: EventQuery) -> DataFrame:
    """Events that meet the conditions; a class condition is a semi-join with the detections."""
    for condition in query.conditions():
        events = events.where(condition)
    if query.class_name is not None:
        of_class = detections.where(F.col("class_name") == query.class_name).select("event_id")
        events = events.join(of_class, "event_id", "left_semi")
    return events


def list_events(events: DataFrame, detections: DataFrame, query: EventQuery) -> DataFrame:
    """One page of events, latest first, ties by event id."""
    found = select_events(events, detections, query).orderBy(F.desc("timestamp_ms"), "event_id")
    return (found.offset(query.offset) if query.offset else found).limit(query.limit)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The review of the highest revision of each event."""
    columns = [c for c in reviews.columns if c != "event_id"]
    latest = F.max_by(F.struct(*columns), "revision").alias("r")
    return reviews.groupBy("event_id").agg(latest).select("event_id", "r.*")


def event_cases(events: DataFrame, detections: DataFrame, evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events with their detections and evidence nested in order of place, and their latest review.

    Children are nested before the join, so each side is shuffled once by event id. An event's children must fit a row.
    """

    def nested(rows: DataFrame, name: str) -> DataFrame:
        columns = [c for c in rows.columns if c not in ("event_id", "position")]
        kept = F.array_sort(F.collect_list(F.struct("position", *columns)))
        return rows.groupBy("event_id").agg(kept.alias(name))

    review = latest_reviews(reviews)
    review = review.select("event_id", F.struct(*[c for c in review.columns if c != "event_id"]).alias("review"))
    cases = events.join(nested(detections, "detections"), "event_id", "left")
    cases = cases.join(nested(evidence, "evidence"), "event_id", "left").join(review, "event_id", "left")
    return cases.withColumns({c: F.coalesce(c, F.array().cast(cases.schema[c].dataType)) for c in ("detections", "evidence")})


def shown_verdict() -> Column:
    """The latest review's verdict, else the event's own."""
    return F.coalesce("review.verdict", "verdict")


def shown_confidence() -> Column:
    """The latest review's confidence wherever there is a review, null or not; else the event's own."""
    return F.when(F.col("review").isNotNull(), F.col("review.confidence")).otherwise(F.col("confidence"))


def recheck(cases: DataFrame, query: EventQuery) -> DataFrame:
    """Cases that meet the conditions as they now stand: the verdict is the shown one, a class any detection's."""
    for condition in query.conditions(verdict=shown_verdict()):
        cases = cases.where(condition)
    if query.class_name is not None:
        cases = cases.where(F.exists("detections", lambda d: d["class_name"] == query.class_name))
    return cases


def find_cases(events: DataFrame, detections: DataFrame, evidence: DataFrame, reviews: DataFrame, query: EventQuery) -> DataFrame:
    """The cases that meet the conditions as they now stand. What doesn't need a case filters first: the events' own
    columns, and, where a verdict is asked for, the latest review's or the event's verdict, then the class, of which only
    the detections of what is left are looked up; children are nested only for what is left."""
    own = replace(query, verdict=None, class_name=None)
    events = select_events(events, detections, own)
    latest = latest_reviews(reviews)
    if query.verdict is not None:
        said = latest.select("event_id", F.struct(F.col("verdict").alias("said")).alias("r"))
        now = F.when(F.col("r").isNotNull(), F.coalesce("r.said", "verdict")).otherwise(F.col("verdict"))
        events = events.join(said, "event_id", "left").where(now == query.verdict).drop("r")
    if query.class_name is not None:
        of_class = detections.where(F.col("class_name") == query.class_name).select("event_id")
        of_class = of_class.join(events.select("event_id"), "event_id", "left_semi").distinct()
        events = events.join(of_class, "event_id", "left_semi")
    ids = events.select("event_id")
    sides = [side.join(ids, "event_id", "left_semi") for side in (detections, evidence, reviews)]
    return recheck(event_cases(events, *sides), query)


def index_payload(cases: DataFrame) -> DataFrame:
    """What the vector index keeps of a case."""
    return cases.select(
        "event_id",
        "source",
        "timestamp_ms",
        "event_type",
        "status",
        shown_verdict().alias("verdict"),
        shown_confidence().alias("confidence"),
        F.array_sort(F.array_distinct(F.transform("detections", lambda d: d["class_name"]))).alias("class_names"),
    )


def append_reviews(reviews: DataFrame, new: DataFrame) -> DataFrame:
    """New reviews with the revisions that follow each event's history, in order of parsed_at_ms."""
    held = reviews.groupBy("event_id").agg(F.max("revision").alias("held"))
    order = Window.partitionBy("event_id").orderBy("parsed_at_ms", "verdict")
    numbered = new.withColumn("nth", F.row_number().over(order)).join(held, "event_id", "left")
    return numbered.withColumn("revision", (F.coalesce("held", F.lit(0)) + F.col("nth")).cast("int")).drop("held", "nth")


def broken_contract() -> Column:
    """The first rule of the review contract that a row breaks, or null."""
    ids = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    claims = F.coalesce("claims", F.array().cast("array<struct<text:string,evidence_ids:array<string>>>"))
    claimed = F.flatten(F.transform(claims, lambda c: F.coalesce(c["evidence_ids"], F.array().cast("array<string>"))))
    return (
        F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "verdict")
        .when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence")
        .when(~F.coalesce(F.col("evidence_status").isin(*EVIDENCE_STATES), F.lit(False)), "evidence_status")
        .when(F.col("explanation").isNull(), "explanation")
        .when(F.exists(claims, lambda c: F.coalesce(c["text"], F.lit("")) == ""), "claim_text")
        .when((F.col("evidence_status") == "missing") & (F.col("verdict") != "uncertain"), "missing_evidence")
        .when((F.col("verdict") != "uncertain") & (F.size(ids) == 0), "no_evidence")
        .when(F.size(F.array_except(claimed, ids)) > 0, "claims")
    )


def review_violations(reviews: DataFrame) -> DataFrame:
    """Reviews that break their contract, with the first rule broken."""
    return reviews.withColumn("violation", broken_contract()).where(F.col("violation").isNotNull())


def dangling_evidence(reviews: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_id, evidence_id) that a review names and the event's available evidence lacks."""
    named = reviews.select("event_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return named.join(evidence.where("available").select("event_id", "evidence_id"), ["event_id", "evidence_id"], "left_anti")


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether an absolute path without `..` lies under one of the roots; no roots, no path."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & inside
