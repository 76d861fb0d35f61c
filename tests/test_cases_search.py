import pytest
from pyspark.sql import functions as F

from vigilake.operators import cases, search
from vigilake.operators.cases import EventQuery

EVENT = "event_id string, source string, timestamp_ms bigint, event_type string, status string, verdict string, confidence double, revision int"
DET = "event_id string, position int, class_name string"
EV = "event_id string, position int, evidence_id string, available boolean"
REV = "event_id string, revision int, verdict string, confidence double"


def tables(spark, events=None, reviews=()):
    events = events or [("quay-4/18", "quay-4", 1_688_900_450_000, "intrusion", "pending", "violation", 0.35, 0)]
    return (
        spark.createDataFrame(events, EVENT),
        spark.createDataFrame([(e[0], 0, "trolley") for e in events], DET),
        spark.createDataFrame([], EV),
        spark.createDataFrame(list(reviews), REV),
    )


def test_listing_filters_and_semi_join(spark):
    events, det, *_ = tables(spark)
    assert cases.list_events(events, det, EventQuery(source="quay-4")).count() == 1
    assert cases.list_events(events, det, EventQuery(class_name="crane")).count() == 0
    at = 1_688_900_450_000
    assert cases.list_events(events, det, EventQuery(start_ms=at, end_ms=at)).count() == 1
    assert cases.list_events(events, det, EventQuery(end_ms=at - 1)).count() == 0


@pytest.mark.parametrize("limit", [0, 101])
def test_page_bounds(limit):
    with pytest.raises(ValueError):
        EventQuery(limit=limit)


def test_review_overrides_and_null_confidence(spark):
    case = cases.event_cases(*tables(spark, reviews=[("quay-4/18", 1, "violation", 0.77), ("quay-4/18", 2, "compliant", None)]))
    row = case.select(cases.shown_verdict().alias("v"), cases.shown_confidence().alias("c")).first()
    assert (row.v, row.c) == ("compliant", None)
    assert cases.recheck(case, EventQuery(verdict="compliant")).count() == 1
    assert cases.recheck(case, EventQuery(verdict="violation")).count() == 0


def test_fusion_scores_and_order(spark):
    a = spark.createDataFrame([("north", 1.0), ("south", 1.0)], "event_id string, score double")
    b = spark.createDataFrame([("north", 0.7)], "event_id string, score double")
    rows = [tuple(r) for r in search.fuse(a, b).collect()]
    assert rows == [("south", 1.0, "attribute"), ("north", 0.85, "both")]


def test_top_k_comes_after_the_recheck(spark):
    events = [("wrong", "quay-5", 1, "a", "new", None, None, 0), ("right", "quay-4", 2, "a", "new", None, None, 0)]
    ev, det, evidence, rev = tables(spark, events)
    points = spark.createDataFrame([("wrong", [1.0, 0.0]), ("right", [-1.0, 0.0])], "event_id string, vector array<float>")
    found = search.search_events(ev, det, evidence, rev, points, EventQuery(source="quay-4"), [1.0, 0.0], top_k=1)
    assert [r.event_id for r in found.collect()] == ["right"]
    alone = search.search_events(ev, det, evidence, rev, points, EventQuery(source="quay-4"), None, top_k=1)
    assert [(r.event_id, r.matched_by) for r in alone.collect()] == [("right", "attribute")]


def test_vector_filter(spark):
    points = spark.createDataFrame([("p", [1.0, 0.0], "camera-1")], "event_id string, vector array<float>, source string")
    assert search.vector_top_k(points, [1.0, 0.0], 5, {"source": "camera-1"}).count() == 1
    assert search.vector_top_k(points, [1.0, 0.0], 5, {"source": "camera-2"}).count() == 0


def test_review_contract(spark):
    schema = REV + ", evidence_status string, evidence_ids array<string>, claims array<struct<text:string,evidence_ids:array<string>>>, explanation string"
    rows = [
        ("ok", 1, "violation", 0.4, "available", ["f1", "f2"], [("t", ["f2"])], "e"),
        ("missing", 1, "compliant", 0.6, "missing", ["f1"], [], "e"),
        ("range", 1, "violation", -0.1, "available", ["f1"], [], "e"),
        ("claims", 1, "violation", 0.4, "available", ["f1"], [("t", ["f2"])], "e"),
        ("status", 1, "uncertain", 0.4, "gone", None, None, "e"),
        ("silent", 1, "uncertain", 0.4, "missing", None, None, None),
        ("blank", 1, "violation", 0.4, "available", ["f1"], [("", None)], "e"),
        ("loose", 1, "uncertain", 0.4, "missing", None, [("t", ["f1"])], "e"),
    ]
    found = {r.event_id: r.violation for r in cases.review_violations(spark.createDataFrame(rows, schema)).collect()}
    rest = {"status": "evidence_status", "silent": "explanation", "blank": "claim_text", "loose": "claims"}
    assert found == {"missing": "missing_evidence", "range": "confidence", "claims": "claims", **rest}


def test_paths_under_roots(spark):
    rows = spark.createDataFrame([("/a/b/c",), ("/a/../b",), ("a/b",), ("/ab/c",)], "p string")
    assert [r[0] for r in rows.select(cases.under_roots(F.col("p"), ["/a"])).collect()] == [True, False, False, False]
    assert not any(r[0] for r in rows.select(cases.under_roots(F.col("p"), [])).collect())
