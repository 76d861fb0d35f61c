"""Queries over cases: listing, nesting, search, reviews, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import cases, jobs, search, vectors
from vigilake.operators.cases import EventQuery
from vigilake.plans import tables as t
from vigilake.plans.registry import register
from vigilake.sources.ledger import upsert_latest

LIST = EventQuery(source="3-MEDIUM", status="O", start_ms=820_454_400_000, end_ms=915_148_800_000, class_name="R", limit=50, offset=5)
SEARCH = EventQuery(status="O", class_name="N")


@register(
    "b1_list_events",
    f"""WITH {t.CASES_EVENTS} SELECT event_id, source, timestamp_ms, status FROM ev
WHERE source = '3-MEDIUM' AND status = 'O' AND timestamp_ms BETWEEN 820454400000 AND 915148800000
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'R')
ORDER BY timestamp_ms DESC, event_id LIMIT 50 OFFSET 5""",
)
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cases.list_events(t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), LIST)
    return found.select("event_id", "source", "timestamp_ms", "status")


@register(
    "c1_events_with_class",
    f"""WITH {t.CASES_EVENTS} SELECT event_id, event_type FROM ev WHERE event_type = 'type-3'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'A')""",
)
def with_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = EventQuery(event_type="type-3", class_name="A")
    return cases.select_events(t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), query).select("event_id", "event_type")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.event_cases(t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), t.cases_evidence(spark, sf_dir), t.reviews(spark, sf_dir))


@register(
    "c2_event_cases",
    f"""WITH {t.CASES_EVENTS}, {t.DETECTIONS},
d AS (SELECT event_id, count(*) AS n, string_agg(class_name, ',' ORDER BY position, class_name, confidence, track_id) AS classes FROM det GROUP BY 1),
e AS (SELECT l_orderkey AS event_id, count_if(l_linestatus = 'O') AS n FROM lineitem GROUP BY 1)
SELECT event_id, coalesce(d.classes, '') AS classes, CAST(coalesce(d.n, 0) AS INTEGER) AS n_detections, CAST(coalesce(e.n, 0) AS INTEGER) AS available_evidence,
       coalesce(CASE toxic WHEN 1 THEN 'violation' WHEN 0 THEN 'compliant' END, ev.verdict) AS verdict,
       CASE WHEN l.doc_id IS NULL THEN confidence WHEN quality = 1 THEN 0.9 END AS confidence
FROM ev LEFT JOIN d USING (event_id) LEFT JOIN e USING (event_id) LEFT JOIN labels AS l ON l.doc_id = event_id""",
)
def nested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select(
        "event_id",
        F.array_join(F.transform("detections", lambda d: d["class_name"]), ",").alias("classes"),
        F.size("detections").alias("n_detections"),
        F.size(F.filter("evidence", lambda e: e["available"])).alias("available_evidence"),
        cases.shown_verdict().alias("verdict"),
        cases.shown_confidence().alias("confidence"),
    )


@register(
    "b3_recheck",
    f"""WITH {t.CASES_EVENTS} SELECT event_id, toxic = 1 AS violation FROM ev JOIN labels ON doc_id = event_id
WHERE toxic = 1 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'R')""",
)
def recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cases.find_cases(
        t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), t.cases_evidence(spark, sf_dir), t.reviews(spark, sf_dir), EventQuery(verdict="violation", class_name="R")
    )
    return found.select("event_id", (cases.shown_verdict() == "violation").alias("violation"))


@register(
    "b6_index_payload",
    f"""WITH {t.CASES_EVENTS}, {t.DETECTIONS}, d AS (SELECT event_id, list_sort(list_distinct(list(class_name))) AS c FROM det GROUP BY 1)
SELECT event_id, source, timestamp_ms, event_type, status, coalesce(CASE toxic WHEN 1 THEN 'violation' WHEN 0 THEN 'compliant' END, verdict) AS verdict,
       CASE WHEN l.doc_id IS NULL THEN confidence WHEN quality = 1 THEN 0.9 END AS confidence, coalesce(array_to_string(c, ','), '') AS class_names
FROM ev LEFT JOIN d USING (event_id) LEFT JOIN labels AS l ON l.doc_id = event_id""",
)
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.index_payload(_cases(spark, sf_dir)).withColumn("class_names", F.array_join("class_names", ","))


COSINE = """v AS (
  SELECT vec_id AS event_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score
  FROM embeddings)"""


def _asked(condition: str, k: int) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS event_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), query) AS score FROM embeddings CROSS JOIN q {condition}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rank FROM s)
SELECT query_id, event_id, label, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


@register("d2_vector_top_k", _asked("", 20))
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.block_top_k(t.points(spark, sf_dir), t.queries(spark, sf_dir), 20)
    return found.withColumn("score", F.round("score", 6))


@register("b4_filtered_top_k", _asked("WHERE label = 1", 10))
def filtered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.block_top_k(t.points(spark, sf_dir).where("label = 1"), t.queries(spark, sf_dir), 10)
    return found.withColumn("score", F.round("score", 6))


@register(
    "d4_attribute_search",
    f"""WITH {t.CASES_EVENTS} SELECT event_id, 1.0::DOUBLE AS score FROM ev WHERE status = 'O'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'N') ORDER BY timestamp_ms DESC, event_id LIMIT 30""",
)
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.attribute_search(t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), SEARCH, 30)


FUSED = f"""{COSINE}, emb AS (SELECT event_id, score FROM v ORDER BY score DESC, event_id LIMIT 100),
att AS (
  SELECT event_id, 1.0::DOUBLE AS score FROM ev WHERE status = 'O'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'N') ORDER BY timestamp_ms DESC, event_id LIMIT 50),
fused AS (
  SELECT event_id, round(CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN 0.5 * a.score + 0.5 * b.score ELSE coalesce(a.score, b.score) END, 4) AS score,
         CASE WHEN a.score IS NULL THEN 'embed' WHEN b.score IS NULL THEN 'attribute' ELSE 'both' END AS matched_by
  FROM att AS a FULL JOIN emb AS b USING (event_id) ORDER BY 2 DESC, event_id LIMIT 100)"""


@register("d5_fuse", f"WITH {t.CASES_EVENTS}, {FUSED} SELECT * FROM fused")
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.attribute_search(t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), SEARCH, 50)
    return search.fuse(found, search.vector_top_k(t.points(spark, sf_dir), t.query_vector(spark, sf_dir), 100).select("event_id", "score"))


@register(
    "d6_search_events",
    f"""WITH {t.CASES_EVENTS}, {FUSED}
SELECT event_id, source, timestamp_ms, event_type, coalesce(CASE toxic WHEN 1 THEN 'violation' WHEN 0 THEN 'compliant' END, verdict) AS verdict,
       CASE WHEN l.doc_id IS NULL THEN confidence WHEN quality = 1 THEN 0.9 END AS confidence, score, matched_by
FROM fused JOIN ev USING (event_id) LEFT JOIN labels AS l ON l.doc_id = event_id
WHERE status = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'N')
ORDER BY score DESC, timestamp_ms DESC, event_id LIMIT 50""",
)
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_events(
        t.cases_events(spark, sf_dir),
        t.cases_detections(spark, sf_dir),
        t.cases_evidence(spark, sf_dir),
        t.reviews(spark, sf_dir),
        t.points(spark, sf_dir),
        SEARCH,
        t.query_vector(spark, sf_dir),
        50,
    )


@register("a12_latest_by_key", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return upsert_latest(rows.where("turn < 2"), rows.where("turn >= 2"), "conv_id", "turn")


@register(
    "h10_append_reviews",
    """SELECT doc_id AS event_id, CAST(1 + row_number() OVER (PARTITION BY doc_id ORDER BY d) AS INTEGER) AS revision, d AS parsed_at_ms
FROM labels, unnest([10::BIGINT, 20::BIGINT]) AS u(d)""",
)
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = t.reviews(spark, sf_dir)
    new = held.select("event_id", "verdict", F.explode(F.array(F.lit(10).cast("long"), F.lit(20).cast("long"))).alias("parsed_at_ms"))
    return cases.append_reviews(held, new).select("event_id", "revision", "parsed_at_ms")


@register(
    "b17_dangling_evidence",
    """WITH n AS (SELECT DISTINCT l_orderkey AS event_id, 'ev-' || (l_suppkey + l_linenumber % 2) AS evidence_id FROM lineitem)
SELECT * FROM n WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND 'ev-' || l_suppkey = evidence_id AND l_linestatus = 'O')""",
)
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t.table(spark, sf_dir, "lineitem")
    named = F.concat(F.lit("ev-"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).cast("string"))
    named = items.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_set(named).alias("evidence_ids"))
    return cases.dangling_evidence(named, t.cases_evidence(spark, sf_dir))


@register("b14_under_roots", "SELECT page_id, starts_with('/data/' || page_id % 3 || '/x', '/data/1/') AS inside FROM pages")
def under_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), (F.col("page_id") % 3).cast("string"), F.lit("/x"))
    return t.table(spark, sf_dir, "pages").select("page_id", cases.under_roots(path, ["/data/1"]).alias("inside"))


@register("d7_next_job", f"WITH {t.JOBS} SELECT * FROM job WHERE kind = 'review' AND (state = 'pending' AND available_at_ms <= 500 OR state = 'processing' AND lease_expires_ms <= 500) ORDER BY job_id LIMIT 1")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.next_job(t.jobs(spark, sf_dir), "review", 500)


@register(
    "h5_claim",
    f"""WITH {t.JOBS}, c AS (
  SELECT job_id FROM job WHERE kind = 'index' AND (state = 'pending' AND available_at_ms <= 500 OR state = 'processing' AND lease_expires_ms <= 500) ORDER BY job_id LIMIT 1)
SELECT job_id, CASE WHEN hit THEN 'processing' ELSE state END AS state, CASE WHEN hit THEN attempts + 1 ELSE attempts END AS attempts,
       CASE WHEN hit THEN 'me' ELSE lease_owner END AS lease_owner, CASE WHEN hit THEN 800 ELSE lease_expires_ms END AS lease_expires_ms
FROM (SELECT *, job_id IN (SELECT job_id FROM c) AS hit FROM job)""",
)
def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = jobs.claim(t.jobs(spark, sf_dir), "index", "me", 500, 300)
    return after.select("job_id", "state", "attempts", "lease_owner", "lease_expires_ms")


@register("h8_over_limit", f"WITH {t.JOBS} SELECT job_id, CASE WHEN state = 'processing' AND attempts > 3 THEN 'dead' ELSE state END AS state FROM job")
def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.over_limit(t.jobs(spark, sf_dir), 3).select("job_id", "state")


@register("c9_stale_jobs", f"WITH {t.JOBS}, {t.CASES_EVENTS} SELECT job_id, coalesce(entity_revision <> revision, true) AS stale FROM job LEFT JOIN ev ON event_id = entity_id")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stale(t.jobs(spark, sf_dir), t.cases_events(spark, sf_dir)).select("job_id", "stale")


@register(
    "c11_rebuild_index",
    f"""WITH {t.JOBS}, {t.CASES_EVENTS}, w AS (SELECT 'index' AS kind, event_id AS entity_id, revision AS entity_revision, true AS want FROM ev)
SELECT job_id, kind, entity_id, entity_revision, CASE WHEN want AND (job_id IS NULL OR state IN ('completed', 'dead')) THEN 'pending' ELSE state END AS state
FROM job FULL JOIN w USING (kind, entity_id, entity_revision)""",
)
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = jobs.rebuild_index(t.jobs(spark, sf_dir), t.cases_events(spark, sf_dir), 1000)
    return after.select("job_id", "kind", "entity_id", "entity_revision", "state")


@register("a23_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 700 ORDER BY 1 LIMIT 100")
def keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.keyset_page(t.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 700, 100)


@register(
    "a4_pending_summary",
    "SELECT source AS consumer, count(*) AS pending, CAST(count_if(n_chars >= 2000) AS BIGINT) AS reclaimable, max(n_chars) AS longest_idle_ms FROM documents GROUP BY 1",
)
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = t.table(spark, sf_dir, "documents").select(F.col("source").alias("consumer"), F.col("n_chars").alias("idle_ms"))
    return jobs.pending_summary(entries, 2000)
