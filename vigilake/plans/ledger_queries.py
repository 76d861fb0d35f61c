"""Queries over stored tables: versions of the ledger, job transitions by sets, the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import jobs, search, vectors
from vigilake.plans import tables as t
from vigilake.plans.case_queries import SEARCH
from vigilake.plans.registry import register
from vigilake.plans.review_queries import NOW, RESULTS, _results
from vigilake.plans.stream_queries import _messages
from vigilake.session import shared_folder
from vigilake.sources import ledger, pending
from vigilake.sources.snapshots import Merge, Snapshots

BUCKETS = 8


# ---------------------------------------------------------------- the ledger's versions


@register(
    "a13_recorded_events",
    """SELECT 'm-' || event_id AS event_id, event_type AS source, epoch_us(ts) // 1000 AS timestamp_ms, CAST(1 AS BIGINT) AS n_detections, CAST(2 AS BIGINT) AS n_jobs,
       CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS created_ms
FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT 'quarantine', NULL, NULL, count(*), NULL, NULL FROM events WHERE event_id % 10 = 0""",
)
def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even messages in one version of the ledger, all messages in the next, and the second batch replayed."""
    store, messages = ledger.open_ledger(spark, shared_folder(spark, "ledger"), BUCKETS), _messages(spark, sf_dir)
    even = F.substring("ingress_id", 3, 20).cast("long") % 2 == 0
    ledger.record(store, messages.where(even), 1, "query", 0)
    for _ in range(2):
        ledger.record(store, messages, 2, "query", 1)
    found = store.table("detections").groupBy("event_id").agg(F.count("*").alias("n_detections"))
    waiting = store.table("jobs").groupBy(F.col("entity_id").alias("event_id")).agg(F.count("*").alias("n_jobs"))
    events = store.table("events").join(found, "event_id", "left").join(waiting, "event_id", "left")
    bad = store.table("quarantine").agg(F.lit("quarantine").alias("event_id"), F.count("*").alias("n_detections"))
    rows = events.select("event_id", "source", "timestamp_ms", "n_detections", "n_jobs", F.col("created_ms").cast("int").alias("created_ms"))
    return rows.unionByName(bad, allowMissingColumns=True)


@register(
    "a8_migrated_events",
    """SELECT event_id, event_type AS source, value, CASE WHEN event_id % 2 = 0 THEN event_type || '/' || user_id ELSE 'new' END AS lane, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS schema_version FROM events""",
)
def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events from before two columns were added, half from after."""
    rows = t.signals(spark, sf_dir).select("event_id", "source", "track_id", "value")
    store = Snapshots(spark, shared_folder(spark, "migrated"), {"signals": ["event_id"]}, BUCKETS)
    store.transact(lambda _: {"signals": Merge(rows.where("event_id % 2 = 0"))})
    store.migrate("signals", "lane", "string", "concat(source, '/', track_id)")
    store.migrate("signals", "schema_version", "int", "0")
    later = rows.where("event_id % 2 <> 0").select("*", F.lit("new").alias("lane"), F.lit(1).alias("schema_version"))
    store.transact(lambda _: {"signals": Merge(later)})
    return store.table("signals").select("event_id", "source", "value", "lane", "schema_version")


@register("a12_merged_latest", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns, then earlier ones, merged into a stored table that keeps the latest of each conversation."""
    rows = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    store = Snapshots(spark, shared_folder(spark, "latest"), {"turns": ["conv_id"]}, BUCKETS)
    for part in (rows.where("turn >= 1"), rows.where("turn < 2")):
        store.transact(lambda _, part=part: {"turns": Merge(part, "turn")})
    return store.table("turns")


@register(
    "a15_points_upsert",
    "SELECT vec_id AS event_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label, len(embedding) AS size FROM embeddings",
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points, then every third again with another payload."""
    points = t.points(spark, sf_dir)
    store = Snapshots(spark, shared_folder(spark, "points"), {"points": ["event_id"]}, BUCKETS)
    store.transact(lambda _: {"points": Merge(points)})
    store.transact(lambda _: {"points": Merge(points.where("event_id % 3 = 0").withColumn("label", F.lit(-1)), "replace")})
    return store.table("points").select("event_id", F.col("label").cast("int").alias("label"), F.size("vector").cast("long").alias("size"))


def _stored_jobs(spark: SparkSession, sf_dir: str) -> Snapshots:
    """The job table in a store, with its events and evidence."""
    store = Snapshots(spark, shared_folder(spark, "jobs"), ledger.KEYS | {"evidence": ["event_id", "position", "evidence_id", "available"]}, BUCKETS)
    sides = {"jobs": t.jobs(spark, sf_dir), "events": t.cases_events(spark, sf_dir), "evidence": t.cases_evidence(spark, sf_dir)}
    store.transact(lambda _: {name: Merge(rows) for name, rows in sides.items()})
    return store


@register(
    "h9_stored_reviews",
    f"""WITH {RESULTS}, good AS (SELECT * FROM judged WHERE refused IS NULL)
SELECT 'job' AS what, entity_id, kind, entity_revision AS revision, CASE WHEN job_id IN (SELECT job_id FROM good) THEN 'completed' ELSE state END AS state, NULL::DOUBLE AS confidence FROM job
UNION ALL SELECT 'job', event_id, 'index', CAST(revision + 1 AS INTEGER), 'pending', NULL FROM good
WHERE NOT EXISTS (SELECT 1 FROM job WHERE kind = 'index' AND entity_id = event_id AND entity_revision = good.revision + 1)
UNION ALL SELECT 'event', ev.event_id, NULL, CASE WHEN g.job_id IS NULL THEN ev.revision ELSE CAST(ev.revision + 1 AS INTEGER) END, CASE WHEN g.job_id IS NULL THEN status ELSE 'completed' END,
       CASE WHEN g.job_id IS NULL THEN ev.confidence ELSE g.confidence END FROM ev LEFT JOIN good AS g ON g.event_id = ev.event_id
UNION ALL SELECT 'review', event_id, verdict, CAST(revision + 1 AS INTEGER), NULL, confidence FROM good""",
)
def stored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results finished in one version: jobs, events and reviews as they then are."""
    store = _stored_jobs(spark, sf_dir)
    ledger.complete(store, _results(spark, sf_dir), NOW, "query", 1)
    job = store.table("jobs").select(F.lit("job").alias("what"), "entity_id", "kind", F.col("entity_revision").alias("revision"), "state")
    event = store.table("events").select(F.lit("event").alias("what"), F.col("event_id").alias("entity_id"), "revision", F.col("status").alias("state"), "confidence")
    review = store.table("reviews").select(F.lit("review").alias("what"), F.col("event_id").alias("entity_id"), F.col("verdict").alias("kind"), "revision", "confidence")
    rows = job.unionByName(event, allowMissingColumns=True).unionByName(review, allowMissingColumns=True)
    return rows.select("what", "entity_id", "kind", "revision", "state", "confidence")


# ---------------------------------------------------------------- job transitions by sets

# Every job in work is asked for: a third by another owner, a fifth with another attempt.
ASKED = f"""{t.JOBS}, ask AS (
  SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'other' ELSE coalesce(lease_owner, 'none') END AS owner, CAST(attempts + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempt FROM job),
held AS (SELECT job_id FROM job JOIN ask USING (job_id) WHERE state = 'processing' AND lease_owner = owner AND attempts = attempt AND lease_expires_ms > {NOW})"""


def _asked(rows: DataFrame) -> DataFrame:
    k = F.col("job_id")
    owner = F.when(k % 3 == 0, "other").otherwise(F.coalesce("lease_owner", F.lit("none")))
    return rows.select(
        "job_id", owner.alias("owner"), (F.col("attempts") + F.when(k % 5 == 0, 1).otherwise(0)).cast("int").alias("attempt"),
        F.concat(F.lit("error "), (k % 7).cast("string")).alias("error"),
    )


def _moved(spark: SparkSession, sf_dir: str, transition) -> DataFrame:
    """The whole job table after a transition has been committed to the store."""
    store = _stored_jobs(spark, sf_dir)
    ledger.move_jobs(store, transition)
    return store.table("jobs").select("job_id", "state", "attempts", "lease_owner", "lease_expires_ms", "available_at_ms", "last_error")


@register(
    "h5_claim_many",
    f"""WITH {t.JOBS}, free AS (
  SELECT job_id, row_number() OVER (ORDER BY job_id) AS k FROM job
  WHERE kind = 'review' AND ((state = 'pending' AND available_at_ms <= {NOW}) OR (state = 'processing' AND lease_expires_ms <= {NOW}))),
ask AS (SELECT 'c' || c_custkey AS owner, row_number() OVER (ORDER BY c_nationkey, 'c' || c_custkey) AS k FROM customer),
taken AS (SELECT job_id, owner FROM free JOIN ask USING (k))
SELECT job_id, CASE WHEN owner IS NULL THEN state ELSE 'processing' END AS state, CAST(attempts + CASE WHEN owner IS NULL THEN 0 ELSE 1 END AS INTEGER) AS attempts, coalesce(owner, lease_owner) AS lease_owner,
       CASE WHEN owner IS NULL THEN lease_expires_ms ELSE {NOW + 400} END AS lease_expires_ms, available_at_ms, last_error
FROM job LEFT JOIN taken USING (job_id)""",
)
def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a worker that asks for a job."""
    workers = t.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("owner"), F.col("c_nationkey").alias("asked"))
    return _moved(spark, sf_dir, lambda table: jobs.claim_many(table, workers, "review", NOW, 400))


@register(
    "h6_renew_many",
    f"""WITH {ASKED} SELECT job_id, state, attempts, lease_owner, CASE WHEN job_id IN (SELECT job_id FROM held) THEN {NOW + 400} ELSE lease_expires_ms END AS lease_expires_ms, available_at_ms, last_error FROM job""",
)
def renewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, lambda table: jobs.renew_many(table, _asked(table), NOW, 400))


@register(
    "h7_complete_many",
    f"""WITH {ASKED} SELECT job_id, CASE WHEN h THEN 'completed' ELSE state END AS state, attempts, CASE WHEN NOT h THEN lease_owner END AS lease_owner,
       CASE WHEN NOT h THEN lease_expires_ms END AS lease_expires_ms, available_at_ms, last_error FROM (SELECT *, job_id IN (SELECT job_id FROM held) AS h FROM job)""",
)
def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, lambda table: jobs.complete_many(table, _asked(table), NOW))


@register(
    "h8_fail_many",
    f"""WITH {ASKED} SELECT job_id, CASE WHEN NOT h THEN state WHEN attempts >= 3 THEN 'dead' ELSE 'pending' END AS state, attempts, CASE WHEN NOT h THEN lease_owner END AS lease_owner,
       CASE WHEN NOT h THEN lease_expires_ms END AS lease_expires_ms, CASE WHEN h THEN {NOW + 60} ELSE available_at_ms END AS available_at_ms,
       CASE WHEN h THEN 'error ' || (job_id % 7) ELSE last_error END AS last_error FROM (SELECT *, job_id IN (SELECT job_id FROM held) AS h FROM job)""",
)
def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, lambda table: jobs.fail_many(table, _asked(table), NOW, 60, 3))


# ---------------------------------------------------------------- vectors


@register("d2_indexed_top_k")
def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of d2 by inverted lists. These tables' vectors have no groups, so recall takes most of the lists."""
    points, queries = t.points(spark, sf_dir), t.queries(spark, sf_dir)
    centres = vectors.fit_lists(points, 32)
    index = vectors.index_lists(points, centres)
    return vectors.list_top_k(index, queries, centres, 20, 22).withColumn("score", F.round("score", 6))


@register(
    "d5_fuse_all",
    f"""WITH {t.CASES_EVENTS}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS event_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), query) AS score FROM embeddings CROSS JOIN q),
emb AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) <= 100),
att AS (
  SELECT event_id, 1.0::DOUBLE AS score FROM ev WHERE status = 'O'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'N') ORDER BY timestamp_ms DESC, event_id LIMIT 50),
asked AS (SELECT query_id, event_id, att.score FROM att CROSS JOIN q),
fused AS (
  SELECT query_id, event_id, round(CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN 0.5 * a.score + 0.5 * b.score ELSE coalesce(a.score, b.score) END, 4) AS score,
         CASE WHEN a.score IS NULL THEN 'embed' WHEN b.score IS NULL THEN 'attribute' ELSE 'both' END AS matched_by
  FROM asked AS a FULL JOIN emb AS b USING (query_id, event_id))
SELECT query_id, event_id, score, matched_by, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS INTEGER) AS rank FROM fused
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) <= 100""",
)
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute list fused with each question's vector list."""
    found = search.attribute_search(t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), SEARCH, 50)
    queries = t.queries(spark, sf_dir)
    embedded = vectors.block_top_k(t.points(spark, sf_dir), queries, 100)
    return search.fuse_all(found, embedded, queries)


# ---------------------------------------------------------------- pending deliveries


@register(
    "a4_reclaimed",
    """SELECT event_id AS message_id, CASE WHEN epoch_us(ts) // 1000 <= cut THEN 'me' ELSE event_type END AS consumer, CASE WHEN epoch_us(ts) // 1000 <= cut THEN 2 ELSE 1 END AS deliveries
FROM events, (SELECT min(epoch_us(ts) // 1000) + (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) // 2 AS cut FROM events)""",
)
def reclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as deliveries; those of the first half of the time are idle and taken over, page by page."""
    rows = t.signals(spark, sf_dir)
    entries = rows.select(F.col("event_id").alias("message_id"), F.col("source").alias("consumer"), F.col("timestamp_ms").alias("delivered_ms"), F.lit(1).alias("deliveries"))
    store = pending.open_pending(spark, shared_folder(spark, "pending"), BUCKETS)
    store.transact(lambda _: {"entries": Merge(entries)})
    first, last, many = rows.agg(F.min("timestamp_ms"), F.max("timestamp_ms"), F.count("*")).first()
    cut, page = first + (last - first) // 2, many // 4 + 1
    while pending.reclaim_page(store, "me", 10**12, cut + 10**12, page) == page:
        pass
    return store.table("entries").select("message_id", "consumer", "deliveries")
