"""Queries over reviews, results, counters, tracking and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import ids, records, results, text
from vigilake.functions.registry import EmbeddingIdentity, embedder, retrieve_rules
from vigilake.operators import cases, counters, detect, jobs, reviews, tracking
from vigilake.plans import tables as t
from vigilake.plans.registry import register
from vigilake.sources import ledger, wire

NOW = 500
# Results of the review jobs in work: every third comes from another worker, every fifth for an old revision.
RESULTS = f"""{t.JOBS}, {t.CASES_EVENTS}, res AS (
  SELECT job_id, CASE WHEN job_id % 3 = 2 AND job_id % 9 = 2 THEN 'other' ELSE 'w' || (job_id % 3) END AS owner, attempts AS attempt, entity_id AS event_id,
         entity_revision AS revision, CASE WHEN job_id % 4 = 0 THEN 'violation' ELSE 'uncertain' END AS verdict, CAST((job_id % 13) AS DOUBLE) / 10 AS confidence
  FROM job WHERE kind = 'review'),
judged AS (
  SELECT r.*, CASE WHEN NOT coalesce(j.state = 'processing' AND j.lease_owner = r.owner AND j.lease_expires_ms > {NOW}, false) THEN 'lease'
                   WHEN NOT coalesce(e.revision = r.revision, false) THEN 'revision' WHEN r.confidence > 1 THEN 'confidence'
                   WHEN r.verdict = 'violation' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r.event_id AND l_linestatus = 'O') THEN 'no_evidence' END AS refused
  FROM res AS r JOIN job AS j USING (job_id) LEFT JOIN ev AS e ON e.event_id = r.event_id)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("job_id")
    there = t.cases_evidence(spark, sf_dir).where("available").groupBy("event_id").agg(F.collect_set("evidence_id").alias("evidence_ids"))
    made = t.jobs(spark, sf_dir).where("kind = 'review'").select(
        "job_id",
        F.when((k % 3 == 2) & (k % 9 == 2), "other").otherwise(F.concat(F.lit("w"), (k % 3).cast("string"))).alias("owner"),
        F.col("attempts").alias("attempt"),
        F.col("entity_id").alias("event_id"),
        F.col("entity_revision").alias("revision"),
        F.when(k % 4 == 0, "violation").otherwise("uncertain").alias("verdict"),
        ((k % 13).cast("double") / 10).alias("confidence"),
        F.lit("available").alias("evidence_status"),
        F.lit("seen").alias("explanation"),
        F.array().cast("array<struct<text:string,evidence_ids:array<string>>>").alias("claims"),
    )
    return made.join(there, "event_id", "left")


def _completed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return reviews.complete_reviews(
        _results(spark, sf_dir), t.jobs(spark, sf_dir), t.cases_events(spark, sf_dir), t.reviews(spark, sf_dir), t.cases_evidence(spark, sf_dir), NOW
    )


@register("h9_refused_results", f"WITH {RESULTS} SELECT job_id, refused FROM judged WHERE refused IS NOT NULL")
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completed(spark, sf_dir)["refused"].select("job_id", "refused")


@register(
    "h9_completed_events",
    f"""WITH {RESULTS}, good AS (SELECT * FROM judged WHERE refused IS NULL)
SELECT ev.event_id, CASE WHEN g.job_id IS NULL THEN ev.revision ELSE ev.revision + 1 END AS revision, CASE WHEN g.job_id IS NULL THEN status ELSE 'completed' END AS status,
       CASE WHEN g.job_id IS NULL THEN ev.verdict ELSE g.verdict END AS verdict, CASE WHEN g.job_id IS NULL THEN ev.confidence ELSE g.confidence END AS confidence
FROM ev LEFT JOIN good AS g ON g.event_id = ev.event_id""",
)
def completed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completed(spark, sf_dir)["events"].select("event_id", "revision", "status", "verdict", "confidence")


@register(
    "h9_completed_jobs",
    f"""WITH {RESULTS}, good AS (SELECT * FROM judged WHERE refused IS NULL)
SELECT kind, entity_id, entity_revision, CASE WHEN job_id IN (SELECT job_id FROM good) THEN 'completed' ELSE state END AS state FROM job
UNION ALL SELECT 'index', event_id, CAST(revision + 1 AS INTEGER), 'pending' FROM good
WHERE NOT EXISTS (SELECT 1 FROM job WHERE kind = 'index' AND entity_id = event_id AND entity_revision = good.revision + 1)""",
)
def completed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completed(spark, sf_dir)["jobs"].select("kind", "entity_id", "entity_revision", "state")


@register(
    "h13_refresh_evidence",
    """SELECT page_id, page_id % 3 <> 0 AS available, CASE WHEN page_id % 3 <> 0 THEN length(url) END AS size, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS DOUBLE) END AS mtime FROM pages""",
)
def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/data/"), F.col("page_id").cast("string")).alias("path")
    held = pages.select("page_id", path, F.lit(True).alias("available"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mtime"))
    files = pages.where("page_id % 3 <> 0").select(path, F.length("url").cast("long").alias("size"), F.col("page_id").cast("double").alias("mtime"))
    return reviews.refresh_evidence(held, files).select("page_id", "available", "size", "mtime")


def _transition(after: DataFrame) -> DataFrame:
    return after.select("job_id", "state", "attempts", "lease_owner", "lease_expires_ms")




# Of the job table, job 148 is in work: 148 % 7 % 4 = 1; its owner is w1, its attempts are 3, its lease ends at 1480.
@register("h6_renew", f"WITH {t.JOBS} SELECT job_id, state, attempts, lease_owner, CASE WHEN job_id = 148 THEN 900 ELSE lease_expires_ms END AS lease_expires_ms FROM job")
def renewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transition(jobs.renew(t.jobs(spark, sf_dir), 148, "w1", 3, NOW, 400))


@register(
    "h7_complete",
    f"""WITH {t.JOBS} SELECT job_id, CASE WHEN job_id = 148 THEN 'completed' ELSE state END AS state, attempts, CASE WHEN job_id <> 148 THEN lease_owner END AS lease_owner,
       CASE WHEN job_id <> 148 THEN lease_expires_ms END AS lease_expires_ms FROM job""",
)
def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transition(jobs.complete(t.jobs(spark, sf_dir), 148, "w1", 3, NOW))


@register(
    "h8_fail",
    f"""WITH {t.JOBS} SELECT job_id, CASE WHEN job_id = 148 THEN 'dead' ELSE state END AS state, attempts, CASE WHEN job_id <> 148 THEN lease_owner END AS lease_owner,
       CASE WHEN job_id <> 148 THEN lease_expires_ms END AS lease_expires_ms FROM job""",
)
def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transition(jobs.fail(t.jobs(spark, sf_dir), 148, "w1", 3, NOW, 10, 3, "no answer"))


@register(
    "i9_parse_results",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN toxic = 1 THEN 'violation' ELSE 'compliant' END AS verdict,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 12 AS DOUBLE) / 10 END AS confidence,
       CASE WHEN doc_id % 5 = 0 THEN 'no_object' WHEN doc_id % 12 > 10 THEN 'confidence' END AS problem FROM labels""",
)
def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "violation").otherwise("compliant")
    confidence = ((F.col("doc_id") % 12).cast("double") / 10).cast("string")
    old = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (
        results.FIELDS["verdict"] + ": ", verdict, "\n" + results.FIELDS["confidence"] + ": ", confidence, "\n" + results.FIELDS["evidence_status"] + ": available\n"
        + results.FIELDS["explanation"] + ": seen\n" + results.FIELDS["evidence_ids"] + ": e1" + results.WIDE_COMMA + " e2")])
    new = F.concat(F.lit('```json\n{"verdict": "'), verdict, F.lit('", "confidence": '), confidence, F.lit(', "evidence_status": "available", "evidence_ids": ["e1"], "explanation": "seen"}\n```'))
    body = F.when(F.col("doc_id") % 5 == 0, "[1]").when(F.col("doc_id") % 2 == 0, old).otherwise(new)
    found = results.parse_results(t.table(spark, sf_dir, "labels").select("doc_id", body.alias("text")))
    return found.select("doc_id", "verdict", "confidence", "problem")


@register("i11_json_value", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 7 END AS value FROM events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct((F.col("event_id") % 7).alias("v"))))
    value = results.json_value(body, "v bigint", F.struct(F.lit(-1).cast("long").alias("v")))
    return t.table(spark, sf_dir, "events").select("event_id", value["v"].alias("value"))


@register(
    "b16_review_contract",
    """SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'explanation' WHEN doc_id % 6 = 2 THEN 'missing_evidence' WHEN doc_id % 6 = 3 THEN 'no_evidence' ELSE 'claims' END AS violation
FROM labels WHERE doc_id % 6 BETWEEN 1 AND 4""",
)
def broken_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    named = F.array(F.struct(F.lit("claim").alias("text"), F.when(k == 4, F.array(F.lit("e9"))).otherwise(F.array(F.lit("e1"))).alias("evidence_ids")))
    rows = t.table(spark, sf_dir, "labels").select(
        "doc_id", F.lit("violation").alias("verdict"), F.lit(0.5).alias("confidence"), F.when(k == 2, "missing").otherwise("available").alias("evidence_status"),
        F.when(k != 1, "seen").alias("explanation"), F.when(k == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("e1"))).alias("evidence_ids"), named.alias("claims"),
    )
    return cases.review_violations(rows).select("doc_id", "violation")


@register("i7_records", "SELECT doc_id, n_chars + 25 > 400 AS cut FROM (SELECT doc_id, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_chars FROM documents)")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of 25 bytes, the line end among them, around each text."""
    plain = F.concat(F.lit('"'), F.regexp_replace("text", "[^a-z]", ""), F.lit('"'))
    made = records.record({"event": F.lit("io"), "error": plain, "code": F.lit("1")}, 400)
    rows = t.table(spark, sf_dir, "documents").select("doc_id", made.alias("line"))
    return rows.select("doc_id", (F.instr("line", "record_truncated=true") > 0).alias("cut"))


@register(
    "b13_severity",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fatal' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'warning' END WHEN 2 THEN 'info' ELSE 'warning' END AS severity
FROM events WHERE event_id % 4 = 0 OR event_id % 4 = 1 AND event_id % 3 = 0""",
)
def severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "fatal_error").when(k == 1, "native_diagnostic").when(k == 2, "inference_stats").otherwise("stalled")
    rows = t.table(spark, sf_dir, "events").select("event_id", counters.severity(kind, F.when(F.col("event_id") % 3 == 0, "error").otherwise("warning")).alias("severity"))
    return rows.where(counters.severe_enough(F.col("severity"), "error"))


@register(
    "b15_contract",
    """SELECT p_partkey, CASE WHEN k = 0 THEN 'expected memory set is empty' WHEN k = 1 THEN 'pixel format does not match' WHEN k = 2 THEN 'caps memory was not observed'
  WHEN k = 3 THEN 'frame dimensions do not match' WHEN k = 4 THEN 'caps memory does not match' WHEN k = 5 THEN 'allocator memory was not observed'
  WHEN k = 6 THEN 'allocator memory does not match' WHEN k = 7 THEN 'buffer memory does not match' END AS violation FROM (SELECT p_partkey, p_partkey % 9 AS k FROM part)""",
)
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey") % 9, F.array().cast("array<string>")
    one = lambda at, good, bad: F.when(k == at, F.array(F.lit(bad))).otherwise(F.array(F.lit(good)))
    expected = F.struct(
        F.when(k == 0, none).otherwise(F.array(F.lit("device"))).alias("allowed"), F.lit("NV12").alias("format"), F.lit(640).alias("width"), F.lit(360).alias("height"), F.lit(True).alias("needs_allocator")
    )
    seen = F.struct(
        F.when(k == 1, "RGB").otherwise("NV12").alias("format"), F.when(k == 2, none).otherwise(one(4, "device", "system")).alias("caps"), F.when(k == 3, 1).otherwise(640).alias("width"),
        F.lit(360).alias("height"), F.when(k == 6, "system").when(k != 5, "device").alias("allocator"), one(7, "device", "system").alias("buffers"),
    )
    return t.table(spark, sf_dir, "part").select("p_partkey", counters.contract_violation(expected, seen).alias("violation"))


@register(
    "e8_scheduler_counters",
    """SELECT o_orderpriority AS source, count(*) AS submitted, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS completed, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS replaced,
       CAST(0 AS BIGINT) AS cancelled, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS failed, max(o_custkey) AS max_queue_us, max(o_orderkey) AS max_device_us FROM orders GROUP BY 1""",
)
def scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "replaced").otherwise("failed")
    tasks = t.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), state.alias("state"), F.col("o_custkey").alias("queue_us"), F.col("o_orderkey").alias("device_us"))
    return counters.scheduler_counters(tasks, "source")


@register(
    "e9_overlay_counters",
    """SELECT l_returnflag AS source, count(age) AS hits, CAST(count_if(age IS NULL) AS BIGINT) AS misses, CAST(sum(l_linenumber) AS BIGINT) AS predicted_boxes,
       CAST(sum(boxes - l_linenumber) AS BIGINT) AS observed_boxes, CAST(sum(1) AS BIGINT) AS timed_out_boxes, CAST(sum(2) AS BIGINT) AS clipped_boxes, CAST(sum(0) AS BIGINT) AS invalid_boxes,
       CAST(coalesce(sum(CASE WHEN boxes > 0 THEN age END), 0) AS BIGINT) AS age_total_ns, coalesce(max(CASE WHEN boxes > 0 THEN age END), 0) AS max_age_ns
FROM (SELECT *, CASE WHEN l_partkey % 3 > 0 THEN l_partkey END AS age, l_linenumber + l_suppkey % 2 AS boxes FROM lineitem) GROUP BY 1""",
)
def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, one = F.col("l_linenumber").cast("long"), lambda v: F.lit(v).cast("long")
    rows = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("age_ns"), (n + F.col("l_suppkey") % 2).alias("boxes"), n.alias("predicted"),
        one(1).alias("timed_out"), one(2).alias("clipped"), one(0).alias("invalid"),
    )
    return counters.overlay_counters(rows, "source")


@register(
    "e11_delivery_counters",
    """SELECT CAST(count_if(s AND a) AS BIGINT) AS emitted, CAST(count_if(NOT s) AS BIGINT) AS filtered, CAST(count_if(s AND NOT a) AS BIGINT) AS rejected, CAST(count_if(s AND a AND n_chars > 1000) AS BIGINT) AS truncated
FROM (SELECT doc_id % 4 IN (1, 2, 3) AS s, doc_id % 7 > 0 AS a, n_chars FROM documents)""",
)
def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*[F.lit(s) for s in counters.SEVERITIES])
    rows = t.table(spark, sf_dir, "documents").select(F.get(levels, (F.col("doc_id") % 4).cast("int")).alias("severity"), F.col("n_chars").alias("n_bytes"), (F.col("doc_id") % 7 > 0).alias("accepted"))
    return counters.delivery_counters(rows, "warning", 1_000)


@register("e14_cleanup_totals", "SELECT o_orderstatus AS stream, count(*) AS pages, CAST(sum(o_custkey) AS BIGINT) AS seen, CAST(sum(o_custkey // 2) AS BIGINT) AS acked FROM orders GROUP BY 1")
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stream"), F.col("o_custkey").alias("seen"), F.floor(F.col("o_custkey") / 2).alias("acked"))
    return counters.cleanup_totals(pages, "stream")


@register(
    "a22_stream_summary",
    """SELECT event_type AS stream, count(*) AS length, CAST(count_if(event_id % 3 > 0 AND event_id % 5 > 0) AS BIGINT) AS pending,
       CASE WHEN count_if(event_id % 3 > 0 AND event_id % 5 > 0) > 0 THEN 'pending' ELSE 'clear' END AS status FROM events GROUP BY 1""",
)
def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), (F.col("event_id") % 3 > 0).alias("delivered"), (F.col("event_id") % 5 == 0).alias("acked"))
    return counters.stream_summary(rows, "stream")


@register("g21_published_frames", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n FROM orders WHERE o_orderkey % 4 < 2")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(s) for s in ("completed", "failed", "replaced", "cancelled")])
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey", F.get(states, (F.col("o_orderkey") % 4).cast("int")).alias("status"), F.array(F.lit(1), F.lit(2)).alias("detections"))
    return counters.published_frames(rows).select("o_orderkey", F.size("detections").alias("n"))


@register(
    "g25_display",
    """SELECT p_partkey, round(x + 10, 6) AS x, round(w, 6) AS width, 'part #' || p_size || ' 0.50' AS label FROM (
  SELECT p_partkey, p_size, least(p_size / 40.0, 1) * 200 AS x, (least(p_size / 40.0 + 0.2, 1) - least(p_size / 40.0, 1)) * 200 AS w FROM part) WHERE w > 0""",
)
def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.struct(F.lit(10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(200.0).alias("width"), F.lit(100.0).alias("height"))
    x = F.col("p_size") / 40.0
    box = F.struct(x.alias("x1"), F.lit(0.1).alias("y1"), (x + 0.2).alias("x2"), F.lit(0.9).alias("y2"))
    rows = t.table(spark, sf_dir, "part").select("p_partkey", counters.display_rect(view, box).alias("r"), counters.display_label(F.lit("part"), F.col("p_size"), F.lit(0.5)).alias("label"))
    return rows.where("r IS NOT NULL").select("p_partkey", F.round("r.x", 6).alias("x"), F.round("r.width", 6).alias("width"), "label")


@register(
    "g16_warp_box",
    """SELECT p_partkey, round(least(0.9 * a + 0.1 * b, 0.9 * c + 0.1 * b, 0.9 * a + 0.1 * d, 0.9 * c + 0.1 * d) + 3, 6) AS x1, round(least(-0.2 * a + b, -0.2 * c + b, -0.2 * a + d, -0.2 * c + d) - 4, 6) AS y1,
       round(greatest(0.9 * a + 0.1 * b, 0.9 * c + 0.1 * b, 0.9 * a + 0.1 * d, 0.9 * c + 0.1 * d) + 3, 6) AS x2, round(greatest(-0.2 * a + b, -0.2 * c + b, -0.2 * a + d, -0.2 * c + d) - 4, 6) AS y2
FROM (SELECT p_partkey, p_size AS a, p_partkey % 50 AS b, p_size + 10 AS c, p_partkey % 50 + 20 AS d FROM part)""",
)
def warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 10).alias("x2"), (y + 20).alias("y2"))
    made = detect.warp_box(box, [F.lit(v) for v in (0.9, 0.1, 3.0, -0.2, 1.0, -4.0)])
    return t.table(spark, sf_dir, "part").select("p_partkey", made.alias("w")).select("p_partkey", *[F.round(f"w.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@register(
    "g15_source_warp",
    """SELECT p_partkey, 1.1::DOUBLE AS m00, 0.1::DOUBLE AS m01, round((1.1 * p_size + 0.1 * 7 + 4 - p_size) / 2, 6)::DOUBLE AS m02, (-0.2)::DOUBLE AS m10, 0.9::DOUBLE AS m11,
       round((-0.2 * p_size + 0.9 * 7 + 6 - 7) / 2, 6)::DOUBLE AS m12 FROM part""",
)
def source_warps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tracking.source_warp([F.lit(v) for v in (1.1, 0.1, 4.0, -0.2, 0.9, 6.0)], F.lit(2.0), F.col("p_size").cast("double"), F.lit(7.0))
    return t.table(spark, sf_dir, "part").select("p_partkey", *[F.round(m, 6).alias(f"m{k // 3}{k % 3}") for k, m in enumerate(made)])


@register(
    "b11_score_split",
    f"""WITH {t.BOXES} SELECT frame_id, CAST(count_if(confidence > 0.95) AS BIGINT) AS high, CAST(count_if(confidence > 0.92 AND confidence <= 0.95) AS BIGINT) AS low FROM box WHERE x2 > x1 AND y2 > y1 GROUP BY 1""",
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.boxed(spark, sf_dir).select("frame_id", F.explode("boxes").alias("b"))
    rows = rows.withColumn("part", tracking.score_split(F.col("b"), tracking.Settings(low=0.92, high=0.95)))
    return rows.groupBy("frame_id").agg(F.count_if(F.col("part") == "high").alias("high"), F.count_if(F.col("part") == "low").alias("low"))


@register(
    "g9_fused_costs",
    "SELECT l_orderkey, l_linenumber, round(1 - (1 - l_discount) * l_tax, 9) AS cost, l_linenumber - 2 < 0 OR l_partkey % 3 - 1 < 0 OR l_linenumber - 2 = l_partkey % 3 - 1 AS fits FROM lineitem",
)
def fused_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = tracking.same_class(F.col("l_linenumber") - 2, F.col("l_partkey") % 3 - 1)
    return t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(tracking.fused_cost(F.col("l_discount"), F.col("l_tax")), 9).alias("cost"), fits.alias("fits"))


@register(
    "c8_duplicate_tracks",
    """WITH p AS (
  SELECT t.l_orderkey AS frame_id, t.l_linenumber AS a, d.l_linenumber AS b, t.l_partkey AS ta, d.l_partkey AS tb, greatest(0, 1 - abs(t.l_quantity - d.l_quantity) / 20) AS i
  FROM lineitem AS t JOIN lineitem AS d ON t.l_orderkey = d.l_orderkey AND t.l_linenumber <= 3 AND d.l_linenumber > 3)
SELECT DISTINCT frame_id, CASE WHEN ta > tb THEN b ELSE a END AS track_id, CASE WHEN ta > tb THEN 'lost' ELSE 'tracked' END AS which FROM p WHERE abs(1 - i / (2 - i) - 0.15) > 1e-9 AND 1 - i / (2 - i) < 0.15""",
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity") / 20
    box = F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + 1).alias("x2"), F.lit(1.0).alias("y2")).alias("box")
    rows = t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("track_id"), box, F.col("l_partkey").alias("age"))
    return tracking.duplicate_tracks(rows.where("track_id <= 3"), rows.where("track_id > 3"), ["frame_id"])


@register("g17_track")
def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detections: orders are frames of four sources."""
    boxes = t.boxed(spark, sf_dir)
    frames = boxes.select(
        (F.col("frame_id") % 4).cast("string").alias("source_id"), F.lit(1).cast("long").alias("generation"), F.col("frame_id").alias("pts_ns"), F.lit(640).alias("width"),
        F.lit(360).alias("height"), F.col("boxes").alias("detections"), F.lit(None).cast("array<double>").alias("warp"),
    )
    found = tracking.track(frames)
    return found.select("source_id", "pts_ns", *tracking.STATS, F.transform("objects", lambda o: o["track_id"]).alias("track_ids"))


@register("e10_tracker_totals")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.tracker_totals(tracked(spark, sf_dir), ["source_id"])


@register(
    "b8_sane_tracked",
    f"""WITH {t.BOXES} SELECT frame_id, count(*) AS n, CAST(sum(greatest(class_id - 3, -1)) AS BIGINT) AS ids FROM box
WHERE least(x2, 1) > least(x1, 1) AND least(y2, 1) > least(y1, 1) AND confidence BETWEEN 0 AND 1 GROUP BY 1""",
)
def sane_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.transform("boxes", lambda b: b.withField("track_id", b["class_id"] - 3).withField("track_state", F.lit(7)))
    rows = t.boxed(spark, sf_dir).select("frame_id", F.explode(detect.sane_tracked(more)).alias("b")).where("b.track_state = 0")
    return rows.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("b.track_id").alias("ids"))


@register("c10_labels", "SELECT p_partkey, CASE p_partkey % 5 - 1 WHEN 0 THEN 'person' WHEN 1 THEN 'helmet' ELSE 'class_' || (p_partkey % 5 - 1) END AS label FROM part")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "part").select("p_partkey", detect.label((F.col("p_partkey") % 5 - 1).cast("int"), ["person", "helmet"]).alias("label"))


@register(
    "g3_detect",
    f"""SELECT l_orderkey AS frame_id, CAST(least(count(*), 50) AS INTEGER) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 7) GROUP BY 1""",
)
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of each tensor for each line item, none of which overlap."""
    n, one = F.col("l_linenumber"), lambda v: F.lit(float(v))
    row = F.array((n * 80 - 70).cast("double"), one(200), (n * 80 - 10).cast("double"), one(260), one(0.9), one(0))
    rows = t.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id")).agg(F.flatten(F.collect_set(row)).alias("tensor"))
    frames = rows.select("frame_id", "tensor", F.floor(F.size("tensor") / 6).cast("int").alias("n_rows"), F.lit(640).alias("source_w"), F.lit(360).alias("source_h"))
    return detect.detect(frames, "corners", 0, 0.5, (640, 640)).select("frame_id", F.size("objects").alias("n"))


@register("a16_collections", """SELECT p_partkey, 'points__embedding_' || left(sha256('{"backend":"mock","dimensions":' || p_size || ',"model":null}'), 16) AS name FROM part""")
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = ids.collection_name("points", {"model": F.lit(None).cast("string"), "backend": F.lit("mock"), "dimensions": F.col("p_size")})
    return t.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@register("a17_artifacts", "SELECT item_id, 'result-' || sha256(text) || '.json' AS name FROM benchmark")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "benchmark").select("item_id", text.artifact_name(F.col("text")).alias("name"))


@register("a14_dimensions", "SELECT vec_id, len(embedding) = (SELECT min(len(embedding)) FROM embeddings) AS ok FROM embeddings")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.same_dimension(t.points(spark, sf_dir)).select(F.col("event_id").alias("vec_id"), "ok")


@register("a11_evidence", "SELECT 'm-' || event_id AS event_id, kind FROM events, unnest(['clip', 'frame']) AS u(kind)")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit("/p").alias("path"), F.lit(True).alias("available"))
    body = F.to_json(F.struct(F.lit("x").alias("type"), F.array(item("frame"), item("clip"), item("frame")).alias("evidence")))
    rows = t.table(spark, sf_dir, "events").select(F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("ingress_id"), body.alias("event"))
    return wire.ledger_rows(wire.decode_events(rows), 1)["evidence"].select("event_id", "kind")


@register("i16_mime", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' END AS mime FROM pages")
def mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(F.lit("a/b.JPG"), F.lit("c.mp4"), F.lit("d.unknown")), (F.col("page_id") % 3 + 1).cast("int"))
    return t.table(spark, sf_dir, "pages").select("page_id", text.mime_type(path).alias("mime"))


@register("i17_milliseconds", "SELECT event_id, format('{:.3f}', CAST(event_id AS DOUBLE) / 1000) AS ms FROM events")
def millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").select("event_id", text.milliseconds(F.col("event_id")).alias("ms"))


@register("i19_explanations", "SELECT p_partkey, 'rule ' || p_partkey || ': a; b' AS said FROM part")
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "part").select("p_partkey", text.rule_explanation(F.col("p_partkey").cast("string"), F.array(F.lit("a"), F.lit("b"))).alias("said"))


@register("j1_embeddings")
def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embedder(EmbeddingIdentity())(F.col("text"))
    return t.table(spark, sf_dir, "benchmark").select("item_id", F.transform(made, lambda x: F.round(x, 9)).alias("vector"))


@register("j3_rules", "SELECT item_id AS question_id, 'mock-0' AS chunk_id, 'mock rule' AS title, text, CAST(1 AS DOUBLE) AS score FROM benchmark")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic backend's answer to all benchmark items as questions."""
    return retrieve_rules(t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")))
