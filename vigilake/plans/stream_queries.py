"""Queries over ordered streams: cooldowns, guards, as-of lookups, statistics, geometry, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import ids, text
from vigilake.operators import cooldown, detect, folds, motion, stats, timeline
from vigilake.plans import tables as t
from vigilake.plans.registry import register
from vigilake.sources import wire

SIX_HOURS = 21_600_000


@register(
    "f1_consumer_cooldown",
    f"""WITH RECURSIVE {t.SIGNALS}, k AS (SELECT source, track_id, list(timestamp_ms ORDER BY timestamp_ms) AS ts FROM sig GROUP BY 1, 2),
a AS (
  SELECT source, track_id, ts, ts[1] AS anchor FROM k
  UNION ALL SELECT source, track_id, ts, list_filter(ts, lambda x: x >= anchor + {SIX_HOURS})[1] FROM a WHERE ts[-1] >= anchor + {SIX_HOURS})
SELECT event_id, CASE WHEN event_id = min(event_id) OVER (PARTITION BY s.source, s.track_id, s.timestamp_ms) AND a.anchor IS NOT NULL THEN 'RUN' ELSE 'SKIP' END AS decision
FROM sig AS s LEFT JOIN (SELECT DISTINCT source, track_id, anchor FROM a) AS a ON a.source = s.source AND a.track_id = s.track_id AND a.anchor = s.timestamp_ms""",
)
def consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.signals(spark, sf_dir).select("event_id", F.col("event_id").alias("ingress_id"), "source", "track_id", "timestamp_ms")
    return cooldown.consumer_cooldown(rows, SIX_HOURS)


@register("f2_publisher_cooldown")
def publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    obj = F.struct(F.col("track_id").cast("int").alias("track_id"), (F.col("event_id") % 2).cast("int").alias("track_state"))
    frames = t.signals(spark, sf_dir).select(F.col("source").alias("source_id"), F.col("event_id").alias("frame_id"), F.col("timestamp_ms").alias("now_ms"), F.array(obj).alias("objects"))
    return cooldown.publisher_cooldown(frames, 600_000).select("frame_id", "published")


@register(
    "d12_rate_limit",
    f"""WITH RECURSIVE {t.SIGNALS}, k AS (SELECT source, list(at_us * 1000 ORDER BY at_us) AS ts FROM sig GROUP BY 1),
a AS (
  SELECT source, ts, ts[1] AS pts_ns FROM k
  UNION ALL SELECT source, list_filter(ts, lambda x: x >= pts_ns + 3600000000000), list_filter(ts, lambda x: x >= pts_ns + 3600000000000)[1] FROM a WHERE ts[-1] >= pts_ns + 3600000000000)
SELECT source AS source_id, pts_ns FROM a""",
)
def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = t.signals(spark, sf_dir).select(F.col("source").alias("source_id"), (F.col("at_us") * 1000).alias("pts_ns"))
    return cooldown.rate_limit(frames, 3_600_000_000_000)


@register(
    "f3_guard",
    f"""WITH {t.FRAMES}, h AS (SELECT *, max(pts_ns) OVER (PARTITION BY source_id, generation ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM fr)
SELECT seq, CASE WHEN pts_ns IS NULL THEN 'no_pts' WHEN pts_ns = high THEN 'duplicate_pts' WHEN pts_ns < high THEN 'stale_pts' ELSE 'published' END AS outcome FROM h""",
)
def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.guard(t.frames(spark, sf_dir), arrivals=4_096).select("seq", "outcome")


@register(
    "f5_generations",
    f"""WITH {t.FRAMES}, h AS (
  SELECT *, CASE WHEN discont THEN 'd' WHEN pts_ns < last_value(pts_ns IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'r' END AS kind FROM fr),
o AS (SELECT *, kind IS NOT NULL AND kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY source_id ORDER BY seq) AS opens FROM h)
SELECT seq, CAST(1 + sum(CAST(opens AS INTEGER)) OVER (PARTITION BY source_id ORDER BY seq) AS BIGINT) AS generation FROM o""",
)
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.generations(t.frames(spark, sf_dir).drop("generation"), arrivals=4_096).select("seq", "generation")


@register(
    "f6_history_depth",
    f"""WITH {t.FRAMES} SELECT seq, least(64, count(*) OVER (PARTITION BY source_id, generation ORDER BY pts_ns RANGE BETWEEN 200 PRECEDING AND CURRENT ROW)) AS depth
FROM fr WHERE pts_ns IS NOT NULL""",
)
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.history_depth(t.frames(spark, sf_dir).where("pts_ns IS NOT NULL"), 64, 200).select("seq", "depth")


@register("b12_current_generation", f"WITH {t.FRAMES} SELECT seq, source_id FROM fr WHERE generation = (SELECT max(generation) FROM fr AS x WHERE x.source_id = fr.source_id)")
def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.current_generation(t.frames(spark, sf_dir)).select("seq", "source_id")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = t.signals(spark, sf_dir).select("track_id", "at_us", "event_id", "source")
    return rows.where("source = 'click'").drop("source"), rows.where("source = 'purchase'").drop("source")


@register(
    "c5_asof",
    f"""WITH {t.SIGNALS} SELECT l.event_id, r.event_id AS found_id FROM (SELECT * FROM sig WHERE source = 'click') AS l
ASOF LEFT JOIN (SELECT * FROM sig WHERE source = 'purchase') AS r ON l.track_id = r.track_id AND l.at_us >= r.at_us""",
)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.asof(*_sides(spark, sf_dir), ["track_id"], "at_us", 86_400_000_000)
    return found.select("event_id", F.col("found.event_id").alias("found_id"))


@register(
    "c6_asof_within",
    f"""WITH {t.SIGNALS} SELECT l.event_id, CASE WHEN r.at_us >= l.at_us - 7200000000 THEN r.event_id END AS found_id FROM (SELECT * FROM sig WHERE source = 'click') AS l
ASOF LEFT JOIN (SELECT * FROM sig WHERE source = 'purchase') AS r ON l.track_id = r.track_id AND l.at_us >= r.at_us""",
)
def asof_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.asof_within(*_sides(spark, sf_dir), ["track_id"], "at_us", 7_200_000_000)
    return found.select("event_id", F.col("found.event_id").alias("found_id"))


@register(
    "e1_window_stats",
    f"""WITH {t.SIGNALS}, w AS (SELECT *, at_us // 86400000000 * 86400000000 AS window_start FROM sig),
g AS (SELECT *, at_us - coalesce(lag(at_us) OVER (PARTITION BY source, window_start ORDER BY at_us), window_start) AS gap FROM w)
SELECT source, window_start, count(*) AS completed, round(count(*) * 1e6 / 86400000000, 6) AS completed_fps,
       greatest(max(gap), window_start + 86400000000 - max(at_us)) AS longest_gap,
       quantile_disc(total_us, 0.5) AS total_p50, quantile_disc(total_us, 0.95) AS total_p95
FROM g GROUP BY source, window_start""",
)
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.window_stats(t.signals(spark, sf_dir), "source", "at_us", 86_400_000_000, ("total_us",))


@register("e7_outcomes", "SELECT o_orderpriority AS source, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS \"O\", CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS \"F\", CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS \"P\" FROM orders GROUP BY 1")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outcome_counters(t.cases_events(spark, sf_dir), "source", "status", ("O", "F", "P"))


@register("e12_first_of_each", "SELECT event_type, user_id, arg_min(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select("event_type", "user_id", "value", "event_id")
    return stats.first_of_each(rows, ["event_type", "user_id"], "event_id")


@register(
    "e5_object_summary",
    f"""WITH {t.DETECTIONS}, c AS (SELECT event_id, class_name, count(*) AS n FROM det GROUP BY 1, 2)
SELECT event_id, string_agg(class_name || ':' || n, ',' ORDER BY class_name) AS objects FROM c GROUP BY 1""",
)
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.cases_detections(spark, sf_dir).groupBy("event_id").agg(F.collect_list("class_name").alias("names"))
    return rows.select("event_id", text.object_summary(F.col("names")).alias("objects"))


@register(
    "b7_sane_boxes",
    f"""WITH {t.BOXES}, c AS (SELECT frame_id, least(greatest(x1, 0), 1) AS x1, least(greatest(y1, 0), 1) AS y1, least(greatest(x2, 0), 1) AS x2, least(greatest(y2, 0), 1) AS y2, confidence FROM box)
SELECT frame_id, count(*) AS n, round(sum((x2 - x1) * (y2 - y1)), 6) AS area FROM c WHERE x2 > x1 AND y2 > y1 AND confidence BETWEEN 0 AND 1 GROUP BY 1""",
)
def sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = t.boxed(spark, sf_dir).select("frame_id", F.explode(detect.sane(F.col("boxes"))).alias("b"))
    area = (F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))
    return kept.groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.sum(area), 6).alias("area"))


@register("d8_suppress")
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = detect.suppress(F.col("boxes"))
    return t.boxed(spark, sf_dir).select("frame_id", F.size("boxes").alias("n"), F.size(kept).alias("kept"))


@register(
    "c7_iou_pairs",
    f"""WITH {t.BOXES}, a AS (SELECT frame_id, l_linenumber AS k, b.* EXCLUDE (frame_id) FROM (SELECT l_orderkey AS frame_id, l_linenumber, row_number() OVER () AS r FROM lineitem) JOIN (SELECT *, row_number() OVER () AS r FROM box) AS b USING (r, frame_id)),
p AS (
  SELECT t.frame_id, greatest(0, least(t.x2, d.x2) - greatest(t.x1, d.x1)) * greatest(0, least(t.y2, d.y2) - greatest(t.y1, d.y1)) AS i,
         (t.x2 - t.x1) * (t.y2 - t.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) AS s
  FROM a AS t JOIN a AS d ON t.frame_id = d.frame_id AND t.k <= 3 AND d.k > 3)
SELECT frame_id, count(*) AS pairs, round(min(1 - i / (s - i)), 6) AS least_cost FROM p WHERE round(1 - i / (s - i), 9) <= 0.8 GROUP BY 1""",
)
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey") % 80 / 100.0, F.col("l_suppkey") % 80 / 100.0
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity") / 100).alias("x2"), (y + 0.3).alias("y2")).alias("box")
    rows = t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("k"), box)
    pairs = detect.iou_pairs(rows.where("k <= 3").withColumnRenamed("k", "track_id"), rows.where("k > 3").withColumnRenamed("k", "detection_id"), ["frame_id"], 1.0)
    pairs = pairs.where(F.round("cost", 9) <= 0.8)
    return pairs.groupBy("frame_id").agg(F.count("*").alias("pairs"), F.round(F.min("cost"), 6).alias("least_cost"))


@register(
    "g1_letterbox",
    """WITH d AS (SELECT p_partkey, 100 + p_size * 7 AS w, 50 + p_partkey % 300 AS h FROM part),
s AS (SELECT *, w * 640 >= h * 640 AS wide, CASE WHEN w >= h THEN 640.0 / w ELSE 640.0 / h END AS scale FROM d),
p AS (SELECT *, 640 - CASE WHEN wide THEN 640 ELSE least(greatest(floor(w * scale + 0.5), 1), 640) END AS px,
             640 - CASE WHEN wide THEN least(greatest(floor(h * scale + 0.5), 1), 640) ELSE 640 END AS py FROM s)
SELECT p_partkey, round(CAST(scale AS DOUBLE), 6) AS scale, CAST(floor(px / 2) AS INTEGER) AS pad_left, CAST(floor(py / 2) AS INTEGER) AS pad_top,
       CAST(px - floor(px / 2) AS INTEGER) AS pad_right, CAST(py - floor(py / 2) AS INTEGER) AS pad_bottom
FROM p""",
)
def letterboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (100 + F.col("p_size") * 7).cast("int"), (50 + F.col("p_partkey") % 300).cast("int")
    fit = detect.letterbox(w, h, F.lit(640), F.lit(640)).alias("fit")
    return t.table(spark, sf_dir, "part").select("p_partkey", fit).select("p_partkey", F.round("fit.scale", 6).alias("scale"), "fit.pad_left", "fit.pad_top", "fit.pad_right", "fit.pad_bottom")


@register("d9_best_class", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class_id, CAST(list_max(embedding) AS DOUBLE) AS score FROM embeddings")
def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "embeddings").select("vec_id", detect.best_class(F.col("embedding")).alias("b")).select("vec_id", "b.*")


@register("g19_running_ids", f"WITH {t.SIGNALS} SELECT event_id, CAST(row_number() OVER (PARTITION BY source ORDER BY event_id) AS INTEGER) AS track_id FROM sig")
def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = folds.row_numbers(t.signals(spark, sf_dir).select("event_id", "source"), ["source"], "event_id", 4_096, "track_id")
    return numbered.select("event_id", F.col("track_id").cast("int").alias("track_id"))


@register("g24_predict")
def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.col("event_id") % 50 / 100.0
    obj = F.struct(F.lit("person").alias("class_name"), F.lit(0).alias("class_id"), move.alias("x1"), F.lit(0.2).alias("y1"), (move + 0.2).alias("x2"), F.lit(0.4).alias("y2"), F.col("track_id").cast("int").alias("track_id"), F.lit(1).alias("track_state"))
    frames = t.signals(spark, sf_dir).groupBy(F.col("source").alias("source_id"), F.lit(1).cast("long").alias("generation"), (F.floor(F.col("event_id") / 4) * 100_000_000).alias("pts_ns"))
    frames = frames.agg(F.array_sort(F.collect_list(obj)).alias("objects"))
    displays = frames.select("source_id", "generation", (F.col("pts_ns") + 50_000_000).alias("pts_ns"))
    return motion.predict(frames, displays)


@register(
    "i1_identifiers",
    f"""WITH {t.SIGNALS} SELECT event_id, sha256(event_id || chr(0) || 'frame' || chr(0) || source) AS evidence_id, left(sha256(source || chr(0) || track_id), 32) AS track_key,
       sha256(event_id || chr(0) || track_id) AS token FROM sig""",
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s, k = F.col("event_id"), F.col("source"), F.col("track_id")
    return t.signals(spark, sf_dir).select("event_id", ids.evidence_id(e, F.lit("frame"), s).alias("evidence_id"), ids.track_key(s, k).alias("track_key"), ids.event_token(e, k).alias("token"))


@register("i3_point_ids")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.signals(spark, sf_dir).select("event_id", ids.name_uuid(F.col("event_id").cast("string")).alias("point_id"))


@register("i4_hash_embedding")
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = ids.hash_embedding(F.col("text"), 64)
    return t.table(spark, sf_dir, "benchmark").select("item_id", F.transform(vector, lambda x: F.round(x, 9)).alias("vector"))


@register("i5_event_text", f"WITH {t.CASES_EVENTS} SELECT event_id, 'event_id=' || event_id || ' source=' || source || ' timestamp_ms=' || timestamp_ms || ' event_type=' || event_type || ' verdict=' || coalesce(verdict, '') AS text FROM ev")
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {k: F.col(k) for k in ("event_id", "source", "timestamp_ms", "event_type", "verdict")}
    return t.cases_events(spark, sf_dir).select("event_id", text.event_text(fields).alias("text"))


@register(
    "i6_log_value",
    """SELECT event_id, CASE WHEN regexp_full_match(props, '[A-Za-z0-9_./:-]+') THEN props
  ELSE '"' || replace(replace(replace(replace(replace(props, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' END AS shown FROM events""",
)
def log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").select("event_id", text.log_value(F.col("props")).alias("shown"))


@register("i8_safe_directory", "SELECT page_id, CASE WHEN regexp_full_match(url, '[A-Za-z0-9._-]{1,128}') THEN url ELSE 'event-' || sha256(url) END AS directory FROM pages")
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", text.safe_directory(F.col("url")).alias("directory"))


@register(
    "a6_decode_events",
    """SELECT 'm-' || event_id AS event_id, event_type AS source, epoch_us(ts) // 1000 AS timestamp_ms, event_type, CAST(NULL AS BIGINT) AS source_pts,
       user_id AS track_id, CASE WHEN event_id % 10 = 0 THEN 'malformed' END AS problem FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'malformed' FROM events WHERE event_id % 10 = 0""",
)
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wire.decode_events(_messages(spark, sf_dir))
    return rows.select("ctx.event_id", "ctx.source", "ctx.timestamp_ms", "ctx.event_type", "ctx.source_pts", F.get("ctx.detections", F.lit(0))["track_id"].cast("long").alias("track_id"), "problem")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON message for each event; every tenth is cut short."""
    box = F.struct(F.lit("person").alias("class"), F.lit(0.9).alias("confidence"), F.array(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.2)).alias("bbox"), F.col("track_id"))
    body = F.to_json(F.struct(F.col("source").alias("type"), "source", "timestamp_ms", F.array(box).alias("detections")))
    body = F.when(F.col("event_id") % 10 == 0, F.expr("substring('{\"type\": \"x\", ', 1, 11)")).otherwise(body)
    return t.signals(spark, sf_dir).select(F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("ingress_id"), body.alias("event"))


@register(
    "a13_ledger_jobs",
    "SELECT 'm-' || event_id AS entity_id, kind, CAST(0 AS INTEGER) AS entity_revision, 'pending' AS state FROM events, unnest(['review', 'index']) AS u(kind) WHERE event_id % 10 <> 0",
)
def ledger_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = wire.ledger_rows(wire.decode_events(_messages(spark, sf_dir)), 1_000)["jobs"]
    return made.select("entity_id", "kind", "entity_revision", "state")


@register("a10_ledger_detections", "SELECT 'm-' || event_id AS event_id, 'person' AS class_name, CAST(user_id AS INTEGER) AS track_id FROM events WHERE event_id % 10 <> 0")
def ledger_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = wire.ledger_rows(wire.decode_events(_messages(spark, sf_dir)), 1_000)["detections"]
    return made.select("event_id", "class_name", "track_id")


@register("a2_encode_payload")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    obj = F.struct(F.lit("person").alias("class_name"), F.lit(0).alias("class_id"), F.lit(0.5).alias("confidence"), F.lit(0.1).alias("x1"), F.lit(0.1).alias("y1"), F.lit(0.2).alias("x2"), F.lit(0.2).alias("y2"), F.col("track_id").cast("int").alias("track_id"), F.lit(1).alias("track_state"), F.lit(False).alias("occluded"))
    frames = t.signals(spark, sf_dir).select(F.col("source").alias("source_id"), F.col("event_id").alias("frame_id"), "timestamp_ms", F.array(obj).alias("objects"))
    return wire.encode_payload(frames)
