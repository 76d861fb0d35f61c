"""The driver's tables as the event model: orders are events, their line items detections, labels reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def millis(ts: str) -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def rounded(value: Column, places: int) -> Column:
    """`value` as SQL's round of a double gives it: the scaled binary number decides, not the shortest decimal."""
    return F.round(value * 10.0**places, 0) / 10.0**places


def cases_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderpriority").alias("source"),
        millis("o_orderdate").alias("timestamp_ms"),
        F.concat(F.lit("type-"), (F.col("o_custkey") % 5).cast("string")).alias("event_type"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_custkey") % 3 == 0, "uncertain").alias("verdict"),
        rounded(F.col("o_totalprice") / 1e6, 6).alias("confidence"),
        (F.col("o_custkey") % 4).cast("int").alias("revision"),
    )


CASES_EVENTS = """ev AS (
  SELECT o_orderkey AS event_id, o_orderpriority AS source, epoch_ms(o_orderdate) AS timestamp_ms,
         'type-' || (o_custkey % 5) AS event_type, o_orderstatus AS status,
         CASE WHEN o_custkey % 3 = 0 THEN 'uncertain' END AS verdict, round(o_totalprice / 1e6, 6) AS confidence,
         CAST(o_custkey % 4 AS INTEGER) AS revision
  FROM orders)"""


def cases_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_returnflag").alias("class_name"),
        F.round(1 - F.col("l_discount"), 4).alias("confidence"),
        F.col("l_partkey").alias("track_id"),
    )


DETECTIONS = """det AS (
  SELECT l_orderkey AS event_id, l_linenumber AS position, l_returnflag AS class_name,
         round(1 - l_discount, 4) AS confidence, l_partkey AS track_id
  FROM lineitem)"""


def cases_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        F.col("l_linenumber").alias("position"),
        F.concat(F.lit("ev-"), F.col("l_suppkey").cast("string")).alias("evidence_id"),
        (F.col("l_linestatus") == "O").alias("available"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("event_id"),
        F.lit(1).alias("revision"),
        F.when(F.col("toxic") == 1, "violation").otherwise("compliant").alias("verdict"),
        F.when(F.col("quality") == 1, 0.9).alias("confidence"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One stored vector, as a question."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vectors whose id 50 divides, as questions."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("source"),
        F.col("user_id").alias("track_id"),
        micros("ts").alias("at_us"),
        millis("ts").alias("timestamp_ms"),
        F.round(F.col("value") * 1000).cast("long").alias("total_us"),
        "value",
        "props",
    )


SIGNALS = """sig AS (
  SELECT event_id, event_type AS source, user_id AS track_id, epoch_us(ts) AS at_us, epoch_us(ts) // 1000 AS timestamp_ms,
         CAST(round(value * 1000) AS BIGINT) AS total_us, value, props
  FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job table: states, leases and attempts by arithmetic on order keys."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"),
        F.when(k % 2 == 0, "review").otherwise("index").alias("kind"),
        k.alias("entity_id"),
        (F.col("o_custkey") % 3).cast("int").alias("entity_revision"),
        F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "dead"))), (k % 7 % 4 + 1).cast("int")).alias("state"),
        (k % 5).cast("int").alias("attempts"),
        F.when(k % 7 % 4 == 1, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("lease_owner"),
        F.when(k % 7 % 4 == 1, k * 10).alias("lease_expires_ms"),
        (k * 3 % 1000).alias("available_at_ms"),
        F.lit(None).cast("string").alias("last_error"),
    )


JOBS = """job AS (
  SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'review' ELSE 'index' END AS kind, o_orderkey AS entity_id,
         CAST(o_custkey % 3 AS INTEGER) AS entity_revision,
         ['pending', 'processing', 'completed', 'dead'][CAST(o_orderkey % 7 % 4 + 1 AS INTEGER)] AS state,
         CAST(o_orderkey % 5 AS INTEGER) AS attempts,
         CASE WHEN o_orderkey % 7 % 4 = 1 THEN 'w' || (o_orderkey % 3) END AS lease_owner,
         CASE WHEN o_orderkey % 7 % 4 = 1 THEN o_orderkey * 10 END AS lease_expires_ms,
         o_orderkey * 3 % 1000 AS available_at_ms, CAST(NULL AS VARCHAR) AS last_error
  FROM orders)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose media times run back now and then."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 97 != 0, F.col("event_id") - F.when(F.col("event_id") % 11 == 0, 40).otherwise(0)).alias("pts_ns"),
        (F.floor(F.col("event_id") / 500) + 1).cast("long").alias("generation"),
        (F.col("event_id") % 61 == 0).alias("discont"),
    )


FRAMES = """fr AS (
  SELECT event_type AS source_id, event_id AS seq,
         CASE WHEN event_id % 97 <> 0 THEN event_id - CASE WHEN event_id % 11 = 0 THEN 40 ELSE 0 END END AS pts_ns,
         event_id // 500 + 1 AS generation, event_id % 61 = 0 AS discont
  FROM events)"""


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (orders) with an array of boxes (line items) by arithmetic."""
    x, y = F.col("l_partkey") % 80 / 100.0, F.col("l_suppkey") % 80 / 100.0
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        F.struct(
            (F.col("l_partkey") % 2).cast("int").alias("class_id"),
            F.round(1 - F.col("l_discount") - F.col("l_tax") / 100, 6).alias("confidence"),
            x.alias("x1"),
            y.alias("y1"),
            (x + F.col("l_quantity") / 100).alias("x2"),
            (y + 0.3).alias("y2"),
        ).alias("box"),
    )
    return rows.groupBy("frame_id").agg(F.array_sort(F.collect_list("box")).alias("boxes"))


BOXES = """box AS (
  SELECT l_orderkey AS frame_id, CAST(l_partkey % 2 AS INTEGER) AS class_id, round(1 - l_discount - l_tax / 100, 6) AS confidence,
         l_partkey % 80 / 100.0 AS x1, l_suppkey % 80 / 100.0 AS y1,
         l_partkey % 80 / 100.0 + l_quantity / 100 AS x2, l_suppkey % 80 / 100.0 + 0.3 AS y2
  FROM lineitem)"""
