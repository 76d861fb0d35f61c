"""The ledger: events, detections, evidence, jobs, reviews and quarantine, which change together, version by version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.reviews import review_changes
from vigilake.sources.snapshots import Merge, Snapshots
from vigilake.sources.wire import decode_events, ledger_rows

#: Each table's key: a row that the table already holds isn't written again.
KEYS = {
    "events": ["event_id"],
    "detections": ["event_id", "class_name", "track_id", "confidence", "bbox"],
    "evidence": ["event_id", "kind", "path"],
    "jobs": ["kind", "entity_id", "entity_revision"],
    "reviews": ["event_id", "revision"],
    "quarantine": ["ingress_id"],
}


def open_ledger(spark: SparkSession, root: str, buckets: int = 64) -> Snapshots:
    """The ledger under `root`. All its writers have to name the same number of buckets."""
    return Snapshots(spark, root, KEYS, buckets)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as of the latest version."""
    return open_ledger(spark, root).table(name)


def job_rows(jobs: DataFrame) -> DataFrame:
    """New jobs in the columns of the jobs table; a job's id is the hash of its key."""
    return jobs.select(
        F.xxhash64(*KEYS["jobs"]).alias("job_id"), *KEYS["jobs"], "state", F.col("attempts").cast("int").alias("attempts"),
        F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("long").alias("lease_expires_ms"),
        F.col("available_at_ms").cast("long").alias("available_at_ms"), F.lit(None).cast("string").alias("last_error"),
    )


def recorded(decoded: DataFrame, now_ms: int) -> dict[str, Merge]:
    """What a batch of decoded messages adds to the ledger's tables; malformed and invalid messages go to quarantine."""
    rows = ledger_rows(decoded, now_ms)
    rows["jobs"] = job_rows(rows["jobs"])
    rows["quarantine"] = decoded.where("problem IS NOT NULL").select("ingress_id", "event", "problem")
    return {name: Merge(r) for name, r in rows.items()}


def record(ledger: Snapshots, ingress: DataFrame, now_ms: int, writer: str | None = None, batch: int | None = None) -> int:
    """Record messages in one version of all tables: no event is ever seen without its detections, evidence and jobs.

    Rows whose key a table holds stay as they are, so messages that come again change nothing. Messages are decoded once,
    into a staged table from which all the ledger's tables are made.
    """
    staged = f"{ledger.root}/staged/{uuid.uuid4().hex}"

    def step(_) -> dict[str, Merge]:
        decode_events(ingress).write.mode("overwrite").parquet(staged)
        return recorded(ledger.spark.read.parquet(staged), now_ms)

    try:
        return ledger.transact(step, writer, batch)
    finally:
        ledger.discard(staged)


def record_batch(root: str, now_ms: int, writer: str = "ingest"):
    """A foreachBatch writer. A batch that is replayed after a crash is known by its number and left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            record(open_ledger(batch.sparkSession, root), held, now_ms, writer, batch_id)
        finally:
            held.unpersist()

    return write


def complete(ledger: Snapshots, results: DataFrame, now_ms: int, writer: str | None = None, batch: int | None = None) -> int:
    """Finish reviews: all results that count change reviews, events and jobs in one version (`reviews.review_changes`),
    judged by the version that they change, so a lease that another writer ended in between refuses them."""

    def step(table) -> dict[str, Merge]:
        held = {name: table(name) for name in ("jobs", "events", "evidence")}
        changes = review_changes(results, held["jobs"], held["events"], held["evidence"], now_ms)
        waiting = job_rows(changes["waiting"])
        return {
            "reviews": Merge(changes["reviews"]), "events": Merge(changes["events"], "replace"),
            "jobs": Merge(changes["jobs"].unionByName(waiting.join(held["jobs"].select(*KEYS["jobs"]), KEYS["jobs"], "left_anti")), "replace"),
        }

    return ledger.transact(step, writer, batch)


def move_jobs(ledger: Snapshots, transition, writer: str | None = None, batch: int | None = None) -> int:
    """Change the jobs that `transition(jobs)` returns (one of operators.jobs' set transitions); only their buckets are
    written again."""
    return ledger.transact(lambda table: {"jobs": Merge(transition(table("jobs")), "replace")}, writer, batch)


def upsert_latest(current: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables' rows, of each key that of the greatest order."""
    both = current.unionByName(new, allowMissingColumns=True)
    others = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def same_dimension(points: DataFrame) -> DataFrame:
    """Points with a check column `ok`: whether the vector is as long as the table's shortest one."""
    return points.join(F.broadcast(points.agg(F.min(F.size("vector")).alias("_n"))), how="cross").withColumn("ok", F.size("vector") == F.col("_n")).drop("_n")
