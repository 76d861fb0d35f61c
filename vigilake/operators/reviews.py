"""Finishing reviews: one step from checked results to history, events, evidence and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.cases import broken_contract


def refresh_evidence(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence with available, size and mtime as `files` (path, size, mtime) now has them; an unlisted path isn't
    available and has neither."""
    now = files.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    held = evidence.drop("available", "size", "mtime").join(now.dropDuplicates(["_path"]), F.col("path") == F.col("_path"), "left")
    return held.withColumnsRenamed({"_size": "size", "_mtime": "mtime"}).withColumn("available", F.col("_path").isNotNull()).drop("_path")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime in seconds) of the files under a folder, by their listing alone: no content is read. Files without
    content aren't listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def judge_results(results: DataFrame, jobs: DataFrame, events: DataFrame, evidence: DataFrame, now_ms: int) -> DataFrame:
    """Results (job_id, owner, attempt, event_id, revision, and a review's columns) with `refused`, or null where the
    result counts: `lease` where the job isn't this owner's attempt any more or its lease has run out, `revision` where
    the event has moved on, a rule of the review contract, or `evidence` where it names what the event hasn't available.

    Of several results of one job the first by owner counts, the others are `lease`.
    """
    held = jobs.select(
        "job_id", F.col("kind").alias("_kind"), F.col("entity_id").alias("_entity"), F.col("entity_revision").alias("_revision"), F.col("state").alias("_state"),
        F.col("lease_owner").alias("_owner"), F.col("attempts").alias("_attempts"), F.col("lease_expires_ms").alias("_expires"),
    )
    rows = results.join(held, "job_id", "left")
    rows = rows.join(events.select("event_id", F.col("revision").alias("_now")), "event_id", "left")
    there = evidence.where("available").groupBy("event_id").agg(F.collect_set("evidence_id").alias("_there"))
    rows = rows.join(there, "event_id", "left")
    mine = (F.col("_kind") == "review") & (F.col("_entity") == F.col("event_id")) & (F.col("_revision") == F.col("revision"))
    mine = mine & (F.col("_state") == "processing") & (F.col("_owner") == F.col("owner")) & (F.col("_attempts") == F.col("attempt")) & (F.col("_expires") > now_ms)
    none = F.array().cast("array<string>")
    dangling = F.size(F.array_except(F.coalesce("evidence_ids", none), F.coalesce("_there", none))) > 0
    refused = (
        F.when(~F.coalesce(mine, F.lit(False)), "lease")
        .when(~F.coalesce(F.col("_now") == F.col("revision"), F.lit(False)), "revision")
        .otherwise(F.coalesce(broken_contract(), F.when(dangling, "evidence")))
    )
    first = F.min(F.struct("owner", "attempt")).alias("_first")
    rows = rows.withColumn("refused", refused)
    chosen = rows.where("refused IS NULL").groupBy("job_id").agg(first)
    rows = rows.join(chosen, "job_id", "left")
    late = F.col("refused").isNull() & (F.struct("owner", "attempt") != F.col("_first"))
    return rows.withColumn("refused", F.when(late, "lease").otherwise(F.col("refused"))).select(*results.columns, "refused")


def review_changes(results: DataFrame, jobs: DataFrame, events: DataFrame, evidence: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """The rows that all results that count change: `reviews` (new ones, of the event's next revision), `events` and
    `jobs` as they are after, `waiting` (an index job for each new revision) and `refused`, the other results."""
    judged = judge_results(results, jobs, events, evidence, now_ms)
    good = judged.where("refused IS NULL")
    new = good.withColumn("revision", (F.col("revision") + 1).cast("int")).withColumn("parsed_at_ms", F.lit(now_ms).cast("long"))
    said = new.select("event_id", F.struct("revision", "verdict", "confidence").alias("_new"))
    said = said.groupBy("event_id").agg(F.min("_new").alias("_new"))  # an event has one review job at a revision
    after = events.join(said, "event_id")
    for c, value in (("revision", F.col("_new.revision")), ("status", F.lit("completed")), ("verdict", F.col("_new.verdict")), ("confidence", F.col("_new.confidence"))):
        after = after.withColumn(c, value.cast(events.schema[c].dataType))
    done = jobs.join(good.select("job_id"), "job_id", "left_semi")
    for c, value in (("state", "completed"), ("lease_owner", None), ("lease_expires_ms", None)):
        done = done.withColumn(c, F.lit(value).cast(jobs.schema[c].dataType))
    waiting = new.select(
        F.lit("index").alias("kind"), F.col("event_id").alias("entity_id"), F.col("revision").alias("entity_revision"), F.lit("pending").alias("state"),
        F.lit(0).alias("attempts"), F.lit(now_ms).cast("long").alias("available_at_ms"),
    ).distinct()
    return {
        "reviews": new.drop("job_id", "owner", "attempt", "refused"), "events": after.select(events.columns), "jobs": done.select(jobs.columns),
        "waiting": waiting, "refused": judged.where("refused IS NOT NULL"),
    }


def complete_reviews(
    results: DataFrame, jobs: DataFrame, events: DataFrame, reviews: DataFrame, evidence: DataFrame, now_ms: int
) -> dict[str, DataFrame]:
    """The tables `reviews`, `events` and `jobs` after all results that count, and `refused`, the others with their reason.

    A result appends a review of the event's next revision; the event takes its verdict and confidence and is completed;
    the job is finished without a lease; and an index job for the new revision waits, unless there is one. Nothing of a
    refused result is written. `ledger.complete` makes the same change in one version of the stored tables.
    """
    judged = judge_results(results, jobs, events, evidence, now_ms)
    good = judged.where("refused IS NULL")
    new = good.withColumn("revision", (F.col("revision") + 1).cast("int")).withColumn("parsed_at_ms", F.lit(now_ms).cast("long"))
    shared = [c for c in reviews.columns if c in new.columns]
    history = reviews.unionByName(new.select(*shared), allowMissingColumns=True)

    said = new.select("event_id", F.struct("revision", "verdict", "confidence").alias("_new"))
    after = events.join(said, "event_id", "left")
    for c, value in (("revision", F.col("_new.revision")), ("status", F.lit("completed")), ("verdict", F.col("_new.verdict")), ("confidence", F.col("_new.confidence"))):
        after = after.withColumn(c, F.when(F.col("_new").isNotNull(), value).otherwise(F.col(c)))

    done = good.select("job_id", F.lit(True).alias("_done"))
    table = jobs.join(done, "job_id", "left")
    for c, value in (("state", "completed"), ("lease_owner", None), ("lease_expires_ms", None)):
        table = table.withColumn(c, F.when(F.col("_done"), F.lit(value)).otherwise(F.col(c)))
    waiting = new.select(F.lit("index").alias("kind"), F.col("event_id").alias("entity_id"), F.col("revision").alias("entity_revision"))
    key = ["kind", "entity_id", "entity_revision"]
    waiting = waiting.join(jobs.select(*key), key, "left_anti").withColumns(
        {"state": F.lit("pending"), "attempts": F.lit(0), "available_at_ms": F.lit(now_ms).cast("long")}
    )
    table = table.select(jobs.columns).unionByName(waiting, allowMissingColumns=True)
    return {"reviews": history, "events": after.select(events.columns), "jobs": table, "refused": judged.where("refused IS NOT NULL")}


def event_view(cases: DataFrame) -> DataFrame:
    """What a reader of a case is shown: all but where evidence lies and what identifies rows."""
    evidence = F.transform("evidence", lambda e: e.dropFields("path"))
    return cases.withColumn("evidence", evidence)


def review_of(reviews: DataFrame, event_id) -> DataFrame:
    """The latest review of one event, or no row."""
    return reviews.where(F.col("event_id") == event_id).orderBy(F.desc("revision")).limit(1)


def readable_evidence(evidence: DataFrame, event_id, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """An event's available evidence, of the kinds asked for, in order of its ids."""
    found = evidence.where((F.col("event_id") == event_id) & F.col("available"))
    return (found if kinds is None else found.where(F.col("kind").isin(*kinds))).orderBy("evidence_id")


def reviews_of(reviews: DataFrame, asked: DataFrame) -> DataFrame:
    """For each of `asked` (event_id) its latest review's columns and `found`, whether there is one."""
    others = [c for c in reviews.columns if c != "event_id"]
    latest = reviews.groupBy(F.col("event_id").alias("_id")).agg(F.max_by(F.struct(*others), "revision").alias("_r"))
    held = asked.join(latest, F.col("event_id") == F.col("_id"), "left")
    return held.select(*asked.columns, F.col("_id").isNotNull().alias("found"), "_r.*")


def readable_evidence_of(evidence: DataFrame, asked: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The available evidence of all of `asked` (event_id), of the kinds asked for."""
    found = evidence.where("available") if kinds is None else evidence.where(F.col("available") & F.col("kind").isin(*kinds))
    return found.join(asked.select("event_id").distinct(), "event_id", "left_semi")
