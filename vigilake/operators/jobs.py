"""Durable work: claims, leases and retries as transitions of a job table at a given time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.operators.folds import ranked

#: Requests and jobs that meet in one task.
PART_ROWS = 100_000


def _set(jobs: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """The table with `values` where `hit` holds."""
    kept = {k: F.when(hit, v.cast(jobs.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()}
    return jobs.withColumns(kept)


def claimable(now_ms: int) -> Column:
    """Pending and due, or in work with a lease that has run out."""
    due = (F.col("state") == "pending") & (F.col("available_at_ms") <= now_ms)
    return due | ((F.col("state") == "processing") & (F.col("lease_expires_ms") <= now_ms))


def next_job(jobs: DataFrame, kind: str, now_ms: int) -> DataFrame:
    """The claimable job of the lowest id, or no row: each task keeps one row."""
    return jobs.where((F.col("kind") == kind) & claimable(now_ms)).orderBy("job_id").limit(1)


def claim(jobs: DataFrame, kind: str, owner: str, now_ms: int, lease_ms: int) -> DataFrame:
    """The table after `owner` has claimed the next job: one attempt more, a new lease."""
    chosen = next_job(jobs, kind, now_ms).select("job_id", F.lit(True).alias("_hit"))
    held = jobs.join(F.broadcast(chosen), "job_id", "left")  # one row at most
    hit = F.coalesce("_hit", F.lit(False))
    held = _set(
        held, hit, state=F.lit("processing"), attempts=F.col("attempts") + 1, lease_owner=F.lit(owner), lease_expires_ms=F.lit(now_ms + lease_ms)
    )
    return held.select(jobs.columns)


def holds_lease(job_id: int, owner: str, attempt: int, now_ms: int) -> Column:
    """Whether the row is this job in this attempt, under a lease of this owner that hasn't run out."""
    mine = (F.col("job_id") == job_id) & (F.col("lease_owner") == owner) & (F.col("attempts") == attempt)
    return mine & (F.col("state") == "processing") & (F.col("lease_expires_ms") > now_ms)


def renew(jobs: DataFrame, job_id: int, owner: str, attempt: int, now_ms: int, lease_ms: int) -> DataFrame:
    return _set(jobs, holds_lease(job_id, owner, attempt, now_ms), lease_expires_ms=F.lit(now_ms + lease_ms))


def complete(jobs: DataFrame, job_id: int, owner: str, attempt: int, now_ms: int) -> DataFrame:
    hit = holds_lease(job_id, owner, attempt, now_ms)
    return _set(jobs, hit, state=F.lit("completed"), lease_owner=F.lit(None), lease_expires_ms=F.lit(None))


def fail(jobs: DataFrame, job_id: int, owner: str, attempt: int, now_ms: int, delay_ms: int, max_retries: int, error: str) -> DataFrame:
    """Dead once the attempts reach the most allowed, else pending again after the delay."""
    hit = holds_lease(job_id, owner, attempt, now_ms)
    state = F.when(F.col("attempts") >= max_retries, "dead").otherwise("pending")
    return _set(
        jobs, hit, state=state, available_at_ms=F.lit(now_ms + delay_ms), last_error=F.lit(error), lease_owner=F.lit(None), lease_expires_ms=F.lit(None)
    )


def claim_many(jobs: DataFrame, requests: DataFrame, kind: str, now_ms: int, lease_ms: int) -> DataFrame:
    """The jobs that change as all `requests` (owner, and any column `asked` that orders them) claim one job each: the
    claimable job of the k-th lowest id goes to the k-th request, by `asked` and owner. Claimable jobs are due as in
    `claimable`. An owner that asks twice gets two. Both are numbered by ranges of their order, many tasks each."""
    asked = ranked(requests.select("owner", F.col("asked").cast("long").alias("asked")), ["asked", "owner"], "_k")
    free = ranked(jobs.where((F.col("kind") == kind) & claimable(now_ms)), ["job_id"], "_k")
    taken = free.join(asked, "_k")
    values = {"state": F.lit("processing"), "attempts": F.col("attempts") + 1, "lease_owner": F.col("owner"), "lease_expires_ms": F.lit(now_ms + lease_ms)}
    return taken.withColumns({k: v.cast(jobs.schema[k].dataType) for k, v in values.items()}).select(jobs.columns)


def _held(jobs: DataFrame, requests: DataFrame, now_ms: int, *more: str) -> DataFrame:
    """Each job that a request (job_id, owner, attempt) names under its own running lease, once, with the request's
    other columns; of requests alike the least counts. Requests of others fall away: their lease is lost.

    Requests and jobs are dealt once for both steps, into as many parts as they need, before requests are grouped: they
    are seldom alike, so a map of those that one task reads would hold them all."""
    running = jobs.where((F.col("state") == "processing") & (F.col("lease_expires_ms") > now_ms))
    parts = (jobs.count() + requests.count()) // PART_ROWS + 1
    key = {"_id": ("job_id", "job_id"), "_owner": ("owner", "lease_owner"), "_attempt": ("attempt", "attempts")}
    named = requests.select(*[F.col(a).alias(k) for k, (a, _) in key.items()], *more)
    asked = named.repartition(parts, *key).groupBy(*key).agg(F.min(F.struct(F.lit(0).alias("_zero"), *more)).alias("_more"))
    mine = reduce(and_, [F.col(b) == F.col(k) for k, (_, b) in key.items()])
    return running.repartition(parts, *[b for _, b in key.values()]).join(asked, mine)


def _changed(held: DataFrame, jobs: DataFrame, **values: Column) -> DataFrame:
    return held.withColumns({k: v.cast(jobs.schema[k].dataType) for k, v in values.items()}).select(jobs.columns)


def renew_many(jobs: DataFrame, requests: DataFrame, now_ms: int, lease_ms: int) -> DataFrame:
    """The jobs that change as `requests` (job_id, owner, attempt) renew their leases."""
    return _changed(_held(jobs, requests, now_ms), jobs, lease_expires_ms=F.lit(now_ms + lease_ms))


def complete_many(jobs: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """The jobs that change as `requests` (job_id, owner, attempt) finish."""
    return _changed(_held(jobs, requests, now_ms), jobs, state=F.lit("completed"), lease_owner=F.lit(None), lease_expires_ms=F.lit(None))


def fail_many(jobs: DataFrame, requests: DataFrame, now_ms: int, delay_ms: int, max_retries: int) -> DataFrame:
    """The jobs that change as `requests` (job_id, owner, attempt, error) fail: dead once the attempts reach the most
    allowed, else pending again after the delay. Of several errors of one attempt the least is kept."""
    state = F.when(F.col("attempts") >= max_retries, "dead").otherwise("pending")
    return _changed(
        _held(jobs, requests, now_ms, "error"), jobs, state=state, available_at_ms=F.lit(now_ms + delay_ms), last_error=F.col("_more.error"),
        lease_owner=F.lit(None), lease_expires_ms=F.lit(None),
    )


def lost_leases(jobs: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """The requests (job_id, owner, attempt) that `_many` transitions leave out."""
    running = jobs.where((F.col("state") == "processing") & (F.col("lease_expires_ms") > now_ms))
    running = running.select("job_id", F.col("lease_owner").alias("owner"), F.col("attempts").alias("attempt"))
    return requests.join(running, ["job_id", "owner", "attempt"], "left_anti")


def over_limit(jobs: DataFrame, max_retries: int) -> DataFrame:
    """Claimed jobs with more attempts than allowed become dead."""
    return _set(jobs, (F.col("state") == "processing") & (F.col("attempts") > max_retries), state=F.lit("dead"))


def stale(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Review jobs with `stale`: whether their revision isn't the event's; an unknown event is stale."""
    revisions = events.select(F.col("event_id").alias("entity_id"), F.col("revision").alias("_now"))
    held = jobs.join(revisions, "entity_id", "left")
    return held.withColumn("stale", ~F.coalesce(F.col("entity_revision") == F.col("_now"), F.lit(False))).drop("_now")


def rebuild_index(jobs: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """An index job for every event at its revision: missing ones are made, finished and dead ones start again, and
    those that wait or run stay."""
    want = events.select(F.lit("index").alias("kind"), F.col("event_id").alias("entity_id"), F.col("revision").alias("entity_revision"), F.lit(True).alias("_want"))
    both = jobs.join(want, ["kind", "entity_id", "entity_revision"], "full_outer")
    again = F.col("_want") & (F.col("job_id").isNull() | F.col("state").isin("completed", "dead"))
    both = _set(
        both, F.coalesce(again, F.lit(False)), state=F.lit("pending"), attempts=F.lit(0), available_at_ms=F.lit(now_ms), lease_owner=F.lit(None), lease_expires_ms=F.lit(None), last_error=F.lit(None)
    )
    return both.select(jobs.columns)


def keyset_page(entries: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows beyond a key, in its order."""
    rows = entries if after is None else entries.where(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def pending_summary(entries: DataFrame, idle_ms: int) -> DataFrame:
    """By consumer: entries, those idle long enough to be taken over, and the longest idle time."""
    return entries.groupBy("consumer").agg(
        F.count("*").alias("pending"), F.count_if(F.col("idle_ms") >= idle_ms).alias("reclaimable"), F.max("idle_ms").alias("longest_idle_ms")
    )
