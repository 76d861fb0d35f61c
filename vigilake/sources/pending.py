"""Deliveries that nobody has acknowledged: taken over page by page, and swept, with the cursor kept in a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.folds import ranked
from vigilake.operators.jobs import keyset_page
from vigilake.sources.messages import Log
from vigilake.sources.snapshots import Merge, Snapshots

KEYS = {"entries": ["message_id"], "cursors": ["name"]}


def open_pending(spark: SparkSession, root: str, buckets: int = 16) -> Snapshots:
    """The store of `entries` (message_id, consumer, delivered_ms, deliveries) and of the `cursors` over them."""
    return Snapshots(spark, root, KEYS, buckets)


def deliver(store: Snapshots, messages: DataFrame, consumer: str, now_ms: int) -> int:
    """Note that messages (message_id) were handed to a consumer; those that are noted already stay as they are."""
    rows = messages.select("message_id", F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("long").alias("delivered_ms"), F.lit(1).alias("deliveries"))
    return store.transact(lambda _: {"entries": Merge(rows)})


def acknowledge(store: Snapshots, messages: DataFrame) -> int:
    return store.transact(lambda _: {"entries": Merge(messages.select("message_id"), "drop")})


def _cursor(table, name: str):
    rows = table("cursors")
    found = None if rows is None else rows.where(F.col("name") == name).first()
    return None if found is None else found["after"]


def _moved(store: Snapshots, name: str, after) -> Merge:
    return Merge(store.spark.createDataFrame([(name, after)], "name string, after string"), "replace")


def _reclaimed(store: Snapshots, consumer: str, idle_ms: int, now_ms: int, page: int, taken: Callable) -> None:
    """Take over a page. `taken` gets the idle entries' ids behind the cursor and gives the page's last one and its size."""

    def step(table) -> dict[str, Merge]:
        entries = table("entries")
        if entries is None:
            return {}
        after = _cursor(table, consumer)
        idle = entries.where(F.col("delivered_ms") <= now_ms - idle_ms)
        idle = idle if after is None else idle.where(F.col("message_id") > after)
        last, many = taken(idle.select("message_id"))
        if not many:
            return {"cursors": _moved(store, consumer, None)}
        rows = idle.where(F.col("message_id") <= last).withColumns(
            {"consumer": F.lit(consumer), "delivered_ms": F.lit(now_ms).cast("long"), "deliveries": F.col("deliveries") + 1}
        )
        return {"entries": Merge(rows, "replace"), "cursors": _moved(store, consumer, last if many == page else None)}

    store.transact(step)


def reclaim(store: Snapshots, consumer: str, idle_ms: int, now_ms: int, page: int = 1_000) -> list:
    """Take over the next page of entries that were delivered `idle_ms` or longer ago, in order of their ids; the ids.

    The page begins behind the cursor that is kept for the consumer, which goes back to the start after a page that isn't
    full. Cursor and entries change in one version, so a crash loses no page and takes none twice. The ids come to the
    driver; where pages are large, `reclaim_page` keeps them on the cluster.
    """
    ids: list = []

    def taken(idle: DataFrame) -> tuple:
        ids[:] = [r[0] for r in keyset_page(idle, "message_id", None, page).collect()]  # at most a page
        return (ids[-1] if ids else None), len(ids)

    _reclaimed(store, consumer, idle_ms, now_ms, page, taken)
    return ids


def reclaim_page(store: Snapshots, consumer: str, idle_ms: int, now_ms: int, page: int) -> int:
    """`reclaim` for pages of any size: how many entries were taken over. Of the ids only the page's last one comes to the
    driver, and no task sorts the whole page."""
    many = 0

    def taken(idle: DataFrame) -> tuple:
        nonlocal many
        last, many = ranked(idle, ["message_id"], "_k").where(F.col("_k") <= page).agg(F.max("message_id"), F.count("*")).first()
        return last, many

    _reclaimed(store, consumer, idle_ms, now_ms, page, taken)
    return many


@dataclass(frozen=True)
class Swept:
    """What a sweep found and did."""

    pending_before: int
    acknowledged: int = 0
    trimmed: int = 0
    dry_run: bool = False


class SweepFailed(RuntimeError):
    """A sweep that broke off; `done` is what it had done by then, and the next sweep goes on from there."""

    def __init__(self, message: str, done: Swept):
        super().__init__(message)
        self.done = done


def sweep(store: Snapshots, log: Log | None = None, page: int = 100_000, dry_run: bool = False) -> Swept:
    """Acknowledge all entries, a page a version, and then trim the log of what all its consumers are past."""
    entries = store.table("entries")
    done = Swept(0 if entries is None else entries.count(), dry_run=dry_run)
    if dry_run:
        return done
    try:
        while entries is not None:
            ids = keyset_page(entries.select("message_id"), "message_id", None, page)
            before = entries.count()
            if not before:
                break
            acknowledge(store, ids)
            entries = store.table("entries")
            done = replace(done, acknowledged=done.acknowledged + before - entries.count())
        return done if log is None else replace(done, trimmed=log.trim())
    except Exception as problem:
        raise SweepFailed(str(problem), done) from problem
