"""Versions of several tables: atomic, replayable, migrated, and read without a shuffle."""

import json

import pytest

from vigilake import schemas
from vigilake.operators import jobs
from vigilake.sources import ledger, pending
from vigilake.sources.snapshots import Conflict, Merge, Snapshots


def messages(spark, names):
    box = {"class": "van", "class_id": 2, "confidence": 0.7, "bbox": [5, 6, 7, 8], "track_id": 4}
    seen = [{"kind": "clip", "path": "/data/x.mp4", "available": True}]
    rows = [(f"in-{n}", json.dumps({"event_id": n, "source": "yard", "timestamp_ms": 9, "detections": [box], "evidence": seen})) for n in names]
    return spark.createDataFrame(rows, schemas.INGRESS)


def counts(store, version=None):
    tables = store.manifest(version)["tables"]
    return {name: store.table(name, version).count() for name in tables if store.table(name, version).count()}


def test_a_batch_that_dies_between_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    store = ledger.open_ledger(spark, str(tmp_path), 4)
    assert ledger.record(store, messages(spark, ["a"]), 1, "w", 0) == 1
    written, merged = [], Snapshots._merged

    def dying(self, name, entry, change):
        if len(written) == 2:
            raise RuntimeError("killed")
        written.append(name)
        return merged(self, name, entry, change)

    monkeypatch.setattr(Snapshots, "_merged", dying)
    with pytest.raises(RuntimeError, match="killed"):
        ledger.record(store, messages(spark, ["b", "c"]), 2, "w", 1)
    monkeypatch.undo()
    assert store.version() == 1 and counts(store) == {"events": 1, "detections": 1, "evidence": 1, "jobs": 2}
    for _ in range(2):  # the replay commits once
        assert ledger.record(store, messages(spark, ["b", "c"]), 2, "w", 1) == 2
    assert counts(store) == {"events": 3, "detections": 3, "evidence": 3, "jobs": 6}
    assert counts(store, 1) == {"events": 1, "detections": 1, "evidence": 1, "jobs": 2}
    assert ledger.record(store, messages(spark, ["c", "d"]), 3, "w", 2) == 3  # c is known already
    assert {r.event_id: r.created_ms for r in store.table("events").collect()} == {"a": 1, "b": 2, "c": 2, "d": 3}


def test_merges(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), {"t": ["k"]}, 3)
    rows = lambda *r: spark.createDataFrame(r, "k string, at int, v string")
    read = lambda: {r.k: (r.at, r.v) for r in store.table("t").collect()}
    store.transact(lambda _: {"t": Merge(rows(("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")))})
    store.transact(lambda _: {"t": Merge(rows(("a", 9, "new"), ("c", 2, "q"), ("c", 1, "p")))})
    assert read() == {"a": (1, "x"), "b": (1, "y"), None: (1, "z"), "c": (1, "p")}
    store.transact(lambda _: {"t": Merge(rows(("a", 0, "r"), (None, 3, "n")), "replace")})
    assert read() == {"a": (0, "r"), "b": (1, "y"), None: (3, "n"), "c": (1, "p")}
    store.transact(lambda _: {"t": Merge(rows(("a", 0, "tie"), ("b", 0, "old"), ("c", 5, "late"), ("c", 4, "less")), "at")})
    assert read() == {"a": (0, "r"), "b": (1, "y"), None: (3, "n"), "c": (5, "late")}
    before = {f["bucket"]: f["path"] for f in store.manifest()["tables"]["t"]["files"]}
    store.transact(lambda _: {"t": Merge(rows(("a", 7, "s")), "replace")})
    after = {f["bucket"]: f["path"] for f in store.manifest()["tables"]["t"]["files"]}
    assert sum(before[b] != after[b] for b in before) == 1  # other buckets' files stay
    store.transact(lambda _: {"t": Merge(rows())})
    assert read()["a"] == (7, "s")


def test_reading_needs_no_shuffle_and_old_rows_have_the_new_column(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), {"t": ["k"]}, 4)
    rows = spark.createDataFrame([(k, k * 10) for k in range(20)], "k int, v int")
    store.transact(lambda _: {"t": Merge(rows)})
    version = store.migrate("t", "w", "bigint", "v + 1")
    assert store.migrate("t", "w", "bigint", "0") == version
    assert {r.k: r.w for r in store.table("t").collect()} == {k: 10 * k + 1 for k in range(20)}
    store.transact(lambda _: {"t": Merge(spark.createDataFrame([(3, 1, 100)], "k int, v int, w bigint"), "replace")})
    store.migrate("t", "x", "string", "concat('w', w)")
    got = {r.k: (r.w, r.x) for r in store.table("t").collect()}
    assert got == {k: (10 * k + 1, f"w{10 * k + 1}") for k in range(20)} | {3: (100, "w100")}
    assert "w" not in store.table("t", 1).columns
    assert "Exchange" not in store.table("t")._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="nothing"):
        store.migrate("t", "y", "int", "nothing + 1")


def test_writers_at_once(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), {"t": ["k"]}, 2)
    row = lambda k: Merge(spark.createDataFrame([(k,)], "k int"))
    turns = []

    def slow(table):
        """Another writer commits while this one is at work, twice."""
        turns.append(0 if table("t") is None else table("t").count())
        if len(turns) <= 2:
            store.transact(lambda _: {"t": row(10 + len(turns))})
        return {"t": row(1)}

    assert store.transact(slow) == 3 and turns == [0, 1, 2]
    assert sorted(r.k for r in store.table("t").collect()) == [1, 11, 12]

    def always(table):
        store.transact(lambda _: {"t": row(100 + store.version())})
        return {"t": row(2)}

    with pytest.raises(Conflict):
        store.transact(always, tries=2)


def test_expiry(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), {"t": ["k"]}, 2)
    for k in range(5):
        store.transact(lambda _, k=k: {"t": Merge(spark.createDataFrame([(j, k) for j in range(8)], "k int, v int"), "replace")})
    assert store.expire(2, older_than_ms=10**9) == 0 and store.expire(2, older_than_ms=-10_000) == 3
    assert {r.v for r in store.table("t").collect()} == {4} and store.table("t", 4).count() == 8
    assert store.version() == 5


def test_reviews_and_jobs_change_together(spark, tmp_path):
    store = ledger.open_ledger(spark, str(tmp_path), 4)
    ledger.record(store, messages(spark, ["a", "b", "c"]), 1)
    workers = spark.createDataFrame([("w1", 1), ("w2", 2), ("w3", 0)], "owner string, asked int")
    ledger.move_jobs(store, lambda table: jobs.claim_many(table, workers, "review", 5, 100))
    held = {r.entity_id: r for r in store.table("jobs").where("kind = 'review'").collect()}
    order = sorted(held.values(), key=lambda r: r.job_id)
    assert [r.lease_owner for r in order] == ["w3", "w1", "w2"] and {r.attempts for r in order} == {1}
    schema = "job_id bigint, owner string, attempt int, event_id string, revision int, verdict string, confidence double, evidence_status string, explanation string, evidence_ids array<string>, claims array<struct<text:string,evidence_ids:array<string>>>"
    say = lambda r, owner, revision=0: (r.job_id, owner, 1, r.entity_id, revision, "uncertain", 0.5, "available", "seen", [], [])
    good, stolen, late = order
    results = spark.createDataFrame([say(good, "w3"), say(good, "w3"), say(stolen, "nobody"), say(late, "w2", 4)], schema)
    for _ in range(2):
        version = ledger.complete(store, results, 50, "reviews", 7)
    assert version == store.version() == 3
    after = {r.event_id: (r.revision, r.status) for r in store.table("events").collect()}
    assert after == {e: (1, "completed") if e == good.entity_id else (0, "pending") for e in "abc"}
    assert [(r.event_id, r.revision, r.verdict) for r in store.table("reviews").collect()] == [(good.entity_id, 1, "uncertain")]
    states = {(r.kind, r.entity_id, r.entity_revision): r.state for r in store.table("jobs").collect()}
    assert states["review", good.entity_id, 0] == "completed" and states["index", good.entity_id, 1] == "pending" and len(states) == 7
    assert sorted(s for (kind, _, _), s in states.items() if kind == "review") == ["completed", "processing", "processing"]


def test_set_transitions(spark):
    rows = [(k, "review", f"e{k}", 0, "processing", 1 + k % 3, f"w{k % 2}", 100, 0, None) for k in range(6)] + [(9, "review", "e9", 0, "processing", 1, "w1", 40, 0, None)]
    table = spark.createDataFrame(rows, schemas.JOB)
    asked = spark.createDataFrame([(0, "w0", 1, "x"), (0, "w0", 1, "a"), (1, "w0", 2, "x"), (2, "w0", 3, "z"), (3, "w1", 2, "y"), (9, "w1", 1, "late"), (77, "w1", 1, "none"), (None, None, None, None)], "job_id long, owner string, attempt int, error string")
    got = {r.job_id: (r.state, r.available_at_ms, r.last_error) for r in jobs.fail_many(table, asked, 50, 7, 3).collect()}
    assert got == {0: ("pending", 57, "a"), 2: ("dead", 57, "z")}
    assert {r.job_id: r.lease_expires_ms for r in jobs.renew_many(table, asked, 50, 30).collect()} == {0: 80, 2: 80}
    done = jobs.complete_many(table, asked, 50).collect()
    assert {(r.job_id, r.state, r.lease_owner, r.lease_expires_ms) for r in done} == {(0, "completed", None, None), (2, "completed", None, None)}
    assert sorted((r.job_id is None, r.job_id) for r in jobs.lost_leases(table, asked, 50).collect() if r.job_id is not None) == [(False, 1), (False, 3), (False, 9), (False, 77)]
    free = table.withColumn("state", table.kind.substr(20, 1)).selectExpr("job_id", "kind", "entity_id", "entity_revision", "'pending' AS state", "attempts", "lease_owner", "lease_expires_ms", "available_at_ms", "last_error")
    many = spark.createDataFrame([(f"v{k}", k % 4) for k in range(12)], "owner string, asked int")
    assert [(r.job_id, r.lease_owner) for r in jobs.claim_many(free, many, "review", 50, 30).orderBy("job_id").collect()] == [(0, "v0"), (1, "v4"), (2, "v8"), (3, "v1"), (4, "v5"), (5, "v9"), (9, "v10")]
    assert jobs.claim_many(free, many.limit(0), "review", 50, 30).count() == 0


def test_drop(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), {"t": ["k"]}, 3)
    store.transact(lambda _: {"t": Merge(spark.createDataFrame([(k, "x") for k in [*range(9), None]], "k int, v string"))})
    store.transact(lambda _: {"t": Merge(spark.createDataFrame([(1,), (2,), (None,), (77,)], "k int"), "drop")})
    assert sorted(r.k for r in store.table("t").collect()) == [0, 3, 4, 5, 6, 7, 8]
    store.transact(lambda _: {"t": Merge(store.table("t"), "drop")})
    assert store.table("t").count() == 0 and store.manifest()["tables"]["t"]["files"] == []


def entries(spark, store, n=25):
    rows = spark.createDataFrame([(f"{k:03}",) for k in range(n)], "message_id string")
    pending.deliver(store, rows.where("message_id < '010'"), "old", 100)
    pending.deliver(store, rows, "new", 900)


def test_reclaim_goes_on_behind_its_cursor(spark, tmp_path):
    store = pending.open_pending(spark, str(tmp_path), 3)
    assert pending.reclaim(store, "me", 500, 1_000) == []
    entries(spark, store)
    pages = [pending.reclaim(store, "me", 500, 1_000, 4)]
    again = pending.open_pending(spark, str(tmp_path), 3)  # another process
    pages += [pending.reclaim(again, "me", 500, 1_000, 4) for _ in range(3)]
    assert [len(p) for p in pages] == [4, 4, 2, 0] and sum(pages, []) == [f"{k:03}" for k in range(10)]
    held = {r.message_id: (r.consumer, r.delivered_ms, r.deliveries) for r in store.table("entries").collect()}
    assert held["003"] == ("me", 1_000, 2) and held["020"] == ("new", 900, 1)
    assert pending.reclaim(store, "you", 100, 1_000, 4) == ["010", "011", "012", "013"]
    pending.acknowledge(store, store.table("entries").where("message_id >= '012'"))
    assert pending.reclaim(store, "you", 0, 2_000, 4) == []  # behind its cursor nothing is left, so it goes back
    assert len(pending.reclaim(store, "you", 0, 2_000, 50)) == 12


def test_sweep_reports_what_it_did_before_it_broke_off(spark, tmp_path, monkeypatch):
    store = pending.open_pending(spark, str(tmp_path), 3)
    assert pending.sweep(store) == pending.Swept(0)
    entries(spark, store)
    assert pending.sweep(store, dry_run=True) == pending.Swept(25, dry_run=True) and store.table("entries").count() == 25
    real, calls = pending.acknowledge, []

    def dying(store, rows):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("gone")
        return real(store, rows)

    monkeypatch.setattr(pending, "acknowledge", dying)
    with pytest.raises(pending.SweepFailed) as broke:
        pending.sweep(store, page=10)
    assert broke.value.done == pending.Swept(25, 20) and store.table("entries").count() == 5
    assert pending.sweep(store, page=10) == pending.Swept(5, 5)
