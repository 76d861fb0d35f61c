import json

from vigilake import schemas
from vigilake.operators import jobs
from vigilake.sources import ledger, wire
from vigilake.streaming import ingest


def messages(spark, rows):
    return spark.createDataFrame([(i, json.dumps(e) if isinstance(e, dict) else e) for i, e in rows], schemas.INGRESS)


DETECTION = {"class": "forklift", "class_id": 5, "confidence": 0.81, "bbox": [12, 20, 64, 90], "track_id": 31}


def test_decoding(spark):
    rows = [
        ("m9", {"event_id": "gate-3", "stream_generation": 5, "pts": 81, "type": "shown", "event_type": "chosen", "detections": [DETECTION]}),
        ("m10", {"type": "only-type", "event_id": ""}), ("m11", {"type": "hidden", "event_type": None}), ("m12", "[1, 2"), ("m13", {"detections": [{"class": "cup", "bbox": [1, 2, 3]}]}),
    ]
    got = {r.ingress_id: r for r in wire.decode_events(messages(spark, rows)).collect()}
    first, second = got["m9"].ctx, got["m10"].ctx
    assert (first.event_id, first.stream_generation, first.source_pts, first.event_type) == ("gate-3", 5, 81, "chosen")
    assert (second.event_id, second.event_type, second.stream_generation, second.source_pts, second.source) == ("m10", "only-type", None, None, "")
    assert got["m11"].ctx.event_type is None
    assert [got[k].problem for k in ("m9", "m12", "m13")] == [None, "malformed", "invalid"]


def test_payload(spark):
    schema = f"source_id string, frame_id bigint, timestamp_ms bigint, objects array<{schemas.TRACKED}>"
    frame = ("c", 170, 1, [("person", 0, 0.9, 0.1, 0.2, 0.3, 0.4, 12, 1, True)])
    got = json.loads(wire.encode_payload(spark.createDataFrame([frame], schema)).first().event)
    assert set(got) == {"type", "source", "timestamp_ms", "frame_id", "detections"} and len(got["detections"][0]) == 7
    assert got["detections"][0]["track_state"] == "MATCHED"


def test_streamed_ledger_is_idempotent(spark, tmp_path):
    event = {"event_id": "dock-8/77", "source": "dock-8", "timestamp_ms": 1_688_000_123_000, "frame_id": 907, "detections": [DETECTION, DETECTION]}
    rows = [("1-0", event), ("2-0", event), ("3-0", "no json")]
    messages(spark, rows).coalesce(1).write.json(str(tmp_path / "in"))
    for turn in range(2):  # the second run has a new checkpoint, so it records everything again
        source = wire.read_ingress(spark, str(tmp_path / "in"), streaming=True)
        ingest.ingest(source, str(tmp_path / "ledger"), str(tmp_path / f"check{turn}"), 5).awaitTermination()
    read = lambda name: ledger.read_table(spark, str(tmp_path / "ledger"), name)
    assert [r.event_id for r in read("events").collect()] == ["dock-8/77"]
    assert read("detections").count() == 1
    assert sorted(r.kind for r in read("jobs").collect()) == ["index", "review"]
    assert read("quarantine").count() == 1


def test_cooldown_stream_matches_batch(spark, tmp_path):
    schema = "event_id string, ingress_id string, source string, track_id bigint, timestamp_ms bigint"
    rows = [(f"e{k}", str(k), "c", k % 3, 1_700_000_000_000 + k * 4_000) for k in range(60)]  # a first watermark is 0, at which rows are late
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = ingest.cooldown_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), 30_000)
    query = stream.writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id for r in spark.table("taken").where("taken").collect()}
    from vigilake.operators.cooldown import consumer_cooldown

    assert got == {r.event_id for r in consumer_cooldown(spark.createDataFrame(rows, schema), 30_000).where("decision = 'RUN'").collect()}


def job(spark, *rows):
    return spark.createDataFrame([(*r,) for r in rows], schemas.JOB)


def test_retry_to_dead_and_fencing(spark):
    table = job(spark, (1, "review", "evt-1", 0, "pending", 0, None, None, 0, None))
    one = jobs.claim(table, "review", "a", 0, 10)
    assert jobs.next_job(one, "review", 5).count() == 0
    assert jobs.next_job(one, "review", 11).count() == 1
    failed = jobs.fail(one, 1, "a", 1, 5, 0, 2, "x").first()
    assert (failed.state, failed.last_error) == ("pending", "x")
    again = jobs.claim(one, "review", "b", 11, 10)
    assert jobs.complete(again, 1, "a", 1, 12).first().state == "processing"
    assert jobs.fail(again, 1, "b", 2, 12, 0, 2, "x").first().state == "dead"
    assert jobs.complete(again, 1, "b", 2, 12).first().state == "completed"
    assert jobs.renew(again, 1, "b", 2, 12, 100).first().lease_expires_ms == 112


def test_labels(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("person\n\n# no\n helmet \n")
    got = wire.read_labels(spark, str(tmp_path / "labels.txt")).orderBy("class_id").collect()
    assert [tuple(r) for r in got] == [(0, "person"), (1, "helmet")]


def test_settings(tmp_path):
    from dataclasses import dataclass

    import pytest

    from vigilake.sources.settings import read_settings

    @dataclass
    class Limits:
        rate: int = 15
        name: str = "x"
        quiet: bool = False

    file = tmp_path / "a.yaml"
    file.write_text("# limits\nrate: 20  # frames\nquiet: true\n")
    assert read_settings(Limits(), ["/none", str(file)], "V", {"V_NAME": "y"}) == Limits(20, "y", True)
    file.write_text("rat: 20")
    with pytest.raises(ValueError):
        read_settings(Limits(), [str(file)], "V", {})


def test_publish_and_listing(spark, tmp_path):
    from vigilake.operators.reviews import list_files, refresh_evidence
    from vigilake.sources.settings import publish

    spark.createDataFrame([("{}",), ("{}",)], "event string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("event string").json(str(tmp_path / "in"))
    publish(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.bin").write_bytes(b"12345")
    held = spark.createDataFrame([(str(tmp_path / "e" / n), True, 0, 0.0) for n in ("a.bin", "b.bin")], "path string, available boolean, size bigint, mtime double")
    got = {r.path[-5:]: (r.available, r.size) for r in refresh_evidence(held, list_files(spark, str(tmp_path / "e"))).collect()}
    assert got == {"a.bin": (True, 5), "b.bin": (False, None)}


def test_windowed_stream(spark, tmp_path):
    rows = [("c", f"2024-01-01 00:00:{k:02d}", k * 10) for k in range(0, 60, 3)] + [("c", "2024-01-01 01:00:00", 1)]
    spark.createDataFrame(rows, "source_id string, ts string, total_us bigint").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, ts timestamp, total_us bigint").json(str(tmp_path / "in"))
    query = ingest.windowed_stats(stream).writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("windows").orderBy("window_start").collect()
    assert len(got) == 12 and sum(r.completed for r in got) == 20 and (got[1].p50, got[1].p95) == (60, 90)
