"""The message log: batch and stream, crashes on either side of a commit, consumers and trimming."""

import json

import pytest

from vigilake.sources import ledger
from vigilake.sources.messages import Log, MessageLog

SCHEMA = "ingress_id string, event string"


@pytest.fixture(scope="module")
def log_spark(spark):
    spark.dataSource.register(MessageLog)
    return spark


def put(spark, root, rows, parts=2):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.format("message_log").mode("append").save(root)


def read(spark, root):
    return sorted((r.ingress_id, r.event) for r in spark.read.format("message_log").load(root).collect())


def test_batches(log_spark, tmp_path):
    root = str(tmp_path / "log")
    put(log_spark, root, [(f"a{k}", f"é{k}\n") for k in range(10)])
    put(log_spark, root, [(None, "no id")])
    got = read(log_spark, root)
    assert len(got) == 11 and ("a3", "é3\n") in got and [i for i, e in got if e == "no id"] == [f"{Log(root).end() - 1}-0"]
    with pytest.raises(Exception, match="only ever added"):
        log_spark.createDataFrame([("x", "y")], SCHEMA).write.format("message_log").mode("overwrite").save(root)


def test_a_crash_between_note_and_renames_is_made_good(tmp_path):
    log = Log(str(tmp_path))
    log.write("staged/one.jsonl", b'{"ingress_id": "1", "event": "x"}\n')
    log.write("staged/two.jsonl", b'{"ingress_id": "2", "event": "y"}\n')
    log.write("notes/p-000000000000.json", json.dumps({"segments": [["one.jsonl", 0], ["two.jsonl", 1]]}).encode())
    assert log.end() == 2 and log.names("staged") == []
    log.write("staged/again.jsonl", b'{"ingress_id": "1", "event": "x"}\n')
    log.commit("p-000000000000", ["again.jsonl"])  # the batch is replayed
    assert log.end() == 2 and log.names("staged") == [] and log.names("segments") == ["000000000000.jsonl", "000000000001.jsonl"]


def run(spark, source, sink, check, consumer, write=None):
    rows = spark.readStream.format("message_log").option("path", source).option("consumer", consumer).load()
    out = rows.writeStream.option("checkpointLocation", check).trigger(availableNow=True)
    out = out.foreachBatch(write) if write else out.format("message_log").option("path", sink).option("producer", consumer)
    out.start().awaitTermination()


def test_streams_resume_without_loss_or_repeat(log_spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("source", "sink", "check"))
    for k in range(3):
        put(log_spark, source, [(f"{k}-{j}", f"m{k}{j}") for j in range(5)])
        run(log_spark, source, sink, check, "copy")
    run(log_spark, source, sink, check, "copy")
    assert read(log_spark, sink) == read(log_spark, source) and len(read(log_spark, sink)) == 15


def test_a_killed_reader_records_each_message_once(log_spark, tmp_path):
    source, check, store = str(tmp_path / "source"), str(tmp_path / "check"), ledger.open_ledger(log_spark, str(tmp_path / "ledger"), 2)
    event = lambda k: json.dumps({"event_id": f"e{k}", "source": "s", "timestamp_ms": k})
    put(log_spark, source, [(f"i{k}", event(k)) for k in range(4)])
    calls = []

    def dying(batch, batch_id):
        calls.append(batch_id)
        ledger.record(store, batch, 1, "reader", batch_id)
        if len(calls) == 1:
            raise RuntimeError("killed after the commit, before the offset was kept")

    with pytest.raises(Exception, match="killed"):
        run(log_spark, source, None, check, "reader", dying)
    put(log_spark, source, [("i9", event(9))])
    for _ in range(2):
        run(log_spark, source, None, check, "reader", dying)
    assert calls[0] == calls[1] == 0 and len(calls) == 3
    assert sorted(r.event_id for r in store.table("events").collect()) == ["e0", "e1", "e2", "e3", "e9"]
    assert store.version() == 2  # the replayed batch made no version


def test_trimming_waits_for_the_slowest_consumer(log_spark, tmp_path):
    source, check = str(tmp_path / "source"), tmp_path / "check"
    put(log_spark, source, [("a", "1"), ("b", "2")])
    log = Log(source)
    assert log.trim() == 0
    run(log_spark, source, str(tmp_path / "x"), str(check / "x"), "fast")
    put(log_spark, source, [("c", "3")], 1)
    run(log_spark, source, str(tmp_path / "x"), str(check / "x"), "fast")
    run(log_spark, source, str(tmp_path / "x"), str(check / "x"), "fast")
    log.write("consumers/slow.json", b'{"next": 1}')
    assert log.trim() == 1 and log.start() == 1 and log.trim() == 0
    assert len(read(log_spark, source)) == 2
    put(log_spark, source, [("d", "4")], 1)
    run(log_spark, source, str(tmp_path / "y"), str(check / "y"), "late")
    assert {i for i, _ in read(log_spark, str(tmp_path / "y"))} == {i for i, _ in read(log_spark, source)}
