"""Rules in an inverted index, files by content, index texts, labels and placements."""

import hashlib
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from vigilake.functions import text
from vigilake.functions.registry import retrieve_rules
from vigilake.operators import detect, reviews, rules
from vigilake.sources import wire
from vigilake.sources.artifacts import write_artifacts

RULES = [
    ("r1", "Helmets", "Workers wear a helmet on the site. A helmet is hard."), ("r2", "Vests", "Workers wear a vest"), ("r3", "Gates", "Gates stay shut at night"),
    ("r4", "Empty", None), ("r5", "Twins", "Workers wear a vest"),
]
ASKED = [(1, "Who must wear a HELMET?"), (2, "vest workers vest"), (3, "nothing fits"), (4, None), (5, "night-gates, helmet")]


def brute(passages, asked, k):
    words = {c: re.findall(r"\w+", (t or "").lower()) for c, t in passages.items()}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    out = set()
    for q, question in asked:
        scores = {}
        for term in set(re.findall(r"\w+", (question or "").lower())):
            df = sum(term in w for w in words.values())
            for c, w in words.items():
                if term in w:
                    tf = w.count(term)
                    scores[c] = scores.get(c, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        for rank, (c, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], 1):
            out.add((q, c, round(s, 5), rank))
    return out


def test_rules_match_brute_force_and_can_be_replaced(spark, tmp_path):
    store = rules.open_rules(spark, str(tmp_path), 3)
    frame = lambda rows: spark.createDataFrame(rows, "rule_id string, title string, text string")
    rules.ingest(store, rules.chunks_of(frame(RULES)))
    asked = spark.createDataFrame(ASKED, "question_id int, question string")
    got = lambda k: {(r.question_id, r.chunk_id, round(r.score, 5), r["rank"]) for r in rules.retrieve(store, asked, k).collect()}
    passages = {f"{r}#0": t for r, _, t in RULES}
    assert got(2) == brute(passages, ASKED, 2) and got(10) == brute(passages, ASKED, 10)
    rules.ingest(store, rules.chunks_of(frame([("r1", "Boots", "Boots only")])))
    passages["r1#0"] = "Boots only"
    assert got(10) == brute(passages, ASKED, 10) and not any(c == "r1#0" for _, c, _, _ in got(10))
    said = {r.question_id: r.said for r in rules.explain(rules.retrieve(store, asked, 2)).collect()}
    assert said[2] == "rule 2: Vests; Twins"
    assert rules.retrieve(store, asked.limit(0), 3).count() == 0
    assert [(r.question_id, r.chunk_id, r.text) for r in retrieve_rules(asked.limit(1)).collect()] == [(1, "mock-0", ASKED[0][1])]


def test_chunks(spark):
    got = rules.chunks_of(spark.createDataFrame([("a", "t", " ".join(f"w{k}" for k in range(7))), ("b", "t", "  ")], "rule_id string, title string, text string"), 3)
    assert {(r.chunk_id, r.text) for r in got.collect()} == {("a#0", "w0 w1 w2"), ("a#1", "w3 w4 w5"), ("a#2", "w6"), ("b#0", "")}


def test_artifacts_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one", "x"), (2, "two", "y"), (3, "one", "z"), (4, None, "w"), (5, "", "v")], "event_id int, content string, size string")
    root = str(tmp_path / "files")
    for _ in range(2):
        got = {r.event_id: r for r in write_artifacts(rows.select("event_id", "content"), root).collect()}
    digest = hashlib.sha256(b"one").hexdigest()
    assert got[1].path == got[3].path == f"{root}/{digest[:2]}/{digest}.json" and got[1].sha256 == digest
    assert (got[4].path, got[4].size) == (None, None) and got[5].size == 0
    files = [p for p in (tmp_path / "files").rglob("*") if p.is_file() and p.suffix == ".json"]
    assert len(files) == 3 and {p.read_bytes() for p in files} == {b"one", b"two", b""}
    (tmp_path / "files" / digest[:2] / f"{digest}.json").write_bytes(b"cut")  # as a crash of something else might leave it
    (tmp_path / "files" / digest[:2] / f"{digest}.json").write_bytes(b"o")
    write_artifacts(rows.select("event_id", "content"), root).collect()
    assert (tmp_path / "files" / digest[:2] / f"{digest}.json").read_bytes() == b"one"
    held = spark.createDataFrame([(r.path, False, 0, 0.0) for r in got.values() if r.path] + [("/gone", True, 1, 0.0)], "path string, available boolean, size bigint, mtime double")
    found = reviews.refresh_evidence(held, reviews.list_files(spark, root))
    assert sorted(((r.available, r.size) for r in found.where("path <> '/gone'").collect()), key=str) == [(False, None), (True, 3), (True, 3), (True, 3)]  # empty files aren't listed
    assert not found.where("path = '/gone'").first().available


def test_index_text_has_all_fields(spark):
    row = ("e", "cam", 5, None, "r1", "v2", "high", '{"a":1}', [("van",), (None,), ("van",)], [(True,), (False,), (None,)], "compliant", 1e-05, "", "missing")
    kinds = "event_id string, source string, timestamp_ms long, event_type string, rule_id string, rule_version string, severity string, rule_facts string, detections array<struct<class_name:string>>, evidence array<struct<available:boolean>>, verdict string, confidence double, review_verdict string, evidence_status string"
    frame = spark.createDataFrame([row], kinds)
    said = frame.select(text.index_text({c: F.col(c) for c in frame.columns}).alias("t")).first().t
    assert said == 'event_id=e source=cam timestamp_ms=5 event_type= rule_id=r1 rule_version=v2 severity=high objects=unknown:1,van:2 rule_facts={"a":1} available_evidence=1 evidence_status=missing verdict=compliant confidence=1e-05'
    values = [0.0, 1.0, 0.1, 1e-4, 9.99e-5, 1.5e-7, 123456789.0, 1e7, 12345678.5, 1e15, 1e16, 0.001, 0.00012345, -1234567890.125, 0.30000000000000004]
    made = spark.createDataFrame([(v,) for v in values], "v double").select(text.python_float(F.col("v")).alias("t")).collect()
    assert [r.t for r in made] == [repr(v) for v in values]


def test_target_class_and_placement(spark, tmp_path):
    assert detect.target_class(["a", "b", "a"], "a") == 0 and detect.target_class(["a"], "") is None
    with pytest.raises(ValueError, match="no label 'x'"):
        detect.target_class(["a"], "x")
    entries = [("Node", "n2", "P"), ("Node", "n1", "P"), ("Other", "n0", "P"), ("Node", "n2", "P"), ("Node", "n3", ""), ("Node", "n1", "Q")]
    (tmp_path / "p.json").write_text(json.dumps([{"cat": c, "name": n, "args": {"provider": p}} for c, n, p in entries]))
    trace = spark.read.option("multiLine", True).json(str(tmp_path / "p.json"))
    assert [(r.node, r.provider) for r in wire.node_placement(trace).orderBy("seen").collect()] == [("n2", "P"), ("n1", "P"), ("n1", "Q")]


def test_latest_reviews_and_readable_evidence(spark):
    held = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "event_id string, revision int, verdict string")
    asked = spark.createDataFrame([("a",), ("b",)], "event_id string")
    assert {(r.event_id, r.found, r.verdict) for r in reviews.reviews_of(held, asked).collect()} == {("a", True, "z"), ("b", False, None)}
    seen = spark.createDataFrame([("a", "1", "clip", True), ("a", "2", "frame", True), ("a", "3", "clip", False), ("c", "4", "clip", True)], "event_id string, evidence_id string, kind string, available boolean")
    assert {r.evidence_id for r in reviews.readable_evidence_of(seen, asked).collect()} == {"1", "2"}
    assert {r.evidence_id for r in reviews.readable_evidence_of(seen, asked, ("clip",)).collect()} == {"1"}
