import hashlib
import math
import uuid

from pyspark.sql import functions as F

from vigilake.functions import ids, text
from vigilake.operators import detect

FRAMES = "tensor array<double>, n_rows int, source_w int, source_h int"


def found(spark, rows, w, h, canvas=(640, 640), threshold=0.5, **options):
    flat = [float(x) for r in rows for x in r]
    frames = spark.createDataFrame([(flat, len(rows), w, h)], FRAMES)
    objects = detect.detect(frames, "corners", 0, threshold, canvas, **options).first().objects
    return [(o.class_id, *[round(v, 4) for v in (o.x1, o.y1, o.x2, o.y2)]) for o in objects]


def test_boxes_map_back(spark):
    # 800 x 400 on 640 x 640: scale 0.8, 160 rows of padding above
    assert found(spark, [(160, 240, 480, 400, 0.7, 2)], 800, 400) == [(2, 0.25, 0.25, 0.75, 0.75)]
    box = F.array(F.struct(*[F.lit(v).alias(k) for k, v in {"x1": 9.0, "y1": 21.0, "x2": 57.0, "y2": 33.0}.items()]))
    fit = F.struct(F.lit(3.0).alias("scale"), F.lit(3).alias("pad_left"), F.lit(9).alias("pad_top"))
    back = spark.range(1).select(detect.unmap(box, fit, F.lit(20), F.lit(16))).first()[0][0]
    assert [round(v, 4) for v in back] == [0.1, 0.25, 0.9, 0.5]
    assert found(spark, [(-9, 5, 900, 640, 0.6, 1), (650, 1, 700, 9, 0.6, 1)], 320, 320) == [(1, 0.0, 0.0078, 1.0, 1.0)]


def test_suppression_before_clipping(spark):
    # on the canvas a third of the smaller box overlaps; inside the frame, which starts at row 160, half of it would
    rows = [(50, 20, 250, 260, 0.95, 0), (50, 200, 250, 320, 0.75, 0)]
    assert len(found(spark, rows, 800, 400)) == 2


def test_target_class(spark):
    rows = [(10, 10, 60, 60, 0.8, 3), (400, 10, 460, 70, 0.55, 5), (10, 400, 60, 460, 0.45, 5)]
    assert [b[0] for b in found(spark, rows, 640, 640, target=5)] == [5]


def test_other_forms(spark):
    anchors = [c for row in ([100.0, 300.0], [100.0, 300.0], [50.0, 50.0], [50.0, 50.0], [0.9, 0.2], [0.1, 0.8]) for c in row]
    df = spark.createDataFrame([(anchors,)], "t array<double>")
    got = df.select(detect.decode(F.col("t"), "anchors", F.lit(2), 2, 0.5, (640, 640))).first()[0]
    assert [(b.class_id, b.confidence, b.x1) for b in got] == [(0, 0.9, 75.0), (1, 0.8, 275.0)]
    rows = [100.0, 100.0, 50.0, 50.0, 0.5, 0.9, 0.1, 300.0, 300.0, 50.0, 50.0, 0.9, 0.2, 0.8]
    df = spark.createDataFrame([(rows,)], "t array<double>")
    got = df.select(detect.decode(F.col("t"), "objectness", F.lit(2), 2, 0.4, (640, 640))).first()[0]
    assert [(b.class_id, round(b.confidence, 2)) for b in got] == [(0, 0.45), (1, 0.72)]


def test_greedy_suppression_agrees_with_a_loop(spark):
    def overlap(a, b):
        w = max(0, min(a[4], b[4]) - max(a[2], b[2]))
        h = max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)

    boxes = [(k % 2, (k * 37 % 100) / 100, (k * 13 % 50) / 100, (k * 29 % 50) / 100, (k * 13 % 50) / 100 + 0.3, (k * 29 % 50) / 100 + 0.3) for k in range(60)]
    kept = []
    for b in sorted(boxes, key=lambda b: -b[1]):
        if len(kept) < 50 and not any(k[0] == b[0] and overlap(k, b) > 0.45 for k in kept):
            kept.append(b)
    df = spark.createDataFrame([(boxes,)], "b array<struct<class_id:int,confidence:double,x1:double,y1:double,x2:double,y2:double>>")
    got = [tuple(x) for x in df.select(detect.suppress(F.col("b"))).first()[0]]
    assert got == kept


def test_sanity(spark):
    nan, inf = float("nan"), float("inf")
    good = ("cup", 3, 0.25, 0.2, 0.3, 0.4, 0.6)
    change = lambda at, v: (*good[:at], v, *good[at + 1 :])
    bad = [change(k, v) for k in range(2, 7) for v in (nan, -inf)] + [change(2, -0.01), change(5, 0.2), change(4, 7.0)]
    rows = [good, *bad, change(1, -4), change(6, 3.0)]
    df = spark.createDataFrame([(rows,)], "b array<struct<class_name:string,class_id:int,confidence:double,x1:double,y1:double,x2:double,y2:double>>")
    got = df.select(detect.sane(F.col("b"))).first()[0]
    assert [tuple(o) for o in got] == [good, change(1, -1), change(6, 1.0)]


def test_identifiers(spark):
    row = spark.createDataFrame([("e", "t")], "e string, t string").select(
        ids.name_uuid(F.col("e")).alias("u"), ids.evidence_id(F.col("e"), F.lit("frame"), F.lit("/p")).alias("i"), ids.hash_embedding(F.col("t")).alias("v")
    ).first()
    assert row.u == str(uuid.uuid5(ids.POINTS, "e"))
    assert row.i == hashlib.sha256(b"e\0frame\0/p").hexdigest()
    seed, values = hashlib.sha256(b"t").digest(), []
    while len(values) < 64:
        seed = hashlib.sha256(seed).digest()
        values += [x / 255.0 * 2 - 1 for x in seed]
    size = math.sqrt(sum(x * x for x in values))
    assert max(abs(a - b / size) for a, b in zip(row.v, values, strict=True)) < 1e-9


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.log_value(F.lit("a/b:c-1.2_x"))) == "a/b:c-1.2_x"
    assert one(text.log_value(F.lit('a "b"\n\x01'))) == '"a \\"b\\"\\n\\u0001"'
    for bad in ("", "a b", "/abs", "..", "é", "n" * 200, "line\n"):
        assert one(text.safe_directory(F.lit(bad))) == "event-" + hashlib.sha256(bad.encode()).hexdigest()
    assert one(text.safe_directory(F.lit("evt-1.a"))) == "evt-1.a"
    assert one(text.object_summary(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == "a:1,b:2"
    assert one(text.object_summary(F.array().cast("array<string>"))) == "none"
    assert one(text.key_values(F.lit("a: 1\nb:2:3\nnone\na: 4"))) == {"a": "4", "b": "2:3"}
    assert one(text.without_fence(F.lit("```json\n{}\n```"))) == "{}"
    assert one(text.milliseconds(F.lit(3046))) == "3.046"


def test_records_fit():
    from vigilake.functions.records import fit_record

    line = fit_record(["event", "message", "reason"], ["stopped", '"' + "é" * 40 + '"', '"' + "\\u0001" * 20 + '"'], 140)
    assert len(line.encode()) <= 140 and line.startswith("event=stopped message=") and "record_truncated=true" in line
    reason = line.split("reason=")[1].split(" ")[0]
    assert reason[0] == reason[-1] == '"' and (len(reason) - 2) % 6 == 0  # escapes stay whole, and go first
    assert fit_record(["event"], ["x"], 8) == "event=x\n"


def test_canonical_json(spark):
    import json

    row = {"b": "é🙂\"", "a": None, "c": 5}
    df = spark.createDataFrame([(row["b"], None, 5)], "b string, a string, c int")
    got = df.select(ids.canonical_json({k: F.col(k) for k in row})).first()[0]
    assert got == json.dumps(row, sort_keys=True, separators=(",", ":"))
