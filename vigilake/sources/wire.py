"""Events on the wire: decoding, quarantine, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake import schemas
from vigilake.functions.ids import evidence_id


def read_ingress(spark: SparkSession, path: str, streaming: bool = False, max_files: int = 100) -> DataFrame:
    """Ingress messages from JSON lines, as a batch or as a stream whose checkpoint keeps what was read."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if streaming else spark.read
    return reader.schema(schemas.INGRESS).json(path)


def decode_events(ingress: DataFrame) -> DataFrame:
    """Messages with `ctx`, the event as a struct, and `problem`: null, malformed (no JSON object) or invalid.

    event_type falls back to type only where the key itself is absent; event_id falls back to the ingress id where it
    is absent or empty. Absent timeline fields stay null; source, timestamp_ms and frame_id become '', 0 and 0.
    """
    raw = F.from_json("event", schemas.WIRE, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys("event")
    held = ingress.withColumn("_raw", raw).withColumn("_keys", keys)
    malformed = F.col("_keys").isNull()
    c = lambda name: F.col(f"_raw.{name}")
    event_type = F.when(F.array_contains("_keys", "event_type"), c("event_type")).otherwise(c("type"))
    detections = F.transform(
        F.coalesce(c("detections"), F.from_json(F.lit("[]"), _field_type("detections"))),
        lambda d: F.struct(
            F.coalesce(d["class_name"], d["class"]).alias("class_name"),
            F.coalesce(d["class_id"], F.lit(-1)).alias("class_id"),
            d["confidence"].alias("confidence"),
            d["bbox"].alias("bbox"),
            F.coalesce(d["track_id"], F.lit(-1)).alias("track_id"),
            d["track_state"].alias("track_state"),
            F.coalesce(d["occluded"], F.lit(False)).alias("occluded"),
        ),
    )
    ident = F.when(F.coalesce(c("event_id"), F.lit("")) == "", F.col("ingress_id")).otherwise(c("event_id"))
    ctx = F.struct(
        ident.alias("event_id"),
        F.col("ingress_id").alias("ingress_id"),
        F.coalesce(c("source"), F.lit("")).alias("source"),
        F.coalesce(c("timestamp_ms"), F.lit(0)).alias("timestamp_ms"),
        F.coalesce(c("frame_id"), F.lit(0)).alias("frame_id"),
        F.coalesce(c("stream_generation"), c("generation")).alias("stream_generation"),
        F.coalesce(c("source_pts"), c("pts")).alias("source_pts"),
        event_type.alias("event_type"),
        c("severity").alias("severity"),
        c("rule_id").alias("rule_id"),
        c("rule_version").alias("rule_version"),
        F.to_json(c("rule_facts")).alias("rule_facts_json"),
        detections.alias("detections"),
        c("evidence").alias("evidence"),
    )
    invalid = F.exists(detections, lambda d: d["class_name"].isNull() | (F.size(d["bbox"]) != 4))
    problem = F.when(malformed, "malformed").when(F.coalesce(invalid, F.lit(True)), "invalid")
    return held.select("ingress_id", "event", F.when(~malformed, ctx).alias("ctx"), problem.alias("problem"))


def _field_type(name: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schemas.WIRE)[name].dataType.simpleString()


def encode_payload(frames: DataFrame) -> DataFrame:
    """Tracked frames (source_id, frame_id, timestamp_ms, objects) as the five-field JSON object on the wire."""
    states = F.array(*[F.lit(s) for s in schemas.TRACK_STATES])
    detections = F.transform(
        "objects",
        lambda o: F.struct(
            o["class_name"].alias("class"),
            o["class_id"].alias("class_id"),
            o["confidence"].alias("confidence"),
            F.array(o["x1"], o["y1"], o["x2"], o["y2"]).alias("bbox"),
            o["track_id"].alias("track_id"),
            F.get(states, o["track_state"]).alias("track_state"),
            o["occluded"].alias("occluded"),
        ),
    )
    payload = F.struct(F.lit("detection").alias("type"), F.col("source_id").alias("source"), "timestamp_ms", "frame_id", detections.alias("detections"))
    return frames.select("source_id", "frame_id", F.to_json(payload).alias("event"))


def ledger_rows(decoded: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """The ledger's tables from decoded messages without a problem. Rows that a table's key already holds are left out,
    the first by ingress id staying."""
    ctx = decoded.where("problem IS NULL").select("ctx.*")
    first = ctx.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in ctx.columns if c != "event_id"]), "ingress_id").alias("e"))
    first = first.select("event_id", "e.*")
    events = first.drop("detections", "evidence").withColumns(
        {"revision": F.lit(0), "status": F.lit("pending"), "verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "result_path": F.lit(None).cast("string"), "created_ms": F.lit(now_ms)}
    )
    det = first.select("event_id", F.posexplode("detections").alias("position", "d")).select("event_id", "position", "d.*")
    key = ["event_id", "class_name", "track_id", "confidence", "bbox"]
    det = det.groupBy(*key).agg(F.min_by(F.struct("position", "class_id", "track_state", "occluded"), "position").alias("d")).select(*key, "d.*")
    ev = first.select("event_id", F.explode("evidence").alias("v")).select("event_id", "v.*")
    ev = ev.dropDuplicates(["event_id", "kind", "path"]).withColumn("evidence_id", evidence_id(F.col("event_id"), F.col("kind"), F.col("path")))
    jobs = events.select(F.explode(F.array(F.lit("review"), F.lit("index"))).alias("kind"), F.col("event_id").alias("entity_id"), F.col("revision").alias("entity_revision"))
    jobs = jobs.withColumns({"state": F.lit("pending"), "attempts": F.lit(0), "available_at_ms": F.lit(now_ms)})
    return {"events": events, "detections": det, "evidence": ev, "jobs": jobs}


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, label) from a text file of labels: trimmed lines in order, without blank ones and comments.

    A label file is a few kilobytes, read as one row so that its lines keep their order.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\r\n|\r|\n").alias("lines"))
    kept = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return whole.select(F.posexplode(kept).alias("class_id", "label"))


def node_placement(trace: DataFrame) -> DataFrame:
    """Distinct (node, provider) of a profile's Node entries that name a provider, with `seen`, their number in the order
    of their first entries. A profile is one JSON array, read as one file in its order; its distinct nodes are few."""
    rows = trace.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.where((F.col("cat") == "Node") & (F.coalesce("args.provider", F.lit("")) != ""))
    first = rows.groupBy(F.col("name").alias("node"), F.col("args.provider").alias("provider")).agg(F.min("_at").alias("_at"))
    return first.select("node", "provider", F.row_number().over(Window.orderBy("_at")).alias("seen"))
