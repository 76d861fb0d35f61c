"""Severity, contracts and counters of the pipeline's records, as conditional columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities in order, and those of event kinds; a diagnostic has its own, any other kind warns.
SEVERITIES = ("info", "warning", "error", "fatal")
INFO_KINDS = ("runtime_resolved", "inference_stats")


def severity(kind: Column, source_severity: Column) -> Column:
    """A record's severity by its kind."""
    diagnostic = F.when(F.coalesce(source_severity == "error", F.lit(False)), "error").otherwise("warning")
    return F.when(kind == "fatal_error", "fatal").when(kind == "native_diagnostic", diagnostic).when(kind.isin(*INFO_KINDS), "info").otherwise("warning")


def severe_enough(found: Column, least: str) -> Column:
    """Whether a record passes a filter of at least `least`; a fatal one always does."""
    ranks = F.array(*[F.lit(s) for s in SEVERITIES])
    return (F.array_position(ranks, found) > SEVERITIES.index(least)) | (found == "fatal")


def contract_violation(expected: Column, seen: Column) -> Column:
    """The first of eight rules that an observed stream breaks, or null.

    `expected` has allowed (memory kinds), format, width and height (0: any) and needs_allocator; `seen` has format,
    caps (memory kinds), width, height, allocator (or null) and buffers (memory kinds).
    """
    allowed = F.coalesce(expected["allowed"], F.array().cast("array<string>"))
    outside = lambda kinds: F.size(F.array_except(F.coalesce(kinds, F.array().cast("array<string>")), allowed)) > 0
    sized = (expected["width"] > 0) & (expected["height"] > 0)
    return (
        F.when(F.size(allowed) == 0, "expected memory set is empty")
        .when(~seen["format"].eqNullSafe(expected["format"]), "pixel format does not match")
        .when(F.coalesce(F.size(seen["caps"]), F.lit(0)) <= 0, "caps memory was not observed")
        .when(sized & ((seen["width"] != expected["width"]) | (seen["height"] != expected["height"])), "frame dimensions do not match")
        .when(outside(seen["caps"]), "caps memory does not match")
        .when(expected["needs_allocator"] & seen["allocator"].isNull(), "allocator memory was not observed")
        .when(seen["allocator"].isNotNull() & ~F.array_contains(allowed, seen["allocator"]), "allocator memory does not match")
        .when(outside(seen["buffers"]), "buffer memory does not match")
    )


def class_count_problem(form: str, shape: tuple[int, ...], n_labels: int) -> str | None:
    """Why a model's output of this form and shape doesn't go with so many labels, or None."""
    if len(shape) != 3:
        return "the output must have three dimensions"
    counts = {"corners": n_labels, "anchors": shape[1] - 4, "objectness": shape[2] - 5}
    if form not in counts:
        return f"no such form: {form}"
    return None if counts[form] == n_labels else f"class count mismatch: model={counts[form]} labels={n_labels}"


def scheduler_counters(tasks: DataFrame, key: str) -> DataFrame:
    """By key, of tasks (state, queue_us, device_us): submitted, how many ended how, and the longest times."""
    ended = ("completed", "replaced", "cancelled", "failed")
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ended]
    return tasks.groupBy(key).agg(F.count("*").alias("submitted"), *counts, F.max("queue_us").alias("max_queue_us"), F.max("device_us").alias("max_device_us"))


def overlay_counters(displays: DataFrame, key: str) -> DataFrame:
    """By key, of displayed frames (age_ns or null without a snapshot, boxes, predicted, timed_out, clipped, invalid):
    hits and misses, boxes of each kind, and the ages' sum and maximum over frames that show a box."""
    shown = F.when(F.col("boxes") > 0, F.col("age_ns"))
    return displays.groupBy(key).agg(
        F.count("age_ns").alias("hits"),
        F.count_if(F.col("age_ns").isNull()).alias("misses"),
        F.sum("predicted").alias("predicted_boxes"),
        F.sum(F.col("boxes") - F.col("predicted")).alias("observed_boxes"),
        *[F.sum(c).alias(f"{c}_boxes") for c in ("timed_out", "clipped", "invalid")],
        F.coalesce(F.sum(shown), F.lit(0)).alias("age_total_ns"),
        F.coalesce(F.max(shown), F.lit(0)).alias("max_age_ns"),
    )


def delivery_counters(records: DataFrame, least: str = "info", most_bytes: int = 16_384) -> DataFrame:
    """One row of counts over log records (severity, n_bytes, accepted): emitted, filtered out, rejected, truncated."""
    passes = severe_enough(F.col("severity"), least)
    return records.agg(
        F.count_if(passes & F.col("accepted")).alias("emitted"),
        F.count_if(~passes).alias("filtered"),
        F.count_if(passes & ~F.col("accepted")).alias("rejected"),
        F.count_if(passes & F.col("accepted") & (F.col("n_bytes") > most_bytes)).alias("truncated"),
    )


def published_frames(submissions: DataFrame) -> DataFrame:
    """What each submission (status, detections) publishes: its detections once completed, none once failed; replaced
    and cancelled ones publish nothing."""
    kept = submissions.where(F.col("status").isin("completed", "failed"))
    return kept.withColumn("detections", F.when(F.col("status") == "completed", F.col("detections")).otherwise(F.filter("detections", lambda d: F.lit(False))))


def display_rect(view: Column, box: Column) -> Column:
    """A box in shares of a frame as (x, y, width, height) inside a view (x, y, width, height), or null without area."""
    unit = lambda v: F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(1.0))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    x1, y1, x2, y2 = (unit(box[c]) for c in ("x1", "y1", "x2", "y2"))
    ok = (view["width"] > 0) & (view["height"] > 0) & finite(box["x1"]) & finite(box["y1"]) & finite(box["x2"]) & finite(box["y2"]) & (x2 > x1) & (y2 > y1)
    made = F.struct(
        (view["x"] + x1 * view["width"]).alias("x"), (view["y"] + y1 * view["height"]).alias("y"),
        ((x2 - x1) * view["width"]).alias("width"), ((y2 - y1) * view["height"]).alias("height"),
    )
    return F.when(ok, made)


def display_label(class_name: Column, track_id: Column, confidence: Column) -> Column:
    """`name #id 0.00`, in at most 127 characters."""
    return F.substring(F.format_string("%s #%d %.2f", class_name, track_id, confidence), 1, 127)


def cleanup_totals(pages: DataFrame, key: str) -> DataFrame:
    """Pages of a clean-up, entries seen and acknowledged."""
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.sum("seen").alias("seen"), F.sum("acked").alias("acked"))


def stream_summary(entries: DataFrame, key: str) -> DataFrame:
    """By stream: entries, those delivered and not acknowledged, and whether any wait."""
    pending = F.count_if(F.col("delivered") & ~F.col("acked"))
    return entries.groupBy(key).agg(F.count("*").alias("length"), pending.alias("pending"), F.when(pending > 0, "pending").otherwise("clear").alias("status"))
