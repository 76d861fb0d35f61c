"""Counters and window statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("queue_us", "device_us", "output_copy_us", "postprocess_us", "total_us")


def nearest_rank(column: str, percent: int) -> Column:
    """The nearest-rank percentile of whole numbers, 0 without values: a value that occurs, not an interpolated one."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column})"), F.lit(0)).cast("long")


def window_stats(samples: DataFrame, key: str, at: str, width: int, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Tumbling windows [start, start + width) of microseconds by key: completed, completed_fps, longest_gap (the
    starts and ends of windows count as results), and the 50th and 95th percentile of each stage."""
    windowed = samples.withColumn("window_start", (F.floor(F.col(at) / width) * width).cast("long"))
    w = Window.partitionBy(key, "window_start").orderBy(at)
    gap = F.col(at) - F.coalesce(F.lag(at).over(w), F.col("window_start"))
    windowed = windowed.withColumn("_gap", gap)
    percentiles = [nearest_rank(s, p).alias(f"{s.removesuffix('_us')}_p{p}") for s in stages for p in (50, 95)]
    return windowed.groupBy(key, "window_start").agg(
        F.count("*").alias("completed"),
        F.round(F.count("*") * 1e6 / width, 6).alias("completed_fps"),
        F.greatest(F.max("_gap"), F.col("window_start") + width - F.max(at)).alias("longest_gap"),
        *percentiles,
    )


def summarize(samples: DataFrame, started_us: int, ended_us: int, previous_us: int | None, received: int, dropped: int) -> DataFrame:
    """One window's statistics; the gap before the first result runs from the previous completion, if there was one."""
    w = Window.orderBy("completed_at_us")  # one window's samples
    since = F.lit(previous_us if previous_us is not None else started_us)
    gap = F.col("completed_at_us") - F.coalesce(F.lag("completed_at_us").over(w), since)
    span = ended_us - started_us
    return samples.withColumn("_gap", gap).agg(
        F.lit(received).alias("received"),
        F.lit(dropped).alias("dropped"),
        F.count("*").alias("completed"),
        (F.count("*") * 1e6 / span if span else F.lit(0.0)).alias("completed_fps"),
        F.greatest(F.coalesce(F.max("_gap"), F.lit(0)), F.lit(ended_us) - F.coalesce(F.max("completed_at_us"), since)).alias("longest_gap_us"),
        *[nearest_rank(s, p).alias(f"{s.removesuffix('_us')}_p{p}") for s in STAGES for p in (50, 95)],
    )


def outcome_counters(rows: DataFrame, key: str, column: str, outcomes: tuple[str, ...]) -> DataFrame:
    """How often each outcome occurs, a column each, in one aggregation."""
    counts = [F.count_if(F.col(column) == o).alias(o) for o in outcomes]
    return rows.groupBy(key).agg(*counts)


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, by `order`, of each combination of keys."""
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), order).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*")
