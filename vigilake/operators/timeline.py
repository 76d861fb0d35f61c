"""Order in media time: as-of lookups, guards against stale frames, generations, bounded history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators.folds import carried, last_known, sliced, within


def asof_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, horizon: int) -> DataFrame:
    """Each left row with `found`, the latest right row (a struct) of its keys with left.at - horizon <= right.at <=
    left.at, or null.

    Rows are dealt by key and a time slice as long as the horizon; a right row goes into its own slice and the next, so
    no key's rows need to meet in one task. At equal times the right row of the greatest struct counts.
    """
    others = [c for c in right.columns if c not in keys]
    r = right.select(*keys, F.struct(at, *[c for c in others if c != at]).alias("found"), F.col(at).alias("_t"))
    r = r.withColumn("_slice", F.explode(F.array(_slice("_t", horizon), _slice("_t", horizon) + 1)))
    row = F.struct(*left.columns).alias("_row")
    l = left.select(*keys, F.col(at).alias("_t"), _slice(at, horizon).alias("_slice"), row)  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    seen = Window.partitionBy(*keys, "_slice").orderBy("_t", F.col("_row").isNotNull(), "found")
    latest = F.last("found", ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, 0))
    joined = both.withColumn("_last", latest).where(F.col("_row").isNotNull())
    fresh = F.col(f"_last.{at}") >= F.col("_t") - horizon
    return joined.select("_row.*", F.when(fresh, F.col("_last")).alias("found"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, slice_width: int) -> DataFrame:
    """Each left row with `found`, the latest right row (a struct) of its keys at or before it, however old, or null.

    Inside a time slice this is a running last; each slice also hands on the last right row before it, which is one row
    a key and slice. `slice_width` decides how much of a key meets in one task.
    """
    others = [c for c in right.columns if c not in (*keys, at)]
    r = right.select(*keys, F.struct(at, *others).alias("found"), F.col(at).alias("_t"), _slice(at, slice_width).alias("_slice"))
    l = left.select(*keys, F.col(at).alias("_t"), _slice(at, slice_width).alias("_slice"), F.struct(*left.columns).alias("_row"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_slice").orderBy("_t", F.col("_row").isNotNull(), "found")
    latest = F.last("found", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_last", latest).where(F.col("_row").isNotNull())
    slices = both.groupBy(*keys, "_slice").agg(F.max("found").alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    same = [rows[k].eqNullSafe(slices[k]) for k in (*keys, "_slice")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(slices, condition, "left").select("_row.*", F.coalesce("_last", "_before").alias("found"))


def _slice(at: str, width: int) -> Column:
    return F.floor(F.col(at) / F.lit(width)).cast("long")


#: Arrivals of a source that meet in one task.
ARRIVALS = 100_000


def guard(
    frames: DataFrame, order: str = "seq", generation: int | None = None, source: str | None = None, arrivals: int = ARRIVALS
) -> DataFrame:
    """Frames with `outcome`: published, no_pts, wrong_source, wrong_generation, duplicate_pts or stale_pts, by arrival.

    A frame is accepted if its pts is beyond all accepted before it in its source and generation. Rejected frames never
    exceed that maximum, so the running maximum over all earlier frames is the same. It runs in slices of `order` (a
    number), each of which starts from the maximum of those before it.
    """
    ok = F.col("pts_ns").isNotNull()
    if source is not None:
        ok = ok & (F.col("source_id") == source)
    if generation is not None:
        ok = ok & (F.col("generation") == generation)
    key, accepted = ["source_id", "generation"], F.when(ok, F.col("pts_ns"))
    frames = carried(sliced(frames, order, arrivals), key, {"_end": F.max(accepted)}, {"_end": F.max})
    here = F.max(accepted).over(within(key, order).rowsBetween(Window.unboundedPreceding, -1))
    high = F.greatest(here, F.col("_end"))
    outcome = F.when(F.col("pts_ns").isNull(), "no_pts")
    if source is not None:
        outcome = outcome.when(F.col("source_id") != source, "wrong_source")
    if generation is not None:
        outcome = outcome.when(F.col("generation") != generation, "wrong_generation")
    outcome = outcome.when(F.col("pts_ns") == F.col("_high"), "duplicate_pts").when(F.col("pts_ns") < F.col("_high"), "stale_pts")
    return frames.withColumn("_high", high).withColumn("outcome", outcome.otherwise("published")).drop("_high", "_end", "_slice")


def generations(buffers: DataFrame, order: str = "seq", arrivals: int = ARRIVALS) -> DataFrame:
    """Buffers with `generation`, from 1: a discontinuity or a pts below the one before it opens a new one, and equal
    causes in a row open one together. Slices of `order` hand on the last pts, the last cause and the count."""
    key, w = ["source_id"], within(["source_id"], order)
    latest = F.max_by("pts_ns", F.when(F.col("pts_ns").isNotNull(), F.col(order)))
    rows = carried(sliced(buffers, order, arrivals), key, {"_pts": latest}, {"_pts": last_known})
    held = F.coalesce(last_known(F.col("pts_ns")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_pts"))
    rows = rows.withColumn("_kind", F.when(F.col("discont"), "discont").when(F.col("pts_ns") < held, "rollback"))
    cause = F.struct("_kind")  # never null itself, so that a buffer without a cause is handed on too
    rows = carried(rows, key, {"_last": F.max_by(cause, order)}, {"_last": last_known})
    before = F.coalesce(F.lag(cause).over(w), F.col("_last"))
    opens = F.col("_kind").isNotNull() & ~F.col("_kind").eqNullSafe(before["_kind"])
    rows = rows.withColumn("_opens", opens.cast("long"))
    rows = carried(rows, key, {"_sum": F.sum("_opens")}, {"_sum": F.sum})
    count = 1 + F.sum("_opens").over(w) + F.coalesce("_sum", F.lit(0))
    return rows.withColumn("generation", count).drop("_slice", "_pts", "_kind", "_last", "_opens", "_sum")


def history_depth(frames: DataFrame, most: int = 64, span_ns: int = 2_000_000_000) -> DataFrame:
    """Frames with `depth`, the frames that a history of at most `most`, none over `span_ns` older, then holds."""
    # a frame counts in its own slice and, for the frames of the next, as one of those before
    rows = sliced(frames, "pts_ns", max(1, span_ns)).withColumn("_copy", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = rows.withColumn("_slice", F.col("_slice") + F.col("_copy").cast("long"))
    held = F.count("*").over(within(["source_id", "generation"], "pts_ns").rangeBetween(-span_ns, 0))
    rows = rows.withColumn("depth", F.least(held, F.lit(most)).cast("long"))
    return rows.where(~F.col("_copy")).drop("_copy", "_slice")


def current_generation(frames: DataFrame) -> DataFrame:
    """Frames of the latest generation of their source."""
    latest = frames.groupBy("source_id").agg(F.max("generation").alias("generation"))
    return frames.join(latest, ["source_id", "generation"], "left_semi")
