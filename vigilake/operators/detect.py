"""Detections: sanity, letterbox geometry, overlap, suppression, and decoding of raw tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Overlap above which the weaker box of a class goes, and boxes at most that stay.
OVERLAP, MOST = 0.45, 50


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def _unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def sane(objects: Column) -> Column:
    """Detections whose numbers are finite, confidence in 0..1 and area positive once clamped to the unit square;
    class and track ids are at least -1, states outside 0..3 become 0."""

    def good(o: Column) -> Column:
        numbers = _finite(o["confidence"]) & _finite(o["x1"]) & _finite(o["y1"]) & _finite(o["x2"]) & _finite(o["y2"])
        area = (_unit(o["x2"]) > _unit(o["x1"])) & (_unit(o["y2"]) > _unit(o["y1"]))
        return numbers & o["confidence"].between(0.0, 1.0) & area

    def mended(o: Column) -> Column:
        for side in ("x1", "y1", "x2", "y2"):
            o = o.withField(side, _unit(o[side]))
        return o.withField("class_id", F.greatest(o["class_id"], F.lit(-1)))

    return F.transform(F.filter(objects, good), mended)


def sane_tracked(objects: Column) -> Column:
    """`sane`, and the same for what a tracker adds."""
    return F.transform(
        sane(objects),
        lambda o: o.withField("track_id", F.greatest(o["track_id"], F.lit(-1))).withField(
            "track_state", F.when(o["track_state"].between(0, 3), o["track_state"]).otherwise(0)
        ),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union has no area."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda o: F.greatest(F.lit(0.0), o["x2"] - o["x1"]) * F.greatest(F.lit(0.0), o["y2"] - o["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def suppress(boxes: Column, overlap: float = OVERLAP, most: int = MOST) -> Column:
    """Greedy suppression inside an array of boxes: by confidence, then place, a box stays unless a box of its class
    that stays overlaps it by more than `overlap`; at most `most` stay."""
    ranked = F.transform(boxes, lambda b, i: F.struct((-b["confidence"]).alias("rank"), i.alias("place"), b.alias("box")))
    ordered = F.transform(F.array_sort(ranked), lambda r: r["box"])
    none = F.filter(boxes, lambda b: F.lit(False))
    return F.aggregate(
        ordered,
        none,
        lambda kept, b: F.when(
            (F.size(kept) < most) & ~F.exists(kept, lambda k: (k["class_id"] == b["class_id"]) & (iou(k, b) > overlap)),
            F.concat(kept, F.array(b)),
        ).otherwise(kept),
    )


def letterbox(source_w: Column, source_h: Column, model_w: Column, model_h: Column) -> Column:
    """How a source frame fits a model's canvas: scale and the padding of each side."""
    wide = source_w.cast("long") * model_h >= source_h.cast("long") * model_w
    scale = F.when(wide, model_w / source_w).otherwise(model_h / source_h)
    fit = lambda size, most: F.least(F.greatest(F.floor(size * scale + 0.5).cast("int"), F.lit(1)), most)
    pad_x = model_w - F.when(wide, model_w).otherwise(fit(source_w, model_w))
    pad_y = model_h - F.when(wide, fit(source_h, model_h)).otherwise(model_h)
    left, top = F.floor(pad_x / 2).cast("int"), F.floor(pad_y / 2).cast("int")
    return F.struct(
        scale.alias("scale"),
        left.alias("pad_left"),
        top.alias("pad_top"),
        (pad_x - left).cast("int").alias("pad_right"),
        (pad_y - top).cast("int").alias("pad_bottom"),
    )


def unmap(boxes: Column, fit: Column, source_w: Column, source_h: Column) -> Column:
    """Boxes on the model's canvas as shares of the source frame, clamped; boxes without area go."""

    def back(b: Column) -> Column:
        for side, pad, size in (("x1", "pad_left", source_w), ("y1", "pad_top", source_h), ("x2", "pad_left", source_w), ("y2", "pad_top", source_h)):
            b = b.withField(side, _unit((b[side] - fit[pad]) / fit["scale"] / size))
        return b

    return F.filter(F.transform(boxes, back), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))


def label(class_id: Column, labels: list[str]) -> Column:
    """The class's name, else `class_<n>`, in at most 31 characters."""
    named = F.when(class_id >= 0, F.get(F.array(*[F.lit(x) for x in labels]), class_id))
    return F.substring(F.coalesce(named, F.concat(F.lit("class_"), class_id.cast("string"))), 1, 31)


def best_class(scores: Column) -> Column:
    """(class_id, score) of the first greatest score above 0; class -1 and score 0 if there is none."""
    top = F.array_max(scores)
    found = F.struct((F.array_position(scores, top) - 1).cast("int").alias("class_id"), top.cast("double").alias("score"))
    none = F.struct(F.lit(-1).alias("class_id"), F.lit(0.0).alias("score"))
    return F.when(top > 0, found).otherwise(none)


def _rows(tensor: Column, rows: Column, width: Column, pick) -> Column:
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda i: pick(i, width))


def _corner(cx: Column, cy: Column, w: Column, h: Column, pixels: Column, width: int, height: int) -> dict[str, Column]:
    """Corners on the canvas; rows that aren't in pixels are shares of it."""
    sx, sy = F.when(pixels, 1.0).otherwise(float(width)), F.when(pixels, 1.0).otherwise(float(height))
    return {"x1": (cx - w / 2) * sx, "y1": (cy - h / 2) * sy, "x2": (cx + w / 2) * sx, "y2": (cy + h / 2) * sy}


def decode(tensor: Column, form: str, rows: Column, classes: int, threshold: float, canvas: tuple[int, int]) -> Column:
    """Candidate boxes of a raw tensor (a flat array), before suppression, with confidence of at least `threshold`.

    `corners`: rows of x1 y1 x2 y2 score class. `anchors`: a column for each row of cx cy w h and a score for each
    class. `objectness`: rows of cx cy w h, objectness and class scores. A row with a coordinate above 1.5 is in
    pixels, others are shares of the canvas.
    """
    width, height = canvas
    at = lambda k: F.get(tensor, k.cast("int")).cast("double")

    def box(i: Column) -> Column:
        if form == "corners":
            a = [at(i * 6 + k) for k in range(6)]
            pixels = F.greatest(*a[:4]) > 1.5
            sx, sy = F.when(pixels, 1.0).otherwise(float(width)), F.when(pixels, 1.0).otherwise(float(height))
            corners = {"x1": a[0] * sx, "y1": a[1] * sy, "x2": a[2] * sx, "y2": a[3] * sy}
            best = F.struct(a[5].cast("int").alias("class_id"), a[4].alias("score"))
        else:
            step = classes + 5
            get = (lambda c: at(rows * c + i)) if form == "anchors" else (lambda c: at(i * step + c))
            a = [get(c) for c in range(4)]
            corners = _corner(*a, F.greatest(*a) > 1.5, width, height)
            if form == "anchors":
                best = best_class(F.array(*[get(4 + c) for c in range(classes)]))
            else:
                best = best_class(F.array(*[get(4) * get(5 + c) for c in range(classes)]))
        return F.struct(best["class_id"].alias("class_id"), best["score"].alias("confidence"), *[v.alias(k) for k, v in corners.items()])

    if form not in ("corners", "anchors", "objectness"):
        raise ValueError(f"no such form: {form}")
    made = F.transform(F.sequence(F.lit(0), rows - 1), box)
    return F.filter(F.when(rows > 0, made).otherwise(F.filter(made, lambda b: F.lit(False))), lambda b: b["confidence"] >= threshold)


def target_class(labels: list[str], name: str | None) -> int | None:
    """The first class of this label; None, which keeps all classes, for no name. A name that no label is is an error."""
    if not name:
        return None
    if name not in labels:
        raise ValueError(f"no label {name!r}: the labels are {', '.join(labels)}")
    return labels.index(name)


def detect(frames: DataFrame, form: str, classes: int, threshold: float, canvas: tuple[int, int], target: int | None = None) -> DataFrame:
    """Frames (tensor, n_rows, source_w, source_h) with `objects`: decoded, suppressed on the canvas, then mapped back."""
    boxes = decode(F.col("tensor"), form, F.col("n_rows"), classes, threshold, canvas)
    if target is not None:
        boxes = F.filter(boxes, lambda b: b["class_id"] == target)
    fit = letterbox(F.col("source_w"), F.col("source_h"), F.lit(canvas[0]), F.lit(canvas[1]))
    held = frames.withColumn("_boxes", boxes).withColumn("_fit", fit).withColumn("_kept", suppress(F.col("_boxes")))
    objects = unmap(F.col("_kept"), F.col("_fit"), F.col("source_w"), F.col("source_h"))
    return held.withColumn("objects", objects).drop("_boxes", "_fit", "_kept", "tensor")


def iou_pairs(tracks: DataFrame, detections: DataFrame, keys: list[str], most_cost: float = 0.8) -> DataFrame:
    """Pairs of a frame's tracks and detections with cost 1 - IoU of at most `most_cost`; frames are the join key."""
    pairs = tracks.alias("t").join(detections.alias("d"), keys)
    cost = 1.0 - iou(F.col("t.box"), F.col("d.box"))
    return pairs.select(*keys, "track_id", "detection_id", cost.alias("cost")).where(F.col("cost") <= most_cost)


def warp_box(box: Column, affine: list[Column]) -> Column:
    """The bounding box of a box's corners under the affine map (m00, m01, m02, m10, m11, m12)."""
    xs, ys = [], []
    for cx in ("x1", "x2"):
        for cy in ("y1", "y2"):
            xs.append(affine[0] * box[cx] + affine[1] * box[cy] + affine[2])
            ys.append(affine[3] * box[cx] + affine[4] * box[cy] + affine[5])
    return F.struct(F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"))
