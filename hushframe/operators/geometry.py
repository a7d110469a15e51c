"""Boxes: padding, clamping, letterboxes, overlap and regions of recognised text, plates and faces. Column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("face", "face_bystander", "license_plate", "email", "phone_number", "postal_address", "government_id", "payment_identifier", "custom_sensitive_text", "spoken_pii")


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(as_col(high), x))


def polygon_box(polygon: Column) -> Column:
    """The box (x1, y1, x2, y2) around a polygon, an array of (x, y)."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def region_kind(categories: Column) -> Column:
    """The one category of a text's spans, or custom_sensitive_text for several."""
    return F.when(F.size(F.array_distinct(categories)) == 1, F.get(categories, F.lit(0))).otherwise("custom_sensitive_text")


@dataclass(frozen=True)
class Letterbox:
    """How a frame was scaled into a square: columns of scale and padding."""

    width: Column
    height: Column
    scale: Column
    pad_x: Column
    pad_y: Column


def letterbox(width: Column, height: Column, size: int) -> Letterbox:
    """Scale to fit, sides rounded half to even, and centred."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    pads = [F.floor((F.lit(size) - F.bround(side * scale)) / 2) for side in (width, height)]
    return Letterbox(width, height, scale, *pads)


def from_letterbox(x1: Column, y1: Column, x2: Column, y2: Column, t: Letterbox) -> dict[str, Column]:
    """A box in the square as one in the frame, clamped to it."""
    back = lambda v, pad, side: clamp((v - pad) / t.scale, F.lit(0.0), side.cast("double"))
    return {"x1": back(x1, t.pad_x, t.width), "y1": back(y1, t.pad_y, t.height), "x2": back(x2, t.pad_x, t.width), "y2": back(y2, t.pad_y, t.height)}


def padded(box: dict[str, Column], width: Column, height: Column, ratio: float) -> dict[str, Column]:
    """A box grown on each side by a share of the frame's sides, clamped."""
    px, py = width * F.lit(ratio), height * F.lit(ratio)
    w, h = width.cast("double"), height.cast("double")
    return {"x1": clamp(box["x1"] - px, F.lit(0.0), w), "y1": clamp(box["y1"] - py, F.lit(0.0), h), "x2": clamp(box["x2"] + px, F.lit(0.0), w), "y2": clamp(box["y2"] + py, F.lit(0.0), h)}


def normalised(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """x, y, w, h as shares of the frame; all null for an empty box."""
    some = (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])
    parts = {"x": box["x1"] / width, "y": box["y1"] / height, "w": (box["x2"] - box["x1"]) / width, "h": (box["y2"] - box["y1"]) / height}
    return {k: F.when(some, v) for k, v in parts.items()}


def pad_regions(regions: DataFrame, *, pad_px: int = 0, ttl_ms: int, width: str = "width", height: str = "height") -> DataFrame:
    """Regions (x, y, w, h, ts_ms and the frame's width and height) padded by pixels, clamped to the frame, and given expires_ms.

    valid is false for what has no area then; invalid rows stay.
    """
    px, py = F.lit(float(pad_px)) / F.col(width), F.lit(float(pad_px)) / F.col(height)
    x1, y1 = clamp(F.col("x") - px, 0.0, 1.0), clamp(F.col("y") - py, 0.0, 1.0)
    x2, y2 = clamp(F.col("x") + F.col("w") + px, 0.0, 1.0), clamp(F.col("y") + F.col("h") + py, 0.0, 1.0)
    return regions.select(*[c for c in regions.columns if c not in ("x", "y", "w", "h")], x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"), (F.col("ts_ms") + ttl_ms).alias("expires_ms"), ((x2 > x1) & (y2 > y1)).alias("valid"))


def pixel_bounds(width: Column, height: Column) -> dict[str, Column]:
    """left, top, right, bottom pixels of a region (x, y, w, h): outward rounding, one pixel at least, inside the frame."""
    left = clamp(F.floor(F.col("x") * width), F.lit(0), width - 1)
    top = clamp(F.floor(F.col("y") * height), F.lit(0), height - 1)
    right = F.least(width, F.greatest(left + 1, F.ceil((F.col("x") + F.col("w")) * width)))
    bottom = F.least(height, F.greatest(top + 1, F.ceil((F.col("y") + F.col("h")) * height)))
    return {"left_px": left, "top_px": top, "right_px": right, "bottom_px": bottom}


def intersection(a: str, b: str) -> Column:
    """Area that two regions (prefixes of x, y, w, h) share."""
    c = F.col
    across = F.least(c(f"{a}x") + c(f"{a}w"), c(f"{b}x") + c(f"{b}w")) - F.greatest(c(f"{a}x"), c(f"{b}x"))
    down = F.least(c(f"{a}y") + c(f"{a}h"), c(f"{b}y") + c(f"{b}h")) - F.greatest(c(f"{a}y"), c(f"{b}y"))
    return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 without area."""
    shared = intersection(a, b)
    union = F.col(f"{a}w") * F.col(f"{a}h") + F.col(f"{b}w") * F.col(f"{b}h") - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def overlapping_pairs(regions: DataFrame, frame: str = "frame", ordinal: str = "ordinal") -> DataFrame:
    """(frame, a, b, iou) of pairs of one frame's regions that share area, a before b: an equi-join on the frame."""
    parts = lambda p: regions.select(F.col(frame), *[F.col(c).alias(f"{p}_{c}") for c in (ordinal, "x", "y", "w", "h")])
    both = parts("a").join(parts("b"), frame).filter(F.col(f"a_{ordinal}") < F.col(f"b_{ordinal}"))
    return both.withColumn("iou", iou("a_", "b_")).filter("iou > 0").select(frame, F.col(f"a_{ordinal}").alias("a"), F.col(f"b_{ordinal}").alias("b"), "iou")


def ragged(values: Column, place: Column) -> Column:
    """A model's value at a place; the last one where the list is short, 0 where it is empty."""
    return F.coalesce(F.get(values, place.cast("int")), F.try_element_at(values, F.lit(-1)), F.lit(0.0))


def ocr_regions(blocks: DataFrame, found: Column, *, least_confidence: float = 0.4, padding: float = 0.02) -> DataFrame:
    """Regions of text blocks (polygon, confidence, width, height) that have spans and enough confidence; empty boxes go."""
    box = polygon_box(F.col("polygon"))
    w, h = F.col("width"), F.col("height")
    own = blocks.withColumns({"__spans": found, "__box": box}).filter((F.col("confidence") >= least_confidence) & (F.size("__spans") > 0))
    grown = padded({k: F.col(f"__box.{k}") for k in ("x1", "y1", "x2", "y2")}, w, h, padding)
    kind = region_kind(F.transform("__spans", lambda s: s["category"]))
    out = own.select(*blocks.columns, kind.alias("kind"), *[c.alias(k) for k, c in normalised(grown, w, h).items()])
    return out.filter("x is not null")


def plate_regions(raw: DataFrame, *, size: int = 640, least_confidence: float = 0.45, padding: float = 0.02, classes: tuple[str, ...] = ("license_plate", "plate")) -> DataFrame:
    """Regions of a detector's ragged lists (boxes, conf, cls, names, width, height): confident, of a wanted class, with area."""
    each = raw.select("*", F.posexplode("boxes").alias("__at", "__box"))
    each = each.withColumns({"confidence": ragged(F.col("conf"), F.col("__at")), "__class": F.lower(F.try_element_at("names", ragged(F.col("cls"), F.col("__at")).cast("int")))})
    each = each.filter((F.col("confidence") >= least_confidence) & ~F.isnan("confidence") & F.col("__class").isin(*classes))
    w, h = F.col("width"), F.col("height")
    t = letterbox(w, h, size)
    box = padded(from_letterbox(*[F.get("__box", F.lit(k)) for k in range(4)], t), w, h, padding)
    kept = [c for c in raw.columns if c not in ("boxes", "conf", "cls", "names")]
    return each.select(*kept, F.lit("license_plate").alias("kind"), "confidence", *[c.alias(k) for k, c in normalised(box, w, h).items()]).filter("x is not null")


def face_regions(faces: DataFrame) -> DataFrame:
    """Faces' pixel boxes (x1, y1, x2, y2, width, height) as regions face_bystander; status error for an empty one."""
    w, h = F.col("width"), F.col("height")
    box = {"x1": clamp(F.col("x1"), F.lit(0.0), w.cast("double")), "y1": clamp(F.col("y1"), F.lit(0.0), h.cast("double")), "x2": clamp(F.col("x2"), F.lit(0.0), w.cast("double")), "y2": clamp(F.col("y2"), F.lit(0.0), h.cast("double"))}
    out = faces.select("*", F.lit("face_bystander").alias("kind"), *[c.alias(k) for k, c in normalised(box, w, h).items()])
    return out.withColumn("status", F.when(F.col("x").isNull(), "error").otherwise("ok"))


def all_detectors(**found: DataFrame) -> DataFrame:
    """Regions of several detectors as one table, in order of their names, with detector."""
    out = None
    for name in sorted(found):
        own = found[name].withColumn("detector", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def dimension_status(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """ok, or error where there is no image, or one of another size than the frame."""
    return F.when(F.coalesce((image_width == width) & (image_height == height), F.lit(False)), "ok").otherwise("error")


def recogniser_blocks(raw: DataFrame) -> DataFrame:
    """raw (out: an array of (points: an array of [x, y], text, confidence)) as blocks (place, polygon, text, confidence); a block whose
    points or confidence aren't finite numbers, or of fewer than three points, goes."""
    each = raw.select("*", F.posexplode("out").alias("place", "__b")).drop("out")
    point = lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    blocks = each.withColumns({"polygon": F.transform("__b.points", point), "text": F.col("__b.text"), "confidence": F.col("__b.confidence").cast("double")}).drop("__b")
    return blocks.filter((F.size("polygon") >= 3) & F.forall("polygon", lambda p: finite(p["x"]) & finite(p["y"])) & finite(F.col("confidence")))


def face_outputs(raw: DataFrame) -> DataFrame:
    """raw (faces: an array of (bbox, det_score, quality, embedding)) as faces (place, x1, y1, x2, y2, confidence, quality, embedding).

    A quality that isn't given is the confidence; an embedding with a value that isn't finite is null.
    """
    each = raw.select("*", F.posexplode("faces").alias("place", "__f")).drop("faces")
    bad = F.exists("__f.embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    corners = {c: F.get("__f.bbox", F.lit(k)) for k, c in enumerate(("x1", "y1", "x2", "y2"))}
    return each.withColumns({**corners, "confidence": F.col("__f.det_score"), "quality": F.coalesce("__f.quality", "__f.det_score"), "embedding": F.when(~bad, F.col("__f.embedding"))}).drop("__f")


def region_problem(x: Column, y: Column, w: Column, h: Column, confidence: Column, timestamp_ms: Column, kind: Column) -> Column:
    """The first rule that a normalised region breaks, or null: a known kind, a time of 0 or more, finite numbers between 0 and 1, an area
    inside the frame."""
    outside = lambda c: ~F.coalesce(~F.isnan(c) & (c >= 0) & (c <= 1), F.lit(False))
    wrong = F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind").when(F.coalesce(timestamp_ms < 0, F.lit(True)), "timestamp").when(outside(confidence), "confidence")
    return wrong.when(outside(x) | outside(y) | outside(w) | outside(h), "interval").when((w <= 0) | (h <= 0), "no_area").when((x + w > 1 + 1e-9) | (y + h > 1 + 1e-9), "outside_frame")
