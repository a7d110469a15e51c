"""Raster frames: regions covered, pixelated or blurred. Bytes are row-major; NumPy in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def colour_for(channels: int, colour: tuple[int, ...]) -> tuple[int, ...]:
    """A colour of a frame's kind: grey is the rounded mean of three, a fourth channel is opaque unless given."""
    if channels == 1:
        return (round(sum(colour[:3]) / len(colour[:3])),)
    return tuple(colour[:3]) if channels == 3 else (*colour[:3], colour[3] if len(colour) > 3 else 255)


def compose(image: np.ndarray, boxes: list[tuple[int, int, int, int]], style: str, *, colour: tuple[int, ...] = (0, 0, 0), block: int = 8, radius: int = 2) -> np.ndarray:
    """A copy of a height x width x channels image with boxes (left, top, right, bottom) hidden, later ones over earlier ones.

    cover: one colour. pixelate: blocks of `block` pixels take the pixel in their middle. blur: the floor of the mean of the square of
    `radius` around each pixel, cut at the frame. Both read the image as it was.
    """
    out = image.copy()
    height, width = image.shape[:2]
    for left, top, right, bottom in boxes:
        if style == "cover":
            out[top:bottom, left:right] = colour_for(image.shape[2], colour)
        elif style == "pixelate":
            rows, columns = (np.minimum(stop - 1, begin + (np.arange(stop - begin) // block) * block + block // 2) for begin, stop in ((top, bottom), (left, right)))
            out[top:bottom, left:right] = image[rows][:, columns]
        elif style == "blur":
            sums = np.zeros((height + 1, width + 1, image.shape[2]), np.int64)
            sums[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
            y, x = np.arange(top, bottom), np.arange(left, right)
            y0, y1, x0, x1 = np.maximum(0, y - radius), np.minimum(height, y + radius + 1), np.maximum(0, x - radius), np.minimum(width, x + radius + 1)
            total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
            out[top:bottom, left:right] = total // ((y1 - y0)[:, None] * (x1 - x0)[None, :])[:, :, None]
        else:
            raise ValueError(f"no style {style}")
    return out


def redact_frames(frames: DataFrame, style: str, **options) -> DataFrame:
    """frames (payload, width, height, channels, boxes: array of left, top, right, bottom; full_frame optional) with payload redacted.

    status: ok, no_payload for a null one, error if the payload's size isn't that of the frame; the payload is null then.
    """
    names = frames.columns
    at = {c: names.index(c) for c in ("payload", "width", "height", "channels", "boxes")}
    full = names.index("full_frame") if "full_frame" in names else None

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(k).to_pylist() for c, k in at.items()}
            whole = batch.column(full).to_pylist() if full is not None else [False] * batch.num_rows
            payloads, status = [], []
            for raw, w, h, n, boxes, everything in zip(*columns.values(), whole):
                if raw is None or not w or not h or n not in (1, 3, 4) or len(raw) != w * h * n:
                    payloads.append(None)
                    status.append("no_payload" if raw is None else "error")
                    continue
                image = np.frombuffer(raw, np.uint8).reshape(h, w, n)
                where = [(0, 0, w, h)] if everything else [(b["left"], b["top"], b["right"], b["bottom"]) for b in boxes or ()]
                payloads.append(compose(image, where, "cover" if everything else style, **options).tobytes())
                status.append("ok")
            own = list(batch.columns)
            own[at["payload"]] = pa.array(payloads, pa.binary())
            yield pa.RecordBatch.from_arrays([*own, pa.array(status)], names=[*names, "status"])

    return frames.drop("status").mapInArrow(redacted, frames.drop("status").limit(0).schema.add("status", "string"))


def letterbox_image(image: np.ndarray, size: int, grey: int = 114) -> np.ndarray:
    """An image scaled (nearest pixel) into a square with a grey border."""
    height, width = image.shape[:2]
    scale = min(size / width, size / height)
    w, h = round(width * scale), round(height * scale)
    rows, columns = np.minimum(height - 1, (np.arange(h) / scale).astype(int)), np.minimum(width - 1, (np.arange(w) / scale).astype(int))
    out = np.full((size, size, image.shape[2]), grey, np.uint8)
    top, left = (size - h) // 2, (size - w) // 2
    out[top : top + h, left : left + w] = image[rows][:, columns]
    return out


def frame_times(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """frames (seq) with ts_ms at a fixed rate, rounded half to even."""
    return frames.withColumn("ts_ms", F.bround(F.col("seq") * 1000.0 / fps).cast("long"))


def solid(width: Column, height: Column, channels: Column, colour: tuple[int, ...]) -> Column:
    """The payload of a frame of one colour, as colour_for gives it."""
    one = F.lit("")
    for n in (1, 3, 4):
        one = F.when(channels == n, bytes(colour_for(n, colour)).hex()).otherwise(one)
    return F.unhex(F.repeat(one, (width * height).cast("int")))


def pixel(payload: Column, x: Column, y: Column, width: Column, channels: Column) -> Column:
    """The bytes of one pixel."""
    return F.substring(payload, ((y * width + x) * channels).cast("int") + 1, channels.cast("int"))


def letterbox_frames(frames: DataFrame, size: int, grey: int = 114) -> DataFrame:
    """frames (payload, width, height, channels) with model_input: the payload of letterbox_image; null where the payload doesn't fit."""
    at = [frames.columns.index(c) for c in ("payload", "width", "height", "channels")]
    own = frames.drop("model_input")

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, w, h, n in zip(*(batch.column(k).to_pylist() for k in at)):
                fits = raw is not None and w and h and n and len(raw) == w * h * n
                out.append(letterbox_image(np.frombuffer(raw, np.uint8).reshape(h, w, n), size, grey).tobytes() if fits else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "model_input"])

    return own.mapInArrow(boxed, own.limit(0).schema.add("model_input", "binary"))
