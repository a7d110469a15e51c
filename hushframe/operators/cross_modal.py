"""Spoken and visual evidence aligned by source time: overlap, watermarks, associations, bounded buffers and late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.folds import ordered_fold
from hushframe.operators.intervals import next_at_least, overlap_join


def overlaps(frames: DataFrame, intervals: DataFrame, *, frame_ms: int = 33, pre_ms: int = 50, post_ms: int = 50, bucket: int) -> DataFrame:
    """(stream, seq, ts_ms, n_intervals, min_confidence): for each frame the padded intervals that overlap it; repeats count once."""
    spoken = intervals.select("stream", (F.col("start_ms") - pre_ms).alias("a"), (F.col("end_ms") + post_ms).alias("b"), "confidence", "detector", "reason").distinct()
    spans = frames.select("stream", "seq", "ts_ms", (F.col("ts_ms") + frame_ms).alias("ts_end"))
    found = overlap_join(spans, spoken, "stream", bucket=bucket, left_span=("ts_ms", "ts_end"), right_span=("a", "b"), keep=["stream", "seq"])
    return found.groupBy("stream", "seq", "ts_ms").agg(F.count("a").alias("n_intervals"), F.min("confidence").alias("min_confidence"))


def associate(faces: Column, *, least_face: float = 0.5, least_score: float = 0.7, margin: float = 0.1) -> Column:
    """How a frame's faces (confidence, score) go with speech: mouth, face_fallback or unsafe.

    A single face is the speaker's if it is sure enough. Of several the best score must be unique by a margin, high and of a sure
    face; otherwise all faces are covered.
    """
    scored = F.reverse(F.array_sort(F.transform(F.filter(faces, lambda f: f["score"].isNotNull()), lambda f: F.struct(f["score"].alias("score"), f["confidence"].alias("confidence")))))
    best, second = F.get(scored, F.lit(0)), F.get(scored, F.lit(1))
    unique = (F.size(scored) == 1) | (best["score"] - second["score"] >= margin)
    clear = (F.size(scored) > 0) & unique & (best["score"] >= least_score) & (best["confidence"] >= least_face)
    single = F.get(faces, F.lit(0))
    return F.when(F.coalesce(F.size(faces), F.lit(0)) <= 0, "unsafe").when(F.size(faces) == 1, F.when(single["confidence"] >= least_face, "mouth").otherwise("unsafe")).when(F.coalesce(clear, F.lit(False)), "mouth").otherwise("face_fallback")


def mouth_box(face: Column) -> Column:
    """The lower middle of a face."""
    return F.struct((face["x"] + face["w"] * 0.15).alias("x"), (face["y"] + face["h"] * 0.55).alias("y"), (face["w"] * 0.70).alias("w"), (face["h"] * 0.40).alias("h"))


def decide(frames: DataFrame, intervals: DataFrame, updates: DataFrame, *, frame_ms: int, pre_ms: int, post_ms: int, bucket: int) -> DataFrame:
    """(stream, seq, status, association, min_confidence, delay_ms, lag_ms) for frames (ts_ms, faces), without a buffer's limits.

    A frame is decided at the first watermark of the stream's updates that reaches its end and padding; without one it stays
    unsafe_audio_incomplete.
    """
    need = frames.withColumn("required", F.col("ts_ms") + frame_ms + pre_ms)
    released = next_at_least(need, updates, "stream", "required", "watermark_ms", "released")
    spoken = overlaps(frames, intervals, frame_ms=frame_ms, pre_ms=pre_ms, post_ms=post_ms, bucket=bucket).drop("ts_ms")
    own = released.join(spoken, ["stream", "seq"])
    how = associate(F.col("faces"))
    status = F.when(F.col("released").isNull(), "unsafe_audio_incomplete").when(F.col("n_intervals") == 0, "no_sensitive_speech").when(how == "unsafe", "unsafe_no_face_association").otherwise("protected")
    shown = F.when(status == "protected", how).when(status == "unsafe_no_face_association", "unsafe").otherwise("none")
    return own.select("stream", "seq", status.alias("status"), shown.alias("association"), F.when(status == "protected", F.col("min_confidence")).alias("min_confidence"), F.greatest(F.lit(0), F.col("released") - F.col("ts_ms")).alias("delay_ms"), F.greatest(F.lit(0), F.col("released") - F.col("required")).alias("lag_ms"))


def late(updates: DataFrame) -> DataFrame:
    """updates (stream, ord, start_ms, end_ms, watermark_ms) with late: whether the interval ends before what was known by then."""
    order = Window.partitionBy("stream").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return updates.withColumn("previous", F.max("watermark_ms").over(order)).withColumn("late", F.coalesce(F.col("end_ms") <= F.col("previous"), F.lit(False)))


def metrics(decisions: DataFrame, key: str | None = None) -> DataFrame:
    """Counts by outcome, and total and largest delays and lags of those that have one."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    grouped = decisions.groupBy(key) if key else decisions.groupBy()
    return grouped.agg(F.count("*").alias("released"), is_("protected").alias("protected"), is_("no_sensitive_speech").alias("silent"), F.count_if(F.col("status").startswith("unsafe")).alias("unsafe"), F.coalesce(F.sum("delay_ms"), F.lit(0)).alias("total_delay_ms"), F.coalesce(F.max("delay_ms"), F.lit(0)).alias("max_delay_ms"), F.coalesce(F.max("lag_ms"), F.lit(0)).alias("max_lag_ms"))


class Synchroniser:
    """The buffered form of one stream: frames wait for watermarks in order, within limits; what breaks the timeline fails them all."""

    def __init__(self, frame_ms: int, pre_ms: int, post_ms: int, most: int, most_ms: int):
        self.frame_ms, self.pre_ms, self.post_ms, self.most, self.most_ms = frame_ms, pre_ms, post_ms, most, most_ms
        self.pending: list[tuple[int, int]] = []
        self.intervals: set[tuple[int, int, float]] = set()
        self.watermark: int | None = None
        self.last_frame: int | None = None

    def _fail(self, reason: str) -> list[tuple]:
        out = [(seq, "failed", reason, None) for seq, _ in self.pending]
        self.pending = []
        return out

    def _release(self) -> list[tuple]:
        out = []
        while self.pending and self.watermark is not None and self.watermark >= self.pending[0][1] + self.frame_ms + self.pre_ms:
            seq, ts = self.pending.pop(0)
            hit = any(b + self.post_ms > ts and a - self.pre_ms < ts + self.frame_ms for a, b, _ in self.intervals)
            out.append((seq, "sensitive_speech" if hit else "no_sensitive_speech", None, max(0, self.watermark - ts)))
        while len(self.pending) > self.most or len(self.pending) >= 2 and self.pending[-1][1] - self.pending[0][1] > self.most_ms:
            out.append((self.pending.pop(0)[0], "failed", "unsafe_buffer_overflow", None))
        # intervals that no later frame can meet any more are forgotten, so the state stays bounded
        oldest = self.pending[0][1] if self.pending else self.last_frame
        if oldest is not None and len(self.intervals) > 4 * self.most:
            self.intervals = {i for i in self.intervals if i[1] + self.post_ms > oldest}
        return out

    def frame(self, seq: int, ts: int) -> list[tuple]:
        if self.last_frame is not None and ts < self.last_frame:
            return self._fail("unsafe_timestamp_discontinuity")
        self.last_frame = ts
        self.pending.append((seq, ts))
        return self._release()

    def audio(self, watermark: int, intervals: list[tuple[int, int, float]]) -> list[tuple]:
        if watermark < 0 or self.watermark is not None and watermark < self.watermark or any(b > watermark for _, b, _ in intervals):
            return self._fail("unsafe_timestamp_discontinuity")
        self.intervals |= set(intervals)
        self.watermark = watermark
        return self._release()

    def flush(self) -> list[tuple]:
        return self._fail("unsafe_audio_incomplete")


def synchronise(events: DataFrame, *, frame_ms: int = 33, pre_ms: int = 50, post_ms: int = 50, most: int = 30, most_ms: int = 1000) -> DataFrame:
    """(stream, seq, status, reason, delay_ms) of events (stream, ord, kind, seq, ts_ms, start_ms, end_ms, confidence, watermark_ms).

    kind is frame (seq, ts_ms) or audio (watermark_ms and one interval or none); ord orders both. What is left at the end fails as
    unsafe_audio_incomplete.
    """
    start = lambda: Synchroniser(frame_ms, pre_ms, post_ms, most, most_ms)

    def step(state: Synchroniser, row) -> list[tuple]:
        if row.kind == "frame":
            found = state.frame(int(row.seq), int(row.ts_ms))
        else:
            own = [(int(row.start_ms), int(row.end_ms), float(row.confidence))] if row.start_ms == row.start_ms and row.start_ms is not None else []
            found = state.audio(int(row.watermark_ms), own)
        return [(row.stream, *x) for x in found]

    return ordered_fold(events, ["stream"], ["ord"], start, step, "stream long, seq long, status string, reason string, delay_ms long", lambda state, key: [(key[0], *x) for x in state.flush()])


def spoken_regions(decisions: DataFrame, *, frame_ms: int, detector: str = "cross_modal") -> DataFrame:
    """A region of kind spoken_pii for each face that a protected decision (stream, seq, ts_ms, status, association, min_confidence, faces)
    covers: the mouth of the speaker, or all of every face; it lives for one frame.

    The speaker is the only face, or the one of the best score.
    """
    own = decisions.filter("status = 'protected'")
    best = F.element_at(F.array_sort(F.transform("faces", lambda f, k: F.struct(F.coalesce(f["score"], F.lit(-1.0)).alias("score"), (-k).alias("k"), f.alias("face")))), -1)["face"]
    box = lambda f: F.struct(f["x"].alias("x"), f["y"].alias("y"), f["w"].alias("w"), f["h"].alias("h"))
    boxes = F.when(F.col("association") == "mouth", F.array(mouth_box(best))).otherwise(F.transform("faces", box))
    each = own.select("stream", "seq", "ts_ms", "min_confidence", F.posexplode(boxes).alias("place", "b"))
    return each.select("stream", "seq", "place", F.lit("spoken_pii").alias("kind"), "b.x", "b.y", "b.w", "b.h", F.col("min_confidence").alias("confidence"), F.lit(detector).alias("detector"), (F.col("ts_ms") + frame_ms).alias("expires_ms"))


def faces_of(regions: DataFrame) -> DataFrame:
    """Those regions that are faces."""
    return regions.filter(F.col("kind").isin("face", "face_bystander"))


def update_status(updates: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """updates (key, reason, n_late) with status and reason: unsafe for a reason of its own, late audio, or the first unsafe decision
    (key, seq, status) it released; else released if it released any; else pending."""
    unsafe = F.when(F.col("status").startswith("unsafe"), F.col("status"))
    own = decisions.groupBy(*key).agg(F.count("*").alias("__n"), F.min_by(unsafe, F.when(unsafe.isNotNull(), F.col("seq"))).alias("__first"))
    reason = F.coalesce("reason", F.when(F.col("n_late") > 0, "unsafe_late_audio"), "__first")
    both = updates.join(own, key, "left").withColumn("reason", reason)
    return both.withColumn("status", F.when(F.col("reason").isNotNull(), "unsafe").when(F.col("__n") > 0, "released").otherwise("pending")).drop("__n", "__first")
