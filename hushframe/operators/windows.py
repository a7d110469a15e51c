"""Media windows put together: protected video, audio outcome and speech-and-faces decision to observations, gate and output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators import gate

VIDEO, AUDIO, CROSS_MODAL = "video", "spoken_pii", "cross_modal"


def video_status(there: Column, failures: Column, render_status: Column) -> Column:
    """Whether the protected video can be shown: ready, or why not."""
    return F.when(~there, "video_processor_failure").when(failures > 0, "video_detector_failure").when(F.coalesce(render_status != "rendered", F.lit(True)), "video_render_failure").otherwise("ready")


def audio_safe(status: Column, watermark: Column) -> Column:
    """Whether what the audio stage gave can be released."""
    return F.coalesce(status.isin("ok", "no_speech") & watermark.isNotNull(), F.lit(False))


def augmentation(windows: DataFrame, decisions: DataFrame) -> DataFrame:
    """windows (session, seq, ts_ms, audio_status, audio_watermark_ms, sync_reason) with xm_status, xm_reason, xm_watermark_ms and xm_lag_ms.

    Without safe audio it is failed; then a reason of the synchroniser's; then the last decision (session, ts_ms, ord, status, reason,
    watermark_ms, lag_ms) for the frame's time; without one it is processing.
    """
    last = decisions.groupBy("session", "ts_ms").agg(F.max_by(F.struct("status", "reason", "watermark_ms", "lag_ms"), "ord").alias("__d"))
    both = windows.join(last, ["session", "ts_ms"], "left")
    safe = audio_safe(F.col("audio_status"), F.col("audio_watermark_ms"))
    known, d = F.col("__d").isNotNull(), F.col("__d")
    ready = known & d["status"].isin("protected", "no_sensitive_speech")
    used = safe & F.col("sync_reason").isNull()
    status = F.when(~safe, "failed").when(F.col("sync_reason").isNotNull(), "failed").when(~known, "processing").when(ready, "ready").otherwise("failed")
    reason = F.when(~safe, "cross_modal_audio_unavailable").when(F.col("sync_reason").isNotNull(), F.col("sync_reason")).when(~known, "cross_modal_pending").when(~ready, F.coalesce(d["reason"], F.lit("cross_modal_unsafe")))
    watermark = F.when(used, F.when(known, d["watermark_ms"]).otherwise(F.col("audio_watermark_ms")))
    return both.withColumns({"xm_status": status, "xm_reason": reason, "xm_watermark_ms": watermark, "xm_lag_ms": F.when(used & known, d["lag_ms"])}).drop("__d")


def observations(windows: DataFrame) -> DataFrame:
    """(session, seq, capability, state, watermark_ms, lag_ms, reason): three observations of each window.

    windows: end_ms, video_there, failures, render_status, audio_status, audio_watermark_ms, audio_lag_ms, and the columns of augmentation;
    a null audio_status is an audio stage that failed, a null xm_status no speech-and-faces stage.
    """
    c = F.col
    video = video_status(c("video_there"), c("failures"), c("render_status"))
    audio = audio_safe(c("audio_status"), c("audio_watermark_ms"))
    row = lambda capability, state, watermark, lag, reason: F.struct(F.lit(capability).alias("capability"), state.alias("state"), watermark.cast("long").alias("watermark_ms"), lag.cast("long").alias("lag_ms"), reason.cast("string").alias("reason"))
    is_ready = c("xm_status") == "ready"
    three = F.array(
        row(VIDEO, F.when(video == "ready", "ready").otherwise("failed"), F.when(video == "ready", c("end_ms")), F.when(video == "ready", 0), F.when(video != "ready", video)),
        row(AUDIO, F.when(audio, "ready").otherwise("failed"), F.when(audio, c("audio_watermark_ms")), F.when(audio, F.coalesce("audio_lag_ms", F.lit(0))), F.when(~audio, F.coalesce("audio_status", F.lit("audio_processor_failure")))),
        row(CROSS_MODAL, F.coalesce("xm_status", F.lit("unavailable")), c("xm_watermark_ms"), F.when(is_ready, F.coalesce("xm_lag_ms", F.lit(0))).otherwise(c("xm_lag_ms")), F.when(F.coalesce(~is_ready, F.lit(True)), F.coalesce("xm_reason", F.lit("cross_modal_unavailable")))),
    )
    return windows.select("session", "seq", F.explode(three).alias("o")).select("session", "seq", "o.*")


def process(windows: DataFrame, decisions: DataFrame, policies: DataFrame, *, fallback: str = "full_redact") -> DataFrame:
    """(session, seq, action, readiness, reason, video, audio, video_status, audio_status, cross_modal_status) of each window.

    windows has the columns that augmentation and observations need. What is published is protected video and audio; full redaction
    gives a full cover and silence; a block gives nothing.
    """
    own = augmentation(windows, decisions)
    decided = gate.route(gate.decisions(own.select("session", "seq", "end_ms"), policies, observations(own), fallback=fallback))
    shown = own.select("session", "seq", video_status(F.col("video_there"), F.col("failures"), F.col("render_status")).alias("video_status"), F.coalesce("audio_status", F.lit("unsafe_input")).alias("audio_status"), F.col("xm_status").alias("cross_modal_status"))
    return decided.select("session", "seq", "action", "readiness", "reason", "video", "audio").join(shown, ["session", "seq"])


def can_start(capabilities: DataFrame, key: str) -> DataFrame:
    """(key, required_unavailable, optional_unavailable, can_start) of capabilities (enabled, required, state, permission, safety)."""
    off = lambda required: F.bool_or(F.col("enabled") & (F.col("required") == required) & (F.col("state") != "ready"))
    grouped = capabilities.groupBy(key).agg(off(True).alias("required_unavailable"), off(False).alias("optional_unavailable"), F.first("permission").alias("__p"), F.first("safety").alias("__s"))
    return grouped.select(key, "required_unavailable", "optional_unavailable", ((F.col("__p") == "granted") & ~F.col("required_unavailable") & F.col("__s").isin("normal", "degraded")).alias("can_start"))
