"""The privacy gate: issues of capabilities, decisions for windows, panic, and what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.folds import ordered_fold


def issue(required: Column, state: Column, watermark: Column, lag: Column, end_ms: Column, most_lag: Column, there: Column) -> Column:
    """The first thing wrong with a capability's observation, or null."""
    wrong = (
        F.when(~there, "observation_missing").when(state != "ready", F.concat(F.lit("state_"), state)).when(watermark.isNull(), "watermark_missing").when(watermark < end_ms, "watermark_pending")
        .when(most_lag.isNotNull() & lag.isNull(), "lag_missing").when(most_lag.isNotNull() & (lag > most_lag), "lag_exceeded")
    )
    return F.concat(F.when(required, "required_").otherwise("optional_"), wrong)


#: Most rows of a list of policies, which people write: it is broadcast.
POLICIES = 10_000


def policy_list(policies: DataFrame) -> DataFrame:
    """policies, to be broadcast; more than POLICIES rows are an error."""
    if policies.limit(POLICIES + 1).count() > POLICIES:
        raise ValueError(f"more than {POLICIES} policies")
    return F.broadcast(policies)


def issues(windows: DataFrame, policies: DataFrame, observations: DataFrame) -> DataFrame:
    """(session, seq, ord, capability, required, issue, watermark_ms, lag_ms): each window and enabled policy, with or without one.

    Policies are a list of capabilities that people wrote (broadcast, with a checked size). A missing observation never drops its row.
    """
    wanted = windows.select("session", "seq", "end_ms").join(policy_list(policies.filter("enabled")))
    seen = observations.select("session", "seq", "capability", "state", "watermark_ms", "lag_ms", F.lit(True).alias("__there"))
    both = wanted.join(seen, ["session", "seq", "capability"], "left")
    found = issue(F.col("required"), F.col("state"), F.col("watermark_ms"), F.col("lag_ms"), F.col("end_ms"), F.col("max_lag"), F.coalesce("__there", F.lit(False)))
    return both.select("session", "seq", "ord", "capability", "required", found.alias("issue"), "watermark_ms", "lag_ms")


def invalid(policies: DataFrame, observations: DataFrame) -> DataFrame:
    """(session, seq) of windows with an observation of an unknown capability, or two of one."""
    known = policy_list(policies.select("capability", F.lit(True).alias("__known")))
    counted = observations.groupBy("session", "seq", "capability").agg(F.count("*").alias("n")).join(known, "capability", "left")
    return counted.filter("n > 1 or __known is null").select("session", "seq").distinct()


def decisions(windows: DataFrame, policies: DataFrame, observations: DataFrame, *, fallback: str = "full_redact") -> DataFrame:
    """(session, seq, action, readiness, reason, watermark_ms, lag_ms) of each window, without panic.

    Invalid input comes first, then the first required issue in policy order, then the first optional one (degraded), else ready. The
    watermark is the smallest and the lag the largest of required capabilities, or of all enabled ones if none is required.
    """
    rows = issues(windows, policies, observations)
    first = lambda required: F.min_by(F.when(F.col("required") == required, F.col("issue")), F.when((F.col("required") == required) & F.col("issue").isNotNull(), F.col("ord")))
    any_required = F.bool_or("required")
    counted = lambda agg, c: F.when(any_required, agg(F.when(F.col("required"), F.col(c)))).otherwise(agg(F.col(c)))
    per = rows.groupBy("session", "seq").agg(first(True).alias("required_issue"), first(False).alias("optional_issue"), counted(F.min, "watermark_ms").alias("watermark_ms"), counted(F.max, "lag_ms").alias("lag_ms"))
    bad = invalid(policies, observations).withColumn("__bad", F.lit(True))
    per = per.join(bad, ["session", "seq"], "left")
    wrong = F.when(F.col("__bad"), "invalid_observation").otherwise(F.col("required_issue"))
    return per.select(
        "session", "seq", F.when(wrong.isNotNull(), fallback).otherwise("publish").alias("action"), F.when(wrong.isNotNull(), "unsafe").when(F.col("optional_issue").isNotNull(), "degraded").otherwise("ready").alias("readiness"),
        F.coalesce(wrong, "optional_issue", F.lit("ready")).alias("reason"), "watermark_ms", "lag_ms",
    )


def panic(decided: DataFrame, control: DataFrame, *, recoveries: int = 2, fallback: str = "full_redact") -> DataFrame:
    """(session, seq, action, reason, panic_active): decisions under control (panic, leave, alive), in order of seq.

    Panic stays until it was asked to end and `recoveries` healthy windows came in a row. Invalid input leaves the state untouched.
    """

    def start() -> dict:
        return {"active": False, "leave": False, "streak": 0, "ended": 0}

    def step(s: dict, row) -> list[tuple]:
        if row.panic:
            s |= {"active": True, "leave": False, "streak": 0}
        if row.leave and s["active"]:
            s["leave"] = True
        blocked = row.readiness == "unsafe"
        if row.reason == "invalid_observation":
            return [(row.session, row.seq, fallback, row.reason, s["active"])]
        if s["active"]:
            if s["leave"] and row.alive and not blocked:
                s["streak"] += 1
                if s["streak"] < recoveries:
                    return [(row.session, row.seq, fallback, "panic_recovery_pending", True)]
                s |= start()
            else:
                s["streak"] = 0
                return [(row.session, row.seq, fallback, "panic_recovery_blocked" if s["leave"] else "panic_active", True)]
        if not row.alive:
            return [(row.session, row.seq, fallback, "liveness_lost", False)]
        return [(row.session, row.seq, row.action, row.reason, False)]

    joined = decided.select("session", "seq", "action", "readiness", "reason").join(control, ["session", "seq"])
    return ordered_fold(joined, ["session"], ["seq"], start, step, "session long, seq long, action string, reason string, panic_active boolean")


def liveness(signals: DataFrame) -> DataFrame:
    """signals (session, seq, alive, null: no change) with the last known value, alive before the first."""
    return signals.withColumn("alive", F.coalesce(F.last("alive", ignorenulls=True).over(Window.partitionBy("session").orderBy("seq")), F.lit(True)))


def snapshot(observations: DataFrame) -> DataFrame:
    """(session, seq, capabilities): each session's latest window with its capabilities by name."""
    latest = Window.partitionBy("session")
    own = observations.withColumn("__last", F.max("seq").over(latest)).filter("seq = __last")
    return own.groupBy("session", "seq").agg(F.sort_array(F.collect_list(F.struct("capability", "state", "watermark_ms", "lag_ms"))).alias("capabilities"))


def safe_code(code: Column) -> Column:
    """A reason code as it may be shown, else null."""
    return F.when(code.rlike(r"^[a-z0-9_-]{1,64}$"), code)


def route(decided: DataFrame) -> DataFrame:
    """decisions with video and audio: protected media, full cover and silence, or none."""
    video = F.when(F.col("action") == "publish", "protected").when(F.col("action") == "full_redact", "covered")
    audio = F.when(F.col("action") == "publish", "protected").when(F.col("action") == "full_redact", "silence")
    return decided.withColumns({"video": video, "audio": audio})


def sink_events(routed: DataFrame) -> DataFrame:
    """(session, seq, ord, event): the decision first; then blocked, or video and audio."""
    events = F.when(F.col("video").isNull(), F.array(F.lit("decision"), F.lit("blocked"))).otherwise(F.array(F.lit("decision"), F.concat(F.lit("video:"), "video"), F.concat(F.lit("audio:"), "audio")))
    return routed.select("session", "seq", F.posexplode(events).alias("ord", "event"))


def outcome_metrics(routed: DataFrame) -> DataFrame:
    """Windows by action and readiness."""
    return routed.groupBy("action").agg(F.count("*").alias("windows"), F.count_if(F.col("readiness") == "degraded").alias("degraded"), F.count_if(F.col("readiness") == "unsafe").alias("unsafe"), F.countDistinct("session").alias("sessions"))


def observations_of(results: DataFrame, capability: str, *, ok: tuple[str, ...] = ("ok", "ready", "success")) -> DataFrame:
    """(session, seq, capability, state, watermark_ms, lag_ms) of a detector's results (status, watermark_ms, lag_ms)."""
    state = F.when(F.col("status").isin(*ok), "ready").when(F.col("status") == "processing", "processing").when(F.col("status") == "unavailable", "unavailable").otherwise("failed")
    return results.select("session", "seq", F.lit(capability).alias("capability"), state.alias("state"), "watermark_ms", "lag_ms")
