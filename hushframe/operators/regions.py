"""Regions over time: greedy merging, expiry, association with earlier frames, cadence and detectors' outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.folds import ordered_fold
from hushframe.operators.intervals import overlap_join

REGION = "struct<kind:string,confidence:double,x:double,y:double,w:double,h:double,detector:string,track:string,n:int>"


def _shared(a: Column, b: Column) -> Column:
    across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)


def _joined(a: Column, b: Column) -> Column:
    """The box around both, the larger confidence, all detectors, the track if it is the same."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    w, h = F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y
    detectors = F.array_join(F.array_sort(F.array_distinct(F.split(F.concat_ws(",", a["detector"], b["detector"]), ","))), ",")
    return F.struct(a["kind"], F.greatest(a["confidence"], b["confidence"]), x, y, w, h, detectors, F.when(a["track"] == b["track"], a["track"]), a["n"] + b["n"]).cast(REGION)


def merge_regions(regions: DataFrame, frame: str = "frame", *, least_iou: float = 0.0, most: int = 256) -> DataFrame:
    """(frame, place, region, over_limit): each frame's regions merged, in order of kind and confidence (high first), then ordinal.

    A region joins the first one so far of its kind with which it shares area and has least_iou; the grown box is what later ones are
    compared with, and grown boxes aren't merged with each other. over_limit says that the frame has more than `most` in the end.
    """
    has = lambda c: F.col(c) if c in regions.columns else F.lit(None).cast("string")
    item = F.struct(F.col("kind"), (-F.col("confidence")).alias("minus"), F.col("ordinal"), F.struct(F.col("kind"), F.col("confidence"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.coalesce(has("detector"), F.lit("")), has("track"), F.lit(1)).cast(REGION).alias("region"))
    grouped = regions.groupBy(frame).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        r = x["region"]

        def fits(o: Column) -> Column:
            shared = _shared(o, r)
            return (o["kind"] == r["kind"]) & (shared > 0) & (shared / (o["w"] * o["h"] + r["w"] * r["h"] - shared) >= least_iou)

        at = F.array_position(F.transform(acc, fits), True)
        return F.when(at == 0, F.concat(acc, F.array(r))).otherwise(F.transform(acc, lambda o, k: F.when(k + 1 == at, _joined(o, r)).otherwise(o)))

    merged = grouped.select(frame, F.aggregate("items", F.array().cast(f"array<{REGION}>"), step).alias("regions"))
    return merged.select(frame, (F.size("regions") > most).alias("over_limit"), F.posexplode("regions").alias("place", "region"))


def active(frames: DataFrame, regions: DataFrame, key: str, *, bucket: int) -> DataFrame:
    """(key, seq, ts_ms, active): how many regions [from_ms, expires_ms) are live at each frame; a region that ends now is not."""
    moments = frames.select(key, "seq", "ts_ms", (F.col("ts_ms") + 1).alias("ts_end"))
    found = overlap_join(moments, regions.select(key, "from_ms", "expires_ms"), key, bucket=bucket, left_span=("ts_ms", "ts_end"), right_span=("from_ms", "expires_ms"), keep=[key, "seq"])
    return found.groupBy(key, "seq", "ts_ms").agg(F.count("from_ms").alias("active"))


def _iou(a: dict, b: dict) -> float:
    across = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    down = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - across * down
    return across * down / union if union > 0 else 0.0


def track(frames: DataFrame, *, least_iou: float = 0.3) -> DataFrame:
    """(stream, seq, detector, region_key, kind, status): each detector's live regions after each frame, with lasting keys.

    frames: stream, seq, ts_ms, detector, status, ttl_ms and regions, an array of (kind, x, y, w, h, track). After a success each
    region takes the key of an earlier live one of its detector and kind: the first with the same track, else the one of the largest
    IoU of least_iou or more, else a new key; the detector's other keys go. After anything else all keys stay until they expire. A
    frame earlier than the last one has status out_of_order and changes nothing.
    """

    def start() -> dict:
        return {"live": {}, "next": 0, "last": None}

    def step(state: dict, row) -> list[tuple]:
        if state["last"] is not None and row.ts_ms < state["last"]:
            return [(row.stream, row.seq, row.detector, None, None, "out_of_order")]
        state["last"] = row.ts_ms
        live = state["live"]
        for k in [k for k, r in live.items() if r["expires"] <= row.ts_ms]:
            del live[k]
        if row.status == "success":
            earlier, used = [k for k, r in live.items() if r["detector"] == row.detector], set()
            for region in row.regions if row.regions is not None else ():
                region = region if isinstance(region, dict) else region.asDict()
                own = [k for k in earlier if k not in used and live[k]["kind"] == region["kind"]]
                found = next((k for k in own if region["track"] and live[k]["track"] == region["track"]), None)
                if found is None:
                    best = least_iou
                    for k in own:
                        value = _iou(live[k], region)
                        if value >= least_iou and (found is None or value > best):
                            found, best = k, value
                if found is None:
                    found, state["next"] = state["next"], state["next"] + 1
                used.add(found)
                live[found] = region | {"detector": row.detector, "expires": row.ts_ms + row.ttl_ms}
            for k in earlier:
                if k not in used:
                    del live[k]
        shown = [(row.stream, row.seq, row.detector, k, r["kind"], row.status) for k, r in live.items() if r["detector"] == row.detector]
        return shown or [(row.stream, row.seq, row.detector, None, None, row.status)]

    return ordered_fold(frames, ["stream"], ["seq", "detector"], start, step, "stream long, seq long, detector string, region_key long, kind string, status string")


def run_status(runs: DataFrame, *, cadence: int, timeout_ms: float) -> DataFrame:
    """runs (seq, outcome, duration_ms) with status: skipped off cadence, timeout when called too long, else by outcome."""
    status = F.when(F.col("seq") % cadence != 0, "skipped").when((F.col("outcome") == "called") & (F.col("duration_ms") > timeout_ms), "timeout").when(F.col("outcome") == "called", "success").otherwise(F.col("outcome"))
    return runs.withColumn("status", status)


def detector_metrics(runs: DataFrame) -> DataFrame:
    """Counts and times by detector; timeouts are failures too, and skipped runs are no calls."""
    is_ = lambda *s: F.col("status").isin(*s)
    own = F.when(~is_("skipped"), F.col("duration_ms"))
    return runs.groupBy("detector").agg(
        F.count_if(~is_("skipped")).alias("calls"), F.count_if(is_("success")).alias("successes"), F.count_if(is_("skipped")).alias("skipped"), F.count_if(is_("timeout")).alias("timeouts"),
        F.count_if(is_("timeout", "unavailable", "invalid", "error")).alias("failures"), F.round(F.sum(own), 3).alias("total_ms"), F.round(F.max(own), 3).alias("max_ms"),
    )


def last_known(frames: DataFrame, value: str, *, cadence: int, ttl: int) -> DataFrame:
    """frames (stream, seq) with reused and age: the frame of the last detection, if it is at most ttl frames old, else null."""
    order = Window.partitionBy("stream").orderBy("seq")
    at = F.last(F.when(F.col("seq") % cadence == 0, F.col("seq")), ignorenulls=True).over(order)
    what = F.last(F.when(F.col("seq") % cadence == 0, F.col(value)), ignorenulls=True).over(order)
    age = F.col("seq") - at
    return frames.withColumns({"age": F.when(age <= ttl, age), "reused": F.when(age <= ttl, what)})


def registration_problem(registrations: DataFrame) -> DataFrame:
    """registrations (ord, name, cadence, timeout_ms, ttl_ms, concurrency) with problem: the first rule that one breaks, or null.

    Names are not empty and unique (the first one in order stays); numbers are above 0.
    """
    nth = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    c = F.col
    problem = F.when(F.trim(F.coalesce(c("name"), F.lit(""))) == "", "name").when(nth > 1, "duplicate").when(c("cadence") <= 0, "cadence").when((c("timeout_ms") <= 0) | (c("ttl_ms") <= 0), "duration").when(c("concurrency") <= 0, "concurrency")
    return registrations.withColumn("problem", problem)


#: Statuses of a run that failed.
FAILED = ("timeout", "unavailable", "invalid", "error")


def failed_runs(runs: Column) -> Column:
    """Those of an array of runs (status) that failed."""
    return F.filter(runs, lambda r: r["status"].isin(*FAILED))


def run_outcome(error: Column) -> Column:
    """The status that an error of a named kind stands for; null: none, anything unknown: error."""
    return F.when(error.isNull(), "success").when(error == "timeout", "timeout").when(error == "unavailable", "unavailable").when(error.isin("type", "value"), "invalid").otherwise("error")


def queue_metrics(frames: DataFrame, key: str) -> DataFrame:
    """(key, max_pending, total_wait_ms) of frames (pending, wait_ms): negative waits are 0."""
    return frames.groupBy(key).agg(F.max("pending").alias("max_pending"), F.sum(F.greatest(F.lit(0.0), F.col("wait_ms"))).alias("total_wait_ms"))


def release_times(frames: DataFrame, key: str) -> DataFrame:
    """frames (seq, done_ms) with released_ms: a frame waits for all earlier ones, so it is out at the latest time so far."""
    return frames.withColumn("released_ms", F.max("done_ms").over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def live_regions(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """(stream, seq, detector, from_seq, ...): the regions that each detector has at each frame, of runs (stream, seq, ts_ms, detector,
    status) and regions (stream, seq, detector, expires_ms, ...): those of its last success so far, until they expire."""
    order = Window.partitionBy("stream", "detector").orderBy("seq")
    last = F.last(F.when(F.col("status") == "success", F.col("seq")), ignorenulls=True).over(order)
    at = runs.select("stream", "seq", "ts_ms", "detector", last.alias("from_seq")).filter("from_seq is not null")
    own = regions.withColumnRenamed("seq", "from_seq")
    return at.join(own, ["stream", "detector", "from_seq"]).filter(F.col("expires_ms") > F.col("ts_ms"))


def protected_frames(frames: DataFrame, runs: DataFrame, regions: DataFrame, *, most: int = 256, least_iou: float = 0.0) -> DataFrame:
    """(stream, seq, n_regions, failures, render_status): what comes of each frame (stream, seq, has_payload) after its detectors' runs.

    Live regions of all detectors are merged; more than `most` of them, or none that fit a frame without payload, are not rendered.
    """
    live = live_regions(runs, regions).withColumn("frame", F.struct("stream", "seq")).withColumn("ordinal", F.struct("detector", "from_seq", "ordinal"))
    merged = merge_regions(live, least_iou=least_iou, most=most).groupBy("frame").agg(F.count("*").alias("n")).select("frame.*", "n")
    failed = runs.groupBy("stream", "seq").agg(F.count_if(F.col("status").isin(*FAILED)).alias("failures"))
    own = frames.join(merged, ["stream", "seq"], "left").join(failed, ["stream", "seq"], "left").na.fill(0, ["n", "failures"])
    status = F.when(F.col("n") > most, "error").when(~F.col("has_payload"), "no_payload").otherwise("rendered")
    return own.select("stream", "seq", F.col("n").alias("n_regions"), "failures", status.alias("render_status"))
