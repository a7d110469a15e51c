"""Audio: resampling, timelines, voice activity, speech segments, muting and the words spoken in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.folds import ordered_fold
from hushframe.operators import text_pii
from hushframe.operators.intervals import merge, overlap_join

# fixed values: spoken digits and symbols
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SYMBOLS = {"at": "@", "dot": ".", "period": ".", "underscore": "_", "dash": "-", "hyphen": "-", "plus": "+"}
EDGE = " ,;:!?"


def downmix(samples: Column, channels: Column) -> Column:
    """The mean of each frame's channels."""
    frames = F.sequence(F.lit(0), F.floor(F.size(samples) / channels).cast("int") - 1)
    mono = F.transform(frames, lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels)
    return F.when(F.size(samples) >= channels, mono).otherwise(F.array().cast("array<double>"))


def resample(samples: Column, source: Column, target: int) -> Column:
    """Linear interpolation to another rate; as many samples as rounds half to even, one at least."""
    n = F.size(samples)
    count = F.greatest(F.lit(1), F.bround(n * F.lit(float(target)) / source).cast("int"))
    last = (n - 1).cast("double")

    def at(i: Column) -> Column:
        place = F.least(last, i * source / F.lit(float(target)))
        low = F.floor(place).cast("int")
        left, right = F.get(samples, low), F.get(samples, F.least(low + 1, n - 1))
        return left + (right - left) * (place - low)

    return F.when(n == 0, samples).when(source == target, samples).otherwise(F.transform(F.sequence(F.lit(0), count - 1), at))


def decode_pcm(column: Column, form: str) -> Column:
    """Samples of little-endian bytes: pcm16 (by 1/32768) or float32; null where the length or a value is out of range."""

    @F.pandas_udf("array<double>")
    def decoded(values: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> list[float] | None:
            if raw is None or len(raw) % (2 if form == "pcm16" else 4):
                return None
            found = np.frombuffer(raw, "<i2" if form == "pcm16" else "<f4").astype(float) / (32768 if form == "pcm16" else 1)
            return None if not np.isfinite(found).all() or (np.abs(found) > 1).any() else found.tolist()

        return values.map(one)

    return decoded(column)


def chunks(segments: DataFrame, key: str, *, chunk_ms: int = 30) -> DataFrame:
    """(key, seq, start_ms, samples): segments (start_ms, rate, samples) cut into chunks of chunk_ms; the last may be short."""
    size = F.greatest(F.lit(1), F.bround(F.col("rate") * chunk_ms / 1000.0).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("samples") - 1), size)
    each = segments.filter(F.size("samples") > 0).select(key, "start_ms", "rate", "samples", size.alias("__size"), F.posexplode(starts).alias("seq", "__at"))
    begin = (F.col("start_ms") + F.bround(F.col("__at") * 1000.0 / F.col("rate"))).cast("long")
    return each.select(key, F.col("seq").cast("long").alias("seq"), begin.alias("start_ms"), F.slice("samples", F.col("__at") + 1, F.col("__size")).alias("samples"))


def timeline(chunk_rows: DataFrame, *, tolerance_ms: int = 1) -> DataFrame:
    """(stream, status): ok, or unsafe_timestamp_discontinuity if a chunk (seq, start_ms, rate, frames) isn't number + 1 or doesn't
    start within tolerance_ms of the end of the one before it. Ends are fractions, compared as whole numbers."""
    order = Window.partitionBy("stream").orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    gap = (F.col("start_ms") - before("start_ms")) * before("rate") - before("frames") * 1000
    bad = (F.col("seq") != before("seq") + 1) | (F.abs(gap) > tolerance_ms * before("rate"))
    return chunk_rows.withColumn("__bad", F.coalesce(bad, F.lit(False))).groupBy("stream").agg(F.when(F.bool_or("__bad"), "unsafe_timestamp_discontinuity").otherwise("ok").alias("status"))


def ring(chunk_rows: DataFrame, *, ring_ms: int = 1000) -> DataFrame:
    """chunks (stream, start_ms, end_ms) with ring_size: how many of the latest span ring_ms at most, one at least.

    Of the chunks that end no later, those that start ring_ms or less before its end. On a source timeline starts rise with ends, so that
    is a running count of ends without one of the starts that are too early.
    """
    ends = chunk_rows.select("*", F.col("end_ms").alias("__at"), F.lit(1).alias("__end"))
    starts = chunk_rows.select("stream", F.col("start_ms").alias("__at"), F.lit(0).alias("__end"))
    both = Window.partitionBy("stream").orderBy("__at")
    ended = F.sum("__end").over(both.rangeBetween(Window.unboundedPreceding, 0))
    early = F.coalesce(F.sum(1 - F.col("__end")).over(both.rangeBetween(Window.unboundedPreceding, -ring_ms - 1)), F.lit(0))
    counted = ends.unionByName(starts, allowMissingColumns=True).withColumn("ring_size", F.greatest(F.lit(1), ended - early).cast("int"))
    return counted.filter("__end = 1").drop("__at", "__end")


def release(chunk_rows: DataFrame) -> DataFrame:
    """(stream, watermark_ms, duration_ms): the last chunk's end, rounded up, of chunks (start_ms, rate, frames)."""
    end = F.ceil(F.col("start_ms") + F.col("frames") * 1000 / F.col("rate")).cast("long")
    exact = F.col("start_ms") + F.floor((F.col("frames") * 1000 + F.col("rate") - 1) / F.col("rate")).cast("long")
    return chunk_rows.groupBy("stream").agg(F.max(F.coalesce(exact, end)).alias("watermark_ms"), (F.max(F.coalesce(exact, end)) - F.min("start_ms")).alias("duration_ms"))


def voice_windows(voiced: DataFrame, key: str, *, gap_ms: int = 90, least_ms: int = 120, most_ms: int = 15_000) -> DataFrame:
    """(key, start_ms, end_ms): voiced frames [start_ms, end_ms) merged over gaps of gap_ms, without short ones, cut at most_ms."""
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = voiced.withColumn("__new", F.when(before.isNull() | (F.col("start_ms") - before > gap_ms), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(key, "__island").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b")).filter(F.col("b") - F.col("a") >= least_ms)
    cut = merged.select(key, "b", F.explode(F.sequence("a", F.col("b") - 1, F.lit(most_ms).cast("long"))).alias("start_ms"))
    return cut.select(key, "start_ms", F.least(F.col("start_ms") + most_ms, "b").alias("end_ms")).filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def energy_frames(samples: DataFrame, key: str, *, frame: int, ms: int = 30, threshold: float = 0.015) -> DataFrame:
    """(key, start_ms, end_ms) of frames of `frame` samples (pos, value) whose root mean square reaches the threshold."""
    energy = samples.groupBy(key, F.floor(F.col("pos") / frame).alias("__f")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("n"))
    return energy.filter(F.col("rms") >= threshold).select(key, (F.col("__f") * ms).cast("long").alias("start_ms"), (F.col("__f") * ms + F.bround(F.col("n") * F.lit(float(ms)) / frame)).cast("long").alias("end_ms"))


def speech_segments(frames: DataFrame, *, pre_ms: int = 150, post_ms: int = 250, most_ms: int = 15_000, overlap_ms: int = 0) -> DataFrame:
    """(stream, segment, start_ms, end_ms): chunks (stream, seq, start_ms, end_ms, voice_start, voice_end; null without voice) in order.

    A segment opens pre_ms before its first voice (not before the first chunk since the last segment), stays open for post_ms after
    the last voice, and is split at most_ms.
    """

    def start() -> dict:
        return {"open": None, "end": None, "voice": None, "floor": None, "n": 0}

    def emit(state: dict, stream: int) -> list[tuple]:
        out = []
        if state["open"] is not None and state["end"] > state["open"]:
            out.append((stream, state["n"], state["open"], state["end"]))
            state["n"] += 1
        state |= {"floor": state["end"], "open": None, "voice": None}
        return out

    def step(state: dict, row) -> list[tuple]:
        out = []
        if state["floor"] is None:
            state["floor"] = row.start_ms
        if pd.notna(row.voice_start):
            if state["open"] is None:
                state["open"] = max(int(row.voice_start) - pre_ms, state["floor"])
            state["voice"] = int(row.voice_end)
            state["end"] = min(int(row.end_ms), state["voice"] + post_ms)
            while state["end"] - state["open"] >= most_ms:
                out.append((row.stream, state["n"], state["open"], state["open"] + most_ms))
                state |= {"n": state["n"] + 1, "open": state["open"] + most_ms - overlap_ms}
        elif state["open"] is not None:
            state["end"] = min(int(row.end_ms), state["voice"] + post_ms)
            if row.end_ms - state["voice"] >= post_ms:
                out += emit(state, row.stream)
        return out

    return ordered_fold(frames, ["stream"], ["seq"], start, step, "stream long, segment long, start_ms long, end_ms long", lambda state, key: emit(state, key[0]))


def mute(samples: DataFrame, intervals: DataFrame, key: str, *, bucket: int = 1000) -> DataFrame:
    """samples (key, pos, rate, value) with muted: whether the sample's time, pos/rate to (pos + 1)/rate s, overlaps an interval
    (start_ms, end_ms) at all; muted samples are 0. Intervals of one key are merged first, so they don't overlap, and each sample
    meets only those of its own time bucket: an equi-join."""
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", F.when(before.isNull() | (F.col("start_ms") > before), 1).otherwise(0))
    spans = marked.withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "__i").agg(F.min("start_ms").alias("__a"), F.max("end_ms").alias("__b")).filter("__b > __a")
    touched = spans.select(key, "__a", "__b", F.explode(F.sequence(F.floor(F.col("__a") / bucket), F.floor(F.col("__b") / bucket))).alias("__bucket"))
    first, last = (F.floor((F.col("pos") + k) * 1000 / F.col("rate") / bucket) for k in (0, 1))
    # a sample that lies across a bucket's end asks in all its buckets
    asked = samples.select("*", F.explode(F.sequence(first, last)).alias("__bucket"))
    held = touched.groupBy(key, "__bucket").agg(F.collect_list(F.struct("__a", "__b")).alias("__spans"))  # at most bucket / 2 + 1
    met = asked.join(held, [key, "__bucket"], "left").withColumn("__hit", F.coalesce(F.exists("__spans", lambda s: ((F.col("pos") + 1) * 1000 > s["__a"] * F.col("rate")) & (F.col("pos") * 1000 < s["__b"] * F.col("rate"))), F.lit(False)))
    found = met.drop("__spans", "__bucket").groupBy(*samples.columns).agg(F.bool_or("__hit").alias("muted"))
    return found.withColumn("value", F.when(F.col("muted"), 0.0).otherwise(F.col("value")))


def mute_pcm16(rows: DataFrame, audio: str, spans: str, rate: str) -> DataFrame:
    """rows with the 16-bit mono audio bytes silenced in spans, an array of (start_ms, end_ms): floor of starts, ceiling of ends."""
    at = [rows.columns.index(c) for c in (audio, spans, rate)]

    def muted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                data = np.frombuffer(row[at[0]], "<i2").copy()
                for s in row[at[1]] if row[at[1]] is not None else ():
                    data[int(s["start_ms"] * row[at[2]] // 1000) : -int(-s["end_ms"] * row[at[2]] // 1000)] = 0
                out.append(data.tobytes())
            frame[audio] = out
            yield frame

    return rows.mapInPandas(muted, rows.limit(0).schema)


def queue_status(segments: DataFrame, *, most: int = 4, most_ms: int = 30_000) -> DataFrame:
    """(stream, status): overflow for more than `most` segments or more than most_ms of them, else ok."""
    return segments.groupBy("stream").agg(F.when((F.count("*") > most) | (F.sum(F.col("end_ms") - F.col("start_ms")) > most_ms), "unsafe_overflow").otherwise("ok").alias("status"))


def spoken_token(word: Column) -> Column:
    """A word as it would be written: digit and symbol words replaced, outer punctuation but the full stop stripped."""
    table = F.create_map(*[F.lit(x) for kv in {**SYMBOLS, **DIGITS}.items() for x in kv])
    pieces = F.filter(F.split(F.btrim(F.lower(F.regexp_replace(word, r"(?U)^\s+|\s+$", "")), F.lit(EDGE)), r"\s+"), lambda p: p != "")
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), F.btrim(p, F.lit(EDGE)))), " ")


def spoken_pii(words: DataFrame, key: str, config: text_pii.Config = text_pii.Config()) -> DataFrame:
    """(key, start_ms, end_ms, confidence, reason): spans of personal data in words (pos, word, start_ms, end_ms, confidence).

    Words are joined by single spaces in order, without those that are nothing but punctuation; a span covers the words it overlaps,
    from the first one's start to the last one's end, with the smallest of their confidences. A key's words are one transcript.
    """
    named = words.withColumn("token", spoken_token(F.col("word"))).filter("token <> ''")
    # running places: placing a transcript's words in one fold copies all words before each word
    before = Window.partitionBy(key).orderBy("pos", "token", "start_ms", "end_ms", "confidence").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("at", F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)))
    spoken = placed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "token", "start_ms", "end_ms", "confidence"))).alias("items"))
    text = F.array_join(F.transform("items", lambda w: w["token"]), " ")
    found = spoken.withColumn("text", text).withColumn("span", F.explode(text_pii.spans(F.col("text"), config)))
    covered = F.filter("items", lambda w: (w["at"] + F.length(w["token"]) > F.col("span.start")) & (w["at"] < F.col("span.end")))
    of = lambda name: F.transform("covered", lambda w: w[name])
    return found.withColumn("covered", covered).filter(F.size("covered") > 0).select(
        key, F.array_min(of("start_ms")).alias("start_ms"), F.array_max(of("end_ms")).alias("end_ms"), F.array_min(of("confidence")).alias("confidence"), F.col("span.category").alias("reason")
    )


def timeline_words(windows: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, window, pos, word, start_ms, end_ms, confidence): a transcriber's words on the source timeline.

    windows: key, window, start_ms, end_ms, text and confidence; words: key, window, pos, word, from_ms, to_ms and confidence, relative to
    their window. Words are clamped to the window and empty ones go; a window that has none left gives its whole text as one word.
    """
    begin, end = F.greatest(F.col("start_ms"), F.col("start_ms") + F.col("from_ms")), F.least(F.col("end_ms"), F.col("start_ms") + F.col("to_ms"))
    own = words.withColumnRenamed("confidence", "__own").join(windows, [key, "window"])
    placed = own.select(key, "window", "pos", "word", begin.alias("a"), end.alias("b"), F.col("__own").alias("confidence")).filter("b > a AND trim(word) <> ''")
    silent = windows.join(placed.select(key, "window").distinct(), [key, "window"], "left_anti").filter("trim(text) <> ''")
    whole = silent.select(key, "window", F.lit(0).cast("long").alias("pos"), F.col("text").alias("word"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), "confidence")
    return placed.withColumn("pos", F.col("pos").cast("long")).unionByName(whole).withColumnsRenamed({"a": "start_ms", "b": "end_ms"})


def classified_segments(segments: DataFrame, words: DataFrame, key: str, *, bucket: int = 15_000) -> DataFrame:
    """segments (key, segment, start_ms, end_ms) with n_words inside and status: ok, or unsafe_unclassified without any.

    words: key, from_ms, to_ms; a word is inside if it overlaps the segment.
    """
    found = overlap_join(segments, words.select(key, "from_ms", "to_ms"), key, bucket=bucket, left_span=("start_ms", "end_ms"), right_span=("from_ms", "to_ms"), keep=[key, "segment"])
    counted = found.groupBy(key, "segment", "start_ms", "end_ms").agg(F.count("from_ms").alias("n_words"))
    return counted.withColumn("status", F.when(F.col("n_words") > 0, "ok").otherwise("unsafe_unclassified"))


def one_chunk(segments: DataFrame, key: str) -> DataFrame:
    """(key, seq, start_ms, samples): each segment with samples as one chunk, number 0."""
    return segments.filter(F.size("samples") > 0).select(key, F.lit(0).cast("long").alias("seq"), "start_ms", "samples")


def segmenter_input(chunk_rows: DataFrame) -> DataFrame:
    """chunks (stream, seq, place, start_ms, rate, frames, channels, form) in order of place with problem, the first that applies, or null:
    not mono_float32, a number that doesn't rise, or a start before the end of the chunk before it."""
    order = Window.partitionBy("stream").orderBy("place")
    before = lambda c: F.lag(c).over(order)
    overlap = (F.col("start_ms") - before("start_ms")) * before("rate") < before("frames") * 1000
    problem = F.when((F.col("channels") != 1) | (F.col("form") != "float32"), "not_mono_float32").when(F.col("seq") <= before("seq"), "sequence").when(overlap, "overlap")
    return chunk_rows.withColumn("problem", problem)


def join_chunks(chunk_rows: DataFrame) -> DataFrame:
    """(stream, start_ms, end_ms, rate, samples, status): chunks (seq, start_ms, rate, channels, form, samples) as one segment for analysis;
    format_mismatch and no samples if they differ in format."""
    form = F.struct("rate", "channels", "form")
    item = F.struct("seq", "start_ms", "rate", "samples")
    grouped = chunk_rows.groupBy("stream").agg(F.countDistinct(form).alias("forms"), F.sort_array(F.collect_list(item)).alias("items"))
    first, last = F.get("items", F.lit(0)), F.element_at("items", -1)
    end = F.bround(last["start_ms"] + F.size(last["samples"]) * F.lit(1000.0) / last["rate"]).cast("long")
    same = F.col("forms") == 1
    return grouped.select("stream", first["start_ms"].alias("start_ms"), end.alias("end_ms"), F.when(same, first["rate"]).alias("rate"), F.when(same, F.flatten(F.transform("items", lambda x: x["samples"]))).alias("samples"), F.when(same, "ok").otherwise("format_mismatch").alias("status"))


def silence(samples: Column) -> Column:
    """As many zeros as there are samples."""
    return F.transform(samples, lambda x: F.lit(0.0))


def silence_bytes(data: Column) -> Column:
    """As many zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), F.octet_length(data)))


def transcript_text(words: DataFrame, key: str) -> DataFrame:
    """(key, text): the words (pos, word) of each transcript, trimmed and joined by single spaces."""
    return words.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.trim("word").alias("word")))), lambda w: w["word"]), " ").alias("text"))


def model_windows(found: DataFrame, key: str, *, most_ms: int = 15_000) -> DataFrame:
    """(key, start_ms, end_ms, status): what a voice model found (segment_ms, segment_end_ms, rate, from_sample, to_sample) on the source
    timeline, rounded half to even and cut at most_ms. Such models take 8 and 16 kHz only: other rates give one row rate."""
    place = lambda c: F.col("segment_ms") + F.bround(F.col(c) * 1000.0 / F.col("rate")).cast("long")
    ok = F.col("rate").isin(8000, 16_000)
    own = found.withColumns({"a": place("from_sample"), "b": F.least(F.col("segment_end_ms"), place("to_sample"))})
    each = own.filter(ok & (F.col("b") > F.col("a"))).select(key, "b", F.explode(F.sequence("a", F.col("b") - 1, F.lit(most_ms).cast("long"))).alias("start_ms"))
    wrong = own.filter(~ok).select(key, F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit("rate").alias("status")).distinct()
    return each.select(key, "start_ms", F.least(F.col("start_ms") + most_ms, "b").alias("end_ms"), F.lit("ok").alias("status")).union(wrong)


def detect_spoken(segments: DataFrame, voice: DataFrame, words: DataFrame, key: str, *, padding: int = 250, gap: int = 100, most_ms: int = 120_000, config: text_pii.Config = text_pii.Config()) -> tuple[DataFrame, DataFrame]:
    """Voice, words, personal data and interval policy in a row: (key, status) of segments (start_ms, end_ms, n_samples), and the intervals.

    Status: no_samples, too_long, no_voice (its words aren't looked at) or ok. Intervals are padded, clamped to their segment, merged.
    """
    voiced = voice.select(key).distinct().withColumn("__voiced", F.lit(True))
    status = F.when(F.col("n_samples") == 0, "no_samples").when(F.col("end_ms") - F.col("start_ms") > most_ms, "too_long").when(F.col("__voiced").isNull(), "no_voice").otherwise("ok")
    known = segments.join(voiced, key, "left").withColumn("status", status)
    ok = known.filter("status = 'ok'").select(key, F.col("start_ms").alias("segment_ms"), F.col("end_ms").alias("segment_end_ms"))
    found = spoken_pii(words.join(ok.select(key), key, "left_semi"), key, config).join(ok, key)
    rows = found.withColumns({"detector": F.lit("spoken"), "event_id": F.lit(0).cast("long")})
    merged = merge(rows, key, padding=padding, gap=gap, begin=F.col("segment_ms"), finish=F.col("segment_end_ms"))
    return known.select(key, "status"), merged


def outcome(calls: DataFrame) -> DataFrame:
    """calls with status, the first that applies, and safe: whether what came out may be released.

    calls: chunks (number), timeline (of timeline()), input_problem, vad (ok or failed), segments, duration_ms, deadline_met, unclassified,
    transcription (ok or failed), muted (ok or failed).
    """
    c = F.col
    status = (
        F.when(c("chunks") == 0, "no_speech").when(c("timeline") != "ok", "unsafe_timestamp_discontinuity").when(c("input_problem").isNotNull(), "unsafe_input").when(c("vad") != "ok", "unsafe_vad_failure")
        .when(c("segments") == 0, "no_speech").when((c("segments") > 4) | (c("duration_ms") > 30_000), "unsafe_queue_overflow").when(~c("deadline_met"), "unsafe_deadline").when(c("unclassified"), "unsafe_unclassified")
        .when(c("transcription") != "ok", "unsafe_transcription_failure").when(c("muted") != "ok", "unsafe_input").otherwise("ok")
    )
    return calls.withColumn("status", status).withColumn("safe", F.col("status").isin("ok", "no_speech") & (c("chunks") > 0))


def normalise_chunk(chunk_rows: DataFrame, *, rate: int = 16_000) -> DataFrame:
    """chunks (rate, channels, samples) as mono at one rate: the mean of the channels, then resampled; the form is float32 from then on."""
    mono = chunk_rows.withColumn("samples", downmix(F.col("samples"), F.col("channels")))
    return mono.withColumn("samples", resample(F.col("samples"), F.col("rate"), rate)).withColumns({"rate": F.lit(rate), "channels": F.lit(1), "form": F.lit("float32")})
