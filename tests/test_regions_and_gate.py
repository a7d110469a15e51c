import numpy as np
from pyspark.sql import functions as F

from hushframe.operators import cross_modal, evaluation, gate, geometry, identity, intervals, raster, regions
from hushframe.operators.audio import mute_pcm16, spoken_pii, spoken_token


def test_padding_clamps(spark):
    row = spark.createDataFrame([(0.02, 0.2, 0.2, 0.2, 100, 100, 100)], "x double, y double, w double, h double, ts_ms long, width int, height int")
    r = geometry.pad_regions(row, pad_px=5, ttl_ms=50).first()
    assert (r["x"], round(r["y"], 9), round(r["w"], 9), r["expires_ms"]) == (0.0, 0.15, 0.27, 150)


def test_overlapping_boxes_merge(spark):
    rows = spark.createDataFrame([(1, 1, "face", 0.9, 0.2, 0.2, 0.2, 0.2), (1, 2, "face", 0.8, 0.3, 0.2, 0.2, 0.2), (1, 3, "email", 0.8, 0.3, 0.2, 0.2, 0.2)], "frame long, ordinal long, kind string, confidence double, x double, y double, w double, h double")
    got = regions.merge_regions(rows).orderBy("place").collect()
    assert [(r["region"]["kind"], round(r["region"]["w"], 9), r["region"]["n"]) for r in got] == [("email", 0.2, 1), ("face", 0.3, 2)]


def test_grown_boxes_are_not_merged_with_each_other(spark):
    rows = [(1, 1, "face", 0.9, 0.0, 0.0, 0.2, 0.2), (1, 2, "face", 0.8, 0.5, 0.0, 0.2, 0.2), (1, 3, "face", 0.7, 0.15, 0.0, 0.4, 0.2)]
    df = spark.createDataFrame(rows, "frame long, ordinal long, kind string, confidence double, x double, y double, w double, h double")
    assert regions.merge_regions(df).count() == 2


def test_tracks_keep_keys_until_they_expire(spark):
    region = lambda x: [("face", x, 0.1, 0.2, 0.2, None)]
    rows = [(1, 0, 0, "d", "success", 50, region(0.1)), (1, 1, 25, "d", "skipped", 50, None), (1, 2, 40, "d", "success", 50, region(0.12)), (1, 3, 95, "d", "error", 50, None)]
    df = spark.createDataFrame(rows, "stream long, seq long, ts_ms long, detector string, status string, ttl_ms long, regions array<struct<kind:string,x:double,y:double,w:double,h:double,track:string>>")
    got = {r["seq"]: r["region_key"] for r in regions.track(df).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] is None


def test_letterbox(spark):
    t = geometry.letterbox(F.lit(200), F.lit(100), 200)
    box = geometry.from_letterbox(F.lit(20), F.lit(110), F.lit(80), F.lit(150), t)
    assert tuple(spark.range(1).select(*[c.alias(k) for k, c in box.items()]).first()) == (20.0, 60.0, 80.0, 100.0)


def test_merged_intervals(spark):
    rows = [(1, 1, 1050, 1100, 0.7, "a", "phone_number"), (1, 2, 1160, 1200, 0.9, "b", "email")]
    df = spark.createDataFrame(rows, "stream long, event_id long, start_ms long, end_ms long, confidence double, detector string, reason string")
    got = intervals.merge(df, "stream", padding=50, gap=20, begin=F.lit(1000), finish=F.lit(1500)).collect()
    assert [(r["start_ms"], r["end_ms"], r["confidence"], r["reason"]) for r in got] == [(1000, 1250, 0.9, "phone_number, email")]


def test_reason_fold(spark):
    fold = lambda *r: spark.range(1).select(intervals.fold_reasons(F.array(*map(F.lit, r)))).first()[0]
    assert fold("a", "b", "a") == "a, b, a"
    assert fold("a", "a", "", "b") == "a, b"


def test_spoken_words(spark):
    digits = "zero two oh seven nine four six three one eight".split()
    rows = [(1, k, w, k * 30, k * 30 + 30, 0.9) for k, w in enumerate(digits)] + [(2, k, w, k * 100, k * 100 + 100, 0.5) for k, w in enumerate("kite at wind dot test".split())]
    df = spark.createDataFrame(rows, "id long, pos long, word string, start_ms long, end_ms long, confidence double")
    assert {(r["id"], r["start_ms"], r["end_ms"], r["reason"]) for r in spoken_pii(df, "id").collect()} == {(1, 0, 300, "phone_number"), (2, 0, 500, "email")}
    assert spark.range(1).select(spoken_token(F.lit(" Dot, "))).first()[0] == "."


def test_cosine_bands(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0], 0.9, 0.9), (2, [0.6, 0.8], 0.9, 0.9), (3, None, 0.9, 0.9), (4, [1.0, 0.0], 0.2, 0.9), (5, [0.0, 1.0], 0.9, 0.9)], "i long, embedding array<double>, confidence double, quality double")
    template = identity.enroll(spark.createDataFrame([(0, 1, [2.0, 0.0])], "creator long, o long, embedding array<double>"), "creator", "embedding")
    assert {r["i"]: r["status"] for r in identity.decide(faces, template).collect()} == {1: "creator", 2: "ambiguous", 3: "embedding_failed", 4: "low_quality", 5: "unknown"}
    assert {r["status"] for r in identity.decide(faces, template.limit(0)).collect()} == {"no_enrollment"}


def test_synchroniser_overflow_and_flush():
    s = cross_modal.Synchroniser(33, 50, 50, 1, 1000)
    assert s.frame(0, 0) == []
    assert s.frame(1, 10) == [(0, "failed", "unsafe_buffer_overflow", None)]
    assert s.audio(200, [(20, 30, 0.9)]) == [(1, "sensitive_speech", None, 190)]
    assert s.frame(2, 5) == [] and s.last_frame == 10
    s.frame(3, 500)
    assert s.audio(100, []) == [(3, "failed", "unsafe_timestamp_discontinuity", None)]


def test_streamed_synchroniser_equals_the_batch(spark, tmp_path):
    from hushframe.streaming import twins

    schema = "stream long, ord long, kind string, seq long, ts_ms long, start_ms long, end_ms long, confidence double, watermark_ms long"
    rows = [(k % 2, k, "frame", k, k * 40, None, None, None, None) if k % 3 else (k % 2, k, "audio", None, None, k * 40 - 30, k * 40 - 10, 0.9, k * 40) for k in range(60)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = twins.synchronise(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("synced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("synced").collect()}
    want = {tuple(r) for r in cross_modal.synchronise(df).collect() if r["reason"] != "unsafe_audio_incomplete"}
    assert got == want and want


def test_panic_needs_two_recoveries(spark):
    decided = spark.createDataFrame([(1, k, "publish", "ready", "ready") for k in range(1, 6)], "session long, seq long, action string, readiness string, reason string")
    control = spark.createDataFrame([(1, 1, True, False, True), (1, 2, False, False, True), (1, 3, False, True, True), (1, 4, False, False, True), (1, 5, False, False, False)], "session long, seq long, panic boolean, leave boolean, alive boolean")
    got = [(r["reason"], r["panic_active"]) for r in gate.panic(decided, control).orderBy("seq").collect()]
    assert got == [("panic_active", True), ("panic_active", True), ("panic_recovery_pending", True), ("ready", False), ("liveness_lost", False)]


def test_unknown_capability_is_invalid(spark):
    windows = spark.createDataFrame([(1, 1, 0, 100)], "session long, seq long, start_ms long, end_ms long")
    policies = spark.createDataFrame([(1, "video", True, True, None)], "ord int, capability string, required boolean, enabled boolean, max_lag long")
    seen = lambda *rows: spark.createDataFrame(list(rows), "session long, seq long, capability string, state string, watermark_ms long, lag_ms long")
    decide = lambda o: tuple(gate.decisions(windows, policies, o).first())[2:5]
    assert decide(seen((1, 1, "video", "ready", 99, 0))) == ("full_redact", "unsafe", "required_watermark_pending")
    assert decide(seen((1, 1, "video", "ready", 100, 0))) == ("publish", "ready", "ready")
    assert decide(seen((1, 1, "video", "ready", 100, 0), (1, 1, "x", "ready", 100, 0))) == ("full_redact", "unsafe", "invalid_observation")
    assert decide(seen()) == ("full_redact", "unsafe", "required_observation_missing")


def test_perfect_detection(spark):
    truth = spark.createDataFrame([(1, "plate", 1, 0.0, 0.0, 1.0, 1.0)], "image long, class string, ordinal long, x1 double, y1 double, x2 double, y2 double")
    found = truth.withColumn("score", F.lit(0.9))
    matched = evaluation.match(truth, found, thresholds=evaluation.THRESHOLDS)
    r = evaluation.precision_recall(matched, truth).filter("class = 'plate' and threshold = 0.5").first()
    assert (r["precision"], r["recall"], r["miss_rate"]) == (1.0, 1.0, 0.0)
    assert tuple(evaluation.mean_average_precision(evaluation.average_precision(matched, truth)).first()) == (1.0, 1.0)
    low = evaluation.precision_recall(evaluation.match(truth, found.withColumn("score", F.lit(0.2))), truth, least_score=0.5).filter("class = 'plate'").first()
    assert (low["precision"], low["recall"], low["miss_rate"]) == (0.0, 0.0, 1.0)


def test_raster_styles():
    image = np.arange(10 * 8 * 3, dtype=np.uint8).reshape(8, 10, 3)
    out = raster.compose(image, [(2, 1, 6, 5)], "cover", colour=(255, 0, 0))
    assert tuple(out[1, 2]) == (255, 0, 0) and (out[0] == image[0]).all()
    blurred = raster.compose(image, [(0, 0, 10, 8)], "blur", radius=1)
    assert (blurred[0, 0] == image[:2, :2].reshape(-1, 3).astype(int).sum(0) // 4).all()
    pixels = raster.compose(image, [(0, 0, 10, 8)], "pixelate", block=8)
    assert (pixels[0, 0] == image[4, 4]).all() and (pixels[0, 9] == image[4, 9]).all()


def test_muted_bytes(spark):
    from hushframe.sources.media import wav_bytes

    rows = spark.createDataFrame([(bytearray(np.full(160, 100, "<i2").tobytes()), [(2, 5)], 16000)], "audio binary, spans array<struct<start_ms:long,end_ms:long>>, rate int")
    out = np.frombuffer(bytes(mute_pcm16(rows, "audio", "spans", "rate").first()["audio"]), "<i2")
    assert (out[32:80] == 0).all() and (out[:32] == 100).all() and (out[80:] == 100).all()
    assert wav_bytes(np.zeros(10), 8000)[:4] == b"RIFF"


def test_wav_files(spark, tmp_path):
    from hushframe.sources import media

    (tmp_path / "a.wav").write_bytes(media.wav_bytes(np.array([0.0, 0.5, -0.5]), 8000))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    got = {r["path"][-5:]: r for r in media.read_wav(spark, str(tmp_path)).collect()}
    assert got["a.wav"]["samples"] == [0.0, 0.5, -0.5] and got["b.wav"]["status"] == "not_pcm16"
    assert media.read_digests(spark, str(tmp_path)).count() == 2
