import json

import numpy as np
import pytest

from hushframe.functions.folds import ordered_fold
from hushframe.operators import audio, identity, regions, windows
from hushframe.sources import media


def test_keys_of_a_fold_are_exact(spark):
    """Null keys are one key, and long keys that a float can't tell apart are two."""
    rows = [(None, 1, 5), (None, 2, None), (None, 3, 7), (2**60 + 1, 1, 2**60 + 1), (2**60 + 3, 1, 2**60 + 3)]
    df = spark.createDataFrame(rows, "key long, ord long, value long").repartition(3)

    def step(state, row):
        state.append(row.value)
        return [(row.key, len(state), row.value)]

    got = ordered_fold(df, ["key"], ["ord"], list, step, "key long, n long, value long", lambda state, key: [(key[0], -len(state), None)]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 1, 5), (None, 2, None), (None, 3, 7), (None, -3, None), (2**60 + 1, 1, 2**60 + 1), (2**60 + 1, -1, None), (2**60 + 3, 1, 2**60 + 3), (2**60 + 3, -1, None)]))


def test_an_empty_fold(spark):
    df = spark.createDataFrame([], "key long, ord long")
    assert ordered_fold(df, ["key"], ["ord"], dict, lambda s, r: [(1,)], "n long", lambda s, k: [(2,)]).count() == 0


def test_several_regions_are_matched_greedily(spark):
    """By the definition, on frames of several regions: the first of the same track, then the largest overlap, then a new key."""
    region = lambda kind, x, track=None: (kind, x, 0.0, 0.2, 0.2, track)
    first = [region("face", 0.0), region("face", 0.5, "t"), region("plate", 0.0)]
    second = [region("face", 0.05), region("face", 0.02), region("face", 0.9, "t"), region("plate", 0.5)]
    df = spark.createDataFrame([(1, 0, 0, "d", "success", 50, first), (1, 1, 10, "d", "success", 50, second)], "stream long, seq long, ts_ms long, detector string, status string, ttl_ms long, regions array<struct<kind:string,x:double,y:double,w:double,h:double,track:string>>")
    got = sorted((r["seq"], r["region_key"], r["kind"]) for r in regions.track(df).collect())
    assert got == [(0, 0, "face"), (0, 1, "face"), (0, 2, "plate"), (1, 0, "face"), (1, 1, "face"), (1, 3, "face"), (1, 4, "plate")]


def test_wav_files(spark, tmp_path):
    samples = np.array([0.5, -0.25, 0.125, 1.0] * 100)
    media.write_wav(spark, samples, 1000, f"{tmp_path}/a.wav", mute=((100, 150), (390, 500)))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    got = {r["path"].rpartition("/")[2]: r for r in media.read_wav(spark, f"{tmp_path}/*.wav", start_ms=70).collect()}
    assert (got["b.wav"]["status"], got["b.wav"]["samples"]) == ("not_pcm16", None)
    found, want = np.array(got["a.wav"]["samples"]), samples.copy()
    want[100:150] = want[390:] = 0
    assert (got["a.wav"]["status"], got["a.wav"]["rate"], got["a.wav"]["start_ms"]) == ("ok", 1000, 70) and abs(found - want).max() < 1e-4
    assert media.read_wav(spark, f"{tmp_path}/a.wav", most_ms=100).first()["status"] == "duration"


def test_digests_and_images(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    assert media.read_digests(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    with pytest.raises(ValueError):
        media.list_images(spark, str(tmp_path))
    (tmp_path / "y.PNG").write_bytes(b"12")
    assert [r["length"] for r in media.list_images(spark, str(tmp_path)).collect()] == [2]


def test_evaluation_inputs(spark, tmp_path):
    box = {"image_id": "i", "class_id": "k", "box": [0, 0, 2, 2]}
    good = {"fixture_version": "1", "ground_truth": [box], "predictions": [box | {"score": 0.5}], "performance": {"latency_ms": [3.0, 4.0], "seconds": 2.0}}
    (tmp_path / "good.json").write_text(json.dumps(good))
    truth, found, speed = media.read_evaluation(spark, f"{tmp_path}/good.json")
    assert truth.first()["x2"] == found.first()["x2"] == 2.0 and speed.first()["seconds"] == 2.0
    for name, change in {"fixture_version": {"fixture_version": " "}, "ground_truth": {"ground_truth": [box | {"box": [0, 0, 0, 2]}]}, "predictions": {"predictions": [box | {"score": 1.5}]}, "confidence_threshold": {"confidence_threshold": 2.0}, "seconds": {"performance": {"seconds": 0.0}}}.items():
        (tmp_path / "bad.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError, match=name):
            media.read_evaluation(spark, f"{tmp_path}/bad.json")


def test_reports(spark, tmp_path):
    media.write_report(spark.createDataFrame([(0.5, "m")], "recall double, model string"), str(tmp_path))
    assert (tmp_path / "report.json").read_text() == '{\n  "model": "m",\n  "recall": 0.5\n}\n'
    assert "| recall | 0.5 |" in (tmp_path / "report.md").read_text()


def test_muting_meets_spans_across_buckets(spark):
    samples = spark.createDataFrame([(1, k, 10, 1.0) for k in range(40)], "key long, pos long, rate long, value double")
    spans = spark.createDataFrame([(1, 950, 1010), (1, 990, 1200), (1, 2500, 2500), (2, 0, 9999)], "key long, start_ms long, end_ms long")
    assert sorted(r["pos"] for r in audio.mute(samples, spans, "key").filter("muted").collect()) == [9, 10, 11]


def test_vectors_of_several_sizes_are_no_enrollment(spark):
    rows = [(1, 1, "ok", 1, 0.9, 0.9, [1.0, 0.0], True), (1, 2, "ok", 1, 0.9, 0.9, [1.0], True), (2, 1, "ok", 1, 0.9, 0.9, [1.0], True)]
    triaged = identity.triage(spark.createDataFrame(rows, "key long, sample long, status string, faces int, confidence double, quality double, embedding array<double>, consent boolean"))
    got = {r["key"]: r for r in identity.with_templates(identity.outcome(triaged, "key"), identity.enroll(triaged, "key", "embedding"), "key").collect()}
    assert (got[1]["status"], [tuple(x) for x in got[1]["rejections"]]) == ("rejected", [(-1, "incompatible_embeddings")]) and got[2]["status"] == "enrolled"


def test_a_window_without_stages_is_redacted(spark):
    media_rows = spark.createDataFrame([(1, 1, 0, 33, False, 0, None, None, None, None, None)], "session long, seq long, ts_ms long, end_ms long, video_there boolean, failures int, render_status string, audio_status string, audio_watermark_ms long, audio_lag_ms long, sync_reason string")
    none = spark.createDataFrame([], "session long, ts_ms long, ord long, status string, reason string, watermark_ms long, lag_ms long")
    policies = spark.createDataFrame([(1, "video", True, True, None), (2, "spoken_pii", False, True, None), (3, "cross_modal", False, True, None)], "ord int, capability string, required boolean, enabled boolean, max_lag long")
    got = windows.process(media_rows, none, policies).first()
    assert (got["action"], got["video"], got["audio"], got["video_status"], got["audio_status"], got["cross_modal_status"]) == ("full_redact", "covered", "silence", "video_processor_failure", "unsafe_input", "failed")
    blocked = windows.process(media_rows, none, policies, fallback="block").first()
    assert (blocked["action"], blocked["video"], blocked["audio"]) == ("block", None, None)
