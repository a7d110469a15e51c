"""Files of audio, images, reports and manifests, read and written by Spark."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")
INPUT = "fixture_version string, confidence_threshold double, ground_truth array<struct<image_id:string,class_id:string,box:array<double>>>, predictions array<struct<image_id:string,class_id:string,box:array<double>,score:double>>, performance struct<latency_ms:array<double>,cold_start_ms:double,frames:bigint,seconds:double>"


def read_wav(spark: SparkSession, path: str, *, most_ms: int = 120_000, start_ms: int = 0) -> DataFrame:
    """(path, start_ms, rate, channels, samples, status) of 16-bit WAV files: status ok, not_pcm16 or duration; samples are null unless ok.
    start_ms is where the file's first sample lies on the source timeline."""

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"]):
                rate = channels = samples = None
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate, channels, n = w.getframerate(), w.getnchannels(), w.getnframes()
                        status = "not_pcm16" if w.getsampwidth() != 2 else "ok" if 0 < n * 1000 <= most_ms * rate else "duration"
                        if status == "ok":
                            samples = (np.frombuffer(w.readframes(n), "<i2") / 32768.0).tolist()
                except (wave.Error, EOFError):
                    status = "not_pcm16"
                out.append((name, rate, channels, samples, status))
            yield pd.DataFrame(out, columns=["path", "rate", "channels", "samples", "status"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decoded, "path string, rate int, channels int, samples array<double>, status string").select("path", F.lit(start_ms).cast("long").alias("start_ms"), "rate", "channels", "samples", "status")


def wav_bytes(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A 16-bit WAV file of samples between -1 and 1."""
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(np.asarray(samples) * 32768), -32768, 32767).astype("<i2").tobytes())
    return held.getvalue()


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of image files, by path; a folder without any is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES)).select("path", "length").orderBy("path")
    if found.isEmpty():
        raise ValueError(f"no images in {path}")
    return found


def write_wav(spark: SparkSession, samples: np.ndarray, rate: int, path: str, *, mute: tuple[tuple[int, int], ...] = (), channels: int = 1) -> None:
    """A 16-bit WAV file, with what lies in the spans (start_ms, end_ms) of mute silenced: floor of starts, ceiling of ends."""
    own = np.array(samples, float).reshape(-1, channels)
    for start, end in mute:
        own[start * rate // 1000 : -(-end * rate // 1000)] = 0
    _write(spark, path, wav_bytes(own.reshape(-1), rate, channels))


def _write(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, through the file system that Spark reads the path by."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Truth, predictions and performance of evaluation inputs."""
    raw = spark.read.schema(INPUT).json(path, multiLine=True)
    wrong = evaluation_problem(raw).filter("problem is not null").first()  # one row for each file that can't be used
    if wrong is not None:
        raise ValueError(f"evaluation input: {wrong['problem']}")
    box = lambda k: F.get(F.col("r.box"), F.lit(k))
    boxes = [box(k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    rows = lambda c: raw.select(F.posexplode(c).alias("ordinal", "r")).select(F.col("r.image_id").alias("image"), F.col("r.class_id").alias("class"), "ordinal", *boxes, *([F.col("r.score").alias("score")] if c == "predictions" else []))
    return rows("ground_truth"), rows("predictions"), raw.select("performance.*")


def evaluation_problem(inputs: DataFrame) -> DataFrame:
    """inputs (of schema INPUT) with problem: the first part of an evaluation input that isn't as it must be, or null."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    def bad_box(r: Column) -> Column:
        corners = [F.get(r["box"], F.lit(k)) for k in range(4)]
        whole = (F.size(r["box"]) == 4) & number(corners[0]) & number(corners[1]) & number(corners[2]) & number(corners[3])
        return blank(r["image_id"]) | blank(r["class_id"]) | ~F.coalesce(whole & (corners[0] >= 0) & (corners[1] >= 0) & (corners[2] > corners[0]) & (corners[3] > corners[1]), F.lit(False))

    score = lambda r: ~F.coalesce(number(r["score"]) & (r["score"] >= 0) & (r["score"] <= 1), F.lit(False))
    asked = F.coalesce("confidence_threshold", F.lit(0.25))
    problem = (
        F.when(blank(F.col("fixture_version")), "fixture_version").when(F.col("ground_truth").isNull() | F.exists("ground_truth", bad_box), "ground_truth").when(F.col("predictions").isNull() | F.exists("predictions", lambda r: bad_box(r) | score(r)), "predictions")
        .when(~number(asked) | (asked < 0) | (asked > 1), "confidence_threshold").when(F.exists(F.coalesce("performance.latency_ms", F.array().cast("array<double>")), lambda x: ~F.coalesce(number(x), F.lit(False))), "latency_ms")
        .when(F.col("performance.seconds") <= 0, "seconds")
    )
    return inputs.withColumn("problem", problem)


def report(row: Row) -> tuple[str, str]:
    """A one-row report as JSON (sorted keys, indented) and as Markdown."""
    held = row.asDict(recursive=True)
    lines = [f"| {k} | {held[k]} |" for k in sorted(held)]
    return json.dumps(held, indent=2, sort_keys=True) + "\n", "\n".join(["| metric | value |", "| --- | --- |", *lines]) + "\n"


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as two files in path: report.json (sorted keys, indented by 2) and report.md."""
    as_json, as_markdown = report(df.limit(1).collect()[0])
    _write(df.sparkSession, f"{path}/report.json", as_json.encode())
    _write(df.sparkSession, f"{path}/report.md", as_markdown.encode())
