import time

from pyspark.sql import functions as F

from hushframe.operators import audio


def test_spans_of_a_long_transcript_cover_their_words(spark):
    begun = time.monotonic()
    word = F.when(F.col("pos") % 50 == 0, "02079460011").otherwise("hm")
    words = spark.range(20_000).select(F.lit(1).alias("id"), F.col("id").alias("pos")).withColumn("word", word).select("id", "pos", "word", (F.col("pos") * 300).alias("start_ms"), (F.col("pos") * 300 + 280).alias("end_ms"), F.lit(0.5).alias("confidence"))
    got = sorted(tuple(r) for r in audio.spoken_pii(words, "id").collect())
    assert got == [(1, p * 300, p * 300 + 280, 0.5, "phone_number") for p in range(0, 20_000, 50)]
    assert time.monotonic() - begun < 60


def test_words_that_are_punctuation_have_no_place(spark):
    rows = [(1, p, w, p * 300, p * 300 + 280, 0.5 + p / 10) for p, w in enumerate(["é😀", "?!", "one two", "kite", "at", ",", "wind.test", "and"])]
    words = spark.createDataFrame(rows, "id long, pos int, word string, start_ms long, end_ms long, confidence double")
    assert [tuple(r) for r in audio.spoken_pii(words, "id").collect()] == [(1, 900, 2080, 0.8, "email")]


def test_words_on_the_timeline(spark):
    windows = spark.createDataFrame([(1, 0, 1000, 1500, "hello there", 0.8), (1, 1, 2000, 2200, "all of it", 0.7), (1, 2, 3000, 3100, " ", 0.7)], "id long, window long, start_ms long, end_ms long, text string, confidence double")
    words = spark.createDataFrame([(1, 0, 0, "hello", -50, 200, 0.9), (1, 0, 1, "there", 200, 900, 0.6), (1, 0, 2, "late", 600, 700, 0.5), (1, 1, 0, "x", 50, 50, 0.5)], "id long, window long, pos long, word string, from_ms long, to_ms long, confidence double")
    got = [tuple(r) for r in audio.timeline_words(windows, words, "id").orderBy("window", "pos").collect()]
    assert got == [(1, 0, 0, "hello", 1000, 1200, 0.9), (1, 0, 1, "there", 1200, 1500, 0.6), (1, 1, 0, "all of it", 2000, 2200, 0.7)]


def test_segments_without_words_are_unsafe(spark):
    segments = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 1000, 2000)], "id long, segment long, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 900, 1000), (1, 10, 20), (2, 1500, 1600)], "id long, from_ms long, to_ms long")
    got = {r["segment"]: (r["n_words"], r["status"]) for r in audio.classified_segments(segments, words, "id").collect()}
    assert got == {0: (2, "ok"), 1: (0, "unsafe_unclassified")}
