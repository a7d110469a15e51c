"""Streaming forms of batch operators: the same column logic on readStream inputs, with state where rows must wait."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushframe.operators.cross_modal import Synchroniser


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that driver and executors share is needed")
        found = tempfile.mkdtemp(prefix="hushframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def drained(stream: DataFrame, name: str) -> DataFrame:
    """A stream run until it has taken all there is: its complete result, as a table. State and result are in the shared folder, so
    a lost executor costs no more than its tasks."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/hushframe-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/result")


def windowed_counts(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value), tumbling, with late rows up to `late`."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = own.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def distinct_intervals(intervals: DataFrame, *, late: str = "2 hours") -> DataFrame:
    """Intervals (ts and their columns) without exact repeats within the watermark."""
    own = intervals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.dropDuplicatesWithinWatermark(["stream", "start_ms", "end_ms", "detector", "reason"])


def synchronise(events: DataFrame, *, frame_ms: int = 33, pre_ms: int = 50, post_ms: int = 50, most: int = 30, most_ms: int = 1000) -> DataFrame:
    """The synchroniser over a stream of events (as in cross_modal.synchronise), each stream's rows in order of ord in a batch.

    Late audio is the synchroniser's own business: nothing is dropped by an engine watermark. Pending frames stay in state.
    """
    state_schema = "pending string, intervals string, watermark long, last_frame long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        own = Synchroniser(frame_ms, pre_ms, post_ms, most, most_ms)
        if state.exists:
            pending, intervals, own.watermark, own.last_frame = state.get
            own.pending, own.intervals = [tuple(x) for x in json.loads(pending)], {tuple(x) for x in json.loads(intervals)}
        rows = pd.concat(list(frames)).sort_values("ord")
        out = []
        for row in rows.itertuples(index=False):
            if row.kind == "frame":
                out += own.frame(int(row.seq), int(row.ts_ms))
            else:
                out += own.audio(int(row.watermark_ms), [(int(row.start_ms), int(row.end_ms), float(row.confidence))] if pd.notna(row.start_ms) else [])
        state.update((json.dumps(own.pending), json.dumps(sorted(own.intervals)), own.watermark, own.last_frame))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["stream", "seq", "status", "reason", "delay_ms"])

    return events.groupBy("stream").applyInPandasWithState(step, "stream long, seq long, status string, reason string, delay_ms long", state_schema, "append", GroupStateTimeout.NoTimeout)
