"""Operator 1, quality classifier: Zstandard dictionaries of good and of bad text, and a calibrated size difference.

A text is cut into pieces of PIECE bytes, all of which are compressed with either dictionary. (bad size - good size) / (bad size +
good size) over the whole text is above 0 if good text predicts it better. Logistic regression on labelled texts outside the
dictionaries, weighted to the true share of the labels, turns it into a probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import cut, flat, releasing

PIECE = 1024
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Labelled texts of each label for the dictionaries, and as many again for the calibration.
SAMPLE = 1500
#: Pieces of each label's sampled texts that a dictionary is trained on: a hundred times its size.
PIECES = 100 * DICTIONARY_BYTES // PIECE


def pieces(data: memoryview) -> list[memoryview]:
    return [data[at : at + PIECE] for at in range(0, len(data), PIECE)]


def dictionary(found: list[bytes]) -> bytes:
    """A dictionary of pieces; the raw pieces where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the least penalised logistic loss; a slope below 0 isn't allowed, as it would reverse the meaning."""
    w, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-3 * w
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), gradient)
        w = w - np.clip(step, -20, 20)
        if abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


class Model:
    """Two dictionaries and the calibration; it can be sent to workers (about 130 KB)."""

    def __init__(self, good: bytes, bad: bytes, slope: float, intercept: float):
        self.good, self.bad, self.slope, self.intercept = good, bad, slope, intercept

    def compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        kept = zstandard.ZstdCompressionDict(content) if content else None
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=False, write_content_size=False, write_dict_id=False)

    def differences(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Normalised size differences of the rows' whole texts; 0 for an empty one."""
        good, bad, out = self.compressor(self.good), self.compressor(self.bad), np.zeros(len(offsets) - 1)
        view = memoryview(np.ascontiguousarray(data))
        for row in range(len(out)):
            own = pieces(view[offsets[row] : offsets[row + 1]])
            g, b = sum(len(good.compress(p)) for p in own), sum(len(bad.compress(p)) for p in own)
            out[row] = (b - g) / (b + g) if own else 0.0
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(data, offsets) + self.intercept, -30, 30)))


def labelled_ids(docs: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(id, y) of the ids that documents and labels share; an id with both labels, or a null one, has no row."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most")
    there = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"))
    return known.join(there, "id", "left_semi").select("id", F.col("y").cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, most_pieces: int = PIECES) -> Model:
    """Learn from a bounded sample: of each label (1 good, 0 bad) the 2 x sample ids with the smallest hash.

    Ids are chosen without their texts; only the chosen ones' texts are read. Every second id of a label is for the dictionaries: of
    the pieces of those texts, all of them, the `most_pieces` with the smallest hash of id and place train one; nothing else limits
    a text's length. The others are for the calibration, whose weights are the labels' true shares. Null ids and labels, and
    ids with both labels, are left out. Of an id's several texts the smallest counts; a null text is an empty one. So the model
    depends on the rows alone, not on their order or partitions. Without two texts of either label it gives every text the
    share of label 1 (add-one).
    """
    ids = cut(labelled_ids(docs, labels, doc_id, label), "labelled-ids")
    total = {r[0]: r[1] for r in ids.groupBy("y").agg(F.count("*")).collect()}  # two rows
    chosen = [r for y in (0, 1) for r in ids.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * sample).collect()]  # at most 4 x sample ids
    n = {y: sum(r["y"] == y for r in chosen) for y in (0, 1)}
    if min(n.values()) < 2:
        return Model(b"", b"", 0.0, float(np.log((total.get(1, 0) + 1) / (total.get(0, 0) + 1))))
    turn = {0: 0, 1: 0}
    dealt = []
    for r in chosen:
        dealt.append((r["id"], r["y"], turn[r["y"]] % 2 == 1))
        turn[r["y"]] += 1
    spark = docs.sparkSession
    picked = spark.createDataFrame(dealt, f"id {dict(ids.dtypes)['id']}, y int, held boolean")
    # one text for each id, put together map side first: an id that many rows share is no hot key
    taken = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    taken = cut(taken.groupBy("id", "y", "held").agg(F.min("text").alias("text")), "labelled-texts")
    places = F.sequence(F.lit(0), F.ceil(F.octet_length("text") / PIECE).cast("int") - 1)
    cut_out = lambda k: F.struct(F.xxhash64("id", k).alias("h"), F.substring(F.encode("text", "utf-8"), k * PIECE + 1, F.lit(PIECE)).alias("piece"))
    each = taken.filter("not held and text <> ''").select("y", "id", F.explode(F.transform(places, cut_out)).alias("p")).select("y", "id", "p.h", "p.piece")
    learnt = {}
    for y in (0, 1):
        own = each.filter(F.col("y") == y)
        last = own.select("h").orderBy("h").limit(most_pieces).agg(F.max("h")).first()[0]
        found = own.filter(F.col("h") <= last).orderBy("h", "id").collect() if last is not None else []  # most_pieces of PIECE bytes
        learnt[y] = dictionary([bytes(r["piece"]) for r in found])
    model = Model(learnt[1], learnt[0], 1.0, 0.0)
    shared = spark.sparkContext.broadcast(model)

    @releasing
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.differences(*flat(batch.column(2))))], names=["id", "y", "x"])

    held = taken.filter("held").select("id", "y", "text").mapInArrow(compared, taken.select("id", "y").withColumn("x", F.lit(0.0)).schema).orderBy("y", "id").collect()  # at most 2 x sample rows
    shared.destroy()
    y = np.array([r["y"] for r in held], float)
    weight = np.array([total[k] / (y == k).sum() for k in (0, 1)])
    weight = weight[y.astype(int)] * len(y) / sum(total.values())
    model.slope, model.intercept = logistic(np.array([r["x"] for r in held]), y, weight)
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5, else 0), of whole texts only.

    Columns of those two names are replaced, all others stay. A null text is an empty one, whose score is the calibration's
    intercept. Equal texts get equal scores. An empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    @releasing
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores(*flat(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(scored, docs.limit(0).schema.add("score", "double").add("predicted", "integer"))
