"""Operator 10, best-fit packing planned over a histogram of lengths.

1. Each document becomes pieces of at most `capacity` tokens (map side, ids by the library through worker caches).
2. The histogram of piece lengths, at most `capacity` rows whatever the input, goes to the driver.
3. Best fit decreasing runs over counts: all bins in the same state are one class, so the plan's size follows the number of
   distinct lengths and not the number of documents.
4. Each piece takes the planned slot whose number is its rank within its length. Ranks come from two levels (a count for each
   length and salt, then a row number within length and salt), so a length that many documents share isn't one task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import cut, releasing
from hushframe.llm.pretokens import ByteIds, for_task

#: Groups that the rows of one length are dealt to before they are numbered.
SALTS = 32


def best_fit(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """A plan: rows (length, first rank, count, first sequence, pieces a sequence, first offset), by length and first rank.

    Lengths go from long to short; each piece goes where the least room is left that holds it, else to a new sequence. Bins with
    the same room left that were made together form one range of sequences, so one step places many pieces.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, sequences)
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_bins:
                open_bins[room] = []
                at = np.searchsorted(rooms, room)
                rooms.insert(int(at), room)
            open_bins[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = int(np.searchsorted(rooms, length))
            if at == len(rooms):
                per = capacity // length
                full = left // per
                if full:
                    plan.append((length, rank, full * per, opened, per, 0))
                    leave(capacity - per * length, opened, full)
                    opened, rank, left = opened + full, rank + full * per, left - full * per
                if left:
                    plan.append((length, rank, left, opened, left, 0))
                    leave(capacity - left * length, opened, 1)
                    opened, left = opened + 1, 0
                break
            room = rooms[at]
            first, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            per = room // length
            full = min(n, left // per)
            offset = capacity - room
            if full:
                plan.append((length, rank, full * per, first, per, offset))
                leave(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            rest = n - full
            if left and rest:  # fewer pieces than this bin would take
                plan.append((length, rank, left, first + full, left, offset))
                leave(room - left * length, first + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            if rest:
                leave(room, first + full, rest)
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut so that only the first piece may be short."""

    @releasing
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        with for_task(ByteIds, path) as own:
            for batch in batches:
                rows: list[tuple[int, int, int, int, int]] = []
                for row, value in enumerate(batch.column(1).to_pylist()):
                    ids = (own.ids(value) if value else b"") + end
                    total = len(ids) // 4
                    start, stop, piece = 0, (total - 1) % capacity + 1, 0
                    while start < total:
                        rows.append((row, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
                found = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1].astype(np.int32)), *(pa.array(found[:, k]) for k in range(2, 5))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and their place in it: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document of more than capacity tokens (end_id included) is cut into pieces of capacity tokens, the first of which may be
    shorter. Sequences are filled from offset 0 without gaps. A null or empty text is one piece of one token. A repeated row (and
    a null doc_id) gets its own pieces. Equal lengths are interchangeable: ties are broken by hash of the id. An empty table gives
    an empty result; other columns of docs don't matter.
    """
    pieces = cut(cut_pieces(docs, path, capacity, end_id, doc_id, text), "pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    sums = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    shared = docs.sparkSession.sparkContext.broadcast(best_fit(histogram, capacity))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    numbered = pieces.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    # at most capacity x SALTS rows, whatever the input: 2048 x 32 x 40 bytes
    ranked = numbered.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))

    @releasing
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        first = np.searchsorted(plan[:, 0], np.arange(capacity + 2)) if len(plan) else np.zeros(capacity + 2, np.int64)
        width = int(plan[:, 1].max()) + 1 if len(plan) else 1
        key = plan[:, 0] * width + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(key, length * width + np.minimum(rank, width - 1), side="right") - 1
            assert (at >= first[length]).all()
            found = plan[at]
            inside = rank - found[:, 1]
            sequence, offset = found[:, 3] + inside // found[:, 4], found[:, 5] + inside % found[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["doc_id"]
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
