"""Operator 6, token counts: a broadcast table of frequent pre-token lengths, worker caches behind it, no pre-token shuffle.

The table's pre-tokens are the most frequent ones of all documents: each task counts its own in bounded memory, and only the tasks' lists
of the most frequent ones are put together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.pretokens import WordLengths, worker

#: Entries of the broadcast table (a few MB at most, whatever the input), and of a task's list.
FREQUENT, OWN = 1 << 16, 1 << 13
#: Characters of the longest pre-token that is counted or cached; longer ones are encoded each time.
LONGEST = 128


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", entries: int = FREQUENT, own_entries: int = OWN) -> dict[str, int]:
    """Lengths in tokens of the pre-tokens that are frequent in docs.

    It decides which pre-tokens skip the workers' caches, so it changes the speed and never a count.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = worker(WordLengths, path), Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.update(own.pretokens(value or "") or ())
                if len(counts) > 8 * entries:
                    counts = Counter(dict(counts.most_common(2 * entries)))
        kept = [x for x in counts.most_common(own_entries) if len(x[0]) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["pretoken", "n"])

    found = docs.select(text).mapInArrow(top, "pretoken string, n long")
    rows = found.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(entries).select("pretoken").collect()
    return worker(WordLengths, path).encode([r[0] for r in rows]) if rows else {}


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes (of UTF-8), n_tokens (by the vocabulary file at path) and over_limit (n_tokens > limit).

    All columns of docs stay but those three names, which are replaced. A null text counts as empty (0, 0, false); an empty
    table gives an empty result; repeated rows stay repeated; special-token strings inside a text count as the library's default
    has it (one token); texts of any length are counted whole.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path, text))
    schema = docs.limit(0).schema
    place = docs.columns.index(text)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent = worker(WordLengths, path), shared.value
        for batch in batches:
            texts = batch.column(place)
            n = [own.count(value, frequent) if value else 0 for value in texts.to_pylist()]
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, n_bytes, pa.array(n, pa.int64()), over], names=[*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    for name, kind in (("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(counted, schema)
