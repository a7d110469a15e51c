"""Shared plumbing of the training-data operators: table access, written cut points, and text as flat NumPy arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multiplier of the rolling polynomial hash (modulo 2**64), and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that one vectorised step takes at most; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of a batch of rows that Spark gives a worker, unless the session says otherwise (Spark's default: 64 MB, held by both sides).
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from wherever sf_dir points to."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its
    own; on a cluster it is an error, as a folder of one machine isn't shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that driver and executors share is needed")
        found = tempfile.mkdtemp(prefix="hushframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Rows go to the workers in batches of about BATCH_BYTES, whatever the texts' lengths; a bound that the session has stays. It
    holds for the session, as a result is often run after the operator returned it."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/hushframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut wrote, once nothing reads them any more, so that the shared disk doesn't fill up."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give the memory that is free back to the system: workers are kept between tasks, and idle ones would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, with release() at the end of each task."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


#: Keys that are broadcast as hot ones at most, and rows below which no key is hot.
HOT_KEYS, HOT_ROWS = 50_000, 2_000


def hot(counts: DataFrame, n: str = "n", least: int | None = None) -> tuple[DataFrame | None, int]:
    """The rows of counts (one for each key, n rows of it in the table that is meant) of hot keys, None if there are none, and the bound
    above which a key is one.

    The bound is `least` (HOT_ROWS), or so much more that HOT_KEYS keys at most can be above it: rows / HOT_KEYS.
    """
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    bound = max(HOT_ROWS if least is None else least, -(-(total or 0) // HOT_KEYS))
    return (counts.filter(F.col(n) > bound) if (most or 0) > bound else None), bound


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """left joined with right (a written table: one row for each key, n rows of left each) on key; left's rows of hot keys meet a
    broadcast of the hot keys' rows, of which there is a proven number at most, so that no key is one task's work."""
    warm, bound = hot(right, n)
    keys = [key] if isinstance(key, str) else key
    others = [c for c in right.columns if c not in keys]
    if warm is None:
        return left.join(right, keys)
    both = left.join(F.broadcast(warm.withColumn("__hot", F.lit(True))), keys, "left")
    rest = both.filter("__hot is null").drop("__hot", *others).join(right.filter(F.col(n) <= bound), keys)
    return both.filter("__hot").drop("__hot").select(rest.columns).union(rest)


def salted(rows: DataFrame, key: str, counts: DataFrame, by: Column, n: str = "n", least: int | None = None) -> DataFrame:
    """rows with columns salt and parts: 0 and 1, but for the rows of a hot key (by counts: key, n) a hash of `by` modulo as many parts
    as keep each part within the bound of hot keys. The parts' numbers are broadcast, HOT_KEYS at most."""
    warm, bound = hot(counts, n, least)
    if warm is None:
        return rows.withColumns({"salt": F.lit(0).cast("long"), "parts": F.lit(1).cast("long")})
    parts = warm.select(F.col(key).alias("__key"), F.ceil(F.col(n) / bound).alias("__parts"))
    both = rows.join(F.broadcast(parts), F.col(key) == F.col("__key"), "left")
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    return both.withColumns({"salt": F.pmod(F.xxhash64(by), parts), "parts": parts}).drop("__key", "__parts")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the offsets of its rows in them, without copying."""
    column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges (i, j) of at most limit bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept by the worker up to a few steps' length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + (1 << 18)), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums p with hash(i, j) = (p[j] - p[i]) * BASE**-i, of 64-bit values."""
    p = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(BASE, len(values)), out=p[1:])
    return p


class Tokens:
    """Words of a step of rows: every maximal run of bytes that the 256-entry map leaves above 0.

    text: mapped bytes with one separator slot (0) behind each row; start, end: of the words in it; first: the number of the
    first word of each row, and their total; slot: place of each row's separator slot.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, byte_map: np.ndarray):
        rows, begin = len(offsets) - 1, int(offsets[0])
        size = int(offsets[-1]) - begin
        self.slot = offsets[1:] - begin + np.arange(rows)
        text = np.zeros(size + rows, np.uint8)
        inside = np.ones(size + rows, bool)
        inside[self.slot] = False
        text[inside] = byte_map[data[begin : begin + size]]
        self.text = text
        word = np.zeros(size + rows + 1, np.int8)
        word[1:] = text != 0
        edge = np.diff(word)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.concatenate([[0], np.searchsorted(self.start, self.slot)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        value = BYTE_VALUE[self.text]
        p = rolling(value)
        return mix((p[self.end] - p[self.start]) * powers(BASE_INV, len(self.text))[self.start] + (self.end - self.start).astype(U64))


def byte_map(separators: bytes, lower: bool = True) -> np.ndarray:
    """A map for Tokens: separators become 0; A-Z become a-z if lower; byte 0 becomes 255, which UTF-8 doesn't use."""
    found = np.arange(256, dtype=np.uint8)
    found[0] = 255
    if lower:
        found[65:91] += 32
    found[list(separators)] = 0
    return found


#: The white space that ends a word: space and the bytes 9 to 13.
SPACE = b" \t\n\x0b\x0c\r"


def span_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[k]:first[k+1]], with 0 for empty spans."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class Memo:
    """A table from 64-bit keys to numbers, looked up by whole arrays. Bounded: a full table starts anew.

    Each key has PROBES places; one that finds no place isn't kept and is computed again next time.
    """

    PROBES = 8

    def __init__(self, bits: int, kind: type = np.float64):
        self.bits, self.filled = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, kind)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(BASE)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys (none of them 0), and the places in keys of those that aren't there."""
        keys = keys.astype(U64, copy=False)
        home, last = self._home(keys), (1 << self.bits) - 1
        at, out = self.keys[home], self.values[home]
        off = np.flatnonzero(at != keys)
        absent = [off[at[off] == 0]]
        off = off[at[off] != 0]
        for probe in range(1, self.PROBES):
            if not len(off):
                break
            place = (home[off] + probe) & last
            at = self.keys[place]
            hit = at == keys[off]
            out[off[hit]] = self.values[place[hit]]
            absent.append(off[at == 0])
            off = off[~hit & (at != 0)]
        return out, np.concatenate([*absent, off])

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keep distinct keys."""
        if self.filled + len(keys) > 0.6 * len(self.keys):
            self.keys[:] = 0
            self.filled = 0
        self.filled += len(keys)
        home, last = self._home(keys), (1 << self.bits) - 1
        for probe in range(self.PROBES):
            place = (home + probe) & last
            free = self.keys[place] == 0
            self.keys[place[free]] = keys[free]
            won = self.keys[place] == keys
            self.values[place[won]] = values[won]
            keys, values, home = keys[~won], values[~won], home[~won]
            if not len(keys):
                break


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class Counter64:
    """Counts of 64-bit keys of one task, added step by step. It holds `limit` distinct keys at most and as many that wait to be merged;
    more than that are given out, for a shuffle to add up."""

    def __init__(self, limit: int = 1 << 20):
        self.parts, self.waiting, self.limit = [], 0, limit

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Count keys; if that makes too many, all counts so far, which are then no longer held."""
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.waiting += len(keys)
        if self.waiting <= self.limit:
            return None
        found = self.total()
        if len(found[0]) > self.limit:
            return found
        self.parts, self.waiting = [found], 0
        return None

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """All counts that are held; it holds none from then on."""
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        found = merged(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))
        self.parts, self.waiting = [], 0
        return found


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal first `keys` columns (whole numbers), of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        at = [0, *np.flatnonzero(change), batch.num_rows]
        for i, j in zip(at[:-1], at[1:]):
            if change[i] and held:
                yield held
                held = []
            if j > i:
                held.append(batch.slice(i, j - i))
        last = tuple(c[-1] for c in columns)
    if held:
        yield held
