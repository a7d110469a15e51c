"""Operator 8, benchmark decontamination: spaced seeds, joined by hash, and substitution-tolerant verification around each hit.

A document leaks an item if WINDOW of the item's words in a row (all of them, in a shorter item) stand in it at the same distances,
up to allowed() of them replaced. Cut the window into blocks of three words: however the replaced words fall, two blocks are whole. So
the seeds are two blocks of three words with 0, 3, 6 or 9 ignored positions between them, and every leak has a hit. An item of fewer
than six words has one seed, of all its words.

Items' seeds go to a table, each with the words around it. Documents give out those of their seeds that a bitmap of the items' seeds has
(16 MB at most, whatever the benchmark's size), with the words around them. Both are joined by the seeds' hashes, and the joined
rows hold all that a verification needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import U64, Tokens, byte_map, cut, discard, flat, mix, releasing, steps

WINDOW = 15
#: Word positions that each mask looks at; the others are ignored.
MASKS = tuple((0, 1, 2, gap + 3, gap + 4, gap + 5) for gap in (0, 3, 6, 9))
#: Words before and from a seed's place on that a window with the seed inside can have.
BEFORE, AHEAD = WINDOW - 6, WINDOW
SPAN = BEFORE + AHEAD
#: Most bits of the bitmap, as a power of two, and bits for each seed of a smaller benchmark.
BITS, BITS_A_SEED = 27, 2048
_WORDS = byte_map(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Words that are no words: outside an item, outside a document.
_NO_ITEM, _NO_DOCUMENT = U64(0), U64(1)


def allowed(words: np.ndarray) -> np.ndarray:
    """Replaced words that an item of so many words may have in its window: none under 9 words, 1 under 12, 2 under 15, else 3."""
    return np.where(words >= WINDOW, 3, np.where(words >= 12, 2, np.where(words >= 9, 1, 0)))


def seeds(words: np.ndarray, left: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes at all places that have the whole mask before their row's end; left: words from each place to that end."""
    place = np.flatnonzero(left > mask[-1])
    found = np.full(len(place), (mask[-1] << 8) + len(mask), U64)
    for k in mask:
        found = mix(found + words[place + k])
    return found, place


def around(words: np.ndarray, first: np.ndarray, row: np.ndarray, place: np.ndarray, outside: np.uint64) -> np.ndarray:
    """The SPAN words around each place of a row, as rows; `outside` where the row has none."""
    at = place[:, None] + np.arange(-BEFORE, AHEAD)[None, :]
    inside = (at >= first[row][:, None]) & (at < first[row + 1][:, None])
    return np.where(inside, words[np.where(inside, at, 0)], outside)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of SPAN words as binary values."""
    size = 8 * SPAN
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def item_seeds(items: DataFrame, kind: str) -> DataFrame:
    """(seed, item_id, size, reach, item_words) of items (item_id, lower): all seeds; reach is the last position of the mask."""

    @releasing
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in steps(offsets):
                tokens = Tokens(data, offsets[i : j + 1], _WORDS)
                words, first = tokens.hashes(), tokens.first
                size = np.diff(first)
                row = np.repeat(np.arange(j - i), size)
                left = first[1:][row] - np.arange(len(words))
                parts = [(*seeds(words, np.where(size[row] >= 6, left, 0), mask), mask[-1]) for mask in MASKS]
                # a short item's seed is at its first word
                parts += [(*seeds(words, np.where((size[row] == n) & (left == n), left, 0), tuple(range(n))), n - 1) for n in range(1, 6)]
                seed, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                if not len(seed):
                    continue
                reach, of = np.concatenate([np.full(len(p[0]), p[2], np.int32) for p in parts]), row[place]
                ids = batch.column(0).take(pa.array(i + of))
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), ids, pa.array(size[of].astype(np.int32)), pa.array(reach), packed(around(words, first, of, place, _NO_ITEM))], names=["seed", "item_id", "size", "reach", "item_words"])

    return items.select("item_id", "lower").mapInArrow(found, f"seed long, item_id {kind}, size int, reach int, item_words binary")


def bitmap(seeds_: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap): which of 2**bits slots, by the seeds' highest bits, have a seed; 2**BITS bits at most."""
    n = seeds_.count()
    bits = min(BITS, max(20, (BITS_A_SEED * max(1, n) - 1).bit_length()))
    slot = F.shiftrightunsigned("seed", 64 - bits)
    parts = seeds_.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32_767))).alias("bits")).collect()  # 4 KB each
    found = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        found[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits, found


def hits(texts: DataFrame, seeds_: DataFrame) -> DataFrame:
    """(h1, h2, seed, place, words) of texts (h1, h2, lower): seeds that the items' bitmap has; equal texts of a batch are looked at once."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(seeds_))
    masks = (*MASKS, *(tuple(range(n)) for n in sorted(r["size"] for r in seeds_.filter("size < 6").select("size").distinct().collect())))  # five sizes

    @releasing
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = shared.value
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
            once = np.sort(np.unique(keys, axis=0, return_index=True)[1])
            own = batch if len(once) == len(keys) else batch.take(pa.array(once))
            data, offsets = flat(own.column(2))
            for i, j in steps(offsets):
                tokens = Tokens(data, offsets[i : j + 1], _WORDS)
                words, first = tokens.hashes(), tokens.first
                row = np.repeat(np.arange(j - i), np.diff(first))
                left = first[1:][row] - np.arange(len(words))
                for mask in masks:
                    seed, place = seeds(words, left, mask)
                    slot = seed >> U64(64 - bits)
                    some = np.flatnonzero((held[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1)
                    if len(some):
                        of = row[place[some]]
                        at = pa.array(i + of)
                        yield pa.RecordBatch.from_arrays([own.column(0).take(at), own.column(1).take(at), pa.array(seed[some].view(np.int64)), pa.array(place[some] - first[of]), packed(around(words, first, of, place[some], _NO_DOCUMENT))], names=["h1", "h2", "seed", "place", "words"])

    return texts.mapInArrow(found, "h1 long, h2 long, seed long, place long, words binary")


def verified(joined: DataFrame, kind: str) -> DataFrame:
    """(h1, h2, item_id, n_equal, n_window, word) of joined hits and item seeds (h1, h2, place, words, item_id, size, reach, item_words):
    the best window around each that is a leak; the first one of equally good ones."""

    @releasing
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 20_000) for b in batches for at in range(0, b.num_rows, 20_000)):
            place, size, reach = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 5, 6))
            both = [np.frombuffer(b"".join(batch.column(k).to_pylist()), U64).reshape(-1, SPAN) for k in (3, 7)]
            equal, there = both[0] == both[1], both[1] != _NO_ITEM
            window = np.minimum(WINDOW, size)
            sums = [np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(x, axis=1)], axis=1) for x in (equal, there)]
            rows = np.arange(len(place))
            best, where = np.full(len(place), -1), np.zeros(len(place), np.int64)
            for begin in range(SPAN):  # windows that begin there and have the whole seed inside
                stop = np.minimum(begin + window, SPAN)
                fits = (begin <= BEFORE) & (begin + window > BEFORE + reach) & (sums[1][rows, stop] - sums[1][:, begin] == window)
                n = np.where(fits, sums[0][rows, stop] - sums[0][:, begin], -1)
                better = n > best
                best, where = np.where(better, n, best), np.where(better, begin, where)
            good = np.flatnonzero((best >= 0) & (best >= window - allowed(size)))
            at = pa.array(good)
            word = place + where - BEFORE
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 1, 4)), pa.array(best[good].astype(np.int32)), pa.array(window[good].astype(np.int32)), pa.array(word[good])], names=["h1", "h2", "item_id", "n_equal", "n_window", "word"])

    return joined.select("h1", "h2", "place", "words", "item_id", "size", "reach", "item_words").mapInArrow(checked, f"h1 long, h2 long, item_id {kind}, n_equal int, n_window int, word long")


def text_hash(text: Column) -> tuple[Column, Column]:
    """What texts are told apart by here, 128 bits."""
    return F.xxhash64(text), F.xxhash64(F.lit(8), text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with leaks, an array of (item_id, n_equal, n_window, word): the items that the whole text leaks, by id, each once.

    n_equal of n_window words of an item in a row are equal to the document's from its word number `word` on; of several such places
    the best one, then the first, counts. Words are runs of letters, digits and non-ASCII characters, lower-cased. Items of fewer
    than 9 words leak only word for word; items without words, and with null id or text, are left out; an id that repeats stands for
    all its texts, and may be of any type. A null text leaks nothing. All columns of docs stay but one named leaks, which is replaced;
    repeated rows stay, and equal texts are verified once.
    """
    docs, kind = docs.drop("leaks"), dict(benchmark.dtypes)[item_id]
    declared = f"array<struct<item_id:{kind},n_equal:int,n_window:int,word:bigint>>"
    items = benchmark.select(F.col(item_id).alias("item_id"), F.lower(item_text).alias("lower")).filter("item_id is not null and lower is not null").distinct()
    own = cut(item_seeds(items, kind), "item-seeds")
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    h1, h2 = text_hash(lower)
    found = cut(hits(docs.select(h1.alias("h1"), h2.alias("h2"), lower.alias("lower")), own), "seed-hits")
    good = verified(found.join(own, "seed"), kind)
    best = good.groupBy("h1", "h2", "item_id").agg(F.max(F.struct("n_equal", (-F.col("word")).alias("minus"), "n_window")).alias("b"))
    leak = F.struct("item_id", F.col("b.n_equal").alias("n_equal"), F.col("b.n_window").alias("n_window"), (-F.col("b.minus")).alias("word"))
    leaks = cut(best.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(leak)).alias("leaks")), "leaks")
    discard(own, found)
    # names of our own that no column of docs has
    one, two = (f"__{uuid.uuid4().hex}" for _ in range(2))
    keyed = docs.withColumns({one: h1, two: h2}).join(leaks.withColumnsRenamed({"h1": one, "h2": two}), [one, two], "left")
    return keyed.select(*docs.columns, F.coalesce("leaks", F.array().cast(declared)).alias("leaks"))
