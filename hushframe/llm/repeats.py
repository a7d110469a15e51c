"""Operator 9, exact repeats: every byte covered by a long string that also starts anywhere else, by run-length indexes of blocks.

No single index of the whole corpus is built; blocks are made so that all places of a repeated string meet in one block:
1. Of each window of LENGTH bytes the K-byte string with the smallest hash is its anchor (the last of equal ones), so equal windows
   have equal anchors at equal places. Anchors that occur once can't lie in a repeated window; that leaves a small part of the text.
2. The windows of one anchor at one place are one segment of text. Segments are put together by anchor; equal ones travel once with a
   list of their places, and each window of the corpus lies in exactly one segment.
3. A block of anchors' segments is cut into 8-byte symbols on a grid through the anchor, and gets a run-length Burrows-Wheeler index.
   Matching statistics streamed from its run ends tell which runs of whole symbols occur again; for these the bytes at either end of
   each window are compared exactly.
   A hot anchor's segments are dealt to several blocks. Of such blocks a digest of each distinct window that the index has left
   is counted over all blocks of the anchor, so what repeats across blocks is found too, and no anchor is one task's work.
4. The windows found are joined to the documents as spans and removed.
Of two lengths the shorter one's spans are found first: longer strings that repeat lie within them, so only those spans are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import BASE_INV, BYTE_VALUE, STEP_BYTES, U64, cut, discard, flat, join_hot, mix, powers, releasing, rolling, salted, steps
from hushframe.llm.runindex import RunIndex

LENGTH = 400
#: Bytes of a repeated passage: about 40 words, so that passages of over 50 words are found wherever their words are short.
PASSAGE_BYTES = 200
#: Bytes of segments of one anchor that one index takes; those of anchors with fewer are gathered up to GATHER_BYTES.
BLOCK_BYTES, GATHER_BYTES = 4 << 20, 1 << 20
#: Rows of a batch that a worker gives out.
OUT_ROWS = 1 << 16
#: Segments of an anchor from which on it is dealt to several blocks (or more, see common.hot).
BLOCK_SEGMENTS = 8192
_BYTE_VALUE_2 = mix(BYTE_VALUE)
_PLACES = 1 << 20
NAMES = ["digest", "other", "id", "th", "begin", "end"]


def anchor_bytes(length: int) -> int:
    """K: long enough that random text rarely shares an anchor, short enough that a window has many."""
    return max(8, length // 6)


def segments(gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor place) of each segment of one text.

    gram: hashes of its K-byte strings; width: how many of them a window has.
    """
    out = []
    windows = len(gram) - width + 1
    for at in range(0, windows, _PLACES // 2):
        own = gram[at : min(at + _PLACES // 2, windows) + width - 1]
        key = (own & ~U64(_PLACES - 1)) | (U64(_PLACES - 1) - np.arange(len(own), dtype=U64))
        pad = np.concatenate([key, np.full(-len(key) % width, 2**64 - 1, U64)]).reshape(-1, width)
        left, right = np.minimum.accumulate(pad, axis=1).ravel(), np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(own) - width + 1
        least = np.minimum(right[:n], left[width - 1 : width - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (U64(_PLACES - 1) - (least[first] & U64(_PLACES - 1))).astype(np.int64)
        out.append((first + at, np.diff(np.concatenate([first, [n]])), place + at))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, id, th, lo, n, off) of all segments: n windows from byte lo on, and the anchor's place behind lo.

    docs: id, th, text, and runs, an array of (begin, end) of the parts of the text that are looked at, or null for all of it.
    """
    k = anchor_bytes(length)

    @releasing
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            lists = batch.column(3)
            for i, j in steps(offsets):
                own = data[offsets[i] : offsets[j]]
                if len(own) < length:
                    continue
                p = rolling(BYTE_VALUE[own])
                gram = mix((p[k:] - p[:-k]) * powers(BASE_INV, len(own))[: len(own) - k + 1])
                rows, parts = [], []
                for row in range(i, j):
                    at = int(offsets[row] - offsets[i])
                    runs = [(x["begin"], x["end"]) for x in lists[row].as_py()] if lists[row].is_valid else [(0, int(offsets[row + 1] - offsets[row]))]
                    for begin, end in runs:
                        if end - begin < length:
                            continue
                        first, n, place = segments(gram[at + begin : at + end - k + 1], length - k + 1)
                        parts.append((gram[at + begin + place], first + begin, n, place + begin))
                        rows.append(np.full(len(first), row))
                if rows:
                    anchor, lo, n, place = (np.concatenate(x) for x in zip(*parts))
                    row = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(lo), pa.array(n), pa.array(place - lo)], names=["anchor", "id", "th", "lo", "n", "off"])

    return docs.select("id", "th", "text", "runs").mapInArrow(found, "anchor long, id long, th long, lo long, n long, off long")


def extract(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, seg, off, text, id, th, lo): distinct segments of each batch, with the places of each as lists.

    docs: id, th, text and list, an array of (lo, n, off, anchor).
    """

    @releasing
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            view = memoryview(np.ascontiguousarray(data))
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            first = lists.offsets.to_numpy()
            lo, n, off, anchor = (lists.values.field(k).to_numpy() for k in range(4))
            held: dict[tuple[int, int, int], tuple[bytes, list[int], list[int]]] = {}
            weight = 0
            for row in range(batch.num_rows):
                for at in range(first[row], first[row + 1]):
                    begin = int(offsets[row] + lo[at])
                    text = view[begin : begin + int(n[at]) + length - 1]
                    key = (int(anchor[at]), xxhash.xxh3_64_intdigest(text), int(off[at]))
                    if key not in held:
                        held[key] = (bytes(text), [], [])
                        weight += len(text)
                    held[key][1].append(row)
                    held[key][2].append(int(lo[at]))
                if weight > 8 << 20 or row == batch.num_rows - 1:
                    if held:
                        yield packed(held, ids, ths)
                    held, weight = {}, 0

    def packed(held: dict, ids: np.ndarray, ths: np.ndarray) -> pa.RecordBatch:
        keys = np.array([(a, np.uint64(s).astype(np.int64), o) for a, s, o in held], np.int64)
        rows = np.concatenate([v[1] for v in held.values()])
        ends = pa.array(np.cumsum([0, *(len(v[1]) for v in held.values())]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids[rows], ths[rows], np.concatenate([v[2] for v in held.values()]))]
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(keys[:, 2]), pa.array([v[0] for v in held.values()], pa.binary()), *lists], names=["anchor", "seg", "off", "text", "id", "th", "lo"])

    return docs.select("id", "th", "text", "list").mapInArrow(extracted, "anchor long, seg long, off long, text binary, id array<long>, th array<long>, lo array<long>")


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    out = raw[:-7].astype(U64)
    for k in range(1, 8):
        out <<= U64(8)
        out |= raw[k : len(out) + k]
    return out


def window_digests(raw: np.ndarray, at: np.ndarray, length: int, values: np.ndarray) -> np.ndarray:
    """Hashes of the strings of `length` bytes at the places `at`, which ascend; of a step of the text at a time."""
    out, k = np.empty(len(at), U64), 0
    while k < len(at):
        j = int(np.searchsorted(at, at[k] + STEP_BYTES))
        p, own = rolling(values[raw[at[k] : at[j - 1] + length]]), at[k:j] - at[k]
        out[k:j] = mix((p[own + length] - p[own]) * powers(BASE_INV, len(p))[own])
        k = j
    return out


def repeated_windows(texts: list[bytes], offs: np.ndarray, times: np.ndarray, length: int, split: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(segment, first window, end of windows): runs of windows that occur twice or more, counting each segment `times` times.

    And of the segments marked by split (segments of the same anchor are elsewhere, too) a digest of each distinct window: (segment,
    window, single, digest, digest); single says that it occurs once here.
    """
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    raw = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    eight = eights(raw)
    depth = (length - 8) // 8  # whole symbols in every window but for up to 8 + length % 8 bytes at its ends
    grid = offs % 8
    symbols = (size - grid) // 8
    which = np.repeat(np.arange(len(texts)), symbols)
    first_symbol = np.concatenate([[0], np.cumsum(symbols)[:-1]])
    classes = RunIndex(eight[begin[which] + grid[which] + 8 * (np.arange(len(which)) - first_symbol[which])], symbols).classes(depth).astype(np.int32)
    windows = size - length + 1
    # a block's places fit 32 bits, which halves the memory of what there is of each window
    seg = np.repeat(np.arange(len(texts), dtype=np.int32), windows)
    i = np.arange(len(seg), dtype=np.int32)
    i -= np.concatenate([[0], np.cumsum(windows)[:-1]]).astype(np.int32)[seg]
    e = (offs.astype(np.int32)[seg] - i) % np.int32(8)
    kind = classes[first_symbol.astype(np.int32)[seg] + (i + e - grid.astype(np.int32)[seg]) // np.int32(8)]
    dup = times[seg] > 1
    some = np.flatnonzero(kind >= 0)
    first = np.ones(len(seg), bool)  # of the windows that are equal, the first
    if len(some):
        at, left = begin[seg[some]] + i[some], e[some]
        rest = length - 8 * depth  # bytes around the symbols: `left` of them before
        low = eight[at] & ~(~U64(0) >> (U64(8) * left.astype(U64)))
        keys = [low, kind[some].astype(np.int64) * 8 + left]
        for k in range(0, rest, 8):  # all bytes behind the symbols, 8 at a time; the last 8 of the window are the last of them
            stop = at + np.minimum(left + 8 * depth + k, length - 8)
            tail = eight[stop]
            if rest == 8:
                tail = tail & np.where(left == 0, ~U64(0), (U64(1) << (U64(8) * (U64(8) - left.astype(U64)))) - U64(1))
            keys.append(tail)
        group = np.zeros(len(some), np.int64)
        for key in keys:
            _, inverse = np.unique(key, return_inverse=True)
            _, group = np.unique(group * (len(some) + 1) + inverse, return_inverse=True)
        dup[some] |= np.bincount(group, times[seg[some]])[group] > 1
        first[some] = False
        first[some[np.unique(group, return_index=True)[1]]] = True
    del eight, kind, e, some
    mark = np.concatenate([[False], dup, [False]])
    edge = np.concatenate([[True], seg[1:] != seg[:-1], [True]]) if len(seg) else np.ones(1, bool)
    on = np.flatnonzero(mark[1:-1] & (edge[:-1] | ~mark[:-2]))
    off = np.flatnonzero(mark[1:-1] & (edge[1:] | ~mark[2:]))
    open_ = np.flatnonzero(split[seg] & first)
    at = begin[seg[open_]] + i[open_]
    digests = [window_digests(raw, at, length, values) for values in (BYTE_VALUE, _BYTE_VALUE_2)]
    return (seg[on], i[on], i[off] + 1), (seg[open_], i[open_], ~dup[open_], *digests)


def judge(segs: DataFrame, length: int) -> DataFrame:
    """(id, th, begin, end): repeated bytes of each place of each segment."""

    def block(held: list[pa.RecordBatch], split: bool) -> Iterator[pa.RecordBatch]:
        """Of the rows of whole anchors, or of a part of one (split)."""
        table = pa.Table.from_batches(held)
        keys = np.stack([table[c].to_numpy() for c in ("anchor", "seg", "off")], axis=1)
        _, first, inverse = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        places = table["id"].combine_chunks()
        counts = np.diff(places.offsets.to_numpy())
        texts = table["text"].take(pa.array(first)).to_pylist()
        times = np.bincount(inverse, counts, len(first)).astype(np.int64)
        (seg, start, stop), (open_seg, window, single, digest, other) = repeated_windows(texts, keys[first, 2], times, length, np.full(len(first), split))
        ids, ths, lo = (table[c].combine_chunks().values.to_numpy() for c in ("id", "th", "lo"))
        del table, texts
        if len(seg):
            # every place of a segment with every run of it
            row_of_place = np.repeat(np.arange(len(keys)), counts)
            own = inverse[row_of_place]
            runs = np.bincount(seg, minlength=len(first))
            run_first = np.concatenate([[0], np.cumsum(runs)[:-1]])
            place = np.repeat(np.arange(len(own)), runs[own])
            nth = np.arange(len(place)) - np.repeat(np.cumsum(runs[own]) - runs[own], runs[own])
            run = run_first[own[place]] + nth
            none = pa.nulls(len(place), pa.int64())
            yield from slices(pa.RecordBatch.from_arrays([none, none, pa.array(ids[place]), pa.array(ths[place]), pa.array(lo[place] + start[run]), pa.array(lo[place] + stop[run] + length - 1)], names=NAMES))
        for k in range(0, len(open_seg), OUT_ROWS):
            own = slice(k, k + OUT_ROWS)
            # a window that is single here has one place, that of its segment's only row; of others all places are known to repeat
            place = np.concatenate([[0], np.cumsum(counts)])[first[open_seg[own]]]
            begin = lo[place] + window[own]
            columns = [ids[place], ths[place], begin, begin + length]
            yield pa.RecordBatch.from_arrays([pa.array(digest[own].view(np.int64)), pa.array(other[own].view(np.int64)), *(pa.array(c, mask=~single[own]) for c in columns)], names=NAMES)

    @releasing
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for parts, group in runs_within(batches, 2, BLOCK_BYTES):
            own = sum(b.column(3).nbytes for b in group)
            if parts or weight + own > GATHER_BYTES:
                if held:
                    yield from block(held, False)
                held, weight = [], 0
            if parts:
                yield from block(group, True)
            else:
                held += group
                weight += own
        if held:
            yield from block(held, False)

    counts = cut(segs.groupBy("anchor").agg(F.count("*").alias("n")), "segment-counts")
    dealt = salted(segs, "anchor", counts, F.col("seg"), least=BLOCK_SEGMENTS).select("anchor", "salt", "seg", "text", "off", "id", "th", "lo", "parts")
    dealt = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "seg", "off")
    found = cut(dealt.mapInArrow(judged, "digest long, other long, id long, th long, begin long, end long"), "judged")
    discard(counts)
    places = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "th", "begin", "end"))).alias("places")
    # rows of one digest: one for each block of a hot anchor at most
    across = found.filter("digest is not null").groupBy("digest", "other").agg(F.count("*").alias("n"), places).filter("n > 1").select(F.explode("places").alias("p")).select("p.*")
    return found.filter("digest is null").select("id", "th", "begin", "end").union(across)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of OUT_ROWS rows."""
    for k in range(0, batch.num_rows, OUT_ROWS):
        yield batch.slice(k, OUT_ROWS)


def runs_within(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[bool, list[pa.RecordBatch]]]:
    """(split, rows) of runs of rows with equal first `keys` columns, of sorted batches: split says that a run's rows are elsewhere, too:
    in other parts (a column parts above 1), or in other rows given out, as a run of more than 2 x most bytes comes in several."""
    last, held, weight, cut_before = None, [], 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.ones(batch.num_rows, bool)
        change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        at = [*np.flatnonzero(change), batch.num_rows]
        for i, j in zip(at[:-1], at[1:]):
            key = tuple(c[i] for c in columns)
            if last is not None and key != last and held:
                yield cut_before or held[0].column("parts")[0].as_py() > 1, held
                held, weight, cut_before = [], 0, False
            elif last is not None and key != last:
                cut_before = False
            last = key
            step = max(1, (j - i) * most // max(1, batch.slice(i, j - i).column("text").nbytes))
            for k in range(i, j, step):
                part = batch.slice(k, min(step, j - k))
                if weight > most:
                    yield True, held
                    held, weight, cut_before = [], 0, True
                held.append(part)
                weight += part.column("text").nbytes
    if held:
        yield cut_before or held[0].column("parts")[0].as_py() > 1, held


def find_spans(docs: DataFrame, length: int) -> DataFrame:
    """(id, th, spans), written: the runs of bytes of each text that strings of `length` bytes which also start elsewhere cover, as (begin,
    end) in order; touching runs are one. docs: as for find_anchors."""
    anchors = cut(find_anchors(docs, length), "anchors")
    again = cut(anchors.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1"), "repeated-anchors")
    lists = join_hot(anchors, again, "anchor", "times").groupBy("id", "th").agg(F.collect_set(F.struct("lo", "n", "off", "anchor")).alias("list"))
    segs = cut(extract(docs.select("id", "th", "text").join(lists, ["id", "th"]), length), "segments")
    discard(anchors, again)
    spans = judge(segs, length).groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))

    @releasing
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(2).offsets.to_numpy()
            begin, end = (batch.column(2).values.field(k).to_numpy() for k in range(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            begin, end = begin[first[0] : first[-1]], end[first[0] : first[-1]]
            # a row's places lie above those of the rows before it, so one running maximum is enough
            above = np.concatenate([[0], np.cumsum(np.full(batch.num_rows, int(end.max(initial=0)) + 1))])[row]
            reach = np.maximum.accumulate(end + above)
            opens = np.flatnonzero(np.concatenate([[True], (begin + above)[1:] > reach[:-1]])) if len(row) else row
            stop = (reach - above)[np.concatenate([opens[1:], [len(row)]]) - 1] if len(row) else end
            counts = np.bincount(row[opens], minlength=batch.num_rows)
            spans = pa.StructArray.from_arrays([pa.array(begin[opens]), pa.array(stop)], names=["begin", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)], names=["id", "th", "spans"])

    found = cut(spans.mapInArrow(joined, "id long, th long, spans array<struct<begin: long, end: long>>"), "spans")
    discard(segs)
    return found


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, passages: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary): the text's bytes without those in a string of `length` bytes that
    also starts elsewhere, in any row (the same one included). With passages (at most length), also passages_removed and
    passages_kept: the same of strings of that many bytes.

    Strings are judged on the input, so all copies go; rows with the same text and id are different rows. Columns of these
    names are replaced (and those that begin with __ id, th, text, spans or passages are dropped), others stay; ids may be of any type,
    null or repeated. A null text is an empty one. Cutting bytes may split a character, so kept is binary. length is 64 or more.
    """
    if min(length, passages or length) < 64:
        raise ValueError("length is less than 64")
    if passages and passages > length:
        raise ValueError("passages are longer than length")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "__id", "__th", "__text", "__spans", "__passages", *["passages_removed", "passages_kept"] * bool(passages))
    # rows are known by 128 bits of hashes of id and text; rows equal in both have equal results
    own = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({"__text": own, "__id": F.xxhash64(F.lit(9), F.col(doc_id), own), "__th": F.xxhash64(own, F.col(doc_id))})
    runs = "array<struct<begin: long, end: long>>"
    plain = keyed.select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("__text").alias("text"), F.lit(None).cast(runs).alias("runs"))
    if passages:
        short = find_spans(plain, passages)
        # equal rows are searched one by one: each is a place of its strings
        long = short.select("id", "th", F.filter("spans", lambda x: x["end"] - x["begin"] >= length).alias("runs")).filter(F.size("runs") > 0)
        within = cut(plain.drop("runs").join(long, ["id", "th"]), "within")
        longer = find_spans(within, length)
        both = short.withColumnRenamed("spans", "__passages").join(longer.withColumnRenamed("spans", "__spans"), ["id", "th"], "left")
        spans = cut(both, "both-spans")
        discard(within, longer, short)
    else:
        spans = find_spans(plain, length).withColumnRenamed("spans", "__spans")
    columns = ["__spans", *["__passages"] * bool(passages)]
    joined = keyed.join(spans.withColumnsRenamed({"id": "__id", "th": "__th"}), ["__id", "__th"], "left").select(*docs.columns, "__text", *columns)
    at = len(docs.columns)

    @releasing
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            view = memoryview(np.ascontiguousarray(data))

            def without(lists: pa.ListArray) -> tuple[list[int], list[int], list[bytes]]:
                n_removed, n_spans, kept = [], [], []
                for row in range(batch.num_rows):
                    own, spans = view[offsets[row] : offsets[row + 1]], lists[row].as_py() or ()
                    ends = [0, *(x["end"] for x in spans)]
                    n_removed.append(sum(x["end"] - x["begin"] for x in spans))
                    n_spans.append(len(spans))
                    kept.append(b"".join([*(own[a : x["begin"]] for a, x in zip(ends, spans)), own[ends[-1] :]]))
                return n_removed, n_spans, kept

            n_removed, n_spans, kept = without(batch.column(at + 1))
            out = {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())}
            if passages:
                n_removed, _, kept = without(batch.column(at + 2))
                out |= {"passages_removed": pa.array(n_removed, pa.int64()), "passages_kept": pa.array(kept, pa.binary())}
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *out.values()], names=[*batch.schema.names[:at], *out])

    schema = docs.limit(0).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    if passages:
        schema = schema.add("passages_removed", "long").add("passages_kept", "binary")
    return joined.mapInArrow(removed, schema)
