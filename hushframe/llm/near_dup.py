"""Operator 4, near-duplicates: BagMinHash signatures of word shingles, banding, and exact verification of multiset overlap.

1. Equal texts (by 128 bits of hashes) are put together first, so that copies count once; each distinct text is a node with a number.
   Its signature is made where it is put together, and written with it.
2. Bands of the signature make buckets. In each bucket every text is paired with two of its texts, the hubs (the smallest and the
   largest number), which is linear in the bucket's size. Pairs are verified on the whole texts; those that pass are links.
3. Connected components of the links. Buckets whose texts are now one component need no more work. In every other bucket the texts
   outside its largest component are compared with all its texts, in blocks of bounded size, by their signatures. First each such text's
   likeliest link is verified, which joins nearly all that belongs together; then all pairs of texts of still different components
   that may be links are. So no link between texts that share a bucket is lost to the choice in step 2, and no bucket is capped.
4. A class is a component; it is named by its smallest document id.

Hot buckets, hubs, classes and texts (as large as any share of the rows) meet broadcasts of a bounded number of hot keys, or are dealt
to several tasks; a hub's text travels once to each of its tasks and not with each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.bagminhash import signatures
from hushframe.llm.common import SPACE, U64, Tokens, byte_map, cut, discard, flat, groups, join_hot, mix, releasing, salted, steps

WORDS = 5
SIMILARITY = 0.8
#: Two texts of similarity 0.8 share no band with probability (1 - 0.8**6)**32 < 1e-4.
BANDS, ROWS = 32, 6
#: Components of a signature: more than the bands use, so that step 3 can tell pairs below SIMILARITY from others by them.
SIZE = 640
#: Pairs whose signatures are this many standard deviations below SIMILARITY are not verified in step 3 (1.3e-5 of those at it).
DEVIATIONS = 4.2
#: Bytes of text whose signatures are made at once: each takes some 50 bytes meanwhile.
SIGN_BYTES = 1 << 18
#: Texts of a block in step 3.
BLOCK = 2048
_WORDS = byte_map(SPACE)


def shingles(tokens: Tokens, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `words` words, and the row of each; all words of a row of fewer words are its one shingle."""
    own = tokens.hashes()
    count = np.diff(tokens.first)
    row = np.repeat(np.arange(len(count)), count)
    left = tokens.first[1:][row] - np.arange(len(own))
    found, behind = own.copy(), np.concatenate([own, np.zeros(words - 1, U64)])
    for k in range(1, words):
        found = np.where(left > k, mix(found) + behind[k : len(own) + k], found)
    keep = (left >= words) | (left == count[row])
    return mix(found[keep]), row[keep]


def bags(tokens: Tokens, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, row): each row's distinct shingles (44 bits of their hashes) and how often it has them, by row and element."""
    found, row = shingles(tokens, words)
    key = np.sort((row.astype(U64) << U64(44)) | (found >> U64(20)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at] & U64((1 << 44) - 1), np.diff(np.concatenate([at, [len(key)]])), (key[at] >> U64(44)).astype(np.int64)


def text_hash(text: Column) -> tuple[Column, Column]:
    """What texts are told apart by, 128 bits; a null text is an empty one."""
    own = F.coalesce(text, F.lit(""))
    return F.xxhash64(own), F.xxhash64(F.lit(4), own)


def sign(texts: DataFrame, words: int, bands: int, rows: int, size: int) -> DataFrame:
    """(h1, h2, text, bands, sketch, shingles) of texts (h1, h2, text): band hashes (none for a text without words), a byte for each
    component, the number of shingles."""

    @releasing
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            keys, sketches, some, sizes = [], [], [], []
            for i, j in steps(offsets, SIGN_BYTES):
                element, weight, row = bags(Tokens(data, offsets[i : j + 1], _WORDS), words)
                found = signatures(element, weight, row, j - i, size).view(U64)
                band = mix(np.arange(bands, dtype=U64))[None, :] + np.zeros((j - i, 1), U64)
                for k in range(rows):
                    band = mix(band + found[:, k : bands * rows : rows])
                keys.append(band.view(np.int64))
                sketches.append((mix(found) >> U64(56)).astype(np.uint8))
                some.append(np.bincount(row, minlength=j - i) > 0)
                sizes.append(np.bincount(row, weight, j - i).astype(np.int64))
            if not keys:
                continue
            keys, sketches, some = np.concatenate(keys), np.concatenate(sketches), np.concatenate(some)
            first = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            sketch = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sketches))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(first), pa.array(keys[some].reshape(-1))), sketch, pa.array(np.concatenate(sizes))], names=["h1", "h2", "text", "bands", "sketch", "shingles"])

    return texts.select("h1", "h2", "text").mapInArrow(signed, "h1 long, h2 long, text string, bands array<long>, sketch binary, shingles long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes (a written table) those whose shingle multisets overlap by `least` of their union or more; exact, whole
    texts. b is a hub: its pairs stand behind one row with its text, in as many tasks as they need."""
    sizes = cut(pairs.groupBy("b").agg(F.count("*").alias("n")), "hub-sizes")
    dealt = cut(salted(pairs, "b", sizes, F.col("a")).select("a", "b", "salt"), "pairs")
    asked = dealt.select("b", "salt", "a", F.col("a").alias("node")).union(dealt.select("b", "salt").distinct().select("b", "salt", F.lit(-1).cast("long"), "b"))
    # one shuffle of the texts, at every size
    rows = asked.hint("merge").join(texts.select("node", "text"), "node").select("b", "salt", "a", "text").repartition("b", "salt").sortWithinPartitions("b", "salt", "a")

    @releasing
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_weight = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            a, (data, offsets) = batch.column(2).to_numpy(), flat(batch.column(3))
            passed = np.zeros(len(a), bool)
            for i, j in steps(offsets):
                element, weight, row = bags(Tokens(data, offsets[i : j + 1], _WORDS), words)
                is_hub = a[i:j] < 0
                group = np.cumsum(is_hub)  # 0: of the hub before this step
                key, of_hub = (group[row].astype(U64) << U64(44)) | element, is_hub[row]
                hubs_key, hubs_weight = np.concatenate([hub, key[of_hub]]), np.concatenate([hub_weight, weight[of_hub]])
                own_key, own_weight, own_row = key[~of_hub], weight[~of_hub], row[~of_hub]
                if len(hubs_key):
                    at = np.minimum(np.searchsorted(hubs_key, own_key), len(hubs_key) - 1)
                    same = hubs_key[at] == own_key
                    common = np.bincount(own_row[same], np.minimum(own_weight[same], hubs_weight[at[same]]), j - i)
                    hub_size = np.bincount((hubs_key >> U64(44)).astype(np.int64), hubs_weight, int(group[-1]) + 1)
                    union = np.bincount(own_row, own_weight, j - i) + hub_size[group] - common
                    passed[i:j] = ~is_hub & (common >= least * union - 1e-9)
                if is_hub.any():
                    last = group[row] == group[-1]
                    hub, hub_weight = element[last & of_hub], weight[last & of_hub]
            yield batch.filter(pa.array(passed)).select([2, 0])

    found = cut(rows.mapInArrow(checked, "a long, b long"), "links")
    discard(sizes, dealt)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of links (a, b); nodes have the same label if links lead from one to the other.

    By contraction: each node goes to the smallest of its neighbours and itself, links are moved along and those within one node go,
    until none is left. Numbers come from hashes, so the number of nodes falls by half or more in a round. The labels are put together
    at the end, from the small rounds' maps back to the first.
    """
    ends = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("b", "a"))
    edges, maps = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges"), []
    while True:
        up = cut(ends(edges).groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n")).select("node", F.least("node", "least").alias("label"), "n"), "labels")
        maps.append(up)
        # half a step at a time: hubs' links are hot on one side
        half = join_hot(edges, up.select(F.col("node").alias("a"), F.col("label").alias("to_a"), "n"), "a").select("to_a", "b")
        both = join_hot(half, up.select(F.col("node").alias("b"), F.col("label").alias("to_b"), "n"), "b").filter("to_a <> to_b")
        onward = cut(both.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        discard(edges)
        edges = onward
        if edges.isEmpty():
            break
    labels = maps[-1].select("node", "label")
    for earlier in reversed(maps[:-1]):
        labels = earlier.join(labels.select(F.col("node").alias("label"), F.col("label").alias("onward")), "label", "left").select("node", F.coalesce("onward", "label").alias("label"))
    labels = cut(labels, "labels")
    discard(edges, *maps)
    return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after more links (a, b): components of the labels that they join, which are few."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = cut(labels.join(ends, "node", "full").select("node", F.coalesce("label", "node").alias("label")), "labels")
    of = lambda c: every.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    joins = links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b")
    joined = components(joins)
    news = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    found = cut(every.join(news, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    discard(labels, every, joined)
    return found


def open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, band, node, label, out, n, outside): the rows of buckets that have several labels; out: not of the bucket's most frequent one."""
    members = cut(shared.select("bucket", "band", "node").join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label")), "members")
    shares = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = shares.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).filter("most.n < n")
    sizes = cut(sizes.select("bucket", F.col("most.label").alias("main"), "n", (F.col("n") - F.col("most.n")).alias("outside")), "open-buckets")
    found = cut(join_hot(members, sizes, "bucket").withColumn("out", F.col("label") != F.col("main")).drop("main"), "open-rows")
    discard(members, sizes)
    return found


def compare_outside(rows: DataFrame, sketches: DataFrame, bands: int, width: int, size: int, bar: float, least: float, likeliest: bool) -> DataFrame:
    """(a, b): pairs of step 3 with an estimate of `bar` or more, of open_rows and the texts' sketches (node, sketch, shingles); b is a text
    outside its bucket's largest component. With likeliest, only the best one of each b; else a pair comes from the first of the
    bands that it shares. Texts whose numbers of shingles rule out a similarity of `least` are no pair.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    rows = rows.hint("merge").join(sketches, "node")
    columns = ("out", "node", "label", "sketch", "shingles", "band")
    against = rows.select("bucket", own("n").alias("k"), all_("outside").alias("q"), F.lit(False).alias("asks"), *columns)
    asking = rows.filter("out").select("bucket", all_("n").alias("k"), own("outside").alias("q"), F.lit(True).alias("asks"), *columns)
    dealt = against.union(asking)
    dealt = dealt.repartition("bucket", "k", "q").sortWithinPartitions("bucket", "k", "q")

    def pairs(group: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        table = pa.Table.from_batches(group)
        asks, out, node, label, shingles = (table[c].to_numpy() for c in ("asks", "out", "node", "label", "shingles"))
        band = table["band"][0].as_py()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), size)
        rest = np.flatnonzero(~asks)
        for q in np.flatnonzero(asks):
            # two texts outside the largest component ask once, unless each looks for its likeliest link
            fits = np.minimum(shingles[rest], shingles[q]) >= least * np.maximum(shingles[rest], shingles[q]) - 1e-9
            others = rest[fits & (label[rest] != label[q]) & (~out[rest] | (node[q] < node[rest]) | likeliest)]
            same = sketch[others] == sketch[q]
            estimate = (same.mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            hit = np.flatnonzero(estimate >= bar)
            if likeliest and len(hit):
                hit = hit[[np.argmax(estimate[hit])]]
            elif len(hit):
                shared = same[hit, : bands * width].reshape(len(hit), bands, width).all(axis=2)
                hit = hit[np.argmax(shared, axis=1) == band]
            yield node[others[hit]], np.full(len(hit), node[q]), estimate[hit]

    @releasing
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            found = [np.concatenate(x) for x in zip(*pairs(group))]
            if found and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "estimate"])

    found = dealt.mapInArrow(compared, "a long, b long, estimate double")
    if likeliest:
        return found.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b")
    return found.select("a", "b")


def classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, class_docs, kept) for each row of docs: hashed_classes without the text hashes."""
    return hashed_classes(docs, **options).drop("h1", "h2")


def hashed_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """(doc_id, h1, h2, class_id, class_docs, kept) for each row of docs; h1 and h2 are text_hash of its text.

    Rows are in one class if they have the same text or if links lead from one to the other; a link is a weighted Jaccard similarity
    of `least` or more of their multisets of runs of `words` words (a shorter text is one run; a text without words, which a null
    text is too, has none and is alone with its copies). class_id is the smallest id of the class (null if all are), class_docs the
    number of its rows, and exactly one row of it is kept: one of that id. Ids may repeat or be null; no row is lost.
    """
    h1, h2 = text_hash(F.col(text))
    docs = docs.select(F.col(doc_id).alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    distinct = docs.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    nodes = cut(sign(distinct, words, bands, rows, size).withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    ends = cut(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("band").alias("band"), F.min("node").alias("first"), F.max("node").alias("last")).filter("n > 1"), "buckets")
    shared = cut(join_hot(banded.drop("band"), ends, "bucket"), "shared")
    hub = F.explode(F.array_distinct(F.array("first", "last")))
    star = cut(shared.select(F.col("node").alias("a"), hub.alias("b")).filter("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").groupBy("x", "y").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select("a", "b"), "star")
    # what step 2 and 3 look at: the texts that share a bucket
    candidates = shared.select("node").distinct()
    texts = cut(nodes.select("node", "text", "sketch", "shingles").hint("merge").join(candidates, "node", "left_semi"), "candidates")
    links = verified(star, texts, words, least)
    labels = components(links)
    discard(star, links)
    bar = least - DEVIATIONS * float(np.sqrt(least * (1 - least) / size))
    for low, likeliest in ((least, True), (bar, False)):
        open_ = open_rows(shared, labels)
        likely = cut(compare_outside(open_, texts.select("node", "sketch", "shingles"), bands, rows, size, low, least, likeliest), "outside")
        more = verified(likely, texts, words, least)
        if not more.isEmpty():
            labels = relabelled(labels, more)
        discard(open_, likely, more)
    discard(texts)
    # one row for each text, with its class; then the classes' rows
    named = cut(docs.select("doc_id", "h1", "h2", F.monotonically_increasing_id().alias("row")), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    copies = named.groupBy("h1", "h2").agg(F.count("*").alias("n"), best)
    of_text = nodes.select("h1", "h2", "node").join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("class"))
    of_text = cut(copies.join(of_text, ["h1", "h2"]), "texts")
    whole = cut(of_text.groupBy("class").agg(F.min("best").alias("kept_row"), F.sum("n").alias("class_docs"), F.count("*").alias("texts")), "classes")
    known = cut(join_hot(of_text, whole, "class", "texts").select("h1", "h2", "n", F.col("kept_row.doc_id").alias("class_id"), "class_docs", F.col("kept_row.row").alias("kept_row")), "texts")
    discard(of_text, whole, shared, ends, nodes)
    return join_hot(named, known, ["h1", "h2"]).select(F.col("doc_id").alias(doc_id), "h1", "h2", "class_id", "class_docs", (F.col("row") == F.col("kept_row")).alias("kept"))
