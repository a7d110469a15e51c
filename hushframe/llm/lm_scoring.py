"""Operator 2, language-model scoring: prediction by partial matching over a pretrained byte-context trie.

The text a model sees is the document's words, lower-cased (A-Z), joined by one space and closed by an end byte, so its
probability is that of the word sequence and of the end. Contexts never cross documents.

Training counts every (ORDER + 1)-gram of bytes of all training documents; each task sums its own first, and a shuffle sums the
tasks'. Shorter n-grams follow by summing over first bytes. All of them are written. The broadcast trie has at most NODES of them, so
its size in memory is known: all n-grams of the contexts that are seen most. What it says of a context is thus exact, and a context's
suffixes, which are seen at least as often, are in it too. Bytes behind any other context of ORDER bytes are looked up by a join: the
written n-grams and the n-grams that miss meet by the last bytes of their contexts, and each such group has a trie of its own. So
scores are those of all counts at every size.

Scoring (a form of method D, with symbol exclusion): at each byte the longest context in the trie predicts; a byte that it hasn't
seen costs an escape and goes to the next shorter context, without the symbols that the longer one had. As every symbol seen
after a context was also seen after its suffix, what exclusion leaves of a suffix depends on the longer context alone, and is kept
with it. So the code length of a byte is a function of the last ORDER + 1 bytes; workers keep it in a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import SPACE, U64, Counter64, Memo, Tokens, byte_map, cut, flat, groups, steps

#: Bytes of the longest context.
ORDER = 5
#: Most n-grams of the broadcast trie, and most words of the broadcast word counts (16 bytes each). Neither changes results.
NODES = 1 << 21
WORDS = 1 << 20
#: Last bytes of a context that n-grams which the broadcast trie lacks are grouped by.
TAIL = 2
SEPARATOR, END = 0x20, 0x0A
SYMBOLS = 256
#: Kinds of counted keys.
GRAM, WORD, DOCUMENT = 0, 1, 2
_WORDS = byte_map(SPACE)


def grams(tokens: Tokens, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each byte of the rows' model texts, as big-endian integers, and where each row begins."""
    text = tokens.text.copy()
    keep = text != 0
    text[tokens.end] = SEPARATOR
    keep[tokens.end] = True
    words = np.diff(tokens.first)
    last = np.where(words > 0, tokens.end[tokens.first[1:] - 1] if len(tokens.end) else 0, tokens.slot)
    text[last] = END
    keep[last] = True
    text = text[keep]
    stop = np.cumsum(keep)[tokens.slot]
    begin = np.concatenate([[0], stop[:-1]])
    padded = np.full(len(text) + order * len(begin), END, np.uint8)
    place = np.arange(len(text)) + order * (1 + np.repeat(np.arange(len(begin)), stop - begin))
    padded[place] = text
    one = padded.astype(U64)
    found, width = one[order:], 1
    while width <= order:
        found = found | (one[order - width : len(one) - width] << U64(8 * width))
        width += 1
    return found[place - order], begin


def count_training(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): n-grams, words by hash, and documents, of all rows of docs (a column text)."""

    def rows(kind: int, found: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        keys, n = found or (np.zeros(0, U64), np.zeros(0, np.int64))
        for at in range(0, len(keys), 1 << 18):
            part = keys[at : at + (1 << 18)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[at : at + (1 << 18)])], names=["kind", "key", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, word, documents = Counter64(), Counter64(), 0
        for batch in batches:
            data, offsets = flat(batch.column(0))
            documents += batch.num_rows
            for i, j in steps(offsets):
                tokens = Tokens(data, offsets[i : j + 1], _WORDS)
                yield from rows(GRAM, gram.add(grams(tokens, order)[0]))
                yield from rows(WORD, word.add(tokens.hashes()))
        yield from rows(GRAM, gram.total())
        yield from rows(WORD, word.total())
        yield from rows(DOCUMENT, (np.zeros(1, U64), np.array([documents])))

    return docs.select("text").mapInArrow(counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def kept_within(counts: DataFrame, most: int, weight: str | None = None) -> DataFrame:
    """Rows of counts with n above the lowest level that leaves at most `most` rows (or sum of a column weight); levels are eighths of
    powers of two."""
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = {r[0]: r[1] for r in counts.groupBy(level.alias("level")).agg(F.sum(weight) if weight else F.count("*")).collect()}  # at most 8 x 63 rows
    total, lowest = 0, 1 << 30
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        lowest = k
    return counts.filter(level >= lowest)


def of_frequent_contexts(gram: DataFrame, most: int) -> DataFrame:
    """Rows of gram (length, key, n) of the contexts seen most, with all n-grams of each: at most `most` rows."""
    context = F.shiftrightunsigned("key", 8).alias("context")
    contexts = cut(gram.groupBy("length", context).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "contexts")
    kept = kept_within(contexts, most, "kinds").select("length", "context")
    return gram.select("*", context).join(kept, ["length", "context"]).select("length", "key", "n")


def looked_up(asked: DataFrame, gram: DataFrame, order: int) -> DataFrame:
    """(key, value) of asked (distinct (order + 1)-grams, a column key): log10 of each one's last byte after the others, by all n-grams.

    The n-grams that decide on a key have its last context bytes, as far as they are so long. So both are dealt out by the last TAIL of
    them; shorter n-grams, of which the alphabet allows few, go to every task.
    """
    tail = min(TAIL, order)
    short = gram.filter(F.col("length") <= tail).toArrow()  # at most 256 + 65,536 rows
    shared = gram.sparkSession.sparkContext.broadcast(tuple(short[c].to_numpy() for c in ("length", "key", "n")))
    own = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * tail) - 1)).alias("tail")
    table = gram.filter(F.col("length") > tail).select(own, F.col("length").cast("int").alias("length"), "key", "n")
    dealt = table.union(asked.select(own, F.lit(0).alias("length"), "key", F.lit(0).cast("long"))).repartition("tail").sortWithinPartitions("tail")

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, keys, counts = shared.value
        for group in groups(batches, 1):
            length, key, n = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in group]) for k in (1, 2, 3))
            asks = length == 0
            if not asks.any():
                continue
            mine = (keys >> 8) == group[0].column(0)[0].as_py() & ((1 << 8 * (lengths.astype(np.int64) - 1)) - 1)
            trie = Trie(np.concatenate([lengths[mine], length[~asks]]), np.concatenate([keys[mine], key[~asks]]).view(U64), np.concatenate([counts[mine], n[~asks]]), order)
            yield pa.RecordBatch.from_arrays([pa.array(key[asks]), pa.array(trie.log10(key[asks].view(U64)))], names=["key", "value"])

    return dealt.mapInArrow(valued, "key long, value double")


class Trie:
    """The n-grams of up to order + 1 bytes and their counts, as arrays by length, and what each context needs to predict."""

    def __init__(self, length: np.ndarray, key: np.ndarray, n: np.ndarray, order: int):
        self.order, self.gram, self.count, self.context = order, [], [], []
        self.whole, self.kinds, self.rest, self.rest_kinds = [], [], [], []
        for k in range(order + 1):  # n-grams of k + 1 bytes: contexts of k bytes with a symbol
            own = length == k + 1
            at = np.argsort(key[own])
            self.gram.append(key[own][at])
            self.count.append(n[own][at].astype(np.float64))
            parent = self.gram[k] >> U64(8)
            context, inverse = np.unique(parent, return_inverse=True)
            self.context.append(context)
            self.whole.append(np.bincount(inverse, self.count[k], len(context)))
            self.kinds.append(np.bincount(inverse, minlength=len(context)).astype(np.float64))
            if k:
                shorter = self.gram[k] & U64((1 << 8 * k) - 1)
                theirs = self.count[k - 1][np.searchsorted(self.gram[k - 1], shorter)]
                suffix = np.searchsorted(self.context[k - 1], context & U64((1 << 8 * (k - 1)) - 1))
                self.rest.append(self.whole[k - 1][suffix] - np.bincount(inverse, theirs, len(context)))
                self.rest_kinds.append(self.kinds[k - 1][suffix] - self.kinds[k])
            else:
                self.rest.append(np.zeros(0))
                self.rest_kinds.append(np.zeros(0))

    @staticmethod
    def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(among):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return at, among[at] == keys

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each (order + 1)-gram's last byte after the others."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        longer = np.full(len(keys), -1)  # the context one byte longer, where it is in the trie
        for k in range(self.order, -1, -1):
            own = keys[open_]
            context, has = self._find(self.context[k], (own >> U64(8)) & U64((1 << 8 * k) - 1))
            before = longer[open_]
            total = np.where(has, self.whole[k][context] if len(self.whole[k]) else 0, 0.0)
            kinds = np.where(has, self.kinds[k][context] if len(self.kinds[k]) else 0, 0.0)
            if k < self.order and len(self.rest[k + 1]):
                after = before >= 0
                total = np.where(after, self.rest[k + 1][before], total)
                kinds = np.where(after, self.rest_kinds[k + 1][before], kinds)
            at, seen = self._find(self.gram[k], own & U64((1 << 8 * (k + 1)) - 1))
            hit = has & seen
            out[open_[hit]] += np.log10((2 * self.count[k][at[hit]] - 1) / (2 * total[hit]))
            escape = has & ~seen & (total > 0)
            out[open_[escape]] += np.log10(kinds[escape] / (2 * total[escape]))
            longer[open_] = np.where(has, context, -1)
            open_ = open_[~hit]
        unseen = SYMBOLS - (self.kinds[0][0] if len(self.kinds[0]) else 0)
        out[open_] -= np.log10(unseen)
        return out


class Scorer:
    """A worker's trie (whole, or of frequent contexts), word counts and tables."""

    def __init__(self, trie: Trie, whole: bool, words: np.ndarray, counts: np.ndarray):
        self.trie, self.whole, self.lengths = trie, whole, Memo(21)
        self.words = Memo(max(10, int(1.8 * max(1, len(words))).bit_length()), np.int64)
        self.words.put(words, counts)

    def texts(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's score without the n-grams that the trie can't decide on, and these: (row, key)."""
        keys, begin = grams(tokens, self.trie.order)
        keys = keys + U64(1)
        values, absent = self.lengths.get(keys)
        if len(absent):
            fresh, inverse = np.unique(keys[absent], return_inverse=True)
            found = self.trie.log10(fresh - U64(1))
            if not self.whole:
                found[~Trie._find(self.trie.context[self.trie.order], (fresh - U64(1)) >> U64(8))[1]] = np.nan
            values[absent] = found[inverse]
            self.lengths.put(fresh, found)
        open_ = np.flatnonzero(np.isnan(values))
        values[open_] = 0
        return np.add.reduceat(values, begin), np.searchsorted(begin, open_, side="right") - 1, keys[open_] - U64(1)


class Absent:
    """Rows' lists of distinct keys that the broadcast tables lack, with how often each is there."""

    def __init__(self):
        self.keys, self.times, self.first = [], [], [np.zeros(1, np.int64)]

    def add(self, row: np.ndarray, keys: np.ndarray, rows: int) -> None:
        at = np.lexsort((keys, row))
        r, h = row[at], keys[at]
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
        self.keys.append(h[new])
        self.times.append(np.diff(np.concatenate([new, [len(r)]])))
        self.first.append(np.cumsum(np.bincount(r[new], minlength=rows)) + self.first[-1][-1])

    def arrays(self) -> list[pa.Array]:
        first = pa.array(joined(self.first, np.int32))
        return [pa.ListArray.from_arrays(first, pa.array(joined(self.keys, U64).view(np.int64))), pa.ListArray.from_arrays(first, pa.array(joined(self.times, np.int64)))]


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


_scorers: dict[str, Scorer] = {}
#: Bytes of text that one step of scoring takes.
_STEP = 1 << 18


def score(docs: DataFrame, training: DataFrame, *, order: int = ORDER, nodes: int = NODES, words: int = WORDS) -> DataFrame:
    """docs (columns doc_id and text) with n_tokens, n_known, train_tokens, base_score and score, learnt from training (a column text).

    score is the model's log10 probability of the row's word sequence and end; base_score that of add-one word counts, where n_known
    is the number of tokens (words and the end) that training has. A null text is an empty one: one token, the end. Texts of any
    length are scored whole; equal texts get equal scores; repeated rows and null ids stay. With an empty training table every
    byte has probability 1/256. Counts are exact: n-grams and words beyond the broadcast tables are joined.
    """
    spark = docs.sparkSession
    counts = cut(count_training(training, order), "counts")
    gram = counts.filter(F.col("kind") == GRAM)
    suffixes = F.explode(F.array(*[F.struct(F.lit(m).alias("length"), F.col("key").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("key")) for m in range(1, order + 2)])).alias("g")
    gram = cut(gram.select(suffixes, "n").groupBy("g.length", "g.key").agg(F.sum("n").alias("n")), "trie")
    whole = gram.count() <= nodes
    kept = (gram if whole else of_frequent_contexts(gram, nodes)).toArrow()  # at most `nodes` rows
    trie = Trie(kept["length"].to_numpy(), kept["key"].to_numpy().view(U64), kept["n"].to_numpy(), order)
    word = counts.filter(F.col("kind") == WORD)
    sums = counts.filter(F.col("kind") != GRAM).agg(F.sum("n"), F.count(F.when(F.col("kind") == WORD, 1)), F.sum(F.when(F.col("kind") == DOCUMENT, F.col("n")))).first()
    total, kinds, ends = (int(x or 0) for x in sums)
    kinds += ends > 0
    frequent = kept_within(word, words).toArrow()  # at most `words` rows
    known, known_n = frequent["key"].to_numpy().view(U64), frequent["n"].to_numpy()
    shared = spark.sparkContext.broadcast((trie, whole, known, known_n))
    model = uuid.uuid4().hex

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _scorers:
            _scorers.clear()
            _scorers[model] = Scorer(*shared.value)
        own = _scorers[model]
        for batch in batches:
            data, offsets = flat(batch.column(1))
            values, n_tokens, n_known, base, rare, open_ = [], [], [], [], Absent(), Absent()
            for i, j in steps(offsets, _STEP):
                tokens = Tokens(data, offsets[i : j + 1], _WORDS)
                value, open_row, open_key = own.texts(tokens)
                values.append(value)
                open_.add(open_row, open_key, j - i)
                hashes = tokens.hashes()
                c, absent = own.words.get(hashes)
                c[absent] = 0
                row = np.repeat(np.arange(j - i), np.diff(tokens.first))
                n_tokens.append(np.diff(tokens.first) + 1)
                n_known.append(np.bincount(row[c > 0], minlength=j - i) + (ends > 0))
                base.append(np.bincount(row, np.log10(c + 1.0), minlength=j - i) + np.log10(ends + 1.0))
                rare.add(row[absent], hashes[absent], j - i)
            n = joined(n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n), pa.array(joined(n_known, np.int64)), pa.array(joined(base, np.float64) - n * np.log10(float(total + kinds + 1))), pa.array(joined(values, np.float64)),
                    *rare.arrays(), *open_.arrays(),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "rare_n", "open", "open_n"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<long>, rare_n array<long>, open array<long>, open_n array<long>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    shared.destroy()  # all rows are scored by it
    pairs = lambda keys, times: rows.filter(F.size(keys) > 0).select("row", F.explode(F.arrays_zip(keys, times)).alias("r")).select("row", F.col(f"r.{keys}").alias("key"), F.col(f"r.{times}").alias("times"))
    found = pairs("rare", "rare_n").join(word.select("key", "n"), "key").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    out = rows.drop("rare", "rare_n", "open", "open_n").join(found, "row", "left")
    whole_score = F.col("score")
    if not whole:
        missed = pairs("open", "open_n")
        # decimals, so that the sum doesn't depend on the order of rows and equal texts get equal scores
        rest = missed.join(looked_up(missed.select("key").distinct(), gram, order), "key").groupBy("row").agg(F.sum((F.col("times") * F.col("value")).cast("decimal(28,16)")).alias("rest"))
        out = out.join(rest, "row", "left")
        whole_score = F.col("score") + F.coalesce(F.col("rest").cast("double"), F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), whole_score.alias("score"),
    )
