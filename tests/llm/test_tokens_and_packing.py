import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushframe.llm import common, packing, pretokens, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "é", "'s", "'", "!", "<|endoftext|>", "İ", "Σ", "\xa0", "1", "²", "​", "日", "😀", "_", "\x1c", "\r\n", "ﬁ", "<|"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_caches_give_the_librarys_result(parts):
    text = "".join(parts)
    word, byte = pretokens.worker(pretokens.WordLengths, WORD), pretokens.worker(pretokens.ByteIds, BYTE)
    assert word.count(text, {}) == len(word.tokenizer.encode(text, add_special_tokens=False).ids)
    assert byte.ids(text) == byte.whole(text)


def test_counts(spark, make, texts, clashing):
    own = Tokenizer.from_file(WORD)
    rows = token_counts.count_tokens(clashing(make(spark, texts)), WORD, limit=50).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"], r["label"]) == (len(text.encode()), n, n > 50, "mine")


def test_no_documents(spark, empty):
    assert token_counts.count_tokens(empty, WORD).count() == 0
    assert packing.pack(empty, BYTE).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_an_exact_round_trip(spark, make, texts, clashing, capacity):
    own = Tokenizer.from_file(BYTE)
    rows = packing.pack(clashing(make(spark, texts)), BYTE, capacity=capacity).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    assert set(pieces) == set(range(len(texts)))
    for k, parts in pieces.items():
        ids = own.encode(texts[k] or "", add_special_tokens=False).ids + [0]
        at = 0
        for n, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == capacity)
            assert zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
        total += at
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1 + 1.05 * total / capacity


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_plans_fill_slots_once(histogram):
    plan = packing.best_fit(histogram, 32)
    used = defaultdict(list)
    for length, n in histogram.items():
        ranks = sorted((int(r[1]), int(r[2]), r) for r in plan if r[0] == length)
        at = 0
        for first, count, r in ranks:
            assert first == at
            at += count
            for k in range(count):
                used[r[3] + k // r[4]].append((r[5] + k % r[4] * length, length))
        assert at == n
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 32


def test_repeated_rows_and_null_ids(spark, make):
    rows = packing.pack(make(spark, ["a b c", "a b c", "x", None], [5, 5, None, None]), BYTE, capacity=4).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 5), (False, 5), (True, 0), (True, 0)]
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows)


def test_workers_keep_no_cache_after_packing(spark, make, texts):
    """Idle workers would hold a full one through all stages that follow."""
    assert packing.pack(make(spark, texts), BYTE).count()

    def entries(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(pretokens._workers)]), pa.array([sum(len(e.cache) for e in pretokens._workers.values() if isinstance(e, pretokens.ByteIds))])], names=["encoders", "entries"])

    rows = spark.range(8, numPartitions=4).mapInArrow(entries, "encoders long, entries long").collect()
    assert max(r["encoders"] for r in rows) and not max(r["entries"] for r in rows)


def test_batches_of_long_texts_are_small(spark):
    docs = spark.range(2500, numPartitions=1).selectExpr("id", "repeat(char(97 + id % 26), 10000) text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    rows = common.cut(docs.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r["n"] for r in rows) == 2500
    assert max(r["bytes"] for r in rows) < common.BATCH_BYTES + 20_000
