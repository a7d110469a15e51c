"""The registered queries over the smallest tables, whole, against brute force; op3, op5 and op7 have SQL."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hushframe.llm import queries
from test_duplicates import brute_classes
from test_models import brute_counts, probability
from tests_llm_words import words


@pytest.fixture(scope="module")
def rows(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def collected(spark, small, name):
    return queries.QUERIES[name](spark, small).collect()


def test_op1_learns_from_its_rows_alone(spark, small, rows, tmp_path):
    """Held-out rows are marked by their remainder, most are judged right, and their labels and texts teach nothing."""
    got = {r["doc_id"]: r for r in collected(spark, small, "op1_quality_classifier")}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert set(got) == set(rows) and all(r["held_out"] == (remainder(k, 3) == 1) and r["predicted"] == (r["score"] >= 0.5) for k, r in got.items())
    held = [k for k in labels if k in got and got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == labels[k] for k in held]) >= 0.85
    docs, marks = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    changed = "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN {} ELSE {} END AS {}"
    docs.selectExpr("doc_id", changed.format("reverse(text)", "text", "text")).write.parquet(f"{tmp_path}/documents.parquet")
    marks.selectExpr("doc_id", changed.format("1 - quality", "quality", "quality")).write.parquet(f"{tmp_path}/labels.parquet")
    again = {r["doc_id"]: r for r in collected(spark, str(tmp_path), "op1_quality_classifier")}
    assert all(again[k]["score"] == r["score"] for k, r in got.items() if not r["held_out"])


def test_op2(spark, small, rows):
    got = {r["doc_id"]: r for r in collected(spark, small, "op2_lm_scoring")}
    training = [t for k, t in rows.items() if remainder(k, 7) != 2]
    counts = Counter(w for t in training for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(rows)
    for k, t in rows.items():
        tokens, r = [*words(t), None], got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(k, 7) == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
    seen = brute_counts(training, 5)
    for k in sorted(rows, key=lambda k: (len(rows[k]) > 3000, k % 7, k))[:25]:
        assert math.isclose(got[k]["score"], probability(seen, rows[k], 5), rel_tol=1e-9, abs_tol=1e-9)


def test_op4(spark, small, rows):
    got = {r["doc_id"]: r for r in collected(spark, small, "op4_near_duplicates")}
    items = sorted(rows.items())
    want = {}
    for group in brute_classes(items).values():
        ids = [items[k][0] for k in group]
        want |= {i: (min(ids), len(ids)) for i in ids}
    assert {k: (r["class_id"], r["class_docs"]) for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["kept"]} == {c for c, _ in want.values()} and any(n > 1 for _, n in want.values())


def test_op6(spark, small, rows):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: (len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for k, t in rows.items()}
    got = collected(spark, small, "op6_token_counts")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def brute_leak(doc, item):
    """(equal, word) of the best window of an item (arrays of words), or None."""
    n = len(item)
    window = min(15, n)
    allowed = 3 if n >= 15 else 2 if n >= 12 else 1 if n >= 9 else 0
    best = None
    for p in range(n - window + 1):
        for at in range(len(doc) - window + 1):
            equal = int((doc[at : at + window] == item[p : p + window]).sum())
            if equal >= window - allowed and (best is None or (-equal, at) < best):
                best = (-equal, at)
    return best


def test_op8(spark, small, rows):
    import re

    number = defaultdict(lambda: len(number))
    split = lambda s: np.array([number[w] for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", s.lower())], np.int64)
    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): (r["n_equal"], r["word"]) for r in collected(spark, small, "op8_decontamination")}
    want = {}
    for k, t in rows.items():
        doc = split(t)
        for i, item in items.items():
            # a window with a leak has half of its words in common with the document at least
            if len(np.intersect1d(doc, item)) >= min(15, len(item)) // 2 and (found := brute_leak(doc, item) if len(doc) < 6000 else (None if (k, i) not in got else (-got[k, i][0], got[k, i][1]))):
                want[k, i] = (-found[0], found[1])
    assert got == want and want


def test_op9(spark, small, rows):
    length, data = 400, {k: t.encode() for k, t in rows.items()}
    digest = lambda s, i: hashlib.blake2b(s[i : i + length], digest_size=16).digest()
    seen = Counter(digest(s, i) for s in data.values() for i in range(len(s) - length + 1))
    got = {r["doc_id"]: r for r in collected(spark, small, "op9_suffix_dedup")}
    assert set(got) == set(rows)
    for k, s in data.items():
        gone = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if seen[digest(s, i)] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(s, gone) if not x)
        spans = sum(1 for i in range(len(s)) if gone[i] and (i == 0 or not gone[i - 1]))
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert r["text"] == kept.decode(errors="replace")


def test_op9_finds_passages_of_over_50_words(spark, tmp_path):
    """Passages of 51 short words are under the contract's 400 bytes: its columns leave them, passages_text doesn't have them."""
    rng = np.random.default_rng(9)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefghé"), 4)) for _ in range(n))
    passages = [some(51), some(51)]
    texts = [f"{some(60)} {passages[k % 2]} {some(60)}" for k in range(6)] + [some(120) for _ in range(6)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for r in collected(spark, str(tmp_path), "op9_suffix_dedup"):
        text = texts[r["doc_id"]]
        assert (r["n_removed"], r["text"]) == (0, text)
        passage = passages[r["doc_id"] % 2] if r["doc_id"] < 6 else None
        assert (passage is None and r["passages_text"] == text) or (passage and passage in text and not any(w in r["passages_text"] for w in passage.split()[1:-1:10]) and r["passages_removed"] >= len(passage.encode()))


def test_op10(spark, small, rows):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in collected(spark, small, "op10_best_fit_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(rows)
    total = 0
    for k, parts in pieces.items():
        ids, at = own.encode(rows[k], add_special_tokens=False).ids + [0], 0
        for n, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())) == (n, at, r["ids_crc32"]) and (n == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids) and len(parts) == -(-len(ids) // 2048)
        total += at
    for slots in sequences.values():
        slots.sort()
        assert [s[0] for s in slots] == [0, *np.cumsum([s[1] for s in slots])[:-1]] and sum(s[1] for s in slots) <= 2048
    assert len(sequences) <= 1 + 1.03 * total / 2048


def test_ids_of_whole_documents_are_the_librarys(spark):
    """The faster encoding against the library, over a larger table."""
    from hushframe.llm import pretokens

    byte = pretokens.worker(pretokens.ByteIds, public_tokenizers.path("byte_bpe_50k.json"))
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert byte.ids(r["text"] or "") == byte.whole(r["text"] or "")
