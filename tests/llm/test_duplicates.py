import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import common, decontaminate, near_dup, repeats
from hushframe.llm.bagminhash import signatures
from hushframe.llm.common import mix
from hushframe.llm.runindex import RunIndex
from tests_llm_words import words


def test_signatures_are_unbiased_and_don_t_depend_on_the_batch():
    rng = np.random.default_rng(0)
    element, weight, owner, true = [], [], [], []
    for k in range(200):
        own = mix(rng.integers(1, 2**63, 50).astype(np.uint64))
        a = rng.integers(0, 7, 50)
        b = np.where(rng.random(50) < 0.7, a, rng.integers(0, 12, 50))
        for side, x in enumerate((a, b)):
            element.append(own[x > 0]), weight.append(x[x > 0]), owner.append(np.full((x > 0).sum(), 2 * k + side))
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    found = signatures(np.concatenate(element), np.concatenate(weight), np.concatenate(owner), 400, 256)
    z = ((found[::2] == found[1::2]).mean(axis=1) - true) / np.sqrt(np.array(true) * (1 - np.array(true)) / 256)
    assert abs(z.mean()) < 0.25 and 0.8 < z.std() < 1.2
    alone = signatures(element[9], weight[9], np.zeros(len(element[9]), int), 1, 256)
    assert (alone[0] == found[9]).all()


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_classes(rows, least=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                same |= both >= least * (sum(bags[i].values()) + sum(bags[j].values()) - both)
            if same:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups


def near_rows():
    rng = random.Random(11)
    out = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            if rng.random() < 0.3:
                base = own  # a chain of copies of copies
            out.append(" ".join(own))
    return out + ["the " * 50, "the " * 55, "the " * 20, None, "", " ", "A B C D E F", "a b c d e f"]


def check_classes(spark, make, rows, ids):
    got = near_dup.classes(make(spark, rows, ids)).collect()
    assert len(got) == len(rows)
    want = {}
    for group in brute_classes(list(zip(ids, rows))).values():
        some = [ids[k] for k in group if ids[k] is not None]
        for k in group:
            want.setdefault(ids[k], []).append((min(some) if some else None, len(group)))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["class_id"], r["class_docs"]))
    key = lambda x: (x[0] is None, x)
    assert {k: sorted(v, key=str) for k, v in have.items()} == {k: sorted(v, key=str) for k, v in want.items()} and key
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(brute_classes(list(zip(ids, rows)))) and all(r["doc_id"] == r["class_id"] for r in kept)


def test_classes(spark, make):
    rows = near_rows()
    check_classes(spark, make, rows, list(range(len(rows))))


def test_classes_with_repeated_and_null_ids(spark, make):
    check_classes(spark, make, ["a b c d e f g"] * 3 + ["q r s t u v", None], [4, 4, None, None, 9])


def test_no_classes(spark, empty):
    assert near_dup.classes(empty).count() == 0


def test_links_outside_the_largest_component_are_found(spark, make, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    rows = near_rows()
    check_classes(spark, make, rows, list(range(len(rows))))


def brute_repeats(rows, length):
    seen = Counter(s[i : i + length] for s in rows for i in range(len(s) - length + 1))
    out = []
    for s in rows:
        gone = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(s, gone) if not x)
        out.append((len(s), sum(gone), sum(1 for i in range(len(s)) if gone[i] and (i == 0 or not gone[i - 1])), kept))
    return out


@pytest.mark.parametrize("length", [64, 67, 133])
def test_repeats(spark, make, clashing, length):
    rng = random.Random(length)
    base = ["".join(rng.choices("abcdé ", k=rng.randint(10, 300))) for _ in range(6)]
    rows = ["".join(rng.choice([rng.choice(base), "ab" * rng.randint(0, 150), rng.choice(base)[5:200], "".join(rng.choices("xyz", k=30))]) for _ in range(rng.randint(0, 4))) for _ in range(50)]
    rows += [None, "", rows[0], "q" * 5000]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(clashing(make(spark, rows)), length=length).collect()}
    assert [got[k] for k in range(len(rows))] == brute_repeats([(t or "").encode() for t in rows], length)


@pytest.mark.parametrize("block", [1 << 10, 4 << 20])
def test_hot_anchors_in_parts(spark, make, monkeypatch, block):
    """A line in most documents, between ever other words: its anchors' segments go to several blocks."""
    monkeypatch.setattr(repeats, "BLOCK_SEGMENTS", 4)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(block)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    line, sides = word(150), [word(40) for _ in range(6)]
    rows = [word(rng.randint(0, 90)) + rng.choice(sides) + line[rng.randint(0, 3) :] + rng.choice(sides) + word(rng.randint(0, 90)) for _ in range(80)]
    rows += [rows[0], rows[1], "z" * 300, None]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(make(spark, rows), length=160).collect()}
    want = brute_repeats([(t or "").encode() for t in rows], 160)
    assert [got[k] for k in range(len(rows))] == want and sum(x[1] > 0 for x in want) > 40


def test_repeats_of_two_lengths(spark, make, clashing):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdé ", k=rng.randint(60, 300))) for _ in range(6)]
    rows = ["".join(rng.choice([rng.choice(base), "ab" * rng.randint(0, 99), rng.choice(base)[5:200], "".join(rng.choices("xyz", k=30))]) for _ in range(rng.randint(0, 4))) for _ in range(50)]
    rows += [None, "", rows[0], "q" * 5000]
    found = repeats.remove_repeats(clashing(make(spark, rows)), length=133, passages=70).collect()
    data = [(t or "").encode() for t in rows]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sorted(found, key=lambda r: r["doc_id"])] == brute_repeats(data, 133)
    short = brute_repeats(data, 70)
    assert [(r["passages_removed"], bytes(r["passages_kept"])) for r in sorted(found, key=lambda r: r["doc_id"])] == [(x[1], x[3]) for x in short]
    assert sum(x[1] for x in short) > sum(x[1] for x in brute_repeats(data, 133))
    with pytest.raises(ValueError):
        repeats.remove_repeats(make(spark, rows), length=100, passages=101)


def test_memory_of_a_block():
    """An index's memory is a bounded multiple of its text's, with digests of all windows, too (118 bytes a byte before)."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 420).astype(np.uint8).tobytes() for _ in range(2500)]
    tracemalloc.start()
    runs, digests = repeats.repeated_windows(texts, np.full(len(texts), 100), np.ones(len(texts), np.int64), 200, np.ones(len(texts), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(runs[0]) == 0 and len(digests[0]) == 2500 * 221
    assert peak < 80 * 420 * 2500


def test_digests_don_t_depend_on_the_steps(monkeypatch):
    raw = np.random.default_rng(4).integers(0, 256, 5000).astype(np.uint8)
    at = np.array([0, 1, 700, 701, 3000, 4800 - 64])
    want = repeats.window_digests(raw, at, 64, repeats.BYTE_VALUE)
    monkeypatch.setattr(repeats, "STEP_BYTES", 2)
    assert (repeats.window_digests(raw, at, 64, repeats.BYTE_VALUE) == want).all()
    assert (repeats.eights(raw)[9] == int.from_bytes(raw[9:17].tobytes())) and len(set(want)) == len(want)


def test_ids_of_any_kind(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=500))
    docs = spark.createDataFrame([("a", text, 1), ("b", text, 2), (None, "x", 3)], "doc_id string, text string, __id int")
    got = repeats.remove_repeats(docs)
    assert sorted((r["doc_id"] or "", r["n_removed"]) for r in got.collect()) == [("", 0), ("a", 500), ("b", 500)]


def test_equal_rows_are_repeats_of_each_other(spark, make, empty):
    text = "".join(random.Random(1).choices("abcdefgh ", k=500))
    got = repeats.remove_repeats(make(spark, [text, text, text + "!", "other"], [3, 3, None, 4])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 500, 500, 500]
    assert repeats.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(empty, length=10)


def test_run_index_classes():
    rng = random.Random(2)
    for _ in range(200):
        strings = [[rng.choice([3, 5, 9]) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 6))]
        index = RunIndex(np.array([x for s in strings for x in s], np.uint64), np.array([len(s) for s in strings]))
        assert len(index.heads) <= index.size
        for depth in (1, 2, 4):
            keys = [(tuple(s[j : j + depth]) if j + depth <= len(s) else (k, j, "end")) for k, s in enumerate(strings) for j in range(len(s))]
            many, numbers = Counter(keys), {}
            for key, number in zip(keys, index.classes(depth)):
                assert (number == -1) == (many[key] == 1)
                if number != -1:
                    assert numbers.setdefault(key, number) == number
            assert len(set(numbers.values())) == len(numbers)


def brute_leaks(docs, items):
    import re

    split = lambda s: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (s or "").lower())
    out = set()
    for d, text in docs:
        w = split(text)
        for item, other in items:
            v = split(other)
            n, window = len(v), min(15, len(v))
            asked = window - (3 if n >= 15 else 2 if n >= 12 else 1 if n >= 9 else 0)
            best = None
            for shift in range(-n, len(w)):
                equal = [0 <= shift + p < len(w) and w[shift + p] == v[p] for p in range(n)]
                for p in range(n - window + 1):
                    e = sum(equal[p : p + window])
                    if n and e >= asked and (best is None or (-e, shift + p) < best):
                        best = (-e, shift + p)
            if best:
                out.add((d, item, -best[0], window, best[1]))
    return out


def test_leaks(spark, make, clashing):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "Ab"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([2, 3, 5, 6, 8, 10, 12, 14, 15, 30])))) for k in range(25)]
    rows = []
    for _ in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 20))
        for _ in range(rng.randint(0, 2)):
            v = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = "zz"
            w += v[rng.randint(0, 2) :] + rng.choices(vocabulary, k=rng.randint(0, 5))
        rows.append(", ".join(w))
    rows += [None, "", items[8][1].upper(), "filler " * 20_000 + items[9][1]]
    bench = spark.createDataFrame([*items, items[0], (None, "x " * 20), (99, None), (98, " ., "), (97, "")], "item_id long, text string")
    got = {(r["doc_id"], *x) for r in decontaminate.find_leaks(clashing(make(spark, rows)), bench).collect() for x in r["leaks"]}
    want = brute_leaks(list(enumerate(rows[:-1])), items)
    assert {x for x in got if x[0] < len(rows) - 1} == want and want
    assert len(items[9][1].split()) < 6 or any(x[:2] == (len(rows) - 1, 9) for x in got)


def test_a_small_bitmap_changes_nothing(spark, make, monkeypatch, empty):
    items = spark.createDataFrame([(f"i{k}", " ".join(f"v{k}x{j}" for j in range(20))) for k in range(9)], "item_id string, text string")
    docs = make(spark, [" ".join(f"v{k}x{j}" for j in range(20)) for k in range(9)] * 2)
    monkeypatch.setattr(decontaminate, "BITS", 15)
    assert all([x["item_id"] for x in r["leaks"]] == [f"i{r['doc_id'] % 9}"] for r in decontaminate.find_leaks(docs, items).collect())
    assert decontaminate.find_leaks(docs, items.limit(0)).filter(F.size("leaks") > 0).count() == 0
    assert decontaminate.find_leaks(empty, items).count() == 0


def test_kept_digest_is_of_bytes():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
