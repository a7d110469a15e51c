import math
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from hushframe.llm import lm_scoring, quality
from hushframe.llm.common import U64, Tokens, byte_map, SPACE, flat
from tests_llm_words import words
import pyarrow as pa


def stream(text):
    return (b" ".join(w.encode() for w in words(text)) + b"\n").replace(b"\x00", b"\xff")


def brute_counts(training, order):
    seen = {}
    for t in training:
        s = b"\n" * order + stream(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen.setdefault(s[i - k : i], Counter())[s[i]] += 1
    return seen


def brute_probability(training, text, order):
    return probability(brute_counts(training, order), text, order)


def probability(seen, text, order):
    """Prediction by partial matching by definition, with sets of excluded symbols."""
    total = 0.0
    s = b"\n" * order + stream(text)
    for i in range(order, len(s)):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            context = seen.get(s[i - k : i])
            if not context:
                continue
            left = {c: n for c, n in context.items() if c not in excluded}
            size = sum(left.values())
            if s[i] in left:
                p *= (2 * left[s[i]] - 1) / (2 * size)
                break
            if size:
                p *= len(left) / (2 * size)
            excluded |= set(context)
        else:
            p *= 1 / (256 - len(seen.get(b"", ())))
        total += math.log10(p)
    return total


def test_scores_are_those_of_the_definition(spark, make):
    training = ["the cat sat on the mat", "The dog  sat", "", None, "a cat and a dog", "é ñ é ñ"]
    asked = ["the cat", "unknown words here", "", None, "dog dog dog \x00", "É é"]
    docs, held = make(spark, training).select("text"), make(spark, asked)
    got = {r["doc_id"]: r for r in lm_scoring.score(held, docs, order=3).collect()}
    counts = Counter(w for t in training for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for k, t in enumerate(asked):
        tokens = [*words(t), None]
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), abs_tol=1e-9)
        assert math.isclose(r["score"], brute_probability(training, t, 3), abs_tol=1e-6), t


def test_rare_words_are_joined(spark, make, texts):
    docs = make(spark, texts)
    wide = {r["doc_id"]: r for r in lm_scoring.score(docs, docs.select("text")).collect()}
    few = {r["doc_id"]: r for r in lm_scoring.score(docs, docs.select("text"), words=8).collect()}
    assert len(wide) == len(few) == len(texts)
    for k, r in wide.items():
        assert r["n_known"] == few[k]["n_known"] == r["n_tokens"] and math.isclose(r["base_score"], few[k]["base_score"], rel_tol=1e-9)


def test_scores_are_of_all_ngrams(spark, make, texts):
    training = [t for t in texts[:40] if t]
    asked = ["the abé", "unknown WORDS here", "", None, *texts[40:50], *texts[40:44], texts[-3]]
    docs, held = make(spark, training).select("text"), make(spark, asked)
    for order, nodes in ((5, 400), (5, 0), (1, 20)):
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score(held, docs, order=order, nodes=nodes).collect()}
        assert len(got) == len(asked) and all(got[k + 4] == got[k + 14] for k in range(4))
        assert all(math.isclose(got[k], brute_probability(training, t, order), rel_tol=1e-9) for k, t in enumerate(asked[:8]))


def test_a_trie_sums_to_one(spark, make):
    from hushframe.llm.lm_scoring import Trie, grams

    data, offsets = flat(pa.array(["abracadabra abra", "bar"]))
    keys = grams(Tokens(data, offsets, byte_map(SPACE)), 2)[0]
    length, key, n = [], [], []
    for m in (1, 2, 3):
        u, c = np.unique(keys & U64((1 << 8 * m) - 1), return_counts=True)
        length.append(np.full(len(u), m)), key.append(u), n.append(c)
    trie = Trie(np.concatenate(length), np.concatenate(key), np.concatenate(n), 2)
    for context in (b"ab", b"ra", b"zz", b"\n\n"):
        every = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.uint64)
        assert math.isclose((10 ** trie.log10(every)).sum(), 1, rel_tol=1e-9)


def test_no_training(spark, make, empty):
    rows = lm_scoring.score(make(spark, ["ab", None]), empty.select("text")).orderBy("doc_id").collect()
    assert [round(r["score"] / -math.log10(256)) for r in rows] == [3, 1] and rows[0]["n_known"] == 0
    assert lm_scoring.score(empty, make(spark, ["ab"]).select("text")).count() == 0


def labelled(spark, make):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["river", "stone", "quiet", "morning", "walked", "slowly", "under", "bridge"], 60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["$$$", "###", "BUY!!", "|", "FREE!!"], 60)) for _ in range(60)]
    docs = make(spark, good + bad)
    return docs.withColumn("quality", F.when(F.col("doc_id") < 60, 1).otherwise(0)), docs


def test_held_out_accuracy(spark, make, clashing):
    rows, docs = labelled(spark, make)
    model = quality.train(rows.drop("quality").filter("doc_id % 3 <> 1"), rows.select("doc_id", "quality"))
    got = quality.score(clashing(docs).withColumn("predicted", F.lit("mine")), model).filter("doc_id % 3 = 1").collect()
    assert np.mean([r["predicted"] == (r["doc_id"] < 60) for r in got]) == 1 and all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts(spark, make, texts, empty):
    rows = labelled(spark, make)[0]
    model = quality.train(rows, rows)
    got = {r["doc_id"]: r for r in quality.score(make(spark, texts), model).collect()}
    assert len(got) == len(texts)
    by_text = {}
    for k, t in enumerate(texts):
        assert by_text.setdefault(t or "", got[k]["score"]) == got[k]["score"]
    assert quality.score(empty, model).count() == 0


def test_one_class_gives_its_share(spark, make):
    rows, docs = labelled(spark, make)
    model = quality.train(docs, rows.filter("quality = 1"))
    assert {round(r["score"], 6) for r in quality.score(docs, model).collect()} == {round(61 / 62, 6)}
    none = quality.train(docs, rows.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_the_model_depends_on_the_rows_alone(spark, make):
    """Repeated ids, ids with both labels, null ids, and any partitioning."""
    rows, docs = labelled(spark, make)
    more = spark.createDataFrame([(0, "other text"), (0, "other text"), (7, None), (None, "nobody's"), (500, "unlabelled")], "doc_id long, text string")
    own = docs.select("doc_id", "text").unionByName(more)
    labels = rows.select("doc_id", "quality").unionByName(spark.createDataFrame([(3, 0), (70, 1), (None, 1), (900, 0), (5, None)], "doc_id long, quality int"))
    models = [quality.train(own.repartition(k), labels.repartition(k)) for k in (1, 3, 5)]
    assert len({(m.good, m.bad, m.slope, m.intercept) for m in models}) == 1
    ids = {r["id"]: r["y"] for r in quality.labelled_ids(own, labels, "doc_id", "quality").collect()}
    assert ids == {k: int(k < 60) for k in range(120) if k not in (3, 70)}


def test_scores_are_those_of_independent_sizes(spark, make, texts):
    rows, docs = labelled(spark, make)
    model = quality.train(docs, rows)
    got = {r["doc_id"]: r["score"] for r in quality.score(make(spark, texts[:60]), model).collect()}
    size = lambda content, part: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False).compress(part))
    for k, t in enumerate(texts[:60]):
        raw = (t or "").encode()
        parts = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
        g, b = sum(size(model.good, p) for p in parts), sum(size(model.bad, p) for p in parts)
        x = (b - g) / (b + g) if parts else 0.0
        assert math.isclose(got[k], 1 / (1 + math.exp(-(model.slope * x + model.intercept))), rel_tol=1e-9)


def test_logistic_regression_by_plain_descent():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.7).astype(float)
    x, weight = rng.normal(y, 1), np.where(y > 0, 1.6, 0.4)
    w = np.zeros(2)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        w -= 0.005 * (np.array([(weight * (p - y) * x).sum(), (weight * (p - y)).sum()]) + 1e-3 * w)
    assert np.allclose(quality.logistic(x, y, weight), w, atol=1e-4)
