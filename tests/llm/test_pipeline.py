"""The pipeline's stages against plain versions, on planted documents."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_duplicates import brute_classes, brute_leaks

GOOD = [f"{a}{b}" for a in ("ri", "mo", "ste", "wal", "qui") for b in ("ver", "rning", "ne", "ked", "et")]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choices(GOOD, k=n)) + f" {rng.random()} {rng.random()}"
    passage = " ".join(f"shared{k}" for k in range(60))
    items = [(k, " ".join(f"q{k}x{j}" for j in range(20))) for k in range(5)]
    good = [sentence(80) for _ in range(90)]
    texts = good + ["BUY!! $$$ ### | " * 30 + str(k) for k in range(60)]
    texts += [good[0], good[1] + " almost"]  # an exact and a near copy
    texts += [f"{sentence(60)} {passage} {sentence(60)}" for _ in range(3)]
    texts += [f"{sentence(40)} {items[2][1]} {sentence(40)}", f"{sentence(40)} {items[3][1].replace('q3x4 ', 'zz ')} {sentence(40)}"]
    texts += [sentence(3000), good[5] + " é" * 3]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 90), 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(enumerate(texts)), items


def test_stages(spark, planted):
    path, texts, items = planted
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/stage-{k}")
        docs = spark.read.parquet(f"{path}/stage-{k}")
        out[name] = docs
    have = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in list(out.items())[:4]}
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in list(out.values())[:4])

    good = have["quality classifier"]
    assert set(good) == {k for k in texts if not 90 <= k < 150} and all(texts[k] == t for k, t in good.items())

    rows = sorted(good.items())
    assert set(have["near-duplicates"]) == {min(rows[k][0] for k in group) for group in brute_classes(rows).values()}

    length, before = corpus_pipeline.REPEAT_BYTES, {k: t.encode() for k, t in have["near-duplicates"].items()}
    seen = Counter(s[i : i + length] for s in before.values() for i in range(len(s) - length + 1))
    for k, s in before.items():
        gone = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        assert have["suffix-array dedup"][k] == bytes(c for c, x in zip(s, gone) if not x).decode(errors="ignore")
    assert sum("shared30" in t for t in have["near-duplicates"].values()) == 3 and not any("shared30" in t for t in have["suffix-array dedup"].values())
    assert all(r["n_chars"] == len(r["text"]) for r in out["suffix-array dedup"].collect())

    rows = have["suffix-array dedup"]
    assert set(rows) - set(have["benchmark decontamination"]) == {d for d, *_ in brute_leaks([(k, t) for k, t in rows.items() if len(t) < 5000], items)} and len(rows) - len(have["benchmark decontamination"]) == 2

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in have["benchmark decontamination"].items()}
    packed = out["best-fit packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == sizes
    assert out["best-fit packing"].select("sequence_id").distinct().count() <= 1 + 1.05 * sum(sizes.values()) / 2048


def test_near_copies_of_null_and_repeated_ids(spark, make):
    base = [" ".join(f"{a}{k}" for k in range(40)) for a in "abcdef"]
    texts = [base[0], base[1], base[2], base[3], base[4], base[4], base[1], base[5] + " near", base[5], None, ""]
    ids = [None, None, None, 7, 7, 7, None, 3, None, None, 7]
    docs = make(spark, texts, ids).cache()
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    rows = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in got.collect()]
    assert sorted(rows) == sorted([(-1, base[0]), (-1, base[1]), (-1, base[2]), (7, base[3]), (7, base[4]), (3, base[5] + " near"), (7, "")])


def test_empty_tables_and_null_columns(spark, tmp_path):
    """Every stage keeps what there is: no rows, rows of nothing but nulls, repeated rows, and no labels or benchmark."""
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    nulls = [(None,) * 5, (None,) * 5, (3, "some words", None, None, None), (3, "some words", "en", None, None), (3, "other words", None, None, None)]
    for rows, want in (([], 0), (nulls, 3)):
        docs = spark.createDataFrame(rows, kinds["documents"])
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{want}-stage-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{want}-stage-{k}")
        assert docs.count() == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_applies_all_stages(spark, planted):
    path, _, _ = planted
    assert corpus_pipeline.run(spark, path).select("doc_id").distinct().count() > 80
