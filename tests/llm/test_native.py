import json

import pytest
from pyspark.sql import functions as F

from compare import same
from hushframe.llm import chat, fingerprints, queries, sql, url_filter


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_equals_the_other_engine(spark, small, name):
    same(queries.QUERIES[name](spark, small), sql.ORACLE_SQL[name], small)


@pytest.mark.parametrize("name", ["op3_url_filter", "op5_document_fingerprints", "op7_chat_formatting"])
def test_no_python_in_the_plan(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


URLS = [
    ("https://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("http://x.org/en/12", "x.org", "/en/12", "org/"),
    ("http://org", "org", "", None), ("http://b.com/fr/x?q=/de/", "b.com", "/fr/x", "com/fr/"), ("http://telecom/fr/", "telecom", "/fr/", None), ("no url", "", "", None), (None, "", "", None), ("", "", "", None),
    ("a://b://c", "b:", "//c", None), ("http://c.com#/de/", "c.com", "", None), ("http://d.net/en/1\n?x", "d.net", "/en/1\n", None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(k, u[0], "mine") for k, u in enumerate(URLS)] * 2, "page_id long, url string, site string")
    got = url_filter.judge(df).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == URLS[r["page_id"]][1:] and r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1
    assert {r["verdict"] for r in got if r["rule"] in ("example.org/es/", "example.org/en/1")} == {"block"}


def test_urls_without_labels_are_allowed(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(df).collect()] == ["allow"]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_the_models_tell_kinds_of_urls_apart(spark):
    rows = [(k, f"http://h{k % 30}.{'org' if k % 2 else 'com'}/{'' if k % 2 else 'de/'}{'good' if k % 2 else 'spam'}/{k}") for k in range(400)] + [(1000 + k, f"http://q{k}.net/{'good' if k % 2 else 'spam'}/{k}") for k in range(60)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).filter("page_id >= 1000").collect()
    assert sum((r["verdict"] == "allow") == (r["page_id"] % 2 == 1) for r in got) >= 57


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [("user", "hi"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 3}, "conversations", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction with input", [("user", "do\n\nx"), ("assistant", "y")]),
    ({"instruction": "do", "output": "y", "system": "be"}, "instruction", [("system", "be"), ("user", "do"), ("assistant", "y")]),
    ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"unknown": 1}, None, []),
    # fields of other layouts beside a layout's own, null values, and an array whose first element lacks a field
    ({"instruction": "do", "input": "", "output": "y", "text": "whole"}, "instruction with input", [("user", "do\n\n"), ("assistant", "y")]),
    ({"prompt": "p", "messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "b"}]}, "messages", [("user", ""), ("assistant", "b")]),
    ({"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", ""), ("assistant", "b")]),
    ({"question": None, "answer": "a"}, "question", [("user", ""), ("assistant", "a")]),
    ({"turn": 1, "role": "user", "text": "t"}, None, []),
    ([1, 2], None, []),
]


def test_layouts_by_fingerprint(spark):
    rows = [(k, json.dumps(r[0])) for k, r in enumerate(RECORDS)] + [(98, "no json"), (99, None)]
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical(spark.createDataFrame(rows, "id long, record string")).collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert got[k] == (layout, turns), k
    assert got[98] == got[99] == (None, [])


TEXTS = ["", None, "\\", "\\<|im_end|>", "<|im_start|>user<|im_sep|>", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "a\nb", "😀\\\\n", "[INST]\\", "x" * 100_000]


def test_templates_are_reversible(spark):
    rows = [(i, t, role, text, "x") for i in range(3) for t, (role, text) in enumerate([(r, x) for x in TEXTS for r in ("user", "assistant", "<|im_sep|>")])]
    rows += [(7, None, None, None, "x"), (None, 1, "assistant", "z", "x"), (None, 1, "assistant", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chats(chat.rows_to_turns(df, "conv_id"))
    got = chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(got) == 5
    for r in got:
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(text for role, text in want[r["conv_id"]] if role == "assistant")
        inner = r["formatted"].replace(chat.START, "").replace(chat.MIDDLE, "").replace(chat.STOP, "")
        assert not any(c in inner for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_a_table_of_another_layout_is_refused(spark):
    with pytest.raises(ValueError):
        chat.rows_to_turns(spark.createDataFrame([(1, "a")], "conv_id long, text string"), "conv_id")
    assert chat.rows_to_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), "conv_id").count() == 0


def test_fingerprints(spark, make, texts, empty, clashing):
    rows = fingerprints.fingerprint_edits(clashing(make(spark, texts))).collect()
    assert len(rows) == len(texts)
    by_text, order = {}, sorted(rows, key=lambda r: -r["doc_id"])
    for k, r in enumerate(order):
        text, after = texts[r["doc_id"]] or "", texts[order[(k + 1) % len(order)]["doc_id"]] or ""
        assert r["n_chars"] == len(text) and by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        half = len(text) // 2
        import hashlib

        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and (r["near_next"] == 1) == (r["fingerprint"] == order[(k + 1) % len(order)]["fingerprint"])
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_fingerprints_of_repeated_and_null_ids(spark, make):
    got = fingerprints.fingerprint_edits(make(spark, ["a b", "a b", None, "c d"], [5, 5, None, None])).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 5, 5]
    assert fingerprints.fingerprint_edits(make(spark, ["only one"], [3])).first()["near_next"] == 1.0


def plain_fingerprint(text, df, n):
    """By definition: sorted terms of the lexicon (else all), in each component's subset."""
    import hashlib
    import re

    terms = sorted({t for t in re.split("[ \\t\\n\\x0b\\f\\r]+", text.lower()) if t}, key=str.encode)
    inside = [t for t in terms if df.get(t, 0) >= 2 and df[t] * fingerprints.RAREST >= n and df[t] * fingerprints.COMMONEST <= n] or terms
    if not inside:
        return "x" + hashlib.md5(text.encode()).hexdigest()
    hashes, out = sorted(int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in inside), []
    for k in range(fingerprints.COMPONENTS):
        bits = 0 if k == 0 else (3, 15, 63)[(k - 1) % 3] << 6 * ((k - 1) // 3)
        own = [h for h in hashes if h & bits == 0]
        out.append(hashlib.md5(str(own).encode()).hexdigest()[:16] if own else fingerprints.NONE)
    return "".join(out)


@pytest.mark.parametrize("ids", [None, [-(2**62), 2**62 + 5, 2**63 - 1], "strings"])
def test_fingerprints_in_blocks(spark, monkeypatch, ids):
    """Several blocks of neighbours, wide ids, a hot null id, and ids of another type."""
    import hashlib
    import random

    monkeypatch.setattr(fingerprints, "BLOCK", 3)
    rng = random.Random(8)
    texts = [" ".join(rng.choices("alpha beta gamma delta Eps zeta eta theta iota kappa".split(), k=rng.randint(0, 9))) for _ in range(60)]
    own = ids if isinstance(ids, list) else [f"d{k:03}" for k in range(60)] if ids else [*range(40), *[None] * 20]
    texts = texts[: len(own)]
    rows = list(zip(own, texts))
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, f"doc_id {'string' if ids == 'strings' else 'long'}, text string")).collect()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    order = sorted(rows, key=lambda r: md5(r[1]), reverse=True)
    order = sorted([r for r in order if r[0] is not None], key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    df = {}
    for t in texts:
        for w in set(t.lower().split()):
            df[w] = df.get(w, 0) + 1
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        want.append((str(i), hashlib.sha256(changed.encode()).hexdigest(), plain_fingerprint(t, df, len(texts)), plain_fingerprint(changed, df, len(texts))))
    assert sorted(want) == sorted((str(r["doc_id"]), r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got)
