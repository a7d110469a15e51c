import pytest
from pyspark.sql import functions as F

from hushframe.operators import text_pii as t


def found(spark, text, config=t.Config()):
    row = spark.createDataFrame([(text,)], "text string").select(t.spans(F.col("text"), config).alias("s")).first()
    return [(s["category"], s["start"], s["end"]) for s in row["s"]]


def test_email_and_phone(spark):
    text = "ring (020) 7946-0011 first, then write to lost.keys@harbour.test"
    assert found(spark, text) == [("phone_number", 6, 20), ("email", 42, 64)]


@pytest.mark.parametrize("text", ["ran 12/11/1998 for 98765432.10 at lap 77", "", None, "4785 3805 9239 1139"])
def test_nothing(spark, text):
    assert found(spark, text) == []


def test_addresses_count_as_phone_numbers(spark):
    assert found(spark, "at 192.168.100.200 now") == [("phone_number", 3, 18)]


def test_space_around_dots_extends_an_address(spark):
    assert found(spark, "kite@wind.test. After that") == [("email", 0, 21)]


def test_disabled(spark):
    assert found(spark, "kite@wind.test 020 7946 0011", t.Config(email=False, phone=False)) == []


def test_configured(spark):
    config = t.Config(phone=False, patterns=(t.Pattern("government_id", r"\bQX-[0-9A-F]{6}\b"), t.Pattern("payment_identifier", r"\bcard no\. \d{5}\b")))
    assert found(spark, "Card No. 40213, issued to qx-00af19; qx-00af1 isn't one", config) == [("payment_identifier", 0, 14), ("government_id", 26, 35)]
    with pytest.raises(ValueError):
        t.Pattern("email", "x")


def test_code_points(spark):
    assert found(spark, "😀😀 a@b.co") == [("email", 3, 9)]


def test_a_failed_contextual_recogniser_is_an_error(spark):
    rows = spark.createDataFrame([("a@b.co", None), ("a@b.co", [(0, 99, "email", "c", 0.5)]), ("a@b.co x", [(7, 8, "postal_address", "c", 0.5)])], f"text string, more {t.SPAN}")
    got = t.recognise(rows, "text", contextual=F.col("more")).select("status", "spans").collect()
    assert [(r["status"], r["spans"] and len(r["spans"])) for r in got] == [("error", None), ("error", None), ("ok", 2)]
    assert {r["status"] for r in t.recognise(rows, "text", contextual=F.col("more"), available=F.lit(False)).collect()} == {"unavailable"}


def test_ocr_forms(spark):
    rows = spark.createDataFrame([("  Thé VERT  ",), ("A | B ~",), (None,)], "text string")
    assert [r[0] for r in rows.select(t.normalise_ocr(F.col("text"))).collect()] == ["thé vert", "a | b", None]


def test_redaction(spark):
    rows = spark.createDataFrame([("call 020 7946 0011!",)], "text string")
    assert rows.select(t.redact(F.col("text"), t.spans(F.col("text")), "x")).first()[0] == "call " + "x" * 13 + "!"


def test_a_plus_behind_another_number_belongs_to_its_number(spark):
    # one character lies between the two: the text before a match is looked at, not taken
    assert found(spark, "4111222233334444 +1 (906) 555-7738 on") == [("phone_number", 17, 34)]
    assert found(spark, "12345678/87654321") == [("phone_number", 0, 8), ("phone_number", 9, 17)]


def test_a_number_inside_an_address_is_part_of_it(spark):
    assert found(spark, "hut @ 38.130.206.250 now") == [("email", 0, 20)]


def test_a_plus_is_redacted(spark):
    rows = spark.createDataFrame([("4111222233334444 +1 (906) 555-7738 on",)], "text string")
    assert rows.select(t.redact(F.col("text"), t.spans(F.col("text")), "x")).first()[0] == "4111222233334444 " + "x" * 17 + " on"
