"""Spans of personal data in text: regular expressions, plausibility, greedy choice. Column expressions only; no matched text leaves.

Positions are code points. A null text has no spans; a text of any length is searched whole.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of what counts as an e-mail address, a phone number, a date and a decimal number
EMAIL = r"(?iU)(?<![\w.+-])[a-z0-9.!#$%&'*+/=?^_`{|}~-]+\s*@\s*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\s*\.\s*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+"
PHONE = r"(?U)(?<!\w)\+?\d[\d\s().-]*\d(?!\w)"
DATE = r"(?U)^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"
DECIMAL = r"(?U)^\d+\.\d{1,2}$"
SPAN = "array<struct<start:int,end:int,category:string,source:string,confidence:double>>"


@dataclass(frozen=True)
class Pattern:
    """A configured pattern, matched whatever the case."""

    category: str
    regex: str
    confidence: float = 0.9
    source: str = "configured"

    def __post_init__(self) -> None:
        if self.category not in ("government_id", "payment_identifier"):
            raise ValueError(f"no category for configured patterns: {self.category}")


@dataclass(frozen=True)
class Config:
    """What is searched for; digits are those of a phone number."""

    email: bool = True
    phone: bool = True
    email_confidence: float = 0.99
    phone_confidence: float = 0.95
    least_digits: int = 8
    most_digits: int = 15
    patterns: tuple[Pattern, ...] = ()


def matches(text: Column, regex: str) -> Column:
    """All matches as an array of (start, end, value): what lies between them adds up to where they are."""
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    sized = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), m.alias("value")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.length(m["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value")))).alias("out"))

    return F.aggregate(sized, none, step, lambda acc: acc["out"])


def plausible_phone(value: Column, least: int = 8, most: int = 15) -> Column:
    digits = F.length(F.regexp_replace(value, r"(?U)\D", ""))
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return digits.between(least, most) & ~trimmed.rlike(DATE) & ~(trimmed.rlike(DECIMAL) & ~trimmed.startswith("+"))


def _as_spans(found: Column, category: str, source: str, confidence: float) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(category).alias("category"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))


def candidates(text: Column, config: Config = Config()) -> Column:
    """All matches of everything that config asks for, as spans."""
    parts = [F.array().cast(SPAN)]
    if config.email:
        has = F.when(text.contains("@"), matches(text, EMAIL)).otherwise(F.array())
        parts.append(_as_spans(has, "email", "text-email-regex", config.email_confidence))
    if config.phone:
        found = F.filter(matches(text, PHONE), lambda m: plausible_phone(m["value"], config.least_digits, config.most_digits))
        parts.append(_as_spans(found, "phone_number", "text-phone-regex", config.phone_confidence))
    parts += [_as_spans(matches(text, f"(?iU){p.regex}"), p.category, p.source, p.confidence) for p in config.patterns]
    return F.concat(*parts)


def choose(spans: Column) -> Column:
    """Greedy choice by start, length (longest first), category and source: what overlaps no chosen span is chosen.

    Chosen spans don't overlap and come in order, so only the last one can overlap the next.
    """
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("minus"), s["category"].alias("category"), s["source"].alias("source"), s["confidence"].alias("confidence"), s["end"].alias("end"))))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]), acc).otherwise(F.concat(acc, F.array(F.struct(s["start"], s["end"], s["category"], s["source"], s["confidence"]).cast(SPAN[6:-1]))))
    return F.aggregate(keyed, F.array().cast(SPAN), step)


def spans(text: Column, config: Config = Config()) -> Column:
    """The recognised spans of a text, in order."""
    return choose(candidates(F.coalesce(text, F.lit("")), config))


def recognise(rows: DataFrame, text: str, config: Config = Config(), contextual: Column | None = None, available: Column | None = None) -> DataFrame:
    """rows with spans (null unless ok) and status: ok, error or unavailable.

    contextual: spans of another recogniser, null where it failed; a null, or a span beyond the text, is an error and never an
    empty success. available: whether that recogniser is there at all; without it, it is.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    if contextual is None:
        return rows.withColumns({"spans": spans(own, config), "status": F.lit("ok")})
    bad = contextual.isNull() | F.exists(contextual, lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length(own)))
    status = F.when(F.coalesce(~available, F.lit(True)) if available is not None else F.lit(False), "unavailable").when(F.coalesce(bad, F.lit(True)), "error").otherwise("ok")
    return rows.withColumn("status", status).withColumn("spans", F.when(F.col("status") == "ok", choose(F.concat(candidates(own, config), contextual.cast(SPAN)))))


def normalise_ocr_ascii(text: Column) -> Column:
    """Normal form of recognised text that is ASCII: lower case, single spaces, no outer spaces, bars and tildes."""
    return F.btrim(F.btrim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(" |~"))


def normalise_ocr(text: Column) -> Column:
    """The same for any text, with compatibility forms (NFKC) and case folding, which need Python; ASCII text stays in the JVM."""

    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            return None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().replace("…", "...").split()).strip(" |~")

        return values.map(one)

    return F.when(text.rlike(r"^\p{ASCII}*$"), normalise_ocr_ascii(text)).otherwise(folded(text))


def classify_ocr(rows: DataFrame, text: str, config: Config = Config()) -> DataFrame:
    """rows with form and spans: recognised text's normal form, and the spans of that."""
    return rows.withColumn("form", normalise_ocr(F.coalesce(F.col(text), F.lit("")))).withColumn("spans", spans(F.col("form"), config))


def redact(text: Column, found: Column, mark: str = "█") -> Column:
    """text with each span's characters replaced by as many marks."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.repeat(F.lit(mark), s["end"] - s["start"])).alias("out"))
    return F.aggregate(found, none, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
