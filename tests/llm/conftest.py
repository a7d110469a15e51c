import random
import re

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def words(text):
    return [lowered(w) for w in re.findall("[^\x20\x09-\x0D]+", text or "")]


@pytest.fixture(scope="session")
def make():
    """Documents of texts, with ids from 0 on or given, in several partitions."""

    def made(spark, texts, ids=None):
        rows = [(i, t, "en", "s", None) for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return made


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empties, copies, near copies, a very long one and odd characters."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéñü", k=rng.randint(1, 6))) for _ in range(300)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [some(rng.randint(1, 120)) for _ in range(40)]
    near = []
    for t in base[:10]:
        w = t.split()
        w[rng.randrange(len(w))] = "zzz"
        near.append(" ".join(w))
    odd = [None, "", "   \n\t ", "x", "a b", "THE THE THE " * 40, "\x00\x01 nul", "😀 İ ß <|endoftext|> 　 end", "word " * 30_000, some(20_000)]
    return [*base, *base[:5], *near, *odd, None, ""]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing():
    """Columns with the names that operators use themselves."""

    def added(df):
        names = "score predicted n_tokens n_bytes over_limit kept leaks n_removed n_spans host path rule verdict th label bucket sketch row length rank salt id key kind"
        return df.withColumns({n: F.lit("mine") for n in names.split() if n not in df.columns})

    return added
