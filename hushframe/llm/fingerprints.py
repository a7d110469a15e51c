"""Operator 5, document fingerprints: I-Match with randomised lexicons. DataFrame functions only.

The lexicon is the terms within a band of inverse document frequency. Each of COMPONENTS subsets of it gives one hash: of the distinct
terms that the text has in common with the subset, sorted (terms stand as 60 bits of their MD5, and are sorted as such). Besides the whole
band there are SETS families of three random subsets, 1/4, 1/16 and 1/64 of it, each within the one before it, so that the share
of equal hashes falls gradually with the share of changed terms. A subset that a text has no term of gives no hash. A text
without any term of the lexicon is hashed in the same way over all its own terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import cut

#: The band: terms in at least 1 of RAREST and at most 1 of COMMONEST documents (and in two at least). The upper bound is above the
#: share of any one group of copies (a third), so that what such a group has in common stays in the lexicon.
RAREST, COMMONEST = 2048, 2
#: Families of subsets: a term is in those of family k whose bits of its hash, from bit 6k on, are 0: two bits, four, and six.
SETS = 10
COMPONENTS = 1 + 3 * SETS
#: Hex digits of a subset's hash, and of a term's.
DIGITS, TERM_DIGITS = 16, 15
NONE = "-" * DIGITS
#: Documents in a block at least, and blocks at most: they bound the driver's share, and decide nothing but which task does what.
BLOCK, BLOCKS = 512, 1 << 15
#: Documents looked at for each block's bounds.
LOOKED_AT = 8
#: Most terms of a broadcast lexicon (some 40 MB); a larger one is joined by shuffle.
BROADCAST_TERMS = 500_000
SPACE = "[ \\t\\n\\x0b\\f\\r]+"


def terms(text: Column) -> Column:
    """Distinct words, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SPACE, -1), lambda t: t != ""))


def term_hash(term: Column) -> Column:
    """60 bits of the term's MD5."""
    return F.conv(F.substring(F.md5(term), 1, TERM_DIGITS), 16, 10).cast("long")


def lexicon(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(term, hash) of the terms within the band, over all n documents."""
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = (F.col("df") >= 2) & (F.col("df") * RAREST >= n) & (F.col("df") * COMMONEST <= n)
    return counts.filter(band).select("term", term_hash(F.col("term")).alias("hash"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used: a lambda over an array of one."""
    return F.transform(F.array(value), use)[0]


def fingerprint(found: Column, own: Column) -> Column:
    """The subsets' hashes in a row: of found, an array of the hashes of the text's terms in the lexicon, or, if it is empty, of all its
    terms; of a text without terms, x and the text's digest, so that only equal texts agree."""
    members = F.array_sort(F.when(F.size(found) > 0, found).otherwise(F.transform(terms(own), term_hash)))
    print_ = lambda x: F.when(F.size(x) == 0, NONE).otherwise(F.substring(F.md5(x.cast("string")), 1, DIGITS))

    def without(members: Column, bits: int) -> Column:
        mask = F.lit(bits)
        return F.filter(members, lambda x: x.bitwiseAND(mask) == 0)

    def family(members: Column, k: int) -> Column:
        smaller = lambda q: F.concat(print_(q), bound(without(q, 0b1100 << 6 * k), lambda s: F.concat(print_(s), print_(without(s, 0b110000 << 6 * k)))))
        return bound(without(members, 0b11 << 6 * k), smaller)

    every = lambda x: F.concat(print_(x), *[family(x, k) for k in range(SETS)])
    return F.when(F.size(members) > 0, bound(members, every)).otherwise(F.concat(F.lit("x"), F.md5(own)))


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes over components that either has; 1 for equal fingerprints."""
    places = F.sequence(F.lit(0), F.lit(COMPONENTS - 1))
    part = lambda s, k: F.substr(s, k * DIGITS + 1, F.lit(DIGITS))
    same = F.size(F.filter(places, lambda k: (part(a, k) == part(b, k)) & (part(a, k) != NONE)))
    either = F.size(F.filter(places, lambda k: (part(a, k) != NONE) | (part(b, k) != NONE)))
    share = same / F.greatest(either, F.lit(1))
    return F.when(a == b, F.lit(1.0)).when(a.startswith("x") | b.startswith("x"), F.lit(0.0)).otherwise(share)


def edited(text: Column, next_text: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of next_text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(next_text, F.lit(1), half))


def placed(docs: DataFrame, n: int) -> DataFrame:
    """docs (id, text, digest) with block: a number that rises as rows come later in descending order of (id, digest), null ids last.

    Bounds are quantiles of a sample, LOOKED_AT rows for each of BLOCKS blocks at most; rows find theirs by binary search.
    """
    key = F.struct(F.col("id").isNotNull().alias("has"), F.col("id"), F.col("digest"))
    blocks = min(BLOCKS, max(1, n // BLOCK))
    looked = docs.select(key.alias("key")).filter(F.pmod(F.xxhash64("key"), F.lit(max(1, n // (LOOKED_AT * blocks)))) == 0) if blocks > 1 else docs.limit(0).select(key.alias("key"))
    dealt = looked.groupBy().agg(F.array_sort(F.collect_set("key")).alias("keys"))
    size, many = F.size("keys"), F.least(F.lit(blocks), F.size("keys"))
    bounds = cut(dealt.select(F.when(many > 0, F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda k: F.element_at("keys", (k * size / many).cast("int") + 1))).otherwise(F.slice("keys", 1, 0)).alias("bounds")), "bounds")
    steps = F.array(*[F.lit(1 << k) for k in range(BLOCKS.bit_length(), -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("bounds")) & (F.try_element_at("bounds", at + step) <= key), at + step).otherwise(at))
    return docs.crossJoin(F.broadcast(bounds)).withColumn("block", F.lit(blocks) - below).drop("bounds")  # bounds is one row


def fingerprint_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    Rows stand in descending order of id (null last; equal ids by the text's MD5, descending), the last one followed by the first. Ids
    are of any type that has an order. A null text is an empty one. Rows are cut into blocks of neighbours by quantiles; a text is
    shuffled once, by block, and its terms are put together again within the same tasks. The first row of each block also stands
    behind the block before it. A single row is its own next one.
    """
    docs = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    n = docs.count()
    words = cut(lexicon(docs, "text", n), "lexicon")
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    rows = placed(docs, n)
    heads = rows.groupBy("block").agg(F.max_by(F.struct("id", "text", "digest"), F.struct(F.col("id").isNotNull(), "id", "digest")).alias("head"))
    heads = cut(heads, "block-heads")
    # at most BLOCKS + 1 numbers
    before = heads.select("block", F.coalesce(F.lag("block").over(Window.orderBy("block")), F.max("block").over(Window.partitionBy())).alias("of"))
    behind = heads.join(F.broadcast(before), "block").select("head.id", "head.text", "head.digest", F.col("of").alias("block"), F.lit(True).alias("behind"))
    every = rows.select("id", "text", "digest", "block", F.lit(False).alias("behind")).union(behind)
    order = Window.partitionBy("block").orderBy("behind", F.desc_nulls_last("id"), F.desc("digest"))
    every = every.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)})
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("own")), F.struct(F.lit(1).alias("side"), F.when(~F.col("behind"), edited(F.col("text"), F.col("next_text"))).alias("own")))
    sided = every.select("block", "place", "behind", "id", F.explode(sides).alias("s")).select("block", "place", "behind", "id", "s.side", "s.own").filter("own is not null")
    # an empty term stands for the text itself, so that one without terms of the lexicon keeps its row, and carries it
    each = sided.select("block", "place", "side", "behind", "id", F.explode(F.array_append(F.transform(terms(F.col("own")), lambda t: F.struct(t.alias("term"), F.lit(None).cast("string").alias("own"))), F.struct(F.lit("").alias("term"), F.col("own").alias("own")))).alias("t"))
    each = each.select("block", "place", "side", "behind", "id", "t.term", "t.own").join(words, "term", "left").filter("hash is not null or term = ''")
    found = F.collect_list("hash").alias("found")
    printed = each.groupBy("block", "place", "side").agg(found, F.max("own").alias("own"), F.first("behind").alias("behind"), F.first("id").alias("id")).withColumn("print", fingerprint(F.col("found"), F.col("own")))
    printed = printed.select("block", "place", "behind", "id", "side", "print", F.when(F.col("side") == 1, F.sha2("own", 256)).alias("sha"), F.length("own").cast("long").alias("chars"))
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = printed.groupBy("block", "place").agg(F.first("id").alias("id"), F.first("behind").alias("behind"), of("chars", 0).alias("n_chars"), of("sha", 1).alias("edited_sha256"), of("print", 0).alias("fingerprint"), of("print", 1).alias("edited_fingerprint"))
    wide = wide.withColumn("after", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("place"))).filter("not behind")
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("after"))}
    return wide.withColumns(near).select(F.col("id").alias(doc_id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
