"""Half-open intervals on a source timeline: joins by overlap, padding and merging, expiry, as-of look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, key: str, *, bucket: int, left_span: tuple[str, str], right_span: tuple[str, str], keep: list[str] | None = None) -> DataFrame:
    """Pairs of left and right rows of one key whose intervals overlap; both sides' columns but for the key must differ.

    An interval's level says by how many doublings of `bucket` time units a bucket is as long as the interval, so that it touches two
    buckets of its level at most, however long it is. The longer one of a pair lies in the buckets of its level, the other one looks
    there: equi-joins, in which a pair counts in the first bucket that both touch, so no pair comes twice. Levels are few (64 at
    most), and found first. An interval without length overlaps nothing. With keep, the columns that tell left rows apart, left rows
    without a pair stay.
    """
    sides = []
    for df, (begin, end) in ((left, left_span), (right, right_span)):
        level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(begin)) / F.lit(bucket))).cast("int"))
        own = df.filter(F.col(end) > F.col(begin)).withColumn("__level", level)
        sides.append((own, begin, end, sorted(r[0] for r in own.select("__level").distinct().collect())))
    (a, ls, le, left_levels), (b, rs, re, right_levels) = sides
    size = (F.lit(bucket) * F.pow(F.lit(2.0), F.col("__at"))).cast("long")
    touched = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / size), F.floor((F.col(e) - 1) / size)))

    def lying(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("__at", F.col("__level")).withColumn("__bucket", touched(s, e)).drop("__level")

    def looking(df: DataFrame, s: str, e: str, levels: list[int], equal: bool) -> DataFrame:
        at = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("__level") if equal else x > F.col("__level"))
        return df.withColumn("__at", F.explode(at)).withColumn("__bucket", touched(s, e)).drop("__level")

    first = F.greatest(F.floor(F.col(ls) / size), F.floor(F.col(rs) / size))
    meet = lambda x, y: x.join(y, [key, "__at", "__bucket"]).filter((F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re)) & (F.col("__bucket") == first)).drop("__at", "__bucket")
    pairs = a.drop("__level").join(b.drop("__level").limit(0), key)
    if right_levels:
        pairs = meet(looking(a, ls, le, right_levels, True), lying(b, rs, re))
        if any(x > right_levels[0] for x in left_levels):
            pairs = pairs.unionByName(meet(lying(a, ls, le), looking(b, rs, re, left_levels, False)))
    if keep is None:
        return pairs
    found = pairs.select(*keep, *[c for c in right.columns if c != key])
    return left.join(found, keep, "left")


def fold_reasons(reasons: Column) -> Column:
    """Reasons in order, joined by commas: a reason is left out if it is empty or equals all that was joined before."""
    step = lambda a, r: F.when((r == "") | (a == r), a).when(a == "", r).otherwise(F.concat(a, F.lit(", "), r))
    return F.aggregate(reasons, F.lit(""), step)


def merge(intervals: DataFrame, key: str, *, padding: int = 250, gap: int = 100, begin: Column | None = None, finish: Column | None = None) -> DataFrame:
    """(key, start_ms, end_ms, confidence, detector, reason, n): intervals padded, clamped to [begin, finish) and merged.

    Rows have start_ms, end_ms, confidence, detector, reason and event_id (which breaks ties). A row joins the one before it if it
    starts at most `gap` after the latest end so far. The first row gives start and detector, the largest confidence counts. What
    is empty after clamping goes.
    """
    start, end = F.col("start_ms") - padding, F.col("end_ms") + padding
    start = start if begin is None else F.greatest(start, begin)
    end = end if finish is None else F.least(end, finish)
    rows = intervals.withColumns({"start_ms": start, "end_ms": end}).filter("end_ms > start_ms")
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms", "event_id")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("__new", F.when(before.isNull() | (F.col("start_ms") > before + gap), 1).otherwise(0))
    island = new.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("start_ms", "end_ms", "event_id", "detector", F.coalesce("reason", F.lit("")).alias("reason"))
    merged = island.groupBy(key, "__island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("confidence").alias("confidence"), F.sort_array(F.collect_list(item)).alias("items"), F.count("*").alias("n"))
    return merged.select(key, "start_ms", "end_ms", "confidence", F.col("items")[0]["detector"].alias("detector"), fold_reasons(F.transform("items", lambda x: x["reason"])).alias("reason"), "n")


def next_at_least(left: DataFrame, right: DataFrame, key: str, need: str, have: str, out: str) -> DataFrame:
    """left with out: the smallest right[have] of the same key that is at least left[need]; null where there is none.

    One sort of both sides together, and no pairs.
    """
    a = left.withColumn("__at", F.col(need)).withColumn("__side", F.lit(0)).withColumn("__have", F.lit(None).cast("long"))
    b = right.select(F.col(key), F.col(have).alias("__at"), F.lit(1).alias("__side"), F.col(have).cast("long").alias("__have"))
    order = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(0, Window.unboundedFollowing)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(out, F.first("__have", ignorenulls=True).over(order)).filter("__side = 0").drop("__at", "__side", "__have")
