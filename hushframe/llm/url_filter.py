"""Operator 3, URL filters: longest matching rule, else the likelihood ratio of two character models. DataFrame functions only.

The rules' own verdicts are the labels: one model learns from accepted, one from rejected URLs (host and path). Each predicts a
character from up to ORDER characters before it, orders interpolated by Witten-Bell: what an order has not seen is shared out as the
next shorter one predicts. The mean log-likelihood difference of a URL's characters is compared with the midpoint between the means
of accepted and rejected URLs that the models haven't learnt from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import cut, join_hot

ORDER = 4
BEFORE, AFTER = "\x02", "\x03"
#: Characters over which the shortest model spreads what it hasn't seen.
ALPHABET = 256.0
#: Most rows of a broadcast n-gram table (some 30 MB); above it the table is joined by shuffle.
BROADCAST_ROWS = 500_000

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or nulls; of equally long ones a blocking rule wins, then the first in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def log_ratios(grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): the natural log ratio of the two models' probabilities of the last character of each (order + 1)-gram.

    grams: (gram, accepted, rejected) with counts; all grams of interest, those without counts too.
    """
    levels = {order + 1: grams.withColumnRenamed("gram", "g")}
    for m in range(order, 0, -1):
        levels[m] = levels[m + 1].groupBy(F.substring("g", 2, m).alias("g")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    found = None
    for m in range(1, order + 2):
        context = F.substring("g", 1, m - 1)
        sums = [F.sum(c).alias(f"all_{c}") for c in ("accepted", "rejected")] + [F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in ("accepted", "rejected")]
        level = levels[m].withColumn("c", context)
        level = level.join(level.groupBy("c").agg(*sums), "c")
        if found is None:
            level = level.withColumns({f"less_{c}": F.lit(1 / ALPHABET) for c in ("accepted", "rejected")})
        else:
            level = level.join(found.select(F.col("g").alias("shorter"), *[F.col(f"p_{c}").alias(f"less_{c}") for c in ("accepted", "rejected")]), F.substring("g", 2, m - 1) == F.col("shorter"))
        p = {}
        for c in ("accepted", "rejected"):
            weight = F.col(f"all_{c}") + F.col(f"kinds_{c}")
            p[f"p_{c}"] = F.when(weight > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"less_{c}")) / weight).otherwise(F.col(f"less_{c}"))
        found = level.select("g", *[x.alias(k) for k, x in p.items()])
    return found.select(F.col("g").alias("gram"), (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def judge(pages: DataFrame, *, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """pages with host, path, rule (of the rule that decides, else null), score and verdict (allow or block).

    Columns of those names are replaced, others stay. score is the calibrated probability of allow by the models, for every row. A
    null URL or one without :// has an empty host and path. Equal hosts and paths are learnt from and judged once; the verdict of a URL
    that many pages share is broadcast to them, so that it is no hot key. Without labels of both kinds the midpoint is 0, and a score of the midpoint is allowed.
    """
    host, path = host_and_path(F.col(url))
    pages = pages.drop("host", "path", "rule", "score", "verdict", "__pages", "__hot").withColumns({"host": host, "path": path})
    rule, ruled = by_rules(F.col("host"), F.col("path"), rules)
    held = F.substring(F.md5(F.concat("host", F.lit("\n"), "path")), 1, 1) < "3"
    sites = pages.groupBy("host", "path").agg(F.count("*").alias("n")).withColumns({"ruled": ruled, "held": held})
    sites = cut(sites.withColumn("site", F.monotonically_increasing_id()), "sites")
    text = F.concat(F.lit(BEFORE * order), "host", "path", F.lit(AFTER))
    places = F.sequence(F.lit(1), F.length(F.concat("host", "path")) + 1)
    each = sites.select("site", "ruled", "held", F.explode(F.transform(places, lambda i: F.substr(text, i, F.lit(order + 1)))).alias("gram"))
    count = lambda v: F.sum(((F.col("ruled") == v) & ~F.col("held")).cast("long"))
    grams = cut(each.groupBy("gram").agg(F.coalesce(count("allow"), F.lit(0)).alias("accepted"), F.coalesce(count("block"), F.lit(0)).alias("rejected")), "grams")
    ratios = cut(log_ratios(grams, order), "ratios")
    ratios = F.broadcast(ratios) if ratios.count() <= BROADCAST_ROWS else ratios
    means = each.select("site", "gram").join(ratios, "gram").groupBy("site").agg(F.avg("ratio").alias("x"))
    scored = cut(sites.join(means, "site"), "site-scores")
    check = scored.filter("held and ruled is not null")
    of = lambda v: F.when(F.col("ruled") == v, F.col("x"))
    fit = check.agg(F.avg(of("allow")).alias("a"), F.avg(of("block")).alias("b"), F.var_pop(of("allow")).alias("va"), F.var_pop(of("block")).alias("vb")).first()
    middle, slope = 0.0, 1.0
    if fit["a"] is not None and fit["b"] is not None:
        middle, slope = (fit["a"] + fit["b"]) / 2, max(0.0, fit["a"] - fit["b"]) / max(1e-9, (fit["va"] + fit["vb"]) / 2)
    verdict = F.coalesce("ruled", F.when(F.col("x") >= middle, "allow").otherwise("block"))
    score = 1 / (1 + F.exp(-F.lit(slope) * (F.col("x") - middle)))
    judged = scored.select("host", "path", F.col("n").alias("__pages"), score.alias("score"), verdict.alias("verdict"))
    return join_hot(pages, judged, ["host", "path"], "__pages").drop("__pages").withColumn("rule", rule)
