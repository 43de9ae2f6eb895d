"""URL filters: fixed rules, and a character language-model ratio for the rest.

Two variable-order Markov models of characters, one of accepted and one of
rejected URLs, are counted from the URLs that rules decide. A character's
probability mixes contexts of three to no characters (Witten-Bell smoothing); a
URL's score is the difference of the two log-likelihoods divided by its number
of characters. The threshold is calibrated on a fifth of the decided URLs that
the counts leave out: the point as many standard deviations from either class.

All is DataFrame operations. Models, scores and sums are made over distinct URLs
and distinct four-character grams. URLs are numbered, so that a gram's row carries
a number and not the URL, and the work grows in proportion to a URL's length. Null URLs and URLs without `://` have an empty
host and path, fit no rule and are judged as text; equal URLs get equal verdicts.
With no accepted or no rejected URL to learn from, undecided URLs are allowed.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import cut

#: (host, path, verdict), as dealt.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDER = 3
BEGIN, END = "\u0002", "\u0003"
#: Gram tables up to this many rows (about 60 bytes each) go to all executors; beyond, the join is by shuffle.
BROADCAST_GRAMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(url: Column) -> Column:
    """Every character with the ORDER characters before it, the end included."""
    chars = F.split(F.concat(F.lit(BEGIN * ORDER), url, F.lit(END)), "")
    # As a lambda's variable the characters are split off once, not once for every gram.
    return F.flatten(F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.array_join(F.slice(c, i, ORDER + 1), ""))))


def gram_scores(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, weight): log-ratio of the two models' probabilities; counted is (gram, a, r), wanted (gram)."""

    def last(k: int) -> Column:
        return F.expr(f"right(gram, {k + 1})")

    total = counted.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0)), F.count_distinct(last(0))).first()
    n_a, n_r, n_chars = total[0], total[1], total[2] + 1
    out = wanted.withColumn("pa", F.lit(1.0 / n_chars)).withColumn("pr", F.lit(1.0 / n_chars))
    for k in range(ORDER + 1):
        own = counted.groupBy(last(k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        out = out.join(own, last(k) == F.col("g"), "left").drop("g").fillna(0, ["a", "r"])
        if k == 0:
            own_types = own.agg(F.sum((F.col("a") > 0).cast("int")), F.sum((F.col("r") > 0).cast("int"))).first()
            na, nr, ta, tr = F.lit(n_a), F.lit(n_r), F.lit(own_types[0] or 0), F.lit(own_types[1] or 0)
        else:
            context = own.groupBy(F.expr(f"left(g, {k})").alias("c")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.sum((F.col("a") > 0).cast("int")).alias("ta"), F.sum((F.col("r") > 0).cast("int")).alias("tr"))
            out = out.join(context, F.expr(f"left(right(gram, {k + 1}), {k})") == F.col("c"), "left").drop("c").fillna(0, ["na", "nr", "ta", "tr"])
            na, nr, ta, tr = map(F.col, ("na", "nr", "ta", "tr"))
        for p, n, seen, types in (("pa", "a", na, ta), ("pr", "r", nr, tr)):
            out = out.withColumn(p, F.when(seen > 0, (F.col(n) + types * F.col(p)) / (seen + types)).otherwise(F.col(p)))
        out = out.select("gram", "pa", "pr")
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("weight"))


def scores(distinct: DataFrame) -> tuple[DataFrame, float]:
    """(number, url, verdict of a rule or null), one row per URL, to (number, decided, score) of the URLs that are open or held out, and the threshold."""
    rows = distinct.withColumn("held", F.crc32(F.col("url").cast("binary")) % 5 == 0)
    each = rows.select("number", "decided", "held", F.explode(grams(F.col("url"))).alias("gram"))
    taught = (~F.col("held")).cast("int")
    counted = cut(each.groupBy("gram").agg(F.sum(F.when(F.col("decided") == "allow", taught).otherwise(0)).alias("a"), F.sum(F.when(F.col("decided") == "block", taught).otherwise(0)).alias("r")))
    weights = cut(gram_scores(counted.filter("a + r > 0"), counted.select("gram")))
    side = F.broadcast(weights) if weights.count() <= BROADCAST_GRAMS else weights
    scored = cut(each.filter("held OR decided IS NULL").join(side, "gram").groupBy("number", "decided", "held").agg(F.avg("weight").alias("score")))
    by = {r["decided"]: r for r in scored.filter("held AND decided IS NOT NULL").groupBy("decided").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("sd")).collect()}
    learnt = {r[0] for r in rows.filter("decided IS NOT NULL AND NOT held").select("decided").distinct().collect()}
    if learnt != {"allow", "block"}:
        return scored, float("-inf")
    if set(by) != learnt:
        return scored, 0.0
    a, r = by["allow"], by["block"]
    spread = a["sd"] + r["sd"]
    return scored, (a["mean"] * r["sd"] + r["mean"] * a["sd"]) / spread if spread else (a["mean"] + r["mean"]) / 2


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (of URLs that no rule decides)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("url", F.lit("")).alias("text"))
    own = own.withColumn("host", host(F.col("text"))).withColumn("path", path(F.col("text"))).withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    distinct = own.groupBy(F.col("text").alias("url")).agg(F.first("fit.verdict").alias("decided"))
    # Once written, the numbers stay as they are.
    distinct = cut(distinct.withColumn("number", F.monotonically_increasing_id()))
    scored, threshold = scores(distinct)
    open_ones = scored.filter("decided IS NULL").select("number", "score").join(distinct.select("number", "url"), "number").select(F.col("url").alias("of"), "score")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") < F.lit(threshold), "block").otherwise("allow"))
    asked = F.when(F.col("fit").isNull(), F.col("text"))
    return own.withColumn("asked", asked).join(open_ones, F.col("asked") == F.col("of"), "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
