"""URL filter: rules by host and path, and a character language-model ratio where no rule fits.

Two smoothed variable-order Markov models, for accepted and for rejected URLs, are counted over the URLs that rules
decide (all but a held-out fifth). Order 3 backs off to 2, 1 and 0 characters of context by Witten-Bell smoothing:
P_k(c|ctx) = (n(ctx c) + T(ctx) P_k-1(c|ctx')) / (n(ctx) + T(ctx)), T being the number of different followers, and a
uniform floor below order 0. The score of a URL is the mean over its characters (and its end) of
log P_accepted - log P_rejected. The threshold is calibrated on the held-out fifth: the middle of the score bins where
the two error rates add up to least. Models are tables of distinct four-character grams; the URLs' grams are joined
with them (broadcast if few enough) and averaged where they are read.

Cases: null or no ``://``: host and path are empty, the method judges what characters there are; an empty URL has
only its end to score; repeated rows are judged each; without rules deciding some URL of each kind the threshold is
0; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, UPPER, cut, small

#: Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ORDER, SYMBOLS, BINS = 3, 1024, 200
START, END = "\x02", "\x03"


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, ruled): the longest rule that fits, and its verdict."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    parts = pages.select("page_id", "url", F.translate(F.coalesce(F.regexp_extract("url", pattern, 1), F.lit("")), UPPER, LOWER).alias("host"), F.coalesce(F.regexp_extract("url", pattern, 2), F.lit("")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, so longer, rules override
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return parts.withColumn("rule", rule).withColumn("ruled", verdict)


def grams(judged: DataFrame) -> DataFrame:
    """One row for each character of each URL and its end: the character after its context."""
    text = F.concat(F.lit(START * ORDER), F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER), F.lit(END))
    c = judged.withColumn("c", F.array_remove(F.split(text, ""), ""))
    at = F.transform(F.slice("c", ORDER + 1, F.size("c")), lambda x, i: F.concat(*[F.get(F.col("c"), i + j) for j in range(ORDER)], x))
    return c.withColumn("g", at).select("page_id", "url", "host", "path", "rule", "ruled", F.explode_outer("g").alias("gram"))


def _held_out(url="url"):
    return F.pmod(F.xxhash64(url), F.lit(5)) == 0


def ratios(chars: DataFrame) -> DataFrame:
    """(gram, llr): log P_accepted - log P_rejected of the last character of each four-character gram."""
    train = F.col("ruled").isNotNull() & ~_held_out()
    d = cut(chars.groupBy("gram").agg(*[F.sum(F.when(train & (F.col("ruled") == v), 1).otherwise(0)).alias(n) for v, n in (("allow", "a"), ("block", "b"))]))
    below = None
    for k in range(ORDER + 1):
        at = d.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")) if k < ORDER else d
        at = at.withColumn("ctx", F.substring("gram", 1, k))
        totals = at.groupBy("ctx").agg(*[f(x) for x in "ab" for f in (lambda x: F.sum(x).alias(f"n{x}"), lambda x: F.sum((F.col(x) > 0).cast("long")).alias(f"t{x}"))])
        at = at.join(totals, "ctx")
        if below is None:
            at = at.withColumn("pa", F.lit(1.0 / SYMBOLS)).withColumn("pb", F.lit(1.0 / SYMBOLS))
        else:
            at = at.withColumn("low", F.substring("gram", 2, k)).join(below, "low")
        for x in "ab":
            n, t, p = F.col(f"n{x}"), F.col(f"t{x}"), F.col(f"p{x}")
            at = at.withColumn(f"p{x}", F.when(n + t > 0, (F.col(x) + F.greatest(t, F.lit(1)) * p) / (n + F.greatest(t, F.lit(1)))).otherwise(p))
        below = at.select(F.col("gram").alias("low"), "pa", "pb")
    return below.select(F.col("low").alias("gram"), (F.log("pa") - F.log("pb")).alias("llr"))


def scored(pages: DataFrame, rules=RULES) -> DataFrame:
    """Every row's host, path, rule, ruled verdict and score (mean log ratio by character)."""
    chars = grams(with_rules(pages, rules))
    model = small(cut(ratios(chars)))
    by = ["page_id", "url", "host", "path", "rule", "ruled"]
    means = chars.join(model, "gram").groupBy(*by).agg(F.avg("llr").alias("score"), F.count(F.lit(1)).alias("n"))
    # rows that are equal were summed together: as many come out again
    each = F.length(F.coalesce("url", F.lit(""))) + 1
    return means.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.floor(F.col("n") / each).cast("int"), F.lit(1))))).drop("copy", "n")


def threshold(judged: DataFrame) -> float:
    """The middle of the scores at which held-out accepted and rejected URLs are told apart best."""
    bins = judged.where(F.col("ruled").isNotNull() & _held_out()).groupBy(F.least(F.greatest(F.floor(F.col("score") * BINS / 10), F.lit(-BINS)), F.lit(BINS)).alias("bin"))
    got = {r["bin"]: (r["a"], r["b"]) for r in bins.agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("a"), F.sum((F.col("ruled") == "block").cast("long")).alias("b")).collect()}
    a, b = (sum(x[i] for x in got.values()) for i in (0, 1))
    if not a or not b:
        return 0.0
    errors, missed, passed = {}, 0, b
    for k in range(-BINS, BINS + 2):
        errors[k] = missed / a + passed / b
        missed, passed = missed + got.get(k, (0, 0))[0], passed - got.get(k, (0, 0))[1]
    best = min(errors.values())
    ties = [k for k, e in errors.items() if e <= best + 1e-12]
    return (ties[0] + ties[-1]) / 2 / (BINS / 10)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every row."""
    s = cut(scored(pages, rules))
    at = threshold(s)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= at, "allow").otherwise("block"))
    return s.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"), F.lit(float(at)).alias("threshold"))
