"""URL filters by association rules.

DataFrame functions and Spark's FP-growth only. Host rules judge what they fit; the URLs they judge are the labels from
which FP-growth mines combinations of URL tokens (host labels, path segments, file ending, query keys). Combinations
that imply a verdict with enough confidence and support become rules; a rule goes if a rule with a part of its tokens
implies the same at least as surely. URLs that no host rule fits are matched through an inverted index: each rule is
listed under its rarest token only, and its other tokens are checked in the row. The surest rule wins, then the one with
most support; a URL without any is allowed.

Support and confidence are counted over distinct URLs: a URL is one label, however many rows have it. Tokens that stand in
the same labelled URLs (equal counts and equal sums of two 64-bit hashes of these) are one token in mining, so that a
template with many fixed parts does not multiply combinations; a rule's token fits where any of its equals stands. That
gives the rules of all combinations. Tokens of which one implies the other, but not the reverse, still combine.

Null URLs and URLs without `://` have an empty host and path, and are allowed. Of rules of the same confidence and support,
one that blocks wins. Rows are judged one by one with the rules broadcast (shuffled beyond MOST_BROADCAST), so repeated
rows and a URL that holds a third of them need no task of their own.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SUPPORT, CONFIDENCE = 0.01, 0.8
MOST_BROADCAST = 50_000
# (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _after(url: Column) -> Column:
    """What follows the first ://, else null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), upper, lower), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, h: Column, p: Column) -> Column:
    """Distinct tokens of a URL."""
    mark = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    ending = F.regexp_extract(p, r"\.([A-Za-z0-9]{1,8})$", 1)
    return F.array_distinct(F.concat(mark("h:", F.split(h, r"\.")), mark("s:", F.split(p, "/")), mark("x:", F.array(ending)), mark("q:", keys)))


def equal_tokens(labelled: DataFrame, support: float) -> dict[str, str]:
    """Each token of enough labelled URLs (distinct url, tokens) to the least of those that stand in the same URLs.

    There are at most 1 / support times as many as a URL has tokens on average, so they may come to the driver.
    """
    least = labelled.count() * support
    seen = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("url").alias("a"), F.xxhash64(F.lit(1), "url").alias("b"))
    often = seen.groupBy("token").agg(F.count("token").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= least)
    same = often.groupBy("n", "a", "b").agg(F.min("token").alias("first"), F.collect_list("token").alias("tokens"))
    return {t: r["first"] for r in same.select("first", "tokens").collect() for t in r["tokens"]}


def merged(tokens: Column, equal: dict[str, str], only: bool = False) -> Column:
    """Tokens as the first of their equals; only: without those that are too rare for any rule."""
    if not equal:
        return F.array().cast("array<string>") if only else tokens
    first = F.create_map(*[F.lit(x) for pair in sorted(equal.items()) for x in pair])
    got = F.transform(tokens, lambda t: first[t] if only else F.coalesce(first[t], t))
    return F.array_distinct(F.filter(got, lambda t: t.isNotNull()))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(items, verdict, confidence, support) of the rules kept, from rows (tokens, verdict)."""
    baskets = labelled.select(F.concat(F.filter("tokens", lambda x: ~x.startswith("=")), F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    plain = sets.select(F.filter("items", lambda x: ~x.startswith("=")).alias("items"), F.array_max(F.filter("items", lambda x: x.startswith("="))).alias("label"), "freq").select(F.array_sort("items").alias("items"), "label", "freq")
    whole = plain.where("label is null").select("items", F.col("freq").alias("all"))
    rules = plain.where("label is not null and size(items) > 0").join(whole, "items").select("items", F.expr("substr(label, 2)").alias("verdict"), (F.col("freq") / F.col("all")).alias("confidence"), F.col("freq").alias("support")).where(F.col("confidence") >= confidence)
    # A rule with one token less is looked up for each token: shorter rules then cover all longer ones step by step.
    less = rules.select("items", "verdict", "confidence", F.explode("items").alias("one")).where("size(items) > 1").select("items", "verdict", "confidence", F.array_remove("items", F.col("one")).alias("part"))
    beaten = less.join(rules.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("c")), ["part", "verdict"]).where("c >= confidence").select("items", "verdict").distinct()
    return rules.join(beaten, ["items", "verdict"], "left_anti")


def inverted(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rules, each listed under the one of its tokens that the fewest labelled URLs have."""
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("token").alias("often"))
    by_token = rules.select("items", "verdict", "confidence", "support", F.explode("items").alias("token")).join(often, "token")
    return by_token.groupBy("items", "verdict", "confidence", "support").agg(F.min(F.struct("often", "token")).alias("r")).select("items", "verdict", "confidence", "support", F.col("r.token").alias("token"))


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    h, p = host(F.col("url")), path(F.col("url"))
    base = pages.select("page_id", "url").withColumns({"host": h, "path": p})
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict})
    urls = base.where("url is not null and ruled is not null").select("url", "host", "path", F.col("ruled").alias("verdict")).distinct()
    labelled = written(urls.select("url", "verdict", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "labelled")
    equal = equal_tokens(labelled, support)
    labelled = labelled.withColumn("tokens", merged(F.col("tokens"), equal, only=True))
    index = written(inverted(mine(labelled, support, confidence), labelled), "rules")
    n_rules = index.count()
    settled = base.where("ruled is not null or url is null")
    open_ = base.where("ruled is null and url is not null")
    done = settled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    if not n_rules:
        return done.unionByName(open_.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict")))
    each = open_.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "rule", merged(tokens(F.col("url"), F.col("host"), F.col("path")), equal).alias("tokens"))
    each = each.select("row", "page_id", "host", "path", "rule", "tokens", F.explode_outer("tokens").alias("token"))
    hits = each.join(F.broadcast(index) if n_rules <= MOST_BROADCAST else index, "token", "left")
    fits = F.col("items").isNotNull() & (F.size(F.array_except("items", "tokens")) == 0)
    best = hits.groupBy("row", "page_id", "host", "path", "rule").agg(F.max(F.when(fits, F.struct("confidence", "support", "verdict"))).alias("m"))
    return done.unionByName(best.select("page_id", "host", "path", "rule", F.coalesce("m.verdict", F.lit("allow")).alias("verdict")))


def op5(spark, sf_dir) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
