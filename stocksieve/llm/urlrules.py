"""URL filters by association rules.

A list of given rules (host suffix, path prefix, verdict) decides the urls it
covers; the longest fitting rule wins.  Those urls are also the labels from
which the method learns: Spark's FP-growth mines combinations of url tokens
(host labels, path segments, the shape of numbers, query keys) that go with a
verdict.  Rules under the least support or confidence are dropped, and so is a
rule that a shorter one of at least its confidence implies.  Urls without a
given rule get the verdict of the best mined rule they fit (confidence, then
support, then fewer tokens), found through an inverted index: a rule is filed
under its rarest token, a url looks up its own tokens and the rest of the
rule's tokens are tested against it.  A url that fits none is allowed.

Everything is a DataFrame job; mining and matching run on distinct urls.  A url
with n frequent tokens makes at most n + n(n-1)/2 + n(n-1)(n-2)/6 small baskets
(``_baskets``), so mining grows with a power of n; the number of mined rules
depends on the support, not on the number of urls.

Cases: a null url or one without ``://`` has empty host and path, no tokens
and the verdict allow; without labelled urls nothing is mined; repeated rows and
null ids are judged like others; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .components import staged

# fixed values of the contract: (host, path, verdict)
GIVEN = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
MAX_TOKENS = 3  # tokens of a mined rule
GROUPS = 256  # of tokens, of which a basket holds at most MAX_TOKENS
_VERDICT = "verdict="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def given(host: Column, path: Column, rules) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    """Distinct tokens of a url, none of them a single page's own number."""
    labels = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("host="), x))
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    digits = F.transform(F.filter(F.split(path(url), "[^0-9]+"), lambda x: x != ""),
                         lambda x: F.concat(F.lit("digits="), F.length(x).cast("string"), F.lit(","), F.substring(x, 1, 1)))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    query = F.transform(query, lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "^([A-Za-z]*)://", 1)))
    every = F.array_distinct(F.concat(labels, parts, digits, query, scheme))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(every)


def _combinations(groups: Column) -> Column:
    """All sets of one to three of the distinct values of an array."""
    rest = lambda i: F.slice(groups, i + 2, F.size(groups))
    one = F.transform(groups, lambda a: F.array(a))
    two = F.flatten(F.transform(groups, lambda a, i: F.transform(rest(i), lambda b: F.array(a, b))))
    three = F.flatten(F.flatten(F.transform(groups, lambda a, i: F.transform(rest(i), lambda b, j: F.transform(rest(i + j + 1), lambda c: F.array(a, b, c))))))
    return F.concat(one, two, three)


def _baskets(labelled: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``(items)`` and their number: the frequent tokens of each url, dealt to baskets in which
    no long combination can arise.

    Tokens fall into ``GROUPS`` groups by hash.  A url makes a basket of each
    set of at most MAX_TOKENS groups it has tokens of, and its items name that
    set, so FP-growth meets few tokens at a time, however many a url has: the
    number of baskets grows with a power of that number, not exponentially.  A
    combination is counted in full in the baskets of exactly its own groups,
    and is read from those."""
    rows = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict")
    each = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    frequent = each.groupBy("token").count().where(F.col("count") >= least).select("token")
    kept = each.join(frequent, "token").groupBy("row", "verdict").agg(F.collect_set("token").alias("tokens"))
    kept = staged(kept.withColumn("groups", F.array_sort(F.array_distinct(F.transform("tokens", _group)))), "url-tokens")
    n = F.size("groups").cast("long")
    total = kept.agg(F.sum(n + F.floor(n * (n - 1) / 2) + F.floor(n * (n - 1) * (n - 2) / 6)).alias("n")).first()["n"] or 0
    # the rows are few and narrow, what they are expanded to is not: dealt out by a fixed number
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = kept.repartition(parts, "row").select("tokens", "verdict", F.explode(_combinations(F.col("groups"))).alias("groups"))
    tag = F.concat(F.array_join("groups", ","), F.lit("|"))
    own = F.filter("tokens", lambda t: F.array_contains("groups", _group(t)))
    return sets.select(F.transform(F.concat(own, F.array(F.concat(F.lit(_VERDICT), "verdict"))), lambda t: F.concat(tag, t)).alias("items")), total


def _group(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(GROUPS)).cast("int")


def _plain(items: Column) -> Column:
    return F.transform(items, lambda t: F.substr(t, F.instr(t, "|") + 1))


def _whole(items: Column) -> Column:
    """Whether tagged items are of all groups that their tag names."""
    named = F.split(F.substring_index(F.get(items, F.lit(0)), "|", 1), ",")
    return F.size(named) == F.size(F.array_distinct(F.transform(_plain(items), _group)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(rule_tokens, verdict, confidence, support, key)`` from ``(tokens,
    verdict)`` rows; key is the rarest token of the rule."""
    spark = labelled.sparkSession
    labelled = staged(labelled.where(F.size("tokens") > 0), "url-labels")
    urls = labelled.count()
    least = max(1, math.ceil(min_support * urls - 1e-9))
    baskets, total = _baskets(labelled, least)
    total = max(1, total)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_confidence).fit(baskets)
    said = F.element_at(_plain(F.col("consequent")), 1)
    rules = (model.associationRules.where(F.startswith(said, F.lit(_VERDICT)) & (F.size("antecedent") <= max_tokens) & _whole(F.col("antecedent")))
             .select(F.array_sort(_plain(F.col("antecedent"))).alias("rule_tokens"), F.substr(said, F.lit(len(_VERDICT) + 1)).alias("verdict"), "confidence",
                     (F.round(F.col("support") * total) / max(1, urls)).alias("support")))
    where = shared_path(spark, "url-rules", unique=True)
    rules.write.parquet(where)  # mined once; used by the pruning and the index
    rules = spark.read.parquet(where)
    # a rule goes when one of its parts is a rule with the same verdict and at least its confidence
    shorter = rules.select(F.col("rule_tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    parts = rules.where(F.size("rule_tokens") > 1).select("*", F.explode(
        F.concat(F.transform("rule_tokens", lambda x: F.array(x)),
                 F.transform("rule_tokens", lambda x: F.array_remove(F.col("rule_tokens"), x)))).alias("part"))
    implied = (parts.where(F.size("part") < F.size("rule_tokens")).join(shorter, "part")
               .where((F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence"))).select("rule_tokens", "verdict").distinct())
    rules = rules.join(implied, ["rule_tokens", "verdict"], "left_anti")
    singles = model.freqItemsets.where(F.size("items") == 1)
    freq = singles.select(F.get(_plain(F.col("items")), F.lit(0)).alias("token"), "freq", _whole(F.col("items")).alias("whole")).where("whole").drop("whole")
    filed = rules.select("*", F.explode("rule_tokens").alias("token")).join(freq, "token")
    return (filed.groupBy("rule_tokens", "verdict", "confidence", "support")
            .agg(F.min(F.struct("freq", "token")).alias("rarest"))
            .select("rule_tokens", "verdict", "confidence", "support", F.col("rarest.token").alias("key")))


def judge_urls(pages: DataFrame, rules=GIVEN, default: str = DEFAULT, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined, confidence)`` for every
    row of ``pages``."""
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    urls = urls.select("url", given(host(F.col("url")), path(F.col("url")), rules).alias("given"), tokens(F.col("url")).alias("tokens"))
    index = mine(urls.where(F.col("given").isNotNull()).select("tokens", F.col("given.verdict").alias("verdict")),
                 min_support, min_confidence)
    looked = urls.where(F.col("given").isNull()).select("url", "tokens", F.explode("tokens").alias("key"))
    fits = looked.join(index, "key").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = fits.groupBy("url").agg(F.max(F.struct("confidence", "support", (-F.size("rule_tokens")).alias("fewer"),
                                                  "verdict", "rule_tokens")).alias("best"))
    best = best.select(F.col("url").alias("found_url"), "best")
    out = pages.select("page_id", "url").join(best, F.col("url") == F.col("found_url"), "left")
    out = out.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "best",
                     given(host(F.col("url")), path(F.col("url")), rules).alias("given"))
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"),
                      F.coalesce(F.col("given.verdict"), F.col("best.verdict"), F.lit(default)).alias("verdict"),
                      F.when(F.col("given").isNull(), F.array_join("best.rule_tokens", " ")).alias("mined"),
                      F.when(F.col("given").isNull(), F.col("best.confidence")).alias("confidence"))
