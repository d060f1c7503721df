"""URL filters: a fixed rule list, and association rules mined from labelled URLs.

``mine_rules`` runs Spark's FP-growth over the token baskets of the bad pages, counts the found
combinations over all labelled pages and keeps the minimal rules ``tokens -> bad`` that have enough
bad pages, confidence and evidence, of whatever number of tokens.  ``match_rules`` looks
rules up in an inverted index: each rule is filed under its rarest token, a URL's tokens fetch
the rules filed there, and the remaining tokens are checked by containment.  Each distinct token
set is matched once and the verdict joined back.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ascii_lower

MIN_BAD = 4  # bad pages that a rule fits at least, at any number of pages
MIN_CONFIDENCE = 0.6
MIN_SIGMA = 1.96  # its bad pages exceed the share of bad pages among all by so many standard deviations


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(matched rule or null, its verdict or null); ``rules`` are (verdict, ``host/path``).

    A rule fits its host and all subdomains if the path starts with the rule's path (which
    begins with ``/``); the longest fitting rule wins, equal lengths by code point.
    """
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        which = F.when(fits, F.lit(rule)).otherwise(which)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return which, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, sorted: host labels, path segments with digits masked, query names.

    Long segments are kept whole; an empty or null URL has no tokens.
    """
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    masked = F.regexp_replace(path, "[0-9]+", "0")
    part = lambda c, by, tag: F.transform(
        F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_sort(F.array_distinct(F.concat(part(host, "[.]", "h:"), part(masked, "/", "p:"), names)))


def _contained(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (row of ``sets``, row of ``rules``) with the rule's ``need`` inside the row's ``tokens``.

    Each rule is filed under its token with the fewest rules, so a rule that is contained is met once.
    """
    postings = rules.select("rule", F.explode("need").alias("token"))
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n_rules"))
    w = W.partitionBy("rule").orderBy("n_rules", "token")
    filed = (postings.join(often, "token").withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .select("rule", "token"))
    index = rules.join(filed, "rule")
    return (sets.withColumn("token", F.explode("tokens")).join(index, "token").drop("token")
            .where(F.size(F.array_except("need", "tokens")) == 0))


def mine_rules(labelled: DataFrame, min_bad: int = MIN_BAD, min_confidence: float = MIN_CONFIDENCE,
               min_sigma: float = MIN_SIGMA) -> DataFrame:
    """``labelled``: (tokens array, bad boolean).  Returns rule (id), tokens, confidence, support.

    A combination of tokens is a rule if at least ``min_bad`` bad pages hold it, ``min_confidence`` of
    the labelled pages that hold it are bad, and these exceed the overall share of bad pages by ``min_sigma``
    standard deviations (score test).  Only minimal rules are kept: a rule with more tokens than
    another one that it includes blocks nothing further.  Tokens that stand in exactly the same labelled
    pages cannot be told apart; the first of them in code point order stands for all, so long URLs
    that repeat are one item, not all subsets of their tokens.

    Over all labelled rows, repeated ones included; rows with a null label are unlabelled and left out,
    rows without tokens count only in the overall share.  Without labelled rows, or without a bad one,
    there are no rules.  Other columns are ignored.
    """
    bad, n = F.col("bad").cast("long"), F.lit(1)
    sets = cut_lineage(labelled.where(F.col("bad").isNotNull()).select("tokens", "bad")
                       .groupBy("tokens").agg(F.sum(bad).alias("bad"), F.count(n).alias("n")))
    total = sets.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    everything, all_bad = float(total["n"] or 0), float(total["bad"] or 0)
    excess = F.col("bad").cast("double") * everything - F.col("n").cast("double") * all_bad
    spread = F.sqrt(F.col("n").cast("double") * all_bad * (everything - all_bad))
    confidence = F.col("bad") / F.col("n")
    passes = (F.col("bad") >= min_bad) & (confidence >= min_confidence) & (excess >= F.lit(min_sigma) * spread)

    # tokens by the labelled sets they stand in, and the rules of one token
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "tokens")).alias(f"x{seed}") for seed in (1, 2)]
    single = (sets.select("tokens", "bad", "n", F.explode("tokens").alias("token"))
              .groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), *same))
    single = cut_lineage(single.groupBy("bad", "n", "x1", "x2").agg(F.min("token").alias("token"))
                         .where(F.col("bad") >= min_bad).select("token", "bad", "n", passes.alias("is_rule")))
    one = single.where("is_rule").select(F.array("token").alias("need"), "bad", "n")

    # what is left of the bad pages' baskets; a combination with one of these rules would not be minimal
    left = single.where("NOT is_rule").select("token")
    baskets = (sets.where("bad > 0").select("tokens", "bad", F.explode("tokens").alias("token")).join(left, "token")
               .groupBy("tokens").agg(F.first("bad").alias("bad"), F.collect_list("token").alias("items"))
               .where(F.size("items") > 1).select("items", F.explode(F.expr("sequence(1, bad)"))).select("items"))
    baskets = cut_lineage(baskets)
    found = one
    if n_baskets := baskets.count():
        mined = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_bad - 0.5) / n_baskets)).fit(baskets).freqItemsets
        many = (mined.where(F.size("items") > 1).select(F.array_sort("items").alias("need"))
                .withColumn("rule", F.concat_ws(" ", "need")))
        counted = (_contained(sets, cut_lineage(many)).groupBy("need")
                   .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(passes))
        counted = cut_lineage(counted.withColumn("rule", F.concat_ws(" ", "need")))
        wider = (_contained(counted.select(F.col("rule").alias("wide"), F.col("need").alias("tokens")), counted.select("rule", "need"))
                 .where(F.col("wide") != F.col("rule")).select(F.col("wide").alias("rule")).distinct())
        found = one.unionByName(counted.join(wider, "rule", "left_anti").select("need", "bad", "n"))
    return found.select(F.concat_ws(" ", "need").alias("rule"), F.col("need").alias("tokens"), confidence.alias("confidence"),
                        (F.col("bad") / F.lit(everything)).alias("support"))


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best mined rule of every distinct ``tokens`` array: (tokens, mined_rule, confidence).

    Highest confidence wins, then highest support, then rule text.  Sets that no rule matches
    are absent; an empty or null set matches none.
    """
    sets = token_sets.select("tokens").distinct()
    hits = _contained(sets, rules.withColumnRenamed("tokens", "need"))
    best = F.max(F.struct("confidence", "support", F.col("rule")))
    return (hits.groupBy("tokens").agg(best.alias("b"))
            .select("tokens", F.col("b.rule").alias("mined_rule"), F.col("b.confidence").alias("confidence")))
