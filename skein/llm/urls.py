"""URL filters: fixed host/path rules, then association rules mined from labelled URLs (DataFrame functions only).

FP-growth mines frequent combinations of URL tokens together with the class token of the label. Tokens that stand in the
same labelled rows are one item, as each more would double the number of combinations and change no combination's rows; tokens of too
few rows are none. Rules that end in "block" and hold the wanted support and confidence are
kept, less those to which a shorter rule gives as much. A rule is posted in the inverted index under its rarest item, so that
tokens common to most URLs have no postings.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, join_hot, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "class=block", "class=allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels by place from the right, path segments, query keys; none without ://."""
    u = F.coalesce(url, F.lit(""))
    labels = F.transform(F.reverse(F.split(host(u), r"\.")), lambda x, i: F.concat(F.lit("label"), i.cast("string"), F.lit("="), x))
    segments = F.transform(F.filter(F.split(path(u), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    query = F.split(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(u, "://", 1))))
    return F.when(F.instr(u, "://") > 0, F.array_distinct(F.concat(scheme, labels, segments, keys))).otherwise(F.array().cast("array<string>"))


def fixed_rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule `host/path` that fits the host, its subdomains and the path's beginning; else nulls."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        rh, rp = r.split("/", 1)
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(f"/{rp}")
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


class Rules(NamedTuple):
    """rules(items, confidence, support, posted_under) and members(token, item): which item each token is."""

    rules: DataFrame
    members: DataFrame


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> Rules:
    """From labelled(url, block: boolean); null labels are left out, and without labelled rows there are no rules.

    A rule holds in at least min_support of the labelled rows, itself and the label, at every size of the table. A combination of
    items matches where each item has a token, which is what all combinations of their tokens would match.
    """
    rows = cut(labelled.where("block is not null").select(F.monotonically_increasing_id().alias("id"), url_tokens(F.col("url")).alias("tokens"), "block"))
    n = rows.count()
    least = max(1, math.ceil(min_support * n))
    posts = rows.select("id", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "id")).alias(f"x{seed}") for seed in (1, 2)]
    counted = posts.groupBy("token").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= least)
    same = Window.partitionBy("n", "x1", "x2")
    # at most (tokens of a row) / min_support tokens are left
    members = cut(counted.select("token", F.min("token").over(same).alias("item"), "n"))
    items = posts.join(small(members), "token").groupBy("id").agg(F.collect_set("item").alias("items"))
    label = F.array(F.when(F.col("block"), BLOCK).otherwise(ALLOW))
    baskets = rows.join(items, "id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), label).alias("items"))
    none = rows.sparkSession.createDataFrame([], "items array<string>, confidence double, support double, posted_under string")
    if not n or members.isEmpty():
        return Rules(none, members.select("token", "item"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support), minConfidence=min_confidence).fit(cut(baskets))
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK) & ~F.array_contains("antecedent", ALLOW))
    rules = rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    freq = members.groupBy("item").agg(F.first("n").alias("n"))
    rarest = rules.withColumn("item", F.explode("items")).join(freq, "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("posted_under"))
    rules = cut(rules.join(rarest, "items").select("items", "confidence", "support", "posted_under"))
    # a shorter rule with as much confidence is found under its posting, as a page's rules are
    shorter = rules.select(F.col("items").alias("fewer"), F.col("confidence").alias("c"), F.col("posted_under").alias("item"))
    beaten = rules.withColumn("item", F.explode("items")).join(shorter, "item").where((F.size("fewer") < F.size("items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("fewer", "items")) == 0))
    return Rules(rules.join(beaten.select("items").distinct(), "items", "left_anti"), members.select("token", "item"))


def match_rules(urls: DataFrame, mined: Rules) -> DataFrame:
    """url, key (its hash), confidence of the best rule that matches, for each distinct non-null url that a rule matches."""
    distinct = urls.where("url is not null").select("url").distinct().withColumn("key", F.xxhash64("url"))
    held = distinct.withColumn("token", F.explode(url_tokens(F.col("url")))).join(small(mined.members), "token")
    pages = held.groupBy("url", "key").agg(F.collect_set("item").alias("held"))
    index = mined.rules.select(F.col("posted_under").alias("item"), F.col("items").alias("wanted"), "confidence")
    hits = pages.withColumn("item", F.explode("held")).join(index, "item").where(F.size(F.array_except("wanted", "held")) == 0)
    return hits.groupBy("url", "key").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], min_support: float = 0.005, min_confidence: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for each row of pages; repeated rows stay repeated, ids may be null.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed by the mined rules. Other columns
    are not read; empty pages give no rows.
    """
    u = cut(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.xxhash64(F.col(url_col)).alias("key")))
    best = match_rules(u, mine_rules(labelled, min_support, min_confidence))
    # by a hash, which splits a url that many pages share; urls of one hash stand together
    best = cut(best.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("url", "confidence"))).alias("best")))
    u = join_hot(u, best, "key", "left").withColumn("confidence", F.try_element_at("best", F.coalesce("url", F.lit(""))))
    u = u.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return u.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")
