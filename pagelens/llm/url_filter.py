"""Operator 4: URL filters by host-suffix and path-prefix expressions.

Each distinct url is expanded into host suffixes x path prefixes (the prefix lengths that rules have). Expressions
meet rules by an equi-join on the first 32 bits of their SHA-256; the full digest confirms, the longest rule wins
(then the rule text, then block before allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

BROADCAST_LIMIT = 500_000  # rules
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, most: int) -> Column:
    """a.b.c -> c, b.c, a.b.c, up to ``most`` labels (no rule has more); an empty host has none."""
    labels = F.split(host, r"\.")
    return F.when((host == "") | F.lit(most < 1), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda i: F.array_join(F.slice(labels, -i, i), ".")))


def expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule or null), verdict.

    ``rules``: (host, path, verdict). A rule fits its host and all subdomains when the url's path starts with its
    path. Null urls and urls without ``://`` have empty host and path and get ``default``; null rule parts never fit.
    Repeated rows give repeated rows. No pages: no rows; no rules: all get ``default``. Other columns are not read.
    Work per url is bounded by the rules' labels and path lengths, not by the url's own labels.
    """
    pages = pages.select("page_id", "url")
    rules = rules.select(F.translate("host", UPPER, LOW).alias("rh"), F.col("path").alias("rp"), "verdict").where("rh is not null and rp is not null and verdict is not null").distinct()
    rules = rules.withColumn("digest", F.sha2(expression(F.col("rh"), F.col("rp")), 256)).withColumn("short", F.substring("digest", 1, 8))
    # one number per distinct path length of the rules; longer host suffixes than the longest rule's can't fit
    lengths = sorted(r[0] for r in rules.select(F.length("rp")).distinct().collect())
    n_rules, labels = rules.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("rh", r"\."))), F.lit(0))).first()
    urls = pages.where("url is not null").select("url").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    prefix = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    asked = (urls.select("url", F.explode(suffixes(F.col("host"), labels)).alias("h"), prefix.alias("ns"), "path")
             .select("url", "h", "path", F.explode("ns").alias("n"))
             .withColumn("digest", F.sha2(expression(F.col("h"), F.expr("substring(path, 1, n)")), 256)))
    asked = asked.select("url", F.col("digest").alias("full"), F.substring("digest", 1, 8).alias("short"))
    fits = asked.join(F.broadcast(rules) if n_rules <= BROADCAST_LIMIT else rules, "short").where("full = digest")
    rule = F.concat("rh", "rp")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("size"), rule.alias("rule"), (F.col("verdict") == "block").alias("block"), F.col("verdict"))).alias("best"))
    return (pages.join(best, "url", "left")
            .select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
                    F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
