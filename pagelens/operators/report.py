"""Corpus reports: A4 locator evidence, A5 payload, A6 determinism, Q1/Q2
contract checks, R2 prompt rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.schema import CLEANED_DROP_TAGS, NODE_KINDS, STRATEGIES

# Whitespace class written with \x{...} escapes so Java and RE2 read it alike.
WS_CLASS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
VOID_DROP = ["link", "meta"]
PAIRED_DROP = [t for t in CLEANED_DROP_TAGS if t not in VOID_DROP]


def evidence(nodes: DataFrame) -> DataFrame:
    """A4: per page node count, unique primaries, flagged and unflagged ambiguous primaries."""
    p = F.col("primary_locator")
    return nodes.groupBy("page_id").agg(
        F.count(F.lit(1)).cast("long").alias("nodes"),
        F.count_if(p["is_unique"]).cast("long").alias("unique_primaries"),
        F.count_if(~p["is_unique"] & p["disambiguation"].isNotNull()).cast("long").alias("flagged_ambiguous"),
        F.count_if(~p["is_unique"] & p["disambiguation"].isNull()).cast("long").alias("unflagged_ambiguous"))


def cleaned_html(html):
    """Text-level cleaning: drop script/style/svg/noscript/template blocks and
    link/meta tags, collapse whitespace runs."""
    c = html
    for t in PAIRED_DROP:
        c = F.regexp_replace(c, r"(?is)<" + t + r"\b[^>]*>.*?</" + t + r"\s*>", "")
    for t in VOID_DROP:
        c = F.regexp_replace(c, r"(?i)<" + t + r"\b[^>]*>", "")
    return F.regexp_replace(c, WS_CLASS, " ")


def tokens(chars):
    return F.round(chars / F.lit(4.0)).cast("long")


def payload_html(pages: DataFrame) -> DataFrame:
    """A5 (html side): raw and cleaned characters with token estimates (chars / 4)."""
    raw = F.length("html")
    cleaned = F.length(cleaned_html(F.col("html")))
    return pages.select("page_id", raw.cast("long").alias("raw_chars"), cleaned.cast("long").alias("cleaned_chars")) \
        .withColumn("raw_tokens", tokens(F.col("raw_chars"))) \
        .withColumn("cleaned_tokens", tokens(F.col("cleaned_chars")))


def payload_totals(payload: DataFrame) -> DataFrame:
    """A5 totals: pages, characters, tokens and reduction of cleaned against raw html per host and over the corpus (host null).

    payload: (host, raw_chars, cleaned_chars, raw_tokens, cleaned_tokens). Sums are partial before the shuffle, which has a row per host.
    """
    sums = [F.sum(c).alias(c) for c in ("raw_chars", "cleaned_chars", "raw_tokens", "cleaned_tokens")]
    total = payload.rollup("host").agg(F.grouping("host").alias("corpus"), F.count(F.lit(1)).alias("pages"), *sums)
    return total.withColumn("reduction_pct", F.when(F.col("raw_chars") > 0, reduction(F.col("cleaned_chars"), F.col("raw_chars"))))


def reduction(small, big):
    """Percent reduction rounded to one decimal."""
    return F.round((F.lit(1.0) - small / big) * 100, 1)


def fingerprint(extracts: DataFrame):
    """sha256 of the extract with captured_at removed."""
    md = F.col("page_metadata")
    stripped = F.struct(F.col("schema_version"), md.dropFields("captured_at").alias("page_metadata"),
                        F.col("interactive_nodes"))
    return F.sha2(F.to_json(stripped), 256)


def determinism(extracts: DataFrame) -> DataFrame:
    """Per url, are all captures' extracts identical (captured_at removed)?"""
    e = extracts.select(F.col("page_metadata.url").alias("url"), fingerprint(extracts).alias("fp"))
    return e.groupBy("url").agg(F.count(F.lit(1)).cast("long").alias("captures"),
                                (F.count_distinct("fp") == 1).alias("deterministic"))


def contract_violations(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """Q1 / Q2: number of violating rows per contract rule (expected all zero)."""
    p = F.col("primary_locator")
    exprs_ok = lambda x: ~(F.contains(x, F.lit(">>>")) | F.contains(x, F.lit("::shadow")))
    n = nodes.agg(
        F.count_if(~F.col("kind").isin(NODE_KINDS)).alias("kind_enum"),
        F.count_if(~p["strategy"].isin(STRATEGIES)
                   | ~F.forall("fallback_locators", lambda f: f["strategy"].isin(STRATEGIES))).alias("strategy_enum"),
        F.count_if(F.coalesce(F.col("tag"), F.lit("")) == "").alias("empty_tag"),
        F.count_if((F.coalesce(p["playwright"], F.lit("")) == "")
                   | F.exists("fallback_locators", lambda f: F.coalesce(f["playwright"], F.lit("")) == "")).alias(
            "empty_expression"),
        F.count_if(~exprs_ok(p["playwright"])
                   | F.exists("fallback_locators", lambda f: ~exprs_ok(f["playwright"]))).alias("shadow_piercing_css"),
        F.count_if(~p["is_unique"] & p["disambiguation"].isNull()).alias("ambiguous_unflagged"),
        F.count_if(p["is_unique"] & p["disambiguation"].isNotNull()).alias("unique_with_guidance"),
    )
    per_page = nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    m = meta.join(per_page, "page_id", "left").agg(
        F.count_if(F.col("frame_count") < 1).alias("frame_count_min"),
        F.count_if(F.col("node_count") != F.coalesce(F.col("n"), F.lit(0))).alias("node_count_mismatch"))
    cols_n = ["kind_enum", "strategy_enum", "empty_tag", "empty_expression", "shadow_piercing_css",
              "ambiguous_unflagged", "unique_with_guidance"]
    cols_m = ["frame_count_min", "node_count_mismatch"]
    un = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations"))
                                      for c in cols_n])).alias("r")).select("r.*")
    um = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations"))
                                      for c in cols_m])).alias("r")).select("r.*")
    return un.unionByName(um)
