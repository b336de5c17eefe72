"""J6 style resolution from ``<style>`` elements.

Style sheets are cut into rules with built-in string functions (nested ``@media`` / ``@supports`` / ``@layer`` blocks included), their
selectors are compiled and matched by ``pagelens.operators.selectors``, and the winner per element and property is
``max_by(value, (important, specificity, order))``.

A rule whose selector or enclosing block is not evaluated (``:has()``, ``@container``, ...) and that sets one of ``PROPS`` is a row of
``style_notes``: it is left out, and said to be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.props import A
from pagelens.functions.text import text_slice
from pagelens.operators.select import FRAME
from pagelens.operators.selectors import compile_selectors, match_selectors, split_list

PROPS = ["display", "visibility", "opacity", "cursor", "position", "width", "height"]
# Viewport widths of the two presets (desktop is the browser default).
VIEWPORT_WIDTH = {"desktop": 1280, "mobile": 375}
# At-rules whose blocks hold no style rules.
NO_RULES = r"(?i)^@(?:-[a-z]+-)?(?:keyframes|font-face|page|property|counter-style|font-feature-values|font-palette-values|view-transition)\b"
BLOCK_LEVELS = 4  # nested blocks whose conditions are kept apart; deeper rules are noted
RULE = ["style_eid", "pos", "si"]


def media_applies(query: Column, width: int) -> Column:
    """One of the queries of a media list holds on a screen of ``width`` pixels; features other than the width and the
    user's preferences are taken as given."""
    def px(name: str, q: Column) -> Column:
        size = F.regexp_extract(q, name + r"\s*:\s*([0-9.]+)\s*(px|em|rem)", 1).try_cast("double")
        return F.when(q.rlike(name + r"\s*:\s*[0-9.]+\s*r?em"), size * 16).otherwise(size)

    def one(q: Column) -> Column:
        held = (F.coalesce(F.lit(width) >= px("min-width", q), F.lit(True)) & F.coalesce(F.lit(width) <= px("max-width", q), F.lit(True))
                & ~q.rlike(r"prefers-color-scheme\s*:\s*dark|prefers-reduced-motion\s*:\s*reduce"))
        kind = F.regexp_extract(q, r"^\s*(?:only\s+|not\s+)?([a-z]+)", 1)
        held = held & kind.isin("", "all", "screen", "and")
        return F.when(q.rlike(r"^\s*not\s"), ~held).otherwise(held)

    return (F.trim(query) == "") | F.exists(F.split(F.lower(query), ","), one)


def css_declarations(elements: DataFrame, frames: DataFrame, viewport: str = "desktop") -> DataFrame:
    """One row per selector of a rule that sets one of PROPS and applies under ``viewport``: FRAME, root_id, RULE, selector, strange, decl."""
    width = VIEWPORT_WIDTH.get(viewport, 1280)
    styles = elements.filter(F.col("tag") == "style").select(*FRAME, F.col("eid").alias("style_eid"), "root_id",
                                                             "t_start", "t_end", F.coalesce(A["media"], F.lit("")).alias("media"))
    css = (styles.filter(media_applies(F.col("media"), width)).join(frames.select(*FRAME, "text"), FRAME)
           .select(*FRAME, "style_eid", "root_id",
                   F.regexp_replace(text_slice(F.col("text"), F.col("t_start"), F.col("t_end")), r"(?s)/\*.*?\*/", "")
                   .alias("css")))
    # a chunk ends with one closing brace: blocks that it opens, then a selector list and its declarations
    chunks = css.select(*FRAME, "style_eid", "root_id", F.posexplode(F.split("css", r"\}")).alias("pos", "chunk"))
    chunks = chunks.withColumn("part", F.split("chunk", r"\{"))
    chunks = chunks.withColumn("opened", F.size("part") - 1)
    w = Window.partitionBy(*FRAME, "style_eid").orderBy("pos")
    chunks = chunks.withColumn("before", F.coalesce(F.sum(F.col("opened") - 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chunks = chunks.withColumn("level", F.col("before") + F.greatest(F.col("opened") - 1, F.lit(0)))
    # the block open at a level is the one opened there last; "@import ...;" and the like before it are cut off
    prelude = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)^.*;", ""), r"\s+", " "))
    for k in range(1, BLOCK_LEVELS + 1):
        at = F.lit(k) - F.col("before") - 1
        opens = (at >= 0) & (at < F.col("opened") - 1)
        last = F.last(F.when(opens, prelude(F.get("part", at.cast("int")))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        chunks = chunks.withColumn(f"block{k}", F.when(F.col("level") >= k, last))
    blocks = F.array_compact(F.array(*[f"block{k}" for k in range(1, BLOCK_LEVELS + 1)]))
    name = lambda b: F.lower(F.regexp_extract(b, r"^@([A-Za-z-]+)", 1))
    rest = lambda b: F.regexp_replace(b, r"^@[A-Za-z-]+\s*", "")
    off = (F.exists(blocks, lambda b: b.rlike(NO_RULES)) | F.exists(blocks, lambda b: (name(b) == "media") & ~media_applies(rest(b), width))
           | F.exists(blocks, lambda b: (name(b) == "supports") & F.lower(rest(b)).startswith("not")))
    rule = F.get("part", F.col("opened") - 1)
    chunks = (chunks.filter((F.col("opened") > 0) & ~off)
              .withColumn("selectors", prelude(rule)).filter(~F.col("selectors").rlike(NO_RULES))
              .withColumn("decls", F.get("part", F.col("opened")))
              .withColumn("strange", F.coalesce(F.exists(blocks, lambda b: ~name(b).isin("media", "supports", "layer")) | (F.col("level") > BLOCK_LEVELS), F.lit(False))))
    decl = F.filter(F.array(*[F.struct(
        F.lit(p).alias("prop"),
        F.try_element_at(F.regexp_extract_all(F.lower("decls"), F.lit(r"(?:^|;)\s*" + p + r"\s*:\s*([^;]*)"), 1),
                         F.lit(-1)).alias("raw")) for p in PROPS]), lambda d: d["raw"].isNotNull())
    return (chunks.withColumn("decl", decl).filter(F.size("decl") > 0)
            .select(*FRAME, "root_id", "style_eid", "pos", "decl", "strange", F.posexplode(split_list(F.col("selectors"))).alias("si", "selector")))


def css_rules(declarations: DataFrame) -> DataFrame:
    """Declarations with compiled selectors, one row per selector and property: FRAME, root_id, RULE, selector, steps, weight, reason, prop, value, important."""
    sel = compile_selectors(declarations).withColumn("reason", F.when(F.col("strange") | F.col("selector").startswith("@"), F.lit("at-rule not evaluated")).otherwise(F.col("reason")))
    sel = sel.withColumn("steps", F.when(F.col("reason").isNull(), F.col("steps")))
    return (sel.select(*FRAME, "root_id", *RULE, "selector", "steps", "weight", "reason", F.explode("decl").alias("d"))
            .select(*FRAME, "root_id", *RULE, "selector", "steps", "weight", "reason", F.col("d.prop").alias("prop"),
                    F.trim(F.regexp_replace("d.raw", r"!\s*important\s*$", "")).alias("value"),
                    F.col("d.raw").rlike(r"!\s*important\s*$").alias("important")))


def style_notes(rules: DataFrame) -> DataFrame:
    """The selectors of ``css_rules`` that are not evaluated, with the reason."""
    return rules.filter(F.col("reason").isNotNull()).groupBy(*FRAME, "root_id", *RULE).agg(F.first("selector").alias("selector"), F.first("reason").alias("reason"))


def stylesheet_values(elements: DataFrame, rules: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Winning style-sheet value (and its !important flag) per element and property; ``keep`` materialises a reused table."""
    scope = [*FRAME, "root_id"]
    known = rules.filter(F.col("reason").isNull())
    selectors = known.groupBy(*scope, *RULE).agg(F.first("steps").alias("steps"))
    m = match_selectors(elements, selectors, RULE, scope, keep).join(known.drop("steps", "root_id"), [*FRAME, *RULE])
    order = F.struct("important", "weight", "style_eid", "pos", "si")
    aggs = []
    for p in PROPS:
        aggs.append(F.max_by(F.when(F.col("prop") == p, F.struct("value", "important")),
                             F.when(F.col("prop") == p, order)).alias(f"_w_{p}"))
    res = m.groupBy(*FRAME, "eid").agg(*aggs)
    sel = [*FRAME, "eid"]
    for p in PROPS:
        sel += [F.col(f"_w_{p}.value").alias(f"ss_{p}"),
                F.coalesce(F.col(f"_w_{p}.important"), F.lit(False)).alias(f"ss_{p}_imp")]
    return res.select(*sel)
