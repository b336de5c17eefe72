"""One dead-letter table for everything a run refuses.

Every stage keeps its own error rows; ``dead_letters`` gives them one shape: stage, key (page or list), item (selector, step or null),
url, code, message, hint. Nothing is dropped on the way: a page refused by two gates has two rows. ``counted`` watches a run's rows
by code while they are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

COLUMNS = "stage string, key long, item string, url string, code string, message string, hint string"
CODES = ["url_not_allowed", "internal_error", "wait_selector_timeout", "wait_selector_unsupported"]


def _page_errors(df: DataFrame, stage: str, item=None) -> DataFrame:
    return df.filter(F.col("error").isNotNull()).select(
        F.lit(stage).alias("stage"), F.col("page_id").cast("long").alias("key"), (item if item is not None else F.lit(None)).cast("string").alias("item"), "url",
        F.col("error.code").alias("code"), F.col("error.message").alias("message"), F.col("error.hint").alias("hint"))


def dead_letters(refusals: DataFrame | None = None, parse: DataFrame | None = None, selectors: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """The union of the given error sources; at least one must be given.

    refusals / parse: (page_id, url, error); selectors: rows of ``gate.presence``; actions: rows of ``lint.check_actions``, of which those with a
    code count, and one row per list that is too long.
    """
    parts = []
    if refusals is not None:
        parts.append(_page_errors(refusals, "gate"))
    if parse is not None:
        parts.append(_page_errors(parse, "parse"))
    if selectors is not None:
        parts.append(_page_errors(selectors, "selector", F.col("selector")))
    if actions is not None:
        row = lambda df, item, code, text: df.select(
            F.lit("action").alias("stage"), F.col("page_id").cast("long").alias("key"), item.cast("string").alias("item"), F.lit(None).cast("string").alias("url"),
            code.alias("code"), text.alias("message"), F.lit(None).cast("string").alias("hint"))
        bad = actions.filter(F.col("code").isNotNull())
        parts.append(row(bad, F.col("step"), F.col("code"), F.concat(F.lit("Action "), F.col("step").cast("string"), F.lit(" ("), F.coalesce("type", F.lit("no type")), F.lit(") was refused: "),
                                                                     F.replace("code", F.lit("_"), F.lit(" ")), F.lit("."))))
        long = actions.filter("list_too_long").select("page_id").distinct()
        parts.append(row(long, F.lit(None), F.lit("too_many_actions"), F.lit("The action list has more than 20 actions.")))
    return reduce(DataFrame.unionByName, parts)


def counted(errors: DataFrame, name: str = "errors") -> tuple[DataFrame, Observation]:
    """The rows with an observation that counts them by code in the job that writes them."""
    watch = Observation(name)
    counts = [F.count_if(F.col("code") == c).alias(c) for c in CODES]
    return errors.observe(watch, F.count(F.lit(1)).alias("all"), *counts), watch
