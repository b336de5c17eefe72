"""Filters and walk predicates: F1 inclusion, F2 skipped subtrees, F5 depth cap,
F7 closed shadow hosts, and the inherited-flag windows used by J5.

Inherited "any ancestor-or-self has X" flags are computed without exploding
ancestor paths: eids are preorder and subtrees are the intervals
``[eid, last_eid]``, so an element lies inside some X-subtree exactly when the
running maximum of ``last_eid`` over preceding X-elements reaches its eid.
One sort per frame (reusing the page_id partitioning) serves all flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.schema import (
    FORM_ASSOCIATED_TAGS,
    INCLUDED_ROLES,
    NATIVE_INTERACTIVE_TAGS,
    SKIP_TAGS,
)

FRAME = ["page_id", "frame_id"]


def frame_window():
    return Window.partitionBy(*FRAME).orderBy("eid")


def covered(flag: Column, strict: bool = False) -> Column:
    """True when the element lies in the subtree of an element where ``flag`` holds
    (itself included unless ``strict``)."""
    w = frame_window()
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    reach = F.max(F.when(flag, F.col("last_eid"))).over(frame)
    return F.coalesce(reach >= F.col("eid"), F.lit(False))


def with_walk_flags(elements: DataFrame, max_depth: int | None) -> DataFrame:
    """Adds ``walked`` (the traversal visits the element), ``depth_hit`` (the
    element is where the depth cap stops the traversal, never without a cap) and ``closed_host``."""
    in_skip = covered(F.col("tag").isin(SKIP_TAGS))
    under_closed = covered(F.col("shadow_mode") == "closed", strict=True)
    reachable = ~in_skip & ~under_closed
    return (
        elements.withColumn("_reach", reachable)
        .withColumns({
            "walked": F.col("_reach") & (F.col("depth") <= max_depth if max_depth is not None else F.lit(True)),
            "depth_hit": F.col("_reach") & (F.col("depth") == max_depth + 1 if max_depth is not None else F.lit(False)),
            "closed_host": F.coalesce(F.col("shadow_mode") == "closed", F.lit(False)),
        })
        .drop("_reach")
    )


def tabindex_nonneg(attrs: Column) -> Column:
    """JS ``parseInt(tabindex, 10) >= 0`` (leading whitespace, sign, digit prefix; -0 counts)."""
    lead = r"^[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]*([+-]?)(\d+)"
    m = F.regexp_extract(attrs["tabindex"], lead, 2)
    sign = F.regexp_extract(attrs["tabindex"], lead, 1)
    return attrs["tabindex"].isNotNull() & (m != "") & ((sign != "-") | (F.regexp_replace(m, "0", "") == ""))


def included(tag: Column, attrs: Column, role: Column, test_attr: Column) -> Column:
    """any of test attribute, native interactive tag, form-associated tag with id,
    listed role, non-negative tabindex."""
    has_id = F.coalesce(attrs["id"] != "", F.lit(False))
    return (
        test_attr.isNotNull()
        | tag.isin(NATIVE_INTERACTIVE_TAGS)
        | (tag.isin(FORM_ASSOCIATED_TAGS) & has_id)
        | F.coalesce(role.isin(INCLUDED_ROLES), F.lit(False))
        | tabindex_nonneg(attrs)
    )
