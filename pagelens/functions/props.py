"""Per-element scalar projections P3-P11 as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import collapse, nullif_empty
from pagelens.schema import DISABLED_PROPERTY_TAGS, FORM_FIELD_TAGS, GENERATED_ID_PATTERN, INPUT_TYPES, TEST_ATTRIBUTES

class _Attrs:
    """``A["name"]``: lazily built ``attrs['name']`` column (no session needed at import)."""

    def __getitem__(self, key: str) -> Column:
        return F.col("attrs")[key]


A = _Attrs()


def has(name: str) -> Column:
    return A[name].isNotNull()


def test_attr() -> Column:
    """First non-empty test attribute, as struct(attr, value)."""
    out = F.lit(None).cast("struct<attr:string,value:string>")
    for name in reversed(TEST_ATTRIBUTES):
        out = F.when(F.coalesce(A[name] != "", F.lit(False)),
                     F.struct(F.lit(name).alias("attr"), A[name].alias("value"))).otherwise(out)
    return out


def input_type_attr() -> Column:
    """Lower-cased ``type`` attribute, default "text" (used by role and name rules)."""
    return F.lower(F.coalesce(nullif_empty(A["type"]), F.lit("text")))


def role() -> Column:
    """Explicit role (collapsed, first token) else the implicit mapping."""
    explicit = nullif_empty(F.split(collapse(A["role"]), " ").getItem(0))
    t = input_type_attr()
    size = F.expr("try_cast(trim(attrs['size']) as int)")
    implicit = (
        F.when(F.col("tag") == "button", "button")
        .when(F.col("tag") == "dialog", "dialog")
        .when(F.col("tag") == "a", F.when(has("href"), "link"))
        .when(F.col("tag") == "select", F.when(has("multiple") | (F.coalesce(size, F.lit(0)) > 1), "listbox")
              .otherwise("combobox"))
        .when(F.col("tag") == "textarea", "textbox")
        .when(F.col("tag") == "option", "option")
        .when(F.col("tag") == "input",
              F.when(t == "checkbox", "checkbox").when(t == "radio", "radio")
              .when(t.isin("button", "submit", "reset", "image"), "button")
              .when(t == "range", "slider").when(t == "number", "spinbutton")
              .when(t == "search", "searchbox").when(t == "hidden", F.lit(None))
              .otherwise("textbox"))
    )
    return F.coalesce(explicit, implicit)


def is_generated_id(c: Column) -> Column:
    """P5."""
    return F.coalesce(c.rlike(GENERATED_ID_PATTERN), F.lit(False))


def is_form_field() -> Column:
    return F.col("tag").isin(FORM_FIELD_TAGS)


def prop_type() -> Column:
    """IDL type for input / button, raw non-empty attribute otherwise."""
    lt = F.lower(A["type"])
    return (
        F.when(F.col("tag") == "input", F.when(lt.isin(INPUT_TYPES), lt).otherwise(F.lit("text")))
        .when(F.col("tag") == "button", F.when(lt.isin("submit", "reset", "button"), lt).otherwise(F.lit("submit")))
        .otherwise(nullif_empty(A["type"]))
    )


def prop_required() -> Column:
    """P9."""
    return (
        F.when(is_form_field(), has("required"))
        .when(has("aria-required"), A["aria-required"] == "true")
    )


def prop_disabled() -> Column:
    """P10: own ``disabled`` (not inherited from fieldset) or aria-disabled."""
    aria_true = F.coalesce(A["aria-disabled"] == "true", F.lit(False))
    return (
        F.when(F.col("tag").isin(DISABLED_PROPERTY_TAGS), has("disabled") | aria_true)
        .when(has("aria-disabled"), aria_true)
    )


def prop_checked() -> Column:
    """P11."""
    it = prop_type()
    return (
        F.when(F.col("tag") == "input", F.when(it.isin("checkbox", "radio"), has("checked")))
        .when(A["aria-checked"] == "true", F.lit(True))
        .when(A["aria-checked"] == "false", F.lit(False))
    )
