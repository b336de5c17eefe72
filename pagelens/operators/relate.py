"""Tree relations as joins: J1 aria-labelledby, J2 labels, J3 form group, J4 scope
hint, J5 inherited visibility, J6 style values (inline + UA defaults), J10
descendant image alt, J11 live-region text, P14 css path, R1 accessible name.

Ancestor facts and texts come from one fold over each frame's arrays
(``pagelens.operators.ancestors``); "the first X below" is a running minimum
over the preorder. No relation reads a list of ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import JS_WS, collapse, cut, nullif_empty
from pagelens.operators.select import FRAME, covered
from pagelens.schema import LABELABLE_TAGS

from pagelens.functions.props import A  # noqa: E402

# Elements the UA style sheet renders with display:none.
UA_DISPLAY_NONE_TAGS = ["head", "script", "style", "title", "meta", "link", "template", "noscript", "base",
                        "datalist", "param", "rp", "area"]
# Inline-level elements whose box is empty when they hold neither text nor child elements.
INLINE_TAGS = ["a", "span", "label", "b", "i", "em", "strong", "small", "abbr", "code", "font", "u", "s",
               "sub", "sup", "q", "cite", "mark"]


# ---------------------------------------------------------------------------
# J6 style values
# ---------------------------------------------------------------------------
def inline_decl(prop: str) -> Column:
    """Last declaration of ``prop`` in the inline style attribute (lower-cased, no !important)."""
    style = F.lower(A["style"])
    vals = F.regexp_extract_all(style, F.lit(r"(?:^|;)\s*" + prop + r"\s*:\s*([^;]*)"), 1)
    v = F.try_element_at(vals, F.lit(-1))
    return F.when(F.contains(style, F.lit(prop)), nullif_empty(F.trim(F.regexp_replace(v, r"!\s*important\s*$", ""))))


def parse_float_zero(c: Column) -> Column:
    """JS ``parseFloat(v) === 0``."""
    num = F.regexp_extract(c, r"^\s*([+-]?(\d+\.?\d*|\.\d+))", 1)
    return F.coalesce(F.when(num != "", num.cast("double") == 0), F.lit(False))


def with_styles(el: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Declared display / visibility / opacity / cursor / position per element.

    Inline style wins over style-sheet rules unless the rule is !important;
    ``rules`` (optional) carries resolved style-sheet values per element.
    """
    props = ("display", "visibility", "opacity", "cursor", "position", "width", "height")
    out = el.withColumns({f"_in_{p}": inline_decl(p) for p in props})
    if rules is not None:
        out = out.join(rules, FRAME + ["eid"], "left")
        out = out.withColumns({
            f"st_{p}": F.when(F.coalesce(F.col(f"ss_{p}_imp"), F.lit(False)), F.col(f"ss_{p}"))
            .otherwise(F.coalesce(F.col(f"_in_{p}"), F.col(f"ss_{p}"))) for p in props})
        out = out.drop(*[c for c in out.columns if c.startswith("ss_")])
    else:
        out = out.withColumnsRenamed({f"_in_{p}": f"st_{p}" for p in props})
    out = out.drop(*[c for c in out.columns if c.startswith("_in_")])
    tag = F.col("tag")
    ua_none = (
        tag.isin(UA_DISPLAY_NONE_TAGS)
        | A["hidden"].isNotNull()
        | ((tag == "dialog") & A["open"].isNull())
    )
    hidden_input = (tag == "input") & (F.lower(A["type"]) == "hidden")
    display_none = hidden_input | F.coalesce(F.col("st_display") == "none", ua_none & F.col("st_display").isNull())
    zero = r"^\s*0(\.0*)?(px|em|rem|%)?\s*$"
    zero_box = (
        F.coalesce(F.col("st_width").rlike(zero) & F.col("st_height").rlike(zero), F.lit(False))
    )
    return out.withColumns({"dn_self": display_none, "op0_self": parse_float_zero(F.col("st_opacity")),
                            "zero_box_self": zero_box})


def with_inherited_flags(el: DataFrame) -> DataFrame:
    """J5 inherited flags (crossing shadow boundaries, like the traversal)."""
    doc_form = (F.col("tag") == "form") & (F.col("root_id") == 0)
    return el.withColumns({
        "dn_inh": covered(F.col("dn_self")),
        "op0_inh": covered(F.col("op0_self")),
        "hattr_inh": covered(A["hidden"].isNotNull()),
        "ah_inh": covered(F.coalesce(A["aria-hidden"] == "true", F.lit(False))),
        # running count of document forms (W3), same window sort
        "form_idx": F.when(doc_form, F.count(F.when(doc_form, 1)).over(
            Window.partitionBy(*FRAME).orderBy("eid").rowsBetween(Window.unboundedPreceding, 0)) - 1),
    })


# ---------------------------------------------------------------------------
# Ancestor facts and texts
# ---------------------------------------------------------------------------
def fact_flags(elements: DataFrame, subject: Column) -> DataFrame:
    """Marks subjects, the elements whose text some rule reads (``want``: 1 what a cut keeps, 2 whole) and empty-able live regions."""
    refs = (elements.filter(subject & A["aria-labelledby"].isNotNull())
            .select(*FRAME, "root_id", F.explode(F.split(A["aria-labelledby"], JS_WS)).alias("id")).distinct())
    hit = refs.join(id_index(elements), FRAME + ["root_id", "id"]).select(*FRAME, F.col("ref_eid").alias("eid"), F.lit(2).alias("_ref")).distinct()
    el = elements.join(hit, FRAME + ["eid"], "left")
    whole = F.col("_ref").isNotNull() | F.col("tag").isin("label", "title") | (subject & F.col("role").isNotNull())
    some = subject | F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6")
    return el.withColumns({"subject": subject, "want": F.when(whole, 2).when(some, 1).otherwise(0),
                           "live": subject & F.coalesce(F.col("role").isin("alert", "status"), F.lit(False))}).drop("_ref")


def form_group(form: Column, region: Column) -> Column:
    """J3 as a table of (condition, label), first that holds: the form by id, name or index, else the region by id, label or tag."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    kind = F.concat(region["tag"], F.when(region["role_form"], F.lit('[role="form"]')).otherwise(F.lit("")))
    caption = collapse(region["label"])
    rules = [
        (form.isNotNull() & has(form["id"]), F.concat(F.lit("form#"), form["id"])),
        (form.isNotNull() & has(form["name"]), F.concat(F.lit('form[name="'), form["name"], F.lit('"]'))),
        (form.isNotNull(), F.concat(F.lit("form:nth("), F.coalesce(form["idx"], F.lit(0)).cast("string"), F.lit(")"))),
        (region.isNotNull() & has(region["id"]), F.concat(kind, F.lit("#"), region["id"])),
        (region.isNotNull() & (caption != ""), F.concat(kind, F.lit('[aria-label="'), caption, F.lit('"]'))),
        (region.isNotNull(), kind)]
    return F.coalesce(*[F.when(condition, label) for condition, label in rules])


def ancestor_facts(folded: DataFrame) -> DataFrame:
    """One row per subject: css_path (P14), form_group (J3), scope_hint (J4), visibility / cursor of the nearest setters (J5 / F4),
    the closest label's text (J2), live_anc (J11) and its own ctext."""
    return folded.filter("subject").select(
        *FRAME, "eid", F.col("_css").alias("css_path"), form_group(F.col("form"), F.col("region")).alias("form_group"),
        "scope_hint", "visibility", "cursor", "parent_cursor", "cl_text", "live_anc", "ctext")


def with_text(df: DataFrame, texts: DataFrame, name: str, key: str) -> DataFrame:
    """Adds the collapsed text of the element ``key`` (null: none) as ``name``."""
    return df.join(texts.select(*FRAME, F.col("eid").alias(key), F.col("ctext").alias(name)), FRAME + [key], "left")


def first_below(elements: DataFrame, found: Column, name: str) -> DataFrame:
    """Adds ``name``: eid of the first element of the same tree strictly below that meets ``found``, from one backward sort."""
    w = Window.partitionBy(*FRAME, "root_id").orderBy(F.desc("eid")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.min(F.when(found, F.col("eid"))).over(w)
    return elements.withColumn("_after", after).withColumn(name, F.when(F.col("_after") <= F.col("last_eid"), F.col("_after"))).drop("_after")


# ---------------------------------------------------------------------------
# J1 / J2 label texts
# ---------------------------------------------------------------------------
def id_index(elements: DataFrame) -> DataFrame:
    """First element (tree order) per id within each root: getElementById."""
    return (elements.filter(F.coalesce(A["id"] != "", F.lit(False)))
            .groupBy(*FRAME, "root_id", A["id"].alias("id")).agg(F.min("eid").alias("ref_eid")))


def labelledby_text(subjects: DataFrame, ids: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of the aria-labelledby references, in list order, joined by a space."""
    refs = (subjects.filter(A["aria-labelledby"].isNotNull())
            .select(*FRAME, "eid", "root_id",
                    F.posexplode(F.split(A["aria-labelledby"], JS_WS)).alias("k", "id"))
            .filter(F.col("id") != ""))
    hit = with_text(refs.join(ids, FRAME + ["root_id", "id"]), texts, "rtext", "ref_eid")
    return (hit.groupBy(*FRAME, "eid")
            .agg(collapse(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "rtext"))),
                                                   lambda x: x["rtext"]), " ")).alias("lb_text")))


def labelable(df: DataFrame) -> Column:
    hidden_input = (F.col("tag") == "input") & F.coalesce(F.lower(A["type"]) == "hidden", F.lit(False))
    return F.col("tag").isin(LABELABLE_TAGS) & ~hidden_input


def first_label(elements: DataFrame, ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``labels[0]`` per labelable control: label[for] pointing at it, or a
    label without ``for`` whose first labelable descendant it is."""
    control = labelable(elements)
    by_for = (elements.filter((F.col("tag") == "label") & A["for"].isNotNull())
              .select(*FRAME, "root_id", F.col("eid").alias("l_eid"), A["for"].alias("id"))
              .join(ids, FRAME + ["root_id", "id"]).select(*FRAME, "l_eid", F.col("ref_eid").alias("eid"))
              .join(elements.filter(control).select(*FRAME, "eid"), FRAME + ["eid"]))
    relevant = elements.filter(control | (F.col("tag") == "label")).select(*FRAME, "root_id", "eid", "last_eid", "tag", "attrs")
    wrapped = (first_below(relevant, labelable(relevant), "_control")
               .filter((F.col("tag") == "label") & A["for"].isNull() & F.col("_control").isNotNull())
               .select(*FRAME, F.col("eid").alias("l_eid"), F.col("_control").alias("eid")))
    first = by_for.unionByName(wrapped.select(*by_for.columns)).groupBy(*FRAME, "eid").agg(F.min("l_eid").alias("label_eid"))
    return with_text(first, texts, "fl_text", "label_eid").drop("label_eid")


def first_img_alt(subjects: DataFrame, elements: DataFrame) -> DataFrame:
    """Alt of the first ``img[alt]`` below the element (same tree)."""
    image = (F.col("tag") == "img") & A["alt"].isNotNull()
    some = _subjects_and(subjects, elements, image)
    hit = first_below(some, image, "i_eid").filter(F.col("_subject") & F.col("i_eid").isNotNull()).select(*FRAME, "eid", "i_eid")
    alts = elements.filter(image).select(*FRAME, F.col("eid").alias("i_eid"), A["alt"].alias("img_alt"))
    return hit.join(alts, FRAME + ["i_eid"]).select(*FRAME, "eid", "img_alt")


def _subjects_and(subjects: DataFrame, elements: DataFrame, other: Column) -> DataFrame:
    """Subjects and the elements that meet ``other``, once each, of the frames that have such an element."""
    cols = [*FRAME, "root_id", "eid", "last_eid", "tag", "attrs"]
    having = elements.filter(other).select(*FRAME).distinct()
    rows = subjects.join(having, FRAME, "left_semi").select(*cols, F.lit(True).alias("_subject")).unionByName(elements.filter(other).select(*cols, F.lit(False).alias("_subject")))
    return rows.groupBy(*FRAME, "root_id", "eid").agg(F.first("last_eid").alias("last_eid"), F.first("tag").alias("tag"), F.first("attrs").alias("attrs"), F.bool_or("_subject").alias("_subject"))


def first_heading(subjects: DataFrame, elements: DataFrame, texts: DataFrame) -> DataFrame:
    """Collapsed text of the first h1-h6 below the element (same tree)."""
    heading = F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6")
    hit = (first_below(_subjects_and(subjects, elements, heading), heading, "h_eid")
           .filter(F.col("_subject") & F.col("h_eid").isNotNull()).select(*FRAME, "eid", "h_eid"))
    return with_text(hit, texts, "heading", "h_eid").drop("h_eid")


def has_img_below(subjects: DataFrame, elements: DataFrame) -> DataFrame:
    image = F.col("tag") == "img"
    hit = first_below(_subjects_and(subjects, elements, image), image, "i_eid").filter(F.col("_subject") & F.col("i_eid").isNotNull())
    return hit.select(*FRAME, "eid", F.lit(True).alias("has_img"))


def live_region_text(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """First non-empty text among the (at most 3) enclosing containers below body."""
    need = (nodes.filter(F.col("role").isin("alert", "status") & F.col("text_content").isNull())
            .select(*FRAME, "eid", F.posexplode("live_anc").alias("hop", "a_eid")))
    t = with_text(need, texts, "atext", "a_eid").filter(F.col("atext") != "")
    return (t.groupBy(*FRAME, "eid").agg(F.min_by("atext", "hop").alias("live_text"))
            .withColumn("live_text", cut(F.col("live_text"), 120)))
