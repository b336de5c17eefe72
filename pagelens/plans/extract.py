"""The extraction plan: pages -> elements -> subjects -> nodes -> locators -> extracts.

Execution shape (see README "Plan"):
  1. parse (narrow, Python, Arrow batches) -> one hash exchange on page_id,
     persisted: every later join / window / aggregate is keyed by page_id
     first and reuses that partitioning;
  2. walk / style / inherited-flag windows: one sort per frame;
  3. subjects (elements that can be nodes or locator matches) get their
     ancestor facts and texts from one fold over each frame's arrays;
  4. candidate keys are de-duplicated per frame before matching; the
     value-containment joins are salted by frame size;
  5. the nested extract groups the nodes of a page, at most ``max_nodes`` if set.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property as _own

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import props as P
from pagelens.functions.text import collapse, cut, nullif_empty
from pagelens.functions.url import resolve_href
from pagelens.operators import assemble, frames as FR, locate as L, relate as R
from pagelens.operators.ancestors import fold_frames
from pagelens.operators.gate import split_allowed
from pagelens.operators.select import FRAME, included, with_walk_flags
from pagelens.schema import (
    DEFAULT_MAX_NODES,
    MAX_DEPTH,
    LIVE_REGION_ROLES,
    NOTE_CLICK_TARGET,
    NOTE_CLOSED_SHADOW,
    NOTE_LIVE_REGION,
)
from pagelens.sources.pages import parse_pages, split_parsed

SUBJECT_TAGS = ["input", "button", "a", "select", "textarea", "label", "option", "fieldset", "output", "legend",
                "dialog", "meter", "progress", "area", "iframe", "frame"]

# columns of the work tables of subjects and nodes
SUBJECT_BASE = [*FRAME, "eid", "last_eid", "root_id", "tag", "attrs", "in_shadow", "role", "test_attr", "walked", "closed_host",
                "st_display", "zero_box_self", "dn_inh", "op0_inh", "hattr_inh", "ah_inh"]
SUBJECT_COLUMNS = [*FRAME, "eid", "tag", "attrs", "in_shadow", "role", "test_attr", "walked", "closed_host", "css_path", "form_group", "scope_hint",
                   "live_anc", "lb_text", "fl_text", "cl_text", "aria_label_c", "label_text", "is_form_field", "generated_id", "included", "accessible_name",
                   "name_full", "text_content", "is_visible", "box_shown", "role_hidden", "p_type", "p_href", "p_required", "p_disabled", "p_checked",
                   "click_target", "heading", "heading_ok"]
NODE_COLUMNS = [*FRAME, "eid", "kind", "tag", "role", "in_shadow", "css_path", "form_group", "scope_hint", "accessible_name", "text_content", "placeholder",
                "p_type", "p_href", "p_required", "p_disabled", "p_checked", "is_visible", "context_note", "candidates"]


@dataclass(frozen=True)
class ExtractOptions:
    include_hidden: bool = True
    max_nodes: int | None = DEFAULT_MAX_NODES  # None: no limit
    max_depth: int | None = MAX_DEPTH          # None: no limit
    include_click_targets: bool = False
    viewport: str = "desktop"
    match: str = "contains"          # locator match mode: "contains" or "exact"
    after_actions: int | None = None  # number of declared actions before the snapshot
    allowed_hosts: tuple[str, ...] | None = None  # None: no gate; an empty list refuses every page


def persist(df: DataFrame, by: str = "page_id") -> DataFrame:
    """Materialise a reused intermediate now and cut its lineage.

    It is written as compressed Parquet under the cluster's checkpoint
    directory (``spark.checkpoint.dir``), so a lost executor never re-runs the
    parse or a match join, and later plans start from a small leaf of which
    they read only the columns they use. Rows are bucketed by ``by``, if they
    have it: joins / windows / aggregates keyed by it first then add no
    exchange (nor does the write, where the rows are dealt by it already).
    A bucket is one file in document order, so those keyed by page, frame and
    element add no sort either (the write sorts by bucket in any case).
    """
    from pagelens.session import ensure_checkpoint_dir
    spark = df.sparkSession
    name = f"pagelens_work_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    if by not in df.columns:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, by)
    order = [c for c in dict.fromkeys([by, *FRAME, "eid"]) if c in df.columns]
    rows.write.bucketBy(n, by).sortBy(*order).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


class cached_property(_own):
    """A table built when it is first read; a variant run takes it from its base run, where its options do not influence it."""

    def __get__(self, run, owner=None):
        if run is not None and self.attrname in run.shared:
            return getattr(run.base, self.attrname)
        return super().__get__(run, owner)


class Extraction:
    """All tables of one extraction run, built lazily."""

    base: Extraction | None = None
    shared: frozenset[str] = frozenset()

    def __init__(self, pages: DataFrame, opts: ExtractOptions | None = None, style_rules: bool = True):
        self.opts = opts or ExtractOptions()
        self.spark = pages.sparkSession
        self.refusals = None
        if self.opts.allowed_hosts is not None:  # S2: refused pages never reach the parse
            pages, self.refusals = split_allowed(pages, self.opts.allowed_hosts)
        self.pages = pages
        self.n_parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.use_style_rules = style_rules

    # stages an option first influences; everything upstream is shared by with_options()
    _SHARED_UNTIL = {
        "match": ["parsed", "_split", "css_rules", "style_rules", "elements", "frame_tree", "frame_base", "element_texts", "subjects",
                  "raw_nodes", "match_universe", "candidates", "elements_with_hosts", "page_urls"],
        "max_nodes": ["parsed", "_split", "css_rules", "style_rules", "elements", "frame_tree", "frame_base", "element_texts", "subjects",
                      "raw_nodes", "match_universe", "candidates", "match_pairs", "locators", "resolved",
                      "elements_with_hosts", "page_urls"],
        "max_depth": ["parsed", "_split", "css_rules", "style_rules", "page_urls"],
        "viewport": ["parsed", "_split", "page_urls"],
        "include_hidden": ["parsed", "_split", "css_rules", "style_rules", "elements", "frame_tree", "frame_base", "element_texts", "subjects",
                           "raw_nodes", "match_universe", "candidates", "match_pairs", "locators", "resolved", "nodes",
                           "elements_with_hosts", "page_urls"],
        "after_actions": ["parsed", "_split", "css_rules", "style_rules", "elements", "frame_tree", "frame_base", "element_texts", "subjects",
                          "raw_nodes", "match_universe", "candidates", "match_pairs", "locators", "resolved", "nodes",
                          "kept_nodes", "elements_with_hosts", "page_urls"],
    }

    def with_options(self, **changes) -> "Extraction":
        """A variant run that reuses every materialised table the changed options
        do not influence (e.g. exact matching re-runs only the match join)."""
        from dataclasses import replace
        new = Extraction(self.pages, replace(self.opts, allowed_hosts=None, **changes), style_rules=self.use_style_rules)
        new.refusals = self.refusals
        shared = None
        for k in changes:
            keep = set(self._SHARED_UNTIL.get(k, []))
            shared = keep if shared is None else shared & keep
        new.base, new.shared = self, frozenset(shared or ())
        return new

    # ----------------------------------------------------------------- sources
    @cached_property
    def parsed(self) -> DataFrame:
        return persist(parse_pages(self.pages).repartition(self.n_parts, "page_id"))

    @cached_property
    def _split(self):
        return split_parsed(self.parsed)

    @property
    def elements_raw(self) -> DataFrame:
        return self._split[0]

    @property
    def frames_raw(self) -> DataFrame:
        return self._split[1]

    @property
    def parse_errors(self) -> DataFrame:
        return self._split[2]

    @property
    def errors(self) -> DataFrame:
        """Refused and unparsable pages of this run."""
        from pagelens.operators.errors import dead_letters
        return dead_letters(refusals=self.refusals, parse=self.parse_errors)

    @cached_property
    def page_urls(self) -> DataFrame:
        return persist(self.pages.select("page_id", "url"))  # rendered pages: not rendered again for every reader

    @cached_property
    def css_rules(self) -> DataFrame | None:
        """The compiled rules that set a relevant property; None when no page has one."""
        from pagelens.operators.styles import css_declarations, css_rules
        declarations = persist(css_declarations(self.elements_raw, self.frames_raw, self.opts.viewport))
        return None if declarations.isEmpty() else persist(css_rules(declarations))

    @property
    def style_notes(self) -> DataFrame:
        """Selectors of relevant rules that are not evaluated, with the reason."""
        from pagelens.operators.styles import RULE, style_notes
        if self.css_rules is None:
            none = ", ".join(f"{c} long" for c in [*FRAME, "root_id", *RULE])
            return self.spark.createDataFrame([], f"{none}, selector string, reason string")
        return style_notes(self.css_rules)

    @cached_property
    def style_rules(self) -> DataFrame | None:
        from pagelens.operators.styles import stylesheet_values
        if not self.use_style_rules or self.css_rules is None:
            return None
        return stylesheet_values(self.elements_raw, self.css_rules, persist)

    @cached_property
    def elements(self) -> DataFrame:
        """Every element with walk flags, style values and inherited visibility flags."""
        el = with_walk_flags(self.elements_raw, self.opts.max_depth)
        el = R.with_styles(el, self.style_rules)
        el = R.with_inherited_flags(el)
        return persist(el)

    @cached_property
    def frame_tree(self) -> DataFrame:
        """Every frame of every page, with the parsed frame that is its document."""
        frames = FR.frame_map(self.elements_raw, self.frames_raw, self.page_urls, persist)
        return persist(FR.frame_tree(frames, self.elements_with_hosts, self.page_urls).repartition(self.n_parts, "page_id"))

    @cached_property
    def frame_base(self) -> DataFrame:
        return FR.base_urls(self.elements_raw, self.frames_raw, self.page_urls)

    # ---------------------------------------------------------------- subjects
    @cached_property
    def _subject_rule(self):
        """(elements with role and test attribute, condition of the elements that can become nodes or locator matches)."""
        A = F.col("attrs")
        el = self.elements.withColumns({"role": P.role(), "test_attr": P.test_attr()})
        cond = (F.col("role").isNotNull() | F.col("tag").isin(SUBJECT_TAGS) | F.col("test_attr").isNotNull()
                | A["tabindex"].isNotNull() | A["aria-label"].isNotNull() | A["aria-labelledby"].isNotNull()
                | F.col("closed_host") | A["data-testid"].isNotNull())
        if self.opts.include_click_targets:
            cond = cond | F.col("walked")
        return el, F.coalesce(cond, F.lit(False))

    @cached_property
    def element_texts(self) -> DataFrame:
        """Ancestor facts of the subjects and the texts that rules read, one fold per frame."""
        el, subject = self._subject_rule
        return persist(fold_frames(R.fact_flags(el, subject), self.frames_raw).repartition(self.n_parts, "page_id"))

    @cached_property
    def subjects(self) -> DataFrame:
        """Elements that can become nodes or locator matches, with names and properties."""
        A = F.col("attrs")
        el, cond = self._subject_rule
        # every side table below derives from this one materialised base, so no
        # plan embeds another copy of the growing subject plan
        base = persist(el.filter(cond).select(*SUBJECT_BASE))
        keys = FRAME + ["eid"]
        folded = self.element_texts
        facts = R.ancestor_facts(folded)
        ids = R.id_index(self.elements)
        lb = R.labelledby_text(base, ids, folded)
        fl = R.first_label(self.elements, ids, folded)
        img = R.first_img_alt(base, self.elements)
        s = base.join(facts, keys, "left").join(lb, keys, "left").join(fl, keys, "left").join(img, keys, "left")
        if self.opts.include_click_targets:
            s = s.join(R.first_heading(base, self.elements, folded), keys, "left")
            s = s.join(R.has_img_below(base, self.elements), keys, "left")
        s = s.join(self.frame_base, FRAME, "left")

        tag = F.col("tag")
        itype = P.input_type_attr()
        label_text = F.coalesce(nullif_empty(F.col("lb_text")),
                                F.when(R.labelable(s), nullif_empty(F.col("fl_text"))),
                                nullif_empty(F.col("cl_text")))
        aria_label_c = collapse(A["aria-label"])

        def name(text_col):
            return F.coalesce(
                nullif_empty(aria_label_c),
                label_text,
                F.when(tag == "input",
                       F.when(itype.isin("button", "submit", "reset"), nullif_empty(collapse(A["value"])))
                       .when(itype == "image", nullif_empty(collapse(A["alt"]))))
                .when(tag.isin("select", "textarea"), F.lit(None).cast("string"))
                .otherwise(F.coalesce(nullif_empty(text_col), nullif_empty(collapse(F.col("img_alt"))))),
            )

        vis_hidden = F.coalesce(F.col("visibility").isin("hidden", "collapse"), F.lit(False))
        empty_inline = (tag.isin(R.INLINE_TAGS) & F.coalesce(~F.col("st_display").isin("block", "inline-block", "flex",
                                                                                       "grid", "inline-flex"), F.lit(True))
                        & (F.col("ctext") == "") & (F.col("last_eid") == F.col("eid")))
        zero_box = F.col("zero_box_self") | empty_inline | (tag == "option")
        flags = F.col("dn_inh") | F.col("op0_inh") | F.col("hattr_inh") | F.col("ah_inh")
        # one projection (one analysis pass) for all derived columns
        s = s.withColumns({
            "aria_label_c": aria_label_c,
            "label_text": label_text,
            "is_form_field": P.is_form_field(),
            "generated_id": P.is_generated_id(A["id"]),
            "included": included(tag, A, F.col("role"), F.col("test_attr")),
            "accessible_name": name(cut(F.col("ctext"), 120)),
            "name_full": name(F.col("ctext")),
            "text_content": F.when(~P.is_form_field(), nullif_empty(cut(F.col("ctext"), 120))),
            "is_visible": ~(flags | vis_hidden | zero_box),
            "box_shown": ~(F.col("dn_inh") | vis_hidden | F.col("zero_box_self")),
            "role_hidden": F.col("dn_inh") | F.col("hattr_inh") | F.col("ah_inh") | vis_hidden,
            "p_type": P.prop_type(),
            "_href": F.when((tag == "a") & A["href"].isNotNull(), resolve_href(A["href"], F.col("base_url"))),
            "p_required": P.prop_required(),
            "p_disabled": P.prop_disabled(),
            "p_checked": P.prop_checked(),
        })
        s = s.withColumn("p_href", F.when(~F.col("_href").rlike(r"(?i)^javascript:"), cut(F.col("_href"), 300))) \
             .drop("_href")
        if self.opts.include_click_targets:
            pointer = F.coalesce(F.col("cursor") == "pointer", F.lit(False))
            anc_pointer = F.coalesce(F.col("parent_cursor") == "pointer", F.lit(False))
            content = (F.col("ctext") != "") | F.coalesce(F.col("has_img"), F.lit(False))
            s = s.withColumns({
                "click_target": ~F.col("included") & pointer & ~anc_pointer & content,
                "heading_ok": F.coalesce((F.col("heading") != "") & (F.length("heading") <= 80), F.lit(False))})
        else:
            s = s.withColumn("click_target", F.lit(False))
        # only what later rules read: sorts and joins carry the rest no further
        return persist(s.select(*[c for c in SUBJECT_COLUMNS if c in s.columns]))

    # ------------------------------------------------------------------- nodes
    @cached_property
    def raw_nodes(self) -> DataFrame:
        """F1/F2/F5/F7 (+F4): nodes of every parsed frame before the budget, with candidates."""
        s = self.subjects.filter(F.col("walked") & (F.col("included") | F.col("closed_host") | F.col("click_target")))
        s = s.join(R.live_region_text(s.filter(F.col("role").isin(LIVE_REGION_ROLES)).select(
            *FRAME, "eid", "role", "text_content", "live_anc"), self.element_texts), FRAME + ["eid"], "left")
        live = F.col("role").isin(LIVE_REGION_ROLES) & F.col("text_content").isNull() & F.col("live_text").isNotNull()
        ct = F.col("click_target") if self.opts.include_click_targets else None
        note = F.concat_ws(" ", L.candidate_note(),
                           F.when(F.col("click_target"), F.lit(NOTE_CLICK_TARGET)),
                           F.when(live, F.lit(NOTE_LIVE_REGION)))
        s = s.withColumns({
            "kind": F.when(F.col("closed_host"), F.lit("shadow_boundary")).otherwise(F.lit("element")),
            "candidates": L.candidate_array(ct),
            "text_content": F.when(live, F.col("live_text")).otherwise(F.col("text_content")),
            "context_note": F.when(F.col("closed_host"), F.lit(NOTE_CLOSED_SHADOW)).otherwise(F.nullif(note, F.lit(""))),
            "placeholder": F.col("attrs")["placeholder"],
        })
        return persist(s.select(*NODE_COLUMNS))

    @cached_property
    def match_universe(self) -> dict:
        el = self.elements
        A = F.col("attrs")
        eq_keys = F.array(
            F.when(A["data-testid"] != "", F.concat(F.lit("test-id\u0000"), A["data-testid"])),
            F.when(A["id"] != "", F.concat(F.lit("id\u0000"), A["id"])),
            F.when(A["data-cy"].isNotNull(), F.concat(F.lit("data-cy\u0000"), A["data-cy"])),
            F.when(A["data-qa"].isNotNull(), F.concat(F.lit("data-qa\u0000"), A["data-qa"])),
            F.when(A["data-test"].isNotNull(), F.concat(F.lit("data-test\u0000"), A["data-test"])),
        )
        attr_index = (el.filter(A["data-testid"].isNotNull() | A["id"].isNotNull() | A["data-cy"].isNotNull()
                                | A["data-qa"].isNotNull() | A["data-test"].isNotNull())
                      .select(*FRAME, F.col("eid").alias("m_eid"), F.explode(eq_keys).alias("m_key"))
                      .filter(F.col("m_key").isNotNull()))
        s = self.subjects
        roles = (s.filter(F.col("role").isNotNull() & ~F.col("role_hidden"))
                 .select(*FRAME, F.col("eid").alias("m_eid"), F.col("role").alias("m_role"),
                         F.coalesce(F.col("name_full"), F.lit("")).alias("name"))
                 .withColumn("name_l", F.lower("name")))
        lab_vals = F.array(
            nullif_empty(F.col("aria_label_c")), nullif_empty(F.col("lb_text")),
            F.when(R.labelable(s), nullif_empty(F.col("fl_text"))),
            F.when(R.labelable(s), nullif_empty(F.col("cl_text"))))
        labels = (s.select(*FRAME, F.col("eid").alias("m_eid"), F.explode(lab_vals).alias("lab"))
                  .filter(F.col("lab").isNotNull()).distinct().withColumn("lab_l", F.lower("lab")))
        placeholders = (el.filter(A["placeholder"].isNotNull())
                        .select(*FRAME, F.col("eid").alias("m_eid"), collapse(A["placeholder"]).alias("ph"))
                        .withColumn("ph_l", F.lower("ph")))
        itype = F.lower(A["type"])
        shown = (el.filter((F.col("tag") == "input") & itype.isin("button", "submit") & A["value"].isNotNull())
                 .select(*FRAME, "eid", collapse(A["value"]).alias("mt")).filter(F.col("mt") != ""))

        def text_pairs(keys: DataFrame, mode: str) -> DataFrame:
            from pagelens.operators.textmatch import text_pairs
            return text_pairs(keys, el, self.frames_raw, shown, mode)

        paths = (self.raw_nodes.filter(F.col("css_path") != "")
                 .select(*FRAME, F.col("css_path").alias("value"), F.col("eid").alias("m_eid")))
        return {"attr_index": attr_index, "roles": roles, "labels": labels, "placeholders": placeholders,
                "text_pairs": text_pairs, "paths": paths}

    @cached_property
    def candidates(self) -> DataFrame:
        """(node, rank, candidate) rows."""
        return persist(L.explode_candidates(self.raw_nodes))

    @cached_property
    def match_pairs(self) -> DataFrame:
        """(candidate key, matched element) pairs."""
        keys = self.candidates.select(*FRAME, *L.CKEY).distinct()
        return persist(L.match_pairs(keys, self.match_universe, self.opts.match, self.n_parts, materialize=persist))

    @cached_property
    def locators(self) -> DataFrame:
        """W4/W5/B1/J9 per node."""
        return L.resolve(self.candidates, self.match_pairs, self.raw_nodes, persist)

    @cached_property
    def resolved(self) -> DataFrame:
        """Nodes of every page with their locators, one row per node and frame that shows it. Metadata, counts and documents
        read them several times, so they are written once."""
        from pagelens.session import together
        nodes = self.raw_nodes  # what the next two tables share is written by now
        tree, locators = together(lambda: self.frame_tree, lambda: self.locators)
        n = nodes.join(locators, FRAME + ["eid"], "left")
        n = n.withColumn("primary_locator", F.coalesce(F.col("primary_locator"), L.no_candidate_locator())) \
             .withColumn("fallback_locators", F.coalesce(F.col("fallback_locators"),
                                                          F.array().cast("array<struct<strategy:string,playwright:string,is_unique:boolean,disambiguation:string>>")))
        props = F.struct(
            F.col("p_type").alias("type"), F.col("placeholder"),
            F.col("text_content").alias("text_content"), F.col("p_href").alias("href"),
            F.col("p_required").alias("is_required"), F.col("p_disabled").alias("is_disabled"),
            F.col("p_checked").alias("is_checked"), F.col("is_visible").alias("is_visible"))
        n = FR.placed(tree, n, ["frame_key", "frame_path"]).select(
            "page_id", "frame_id", *FR.SOURCE, "eid", "frame_key", F.col("eid").alias("doc_order"), "kind", "tag", "role",
            "in_shadow", "frame_path", "form_group", "accessible_name", "scope_hint", "css_path",
            "primary_locator", "fallback_locators", props.alias("properties"), "context_note",
            "primary_count", "primary_nth")
        return persist(n)

    @cached_property
    def nodes(self) -> DataFrame:
        """Resolved nodes of every page with their place in the node budget."""
        return assemble.cap_nodes(self.resolved, self.opts.max_nodes)

    @cached_property
    def kept_nodes(self) -> DataFrame:
        n = self.nodes.filter(F.col("within_budget"))
        shown = self.subjects.filter(F.col("tag").isin("iframe", "frame")).select(*FRAME, F.col("eid").alias("host_eid"), "box_shown")
        markers = assemble.cross_origin_markers(self.frame_tree, self.elements_with_hosts, shown)
        if markers is not None:
            n = n.unionByName(markers, allowMissingColumns=True)
        if not self.opts.include_hidden:
            n = n.filter((F.col("kind") == "cross_origin_frame") | F.col("properties")["is_visible"])
        return n

    @cached_property
    def elements_with_hosts(self) -> DataFrame:
        return FR.frame_hosts(self.elements)

    @cached_property
    def page_meta(self) -> DataFrame:
        """Page metadata with ordered notes."""
        return assemble.page_metadata(self, self.opts)

    @cached_property
    def extracts(self) -> DataFrame:
        """One nested row per page."""
        return assemble.extracts(self.kept_nodes, self.page_meta)


def extract(pages: DataFrame, **kwargs) -> Extraction:
    style_rules = kwargs.pop("style_rules", True)
    return Extraction(pages, ExtractOptions(**kwargs), style_rules=style_rules)
