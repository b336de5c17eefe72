"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver's tables (or data Spark derives from them) and
runs over whole tables. One ``Extraction`` per (session, directory, options)
is shared by the queries that need it, so the parse and the match joins run
once per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.operators import gate, report
from pagelens.operators.frames import SOURCE
from pagelens.operators.select import FRAME
from pagelens.plans.extract import ExtractOptions, Extraction, persist
from pagelens.session import configure
from pagelens.sources.pages import read_pages

# pages are extracted as a whole; only the cap queries set the limits
WHOLE = {"max_nodes": None, "max_depth": None}
_CACHE: dict = {}


def extraction(spark: SparkSession, sf_dir: str, **opts) -> Extraction:
    """Shared extraction per (session, directory, options); option variants
    reuse the default run's materialised upstream tables."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(opts.items())))
    ex = _CACHE.get(key)
    if ex is None:
        configure(spark)
        if opts:
            ex = extraction(spark, sf_dir).with_options(**opts)
        else:
            ex = Extraction(read_pages(spark, sf_dir), ExtractOptions(**WHOLE))
        _CACHE[key] = ex
    return ex


def _link_nodes(spark, sf_dir) -> DataFrame:
    n = extraction(spark, sf_dir).nodes.filter(F.col("within_budget"))
    w = Window.partitionBy("page_id").orderBy("frame_key", "eid")
    return n.withColumn("node_no", F.row_number().over(w))


# ---------------------------------------------------------------------------
# pages direct
# ---------------------------------------------------------------------------
def q_src_tag_counts(spark, sf_dir):
    """S3: elements per page and tag."""
    el = extraction(spark, sf_dir).elements
    return el.groupBy("page_id", "tag").agg(F.count(F.lit(1)).cast("long").alias("n"))


def q_src_walked_counts(spark, sf_dir):
    """elements the traversal visits, per page."""
    el = extraction(spark, sf_dir).elements
    return el.groupBy("page_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_elements"),
        F.count_if(F.col("walked")).cast("long").alias("n_walked"))


def q_sel_link_nodes(spark, sf_dir):
    """Node records of every page."""
    n = _link_nodes(spark, sf_dir)
    return n.select("page_id", F.col("node_no").cast("long").alias("node_no"), "kind", "tag", "role",
                    "accessible_name", F.col("properties.is_visible").alias("is_visible"))


def q_prop_text(spark, sf_dir):
    """text_content and type of every node."""
    n = _link_nodes(spark, sf_dir)
    return n.select("page_id", F.col("node_no").cast("long").alias("node_no"),
                    F.col("properties.text_content").alias("text_content"), F.col("properties.type").alias("type"))


def q_prop_href(spark, sf_dir):
    """Absolute href of every link node."""
    n = _link_nodes(spark, sf_dir)
    return n.select("page_id", F.col("node_no").cast("long").alias("node_no"), F.col("properties.href").alias("href"))


def q_rel_css_path(spark, sf_dir):
    """Structural css path of every node."""
    n = _link_nodes(spark, sf_dir)
    return n.select("page_id", F.col("node_no").cast("long").alias("node_no"), "css_path")


def _placed_candidates(ex: Extraction, nodes: DataFrame) -> DataFrame:
    """Candidates of nodes, which are ranked once per parsed frame."""
    nn = nodes.select(*SOURCE, "eid", "page_id", "node_no")
    return ex.candidates.withColumnsRenamed(dict(zip(FRAME, SOURCE))).join(nn, [*SOURCE, "eid"])


def q_loc_candidates(spark, sf_dir):
    """Ranked locator candidates."""
    ex = extraction(spark, sf_dir)
    c = _placed_candidates(ex, _link_nodes(spark, sf_dir))
    return c.select("page_id", F.col("node_no").cast("long").alias("node_no"), F.col("rank").cast("long").alias("rank"),
                    "strategy", "value", "last_resort")


def q_loc_expression(spark, sf_dir):
    """Expression of each candidate."""
    from pagelens.operators.locate import expression
    ex = extraction(spark, sf_dir)
    c = _placed_candidates(ex, _link_nodes(spark, sf_dir))
    return c.select("page_id", F.col("node_no").cast("long").alias("node_no"), F.col("rank").cast("long").alias("rank"),
                    expression(F.col("strategy"), F.col("value"), F.col("role")).alias("playwright"))


def q_loc_match_contains(spark, sf_dir):
    """Match count of every distinct role candidate (contains mode)."""
    ex = extraction(spark, sf_dir)
    keys = ex.candidates.filter(F.col("strategy") == "role").select(*FRAME, "role", "value").distinct()
    pairs = ex.match_pairs.filter(F.col("strategy") == "role")
    cnt = pairs.groupBy(*FRAME, "role", "value").agg(F.count(F.lit(1)).alias("n"))
    return (keys.join(cnt, FRAME + ["role", "value"], "left")
            .select("page_id", "role", "value", F.coalesce("n", F.lit(0)).cast("long").alias("match_count")))


def q_loc_match_exact(spark, sf_dir):
    """J7 / A1 exact mode: role candidates counted by equal names."""
    ex = extraction(spark, sf_dir, match="exact")
    keys = ex.candidates.filter(F.col("strategy") == "role").select(*FRAME, "role", "value").distinct()
    pairs = ex.match_pairs.filter(F.col("strategy") == "role")
    cnt = pairs.groupBy(*FRAME, "role", "value").agg(F.count(F.lit(1)).alias("n"))
    return (keys.join(cnt, FRAME + ["role", "value"], "left")
            .select("page_id", "role", "value", F.coalesce("n", F.lit(0)).cast("long").alias("match_count")))


def q_loc_primary(spark, sf_dir):
    """Primary locator of every node."""
    n = _link_nodes(spark, sf_dir)
    return n.select("page_id", F.col("node_no").cast("long").alias("node_no"),
                    F.col("primary_locator.strategy").alias("strategy"),
                    F.col("primary_locator.playwright").alias("playwright"),
                    F.col("primary_locator.is_unique").alias("is_unique"))


def q_loc_guidance(spark, sf_dir):
    """Guidance text of ambiguous primaries."""
    n = _link_nodes(spark, sf_dir).filter(~F.col("primary_locator.is_unique"))
    return n.select("page_id", F.col("node_no").cast("long").alias("node_no"),
                    F.col("primary_count").cast("long").alias("match_count"),
                    F.col("primary_nth").cast("long").alias("nth"),
                    F.col("primary_locator.disambiguation").alias("disambiguation"))


def q_loc_fallbacks(spark, sf_dir):
    """Fallback locators (strategy and expression, in order)."""
    n = _link_nodes(spark, sf_dir)
    return n.select("page_id", F.col("node_no").cast("long").alias("node_no"),
                    F.posexplode("fallback_locators").alias("pos", "f")).select(
        "page_id", "node_no", F.col("pos").cast("long").alias("pos"), F.col("f.strategy").alias("strategy"),
        F.col("f.playwright").alias("playwright"))


def q_meta_page(spark, sf_dir):
    """Page metadata."""
    m = extraction(spark, sf_dir).page_meta
    return m.select("page_id", "title", "url", F.col("node_count").cast("long").alias("node_count"),
                    F.col("frame_count").cast("long").alias("frame_count"), "truncated",
                    F.array_join("notes", "\n").alias("notes"))


def q_cap_nodes(spark, sf_dir):
    """Node budget of 3 per page: kept nodes and the truncation note."""
    ex = extraction(spark, sf_dir, max_nodes=3)
    m = ex.page_meta
    return m.select("page_id", F.col("node_count").cast("long").alias("node_count"), "truncated",
                    F.array_join("notes", "\n").alias("notes"))


def q_rep_evidence(spark, sf_dir):
    """A4: locator evidence per page."""
    return report.evidence(extraction(spark, sf_dir).kept_nodes)


def q_rep_payload(spark, sf_dir):
    """A5: raw and cleaned html size with token estimates."""
    return report.payload_html(read_pages(spark, sf_dir))


def q_rep_determinism(spark, sf_dir):
    """Captures of one url give identical extracts once captured_at is removed."""
    return report.determinism(extraction(spark, sf_dir).extracts)


def q_chk_contract(spark, sf_dir):
    """Q1 / Q2: contract violations per rule (all zero when the engine is sound)."""
    ex = extraction(spark, sf_dir)
    return report.contract_violations(ex.kept_nodes, ex.page_meta)


def q_gate_hosts(spark, sf_dir):
    """URL gate over every page url against a fixed allow list."""
    return gate.url_gate(read_pages(spark, sf_dir), gate.DEMO_ALLOWED_HOSTS)


def q_diag_auth(spark, sf_dir):
    """Auth check over a fetch log derived from the page urls."""
    return gate.auth_check(gate.derived_fetch_log(read_pages(spark, sf_dir)))


def q_lint_actions(spark, sf_dir):
    """Q4: declared action lists (derived from the event log) validated row by row."""
    from pagelens.operators.lint import check_actions, events_action_lists
    from pagelens.sources.pages import read_table
    return check_actions(events_action_lists(read_table(spark, sf_dir, "events"))).select(
        F.col("page_id").alias("list_id"), F.col("step").cast("long").alias("step"), "type", "code", "list_too_long")


def q_lint_locators(spark, sf_dir):
    """Declared click locators (lower-cased link names) graded against each page."""
    from pagelens.operators.lint import link_click_actions, lint_locators
    ex = extraction(spark, sf_dir)
    acts = link_click_actions(ex.kept_nodes)
    return lint_locators(acts, ex).select("page_id", F.col("step").cast("long").alias("step"), "value",
                                          "match_count", "status")


def q_rep_prompts(spark, sf_dir):
    """R2: prompt text (before the JSON block) per conversation scenario and its page."""
    from pagelens.operators.lint import conversation_scenarios, prompt_head
    from pagelens.sources.pages import read_table
    sc = conversation_scenarios(read_table(spark, sf_dir, "conversations"))
    pages = read_pages(spark, sf_dir).select("page_id")
    return sc.join(pages, "page_id").select("scenario_id", "page_id",
                                            prompt_head(None, None, F.col("scenario")).alias("prompt_head"))


def _masked_json(extracts: DataFrame) -> DataFrame:
    """S4 documents without their time of capture: characters and digest."""
    from pagelens.operators.lint import extract_json
    doc = F.regexp_replace("json", '"captured_at": "[^"]*"', '"captured_at": ""')
    return extract_json(extracts).select("page_id", F.length(doc).cast("long").alias("json_chars"), F.sha2(doc, 256).alias("json_sha256"))


def q_sink_extract(spark, sf_dir):
    """Pretty JSON document per page (rows-only check)."""
    return _masked_json(extraction(spark, sf_dir).extracts)


def q_sink_nodes(spark, sf_dir):
    """Nodes written to the bucketed table and read back, with the number of nodes of their page."""
    import uuid

    from pagelens.operators.nodes_table import read_nodes, write_nodes
    from pagelens.session import ensure_checkpoint_dir
    name = f"pagelens_nodes_{uuid.uuid4().hex}"
    write_nodes(extraction(spark, sf_dir), name, "all", path=f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    nodes = read_nodes(spark, name, latest=True)
    per_page = nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("page_nodes"))
    return nodes.join(per_page, "page_id").select("page_id", "url", "node_no", "kind", "tag", "role", "accessible_name", "schema_version", "run_id", "page_nodes")


def q_sink_toast(spark, sf_dir):
    """S4 on toast pages: pretty JSON document per page."""
    return _masked_json(toast_extraction(spark, sf_dir, False).extracts)


def q_rep_payload_totals(spark, sf_dir):
    """A5: payload totals per host and over the corpus."""
    from pagelens.functions.url import url_host
    pages = read_pages(spark, sf_dir)
    hosts = pages.select("page_id", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"))
    out = report.payload_totals(report.payload_html(pages).join(hosts, "page_id"))
    return out.select("host", F.col("corpus").cast("int").alias("corpus"), F.col("pages").cast("long").alias("pages"), "raw_chars", "cleaned_chars", "raw_tokens", "cleaned_tokens", "reduction_pct")


def q_err_rows(spark, sf_dir):
    """Refusals of all gates in one table: urls off the list, selectors absent or not evaluated, invalid declared actions."""
    from pagelens.operators.errors import dead_letters
    from pagelens.operators.lint import check_actions, events_action_lists
    from pagelens.sources.pages import read_table
    pages, ex = read_pages(spark, sf_dir), extraction(spark, sf_dir)
    refused = gate.split_allowed(pages, gate.DEMO_ALLOWED_HOSTS)[1]
    absent = gate.presence(pages.select("page_id", "url"), ex.elements, ["main .ad", "a:has(b)"], persist)
    actions = check_actions(events_action_lists(read_table(spark, sf_dir, "events")))
    return dead_letters(refusals=refused, parse=ex.parse_errors, selectors=absent, actions=actions).select("stage", "key", "item", "code", "message")


def q_rep_payload_json(spark, sf_dir):
    """A5: payload report with the extract JSON size and reductions (rows-only check)."""
    from pagelens.operators.lint import extract_json
    docs = extract_json(extraction(spark, sf_dir).extracts).select("page_id", F.length("json").alias("json_chars"))
    p = report.payload_html(read_pages(spark, sf_dir)).join(docs, "page_id")
    return p.select("page_id", "raw_chars", "cleaned_chars", F.col("json_chars").cast("long").alias("json_chars"),
                    report.tokens(F.col("json_chars")).alias("json_tokens"),
                    report.reduction(F.col("json_chars"), F.col("raw_chars")).alias("reduction_vs_raw_pct"),
                    report.reduction(F.col("json_chars"), F.col("cleaned_chars")).alias("reduction_vs_cleaned_pct"))


def board_extraction(spark, sf_dir, **opts) -> Extraction:
    from pagelens.plans.render import board_pages
    from pagelens.sources.pages import read_table
    key = (spark.sparkContext.applicationId, sf_dir, "board", tuple(sorted(opts.items())))
    ex = _CACHE.get(key)
    if ex is None:
        configure(spark)
        if opts:
            ex = board_extraction(spark, sf_dir).with_options(**opts)
        else:
            ex = Extraction(board_pages(read_table(spark, sf_dir, "orders")), ExtractOptions(**WHOLE))
        _CACHE[key] = ex
    return ex


def _board_buttons(spark, sf_dir):
    n = board_extraction(spark, sf_dir).kept_nodes.filter(F.col("tag") == "button")
    return n.withColumn("o_orderkey", F.regexp_extract("scope_hint", r"^card-(\d+)$", 1).cast("long"))


def q_board_nodes(spark, sf_dir):
    """J3 / W3 / J4 / J5 / J6 / P10 on board pages: form group, scope hint, visibility, disabled."""
    n = _board_buttons(spark, sf_dir)
    return n.select("page_id", "o_orderkey", "form_group", "scope_hint",
                    F.col("properties.is_disabled").alias("is_disabled"),
                    F.col("properties.is_visible").alias("is_visible"))


def q_loc_board(spark, sf_dir):
    """J7 / A1 / W4 / W1 / B1 on board pages: primary locator and guidance of every button."""
    n = _board_buttons(spark, sf_dir)
    return n.select("page_id", "o_orderkey", F.col("primary_locator.strategy").alias("strategy"),
                    F.col("primary_locator.playwright").alias("playwright"),
                    F.col("primary_locator.is_unique").alias("is_unique"),
                    F.col("primary_locator.disambiguation").alias("disambiguation"))


def q_flt_hidden(spark, sf_dir):
    """F3 / A3 on board pages with include_hidden=false: kept nodes and notes."""
    m = board_extraction(spark, sf_dir, include_hidden=False).page_meta
    return m.select("page_id", F.col("node_count").cast("long").alias("node_count"),
                    F.array_join("notes", "\n").alias("notes"))


def card_extraction(spark, sf_dir) -> Extraction:
    from pagelens.plans.render import card_pages
    from pagelens.sources.pages import read_table
    key = (spark.sparkContext.applicationId, sf_dir, "cards")
    ex = _CACHE.get(key)
    if ex is None:
        configure(spark)
        ex = Extraction(card_pages(read_table(spark, sf_dir, "supplier")), ExtractOptions(include_click_targets=True, **WHOLE))
        _CACHE[key] = ex
    return ex


def q_sel_click_target(spark, sf_dir):
    """F4 / J10 on card pages: click-target nodes with their primary locator and note."""
    n = card_extraction(spark, sf_dir).kept_nodes.filter((F.col("tag") == "div"))
    w = Window.partitionBy("page_id").orderBy("frame_key", "eid")
    return n.select("page_id", F.col("css_path"), F.col("primary_locator.strategy").alias("strategy"),
                    F.col("primary_locator.playwright").alias("playwright"),
                    F.col("primary_locator.is_unique").alias("is_unique"), "context_note")


def q_rel_image_name(spark, sf_dir):
    """J10 / R1 on card pages: links named by the alt of their first image."""
    n = card_extraction(spark, sf_dir).kept_nodes.filter(F.col("tag") == "a")
    return n.select("page_id", "accessible_name", F.col("properties.href").alias("href"),
                    F.col("primary_locator.playwright").alias("playwright"))


def form_extraction(spark, sf_dir) -> Extraction:
    from pagelens.plans.render import form_pages
    from pagelens.sources.pages import read_table
    key = (spark.sparkContext.applicationId, sf_dir, "form")
    ex = _CACHE.get(key)
    if ex is None:
        configure(spark)
        ex = Extraction(form_pages(read_table(spark, sf_dir, "part")), ExtractOptions(**WHOLE))
        _CACHE[key] = ex
    return ex


def q_form_inputs(spark, sf_dir):
    """P3-P7 / P9 / P11 / J1 / J2 / R1 / F1 on form pages: role, name, properties, note per input."""
    ex = form_extraction(spark, sf_dir)
    el = ex.elements.select("page_id", "frame_id", "eid", F.col("attrs")["name"].alias("_name"))
    n = ex.kept_nodes.filter(F.col("tag") == "input").join(el, ["page_id", "frame_id", "eid"])
    return n.select("page_id", F.substring("_name", 2, 20).cast("long").alias("p_partkey"), "role", "accessible_name",
                    "form_group", F.col("properties.type").alias("type"),
                    F.col("properties.placeholder").alias("placeholder"),
                    F.col("properties.is_required").alias("is_required"),
                    F.col("properties.is_checked").alias("is_checked"), "context_note")


def q_loc_form_rank(spark, sf_dir):
    """W7 / W4 / W5 / B1 / J7 on form pages: primary locator, guidance and fallback count per input."""
    ex = form_extraction(spark, sf_dir)
    el = ex.elements.select("page_id", "frame_id", "eid", F.col("attrs")["name"].alias("_name"))
    n = ex.kept_nodes.filter(F.col("tag") == "input").join(el, ["page_id", "frame_id", "eid"])
    return n.select("page_id", F.substring("_name", 2, 20).cast("long").alias("p_partkey"),
                    F.col("primary_locator.strategy").alias("strategy"),
                    F.col("primary_locator.playwright").alias("playwright"),
                    F.col("primary_locator.is_unique").alias("is_unique"),
                    F.col("primary_locator.disambiguation").alias("disambiguation"),
                    F.size("fallback_locators").cast("long").alias("n_fallbacks"))


def frame_extraction(spark, sf_dir) -> Extraction:
    from pagelens.plans.render import frame_pages
    from pagelens.sources.pages import read_table
    key = (spark.sparkContext.applicationId, sf_dir, "frames")
    ex = _CACHE.get(key)
    if ex is None:
        configure(spark)
        ex = Extraction(frame_pages(read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")),
                        ExtractOptions(**WHOLE))
        _CACHE[key] = ex
    return ex


def q_frm_tree(spark, sf_dir):
    """Frame report of every frame page."""
    ft = frame_extraction(spark, sf_dir).frame_tree
    return ft.select("page_id", F.array_join("frame_path", " > ").alias("frame_path"), "url", "name",
                     "same_origin", "reachable")


def q_frm_nodes(spark, sf_dir):
    """J8 / W6 / J7 across frames: element nodes of every reachable frame with their frame path."""
    n = frame_extraction(spark, sf_dir).kept_nodes.filter(F.col("kind") == "element")
    return n.select("page_id", F.array_join("frame_path", " > ").alias("frame_path"), "accessible_name",
                    F.col("primary_locator.playwright").alias("playwright"),
                    F.col("primary_locator.is_unique").alias("is_unique"))


def q_frm_marker(spark, sf_dir):
    """Opaque cross-origin frame markers."""
    n = frame_extraction(spark, sf_dir).kept_nodes.filter(F.col("kind") == "cross_origin_frame")
    return n.select("page_id", F.array_join("frame_path", " > ").alias("frame_path"), "accessible_name",
                    F.col("primary_locator.playwright").alias("playwright"),
                    F.col("primary_locator.is_unique").alias("is_unique"), "context_note")


def q_frm_meta(spark, sf_dir):
    """A2 across frames: node and frame counts of every frame page."""
    m = frame_extraction(spark, sf_dir).page_meta
    return m.select("page_id", F.col("node_count").cast("long").alias("node_count"),
                    F.col("frame_count").cast("long").alias("frame_count"), "truncated")


def q_gate_selector(spark, sf_dir):
    """Presence gate for the selector ``div.ad`` over every page."""
    ex = extraction(spark, sf_dir)
    passed, failed = gate.presence_gate(read_pages(spark, sf_dir).select("page_id", "url"), ex.elements, "div.ad")
    return passed.select("page_id", F.lit(True).alias("present"), F.lit(None).cast("string").alias("error_code")) \
        .unionByName(failed.select("page_id", F.lit(False).alias("present"), F.col("error.code").alias("error_code")))


def q_cap_depth(spark, sf_dir):
    """pages where the depth cap stops the traversal (with the depth note)."""
    ex = extraction(spark, sf_dir, max_depth=50)
    deep = ex.elements.filter(F.col("depth_hit")).select("page_id").distinct().withColumn("hit", F.lit(True))
    m = ex.page_meta.join(deep, "page_id", "left")
    return m.select("page_id", F.coalesce("hit", F.lit(False)).alias("depth_capped"),
                    F.array_contains("notes", "MAX_DEPTH (50) hit; deeper nodes were not traversed.").alias("depth_note"))


def _nodes_of_captures(*runs: Extraction) -> list[DataFrame]:
    """Kept nodes of each run with the url of their page; the runs are extracted at the same time."""
    from pagelens.session import together
    return [kept.join(run.page_urls, "page_id") for run, kept in zip(runs, together(*[lambda run=run: run.kept_nodes for run in runs]))]


def q_diff_states(spark, sf_dir):
    """Nodes added / removed / changed between each board page and its
    capture after the declared save action."""
    from pagelens.operators.lint import state_diff
    from pagelens.plans.render import board_pages_after_save
    from pagelens.sources.pages import read_table
    key = (spark.sparkContext.applicationId, sf_dir, "board-after")
    after = _CACHE.get(key)
    if after is None:
        configure(spark)
        after = Extraction(board_pages_after_save(read_table(spark, sf_dir, "orders")),
                           ExtractOptions(after_actions=1, **WHOLE))
        _CACHE[key] = after
    d = state_diff(*_nodes_of_captures(board_extraction(spark, sf_dir), after), persist)
    return d.select("url", F.array_join("frame_path", " > ").alias("frame_path"), "locator",
                    F.col("occurrence").cast("long").alias("occurrence"), "change", "role", "accessible_name")


def toast_extraction(spark, sf_dir, after: bool) -> Extraction:
    from pagelens.plans.render import toast_pages
    from pagelens.sources.pages import read_table
    key = (spark.sparkContext.applicationId, sf_dir, "toast", after)
    ex = _CACHE.get(key)
    if ex is None:
        configure(spark)
        ex = Extraction(toast_pages(read_table(spark, sf_dir, "events"), after), ExtractOptions(**WHOLE))
        _CACHE[key] = ex
    return ex


def q_diff_toast(spark, sf_dir):
    """J13 on toast pages: nodes added, removed, moved and changed, twins among them."""
    from pagelens.operators.lint import state_diff
    sides = [toast_extraction(spark, sf_dir, after) for after in (False, True)]
    return state_diff(*_nodes_of_captures(*sides), persist).select("url", "locator", "change", "role", "accessible_name", F.col("before.is_disabled").alias("was_disabled"), F.col("after.is_disabled").alias("is_disabled"))


def nested_extraction(spark, sf_dir) -> Extraction:
    from pagelens.plans.render import nested_pages
    from pagelens.sources.pages import read_table
    key = (spark.sparkContext.applicationId, sf_dir, "nested")
    ex = _CACHE.get(key)
    if ex is None:
        configure(spark)
        ex = Extraction(nested_pages(read_table(spark, sf_dir, "supplier")), ExtractOptions(**WHOLE))
        _CACHE[key] = ex
    return ex


def q_frm_nested(spark, sf_dir):
    """J8 / P13 / D2 on nested pages: frames of frames, <base>, frames without src, pages that frame each other."""
    ft = nested_extraction(spark, sf_dir).frame_tree
    return ft.select("page_id", F.array_join("frame_path", " > ").alias("frame_path"), "url", "name", "same_origin", "reachable")


def q_frm_captures(spark, sf_dir):
    """J8 / U1 on nested pages: nodes attached from the latest capture of every framed page."""
    n = nested_extraction(spark, sf_dir).kept_nodes
    return n.select("page_id", F.array_join("frame_path", " > ").alias("frame_path"), "accessible_name", F.col("primary_locator.playwright").alias("playwright"),
                    F.col("primary_locator.is_unique").alias("is_unique"), F.col("properties.href").alias("href"))


def q_frm_blank(spark, sf_dir):
    """A2 on nested pages: node and frame counts, blank frames included."""
    m = nested_extraction(spark, sf_dir).page_meta
    return m.select("page_id", F.col("node_count").cast("long").alias("node_count"), F.col("frame_count").cast("long").alias("frame_count"))


def style_extraction(spark, sf_dir, **opts) -> Extraction:
    from pagelens.plans.render import style_pages
    from pagelens.sources.pages import read_table
    key = (spark.sparkContext.applicationId, sf_dir, "styles", tuple(sorted(opts.items())))
    ex = _CACHE.get(key)
    if ex is None:
        configure(spark)
        if opts:
            ex = style_extraction(spark, sf_dir).with_options(**opts)
        else:
            ex = Extraction(style_pages(read_table(spark, sf_dir, "customer")), ExtractOptions(**WHOLE))
        _CACHE[key] = ex
    return ex


def _style_visibility(ex: Extraction) -> DataFrame:
    n = ex.kept_nodes.filter(F.col("tag") == "button").join(ex.elements.select(*FRAME, "eid", "attrs"), FRAME + ["eid"])
    return n.select("page_id", F.substring(F.col("attrs")["data-testid"], 2, 20).cast("long").alias("c_custkey"), F.col("properties.is_visible").alias("is_visible"))


def q_loc_match_form(spark, sf_dir):
    """J7 / A1 on form pages: match count of every candidate key, all strategies (css: by attribute)."""
    ex = form_extraction(spark, sf_dir)
    key = ["strategy", "role", "value", "m_attr"]
    keys = ex.candidates.select(*FRAME, *key).distinct().filter("m_attr is null or m_attr <> '#path'")
    counts = ex.match_pairs.groupBy(*FRAME, *key).agg(F.count(F.lit(1)).alias("n"))
    from pagelens.operators.locate import join_null_safe
    return join_null_safe(keys, counts, [*FRAME, *key], "left").select(
        "page_id", "strategy", F.coalesce("role", F.lit("")).alias("role"), "value", F.coalesce("n", F.lit(0)).cast("long").alias("match_count"))


def q_vis_styles(spark, sf_dir):
    """J6 / J5 on style pages: visibility under rules with combinators, positions, lists and nested blocks."""
    return _style_visibility(style_extraction(spark, sf_dir))


def q_vis_media(spark, sf_dir):
    """J6 on style pages in the mobile viewport."""
    return _style_visibility(style_extraction(spark, sf_dir, viewport="mobile"))


def q_vis_notes(spark, sf_dir):
    """Selectors of relevant rules that are not evaluated, per page."""
    return style_extraction(spark, sf_dir).style_notes.select("page_id", "selector", "reason")


GATE_SELECTORS = ["div.ad", "main .ad", "nav + div.ad", "article > h1", "nav li:nth-child(5) > a[href^='/t']", "html[lang|=fr] footer",
                  "li:nth-last-child(2) ~ li > a:not([href$='.'], [href$=','])", "body > *:not(nav, div):first-of-type b", "p >> text=the", "a:has(b)"]


def q_gate_selectors(spark, sf_dir):
    """Presence of several selectors in every page; selectors that are not evaluated are refused."""
    pages = read_pages(spark, sf_dir).select("page_id", "url")
    out = gate.presence(pages, extraction(spark, sf_dir).elements, GATE_SELECTORS, persist)
    return out.select("page_id", "selector", "present", F.col("error.code").alias("error_code"))


QUERIES = {
    "sink_toast": q_sink_toast,
    "sink_nodes": q_sink_nodes,
    "rep_payload_totals": q_rep_payload_totals,
    "err_rows": q_err_rows,
    "diff_toast": q_diff_toast,
    "frm_nested": q_frm_nested,
    "frm_captures": q_frm_captures,
    "frm_blank": q_frm_blank,
    "loc_match_form": q_loc_match_form,
    "vis_styles": q_vis_styles,
    "vis_media": q_vis_media,
    "vis_notes": q_vis_notes,
    "gate_selectors": q_gate_selectors,
    "src_tag_counts": q_src_tag_counts,
    "src_walked_counts": q_src_walked_counts,
    "sel_link_nodes": q_sel_link_nodes,
    "prop_text": q_prop_text,
    "prop_href": q_prop_href,
    "rel_css_path": q_rel_css_path,
    "loc_candidates": q_loc_candidates,
    "loc_expression": q_loc_expression,
    "loc_match_contains": q_loc_match_contains,
    "loc_match_exact": q_loc_match_exact,
    "loc_primary": q_loc_primary,
    "loc_guidance": q_loc_guidance,
    "loc_fallbacks": q_loc_fallbacks,
    "meta_page": q_meta_page,
    "cap_nodes": q_cap_nodes,
    "rep_evidence": q_rep_evidence,
    "rep_payload": q_rep_payload,
    "rep_determinism": q_rep_determinism,
    "chk_contract": q_chk_contract,
    "gate_hosts": q_gate_hosts,
    "diag_auth": q_diag_auth,
    "lint_actions": q_lint_actions,
    "lint_locators": q_lint_locators,
    "rep_prompts": q_rep_prompts,
    "sink_extract": q_sink_extract,
    "rep_payload_json": q_rep_payload_json,
    "board_nodes": q_board_nodes,
    "loc_board": q_loc_board,
    "flt_hidden": q_flt_hidden,
    "sel_click_target": q_sel_click_target,
    "rel_image_name": q_rel_image_name,
    "form_inputs": q_form_inputs,
    "loc_form_rank": q_loc_form_rank,
    "frm_tree": q_frm_tree,
    "frm_nodes": q_frm_nodes,
    "frm_marker": q_frm_marker,
    "frm_meta": q_frm_meta,
    "gate_selector": q_gate_selector,
    "cap_depth": q_cap_depth,
    "diff_states": q_diff_states,
}
