"""Declared actions and snapshots: Q4 action-list check, J12 locator lint,
J13 state diff between two captures, R2 prompt rows, S4 JSON sink.

* Q4 validates declared action lists row by row (window count per list).
* J12 resolves declared locators with the same match join as the extraction
  (distinct keys per frame -> match pairs -> counts) and grades them.
* J13 aligns the nodes of a before and an after capture in document order
  (``pagelens.operators.align``).
* R2 renders the team prompt per (scenario, page) from columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.locate import CKEY, match_pairs

ACTION_TYPES = ["fill", "click", "press", "wait"]
MAX_ACTIONS = 20

# The team conventions block and prompt frame of the test-writing prompt.
TEAM_CONVENTIONS = """TEAM CONVENTIONS (non-negotiable):
- Locators: use ONLY the `playwright` expression from each node. Prefer
  primary_locator; use a fallback only if primary.is_unique is false or the
  primary is unusable, and add a comment stating why.
- If a locator has is_unique: false, apply its `disambiguation` guidance;
  never ship an ambiguous locator without scoping it.
- Frames: for any node with non-empty frame_path, chain frameLocator() in the
  given order before locating the element.
- Structure: use test.describe for the feature and test() per scenario;
  group actions by form_group; arrange as Arrange → Act → Assert with comments.
- Assertions: assert every stated state that is relevant to the scenario —
  is_visible, is_disabled, is_required, is_checked — using web-first
  assertions (expect(locator).toBeVisible(), toBeDisabled(), etc.).
- State changes: this JSON is a SINGLE snapshot. If an element is disabled
  now (e.g. a submit button), write the interactions that make it valid; do
  not assume it stays disabled.
- Uniqueness is verified AT CAPTURE TIME. For UI that accumulates entries
  (chat threads, notification lists, growing tables), scope with .first() or
  .filter() and make asserted content unique per run; never assert bare
  visibility on a locator that content growth can multiply.
- Do NOT invent selectors, ids, roles, or text not present in the data. If a
  required element for the scenario is missing, STOP and say what's missing."""
PROMPT_ROLE_LINE = "You are a Senior QA Automation Engineer on the {team} team."
PROMPT_TASK_LINE = "Write a Playwright test in TypeScript following OUR team conventions below."
PROMPT_SCENARIO = "SCENARIO:"
PROMPT_DOM = "SEMANTIC DOM (single source of truth for locators):"
DEFAULT_TEAM = "QA"


# ---------------------------------------------------------------------------
# Q4
# ---------------------------------------------------------------------------
def check_actions(actions: DataFrame, list_key: str = "page_id") -> DataFrame:
    """Q4: per action a violation code (null when valid) and the list-level count check.

    actions: (list_key, step, type, strategy, value, role, nth, text, key, ms)
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(list_key))
    t = F.coalesce(F.col("type"), F.lit(""))
    code = (F.when(~t.isin(ACTION_TYPES), F.lit("invalid_type"))
            .when((t != "wait") & (F.coalesce(F.col("value"), F.lit("")) == ""), F.lit("empty_locator_value"))
            .when((t != "wait") & ~F.coalesce(F.col("strategy"), F.lit("")).isin("test-id", "role", "label", "placeholder", "text", "id", "css"),
                  F.lit("invalid_strategy"))
            .when((t == "fill") & F.col("text").isNull(), F.lit("missing_text"))
            .when((t == "press") & (F.length(F.coalesce(F.col("key"), F.lit(""))) > 30), F.lit("key_too_long"))
            .when((t == "wait") & ~F.coalesce(F.col("ms").between(1, 10000), F.lit(False)), F.lit("wait_out_of_range"))
            .when(F.col("nth").isNotNull() & (F.col("nth") < 0), F.lit("negative_nth")))
    return actions.select(
        list_key, "step", "type",
        code.alias("code"),
        (n > MAX_ACTIONS).alias("list_too_long"))


def events_action_lists(events: DataFrame) -> DataFrame:
    """Declared action lists derived from the event log: one list per user,
    steps in time order; event types map to action types."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.col("event_type")
    atype = (F.when(t.isin("click", "purchase"), "click").when(t == "view", "wait")
             .when(t == "error", "press").when(t == "signup", "fill").otherwise(t))
    return events.select(
        F.col("user_id").alias("page_id"), F.row_number().over(w).alias("step"), atype.alias("type"),
        F.lit("role").alias("strategy"), F.initcap(t).alias("value"), F.lit("button").alias("role"),
        F.lit(None).cast("int").alias("nth"),
        F.when(t == "signup", F.lit("secret")).alias("text"),
        F.when(t == "error", F.get_json_object("props", "$.k")).alias("key"),
        F.when(t == "view", (F.col("value") * 500).cast("int")).alias("ms"))


# ---------------------------------------------------------------------------
# J12
# ---------------------------------------------------------------------------
def lint_locators(actions: DataFrame, ex, mode: str | None = None) -> DataFrame:
    """Resolve declared locators against the main frame of each page.

    status: 'missing' (0 matches), 'ok' (1, or nth < count), 'ambiguous' (>1 without nth),
    'nth_out_of_range'. Fill texts are never selected into the output.
    """
    mode = mode or ex.opts.match
    a = actions.filter(F.col("type") != "wait").select(
        "page_id", F.lit(0).alias("frame_id"), "step", "type", "strategy", "value",
        F.when(F.col("strategy") == "role", F.col("role")).alias("role"), "nth",
        F.when(F.col("strategy") == "css", F.regexp_extract("value", r"^\[([^=\]]+)=", 1)).alias("_attr"))
    a = a.withColumn("m_attr", F.when(F.col("strategy") == "css",
                                      F.when(F.col("_attr") != "", F.col("_attr")).otherwise(F.lit("#path"))))
    keys = a.select("page_id", "frame_id", *CKEY).distinct()
    pairs = match_pairs(keys, ex.match_universe, mode, ex.n_parts)
    counts = pairs.groupBy("page_id", "frame_id", *CKEY).agg(F.count(F.lit(1)).alias("n"))
    from pagelens.operators.locate import join_null_safe
    j = join_null_safe(a, counts, ["page_id", "frame_id", *CKEY], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = (F.when(F.col("n") == 0, "missing")
              .when(F.col("nth").isNotNull() & (F.col("nth") >= F.col("n")), "nth_out_of_range")
              .when((F.col("n") == 1) | F.col("nth").isNotNull(), "ok")
              .otherwise("ambiguous"))
    return j.select("page_id", "step", "type", "strategy", "role", "value", "nth",
                    F.col("n").cast("long").alias("match_count"), status.alias("status"))


def link_click_actions(nodes: DataFrame) -> DataFrame:
    """Declared click actions over every link node of a page (lower-cased name,
    role link), as a team would write them by hand."""
    w = Window.partitionBy("page_id").orderBy("frame_key", "eid")
    return (nodes.filter((F.col("role") == "link") & (F.col("frame_id") == 0) & F.col("accessible_name").isNotNull())
            .select("page_id", F.row_number().over(w).alias("step"), F.lit("click").alias("type"),
                    F.lit("role").alias("strategy"), F.lower("accessible_name").alias("value"),
                    F.lit("link").alias("role"), F.lit(None).cast("int").alias("nth")))


# ---------------------------------------------------------------------------
# J13
# ---------------------------------------------------------------------------
def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes of a url in document order, with the hashes that alignment compares and their place among nodes of the same key."""
    key = ["frame_path", "kind", "role", "locator"]
    order = Window.partitionBy("url").orderBy("frame_key", "doc_order")
    twins = Window.partitionBy("url", *key).orderBy("frame_key", "doc_order")
    rows = nodes.select("url", "frame_path", "kind", "role", F.col("primary_locator.playwright").alias("locator"), "accessible_name", "frame_key", "doc_order",
                        F.col("properties").alias("props"))
    return rows.select("url", F.row_number().over(order).cast("long").alias("no"), F.row_number().over(twins).alias("occurrence"), *key, "accessible_name", "props",
                       F.xxhash64(*key).alias("key"), F.xxhash64(*key, "accessible_name", F.to_json("props")).alias("whole"))


def state_diff(before: DataFrame, after: DataFrame, keep=lambda df, by: df) -> DataFrame:
    """Nodes added, removed, moved or changed between two captures of the same url.

    before / after: node rows carrying ``url`` (page url), frame_key, doc_order,
    frame_path, primary_locator, properties, role, accessible_name. A node that moved and changed is ``changed``;
    ``occurrence`` is its place among nodes of the same key, after the change where it still exists.
    ``keep(table, "url")`` materialises the numbered nodes, which the alignment and its result both read.
    """
    from pagelens.operators.align import align_states
    from pagelens.session import together
    b, a = together(lambda: keep(_numbered(before), "url"), lambda: keep(_numbered(after), "url"))
    pairs = align_states(b.select("url", "no", "key", "whole"), a.select("url", "no", "key", "whole"))
    side = lambda df, s: df.select("url", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in ("url", "key")])
    j = pairs.join(side(b, "b"), ["url", "b_no"], "left").join(side(a, "a"), ["url", "a_no"], "left")
    change = (F.when(F.col("b_no").isNull(), "added").when(F.col("a_no").isNull(), "removed")
              .when(F.col("b_whole") != F.col("a_whole"), "changed").when(F.col("moved"), "moved"))
    either = lambda c: F.coalesce(f"a_{c}", f"b_{c}").alias(c)
    return j.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        "url", either("frame_path"), either("locator"), either("occurrence"), "change", either("role"), either("accessible_name"),
        F.col("b_props").alias("before"), F.col("a_props").alias("after"))


# ---------------------------------------------------------------------------
# S4 JSON sink and R2 prompts
# ---------------------------------------------------------------------------
def json_text(c: Column) -> Column:
    """A string as JSON: the array that holds it alone, without its brackets (the string's own ones stand between quotes)."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.btrim(F.to_json(F.array(c)), F.lit("[]")))


def json_plain(c: Column) -> Column:
    """A number or boolean as JSON."""
    return F.coalesce(c.cast("string"), F.lit("null"))


class JsonLayout:
    """Objects and arrays as JSON text at known depths, on one line or indented by two spaces like JSON.stringify(doc, null, 2)."""

    def __init__(self, pretty: bool):
        self.colon, self.pad = (": ", lambda level: "\n" + "  " * level) if pretty else (":", lambda level: "")

    def object(self, level: int, members: list[tuple], optional: list[tuple] = ()) -> Column:
        """``members`` (name, JSON) stand always, ``optional`` ones (name, JSON, value) where their value is not null."""
        write = lambda name, js: F.concat(F.lit(f'"{name}"{self.colon}'), js)
        lines = [write(n, js) for n, js in members] + [F.when(v.isNotNull(), write(n, js)) for n, js, v in optional]
        inner, outer = self.pad(level + 1), self.pad(level)
        return F.concat(F.lit("{" + inner), F.concat_ws("," + inner, *lines), F.lit(outer + "}"))

    def array(self, level: int, values: Column, item) -> Column:
        """``values`` written one by one by ``item``; the size is asked of the values, so that every item is written once."""
        inner, outer = self.pad(level + 1), self.pad(level)
        return F.when(F.size(values) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[" + inner), F.array_join(F.transform(values, item), "," + inner), F.lit(outer + "]")))


def extract_json(extracts: DataFrame, pretty: bool = True) -> DataFrame:
    """The document per page as JSON text; ``disambiguation`` and ``context_note`` are left out where they are null, other
    members stand as null. Built from columns, level by level."""
    lay = JsonLayout(pretty)
    strings = lambda level, c: lay.array(level, c, json_text)

    def locator(level: int):
        return lambda x: lay.object(level, [("strategy", json_text(x["strategy"])), ("playwright", json_text(x["playwright"])), ("is_unique", json_plain(x["is_unique"]))],
                                    [("disambiguation", json_text(x["disambiguation"]), x["disambiguation"])])

    def node(n: Column) -> Column:
        p = n["properties"]
        properties = lay.object(3, [(k, json_text(p[k])) for k in ("type", "placeholder", "text_content", "href")]
                                + [(k, json_plain(p[k])) for k in ("is_required", "is_disabled", "is_checked", "is_visible")])
        return lay.object(2, [
            ("kind", json_text(n["kind"])), ("tag", json_text(n["tag"])), ("role", json_text(n["role"])), ("in_shadow", json_plain(n["in_shadow"])),
            ("frame_path", strings(3, n["frame_path"])), ("form_group", json_text(n["form_group"])), ("accessible_name", json_text(n["accessible_name"])),
            ("primary_locator", locator(3)(n["primary_locator"])), ("fallback_locators", lay.array(3, n["fallback_locators"], locator(4))),
            ("properties", properties)], [("context_note", json_text(n["context_note"]), n["context_note"])])

    md = F.col("page_metadata")
    metadata = lay.object(1, [(k, json_text(md[k])) for k in ("title", "url", "captured_at")] + [(k, json_plain(md[k])) for k in ("node_count", "frame_count", "truncated")]
                          + [("notes", strings(2, md["notes"]))])
    doc = lay.object(0, [("schema_version", json_text(F.col("schema_version"))), ("page_metadata", metadata),
                         ("interactive_nodes", lay.array(1, F.col("interactive_nodes"), node))])
    return extracts.select("page_id", doc.alias("json"))


def prompt_head(team: str | None = None, framework_note=None, scenario=None):
    """R2: the prompt text before the JSON block, as a column expression."""
    team_c = F.coalesce(F.lit(team) if team else F.lit(None).cast("string"), F.lit(DEFAULT_TEAM))
    note = F.when(F.coalesce(framework_note, F.lit("")) != "", F.concat(F.lit("\n"), framework_note, F.lit("\n"))) \
        .otherwise(F.lit("")) if framework_note is not None else F.lit("")
    return F.concat(
        F.replace(F.lit(PROMPT_ROLE_LINE), F.lit("{team}"), team_c), F.lit("\n" + PROMPT_TASK_LINE + "\n"),
        note, F.lit("\n" + TEAM_CONVENTIONS + "\n\n" + PROMPT_SCENARIO + "\n"), scenario,
        F.lit("\n\n" + PROMPT_DOM + "\n```json\n"))


def prompts(scenarios: DataFrame, docs: DataFrame, team: str | None = None) -> DataFrame:
    """R2: full prompt per scenario = head + extract JSON + closing fence.

    scenarios: (scenario_id, page_id, scenario[, framework_note]); docs: (page_id, json).
    """
    fn = F.col("framework_note") if "framework_note" in scenarios.columns else None
    s = scenarios.join(docs, "page_id")
    return s.select("scenario_id", "page_id",
                    F.concat(prompt_head(team, fn, F.col("scenario")), F.col("json"), F.lit("\n```")).alias("prompt"))


def conversation_scenarios(conversations: DataFrame) -> DataFrame:
    """Scenarios from conversations: the first user turn of each conversation,
    paired with the page of the same id."""
    first = (conversations.filter(F.col("role") == "user")
             .groupBy("conv_id").agg(F.min_by("text", "turn").alias("scenario")))
    return first.select(F.col("conv_id").alias("scenario_id"), F.col("conv_id").alias("page_id"), "scenario")
