"""Table schemas and fixed values of the page-semantics contract."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.1"
MAX_DEPTH = 50
DEFAULT_MAX_NODES = 5000

# Tag and role lists of the inclusion rules (must equal the reference).
SKIP_TAGS = ["script", "style", "svg", "template", "noscript", "head", "iframe", "frame"]
NATIVE_INTERACTIVE_TAGS = ["input", "button", "a", "select", "textarea", "label"]
FORM_ASSOCIATED_TAGS = ["option", "fieldset", "output", "legend"]
INCLUDED_ROLES = [
    "button", "link", "checkbox", "radio", "tab", "menuitem", "switch", "combobox", "textbox", "option",
    "alert", "status", "alertdialog", "dialog",
]
AUTHOR_NAMED_ROLES = ["alert", "status", "alertdialog", "dialog"]
LIVE_REGION_ROLES = ["alert", "status"]
TEST_ATTRIBUTES = ["data-testid", "data-cy", "data-qa", "data-test"]
FORM_FIELD_TAGS = ["input", "select", "textarea"]
STRATEGIES = ["test-id", "role", "label", "placeholder", "text", "id", "css"]
NODE_KINDS = ["element", "shadow_boundary", "cross_origin_frame"]
# Generated-id patterns (case-insensitive).
GENERATED_ID_PATTERN = r"(?i)^:r[0-9a-z]+:?$|^(rc[-_]|react-|radix-|headlessui-|downshift-|mui[-_]|ember\d|select2-|ui-id-)"
# Login-looking path pattern of the auth check.
LOGGED_OUT_PATTERN = r"(?i)login|log-in|signin|sign-in|masuk|auth"
# Tags removed for the "cleaned HTML" payload measure.
CLEANED_DROP_TAGS = ["script", "style", "svg", "noscript", "link", "meta", "template"]
# Input types whose IDL type is kept as written (others become "text").
INPUT_TYPES = [
    "hidden", "text", "search", "tel", "url", "email", "password", "date", "month", "week", "time",
    "datetime-local", "number", "range", "color", "checkbox", "radio", "file", "submit", "image", "reset", "button",
]
# Elements that reflect a boolean `disabled` property.
DISABLED_PROPERTY_TAGS = ["button", "input", "select", "textarea", "fieldset", "option", "optgroup", "link", "style"]
LABELABLE_TAGS = ["button", "input", "meter", "output", "progress", "select", "textarea"]

# Note and guidance texts (exact wording of the contract).
NOTE_DEPTH = "MAX_DEPTH (50) hit; deeper nodes were not traversed."
NOTE_NODES = "MAX_NODES ({n}) hit; traversal stopped early."
NOTE_FRAME_BUDGET = "MAX_NODES ({n}) exhausted before frame '{url}' was extracted."
NOTE_HIDDEN = "{k} hidden node(s) excluded because include_hidden=false."
NOTE_EMPTY = (
    "0 nodes extracted. If this page is a SPA that renders after the wait point, retry with "
    "wait_for:'networkidle' or a wait_selector for a key element."
)
NOTE_AFTER = (
    "State captured AFTER {n} declared action(s); this is still a single snapshot of that post-interaction "
    "moment. Transient UI may expire before locator verification (such locators report 0 matches)."
)
NOTE_CLOSED_SHADOW = (
    "Closed shadow root: contents are unreachable and were not extracted. Light-DOM children were skipped "
    "(rendering unknown)."
)
NOTE_CROSS_ORIGIN = (
    "Cross-origin iframe ({url}): DOM is unreachable from this context and was NOT extracted. Tests can still "
    "interact via frameLocator('{selector}')."
)
NOTE_ALT_TEST_ATTR = "{attr} present; getByTestId only reads data-testid unless the team configures testIdAttribute to {attr}."
NOTE_GENERATED_ID = "Element id '{id}' looks framework-generated and may change between builds; demoted to last resort."
NOTE_LIVE_REGION = "Live region element is empty; text_content was taken from its enclosing container."
NOTE_CLICK_TARGET = (
    "Included via the opt-in cursor:pointer click-target heuristic; the element has no native interactive "
    "semantics (consider adding a role or data-testid)."
)
NOTE_UNEVALUATED = "A '{strategy}' locator candidate could not be evaluated by Playwright and was omitted."
GUIDANCE_NO_CANDIDATE = "No usable locator candidate was derived for this node; locate it manually."
GUIDANCE_NO_HINT = "scope with a stable ancestor or .filter() before locating"
GUIDANCE_IFRAME = "Multiple iframe elements match; scope by src or position."

# ---------------------------------------------------------------------------
# Source tables
# ---------------------------------------------------------------------------
PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# Output of the structural parse: one row per element; the frame-level
# columns (text, mtext, frame_*) are filled on the root row (eid = 0) only,
# and a page that cannot be parsed yields one row with eid = -1 and an error.
PARSED_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("frame_id", T.IntegerType()),
    T.StructField("eid", T.IntegerType()),
    T.StructField("last_eid", T.IntegerType()),
    T.StructField("parent_eid", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("sib_index", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("t_start", T.IntegerType()),
    T.StructField("t_end", T.IntegerType()),
    T.StructField("m_start", T.IntegerType()),
    T.StructField("m_end", T.IntegerType()),
    T.StructField("in_shadow", T.BooleanType()),
    T.StructField("root_id", T.IntegerType()),
    T.StructField("shadow_mode", T.StringType()),
    T.StructField("parent_frame_id", T.IntegerType()),
    T.StructField("host_eid", T.IntegerType()),
    T.StructField("frame_key", T.ArrayType(T.IntegerType())),
    T.StructField("frame_url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("mtext", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("error_message", T.StringType()),
])

LOCATOR_TYPE = T.StructType([
    T.StructField("strategy", T.StringType()),
    T.StructField("playwright", T.StringType()),
    T.StructField("is_unique", T.BooleanType()),
    T.StructField("disambiguation", T.StringType()),
])
