"""DuckDB oracle SQL for the registered queries.

The oracles are written independently of the engine: they read the raw
``pages`` html with regular expressions (anchors in these captures all have
the form ``<a href="...">text</a>``) and recompute the expected records
directly, so they share no code path with the HTML parse or the Spark rules.
"""

from __future__ import annotations

from pagelens.operators.gate import DEMO_ALLOWED_HOSTS
from pagelens.schema import NOTE_EMPTY as _NOTE_EMPTY

NOTE_EMPTY = _NOTE_EMPTY.replace("'", "''")

ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'

LINKS = f"""
links AS (
  SELECT page_id, url, title_raw,
         unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS href_raw,
         unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS txt,
         unnest(range(1, 1 + len(regexp_extract_all(html, '{ANCHOR}', 0)))) AS node_no
  FROM (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title_raw FROM pages)
),
counted AS (
  SELECT l.page_id, l.node_no, l.txt, l.href_raw, l.url,
         (SELECT count(*) FROM links m WHERE m.page_id = l.page_id AND contains(lower(m.txt), lower(l.txt))) AS cnt,
         (SELECT count(*) FROM links m WHERE m.page_id = l.page_id AND contains(lower(m.txt), lower(l.txt))
                 AND m.node_no < l.node_no) AS nth
  FROM links l
)"""


def _q(s: str) -> str:
    """SQL for the JS single-quoted literal of column expression ``s``."""
    return f"('''' || replace(replace({s}, '\\', '\\\\'), '''', '\\''') || '''')"


CSS_PATH = ("'html > body:nth-child(2) > nav:nth-child(1) > ul:nth-child(1) > li:nth-child(' "
            "|| node_no || ') > a:nth-child(1)'")

ENCODE_NON_ASCII = ("array_to_string(list_transform(string_split({x}, ''), "
                    "lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), '')")

ORIGIN = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', 0)"
HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1))"
HOSTPORT = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
SCHEME = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _cleaned(col: str) -> str:
    c = col
    for t in ["script", "style", "svg", "noscript", "template"]:
        c = f"regexp_replace({c}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    for t in ["link", "meta"]:
        c = f"regexp_replace({c}, '(?i)<{t}\\b[^>]*>', '', 'g')"
    return f"regexp_replace({c}, '{WS}', ' ', 'g')"


def _gate_sql() -> str:
    conds = []
    for h in DEMO_ALLOWED_HOSTS:
        if h.startswith("*."):
            conds.append(f"(ends_with({HOST}, '{h[1:]}') OR {HOST} = '{h[2:]}')")
        elif ":" in h:
            conds.append(f"{HOSTPORT} = '{h}'")
        else:
            conds.append(f"{HOST} = '{h}'")
    allowed = " OR ".join(conds)
    hosts = ", ".join(DEMO_ALLOWED_HOSTS)
    return f"""
SELECT page_id, url, ({allowed}) AS allowed,
       CASE WHEN ({allowed}) THEN NULL ELSE 'url_not_allowed' END AS error_code,
       CASE WHEN {SCHEME} NOT IN ('http', 'https') THEN 'Only http/https URLs are allowed (got scheme ''' || {SCHEME} || ''').'
            WHEN ({allowed}) THEN NULL
            ELSE 'Host ''' || {HOSTPORT} || ''' is not in allowed_hosts ({hosts}).' END AS message
FROM pages"""


TITLE = ("trim(regexp_replace(replace(replace(replace(replace(replace(title_raw, '&lt;', '<'), '&gt;', '>'), "
         "'&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[\\t\\n\\f\\r ]+', ' ', 'g'))")

from pagelens.operators.lint import PROMPT_DOM, PROMPT_ROLE_LINE, PROMPT_SCENARIO, PROMPT_TASK_LINE, TEAM_CONVENTIONS


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPT_BEFORE = _lit(PROMPT_ROLE_LINE.replace("{team}", "QA") + "\n" + PROMPT_TASK_LINE + "\n\n"
                     + TEAM_CONVENTIONS + "\n\n" + PROMPT_SCENARIO + "\n")
PROMPT_AFTER = _lit("\n\n" + PROMPT_DOM + "\n```json\n")

ORACLE_SQL = {
    "src_tag_counts": """
SELECT page_id, tag, count(*)::BIGINT AS n
FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
GROUP BY page_id, tag""",
    "src_walked_counts": """
SELECT page_id, count(*)::BIGINT AS n_elements,
       count(*) FILTER (WHERE tag NOT IN ('head', 'meta', 'title', 'style', 'script', 'link', 'noscript', 'svg',
                                          'template', 'iframe', 'frame', 'base'))::BIGINT AS n_walked
FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
GROUP BY page_id""",
    "sel_link_nodes": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no, 'element' AS kind, 'a' AS tag, 'link' AS role,
       NULLIF(left(txt, 120), '') AS accessible_name, true AS is_visible
FROM links""",
    "sink_nodes": f"""
WITH {LINKS}
SELECT page_id, url, node_no::BIGINT AS node_no, 'element' AS kind, 'a' AS tag, 'link' AS role,
       NULLIF(left(txt, 120), '') AS accessible_name, '1.1' AS schema_version, 'all' AS run_id,
       count(*) OVER (PARTITION BY page_id)::BIGINT AS page_nodes
FROM links""",
    "prop_text": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no, NULLIF(left(txt, 120), '') AS text_content, NULL::VARCHAR AS type
FROM links""",
    "prop_href": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no,
       {ORIGIN.replace('url', 'lower(url)')} || {ENCODE_NON_ASCII.format(x='href_raw')} AS href
FROM links""",
    "rel_css_path": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no, {CSS_PATH} AS css_path FROM links""",
    "loc_candidates": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no, 0::BIGINT AS rank, 'role' AS strategy, txt AS value, false AS last_resort
FROM links
UNION ALL
SELECT page_id, node_no, 1, 'text', txt, false FROM links WHERE length(txt) BETWEEN 1 AND 80
UNION ALL
SELECT page_id, node_no, CASE WHEN length(txt) BETWEEN 1 AND 80 THEN 2 ELSE 1 END, 'css', {CSS_PATH}, true FROM links""",
    "loc_expression": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no, 0::BIGINT AS rank,
       'getByRole(''link'', {{ name: ' || {_q('txt')} || ' }})' AS playwright
FROM links
UNION ALL
SELECT page_id, node_no, 1, 'getByText(' || {_q('txt')} || ')' FROM links WHERE length(txt) BETWEEN 1 AND 80
UNION ALL
SELECT page_id, node_no, CASE WHEN length(txt) BETWEEN 1 AND 80 THEN 2 ELSE 1 END,
       'locator(' || {_q(CSS_PATH)} || ')' FROM links""",
    "loc_match_contains": f"""
WITH {LINKS}
SELECT DISTINCT page_id, 'link' AS role, txt AS value, cnt::BIGINT AS match_count FROM counted""",
    "loc_match_exact": f"""
WITH {LINKS}
SELECT page_id, 'link' AS role, txt AS value, count(*)::BIGINT AS match_count FROM links GROUP BY page_id, txt""",
    "loc_primary": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no, 'role' AS strategy,
       'getByRole(''link'', {{ name: ' || {_q('txt')} || ' }})' AS playwright, cnt = 1 AS is_unique
FROM counted""",
    "loc_guidance": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no, cnt::BIGINT AS match_count, nth::BIGINT AS nth,
       cnt || ' matches in frame; use .nth(' || nth || ').' AS disambiguation
FROM counted WHERE cnt <> 1""",
    "loc_fallbacks": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS node_no, 0::BIGINT AS pos, 'text' AS strategy,
       'getByText(' || {_q('txt')} || ')' AS playwright
FROM counted WHERE length(txt) BETWEEN 1 AND 80
UNION ALL
SELECT page_id, node_no, CASE WHEN length(txt) BETWEEN 1 AND 80 THEN 1 ELSE 0 END, 'css',
       'locator(' || {_q(CSS_PATH)} || ')'
FROM counted WHERE cnt <> 1""",
    "meta_page": f"""
WITH {LINKS}, per AS (SELECT page_id, count(node_no) AS n FROM links GROUP BY page_id)
SELECT p.page_id, {TITLE} AS title, p.url, coalesce(per.n, 0)::BIGINT AS node_count, 1::BIGINT AS frame_count,
       false AS truncated,
       CASE WHEN coalesce(per.n, 0) = 0 THEN '{NOTE_EMPTY}' ELSE '' END AS notes
FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title_raw FROM pages) p
LEFT JOIN per ON p.page_id = per.page_id""",
    "cap_nodes": f"""
WITH {LINKS}, per AS (SELECT page_id, count(node_no) AS n FROM links GROUP BY page_id)
SELECT p.page_id, least(coalesce(per.n, 0), 3)::BIGINT AS node_count, coalesce(per.n, 0) > 3 AS truncated,
       CASE WHEN coalesce(per.n, 0) > 3 THEN 'MAX_NODES (3) hit; traversal stopped early.'
            WHEN coalesce(per.n, 0) = 0 THEN '{NOTE_EMPTY}' ELSE '' END AS notes
FROM pages p LEFT JOIN per ON p.page_id = per.page_id""",
    "rep_evidence": f"""
WITH {LINKS}
SELECT page_id, count(*)::BIGINT AS nodes, count(*) FILTER (WHERE cnt = 1)::BIGINT AS unique_primaries,
       count(*) FILTER (WHERE cnt <> 1)::BIGINT AS flagged_ambiguous, 0::BIGINT AS unflagged_ambiguous
FROM counted GROUP BY page_id""",
    "rep_payload": f"""
SELECT page_id, length(html)::BIGINT AS raw_chars, length({_cleaned('html')})::BIGINT AS cleaned_chars,
       round(length(html) / 4.0)::BIGINT AS raw_tokens, round(length({_cleaned('html')}) / 4.0)::BIGINT AS cleaned_tokens
FROM pages""",
    "rep_determinism": """
SELECT url, count(*)::BIGINT AS captures, count(DISTINCT html) = 1 AS deterministic FROM pages GROUP BY url""",
    "chk_contract": """
SELECT * FROM (VALUES ('kind_enum', 0::BIGINT), ('strategy_enum', 0), ('empty_tag', 0), ('empty_expression', 0),
                      ('shadow_piercing_css', 0), ('ambiguous_unflagged', 0), ('unique_with_guidance', 0),
                      ('frame_count_min', 0), ('node_count_mismatch', 0)) t(rule, violations)""",
    "gate_hosts": _gate_sql(),
    "diag_auth": f"""
SELECT page_id, requested_url, final_url,
       regexp_replace(final_url, '/$', '') <> regexp_replace(requested_url, '/$', '') AS redirected,
       regexp_matches(lower(CASE WHEN regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) = ''
                                 THEN '/' ELSE regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) END),
                      'login|log-in|signin|sign-in|masuk|auth') AS looks_logged_out
FROM (SELECT page_id, url AS requested_url,
             CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '/' ELSE {ORIGIN} || '/login' END AS final_url
      FROM pages)""",
    "lint_actions": """
WITH a AS (
  SELECT user_id AS list_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'click' WHEN event_type = 'view' THEN 'wait'
              WHEN event_type = 'error' THEN 'press' WHEN event_type = 'signup' THEN 'fill' ELSE event_type END AS type,
         upper(left(event_type, 1)) || lower(substr(event_type, 2)) AS value,
         CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END AS key,
         CASE WHEN event_type = 'view' THEN CAST(value * 500 AS INTEGER) END AS ms,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)
SELECT list_id, step::BIGINT AS step, type,
       CASE WHEN type NOT IN ('fill', 'click', 'press', 'wait') THEN 'invalid_type'
            WHEN type <> 'wait' AND coalesce(value, '') = '' THEN 'empty_locator_value'
            WHEN type = 'press' AND length(coalesce(key, '')) > 30 THEN 'key_too_long'
            WHEN type = 'wait' AND NOT coalesce(ms BETWEEN 1 AND 10000, false) THEN 'wait_out_of_range'
       END AS code,
       n > 20 AS list_too_long
FROM a""",
    "lint_locators": f"""
WITH {LINKS}
SELECT page_id, node_no::BIGINT AS step, lower(txt) AS value, cnt::BIGINT AS match_count,
       CASE WHEN cnt = 0 THEN 'missing' WHEN cnt = 1 THEN 'ok' ELSE 'ambiguous' END AS status
FROM counted""",
    "rep_prompts": f"""
SELECT c.conv_id AS scenario_id, c.conv_id AS page_id, {PROMPT_BEFORE} || c.scenario || {PROMPT_AFTER} AS prompt_head
FROM (SELECT conv_id, arg_min(text, turn) AS scenario FROM conversations WHERE role = 'user' GROUP BY conv_id) c
JOIN pages p ON p.page_id = c.conv_id""",
}

# ---------------------------------------------------------------------------
# board pages (rendered from orders, see plans/render.py)
# ---------------------------------------------------------------------------
BOARD = """
WITH o AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority,
         (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 25 AS chunk
  FROM orders),
b AS (
  SELECT o_custkey::BIGINT * 100000000 + chunk AS page_id, o_custkey, o_orderkey, o_orderstatus, o_orderpriority,
         o_orderpriority IN ('3-MEDIUM', '5-LOW') AND o_orderstatus <> 'O' AS role_match,
         count(*) FILTER (WHERE o_orderpriority IN ('3-MEDIUM', '5-LOW') AND o_orderstatus <> 'O')
           OVER (PARTITION BY o_custkey, chunk) AS n_role,
         count(*) OVER (PARTITION BY o_custkey, chunk) AS n_text,
         coalesce(count(*) FILTER (WHERE o_orderpriority IN ('3-MEDIUM', '5-LOW') AND o_orderstatus <> 'O')
           OVER (PARTITION BY o_custkey, chunk ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS role_idx
  FROM o)"""

_VISIBLE_DIVS = "count(*) FILTER (WHERE o_orderpriority = '5-LOW')"
_VISIBLE_BUTTONS = "count(*) FILTER (WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'O')"
_DROPPED = f"(2 * count(*) - {_VISIBLE_DIVS} - {_VISIBLE_BUTTONS})"

ORACLE_SQL.update({
    "board_nodes": BOARD + """
SELECT page_id, o_orderkey,
       CASE o_custkey % 3 WHEN 0 THEN 'form#board-' || o_custkey WHEN 1 THEN 'form[name="b' || o_custkey || '"]'
            ELSE 'form:nth(0)' END AS form_group,
       'card-' || o_orderkey AS scope_hint,
       o_orderstatus = 'F' AS is_disabled,
       o_orderpriority = '5-LOW' AND o_orderstatus <> 'O' AS is_visible
FROM b""",
    "loc_board": BOARD + """
SELECT page_id, o_orderkey,
       CASE WHEN n_role = 1 OR n_text <> 1 THEN 'role' ELSE 'text' END AS strategy,
       CASE WHEN n_role = 1 OR n_text <> 1 THEN 'getByRole(''button'', { name: ''Save'' })'
            ELSE 'getByText(''Save'')' END AS playwright,
       n_role = 1 OR n_text = 1 AS is_unique,
       CASE WHEN n_role = 1 OR n_text = 1 THEN NULL
            ELSE n_role || ' matches in frame; '
                 || CASE WHEN role_match THEN 'use .nth(' || role_idx || '); ' ELSE '' END
                 || 'or scope with getByTestId(''card-' || o_orderkey || ''') before locating.' END AS disambiguation
FROM b""",
    "flt_hidden": BOARD + f"""
SELECT page_id, ({_VISIBLE_DIVS} + {_VISIBLE_BUTTONS})::BIGINT AS node_count,
       CASE WHEN {_DROPPED} > 0 THEN {_DROPPED} || ' hidden node(s) excluded because include_hidden=false.'
            ELSE '' END
       || CASE WHEN {_VISIBLE_DIVS} + {_VISIBLE_BUTTONS} = 0
               THEN CASE WHEN {_DROPPED} > 0 THEN chr(10) ELSE '' END || '{NOTE_EMPTY}' ELSE '' END AS notes
FROM b GROUP BY page_id""",
})

# ---------------------------------------------------------------------------
# card pages (rendered from supplier, see plans/render.py)
# ---------------------------------------------------------------------------
CARDS = """
WITH s AS (
  SELECT (s_nationkey::BIGINT * 100000000 + (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 25)::BIGINT AS page_id,
         s_nationkey, s_suppkey, s_name, s_acctbal,
         (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 25 + 1 AS pos
  FROM supplier)"""
_CLICK_NOTE = ("Included via the opt-in cursor:pointer click-target heuristic; the element has no native interactive "
               "semantics (consider adding a role or data-testid).")
_CARD_PATH = "'html > body:nth-child(2) > div:nth-child(' || pos || ')'"
ORACLE_SQL.update({
    "sel_click_target": CARDS + f"""
SELECT page_id, {_CARD_PATH} AS css_path,
       CASE WHEN s_suppkey % 3 = 0 THEN 'text' ELSE 'css' END AS strategy,
       CASE WHEN s_suppkey % 3 = 0 THEN 'getByText(' || {_q('s_name')} || ')'
            ELSE 'locator(' || {_q(_CARD_PATH)} || ')' END AS playwright,
       true AS is_unique,
       '{_CLICK_NOTE}' AS context_note
FROM s WHERE s_acctbal >= 0""",
    "rel_image_name": CARDS + f"""
SELECT page_id, s_name AS accessible_name, 'http://shop.test/s/' || s_suppkey AS href,
       'getByRole(''link'', {{ name: ' || {_q('s_name')} || ' }})' AS playwright
FROM s WHERE s_acctbal >= 0 AND s_suppkey % 3 = 2""",
})

# ---------------------------------------------------------------------------
# form pages (rendered from part, see plans/render.py)
# ---------------------------------------------------------------------------
FORM = r"""
WITH p AS (
  SELECT p_partkey AS k, p_name, p_type, p_size,
         CAST(regexp_extract(p_brand, '(\d+)$', 1) AS BIGINT) AS brand_no,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn
  FROM part),
f AS (
  SELECT *, brand_no::BIGINT * 100000000 + (rn - 1) // 20 AS page_id, (rn - 1) % 20 + 1 AS pos,
         CASE p_size % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'email' WHEN 2 THEN 'checkbox' WHEN 3 THEN 'number'
              ELSE 'submit' END AS t,
         CASE k % 3 WHEN 0 THEN 'p' || k WHEN 1 THEN 'rc_select_' || k END AS id_attr,
         k % 4 AS mode,
         CASE k % 6 WHEN 0 THEN 'data-testid' WHEN 1 THEN 'data-cy' WHEN 2 THEN 'data-qa' END AS tattr
  FROM p),
g AS (
  SELECT *,
         CASE t WHEN 'text' THEN 'textbox' WHEN 'email' THEN 'textbox' WHEN 'checkbox' THEN 'checkbox'
                WHEN 'number' THEN 'spinbutton' ELSE 'button' END AS role,
         (mode = 0 AND id_attr IS NOT NULL) OR mode = 1 AS has_label,
         (mode = 0 AND id_attr IS NOT NULL) OR mode IN (1, 2) AS has_label_value,
         CASE WHEN mode IN (1, 2) OR (mode = 0 AND id_attr IS NOT NULL) OR t = 'submit' THEN p_name END AS name,
         CASE WHEN t IN ('text', 'email') AND k % 2 = 0 THEN p_type END AS ph
  FROM f)"""

FORM_COUNTS = FORM + r""",
c AS (
  SELECT a.*,
    (SELECT count(*) FROM g b WHERE b.page_id = a.page_id AND b.role = a.role AND b.name IS NOT NULL
            AND contains(lower(b.name), lower(a.name))) AS n_role,
    (SELECT count(*) FROM g b WHERE b.page_id = a.page_id AND b.role = a.role AND b.name IS NOT NULL
            AND contains(lower(b.name), lower(a.name)) AND b.pos < a.pos) AS i_role,
    (SELECT count(*) FROM g b WHERE b.page_id = a.page_id AND b.has_label_value
            AND contains(lower(b.p_name), lower(a.p_name))) AS n_label,
    (SELECT count(*) FROM g b WHERE b.page_id = a.page_id AND b.has_label_value
            AND contains(lower(b.p_name), lower(a.p_name)) AND b.pos < a.pos) AS i_label,
    (SELECT count(*) FROM g b WHERE b.page_id = a.page_id AND b.ph IS NOT NULL
            AND contains(lower(b.ph), lower(a.ph))) AS n_ph,
    (SELECT count(*) FROM g b WHERE b.page_id = a.page_id AND b.ph IS NOT NULL
            AND contains(lower(b.ph), lower(a.ph)) AND b.pos < a.pos) AS i_ph,
    'html > body:nth-child(2) > form:nth-child(1) > div:nth-child(' || a.pos || ') > '
      || CASE WHEN a.mode = 0 AND a.id_attr IS NOT NULL THEN 'input:nth-child(2)'
              WHEN a.mode = 1 THEN 'label:nth-child(1) > input:nth-child(1)' ELSE 'input:nth-child(1)' END AS cpath
  FROM g a),
l AS (
  SELECT *, list_filter([
    CASE WHEN tattr = 'data-testid' THEN {'s': 'test-id', 'pw': 'getByTestId(''part-' || k || ''')', 'lr': false,
                                          'u': true, 'n': 1::BIGINT, 'i': 0::BIGINT} END,
    CASE WHEN tattr IN ('data-cy', 'data-qa') THEN {'s': 'css', 'pw': 'locator(''[' || tattr || '="part-' || k || '"]'')',
                                                   'lr': false, 'u': true, 'n': 1::BIGINT, 'i': 0::BIGINT} END,
    CASE WHEN name IS NOT NULL THEN {'s': 'role', 'pw': 'getByRole(''' || role || ''', { name: ''' || name || ''' })',
                                     'lr': false, 'u': n_role = 1, 'n': n_role, 'i': i_role} END,
    CASE WHEN has_label THEN {'s': 'label', 'pw': 'getByLabel(''' || p_name || ''')', 'lr': false,
                              'u': n_label = 1, 'n': n_label, 'i': i_label} END,
    CASE WHEN ph IS NOT NULL THEN {'s': 'placeholder', 'pw': 'getByPlaceholder(''' || ph || ''')', 'lr': false,
                                   'u': n_ph = 1, 'n': n_ph, 'i': i_ph} END,
    CASE WHEN id_attr IS NOT NULL THEN {'s': 'id', 'pw': 'locator(''#' || id_attr || ''')', 'lr': k % 3 = 1,
                                        'u': true, 'n': 1::BIGINT, 'i': 0::BIGINT} END,
    {'s': 'css', 'pw': 'locator(''' || cpath || ''')', 'lr': true, 'u': true, 'n': 1::BIGINT, 'i': 0::BIGINT}
  ], lambda x: x IS NOT NULL) AS cands
  FROM c),
r AS (
  SELECT *, CASE WHEN len(list_filter(cands, lambda x: NOT x.lr)) > 0 THEN list_filter(cands, lambda x: NOT x.lr)
                 ELSE cands END AS pool,
         len(list_filter(cands, lambda x: x.u AND NOT x.lr)) > 0 AS has_us
  FROM l),
q AS (
  SELECT *, CASE WHEN len(list_filter(pool, lambda x: x.u)) > 0 THEN list_filter(pool, lambda x: x.u)[1]
                 ELSE pool[1] END AS prim
  FROM r)"""

ORACLE_SQL.update({
    "form_inputs": FORM + r"""
SELECT page_id, k AS p_partkey, role, name AS accessible_name, 'form#f-' || brand_no AS form_group, t AS type,
       ph AS placeholder, p_size % 4 = 1 AS is_required,
       CASE WHEN t = 'checkbox' THEN p_size % 2 = 0 END AS is_checked,
       NULLIF(concat_ws(' ',
         CASE WHEN tattr IN ('data-cy', 'data-qa') THEN tattr
              || ' present; getByTestId only reads data-testid unless the team configures testIdAttribute to '
              || tattr || '.' END,
         CASE WHEN k % 3 = 1 THEN 'Element id ''rc_select_' || k
              || ''' looks framework-generated and may change between builds; demoted to last resort.' END), '')
         AS context_note
FROM g""",
    "loc_form_rank": FORM_COUNTS + r"""
SELECT page_id, k AS p_partkey, prim.s AS strategy, prim.pw AS playwright, prim.u AS is_unique,
       CASE WHEN NOT prim.u THEN prim.n || ' matches in frame; use .nth(' || prim.i || ').' END AS disambiguation,
       least(4, len(cands) - 1 - CASE WHEN has_us THEN len(list_filter(cands, lambda x: x.lr)) ELSE 0 END)::BIGINT
         AS n_fallbacks
FROM q""",
})

# ---------------------------------------------------------------------------
# frame pages (rendered from nation / region, see plans/render.py)
# ---------------------------------------------------------------------------
FRAMES = r"""
WITH n AS (
  SELECT (800000 + n_nationkey)::BIGINT AS page_id, n_nationkey AS nk, n_regionkey AS rk, n_name,
         CASE n_nationkey % 3 WHEN 0 THEN 'iframe#reg' WHEN 1 THEN 'iframe[name="reg-' || n_regionkey || '"]'
              ELSE 'iframe >> nth=0' END AS sel,
         CASE n_nationkey % 3 WHEN 1 THEN 'reg-' || n_regionkey ELSE '' END AS fname,
         n_regionkey % 2 = 0 AS same,
         CASE WHEN n_regionkey % 2 = 0 THEN 'http://www.regions.test/nation/' || n_nationkey
              ELSE 'http://n' || n_nationkey || '.nations.test/nation/' || n_nationkey END AS url
  FROM nation),
r AS (SELECT (900000 + r_regionkey)::BIGINT AS page_id, r_regionkey AS rk, r_name,
             'http://www.regions.test/region/' || r_regionkey AS url FROM region)"""

ORACLE_SQL.update({
    "frm_tree": FRAMES + """
SELECT page_id, '' AS frame_path, url, '' AS name, true AS same_origin, true AS reachable FROM r
UNION ALL SELECT page_id, '', url, '', true, true FROM n
UNION ALL SELECT page_id, sel, 'http://www.regions.test/region/' || rk, fname, same, same FROM n
UNION ALL SELECT page_id, 'iframe >> nth=1', 'about:srcdoc', '', true, true FROM n""",
    "frm_nodes": FRAMES + """
SELECT page_id, '' AS frame_path, r_name AS accessible_name,
       'getByRole(''button'', { name: ''' || r_name || ''' })' AS playwright, true AS is_unique FROM r
UNION ALL SELECT page_id, '', n_name, 'getByRole(''button'', { name: ''' || n_name || ''' })', true FROM n
UNION ALL SELECT n.page_id, n.sel, r.r_name, 'getByRole(''button'', { name: ''' || r.r_name || ''' })', true
          FROM n JOIN r ON n.rk = r.rk WHERE n.same
UNION ALL SELECT page_id, 'iframe >> nth=1', 'Inline ' || n_name,
                 'getByRole(''button'', { name: ''Inline ' || n_name || ''' })', true FROM n""",
    "frm_marker": FRAMES + """
SELECT page_id, '' AS frame_path, NULLIF(fname, '') AS accessible_name, 'locator(''' || sel || ''')' AS playwright,
       true AS is_unique,
       'Cross-origin iframe (http://www.regions.test/region/' || rk
         || '): DOM is unreachable from this context and was NOT extracted. Tests can still interact via frameLocator('''
         || sel || ''').' AS context_note
FROM n WHERE NOT same""",
    "frm_meta": FRAMES + """
SELECT page_id, 1::BIGINT AS node_count, 1::BIGINT AS frame_count, false AS truncated FROM r
UNION ALL SELECT page_id, 3, 3, false FROM n""",
})

ORACLE_SQL.update({
    "gate_selector": """
SELECT page_id, regexp_matches(html, '<div class="ad"') AS present,
       CASE WHEN regexp_matches(html, '<div class="ad"') THEN NULL ELSE 'wait_selector_timeout' END AS error_code
FROM pages""",
    # the captured pages nest at most a few levels: no page reaches depth 51
    "cap_depth": """
SELECT page_id, false AS depth_capped, false AS depth_note FROM pages""",
})

ORACLE_SQL.update({
    "diff_states": """
SELECT 'http://c' || (o_custkey % 7) || '.shop.test/board/' || o_custkey || '?page=' || chunk AS url,
       '' AS frame_path, 'getByTestId(''toast-' || o_custkey || '-' || chunk || ''')' AS locator,
       1::BIGINT AS occurrence, 'added' AS change, 'status' AS role, 'Stored' AS accessible_name
FROM (SELECT DISTINCT o_custkey,
             (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 25 AS chunk FROM orders)""",
})


def _style_sql(mobile: bool) -> str:
    """Visibility of the buttons of the style pages, rule by rule."""
    return f"""
WITH c AS (SELECT c_custkey AS k, c_custkey // 25 AS page_id, lower(c_mktsegment) AS seg, c_acctbal < 0 AS low, c_acctbal > 8000 AS gold FROM customer),
p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY page_id) AS n, coalesce(lag(gold) OVER w, false) AS after_gold,
coalesce(bool_or(gold) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS later FROM c WINDOW w AS (PARTITION BY page_id ORDER BY k))
SELECT page_id::BIGINT AS page_id, k::BIGINT AS c_custkey, NOT (
low OR (pos % 7 = 2 AND k % 3 = 0) OR ({str(mobile).lower()} AND seg = 'building' AND k % 3 = 2)
OR (later AND k % 4 = 3 AND k % 3 = 0) OR (seg = 'household' AND k % 4 = 2)
OR CASE WHEN pos = n AND k % 3 = 1 THEN true WHEN seg = 'furniture' AND k % 4 = 0 AND k % 3 = 0 THEN false ELSE after_gold OR seg = 'furniture' END) AS is_visible FROM p"""


_GATE_TESTS = {
    "div.ad": "contains(html, '<div class=\"ad\">')",
    "main .ad": "false",
    "nav + div.ad": "regexp_matches(html, '</nav>(<!--[^>]*-->)?<div class=\"ad\">')",
    "article > h1": "contains(html, '<article><h1>')",
    "nav li:nth-child(5) > a[href^='/t']": "starts_with(hrefs[5], '/t')",
    "html[lang|=fr] footer": "contains(html, '<html lang=\"fr\">') AND contains(html, '<footer>')",
    "li:nth-last-child(2) ~ li > a:not([href$='.'], [href$=','])": "len(hrefs) >= 2 AND NOT ends_with(hrefs[-1], '.') AND NOT ends_with(hrefs[-1], ',')",
    "body > *:not(nav, div):first-of-type b": "regexp_matches(html, '<article>(.|\\n)*<b>')",
}
_GATE_REFUSED = ["p >> text=the", "a:has(b)"]

ORACLE_SQL |= {
    "vis_styles": _style_sql(False),
    "vis_media": _style_sql(True),
    "vis_notes": "SELECT DISTINCT (c_custkey // 25)::BIGINT AS page_id, 'li:has(.b0) button' AS selector, 'pseudo-class not evaluated' AS reason FROM customer",
    "gate_selectors": "WITH d AS (SELECT page_id, html, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hrefs FROM pages) " + " UNION ALL ".join(
        [f"SELECT page_id, {_lit(s)} AS selector, coalesce({t}, false) AS present, CASE WHEN coalesce({t}, false) THEN NULL ELSE 'wait_selector_timeout' END AS error_code FROM d"
         for s, t in _GATE_TESTS.items()]
        + [f"SELECT page_id, {_lit(s)} AS selector, false AS present, 'wait_selector_unsupported' AS error_code FROM d" for s in _GATE_REFUSED]),
}

ORACLE_SQL["loc_match_form"] = """
WITH p AS (SELECT regexp_extract(p_brand, '(\\d+)$', 1)::BIGINT AS b, p_partkey AS k, p_name AS name, lower(p_name) AS low, p_type AS kind, p_size AS size,
(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 20 AS chunk FROM part),
q AS (SELECT b * 100000000 + chunk AS page_id, k, name, low, kind, ['textbox', 'textbox', 'checkbox', 'spinbutton', 'button'][size % 5 + 1] AS role, size % 5 = 4 AS submit,
k % 4 = 2 AS aria, (k % 4 = 0 AND k % 3 < 2) OR k % 4 = 1 AS labelled, k % 4 = 1 AS wrapped, CASE WHEN size % 5 < 2 AND k % 2 = 0 THEN kind END AS hint,
CASE k % 3 WHEN 0 THEN 'p' || k WHEN 1 THEN 'rc_select_' || k END AS id FROM p),
c AS (SELECT page_id, 'test-id' AS strategy, '' AS role, 'part-' || k AS value, 1 AS n FROM q WHERE k % 6 = 0
UNION ALL SELECT page_id, 'css', '', '[' || CASE k % 6 WHEN 1 THEN 'data-cy' ELSE 'data-qa' END || '="part-' || k || '"]', 1 FROM q WHERE k % 6 IN (1, 2)
UNION ALL SELECT page_id, 'id', '', id, 1 FROM q WHERE id IS NOT NULL
UNION ALL SELECT page_id, 'role', role, name, (SELECT count(*) FROM q o WHERE o.page_id = q.page_id AND o.role = q.role AND (o.aria OR o.labelled OR o.submit) AND contains(o.low, q.low)) FROM q WHERE aria OR labelled OR submit
UNION ALL SELECT page_id, 'label', '', name, (SELECT count(*) FROM q o WHERE o.page_id = q.page_id AND (o.aria OR o.labelled) AND contains(o.low, q.low)) FROM q WHERE labelled
UNION ALL SELECT page_id, 'placeholder', '', hint, (SELECT count(*) FROM q o WHERE o.page_id = q.page_id AND contains(lower(o.hint), lower(q.hint))) FROM q WHERE hint IS NOT NULL
UNION ALL SELECT page_id, 'text', '', name, (SELECT count(*) FILTER (o.labelled AND NOT (o.wrapped AND o.submit)) + count(*) FILTER (o.submit) FROM q o WHERE o.page_id = q.page_id AND contains(o.low, q.low)) FROM q WHERE labelled)
SELECT DISTINCT page_id::BIGINT AS page_id, strategy, role, value, n::BIGINT AS match_count FROM c"""


# the frames of every nested page: (page_id, frame_path, url, name) and the name of the one node in it
_NESTED = """
WITH RECURSIVE s AS (SELECT s_suppkey::BIGINT AS k FROM supplier),
ring AS (SELECT DISTINCT k % 5 AS j FROM s),
leaf(page_id, path, j, seen) AS (
SELECT k * 10 + 1, 'iframe >> nth=2', k % 5, [k % 5] FROM s WHERE k % 4 = 0
UNION ALL SELECT k * 10, 'iframe[name="next"] > iframe >> nth=2', k % 5, [k % 5] FROM s WHERE k % 4 = 0
UNION ALL SELECT -j * 10 - 10 + v, '', j, [j] FROM ring, (VALUES (2), (3)) t(v)
UNION ALL SELECT page_id, path || CASE path WHEN '' THEN '' ELSE ' > ' END || 'iframe#ring', (j + 1) % 5, list_append(seen, (j + 1) % 5) FROM leaf
WHERE j IN (SELECT j FROM ring) AND len(list_distinct(seen)) = len(seen)),
f AS (SELECT k * 10 AS page_id, '' AS frame_path, 'http://s.test/a/' || k AS url, '' AS name, 'main ' || k AS node, NULL AS href FROM s
UNION ALL SELECT k * 10, 'iframe[name="next"]', 'http://s.test/' || CASE k % 2 WHEN 0 THEN 'b' ELSE 'a' END || '/x' || k, 'next', CASE k % 2 WHEN 0 THEN 'to ' || k END, 'http://s.test/b/y' FROM s
UNION ALL SELECT k * 10, 'iframe[name="next"] > iframe >> nth=0', 'about:blank', '', NULL, NULL FROM s WHERE k % 2 = 0
UNION ALL SELECT k * 10, 'iframe[name="next"] > iframe >> nth=1', 'about:srcdoc', '', 'inner ' || k, NULL FROM s WHERE k % 2 = 0
UNION ALL SELECT k * 10 + 1, '', 'http://s.test/b/x' || k, '', 'to ' || k, 'http://s.test/b/y' FROM s WHERE k % 2 = 0
UNION ALL SELECT k * 10 + 1, 'iframe >> nth=0', 'about:blank', '', NULL, NULL FROM s WHERE k % 2 = 0
UNION ALL SELECT k * 10 + 1, 'iframe >> nth=1', 'about:srcdoc', '', 'inner ' || k, NULL FROM s WHERE k % 2 = 0
UNION ALL SELECT page_id, path, 'http://s.test/c/' || j, '', CASE WHEN len(list_distinct(seen)) < len(seen) OR j NOT IN (SELECT j FROM ring) THEN NULL
WHEN path = '' AND -page_id % 10 = 8 THEN 'old ' || j ELSE 'new ' || j END, NULL FROM leaf)
"""

ORACLE_SQL |= {
    "frm_nested": _NESTED + "SELECT page_id::BIGINT AS page_id, frame_path, url, name, true AS same_origin, true AS reachable FROM f",
    "frm_captures": _NESTED + """SELECT page_id::BIGINT AS page_id, frame_path, node AS accessible_name,
'getByRole(''' || CASE WHEN href IS NULL THEN 'button' ELSE 'link' END || ''', { name: ''' || node || ''' })' AS playwright, true AS is_unique, href FROM f WHERE node IS NOT NULL""",
    "frm_blank": _NESTED + "SELECT page_id::BIGINT AS page_id, count(node)::BIGINT AS node_count, count(*)::BIGINT AS frame_count FROM f GROUP BY page_id",
}

ORACLE_SQL["diff_toast"] = """
WITH e AS (SELECT event_id AS id, event_type AS t, event_id // 20 AS page, min(event_id) OVER (PARTITION BY event_id // 20) = event_id AS is_first,
count(*) FILTER (event_type NOT IN ('signup', 'view')) OVER (PARTITION BY event_id // 20) AS kept,
count(*) FILTER (event_type <> 'signup') OVER (PARTITION BY event_id // 20) AS early, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY event_id // 20) AS late FROM events),
d AS (SELECT page, CASE t WHEN 'error' THEN 'getByRole(''button'', { name: ''Error'' })' ELSE 'getByTestId(''e' || id || ''')' END AS locator,
CASE WHEN t = 'signup' THEN 'added' WHEN t = 'view' THEN 'removed' WHEN t = 'click' THEN 'changed' WHEN t = 'purchase' AND is_first AND kept > 1 THEN 'moved' END AS change,
upper(left(t, 1)) || substr(t, 2) AS accessible_name, CASE t WHEN 'signup' THEN NULL ELSE false END AS was_disabled, CASE t WHEN 'view' THEN NULL ELSE t = 'click' END AS is_disabled FROM e
UNION ALL SELECT DISTINCT page, 'getByRole(''button'', { name: ''Error'' })', 'added', 'Error', NULL::BOOLEAN, false FROM e WHERE page % 2 = 0 AND late > 0)
SELECT 'http://toast.test/' || page AS url, locator, change, 'button' AS role, accessible_name, was_disabled, is_disabled FROM d WHERE change IS NOT NULL"""


def _toast_json_sql() -> str:
    """The JSON document of the toast pages before the interaction, written out from the events."""
    def lines(level: int, *rows: str) -> str:
        return "'" + "' || chr(10) || '".join("  " * level + r for r in rows) + "'"

    role, text = "getByRole(''button'', { name: ''' || name || ''' })", "getByText(''' || name || ''')"
    unique = "' || (n = 1) || '"

    def locator(level: int, strategy: str, expression: str, is_unique: str, hint: str = "") -> str:
        return lines(level, f'  "strategy": "{strategy}",', f'  "playwright": "{expression}",', f'  "is_unique": {is_unique}') + hint + " || chr(10) || " + lines(level, "}")

    css = "locator(''html > body:nth-child(2) > button:nth-child(' || pos || ')'')"
    hint = """ || CASE WHEN n > 1 THEN ',' || chr(10) || '        "disambiguation": "' || n || ' matches in frame; use .nth(' || nth || ')."' ELSE '' END"""
    item = "'        {' || chr(10) || "
    comma = " || ',' || chr(10) || "
    node = (lines(2, "{", '  "kind": "element",', '  "tag": "button",', '  "role": "button",', '  "in_shadow": false,', '  "frame_path": [],', '  "form_group": null,',
                  "  \"accessible_name\": \"' || name || '\",", '  "primary_locator": {')
            + " || chr(10) || CASE WHEN t <> 'error' THEN " + locator(3, "test-id", "getByTestId(''e' || id || ''')", "true") + " ELSE " + locator(3, "role", role, unique, hint)
            + " END || ',' || chr(10) || " + lines(3, '"fallback_locators": [') + " || chr(10) || CASE WHEN t <> 'error' THEN " + item + locator(4, "role", role, unique) + comma
            + item + locator(4, "text", text, unique) + " ELSE " + item + locator(4, "text", text, unique) + " || CASE WHEN n > 1 THEN ',' || chr(10) || " + item + locator(4, "css", css, "true")
            + " ELSE '' END END || chr(10) || "
            + lines(3, "],", '"properties": {', '  "type": "submit",', '  "placeholder": null,', "  \"text_content\": \"' || name || '\",", '  "href": null,', '  "is_required": null,',
                    "  \"is_disabled\": ' || (t = 'error' AND id % 2 = 0) || ',", '  "is_checked": null,', '  "is_visible": true', "}") + " || chr(10) || '    }'")
    doc = (lines(0, "{", '  "schema_version": "1.1",', '  "page_metadata": {', '    "title": "Toast",', "    \"url\": \"http://toast.test/' || page || '\",", '    "captured_at": "",',
                 "    \"node_count\": ' || count(*) || ',", '    "frame_count": 1,', '    "truncated": false,', '    "notes": []', "  },", '  "interactive_nodes": [')
           + " || chr(10) || string_agg(node, ',' || chr(10) ORDER BY id) || chr(10) || " + lines(0, "  ]", "}"))
    return f"""
WITH e AS (SELECT event_id AS id, event_type AS t, event_id // 20 AS page, upper(left(event_type, 1)) || substr(event_type, 2) AS name,
row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY event_id // 20, event_type) AS n,
row_number() OVER (PARTITION BY event_id // 20, event_type ORDER BY event_id) - 1 AS nth FROM events WHERE event_type <> 'signup'),
x AS (SELECT page, id, {node} AS node FROM e),
d AS (SELECT page, {doc} AS doc FROM x GROUP BY page)
SELECT page::BIGINT AS page_id, length(doc)::BIGINT AS json_chars, sha256(doc) AS json_sha256 FROM d"""


ORACLE_SQL |= {
    "sink_toast": _toast_json_sql(),
    "rep_payload_totals": f"""
SELECT host, grouping(host)::INTEGER AS corpus, count(*)::BIGINT AS pages, sum(raw_chars)::BIGINT AS raw_chars, sum(cleaned_chars)::BIGINT AS cleaned_chars,
sum(raw_tokens)::BIGINT AS raw_tokens, sum(cleaned_tokens)::BIGINT AS cleaned_tokens,
round((1.0::DOUBLE - sum(cleaned_chars)::DOUBLE / sum(raw_chars)::DOUBLE) * 100, 1) AS reduction_pct
FROM ({ORACLE_SQL["rep_payload"]}) p JOIN (SELECT page_id, {HOST} AS host FROM pages) h USING (page_id) GROUP BY ROLLUP (host)""",
    "err_rows": f"""
SELECT 'gate' AS stage, page_id AS key, NULL AS item, error_code AS code, message FROM ({ORACLE_SQL["gate_hosts"]}) WHERE NOT allowed
UNION ALL SELECT 'selector', page_id, 'main .ad', 'wait_selector_timeout', 'wait_selector ''main .ad'' did not appear within 15s.' FROM pages
UNION ALL SELECT 'selector', page_id, 'a:has(b)', 'wait_selector_unsupported', 'wait_selector ''a:has(b)'' is not evaluated: pseudo-class not evaluated.' FROM pages
UNION ALL SELECT 'action', list_id, step::VARCHAR, code, 'Action ' || step || ' (' || coalesce(type, 'no type') || ') was refused: ' || replace(code, '_', ' ') || '.' FROM ({ORACLE_SQL["lint_actions"]}) WHERE code IS NOT NULL
UNION ALL SELECT DISTINCT 'action', list_id, NULL, 'too_many_actions', 'The action list has more than 20 actions.' FROM ({ORACLE_SQL["lint_actions"]}) WHERE list_too_long""",
}
