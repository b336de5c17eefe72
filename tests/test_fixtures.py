"""Fixture pages (own markup, situations of the reference's end-to-end tests)
run through the whole Spark pipeline; expected values derived by hand."""

import pytest
from pyspark.sql import functions as F

from pagelens.plans.extract import ExtractOptions, Extraction
from pagelens.schema import NOTE_CLOSED_SHADOW, NOTE_EMPTY, NOTE_LIVE_REGION

FIXTURES = {
    1: ("http://app.test/login", """<html><head><title>Login</title></head><body>
<form id="login"><label for="email">Email address</label><input id="email" type="email" required>
<fieldset disabled><legend id="lg">Options</legend><input type="checkbox" id="cb" checked aria-label="Remember me"></fieldset>
<button type="submit" disabled>Sign in</button></form>
<form><input name="q" placeholder="Search"></form>
<section id="billing"><button>Pay</button></section></body></html>"""),
    2: ("http://app.test/vis", """<body><div style="display:none"><button>b1</button></div>
<button style="visibility:hidden">b2</button><div style="opacity:0"><button>b3</button></div>
<button hidden>b4</button><div aria-hidden="true"><button>b5</button></div>
<button style="width:0;height:0">b6</button><button style="position:fixed">b7</button><button>b8</button></body>"""),
    3: ("http://app.test/prio", """<label for="u">User name</label><input id="u" data-testid="user-field" placeholder="Type your name">"""),
    4: ("http://app.test/amb", """<button>Save</button><div data-testid="card-2"><button>Save</button></div>"""),
    5: ("http://app.test/open", """<div id="host"><template shadowrootmode="open"><button data-testid="inner">Go</button></template></div>"""),
    6: ("http://app.test/closed", """<div id="closed"><template shadowrootmode="closed"><button>Hidden</button></template><span>light</span></div>"""),
    7: ("http://app.test/frame", """<p>top</p><iframe id="pay" srcdoc="<button>Pay now</button>"></iframe>"""),
    8: ("http://app.test/many", "".join(f"<button>B{i}</button>" for i in range(30))),
    9: ("http://app.test/ids", """<input id="rc_select_7" aria-label="City"><button id=":r3:">Go</button><button id="plain">Stop</button>"""),
    10: ("http://shop.test/dir/page", """<a href="rel/x">R</a><a href="javascript:void(0)">J</a><button>B</button>"""),
    11: ("http://app.test/empty", """<p>Just prose</p>"""),
    12: ("http://app.test/surfaces", """<div role="alert">Saved!</div><div role="status"></div><dialog open aria-label="Confirm">Sure?</dialog>"""),
    13: ("http://app.test/toast", """<div class="toast"><div role="alert"></div><span>Payment failed</span></div>"""),
    14: ("http://app.test/logo", """<a href="/"><img src="l.png" alt="Acme home"></a>"""),
    15: ("http://app.test/deep", "<body>" + "<div>" * 50 + "<button>deep</button>" + "</div>" * 50 + "<button>top</button></body>"),
    16: ("http://app.test/text", """<div>foo <span>foo bar</span></div><p>Foo</p><a href="#x">foo</a>"""),
    17: ("http://app.test/labels", """<span id="l1">First</span><span id="l2">Name</span>
<input aria-labelledby="l1 missing l2"><label>Wrapped <input type="text"></label><label></label>
<input type="submit" value="Send"><input type="image" alt="Go img"><select><option id="o1">One</option></select>"""),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, h) for k, (u, h) in FIXTURES.items()]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def ex(pages):
    return Extraction(pages, ExtractOptions())


@pytest.fixture(scope="module")
def nodes(ex):
    rows = ex.kept_nodes.collect()
    out = {}
    for r in rows:
        out.setdefault(r["page_id"], []).append(r)
    for v in out.values():
        v.sort(key=lambda r: (r["frame_key"], r["doc_order"]))
    return out


@pytest.fixture(scope="module")
def meta(ex):
    return {r["page_id"]: r for r in ex.page_meta.collect()}


def by_name(nodes, page, name):
    return [n for n in nodes[page] if n["accessible_name"] == name][0]


def test_form_grouping_and_states(nodes):
    email = [n for n in nodes[1] if n["tag"] == "input" and n["properties"]["type"] == "email"][0]
    assert email["form_group"] == "form#login"
    assert email["accessible_name"] == "Email address"
    assert email["properties"]["is_required"] is True
    assert email["role"] == "textbox"
    submit = by_name(nodes, 1, "Sign in")
    assert submit["properties"]["is_disabled"] is True and submit["form_group"] == "form#login"
    cb = by_name(nodes, 1, "Remember me")
    assert cb["properties"]["is_checked"] is True and cb["properties"]["is_disabled"] is False
    search = [n for n in nodes[1] if n["properties"]["placeholder"] == "Search"][0]
    assert search["form_group"] == "form:nth(1)"
    assert search["primary_locator"]["playwright"] == "getByPlaceholder('Search')"
    assert by_name(nodes, 1, "Pay")["form_group"] == "section#billing"
    assert any(n["tag"] == "legend" for n in nodes[1])
    assert not any(n["tag"] == "fieldset" for n in nodes[1])


def test_visibility_rules(nodes):
    vis = {n["accessible_name"]: n["properties"]["is_visible"] for n in nodes[2]}
    assert vis == {"b1": False, "b2": False, "b3": False, "b4": False, "b5": False, "b6": False,
                   "b7": True, "b8": True}


def test_hidden_dropped(pages):
    e = Extraction(pages.filter("page_id = 2"), ExtractOptions(include_hidden=False))
    names = sorted(r["accessible_name"] for r in e.kept_nodes.collect())
    assert names == ["b7", "b8"]
    m = e.page_meta.collect()[0]
    assert m["notes"] == ["6 hidden node(s) excluded because include_hidden=false."]


def test_priority_order(ex, nodes):
    n = nodes[3][-1]
    assert n["primary_locator"]["playwright"] == "getByTestId('user-field')"
    assert n["primary_locator"]["is_unique"] is True
    cands = (ex.candidates.filter("page_id = 3").filter(F.col("eid") == [x for x in nodes[3] if x["tag"] == "input"][0]["eid"])
             .orderBy("rank").select("strategy").collect())
    assert [c[0] for c in cands] == ["test-id", "role", "label", "placeholder", "id", "css"]


def test_ambiguous_guidance(nodes):
    saves = [n for n in nodes[4] if n["tag"] == "button"]
    assert [s["primary_locator"]["playwright"] for s in saves] == ["getByRole('button', { name: 'Save' })"] * 2
    assert saves[0]["primary_locator"]["disambiguation"] == "2 matches in frame; use .nth(0)."
    assert saves[1]["primary_locator"]["disambiguation"] == (
        "2 matches in frame; use .nth(1); or scope with getByTestId('card-2') before locating.")
    card = [n for n in nodes[4] if n["tag"] == "div"][0]
    assert card["primary_locator"]["playwright"] == "getByTestId('card-2')"


def test_open_shadow(nodes):
    b = nodes[5][0]
    assert b["in_shadow"] is True and b["primary_locator"]["is_unique"] is True
    assert all(f["strategy"] != "css" for f in b["fallback_locators"])


def test_closed_shadow_marker(nodes):
    assert len(nodes[6]) == 1
    m = nodes[6][0]
    assert m["kind"] == "shadow_boundary" and m["tag"] == "div" and m["context_note"] == NOTE_CLOSED_SHADOW


def test_same_origin_frame(nodes, meta):
    b = [n for n in nodes[7] if n["tag"] == "button"][0]
    assert b["frame_path"] == ["iframe#pay"]
    assert meta[7]["frame_count"] == 2


def test_node_cap(pages):
    e = Extraction(pages.filter("page_id = 8"), ExtractOptions(max_nodes=5))
    m = e.page_meta.collect()[0]
    assert m["node_count"] == 5 and m["truncated"] is True
    assert m["notes"] == ["MAX_NODES (5) hit; traversal stopped early."]


def test_generated_ids(nodes):
    city = by_name(nodes, 9, "City")
    assert city["primary_locator"]["strategy"] != "id"
    assert "rc_select_7" in city["context_note"]
    stop = by_name(nodes, 9, "Stop")
    assert "locator('#plain')" in [f["playwright"] for f in stop["fallback_locators"]]
    go = by_name(nodes, 9, "Go")
    assert go["primary_locator"]["strategy"] == "role"


def test_hrefs(nodes):
    hrefs = {n["accessible_name"]: n["properties"]["href"] for n in nodes[10]}
    assert hrefs == {"R": "http://shop.test/dir/rel/x", "J": None, "B": None}


def test_empty_page(meta):
    assert meta[11]["node_count"] == 0 and meta[11]["notes"] == [NOTE_EMPTY]


def test_surfaces(nodes):
    exprs = {n["role"]: n["primary_locator"]["playwright"] for n in nodes[12]}
    assert exprs["alert"] == "getByRole('alert')"
    assert exprs["status"] == "getByRole('status')"
    assert exprs["dialog"] == "getByRole('dialog', { name: 'Confirm' })"


def test_live_region_borrow(nodes):
    a = nodes[13][0]
    assert a["properties"]["text_content"] == "Payment failed"
    assert a["context_note"] == NOTE_LIVE_REGION


def test_logo_link(nodes):
    a = nodes[14][0]
    assert a["accessible_name"] == "Acme home"
    assert a["primary_locator"]["playwright"] == "getByRole('link', { name: 'Acme home' })"


def test_depth_cap(nodes, meta):
    assert [n["accessible_name"] for n in nodes[15]] == ["top"]
    assert meta[15]["truncated"] is True
    assert meta[15]["notes"] == ["MAX_DEPTH (50) hit; deeper nodes were not traversed."]


def test_text_match_innermost(ex, nodes):
    a = nodes[16][0]
    # innermost elements containing "foo" (case-insensitive): span, p, a
    t = [f for f in a["fallback_locators"] if f["strategy"] == "text"][0]
    assert t["playwright"] == "getByText('foo')" and t["is_unique"] is False
    pairs = ex.match_pairs.filter("page_id = 16 AND strategy = 'text'").count()
    assert pairs == 3


def test_labels_and_names(nodes):
    names = [n["accessible_name"] for n in nodes[17]]
    assert "First Name" in names          # aria-labelledby, missing id skipped
    assert "Wrapped" in names             # wrapping label names the input
    assert "Send" in names and "Go img" in names
    opt = [n for n in nodes[17] if n["tag"] == "option"][0]
    assert opt["properties"]["is_visible"] is False


def test_contract_holds(ex):
    from pagelens.operators.report import contract_violations
    bad = contract_violations(ex.kept_nodes, ex.page_meta).filter("violations > 0").collect()
    assert bad == []


RESPONSIVE = """<html><head><style>
@media (max-width: 600px) { .desk { display: none } }
.muted { visibility: hidden } #gone { display: none !important }
</style></head><body><button class="desk">Buy</button><button class="muted">Mute</button>
<button id="gone" style="display:block">Gone</button><p class="muted"><button style="visibility:visible">Back</button></p></body></html>"""


def test_viewport_media_rules(spark):
    pages = spark.createDataFrame([(1, "http://app.test/r", RESPONSIVE)], "page_id long, url string, html string")
    desk = {r["accessible_name"]: r["properties"]["is_visible"]
            for r in Extraction(pages, ExtractOptions()).kept_nodes.collect()}
    mob = {r["accessible_name"]: r["properties"]["is_visible"]
           for r in Extraction(pages, ExtractOptions(viewport="mobile")).kept_nodes.collect()}
    assert desk == {"Buy": True, "Mute": False, "Gone": False, "Back": True}
    assert mob["Buy"] is False


def test_no_candidate_fallback(spark):
    doc = '<div id="h"><template shadowrootmode="open"><div role="button"></div></template></div>'
    pages = spark.createDataFrame([(1, "http://app.test/b2", doc)], "page_id long, url string, html string")
    n = Extraction(pages, ExtractOptions()).kept_nodes.collect()
    assert len(n) == 1
    p = n[0]["primary_locator"]
    assert p["strategy"] == "css" and p["is_unique"] is False
    assert p["playwright"] == "locator('div')"
    assert p["disambiguation"] == "No usable locator candidate was derived for this node; locate it manually."


def test_salted_match_on_a_large_frame(spark):
    """One frame with 9,000 equal links spans three salt buckets of the match join;
    counts and nth must stay exact, and the node budget still caps the nodes."""
    doc = "<nav>" + "".join('<a href="/x">dup</a>' for _ in range(9000)) + "</nav>"
    pages = spark.createDataFrame([(1, "http://big.test/", doc)], "page_id long, url string, html string")
    e = Extraction(pages, ExtractOptions())
    rows = sorted(e.kept_nodes.select("doc_order", "primary_locator", "primary_count", "primary_nth").collect(),
                  key=lambda r: r["doc_order"])
    assert len(rows) == 5000
    assert rows[0]["primary_count"] == 9000 and rows[0]["primary_nth"] == 0
    assert rows[4999]["primary_nth"] == 4999
    assert rows[4999]["primary_locator"]["disambiguation"] == "9000 matches in frame; use .nth(4999)."
    m = e.page_meta.collect()[0]
    assert m["truncated"] is True and m["notes"] == ["MAX_NODES (5000) hit; traversal stopped early."]


def test_elements_below_the_depth_cap_keep_their_facts(spark):
    """A hidden button far below the traversal's cap is no match; a labelled one there keeps its image name."""
    deep = "<div>" * 60 + '<button style="visibility:hidden">Buy</button>' + "</div>" * 60
    pages = spark.createDataFrame([(1, "http://app.test/d", f"<body><button>Buy</button>{deep}</body>")],
                                  "page_id long, url string, html string")
    n = Extraction(pages, ExtractOptions()).kept_nodes.collect()
    assert [(x["primary_count"], x["primary_locator"]["is_unique"]) for x in n] == [(1, True)]


def test_links_and_markers_of_src_frames(spark):
    """Relative links resolve against the frame's own url; a marker is visible only when its host is."""
    pages = spark.createDataFrame([
        (1, "http://b.test/x/host", '<iframe src="/y/z/frame"></iframe><iframe id="n" src="http://o.test/" style="display:none"></iframe>'
                                    '<iframe id="s" src="http://o.test/"></iframe><iframe srcdoc="<a href=w>W</a>"></iframe>'),
        (2, "http://b.test/y/z/frame", '<a href="q">Q</a>')], "page_id long, url string, html string")
    rows = [r for r in Extraction(pages, ExtractOptions()).kept_nodes.collect() if r["page_id"] == 1]
    hrefs = {r["accessible_name"]: r["properties"]["href"] for r in rows if r["tag"] == "a"}
    assert hrefs == {"Q": "http://b.test/y/z/q", "W": "http://b.test/x/w"}
    shown = {r["primary_locator"]["playwright"]: r["properties"]["is_visible"] for r in rows if r["kind"] == "cross_origin_frame"}
    assert shown == {"locator('iframe#n')": False, "locator('iframe#s')": True}
