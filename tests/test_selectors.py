"""The selector compiler and its structural matching, style rules and presence gates."""

import pytest
from pyspark.sql import functions as F

from pagelens.operators import gate, selectors
from pagelens.plans.extract import Extraction, ExtractOptions, persist

PAGE = """<html lang="fr-CA"><head><title>t</title></head><body class="a b">
<main class="ad"><p id="p1" class="x">one</p><p id="p2">two <b id="b1">x</b></p><div id="e"></div></main>
<ul id="u"><li id="l1" class="x">1</li><li id="l2" data-k="Ab c">2</li><li id="l3" class="x y">3<ul id="v"><li id="l4" class="x">4</li></ul></li></ul>
<form><input id="i1" type="checkbox" checked disabled><input id="i2" required><a id="a1" href="/q.pdf">q</a></form>
</body></html>"""

CASES = {
    "main .ad": [], "main.ad": ["main"], "body .ad": ["main"], "p": ["p1", "p2"], "#p1": ["p1"], "p#p2 > b": ["b1"], "main b": ["b1"], "main > b": [],
    "p + p": ["p2"], "p ~ div": ["e"], "li + li": ["l2", "l3"], "#l1 ~ li": ["l2", "l3"], "ul ul li": ["l4"], "ul > li": ["l1", "l2", "l3", "l4"],
    "#u li.x": ["l1", "l3", "l4"], "#u > li.x": ["l1", "l3"], ".x.y": ["l3"], ".x, .y, #a1": ["p1", "l1", "l3", "l4", "a1"],
    "[data-k]": ["l2"], "[data-k='Ab c']": ["l2"], "[data-k=\"ab C\" i]": ["l2"], "[data-k~=c]": ["l2"], "[data-k^=Ab]": ["l2"], "[data-k$=\" c\"]": ["l2"], "[data-k*='b c']": ["l2"],
    "[lang|=fr] #a1": ["a1"], "[data-k=ab]": [], "[data-k^='']": [],
    "li:first-child": ["l1", "l4"], "li:last-child": ["l3", "l4"], "li:only-child": ["l4"], "li:nth-child(2)": ["l2"], "li:nth-child(odd)": ["l1", "l3", "l4"],
    "li:nth-child(-n + 2)": ["l1", "l2", "l4"], "li:nth-last-child(2)": ["l2"], "p:first-of-type": ["p1"], "div:first-of-type": ["e"], "input:nth-of-type(2)": ["i2"],
    "input:last-of-type": ["i2"], "a:only-of-type": ["a1"], "li:not(.x)": ["l2"], "li:not(.x, [data-k])": [], "li:is(.y, #l1)": ["l1", "l3"], ":where(#u) > li:not(:first-child)": ["l2", "l3"],
    "div:empty": ["e"], "input:checked": ["i1"], "input:disabled": ["i1"], "input:enabled": ["i2"], ":required": ["i2"], "a:link": ["a1"], "li:hover": [], "p::before": [],
    "body *:not(p) > b": [], "* > b": ["b1"], "li\n>\tul   li": ["l4"], "UL > LI#l1": ["l1"], "main+ul>li~li": ["l2", "l3"], ":root > body > main > p b": ["b1"],
}
REFUSED = ["a:has(b)", "p >> b", "> p", "p >", "a[", "li:nth-child(x)", "", "p, , a:contains(x)", ":not(p b)", "svg|a", "p" * 5000, "a:not(:not(b))"]


@pytest.fixture(scope="module")
def page(spark):
    return Extraction(spark.createDataFrame([(1, "http://b.test/", PAGE), (2, "http://b.test/2", "<p>other</p>")], "page_id long, url string, html string"), ExtractOptions())


def test_selectors_match(spark, page):
    rows = [(i, s) for i, s in enumerate([*CASES, *REFUSED])]
    items = selectors.compile_selectors(spark.createDataFrame(rows, "no int, whole string").select("no", F.posexplode_outer(selectors.split_list(F.col("whole"))).alias("item", "selector")))
    items = persist(items)
    refused = {r["no"] for r in items.filter("reason is not null").collect()}
    assert refused == set(range(len(CASES), len(rows)))
    hits = selectors.match_selectors(page.elements, items, ["no", "item"], [], persist).join(page.elements, ["page_id", "frame_id", "eid"])
    got = {}
    for r in hits.filter("page_id = 1").select("no", "tag", F.col("attrs")["id"].alias("id")).distinct().collect():
        got.setdefault(r["no"], set()).add(r["id"] or r["tag"])
    assert {s: got.get(i, set()) for i, s in enumerate(CASES)} == {s: set(v) for s, v in CASES.items()}


def test_weights(spark):
    want = {"p": 1, "*": 0, "#a .b p": 1_001_001, "a:not(#x, .y)": 1_000_001, ":where(#x) p": 1, ":is(.a, p) q": 1001, "a::before": 2, "[x]:hover:nth-child(2)": 3000}
    got = selectors.compile_selectors(spark.createDataFrame([(s,) for s in want], "selector string")).collect()
    assert {r["selector"]: r["weight"] for r in got} == want


def test_presence(spark, page):
    out = gate.presence(page.pages.select("page_id", "url"), page.elements, ["main .ad", "main.ad, zz", "p", "p, a:has(b)"], persist).collect()
    got = {(r["page_id"], r["selector"]): (r["present"], r["error"]["code"] if r["error"] else None) for r in out}
    late, refused = (False, "wait_selector_timeout"), (False, "wait_selector_unsupported")
    assert got == {(1, "main .ad"): late, (2, "main .ad"): late, (1, "main.ad, zz"): (True, None), (2, "main.ad, zz"): late, (1, "p"): (True, None), (2, "p"): (True, None),
                   (1, "p, a:has(b)"): refused, (2, "p, a:has(b)"): refused}
    passed, failed = gate.presence_gate(page.pages.select("page_id", "url"), page.elements, "#u li", persist)
    assert [r["page_id"] for r in passed.collect()] == [1]
    assert [r["error"]["message"] for r in failed.collect()] == ["wait_selector '#u li' did not appear within 15s."]


SHEETS = {
    ".modal .x { display: none }": False,
    ".modal > .x { display: none }": True,  # a div stands between
    "@media (max-width: 40em) { .x { display: none } }": True,
    "@media screen, print { .x { display: none } }": False,
    "@media not screen { .x { display: none } }": True,
    "@media (prefers-color-scheme: dark) { .x { display: none } }": True,
    "@media print { .q { color: red } } .x { display: none }": False,
    "@media print { @supports (a: b) { .q { color: red } } .x { display: none } }": True,
    "@layer base { .x { opacity: 0 } }": False,
    "@container (width > 1px) { .x { display: none } }": True,
    ".x { display: none } .modal .x { display: inline }": True,
    ".modal .x { display: inline } .x { display: none }": True,
    ".modal .x { display: inline } .x { display: none !important }": False,
    "#m .x { visibility: hidden } button { visibility: visible }": False,
    ".x:not(.y) { visibility: hidden }": False,
    "a:has(b) { display: none } .x { opacity: 0.0 }": False,
    "}} .x { display: none }": False,
    ".x { display: none": False,
}


def test_style_sheets(spark):
    doc = '<style>{}</style><div class="modal" id="m"><div><button class="x">save</button></div></div>'
    pages = [(i, f"http://b.test/{i}", doc.format(s)) for i, s in enumerate(SHEETS)]
    pages += [(100, "http://b.test/100", '<style media="print">.x{display:none}</style><button class="x">save</button>'), (101, "http://b.test/101", "<style></style><button>save</button>"),
              (102, "http://b.test/102", '<div><template shadowrootmode="open"><style>button{display:none}</style></template></div><button>save</button>')]
    ex = Extraction(spark.createDataFrame(pages, "page_id long, url string, html string"), ExtractOptions())
    got = {r["page_id"]: r["properties"]["is_visible"] for r in ex.kept_nodes.filter("tag = 'button'").collect()}
    assert {s: got[i] for i, s in enumerate(SHEETS)} == SHEETS
    assert got[100] and got[101] and got[102]
    notes = {(r["page_id"], r["selector"], r["reason"]) for r in ex.style_notes.collect()}
    keys = list(SHEETS)
    assert notes == {(keys.index("@container (width > 1px) { .x { display: none } }"), ".x", "at-rule not evaluated"),
                     (keys.index("a:has(b) { display: none } .x { opacity: 0.0 }"), "a:has(b)", "pseudo-class not evaluated")}


def test_long_selectors(spark):
    """Nesting and length that a regular expression's stack or a quadratic search would not survive."""
    many = [".a" * 2000, "[a]" * 1300, "a > " * 900 + "a", ":not(p)" * 500, "(" * 4000, "\"" * 4001, ", ".join(["b[x='1,2']"] * 5000), "[" * 30000, "x" * 300000, ":is(" * 900]
    rows = spark.createDataFrame([(s,) for s in many], "whole string").select(F.explode(selectors.split_list(F.col("whole"))).alias("selector"))
    out = selectors.compile_selectors(rows).select("reason", F.size("steps").alias("n")).collect()
    assert sum(r["n"] == 1 and r["reason"] is None for r in out) >= 5000
