"""Dead letters of a run with a gate in front of the parse, JSON documents, payload totals."""

import json

from pagelens.operators import errors, report
from pagelens.operators.lint import extract_json
from pagelens.plans.extract import extract


def test_gate_in_front_of_the_parse(spark):
    pages = spark.createDataFrame([(1, "http://ok.test/a", "<button>one</button>"), (2, "http://other.test/", "<button>two</button>"), (3, "ftp://ok.test/", "x"), (4, None, "<p>")],
                                  "page_id long, url string, html string")
    ex = extract(pages, allowed_hosts=("ok.test",))
    assert [r["accessible_name"] for r in ex.kept_nodes.collect()] == ["one"]
    rows, watch = errors.counted(ex.errors)
    got = {(r["stage"], r["key"], r["code"]) for r in rows.collect()}
    assert got == {("gate", 2, "url_not_allowed"), ("gate", 3, "url_not_allowed"), ("gate", 4, "url_not_allowed")}
    assert watch.get["all"] == 3 and watch.get["url_not_allowed"] == 3 and watch.get["internal_error"] == 0
    assert extract(pages, allowed_hosts=()).errors.count() == 4
    assert ex.with_options(include_hidden=False).errors.count() == 3


def test_json_documents(spark):
    html = '<title>a "b" \\ é\n</title><main><iframe src="http://o.test/"></iframe><button hidden>x\ty</button><a href="/z">l</a><a href="/z">l</a></main>'
    ex = extract(spark.createDataFrame([(1, "http://ok.test/a", html), (2, "http://ok.test/b", None)], "page_id long, url string, html string"))
    pretty = {r["page_id"]: r["json"] for r in extract_json(ex.extracts).collect()}
    compact = {r["page_id"]: r["json"] for r in extract_json(ex.extracts, pretty=False).collect()}
    for i in (1, 2):
        doc = json.loads(pretty[i])
        assert json.dumps(doc, indent=2, ensure_ascii=False) == pretty[i]
        short = json.loads(compact[i])
        assert json.dumps(short, separators=(",", ":"), ensure_ascii=False) == compact[i] and short["interactive_nodes"] == doc["interactive_nodes"]
    doc = json.loads(pretty[1])
    assert doc["page_metadata"]["title"] == 'a "b" \\ é' and len(doc["interactive_nodes"]) == 4
    assert json.loads(pretty[2])["interactive_nodes"] == []
    # optional members are there only where they say something; the others stand as null
    for n in doc["interactive_nodes"]:
        assert n.get("context_note", "") is not None and n["primary_locator"].get("disambiguation", "") is not None and "form_group" in n


def test_payload_totals(spark):
    rows = spark.createDataFrame([("a", 100, 50, 25, 13), ("a", 100, 100, 25, 25), ("", 0, 0, 0, 0)], "host string, raw_chars long, cleaned_chars long, raw_tokens long, cleaned_tokens long")
    got = {(r["host"], r["corpus"]): (r["pages"], r["raw_chars"], r["reduction_pct"]) for r in report.payload_totals(rows).collect()}
    assert got == {("a", 0): (2, 200, 25.0), ("", 0): (1, 0, None), (None, 1): (3, 200, 25.0)}
