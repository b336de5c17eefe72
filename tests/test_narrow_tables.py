"""Work tables of subjects and nodes hold what later rules read; lists reach the text search as arrays."""

import random

import numpy as np
import pyarrow as pa

from pagelens.operators import textmatch
from pagelens.plans.extract import Extraction, ExtractOptions


def test_tables_hold_what_later_rules_read(spark):
    html = "<html><body><form><label>Name <input id='a' placeholder='p' style='width:0;height:0'></label><button>Save</button></form></body></html>"
    pages = spark.createDataFrame([(1, "http://a.test/", html), (1, "http://a.test/", html)], "page_id long, url string, html string")
    ex = Extraction(pages.limit(1), ExtractOptions(max_nodes=None))
    assert not {"t_start", "st_display", "dn_inh", "base_url", "ctext"} & set(ex.subjects.columns)
    assert not {"attrs", "test_attr", "last_eid", "st_display"} & set(ex.raw_nodes.columns)
    got = {r["tag"]: r for r in ex.kept_nodes.collect()}
    assert got["input"]["properties"]["placeholder"] == "p" and not got["input"]["properties"]["is_visible"]
    assert got["input"]["accessible_name"] == "Name" and got["button"]["form_group"] == "form:nth(0)"


def test_lists_as_arrays():
    rows = [[3, 1], [], [7], []]
    assert [x.tolist() for x in textmatch._numbers(pa.array(rows, pa.list_(pa.int32())))] == rows
    values = [["a", None, "b"], [], [None, "c"], []]
    column = pa.array(values, pa.list_(pa.string()))
    assert textmatch._filled(column) == [[(0, "a"), (2, "b")], [], [(1, "c")], []]
    assert textmatch._filled(column.slice(1, 2)) == [[], [(1, "c")]]
    assert [x.tolist() for x in textmatch._numbers(pa.array(rows, pa.list_(pa.int32())).slice(2, 2))] == [[7], []]


def test_lower_case_by_character():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aAÉßİΣσ \U0001f600\U00010400ǅ") for _ in range(rng.randrange(12)))
        offsets = np.arange(len(text) + 1)
        low, moved = textmatch.lowered(text, offsets)
        assert low == "".join(c.lower() for c in text)
        assert moved.tolist() == [len("".join(c.lower() for c in text[:i])) for i in offsets]
