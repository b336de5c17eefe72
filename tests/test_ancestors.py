"""Nearest ancestors by pointer doubling, and facts and texts of deep and large pages."""

import random

import numpy as np

from pagelens.operators import ancestors
from pagelens.plans.extract import Extraction, ExtractOptions


def test_nearest_ancestor():
    rng = random.Random(1)
    for n in (1, 2, 30, 400):
        for shape in (lambda i: rng.randrange(i), lambda i: i - 1, lambda i: 0):
            parent = np.array([-1] + [shape(i) for i in range(1, n)])
            flag = np.array([rng.random() < 0.1 for _ in range(n)])
            want = []
            for i in range(n):
                while i >= 0 and not flag[i]:
                    i = int(parent[i])
                want.append(i)
            assert ancestors.nearest(flag, parent).tolist() == want


def test_facts_of_a_deep_and_large_page(spark):
    """3,000 levels with a setter now and then, a megabyte of text at the bottom, buttons at several depths."""
    levels = ['<form id="f0">'] + [f'<div data-testid="t{i}" style="visibility:{"hidden" if i % 2 else "visible"}">' if i % 500 == 250 else "<div>" for i in range(3000)]
    body = "".join(x + (f"<button>b{i}</button>" if i in (100, 1000, 2999) else "") for i, x in enumerate(levels))
    body += f'<label>outer <span>name</span> <input id="in"></label><a role="button">{"word  " * 200_000}end</a>'
    body += '<section aria-label=" a  b "><p role="status"></p><p>saved</p></section>'
    ex = Extraction(spark.createDataFrame([(1, "http://b.test/", body), (2, "http://b.test/2", ""), (3, "http://b.test/3", None)], "page_id long, url string, html string"),
                    ExtractOptions(max_nodes=None, max_depth=None))
    rows = {r["accessible_name"] or r["tag"]: r for r in ex.kept_nodes.filter("page_id = 1").collect()}
    assert {k: rows[k]["scope_hint"] for k in ("b100", "b1000", "b2999")} == {"b100": None, "b1000": "t750", "b2999": "t2750"}
    assert [rows[k]["properties"]["is_visible"] for k in ("b100", "b1000", "b2999")] == [True, True, True]
    assert {r["form_group"] for r in rows.values()} == {"form#f0"}
    assert rows["b100"]["css_path"].count(">") == 103 and rows["b2999"]["css_path"].count(">") == 3002
    assert any(r["tag"] == "input" and r["accessible_name"] == "outer name" for r in rows.values())
    long = [r for r in rows.values() if r["tag"] == "a"][0]
    assert long["accessible_name"] == ("word " * 24)[:120] and long["properties"]["text_content"] == ("word " * 24)[:120]
    assert [r["properties"]["text_content"] for r in rows.values() if r["role"] == "status"] == ["saved"]
    assert "path" not in ex.elements.columns
