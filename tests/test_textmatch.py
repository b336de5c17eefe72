"""Text matches by position against every element's own text."""

import random
import re

import numpy as np
import pytest

from pagelens.functions.text import JS_WS
from pagelens.operators import textmatch


def tree(rng, size):
    """Nested elements over a text: lists of (parent, start, end, last) in preorder, and the text."""
    text, rows = [], []

    def build(parent, depth):
        me = len(rows)
        rows.append([parent, sum(map(len, text)), 0, me])
        for _ in range(rng.randrange(4) if depth < 5 else 0):
            text.append("".join(rng.choice("aAbİß  \n \U0001f600") for _ in range(rng.randrange(4))))
            if len(rows) < size:
                build(me, depth + 1)
        text.append(rng.choice(["", "", " ", "ab"]))
        rows[me][2], rows[me][3] = sum(map(len, text)), len(rows) - 1
    build(-1, 0)
    return rows, "".join(text)


def brute(rows, text, wanted, exact):
    collapse = lambda s: re.sub(JS_WS, " ", s).strip(" ")
    low = lambda s: s if exact else "".join(c.lower() for c in s)
    texts = [low(collapse(text[a:b])) for _, a, b, _ in rows]
    out = set()
    for i, w in enumerate(wanted):
        hit = [t != "" and (t == low(w) if exact else low(w) in t) for t in texts]
        out |= {(i, e) for e, h in enumerate(hit) if h and not any(hit[c] for c, r in enumerate(rows) if r[0] == e)}
    return out


@pytest.mark.parametrize("exact", [False, True])
def test_innermost(exact):
    rng = random.Random(7)
    for _ in range(300):
        rows, text = tree(rng, 25)
        wanted = list(dict.fromkeys(["a", "ab", "a b", "b a", "aa", "i", "😀", "ss", rng.choice(["B A a", "bß", " a", "x"])]))
        parent, start, end, last = (np.array(x, np.int64) for x in zip(*rows))
        plain, offsets = textmatch.collapsed(text)
        low = wanted if exact else ["".join(c.lower() for c in w) for w in wanted]
        if not exact:
            plain, offsets = textmatch.lowered(plain, offsets)
        s, t = textmatch.trimmed(plain, offsets[start], offsets[end])
        which, place = textmatch.innermost(plain, low, np.arange(len(rows)), parent, last, s, t, exact)
        assert set(zip(which.tolist(), place.tolist())) == brute(rows, text, wanted, exact), (rows, text)


def test_megabyte_page(spark):
    """A page of a megabyte, 400 levels deep, with 20,000 texts asked for: linear, and nothing but pairs leaves the stage."""
    from pagelens.plans.extract import Extraction, ExtractOptions
    doc = "<div>" * 400 + "".join(f"<p>word{i} and some more text of paragraph number {i}</p>" for i in range(18000)) + "</div>" * 400
    assert len(doc) > 1_000_000
    ex = Extraction(spark.createDataFrame([(1, "http://b.test/", doc), (2, "http://b.test/2", None)], "page_id long, url string, html string"), ExtractOptions(max_depth=None, max_nodes=None))
    keys = spark.range(20000).selectExpr("1L page_id", "0 frame_id", "concat('Word', id) value").union(spark.sql("select 2L, 0, 'x'")).union(spark.sql("select 1L, 0, cast(null as string)"))
    keys = keys.select("page_id", keys.frame_id.cast(dict(ex.elements_raw.dtypes)["frame_id"]).alias("frame_id"), "value")
    shown = spark.createDataFrame([], "page_id long, frame_id int, eid int, mt string")
    out = textmatch.text_pairs(keys, ex.elements_raw, ex.frames_raw, shown, "contains")
    n = {r["value"]: r["count"] for r in out.groupBy("value").count().collect()}
    assert len(n) == 18000 and n["Word17999"] == 1 and n["Word1"] == sum(str(i).startswith("1") for i in range(18000))
    exact = textmatch.text_pairs(spark.sql("select 1L page_id, 0 frame_id, 'word7 and some more text of paragraph number 7' value"), ex.elements_raw, ex.frames_raw, shown, "exact")
    assert exact.count() == 1
