"""Frames of a batch are worked on together, which changes no row."""

import pyarrow as pa
import pytest

from pagelens.operators import ancestors, textmatch
from pagelens.session import together

TEXTS = ["Save  Save all", "  x", "", "save", "İstanbul SAVE Σ", "tail "]


def text_batch(which):
    """A body and two children per frame; the last frame shows an input button."""
    rows = {k: [] for k in ("page_id", "frame_id", "mtext", "wanted", "eid", "parent", "last_eid", "m_start", "m_end", "mt")}
    for i in which:
        n, half = len(TEXTS[i]), len(TEXTS[i]) // 2
        for k, v in zip(rows, [i, 0, TEXTS[i], ["save", "Save", "x", "", "Σ", "ve"], [0, 1, 2], [-1, 0, 0], [2, 1, 2], [0, 0, half], [n, half, n], [None, None, "Save me" if i == 5 else None]]):
            rows[k].append(v)
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 5, pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("chars", [1, 20, 1 << 20])
def test_texts_of_a_batch(exact, chars, monkeypatch):
    run = textmatch._search(exact)
    alone = [r for i in range(len(TEXTS)) for b in run(iter([text_batch([i])])) for r in b.to_pylist()]
    monkeypatch.setattr(textmatch, "GROUP_CHARS", chars)
    assert [r for b in run(iter([text_batch(range(len(TEXTS)))])) for r in b.to_pylist()] == alone and alone
    assert textmatch.groups_of(textmatch.np.array([3, 4, 0, 30, 2])) == {1: [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], 20: [(0, 3), (3, 4), (4, 5)], 1 << 20: [(0, 5)]}[chars]


def test_an_offset_behind_a_frames_text_is_an_error():
    np = textmatch.np
    with pytest.raises(IndexError):
        textmatch.in_text(np.array([3]), np.array([0]), np.array([0, 2]), np.array([2, 5]))


def test_label_text_comes_with_the_fold(spark):
    from pagelens.plans.extract import ExtractOptions, Extraction
    long = "w " * 100
    html = f'<label>{long}<input id="a"></label><label><b>x</b> <button>y</button></label><input id="b">'
    ex = Extraction(spark.createDataFrame([(1, "http://l.test/", html)], "page_id long, url string, html string"), ExtractOptions(max_nodes=None))
    assert "cl_text" in ancestors.SCHEMA
    texts = [r["cl_text"] for r in ex.element_texts.filter("subject").orderBy("eid").collect()]
    assert texts.count(long.strip()) == 2 and texts.count("x y") == 2 and texts[-1] is None
