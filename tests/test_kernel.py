"""S3 parse kernel: tree shape, walk order, text offsets, frames."""

from pagelens.sources.htmltree import parse_page


def rows_of(doc, url="http://a.test/"):
    frames = parse_page(doc, url)
    out = []
    for fid, pfid, host, key, furl, text, mtext, rows in frames:
        for r in rows:
            out.append(dict(frame=fid, eid=r[0], last=r[1], parent=r[2], depth=r[3], sib=r[4], tag=r[5],
                            attrs=r[6], text=text[r[7]:r[8]], mtext=mtext[r[9]:r[10]], shadow=r[11], root=r[12],
                            mode=r[13]))
    return frames, out


def test_implied_structure_and_void():
    _, rows = rows_of("<p>a<br>b<p>c")
    tags = [r["tag"] for r in rows]
    assert tags == ["html", "head", "body", "p", "br", "p"]
    p1 = rows[3]
    assert p1["text"] == "ab" and p1["last"] == 4
    assert rows[5]["sib"] == 2 and rows[5]["parent"] == 2


def test_script_text_not_markup_and_not_match_text():
    _, rows = rows_of('<html><head><title>T</title><script>var t="</p>";</script></head><body><b>x</b></body></html>')
    tags = [r["tag"] for r in rows]
    assert "p" not in tags
    html = rows[0]
    assert 'var t="</p>"' in html["text"]
    assert html["mtext"] == "x"


def test_list_items_and_first_attribute_wins():
    _, rows = rows_of('<ul><li id=a id=b>1<li>2</ul>')
    lis = [r for r in rows if r["tag"] == "li"]
    assert len(lis) == 2 and lis[0]["attrs"]["id"] == "a"
    assert all(r["parent"] == [x for x in rows if x["tag"] == "ul"][0]["eid"] for r in lis)


def test_declarative_shadow_walk_order():
    _, rows = rows_of('<div id=h><template shadowrootmode="open"><button>S</button></template><span>L</span></div>')
    by_tag = {r["tag"]: r for r in rows}
    assert by_tag["span"]["eid"] < by_tag["button"]["eid"]  # light children first
    assert by_tag["button"]["shadow"] and by_tag["button"]["root"] != 0
    assert by_tag["div"]["text"] == "L"  # textContent excludes shadow text
    assert by_tag["div"]["mode"] == "open"
    assert by_tag["div"]["last"] >= by_tag["button"]["eid"]


def test_closed_shadow_contents_dropped():
    _, rows = rows_of('<div><template shadowrootmode="closed"><button>S</button></template><i>L</i></div>')
    assert "button" not in [r["tag"] for r in rows]
    assert [r for r in rows if r["tag"] == "div"][0]["mode"] == "closed"


def test_plain_template_contents_not_in_document():
    _, rows = rows_of('<template><button>x</button></template><a href=/>y</a>')
    assert "button" not in [r["tag"] for r in rows]


def test_srcdoc_child_frame():
    frames, rows = rows_of('<iframe srcdoc="&lt;button&gt;B&lt;/button&gt;"></iframe><p>x</p>')
    assert len(frames) == 2
    child = frames[1]
    assert child[1] == 0 and child[4] == "about:srcdoc" and child[3] == [child[2]]
    assert any(r["frame"] == 1 and r["tag"] == "button" for r in rows)


def test_entities_decoded():
    _, rows = rows_of("<a href='/x?a=1&amp;b=2'>Tom &amp; Jerry&nbsp;!</a>")
    a = [r for r in rows if r["tag"] == "a"][0]
    assert a["attrs"]["href"] == "/x?a=1&b=2"
    assert a["text"] == "Tom & Jerry !"


def test_deep_nesting_is_iterative():
    doc = "<div>" * 3000 + "x" + "</div>" * 3000
    _, rows = rows_of(doc)
    assert max(r["depth"] for r in rows) == 3001  # html 0, body 1, divs 2..3001
