"""Structural HTML parse: one captured page -> flat element rows.

This is the per-row helper behind the ``elements`` source (S3). It only
builds the element tree; every selection, naming, visibility and locator
rule runs afterwards as DataFrame operators over the rows it emits.

Row model (one row per element of one frame):
  eid        position in walk order (element, light children, then shadow
             children); ``<html>`` is 0.
  last_eid   largest eid inside the subtree (shadow subtree included), so
             "d is inside e" is ``e.eid < d.eid <= e.last_eid``.
  path       ancestor eids, root first (shadow host is the parent of the
             shadow root's children).
  t_start/t_end  offsets of the element's ``textContent`` in the frame text.
  m_start/m_end  offsets in the frame *match text*: the same text without
             script / style / noscript / head contents (text-locator matching).
Text of each shadow root is appended after the document text, so the
offsets of light elements never cover shadow text.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

# HTML element categories used by the tree builder.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split()
)
HEAD_CONTENT = frozenset("base basefont bgsound link meta noscript script style template title".split())
CLOSES_P = frozenset(
    (
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
        "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre "
        "section summary table ul xmp"
    ).split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE_BARRIERS = frozenset("applet caption html table td th marquee object template".split())
SPECIAL_STOP = frozenset(
    (
        "address applet area article aside base basefont bgsound blockquote body br button caption center col "
        "colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 "
        "h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav "
        "noembed noframes noscript object ol p param plaintext pre script section select source style summary "
        "table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
    ).split()
)
RAW_TEXT_TAGS = ("noscript", "iframe", "noembed", "noframes", "xmp")
NO_MATCH_TEXT = frozenset(("script", "style", "noscript", "head"))
P_BARRIERS = SCOPE_BARRIERS | {"button"}

# markup in its plainest spelling, which needs none of the stdlib tokenizer's tolerance: start tag, end tag, comment, doctype
PLAIN = re.compile(r'<(?:([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n]+[a-zA-Z_][a-zA-Z0-9_:.-]*(?:="[^"&<>]*")?)*)>|/([a-zA-Z][a-zA-Z0-9-]*)>'
                   r'|!--(?![->])[^-]*(?:-[^-]+)*-->|![dD][oO][cC][tT][yY][pP][eE][^>]*>)')
PLAIN_ATTR = re.compile(r'([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:="([^"]*)")?')
# their contents are tokenized in another mode
MODE_TAGS = frozenset(("script", "style", "title", "textarea", "plaintext", *RAW_TEXT_TAGS))


class _El:
    __slots__ = (
        "tag", "attrs", "children", "shadow", "root_id", "in_shadow", "dropped", "mex",
        "t0", "t1", "m0", "m1", "shadow_mode", "is_marker", "host",
    )

    def __init__(self, tag, attrs, root_id, in_shadow, dropped, mex):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.shadow = None
        self.root_id = root_id
        self.in_shadow = in_shadow
        self.dropped = dropped
        self.mex = mex
        self.t0 = self.t1 = self.m0 = self.m1 = 0
        self.shadow_mode = None
        self.is_marker = False
        self.host = None


class _TreeBuilder(HTMLParser):
    """A small HTML tree builder on top of the stdlib tokenizer.

    Covers implied html/head/body, void elements, raw-text elements, the
    common implied end tags (p, li, dt/dd, option, table rows and cells),
    stray end tags, first-wins duplicate attributes and declarative shadow
    roots. Formatting-element reconstruction (adoption agency) is not done.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html = None
        self.head = None
        self.body = None
        self.stack = []
        self.n_roots = 1
        self.tbuf = [[]]
        self.tlen = [0]
        self.mbuf = [[]]
        self.mlen = [0]
        self.n_open = {"p": 0, "a": 0, "button": 0, "template": 0}  # open elements that rules ask for at every tag

    # ---------- tokens -------------------------------------------------------------
    def updatepos(self, i, j):
        return j  # no one asks for line numbers

    def parse(self, doc):
        """``feed`` for a whole document: plain markup is taken by one expression per tag, any other by the stdlib's rule for it."""
        self.rawdata = doc
        pos, n = 0, len(doc)
        while pos < n:
            at = doc.find("<", pos)
            if at < 0:
                break
            if at > pos:
                self.handle_data(unescape(doc[pos:at]))
                pos = at
            m = PLAIN.match(doc, pos)
            if m is not None and (tag := m[1]) is not None and (tag := tag.lower()) not in MODE_TAGS:
                attrs = {}
                if m[2]:
                    for k, v in PLAIN_ATTR.findall(m[2]):
                        attrs.setdefault(k.lower(), v)
                self._start(tag, attrs, self_closing=False)
                pos = m.end()
            elif m is not None and m[1] is None:
                if m[3] is not None:
                    self.handle_endtag(m[3].lower())
                pos = m.end()
            elif doc[pos + 1:pos + 2].isalpha() and doc[pos + 1].isascii():
                end = self.parse_starttag(pos)
                if end < 0:
                    break
                pos = end
                if self.cdata_elem is not None:
                    at = doc.find("<", pos)
                    text, close = doc[pos:at], f"</{self.cdata_elem}>"
                    if at < 0 or not doc.startswith(close, at) or "&" in text:
                        break
                    if text:
                        self.handle_data(text)
                    self.handle_endtag(self.cdata_elem)
                    self.clear_cdata_mode()
                    pos = at + len(close)
            elif doc.startswith("</", pos):
                end = self.parse_endtag(pos)
                if end < 0:
                    break
                pos = end
            else:
                break
        self.rawdata = doc[pos:]
        self.goahead(0)

    # ---------- element creation -------------------------------------------------
    def _new(self, tag, attrs):
        parent = self.stack[-1] if self.stack else None
        if parent is None:
            el = _El(tag, attrs, 0, False, False, False)
        else:
            dropped = parent.dropped or (parent.tag == "template" and not parent.is_marker)
            if parent.is_marker:
                root_id, in_shadow = parent.root_id, True
                dropped = dropped or parent.shadow_mode == "closed"
            else:
                root_id, in_shadow = parent.root_id, parent.in_shadow
            mex = parent.mex or tag in NO_MATCH_TEXT
            el = _El(tag, attrs, root_id, in_shadow, dropped, mex)
            if not dropped:
                (parent.shadow if parent.is_marker else parent.children).append(el)
        el.t0 = self.tlen[el.root_id]
        el.m0 = self.mlen[el.root_id]
        return el

    def _open(self, tag, attrs):
        el = self._new(tag, attrs)
        self.stack.append(el)
        if tag in self.n_open:
            self.n_open[tag] += 1
        return el

    def _close_top(self):
        el = self.stack.pop()
        el.t1 = self.tlen[el.root_id]
        el.m1 = self.mlen[el.root_id]
        if el.tag in self.n_open:
            self.n_open[el.tag] -= 1
        return el

    def _pop_until(self, idx):
        while len(self.stack) > idx:
            self._close_top()

    def _find(self, tags, barriers=SCOPE_BARRIERS):
        for i in range(len(self.stack) - 1, -1, -1):
            el = self.stack[i]
            if el.is_marker:
                return -1
            if el.tag in tags:
                return i
            if el.tag in barriers:
                return -1
        return -1

    def _close_p(self):
        i = self._find(("p",), P_BARRIERS) if self.n_open["p"] else -1
        if i >= 0:
            self._pop_until(i)

    def _ensure_html(self):
        if self.html is None:
            self.html = self._open("html", {})

    def _ensure_body(self):
        self._ensure_html()
        if self.head is None:
            self._pop_until(1)
            self.head = self._open("head", {})
        if self.body is None:
            if self.head is not None and self.head in self.stack:
                self._pop_until(self.stack.index(self.head))
            # only html remains below the insertion point
            self._pop_until(1)
            self.body = self._open("body", {})

    # ---------- tokenizer callbacks ---------------------------------------------
    def handle_starttag(self, tag, attr_list):
        attrs = {}
        for k, v in attr_list:
            if k not in attrs:
                attrs[k] = "" if v is None else v
        self._start(tag, attrs, self_closing=False)

    def handle_startendtag(self, tag, attr_list):
        attrs = {}
        for k, v in attr_list:
            if k not in attrs:
                attrs[k] = "" if v is None else v
        foreign = any(e.tag in ("svg", "math") for e in self.stack)
        self._start(tag, attrs, self_closing=foreign)

    def _start(self, tag, attrs, self_closing):
        if tag == "html":
            if self.html is None:
                self.html = self._open("html", attrs)
            return
        self._ensure_html()
        if self.n_open["template"]:
            self._insert(tag, attrs, self_closing)  # template contents: no implied head/body handling
            return
        if self.body is None:
            if tag == "head":
                if self.head is None:
                    self.head = self._open("head", attrs)
                return
            if tag in HEAD_CONTENT:
                if self.head is None:
                    self.head = self._open("head", {})
                elif self.head not in self.stack:
                    self.stack.append(self.head)  # "after head": insert into head again
                    self._insert(tag, attrs, self_closing)
                    if self.stack and self.stack[-1] is self.head:
                        self.stack.pop()
                    return
                self._insert(tag, attrs, self_closing)
                return
            if tag == "body":
                if self.head is None:
                    self._pop_until(1)
                    self.head = self._open("head", {})
                if self.head in self.stack:
                    self._pop_until(self.stack.index(self.head))
                self._pop_until(1)
                self.body = self._open("body", attrs)
                return
            self._ensure_body()
        elif tag in ("body", "head"):
            return
        self._insert(tag, attrs, self_closing)

    def _insert(self, tag, attrs, self_closing):
        top = self.stack[-1]
        if tag in CLOSES_P:
            self._close_p()
        if tag == "li":
            for i in range(len(self.stack) - 1, -1, -1):
                t = self.stack[i].tag
                if self.stack[i].is_marker:
                    break
                if t == "li":
                    self._pop_until(i)
                    break
                if t in SPECIAL_STOP and t not in ("address", "div", "p"):
                    break
        elif tag in ("dd", "dt"):
            for i in range(len(self.stack) - 1, -1, -1):
                t = self.stack[i].tag
                if self.stack[i].is_marker:
                    break
                if t in ("dd", "dt"):
                    self._pop_until(i)
                    break
                if t in SPECIAL_STOP and t not in ("address", "div", "p"):
                    break
        elif tag in HEADINGS:
            if self.stack[-1].tag in HEADINGS:
                self._close_top()
        elif tag == "a":
            i = self._find(("a",), frozenset()) if self.n_open["a"] else -1
            if i >= 0:
                self._pop_until(i)
        elif tag == "button":
            i = self._find(("button",)) if self.n_open["button"] else -1
            if i >= 0:
                self._pop_until(i)
        elif tag == "option":
            if self.stack[-1].tag == "option":
                self._close_top()
        elif tag == "optgroup":
            if self.stack[-1].tag == "option":
                self._close_top()
            if self.stack[-1].tag == "optgroup":
                self._close_top()
        elif tag in ("td", "th"):
            i = self._find(("td", "th"), frozenset(("table", "tr", "html", "template")))
            if i >= 0:
                self._pop_until(i)
        elif tag == "tr":
            i = self._find(("tr",), frozenset(("table", "html", "template", "thead", "tbody", "tfoot")))
            if i >= 0:
                self._pop_until(i)
        elif tag in ("thead", "tbody", "tfoot"):
            i = self._find(("thead", "tbody", "tfoot"), frozenset(("table", "html", "template")))
            if i >= 0:
                self._pop_until(i)
        del top

        mode = attrs.get("shadowrootmode", "").lower() if tag == "template" else ""
        parent = self.stack[-1]
        if mode in ("open", "closed") and not parent.is_marker and parent.shadow is None and not parent.dropped:
            # declarative shadow root: the template becomes the host's shadow root
            marker = _El("#shadow-root", {}, self.n_roots, True, parent.dropped, parent.mex)
            marker.is_marker = True
            marker.host = parent
            marker.shadow_mode = mode
            parent.shadow = marker.children = []
            parent.shadow_mode = mode
            marker.shadow = parent.shadow
            self.n_roots += 1
            self.tbuf.append([])
            self.tlen.append(0)
            self.mbuf.append([])
            self.mlen.append(0)
            self.stack.append(marker)
            return

        el = self._open(tag, attrs)
        if tag in VOID_TAGS or self_closing:
            self._close_top()
        elif tag in RAW_TEXT_TAGS:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body", "br"):
            return
        if tag == "head":
            if self.head is not None and self.head in self.stack:
                self._pop_until(self.stack.index(self.head))
            return
        if not self.stack:
            return
        if tag == "p" and self._find(("p",), P_BARRIERS) < 0:
            if self.body is None:
                self._ensure_body()
            self._open("p", {})
            self._close_top()
            return
        for i in range(len(self.stack) - 1, 0, -1):
            el = self.stack[i]
            if el.is_marker:
                if tag == "template":
                    self._pop_until(i)
                return
            if el.tag == tag:
                self._pop_until(i)
                return
            if el.tag == "template" and tag != "template":
                return

    def handle_data(self, data):
        if not data:
            return
        ws_only = not data.strip(" \t\n\r\f")
        if not self.stack:
            if ws_only:
                return
            self._ensure_body()
        elif self.body is None and not ws_only and self.stack[-1].tag in ("html", "head"):
            self._ensure_body()
        top = self.stack[-1]
        if top.dropped or (top.tag == "template" and not top.is_marker):
            return
        if top.is_marker and top.shadow_mode == "closed":
            return
        r = top.root_id
        self.tbuf[r].append(data)
        self.tlen[r] += len(data)
        if not top.mex:
            self.mbuf[r].append(data)
            self.mlen[r] += len(data)

    def handle_comment(self, data):
        return

    def finish(self):
        self.close()
        # implied head and body exist in every document
        self._ensure_body()
        while self.stack:
            self._close_top()


def parse_frame(html_text: str):
    """Parse one document. Returns (root, text, mtext, base) where base[r]
    is the offset of shadow root r's text inside the frame text."""
    tb = _TreeBuilder()
    tb.parse(html_text or "")
    tb.finish()
    t_base, m_base = [], []
    t_off = m_off = 0
    for r in range(tb.n_roots):
        t_base.append(t_off)
        m_base.append(m_off)
        t_off += tb.tlen[r]
        m_off += tb.mlen[r]
    text = "".join("".join(b) for b in tb.tbuf)
    mtext = "".join("".join(b) for b in tb.mbuf)
    return tb.html, text, mtext, t_base, m_base


def flatten(root, t_base, m_base):
    """Walk order numbering: element, light subtree, then shadow subtree."""
    rows = []
    # stack entries: (el, parent_eid, depth, sib_index)
    stack = [(root, -1, 0, 1)]
    while stack:
        el, parent_eid, depth, sib = stack.pop()
        if el is None:
            # subtree end marker: parent_eid carries the row index
            rows[parent_eid][1] = len(rows) - 1
            continue
        eid = len(rows)
        rows.append([eid, eid, parent_eid, depth, sib, el])
        stack.append((None, eid, 0, 0))
        if el.shadow:
            for i in range(len(el.shadow) - 1, -1, -1):
                stack.append((el.shadow[i], eid, depth + 1, i + 1))
        for i in range(len(el.children) - 1, -1, -1):
            stack.append((el.children[i], eid, depth + 1, i + 1))
    out = []
    for eid, last, parent_eid, depth, sib, el in rows:
        tb, mb = t_base[el.root_id], m_base[el.root_id]
        out.append((
            eid, last, parent_eid, depth, sib, el.tag, el.attrs,
            el.t0 + tb, el.t1 + tb, el.m0 + mb, el.m1 + mb,
            el.in_shadow, el.root_id, el.shadow_mode,
        ))
    return out


def parse_page(html_text: str, url: str):
    """Parse a page and its ``srcdoc`` child frames, frames in depth-first order.

    Yields ``(frame_id, parent_frame_id, host_eid, frame_key, frame_url, text, mtext, rows)``;
    ``frame_key`` is the list of host-iframe eids from the main document, so
    sorting by it gives the enumeration order of frames. Child frames given by
    ``src`` are resolved later against the pages table.
    """
    out = []
    # depth first, in order of the hosts; a srcdoc is shorter than its document, so this ends by itself
    todo = [(html_text, None, None, [], url)]
    while todo:
        doc, parent_fid, host_eid, key, furl = todo.pop()
        frame_id = len(out)
        root, text, mtext, t_base, m_base = parse_frame(doc)
        rows = flatten(root, t_base, m_base)
        out.append((frame_id, parent_fid, host_eid, key, furl, text, mtext, rows))
        todo += [(r[6]["srcdoc"], frame_id, r[0], key + [r[0]], "about:srcdoc")
                 for r in reversed(rows) if r[5] in ("iframe", "frame") and "srcdoc" in r[6]]
    return out
