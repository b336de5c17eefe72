"""The kernel's short way for plain markup gives what the stdlib's tokenizer gives."""

import random

from pagelens.sources.htmltree import _TreeBuilder, flatten

PARTS = ["<div>", "</div>", "<p>", "</p>", "<P>", "<button disabled>", "</button>", '<a href="x?a=1&amp;b=2">', "</a>", '<template shadowrootmode="open">', "<template>", "</template>",
         "<script>", "</script>", "<style>a<b", "</style>", "<style>p{}</style>", " a < b > c ", "&lt;x", "&am", "<!--c-->", "<!-- a -- b -->", "<!-->", "<!--a", "<!DOCTYPE html>", "<!x>",
         "<?pi>", "</>", "</ div >", "<div a=b c='d'>", "<br/>", "<br>", '<img src="a>b">', "<title>T &amp; x", "</title>", "<textarea>", "</textarea>", "<head>", "</head>",
         '<body class="z">', "</body>", "<li>", "<td>", "<tr>", "<table>", '<iframe srcdoc="<p>q</p>">', "</iframe>", "<xmp>", "</xmp>", "text", " ", "<svg/>", "<option>", "<h1>",
         '<a b a="1" a="2" B>', "<", "<é>", "<div", '<div a="', "<plaintext>", "<SCRIPT>x</SCRIPT>", '<div\tid="q"\nhidden>', "\x00", "<p\rq>"]


def tree(doc: str, feed):
    builder = _TreeBuilder()
    feed(builder)(doc)
    builder.finish()
    rows = flatten(builder.html, [0] * builder.n_roots, [0] * builder.n_roots)
    return rows, ["".join(b) for b in builder.tbuf], ["".join(b) for b in builder.mbuf]


def test_plain_markup_gives_the_tokenizers_tree():
    rng = random.Random(3)
    for _ in range(5000):
        doc = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        assert tree(doc, lambda b: b.parse) == tree(doc, lambda b: b.feed), doc
