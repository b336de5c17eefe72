"""Rendered page families: HTML built from relational rows with built-in string
functions, so rules that the captured ``pages`` never exercise (forms, hiding
styles, disabled states, duplicate names, test-id scopes) are checked against
an oracle computed straight from the same rows.

Board pages: one page per customer and chunk of at most ``BOARD_PAGE_SIZE``
orders (pagination keeps every page, and so every collected group, bounded
even when one customer holds a third of all orders).

  page_id   = custkey * PAGE_KEY_STRIDE + chunk
  <form>    id / name / none by custkey mod 3
  per order <div data-testid="card-<orderkey>" [hiding by priority]>
              <button [disabled if status F] [hidden if status O]>Save</button></div>
  priority  1-URGENT display:none, 2-HIGH visibility:hidden, 3-MEDIUM opacity:0,
            4-NOT SPECIFIED aria-hidden, 5-LOW nothing
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOARD_PAGE_SIZE = 25
PAGE_KEY_STRIDE = 100_000_000


def page_key(key: Column) -> Column:
    """bigint id of chunk ``chunk`` of ``key``; more chunks than the stride are an error, never a merged page."""
    chunk = F.when(F.col("chunk") < PAGE_KEY_STRIDE, F.col("chunk")).otherwise(F.raise_error(F.lit("more pages than page ids for one key")).cast("long"))
    return key.cast("long") * PAGE_KEY_STRIDE + chunk


def board_pages(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority",
                      ((F.row_number().over(w) - 1) / BOARD_PAGE_SIZE).cast("long").alias("chunk"))
    hide = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(' style="display:none"'))
            .when(F.col("o_orderpriority") == "2-HIGH", F.lit(' style="visibility:hidden"'))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(' style="opacity:0"'))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(' aria-hidden="true"'))
            .otherwise(F.lit("")))
    state = (F.when(F.col("o_orderstatus") == "F", F.lit(" disabled"))
             .when(F.col("o_orderstatus") == "O", F.lit(" hidden")).otherwise(F.lit("")))
    card = F.concat(F.lit('<div data-testid="card-'), F.col("o_orderkey").cast("string"), F.lit('"'), hide,
                    F.lit("><button"), state, F.lit(">Save</button></div>"))
    grouped = (o.select("o_custkey", "chunk", "o_orderkey", card.alias("card"))
               .groupBy("o_custkey", "chunk")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "card"))),
                                             lambda x: x["card"]), "").alias("cards")))
    ck = F.col("o_custkey")
    form_open = (F.when(ck % 3 == 0, F.concat(F.lit('<form id="board-'), ck.cast("string"), F.lit('">')))
                 .when(ck % 3 == 1, F.concat(F.lit('<form name="b'), ck.cast("string"), F.lit('">')))
                 .otherwise(F.lit("<form>")))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Board "), ck.cast("string"),
                    F.lit("</title></head><body><h1>Orders</h1>"), form_open, F.col("cards"),
                    F.lit("</form></body></html>"))
    return grouped.select(
        page_key(ck).alias("page_id"),
        F.concat(F.lit("http://c"), (ck % 7).cast("string"), F.lit(".shop.test/board/"), ck.cast("string"),
                 F.lit("?page="), F.col("chunk").cast("string")).alias("url"),
        html.alias("html"))


CARD_PAGE_SIZE = 25


def card_pages(supplier: DataFrame) -> DataFrame:
    """Card pages: one page per nation and chunk of at most ``CARD_PAGE_SIZE``
    suppliers; every supplier is one ``cursor:pointer`` card in body order.

      acctbal < 0        empty pointer div (decoration, never a click target)
      suppkey mod 3 = 0  <h3>name</h3><p>Account</p>           (short heading)
      suppkey mod 3 = 1  <h3>name x 5</h3>                      (heading over 80 chars)
      suppkey mod 3 = 2  <a href="/s/key"><img alt="name"></a> (image link)
    """
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = supplier.select("s_nationkey", "s_suppkey", "s_name", "s_acctbal",
                        ((F.row_number().over(w) - 1) / CARD_PAGE_SIZE).cast("long").alias("chunk"))
    name = F.col("s_name")
    inner = (F.when(F.col("s_acctbal") < 0, F.lit(""))
             .when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("<h3>"), name, F.lit("</h3><p>Account</p>")))
             .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("<h3>"), F.concat_ws(" ", name, name, name, name, name),
                                                         F.lit("</h3>")))
             .otherwise(F.concat(F.lit('<a href="/s/'), F.col("s_suppkey").cast("string"), F.lit('"><img src="x.png" alt="'),
                                 name, F.lit('"></a>'))))
    card = F.concat(F.lit('<div class="card" style="cursor: pointer">'), inner, F.lit("</div>"))
    grouped = (s.select("s_nationkey", "chunk", "s_suppkey", card.alias("card"))
               .groupBy("s_nationkey", "chunk")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "card"))),
                                             lambda x: x["card"]), "").alias("cards")))
    nk = F.col("s_nationkey")
    return grouped.select(
        page_key(nk).alias("page_id"),
        F.concat(F.lit("http://shop.test/suppliers/"), nk.cast("string"), F.lit("?page="),
                 F.col("chunk").cast("string")).alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><head><title>Suppliers</title></head><body>"), F.col("cards"),
                 F.lit("</body></html>")).alias("html"))


FORM_PAGE_SIZE = 20


def form_pages(part: DataFrame) -> DataFrame:
    """Form pages: one page per brand and chunk of at most ``FORM_PAGE_SIZE``
    parts; each part is one row (``div``) of a single form. With k = partkey:

      input type   by size mod 5: text, email, checkbox, number, submit (value = name)
      id           by k mod 3: "p<k>", generated "rc_select_<k>", none
      label        by k mod 4: label[for] (when an id exists), wrapping label, aria-label, none
      test attr    by k mod 6: data-testid, data-cy, data-qa, none
      required     size mod 4 = 1; checked (checkbox) size even; placeholder = type (text/email, k even)
      name="n<k>"  keys the input back to its part
    """
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                    ((F.row_number().over(w) - 1) / FORM_PAGE_SIZE).cast("long").alias("chunk"))
    k, size = F.col("p_partkey"), F.col("p_size")
    itype = (F.when(size % 5 == 0, "text").when(size % 5 == 1, "email").when(size % 5 == 2, "checkbox")
             .when(size % 5 == 3, "number").otherwise("submit"))
    el_id = F.when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"))) \
        .when(k % 3 == 1, F.concat(F.lit("rc_select_"), k.cast("string")))
    test = (F.when(k % 6 == 0, F.concat(F.lit(' data-testid="part-'), k.cast("string"), F.lit('"')))
            .when(k % 6 == 1, F.concat(F.lit(' data-cy="part-'), k.cast("string"), F.lit('"')))
            .when(k % 6 == 2, F.concat(F.lit(' data-qa="part-'), k.cast("string"), F.lit('"')))
            .otherwise(F.lit("")))
    mode = k % 4
    attrs = F.concat(
        F.lit(' type="'), itype, F.lit('" name="n'), k.cast("string"), F.lit('"'),
        F.when(el_id.isNotNull(), F.concat(F.lit(' id="'), el_id, F.lit('"'))).otherwise(F.lit("")),
        test,
        F.when(mode == 2, F.concat(F.lit(' aria-label="'), F.col("p_name"), F.lit('"'))).otherwise(F.lit("")),
        F.when(itype == "submit", F.concat(F.lit(' value="'), F.col("p_name"), F.lit('"'))).otherwise(F.lit("")),
        F.when(itype.isin("text", "email") & (k % 2 == 0), F.concat(F.lit(' placeholder="'), F.col("p_type"), F.lit('"')))
        .otherwise(F.lit("")),
        F.when(size % 4 == 1, F.lit(" required")).otherwise(F.lit("")),
        F.when((itype == "checkbox") & (size % 2 == 0), F.lit(" checked")).otherwise(F.lit("")))
    inp = F.concat(F.lit("<input"), attrs, F.lit(">"))
    row = (F.when((mode == 0) & el_id.isNotNull(),
                  F.concat(F.lit('<label for="'), el_id, F.lit('">'), F.col("p_name"), F.lit("</label>"), inp))
           .when(mode == 1, F.concat(F.lit("<label>"), F.col("p_name"), F.lit(" "), inp, F.lit("</label>")))
           .otherwise(inp))
    row = F.concat(F.lit('<div class="row">'), row, F.lit("</div>"))
    brand_no = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    grouped = (p.select(brand_no.alias("brand_no"), "chunk", "p_partkey", row.alias("row"))
               .groupBy("brand_no", "chunk")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "row"))),
                                             lambda x: x["row"]), "").alias("rows")))
    b = F.col("brand_no")
    return grouped.select(
        page_key(b).alias("page_id"),
        F.concat(F.lit("http://parts.test/brand/"), b.cast("string"), F.lit("?page="), F.col("chunk").cast("string"))
        .alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><head><title>Parts</title></head><body><form id=\"f-"), b.cast("string"),
                 F.lit("\">"), F.col("rows"), F.lit("</form></body></html>")).alias("html"))


def frame_pages(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Frame pages: one page per region (``http://www.regions.test/region/<rk>``)
    and one host page per nation embedding its region page by ``src`` and an
    inline ``srcdoc`` frame. Nations of an even region live on the regions host
    (same origin, the region document is attached); the others on their own
    host (cross-origin, an opaque marker). The region iframe has
    ``id="reg"`` / ``name="reg-<rk>"`` / neither by nationkey mod 3.
    """
    regions = region.select(
        (F.lit(900000) + F.col("r_regionkey")).cast("long").alias("page_id"),
        F.concat(F.lit("http://www.regions.test/region/"), F.col("r_regionkey").cast("string")).alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><head><title>Region "), F.col("r_name"),
                 F.lit("</title></head><body><button>"), F.col("r_name"), F.lit("</button></body></html>")).alias("html"))
    nk, rk = F.col("n_nationkey"), F.col("n_regionkey")
    sel = (F.when(nk % 3 == 0, F.lit(' id="reg"'))
           .when(nk % 3 == 1, F.concat(F.lit(' name="reg-'), rk.cast("string"), F.lit('"'))).otherwise(F.lit("")))
    iframe = F.concat(F.lit("<iframe"), sel, F.lit(' src="http://www.regions.test/region/'), rk.cast("string"),
                      F.lit('"></iframe>'))
    inline = F.concat(F.lit('<iframe srcdoc="<button>Inline '), F.col("n_name"), F.lit('</button>"></iframe>'))
    url = F.when(rk % 2 == 0, F.concat(F.lit("http://www.regions.test/nation/"), nk.cast("string"))) \
        .otherwise(F.concat(F.lit("http://n"), nk.cast("string"), F.lit(".nations.test/nation/"), nk.cast("string")))
    nations = nation.select(
        (F.lit(800000) + nk).cast("long").alias("page_id"), url.alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><head><title>Nation "), F.col("n_name"),
                 F.lit("</title></head><body><button>"), F.col("n_name"), F.lit("</button>"), iframe, inline,
                 F.lit("</body></html>")).alias("html"))
    return nations.unionByName(regions)


def board_pages_after_save(orders: DataFrame) -> DataFrame:
    """The board pages captured after a declared save action: each page shows a
    status toast (``data-testid="toast-<custkey>-<chunk>"``) below the form."""
    pages = board_pages(orders)
    ck = F.expr(f"page_id div {PAGE_KEY_STRIDE}")
    chunk = F.col("page_id") % PAGE_KEY_STRIDE
    toast = F.concat(F.lit('<div role="status" data-testid="toast-'), ck.cast("string"), F.lit("-"),
                     chunk.cast("string"), F.lit('">Stored</div>'))
    return pages.select("page_id", "url",
                        F.regexp_replace(F.col("html"), "</form></body>", F.concat(F.lit("</form>"), toast,
                                                                                 F.lit("</body>"))).alias("html"))


STYLE_PAGE_SIZE = 25
STYLE_SHEET = """
@import url("other.css");
@font-face { font-family: x; src: url(x) }
@keyframes spin { from { opacity: 0 } 50% { opacity: 0 } to { opacity: 1 } }
/* li button { display: none } */
li.low > div > button { display: none }
li.gold + li button { visibility: hidden }
li.gold ~ li .c3 .b0, .missing button { opacity: 0 }
li:nth-child(7n+2) button:not(.b1, .b2) { display: none }
ul[data-kind="list"] li:last-child button.b1 { visibility: hidden }
.missing .c1 button { display: none }
li.seg-machinery:hover button { display: none }
li.seg-furniture div.c0 > button.b0 { visibility: visible }
li.seg-furniture button { visibility: hidden }
@media print { li button { display: none } }
@media (max-width: 500px) { li.seg-building div > button.b2 { display: none } }
@supports (display: grid) { @media screen and (min-width: 300px) { body > ul > li.seg-household .c2 > button { opacity: 0 } } }
li:has(.b0) button { display: none }
"""


def style_pages(customer: DataFrame) -> DataFrame:
    """Style pages: every ``STYLE_PAGE_SIZE`` customer keys one page with a list item per customer, hidden by the rules of STYLE_SHEET
    according to segment, account balance, key and place in the list. Pages are keyed by key range, so none grows with the data."""
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    page = F.floor(k / STYLE_PAGE_SIZE)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    item = text('<li class="seg-', F.lower("c_mktsegment"), F.when(bal < 0, " low").otherwise(""), F.when(bal > 8000, " gold").otherwise(""), '"><div class="c', k % 4,
                '"><button class="b', k % 3, '" data-testid="t', k, '">', F.col("c_name"), "</button></div></li>")
    items = customer.select(page.alias("page_id"), "c_custkey", item.alias("item")).groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "item"))), lambda x: x["item"]), "").alias("items"))
    return items.select("page_id", text("http://shop.test/customers/", F.col("page_id")).alias("url"),
                        text("<!DOCTYPE html><html><head><title>Customers</title><style>", STYLE_SHEET, '</style></head><body><ul data-kind="list">',
                             F.col("items"), "</ul></body></html>").alias("html"))


NESTED_LEAVES = 5


def nested_pages(supplier: DataFrame) -> DataFrame:
    """Nested pages. With k = suppkey, all on one origin:

      /a/k  a button "main k" and <iframe name="next" src="xk">; for even k a <base href="/b/"> stands before it
      /b/xk (even k only) a link "to k", an <iframe> without src, a srcdoc frame with a button, and for k mod 4 = 0 an iframe of /c/(k mod NESTED_LEAVES)
      /c/j  captured twice, as "old j" and later as "new j"; it frames /c/(j + 1), so the leaves frame each other in a ring
    """
    k = F.col("s_suppkey").cast("long")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    doc = lambda *parts: text("<!DOCTYPE html><html><head><title>Nested</title></head><body>", *parts, "</body></html>")
    even = k % 2 == 0
    main = supplier.select((k * 10).alias("page_id"), text("http://s.test/a/", k).alias("url"),
                           doc(F.when(even, '<base href="/b/">').otherwise(""), "<button>main ", k, '</button><iframe name="next" src="x', k, '"></iframe>').alias("html"))
    leaf = F.when(k % 4 == 0, text('<iframe src="/c/', k % NESTED_LEAVES, '"></iframe>')).otherwise("")
    child = supplier.filter(even).select((k * 10 + 1).alias("page_id"), text("http://s.test/b/x", k).alias("url"),
                                         doc('<a href="y">to ', k, '</a><iframe></iframe><iframe srcdoc="<button>inner ', k, '</button>"></iframe>', leaf).alias("html"))
    rings = supplier.select((k % NESTED_LEAVES).alias("j")).distinct().withColumn("v", F.explode(F.array(F.lit(2), F.lit(3))))
    j = F.col("j")
    rings = rings.select((-j * 10 - 10 + F.col("v")).alias("page_id"), text("http://s.test/c/", j).alias("url"),
                         doc("<button>", F.when(F.col("v") == 2, "old ").otherwise("new "), j, '</button><iframe id="ring" src="', (j + 1) % NESTED_LEAVES, '"></iframe>').alias("html"))
    return main.unionByName(child).unionByName(rings)


TOAST_PAGE_SIZE = 20


def toast_pages(events: DataFrame, after: bool) -> DataFrame:
    """Toast pages, before and after an interaction: every TOAST_PAGE_SIZE event ids one page with a button per event, named by its type.

      signup    only after            view      only before
      click     disabled after        purchase  with a test id; if it is the page's first event, it stands last after
      error     no test id, so errors are twins; every other one (by id) is disabled; on even pages a new enabled twin stands first after
    """
    e, t = F.col("event_id").cast("long"), F.col("event_type")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    page = F.floor(e / TOAST_PAGE_SIZE).cast("long")
    off = (F.lit(after) & (t == "click")) | ((t == "error") & (e % 2 == 0))
    button = text("<button", F.when(t == "error", "").otherwise(text(' data-testid="e', e, '"')), F.when(off, " disabled").otherwise(""), ">", F.initcap(t), "</button>")
    shown = events.filter(t != ("view" if after else "signup")).select(page.alias("page_id"), e.alias("e"), t.alias("t"), button.alias("button"))
    first = events.groupBy(page.alias("page_id")).agg(F.min(e).alias("first"))
    last = F.lit(after) & (F.col("t") == "purchase") & (F.col("e") == F.col("first"))
    rows = shown.join(first, "page_id").groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(last.alias("last"), "e", "button"))), lambda x: x["button"]), "").alias("buttons"))
    twin = F.when(F.lit(after) & (F.col("page_id") % 2 == 0), "<button>Error</button>").otherwise("")
    return rows.select("page_id", text("http://toast.test/", F.col("page_id")).alias("url"),
                       text("<!DOCTYPE html><html><head><title>Toast</title></head><body>", twin, F.col("buttons"), "</body></html>").alias("html"))
