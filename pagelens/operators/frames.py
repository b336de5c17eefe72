"""Frames: J8 frame tree, P13 frame selector, U2 cross-origin markers, D2 frame report.

Child documents come from two places: ``srcdoc`` (parsed with the parent page,
same origin by definition) and ``src`` (another captured page whose url equals
the resolved src). Every captured page is parsed and resolved once, in its own
right. Where it is framed, only rows of the frame map are made: (page, frame)
of the host and (page, frame) of the source. The map grows level by level by an
equi join on the source page, until no new frame is found; a branch stops where
a url equals an ancestor's (cycles). Nodes are attached through the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import dq_escape
from pagelens.functions.url import resolve_href, url_origin
from pagelens.operators.select import FRAME

from pagelens.functions.props import A  # noqa: E402


# the parsed frame that is a frame's document, and its parent's
SOURCE, PARENT_SOURCE = ["src_page_id", "src_frame_id"], ["up_page_id", "up_frame_id"]

# frame ids of ``src`` frames: above every parsed frame id, one range per parent frame
SRC_FRAME_STRIDE = 1 << 31


def css_escape_ident(c: Column) -> Column:
    """CSS.escape for the identifiers met in ids: escape ASCII non-identifier
    characters with a backslash, a leading digit as a code point escape."""
    esc = F.regexp_replace(c, r"([^A-Za-z0-9_\-\u0080-\uFFFF])", r"\\$1")
    lead_digit = F.regexp_extract(esc, r"^(-?)([0-9])", 2)
    lead_minus = F.regexp_extract(esc, r"^(-?)([0-9])", 1)
    return F.when(lead_digit != "", F.concat(lead_minus, F.lit("\\3"), lead_digit, F.lit(" "),
                                             F.regexp_replace(esc, r"^-?[0-9]", ""))) \
        .when(esc == "-", F.lit("\\-")).otherwise(esc)


def frame_hosts(elements: DataFrame) -> DataFrame:
    """Selector of every iframe / frame element within its frame."""
    w = Window.partitionBy(*FRAME, "root_id", "tag").orderBy("eid")
    hosts = elements.filter(F.col("tag").isin("iframe", "frame")).withColumn("_nth", F.row_number().over(w) - 1)
    selector = (
        F.when(F.coalesce(A["id"] != "", F.lit(False)), F.concat(F.col("tag"), F.lit("#"), css_escape_ident(A["id"])))
        .when(F.coalesce(A["name"] != "", F.lit(False)),
              F.concat(F.col("tag"), F.lit('[name="'), dq_escape(A["name"]), F.lit('"]')))
        .otherwise(F.concat(F.col("tag"), F.lit(" >> nth="), F.col("_nth").cast("string")))
    )
    return hosts.select(*FRAME, F.col("eid").alias("host_eid"), selector.alias("selector"),
                        F.coalesce(A["name"], F.lit("")).alias("frame_name"), A["src"].alias("src"),
                        A["srcdoc"].isNotNull().alias("has_srcdoc"), "root_id", "in_shadow")


def frame_tree(frames: DataFrame, hosts: DataFrame, page_urls: DataFrame) -> DataFrame:
    """One row per enumerated frame of the frame map: page_id, frame_id, frame_key,
    frame_path array<string>, url, name, same_origin, reachable, selector,
    parent_frame_id, host_eid and the source ids of the frame and its parent.
    """
    f = frames.select(*FRAME, "parent_frame_id", "host_eid", "frame_key", "frame_url", *SOURCE, *PARENT_SOURCE)
    h = hosts.select(F.col("page_id").alias(PARENT_SOURCE[0]), F.col("frame_id").cast("long").alias(PARENT_SOURCE[1]), "host_eid", "selector", "frame_name")
    j = f.join(h, [*PARENT_SOURCE, "host_eid"], "left")
    main_origin = page_urls.select("page_id", url_origin(F.col("url")).alias("main_origin"))
    j = j.join(main_origin, "page_id", "left")
    # path: selectors of the host iframes from the main document down
    sel_by_key = j.select("page_id", "frame_key", "selector")
    paths = (j.select("page_id", "frame_id", "frame_key",
                      F.posexplode_outer("frame_key").alias("lvl", "_k"))
             .withColumn("anc_key", F.when(F.col("_k").isNotNull(), F.slice("frame_key", 1, F.col("lvl") + 1)))
             .join(sel_by_key.withColumnRenamed("frame_key", "anc_key").withColumnRenamed("selector", "anc_sel"),
                   ["page_id", "anc_key"], "left")
             .groupBy("page_id", "frame_id")
             .agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("anc_key").isNotNull(),
                                                                 F.struct("lvl", F.coalesce("anc_sel", F.lit("iframe")).alias("s"))))),
                              lambda x: x["s"]).alias("frame_path")))
    url = F.col("frame_url")
    same = (F.col("frame_id") == 0) | (url == "") | url.startswith("about:") | \
        F.coalesce(url_origin(url) == F.col("main_origin"), F.lit(False))
    t = (j.join(paths, ["page_id", "frame_id"])
         .select("page_id", "frame_id", "frame_key", "frame_path", url.alias("url"),
                 F.coalesce(F.col("frame_name"), F.lit("")).alias("name"),
                 same.alias("same_origin"), "selector", "parent_frame_id", "host_eid", *SOURCE, *PARENT_SOURCE))
    # reachable = same-origin and every ancestor frame same-origin: no ancestor
    # key prefix may belong to a cross-origin frame
    cross = t.filter(~F.col("same_origin")).select("page_id", F.col("frame_key").alias("x_key"))
    blocked = (t.select("page_id", "frame_id", "frame_key").join(cross, "page_id")
               .filter((F.size("x_key") < F.size("frame_key"))
                       & (F.slice("frame_key", 1, F.greatest(F.size("x_key"), F.lit(1))) == F.col("x_key")))
               .select("page_id", "frame_id").distinct().withColumn("_blocked", F.lit(True)))
    t = t.join(blocked, ["page_id", "frame_id"], "left")
    listed = ~F.coalesce(F.col("_blocked"), F.lit(False))
    return t.filter(listed).withColumn("reachable", F.col("same_origin")).drop("_blocked")


def base_urls(elements: DataFrame, frames: DataFrame, page_urls: DataFrame) -> DataFrame:
    """Base URL per parsed frame: its first <base href>, else its own url; frames without a url of
    their own (srcdoc, about:blank) take their parent's base."""
    first_base = (elements.filter((F.col("tag") == "base") & A["href"].isNotNull())
                  .groupBy(*FRAME).agg(F.min_by(A["href"], "eid").alias("_bh")))
    own = F.when((F.col("frame_url") != "") & ~F.col("frame_url").startswith("about:"), F.col("frame_url"))
    frames = frames.select(*FRAME, "frame_key", own.alias("_own")).join(first_base, FRAME, "left")
    level = F.explode(F.sequence(F.lit(0), F.size("frame_key")))
    chain = (frames.select(*FRAME, "frame_key", level.alias("_lvl"))
             .withColumn("_anc", F.slice("frame_key", F.lit(1), F.col("_lvl"))).drop("frame_key")
             .join(frames.select("page_id", F.col("frame_key").alias("_anc"), "_own", "_bh"), ["page_id", "_anc"])
             .groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("_lvl", "_own", "_bh"))).alias("_chain"))
             .join(page_urls, "page_id"))

    def down(base, x):  # from the main document to the frame
        base = F.coalesce(x["_own"], base)
        return F.when(x["_bh"].isNotNull(), resolve_href(x["_bh"], base)).otherwise(base)

    return chain.select(*FRAME, F.aggregate("_chain", F.col("url"), down).alias("base_url"))


def src_frame_rows(elements: DataFrame, frames: DataFrame, page_urls: DataFrame) -> DataFrame:
    """Frames without srcdoc (iframe / frame): one row per host, url resolved against the base of
    its document, keyed like parsed frames. Without a src, or with an empty one, it is a blank document."""
    hosts = (elements.filter(F.col("tag").isin("iframe", "frame") & A["srcdoc"].isNull())
             .select(*FRAME, F.col("eid").alias("host_eid"), A["src"].alias("src")))
    parent = frames.select(*FRAME, "frame_key")
    blank = F.trim(F.coalesce("src", F.lit(""))) == ""
    return (hosts.join(parent, FRAME).join(base_urls(elements, frames, page_urls), FRAME).join(page_urls, "page_id")
            .select("page_id",
                    ((F.col("frame_id").cast("long") + 1) * SRC_FRAME_STRIDE + F.col("host_eid")).alias("frame_id"),
                    F.col("frame_id").cast("long").alias("parent_frame_id"), "host_eid",
                    F.concat(F.col("frame_key"), F.array(F.col("host_eid"))).alias("frame_key"),
                    F.when(blank, F.lit("about:blank")).otherwise(resolve_href(F.col("src"), F.col("base_url"))).alias("frame_url"),
                    F.col("url").alias("main_url")))


def nested_id(kind: str, parent: Column, child: Column) -> Column:
    """Frame ids of deeper levels: above all those of ``src_frame_rows``."""
    return F.lit(1 << 62).bitwiseOR(F.xxhash64(F.lit(kind), parent.cast("long"), child.cast("long")).bitwiseAND(F.lit((1 << 62) - 1)))


def embedded_id(host: Column, frame_id: Column) -> Column:
    """Id of a frame of an embedded page: its main document is the embedding frame ``host`` itself."""
    return F.when(frame_id == 0, host).otherwise(nested_id("embedded", host, frame_id))


def frame_map(elements: DataFrame, frames: DataFrame, page_urls: DataFrame, keep) -> DataFrame:
    """Every frame of every page with the parsed frame that is its document (SOURCE; null: not captured, blank, cross-origin, or its
    url equals an ancestor's) and its parent's (PARENT_SOURCE). ``keep`` materialises a table that is read again.

    A url captured more than once is framed in its latest capture, the one with the largest page_id.
    """
    parsed = frames.select("page_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("parent_frame_id").cast("long").alias("parent_frame_id"), "host_eid",
                           F.coalesce("frame_key", F.array().cast("array<int>")).alias("frame_key"), "frame_url")
    own = parsed.select("*", F.col("page_id").alias(SOURCE[0]), F.col("frame_id").alias(SOURCE[1]),
                        F.when(F.col("parent_frame_id").isNotNull(), F.col("page_id")).alias(PARENT_SOURCE[0]), F.col("parent_frame_id").alias(PARENT_SOURCE[1]))
    target = page_urls.groupBy(F.col("url").alias("frame_url")).agg(F.max("page_id").alias("_to"))
    links = keep(src_frame_rows(elements, frames, page_urls).join(target, "frame_url", "left"))
    if links.isEmpty():
        return own
    down = links.select(F.col("page_id").alias("_doc"), F.col("parent_frame_id").alias("_parent"), "host_eid",
                        F.col("frame_key").alias("_key"), F.col("frame_url").alias("_url"), F.col("_to").alias("_next"))
    level = links.withColumns({"above": F.array("main_url"), PARENT_SOURCE[0]: F.col("page_id"), PARENT_SOURCE[1]: F.col("parent_frame_id")})
    attached = None
    while True:
        loads = F.coalesce((url_origin(F.col("frame_url")) == url_origin(F.col("main_url")))
                           & ~F.array_contains("above", F.col("frame_url")), F.lit(False))
        level = keep(level.select(*FRAME, "parent_frame_id", "host_eid", "frame_key", "frame_url", "main_url", "above", *PARENT_SOURCE,
                                  F.when(loads, F.col("_to")).alias("_doc")))
        attached = level if attached is None else attached.unionByName(level)
        opened = level.filter(F.col("_doc").isNotNull())
        if opened.isEmpty():
            break
        level = (opened.drop("host_eid", "parent_frame_id", *PARENT_SOURCE).join(down, "_doc")
                 .withColumn("parent_frame_id", embedded_id(F.col("frame_id"), F.col("_parent")))
                 .select("page_id", nested_id("src", F.col("parent_frame_id"), F.col("host_eid")).alias("frame_id"), "parent_frame_id", "host_eid",
                         F.concat("frame_key", "_key").alias("frame_key"), F.col("_url").alias("frame_url"), "main_url",
                         F.concat("above", F.array("frame_url")).alias("above"), F.col("_doc").alias(PARENT_SOURCE[0]), F.col("_parent").alias(PARENT_SOURCE[1]),
                         F.col("_next").alias("_to")))
    # the frames of an opened document: its main document stands in the framing frame itself
    main = F.col("_frame") == 0
    inner = parsed.select(F.col("page_id").alias("_doc"), F.col("frame_id").alias("_frame"), F.col("parent_frame_id").alias("_up"), F.col("host_eid").alias("_eid"),
                          F.col("frame_key").alias("_key"), F.col("frame_url").alias("_url"))
    framed = (attached.filter(F.col("_doc").isNotNull()).withColumnRenamed("frame_id", "_host").join(inner, "_doc")
              .select("page_id", embedded_id(F.col("_host"), F.col("_frame")).alias("frame_id"),
                      F.when(main, F.col("parent_frame_id")).otherwise(embedded_id(F.col("_host"), F.col("_up"))).alias("parent_frame_id"),
                      F.when(main, F.col("host_eid")).otherwise(F.col("_eid")).alias("host_eid"),
                      F.concat("frame_key", "_key").alias("frame_key"),
                      F.when(main, F.col("frame_url")).otherwise(F.col("_url")).alias("frame_url"),
                      F.col("_doc").alias(SOURCE[0]), F.col("_frame").alias(SOURCE[1]),
                      F.when(main, F.col(PARENT_SOURCE[0])).otherwise(F.col("_doc")).alias(PARENT_SOURCE[0]),
                      F.when(main, F.col(PARENT_SOURCE[1])).otherwise(F.col("_up")).alias(PARENT_SOURCE[1])))
    bare = attached.filter(F.col("_doc").isNull()).withColumns({c: F.lit(None).cast("long") for c in SOURCE})
    return own.unionByName(framed.select(*own.columns)).unionByName(bare.select(*own.columns))


def placed(tree: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``df`` (page_id, frame_id of a parsed frame) once for every reachable frame that has it as its document, with that frame's
    page_id, frame_id and ``cols``; SOURCE keeps where they come from. A page's own frames join without a shuffle."""
    tree = tree.filter(F.col("reachable") & F.col(SOURCE[0]).isNotNull()).select(*FRAME, *SOURCE, *cols)
    is_own = (F.col("page_id") == F.col(SOURCE[0])) & (F.col("frame_id") == F.col(SOURCE[1]))
    own = df.withColumn("frame_id", F.col("frame_id").cast("long")).join(tree.filter(is_own), FRAME)
    renamed = df.withColumnRenamed("page_id", SOURCE[0]).withColumn(SOURCE[1], F.col("frame_id").cast("long")).drop("frame_id")
    framed = renamed.join(tree.filter(~is_own), SOURCE)
    return own.unionByName(framed.select(*own.columns))
