"""Assembly: W6 node budget, A2 page metadata, A3 notes, A7 truncation, Q3
empty-page hint, U1 node union, U2 cross-origin markers, S4 nested extract.

The nested document groups the kept nodes of a page, which are bounded by
``max_nodes`` (W6), so no unbounded group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.frames import PARENT_SOURCE, placed
from pagelens.operators.select import FRAME
from pagelens.schema import (
    GUIDANCE_IFRAME,
    NOTE_AFTER,
    NOTE_CROSS_ORIGIN,
    NOTE_DEPTH,
    NOTE_EMPTY,
    NOTE_FRAME_BUDGET,
    NOTE_HIDDEN,
    NOTE_NODES,
    SCHEMA_VERSION,
)

NODE_FIELDS = ["kind", "tag", "role", "in_shadow", "frame_path", "form_group", "accessible_name",
               "primary_locator", "fallback_locators", "properties", "context_note"]


NO_LIMIT = 1 << 62


def cap_nodes(nodes: DataFrame, max_nodes: int | None) -> DataFrame:
    """Sequence of nodes per page in frame order then document order."""
    w = Window.partitionBy("page_id").orderBy("frame_key", "eid")
    return nodes.withColumn("seq", F.row_number().over(w)).withColumn("within_budget", F.col("seq") <= (NO_LIMIT if max_nodes is None else max_nodes))


def cross_origin_markers(frame_tree: DataFrame, hosts: DataFrame, shown: DataFrame) -> DataFrame | None:
    """One opaque node per enumerated frame that is not reachable. It is visible when the first element that
    its selector matches has a shown box (``shown``: page_id, frame_id, host_eid, box_shown)."""
    ft = frame_tree.filter(~F.col("reachable"))
    parent = frame_tree.select("page_id", F.col("frame_id").alias("parent_frame_id"),
                               F.col("frame_path").alias("parent_path"), F.col("frame_key").alias("parent_key"))
    # uniqueness of the selector within the parent frame
    same_sel = (hosts.join(shown, FRAME + ["host_eid"], "left")
                .groupBy(F.col("page_id").alias(PARENT_SOURCE[0]), F.col("frame_id").cast("long").alias(PARENT_SOURCE[1]), "selector").agg(
        F.count(F.lit(1)).alias("_sel_n"), F.min_by("box_shown", "host_eid").alias("_shown")))
    m = (ft.join(parent, ["page_id", "parent_frame_id"], "left")
         .join(same_sel, [*PARENT_SOURCE, "selector"], "left"))
    sel = F.coalesce(F.col("selector"), F.lit("iframe"))
    sel_q = F.replace(sel, F.lit("'"), F.lit("\\'"))
    unique = F.coalesce(F.col("_sel_n") == 1, F.lit(False))
    note = F.replace(F.replace(F.lit(NOTE_CROSS_ORIGIN), F.lit("{url}"),
                               F.when(F.col("url") != "", F.col("url")).otherwise(F.lit("unknown URL"))),
                     F.lit("{selector}"), sel_q)
    props = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in [
        ("type", "string"), ("placeholder", "string"), ("text_content", "string"), ("href", "string"),
        ("is_required", "boolean"), ("is_disabled", "boolean"), ("is_checked", "boolean")]),
        F.coalesce(F.col("_shown"), F.lit(True)).alias("is_visible"))
    return m.select(
        "page_id", F.col("parent_frame_id").alias("frame_id"), F.col("host_eid").alias("eid"),
        F.col("frame_key"), F.lit(-1).alias("doc_order"),
        F.lit("cross_origin_frame").alias("kind"), F.lit("iframe").alias("tag"),
        F.lit(None).cast("string").alias("role"), F.lit(False).alias("in_shadow"),
        F.coalesce(F.col("parent_path"), F.array().cast("array<string>")).alias("frame_path"),
        F.lit(None).cast("string").alias("form_group"),
        F.when(F.col("name") != "", F.col("name")).alias("accessible_name"),
        F.struct(F.lit("css").alias("strategy"), F.concat(F.lit("locator('"), sel_q, F.lit("')")).alias("playwright"),
                 unique.alias("is_unique"),
                 F.when(~unique, F.lit(GUIDANCE_IFRAME)).alias("disambiguation")).alias("primary_locator"),
        F.array().cast("array<struct<strategy:string,playwright:string,is_unique:boolean,disambiguation:string>>")
        .alias("fallback_locators"),
        props.alias("properties"), note.alias("context_note"),
        F.lit(True).alias("within_budget"),
    )


def page_metadata(ex, opts) -> DataFrame:
    """A2 / A3 / A7 / Q3 per page, notes in the contract's order."""
    max_nodes = NO_LIMIT if opts.max_nodes is None else opts.max_nodes
    ft = ex.frame_tree
    nodes = ex.nodes
    el = ex.elements
    # per frame: node count, first depth-cap element, eid of the node that breaks the walk
    per_frame = nodes.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_f"))
    deep = placed(ft, el.filter(F.col("depth_hit")).groupBy(*FRAME).agg(F.min("eid").alias("deep_eid")), []).select(*FRAME, "deep_eid")
    brk = nodes.filter(F.col("seq") == max_nodes + 1).select(*FRAME, F.col("eid").alias("break_eid"))
    fr = (ft.join(per_frame, FRAME, "left").join(deep, FRAME, "left").join(brk, FRAME, "left")
          .withColumn("n_f", F.coalesce("n_f", F.lit(0))))
    wf = Window.partitionBy("page_id").orderBy("frame_key").rowsBetween(Window.unboundedPreceding, -1)
    fr = fr.withColumn("cum_before", F.coalesce(F.sum(F.when(F.col("reachable"), F.col("n_f"))).over(wf), F.lit(0)))
    budget = F.lit(max_nodes) - F.col("cum_before")
    walked = F.col("reachable") & (budget > 0)
    prefix = F.when(F.size("frame_path") > 0,
                    F.concat(F.lit("[frame "), F.array_join("frame_path", " > "), F.lit("] "))).otherwise(F.lit(""))
    depth_note = F.when(walked & F.col("deep_eid").isNotNull()
                        & (F.col("break_eid").isNull() | (F.col("deep_eid") < F.col("break_eid"))),
                        F.struct(F.col("deep_eid").alias("pos"), F.concat(prefix, F.lit(NOTE_DEPTH.replace("50", str(opts.max_depth)))).alias("note")))
    cap_note = F.when(walked & F.col("break_eid").isNotNull(),
                      F.struct(F.col("break_eid").alias("pos"),
                               F.concat(prefix, F.replace(F.lit(NOTE_NODES), F.lit("{n}"),
                                                          budget.cast("string"))).alias("note")))
    exhausted = F.when(F.col("reachable") & (budget <= 0),
                       F.struct(F.lit(-1).alias("pos"),
                                F.replace(F.replace(F.lit(NOTE_FRAME_BUDGET), F.lit("{n}"), F.lit(str(max_nodes))),
                                          F.lit("{url}"), F.col("url")).alias("note")))
    fr = fr.withColumn("fnotes", F.transform(
        F.array_sort(F.filter(F.array(depth_note, cap_note, exhausted), lambda x: x.isNotNull())),
        lambda x: x["note"]))
    fr = fr.withColumn("ftrunc", (F.size("fnotes") > 0))
    per_page = fr.groupBy("page_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("frame_key", "fnotes"))),
                              lambda x: x["fnotes"])).alias("frame_notes"),
        F.bool_or("ftrunc").alias("truncated"),
        F.count(F.lit(1)).alias("frame_count"))
    kept = ex.kept_nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("node_count"))
    if not opts.include_hidden:
        dropped = (nodes.filter(F.col("within_budget") & ~F.col("properties")["is_visible"])
                   .groupBy("page_id").agg(F.count(F.lit(1)).alias("hidden_dropped")))
    else:
        dropped = None
    title = (el.filter((F.col("frame_id") == 0) & (F.col("tag") == "title"))
             .groupBy("page_id").agg(F.min("eid").alias("title_eid")))
    from pagelens.operators.relate import with_text
    title = with_text(title.withColumn("frame_id", F.lit(0)), ex.element_texts, "title_text", "title_eid")
    title = title.select("page_id", F.trim(F.regexp_replace("title_text", r"[\t\n\f\r ]+", " ")).alias("title"))
    pages = ex.pages
    cap = F.col("captured_at") if "captured_at" in pages.columns else F.current_timestamp()
    m = (pages.select("page_id", "url", cap.alias("captured_at"))
         .join(per_page, "page_id", "left").join(kept, "page_id", "left").join(title, "page_id", "left"))
    if dropped is not None:
        m = m.join(dropped, "page_id", "left")
    node_count = F.coalesce(F.col("node_count"), F.lit(0))
    after = F.array(F.lit(NOTE_AFTER.replace("{n}", str(opts.after_actions)))) if opts.after_actions is not None \
        else F.array().cast("array<string>")
    hidden = (F.when(F.coalesce(F.col("hidden_dropped"), F.lit(0)) > 0,
                     F.array(F.replace(F.lit(NOTE_HIDDEN), F.lit("{k}"), F.col("hidden_dropped").cast("string"))))
              .otherwise(F.array().cast("array<string>"))) if dropped is not None else F.array().cast("array<string>")
    empty = F.when(node_count == 0, F.array(F.lit(NOTE_EMPTY))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(after, F.coalesce(F.col("frame_notes"), F.array().cast("array<string>")), hidden, empty)
    return m.select(
        "page_id",
        F.coalesce(F.col("title"), F.lit("")).alias("title"), "url",
        F.date_format(F.col("captured_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("captured_at"),
        node_count.cast("int").alias("node_count"),
        F.coalesce(F.col("frame_count"), F.lit(1)).cast("int").alias("frame_count"),
        F.coalesce(F.col("truncated"), F.lit(False)).alias("truncated"),
        notes.alias("notes"))


def extracts(kept_nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """Nested document per page; nodes in frame order then document order."""
    node = F.struct(*[F.col(c) for c in NODE_FIELDS])
    grouped = kept_nodes.groupBy("page_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("frame_key").alias("k1"), F.col("doc_order").alias("k2"),
                                                         node.alias("n")))),
                    lambda x: x["n"]).alias("interactive_nodes"))
    page_md = F.struct("title", "url", "captured_at", "node_count", "frame_count", "truncated", "notes")
    return (meta.join(grouped, "page_id", "left")
            .select("page_id", F.lit(SCHEMA_VERSION).alias("schema_version"), page_md.alias("page_metadata"),
                    F.coalesce(F.col("interactive_nodes"), F.array().cast(
                        grouped.schema["interactive_nodes"].dataType.simpleString())).alias("interactive_nodes")))
