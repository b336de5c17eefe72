"""Facts of the nearest ancestors (J3, J4, J5, J11, J2, P14) and collapsed texts (P2), frame by frame over arrays.

A frame is one row of arrays in preorder, and a batch of frames is one flat array, in which a parent is a place. "The nearest
ancestor-or-self with X" is found for all elements at once by pointer doubling: an element points to itself if it has X, else to
its parent, and unresolved pointers are followed by pointers until none is left: a logarithmic number of steps in the depth,
without a list of ancestors per element. The frame's text is collapsed once and the elements' offsets move along, so an element's text
is a slice of it; where the contract cuts texts, only what it keeps is taken. Work grows with the page, not with its depth; the css
path, which is as long as the element is deep, is written for subjects alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.props import A
from pagelens.operators.select import FRAME
from pagelens.operators.textmatch import collapsed, groups_of, in_text, trimmed

KEPT_CHARS = 121  # one more than the longest cut, so that a cut still shows

_CELLS = ["eid", "parent", "root_id", "depth", "in_shadow", "sib_index", "tag", "t_start", "t_end", "subject", "want", "live",
          "st_visibility", "st_cursor", "a_id", "a_name", "a_role", "a_label", "a_testid", "form_idx"]
SCHEMA = ("page_id long, frame_id long, eid int, subject boolean, want int, ctext string, _css string, form struct<id:string,name:string,idx:long>, "
          "region struct<tag:string,role_form:boolean,id:string,label:string>, scope_hint string, visibility string, cursor string, parent_cursor string, "
          "closest_label_eid int, cl_text string, live_anc array<int>")


def nearest(flag: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Place of the nearest ancestor-or-self with ``flag`` (-1: none), by pointer doubling."""
    to = np.where(flag, np.arange(len(flag)), parent)
    while True:
        open_ = np.flatnonzero((to >= 0) & ~flag[np.maximum(to, 0)])
        if not len(open_):
            return to
        to[open_] = to[to[open_]]


def _take(values: pa.Array, at: np.ndarray) -> pa.Array:
    return values.take(pa.array(at, pa.int64(), mask=at < 0))


def _paths(rows: np.ndarray, parent: np.ndarray, tags: list[str], sib: np.ndarray) -> list[str]:
    """css paths of ``rows``; ancestors that they share are written once."""
    known: dict[int, str] = {}
    out = []
    for i in rows.tolist():
        chain = []
        while i >= 0 and i not in known:
            chain.append(i)
            i = int(parent[i])
        for j in reversed(chain):
            known[j] = tags[j] if parent[j] < 0 else f"{known[int(parent[j])]} > {tags[j]}:nth-child({sib[j]})"
        out.append(known[chain[0]] if chain else known[i])
    return out


def _fold():
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cells")
            sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
            flat = cells.flatten()
            col = {name: flat.field(i) for i, name in enumerate(_CELLS)}
            get = lambda name, null=0: np.asarray(col[name].fill_null(null))
            frame = np.repeat(np.arange(len(sizes)), sizes)
            key = frame * 2**32 + get("eid")
            up = np.searchsorted(key, frame * 2**32 + np.maximum(get("parent"), 0))
            parent = np.where(get("parent") >= 0, up, -1)
            root, depth, subject, want = get("root_id"), get("depth"), get("subject", False), get("want").copy()
            same = lambda at: np.where((at >= 0) & (root[np.maximum(at, 0)] == root), at, -1)
            strict = lambda at: np.where(parent >= 0, at[np.maximum(parent, 0)], -1)
            tag = lambda *names: np.asarray(pa.compute.is_in(col["tag"], pa.array(names)))
            present = lambda name: np.asarray(col[name].is_valid())
            role_form = np.asarray(pa.compute.equal(col["a_role"], "form").fill_null(False))
            tested = np.asarray(pa.compute.not_equal(col["a_testid"], "").fill_null(False))
            form, region = same(nearest(tag("form"), parent)), same(nearest(role_form | tag("section"), parent))
            label, scope = same(nearest(tag("label"), parent)), same(strict(nearest(tested, parent)))
            visible, cursor = nearest(present("st_visibility"), parent), nearest(present("st_cursor"), parent)
            # the path is the document's only if no shadow root stands above
            top = nearest(parent < 0, parent)
            plain = ~get("in_shadow", False) & (root[np.maximum(top, 0)] == root)
            # containers of live regions: up to three ancestors below body, nearest first
            hops, at = [], np.arange(len(parent))
            for _ in range(3):
                at = np.where(at >= 0, parent[np.maximum(at, 0)], -1)
                ok = (at >= 0) & (depth[np.maximum(at, 0)] >= 2)
                hops.append(same(np.where(ok, at, -1)))
            live = get("live", False)
            for hop in hops:
                at = hop[live & (hop >= 0)]
                want[at] = np.maximum(want[at], 1)

            keep = np.flatnonzero(subject | (want > 0))
            texts: list[str] = [""] * len(keep)
            where = frame[keep]
            start, end = get("t_start").astype(np.int64), get("t_end").astype(np.int64)
            pages = [t or "" for t in batch.column("text").to_pylist()]
            length = np.array([len(t) for t in pages], np.int64)
            for f, g in groups_of(length):
                low, high = np.searchsorted(where, [f, g]).tolist()
                some = keep[low:high]
                starts = np.concatenate([[0], np.cumsum(length[f:g])])[:-1]
                text, offsets = collapsed("".join(pages[f:g]), starts)
                a, b = trimmed(text, *(offsets[in_text(at[some], where[low:high] - f, starts, length[f:g])] for at in (start, end)))
                b = np.where(want[some] >= 2, b, np.minimum(b, a + KEPT_CHARS))
                texts[low:high] = [text[x:y] for x, y in zip(a.tolist(), b.tolist())]
            written = keep[subject[keep] & plain[keep]]
            css = dict(zip(written.tolist(), _paths(written, parent, col["tag"].to_pylist(), get("sib_index"))))
            eids = get("eid")
            ancestors = [[int(eids[h[i]]) for h in hops if h[i] >= 0] if alive else [] for i, alive in zip(keep.tolist(), live[keep].tolist())]
            take = lambda name, at: _take(col[name], at[keep])
            kept = np.full(len(parent), -1)
            kept[keep] = np.arange(len(keep))
            text_of = lambda at: _take(ctext, np.where(at >= 0, kept[np.maximum(at, 0)], -1))
            ctext = pa.array(texts, pa.string())
            struct = lambda at, **of: pa.StructArray.from_arrays(list(of.values()), list(of), mask=pa.array(at[keep] < 0))
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id").take(pa.array(where)), batch.column("frame_id").take(pa.array(where)), take("eid", np.arange(len(parent))),
                pa.array(subject[keep]), pa.array(want[keep].astype(np.int32)), ctext, pa.array([css.get(i, "") for i in keep.tolist()], pa.string()),
                struct(form, id=take("a_id", form), name=take("a_name", form), idx=take("form_idx", form)),
                struct(region, tag=take("tag", region), role_form=pa.array(np.where(region >= 0, role_form[np.maximum(region, 0)], False)[keep]), id=take("a_id", region),
                       label=take("a_label", region)),
                take("a_testid", scope), take("st_visibility", visible), take("st_cursor", cursor), take("st_cursor", strict(cursor)),
                take("eid", label), text_of(label[keep]), pa.array(ancestors, pa.list_(pa.int32()))],
                ["page_id", "frame_id", "eid", "subject", "want", "ctext", "_css", "form", "region", "scope_hint", "visibility", "cursor", "parent_cursor",
                 "closest_label_eid", "cl_text", "live_anc"])
    return run


def fold_frames(elements: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows of SCHEMA for every element with ``subject`` or ``want`` > 0 (1: its text up to KEPT_CHARS, 2: its whole text).

    ``elements``: the flagged tree with style values, ``form_idx`` and ``live`` (an empty live region); ``frames``: page_id, frame_id, text.
    """
    from pyspark import cloudpickle

    import pagelens.operators.ancestors as me
    import pagelens.operators.textmatch as texts
    for module in (me, texts):
        try:  # the stage travels with the task: executors need no installed copy of the package
            cloudpickle.register_pickle_by_value(module)
        except (ValueError, AttributeError):
            pass
    e = elements.select(
        *FRAME, "eid", F.coalesce("parent_eid", F.lit(-1)).alias("parent"), "root_id", "depth", "in_shadow", "sib_index", "tag", "t_start", "t_end", "subject", "want", "live",
        "st_visibility", "st_cursor", A["id"].alias("a_id"), A["name"].alias("a_name"), A["role"].alias("a_role"), A["aria-label"].alias("a_label"),
        A["data-testid"].alias("a_testid"), F.col("form_idx").cast("long").alias("form_idx"))
    rows = e.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(*_CELLS))).alias("cells")).join(frames.select(*FRAME, "text"), FRAME, "left")
    rows = rows.select("page_id", F.col("frame_id").cast("long").alias("frame_id"), "text", "cells")
    return rows.mapInArrow(_fold(), SCHEMA).withColumn("frame_id", F.col("frame_id").cast(dict(elements.dtypes)["frame_id"]))
