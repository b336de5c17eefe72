"""J7 text matching by positions: which elements hold a text, found in the frame's text once and not in every element's copy of it.

A frame's match text is collapsed once (whitespace runs become one space) and element intervals are moved along. All distinct texts
asked for in the frame are searched together (Aho-Corasick), and every occurrence is stabbed to the deepest element whose interval
covers it, by climbing from the owner of its first character. An element that matches below another one takes its place, so what
is left are the innermost matches. Costs grow with the frame's text plus the occurrences, not with the depth of the tree, and only
(text, element) pairs leave the stage: no element's text is part of any exchange.

One frame is one row of arrays: its intervals come from one page, whose tree was built from one row before. Frames of a batch are worked on
together, their texts one after the other as one long text, so that small pages cost no call per page.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.select import FRAME

# JavaScript's white space.
WHITE = np.array([9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF], np.uint32)
_IS_WHITE = np.zeros(1 << 16, bool)
_IS_WHITE[WHITE] = True
_IS_WHITE[-1] = False  # stands for every character above it, too

GROUP_CHARS = 1 << 20  # frames whose texts are worked on together; a longer text is a group of its own


def groups_of(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive frames with at most GROUP_CHARS characters together, or of one frame."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > GROUP_CHARS:
            out.append((first, i))
            first, total = i, 0
        total += n
    return out + ([(first, len(sizes))] if first < len(sizes) else [])


def collapsed(text: str, starts: np.ndarray | None = None) -> tuple[str, np.ndarray]:
    """The text with whitespace runs as one space, and for every offset of ``text`` (its end included) the offset there.

    ``starts``: where the texts begin that ``text`` joins; each is collapsed by itself."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = _IS_WHITE[np.minimum(codes, len(_IS_WHITE) - 1)]
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]
    keep[:1] = True
    if starts is not None:
        keep[starts[starts < len(keep)]] = True
    out = np.where(white, np.uint32(32), codes)[keep]
    return out.tobytes().decode("utf-32-le", "surrogatepass"), np.concatenate([[0], np.cumsum(keep)])


def in_text(offsets: np.ndarray, frame: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Offsets in the texts of ``frame`` as offsets in the text that joins them."""
    if (offsets > sizes[frame]).any():
        raise IndexError("an offset behind the end of its frame's text")
    return offsets + starts[frame]


def lowered(text: str, offsets: np.ndarray) -> tuple[str, np.ndarray]:
    """Lower case, character by character, with the offsets moved where a character becomes several."""
    if "\u0130" not in text and "\u03a3" not in text:  # only the first becomes several, only the second depends on its neighbours
        return text.lower(), offsets
    parts = [c.lower() for c in text]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return "".join(parts), np.concatenate([[0], np.cumsum(sizes)])[offsets]


def trimmed(text: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals without a space at their ends; an interval of nothing else becomes empty."""
    blank = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32
    blank = np.append(blank, False)
    start = np.where((start < end) & blank[start], start + 1, start)
    end = np.where((start < end) & blank[np.maximum(end - 1, 0)], end - 1, end)
    return start, np.maximum(start, end)


def occurrences(text: str, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, first character) of every occurrence, overlapping ones included."""
    import ahocorasick
    machine = ahocorasick.Automaton()
    for i, w in enumerate(wanted):
        machine.add_word(w, i)
    machine.make_automaton()
    found = list(machine.iter(text))
    which = np.array([i for _, i in found], np.int64)
    size = np.array([len(w) for w in wanted], np.int64)
    return which, np.array([e for e, _ in found], np.int64) - size[which] + 1


def innermost_at(which: np.ndarray, first: np.ndarray, size: np.ndarray, eid: np.ndarray, place: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray,
                 exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, place of the element) of the innermost elements that hold a text at ``first``, or with ``exact`` are it.

    ``which``, ``first``: number and first character of every occurrence, ``size``: the texts' lengths; ``place``: where an element's
    parent stands (-1: nowhere). Intervals are nested or apart, outer ones first. The deepest one around a character is the last that starts
    up to there or one above it. The text of a shadow tree stands behind that of its document, so starts need not rise with the places."""
    after = first + size[which]
    filled = np.flatnonzero(end > start)
    order = filled[np.lexsort((filled, -end[filled], start[filled]))]
    before = np.searchsorted(start[order], first, "right") - 1
    at = np.where(before >= 0, order[np.maximum(before, 0)], -1) if len(order) else np.full(len(first), -1)
    while True:
        low = (at >= 0) & (end[np.maximum(at, 0)] < after)
        if not low.any():
            break
        at = np.where(low, place[np.maximum(at, 0)], at)
    held = at >= 0
    if exact:
        held &= (start[np.maximum(at, 0)] == first) & (end[np.maximum(at, 0)] == after)
    pairs = np.stack(np.divmod(np.unique(which[held] * (len(eid) + 1) + at[held]), len(eid) + 1))
    if exact or not pairs.shape[1]:
        return pairs[0], pairs[1]
    covers = np.zeros(pairs.shape[1], bool)  # the next match of the same text stands inside
    covers[:-1] = (pairs[0, 1:] == pairs[0, :-1]) & (eid[pairs[1, 1:]] <= last[pairs[1, :-1]])
    return pairs[0, ~covers], pairs[1, ~covers]


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """The lists of whole numbers of a column, without an object per number."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _filled(column: pa.Array) -> list[list[tuple[int, str]]]:
    """(place, value) of the values that are there, list by list."""
    flat = column.flatten()
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    out: list[list[tuple[int, str]]] = [[] for _ in ends]
    at = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
    for i, row, value in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist(), flat.take(pa.array(at)).to_pylist()):
        out[row].append((i - (int(ends[row - 1]) if row else 0), value))
    return out


def parents(frame: np.ndarray, eid: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Places of the parents; ``eid`` rises within a frame, frames stand one after the other."""
    key, up = frame * 2**32 + eid, frame * 2**32 + np.maximum(parent, 0)
    place = np.searchsorted(key, up)
    return np.where((parent >= 0) & (place < len(key)) & (key[np.minimum(place, len(key) - 1)] == up), place, -1)


def innermost(text: str, wanted: list[str], eid: np.ndarray, parent: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray,
              exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """``innermost_at`` for the texts ``wanted`` in one frame's ``text``."""
    which, first = occurrences(text, wanted)
    size = np.array([len(w) for w in wanted], np.int64)
    return innermost_at(which, first, size, eid, parents(np.zeros(len(eid), np.int64), eid, parent), last, start, end, exact)


def _search(exact: bool):
    lower = (lambda v: v) if exact else (lambda v: "".join(c.lower() for c in v))

    def search(frames, texts, tree, shown, out):
        """Matches of some frames (page, frame, wanted texts); ``tree``: their elements, by frame."""
        frame, eid, parent, last, start, end = tree
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        start, end = in_text(start, frame, starts, sizes), in_text(end, frame, starts, sizes)
        plain, offsets = collapsed("".join(texts), starts)
        edges = np.append(starts, sizes.sum())
        if not exact:
            plain, offsets = lowered(plain, offsets)
        edges = offsets[edges].tolist()
        s, t = trimmed(plain, offsets[start], offsets[end])
        asked, which, first, size = [], [], [], []  # per frame: its distinct texts with their members, and the number of the first one
        for i, (_, _, wanted) in enumerate(frames):
            values = list(dict.fromkeys(wanted))
            members: dict[str, list[str]] = {}
            for v in values:
                members.setdefault(lower(v), []).append(v)
            some = [w for w in members if w]
            asked.append((members, {w: len(size) + k for k, w in enumerate(some)}))
            if some:
                a, b = occurrences(plain[edges[i]:edges[i + 1]], some)
                which.append(a + len(size))
                first.append(b + edges[i])
                size += map(len, some)
        found_text = found_place = np.zeros(0, np.int64)
        if which:
            found_text, found_place = innermost_at(np.concatenate(which), np.concatenate(first), np.array(size, np.int64), eid, parents(frame, eid, parent), last, s, t, exact)
        cuts = np.searchsorted(found_text, np.arange(len(size) + 1)).tolist()
        found = eid[found_place].tolist()
        edge = np.searchsorted(frame, np.arange(len(frames) + 1)).tolist()
        for i, (page, number, _) in enumerate(frames):
            members, numbers = asked[i]
            # values of input buttons are texts of their own; an element whose child shows the text is not innermost
            buttons = {int(eid[edge[i] + k]): (int(parent[edge[i] + k]), lower(v)) for k, v in shown[i]}
            for w, values in members.items():
                hits = set(found[cuts[numbers[w]]:cuts[numbers[w] + 1]]) if w else set()
                if not w and not exact:
                    own = slice(edge[i], edge[i + 1])
                    filled = t[own] > s[own]  # every element with text, the innermost of them
                    hits = set(eid[own][filled].tolist()) - set(parent[own][filled].tolist())
                if buttons:
                    fields = {e: p for e, (p, v) in buttons.items() if (v == w if exact else w in v)}
                    hits = (hits - set(fields.values())) | set(fields)
                for value in values:
                    out["page_id"] += [page] * len(hits)
                    out["frame_id"] += [number] * len(hits)
                    out["value"] += [value] * len(hits)
                    out["m_eid"] += sorted(hits)

    def run(batches):
        for batch in batches:
            out = {"page_id": [], "frame_id": [], "value": [], "m_eid": []}
            frames = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))))
            texts = [t or "" for t in batch.column(2).to_pylist()]
            cells = [_numbers(batch.column(i)) for i in range(4, 9)]
            shown = _filled(batch.column(9))
            for a, b in groups_of(np.array([len(t) for t in texts], np.int64)):
                frame = np.repeat(np.arange(b - a), [len(x) for x in cells[0][a:b]])
                search(frames[a:b], texts[a:b], (frame, *(np.concatenate(c[a:b]) for c in cells)), shown[a:b], out)
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(out["page_id"], pa.int64()), "frame_id": pa.array(out["frame_id"], pa.int64()),
                                              "value": pa.array(out["value"], pa.string()), "m_eid": pa.array(out["m_eid"], pa.int32())})
    return run


def text_pairs(keys: DataFrame, elements: DataFrame, frames: DataFrame, shown: DataFrame, mode: str) -> DataFrame:
    """(page_id, frame_id, value, m_eid) of the innermost elements for every text of ``keys`` (page_id, frame_id, value).

    ``elements``: the tree with match offsets; ``frames``: page_id, frame_id, mtext; ``shown``: page_id, frame_id, eid, mt of the input
    buttons that show a value. ``mode``: "contains" (case ignored) or "exact".
    """
    from pyspark import cloudpickle

    import pagelens.operators.textmatch as me
    try:  # the stage travels with the task: executors need no installed copy of the package
        cloudpickle.register_pickle_by_value(me)
    except (ValueError, AttributeError):
        pass
    wanted = keys.filter(F.col("value").isNotNull()).groupBy(*FRAME).agg(F.collect_set("value").alias("wanted"))
    tree = (elements.select(*FRAME, "eid", F.coalesce("parent_eid", F.lit(-1)).alias("parent"), "last_eid", "m_start", "m_end")
            .join(wanted.select(*FRAME), FRAME, "left_semi").join(shown.select(*FRAME, "eid", "mt"), [*FRAME, "eid"], "left")
            .filter((F.col("m_end") > F.col("m_start")) | F.col("mt").isNotNull()))
    cells = F.sort_array(F.collect_list(F.struct("eid", "parent", "last_eid", "m_start", "m_end", "mt")))
    tree = tree.groupBy(*FRAME).agg(cells.alias("t"))
    rows = wanted.join(tree, FRAME).join(frames.select(*FRAME, "mtext"), FRAME)
    rows = rows.select("page_id", F.col("frame_id").cast("long").alias("frame_id"), "mtext", "wanted", "t.eid", "t.parent", "t.last_eid", "t.m_start", "t.m_end", "t.mt")
    return rows.mapInArrow(_search(mode != "contains"), "page_id long, frame_id long, value string, m_eid int")
