"""Many pages at once as flat columns: the segments of texts, and the folds of ``layout`` and ``columns`` over them.

Texts are dealt by their document and sorted by it, so that a page's rows lie one after
the other; a chunk holds whole pages. A page is plain if its segments come in visual
order, a line's segments stand at one height with a space between them, and lines are
further apart than any rule reaches. Folds over plain pages work on columns; every other page goes
through the fold over its segments, which gives the same where both apply.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.operators import columns as repairs
from docstrata.operators import layout
from docstrata.operators.layout import Segment

#: Bytes of text in one chunk of pages, unless one page has more.
CHUNK_BYTES = 1 << 20
#: Fixed values of the derived segments: left edge, top, step of lines, font, width of a sign, room of a space, room after a clause.
LEFT, TOP, STEP, FONT, SIGN, SPACE, CLAUSE = 72.0, 720, 14, 12.0, 5.4, 4, 40

#: White space as ``str.split`` has it, within a class of a pattern.
_WHITE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that a rule beyond snapping may change: several words, leaders, addresses, check boxes.
_SPECIAL = f"[{_WHITE}]|[.][.][.]|[{''.join(layout.CHECK_BOXES)}]|" + "|".join(re.escape(x) for x in repairs.DOMAINS)


class Pages:
    """Segments of whole pages, in the pages' order; ``of`` numbers each segment's page."""

    def __init__(self, keys: pa.Array, of: np.ndarray, text: pa.Array, x: np.ndarray, y: np.ndarray, font: np.ndarray, width: np.ndarray, seq: np.ndarray):
        self.keys, self.of, self.text, self.x, self.y, self.font, self.width, self.seq = keys, of, text, x, y, font, width, seq
        self.edges = np.searchsorted(of, np.arange(len(keys) + 1))

    def segments(self, page: int) -> list[Segment]:
        part = slice(*self.edges[page : page + 2])
        return [Segment(*row[:5], seq=row[5]) for row in zip(self.text[part].to_pylist(), *(v[part].tolist() for v in (self.x, self.y, self.font, self.width, self.seq)), strict=True)]

    @cached_property
    def heads(self) -> np.ndarray:
        """Which segments begin a line: a page's first ones and those at another height than the one before."""
        out = np.ones(len(self.of), bool)
        out[1:] = (self.of[1:] != self.of[:-1]) | (self.y[1:] != self.y[:-1])
        return out

    @cached_property
    def lines(self) -> np.ndarray:
        """Where lines begin, and where the last one ends."""
        return np.append(np.flatnonzero(self.heads), len(self.of))

    @cached_property
    def plain(self) -> np.ndarray:
        """Which pages are plain."""
        fits = np.isfinite(self.x) & np.isfinite(self.y) & np.isfinite(self.width) & (self.width >= 0) & (self.font > 0)
        if len(fits) > 1:
            end, largest = self.x + self.width, np.maximum(self.font[1:], self.font[self.lines[np.cumsum(self.heads) - 1]][:-1])
            room = np.maximum(2.0, layout.SPACE_GAP * self.font[1:])
            inside = (self.x[1:] - self.x[:-1] > layout.DUPLICATE) & (self.x[1:] - end[:-1] >= room) & (end[1:] >= end[:-1])
            drop = self.y[:-1] - self.y[1:]
            below = (drop > layout.SAME_LINE) & (drop > layout.SAME_VISUAL_LINE * largest)
            fits[1:] &= (self.of[1:] != self.of[:-1]) | np.where(self.heads[1:], below, inside)
        out = np.ones(len(self.keys), bool)
        out[self.of[~fits]] = False
        return out

    def having(self, segments: np.ndarray) -> np.ndarray:
        """Which pages have one of the flagged segments."""
        return np.bincount(self.of[segments], minlength=len(self.keys)) > 0

    @cached_property
    def edge_like(self) -> np.ndarray:
        """Segments whose left edges count: those with a width and a text that is neither blank nor a check box."""
        out = pc.match_substring_regex(self.text, "[0-9A-Za-z]").to_numpy(zero_copy_only=False).copy()
        rest = np.flatnonzero(~out)
        bare = [v.strip() for v in self.text.take(pa.array(rest)).to_pylist()]
        out[rest] = [bool(v) and v not in layout.CHECK_BOXES for v in bare]
        return out & (self.width > 0)

    @cached_property
    def anchors(self) -> list[list[float]]:
        """``layout.repeated_anchors`` of each page. Edges further apart than a mean reaches have no mean in common, so that each run of near edges is folded alone, and runs too short to repeat are not."""
        which = np.flatnonzero(self.edge_like)
        x, of = self.x[which], self.of[which]
        order = np.lexsort((x, of))
        starts = np.ones(len(which), bool)
        starts[1:] = (of[order][1:] != of[order][:-1]) | (np.diff(x[order]) > layout.ANCHOR + 0.01)
        run = np.empty(len(which), np.int64)
        run[order] = np.cumsum(starts) - 1
        kept = np.flatnonzero((np.bincount(run) >= layout.ANCHOR_SEGMENTS)[run])
        kept = kept[np.argsort(run[kept], kind="stable")]
        x, of = x[kept].tolist(), of[kept].tolist()
        edges = [*np.flatnonzero(np.diff(run[kept], prepend=-1)).tolist(), len(kept)] if len(kept) else []
        out: list[list[float]] = [[] for _ in range(len(self.keys))]
        for lo, hi in zip(edges, edges[1:], strict=False):
            out[of[lo]] += layout.repeated_edges(x[lo:hi])
        return out


def derived(keys: pa.Array, texts: pa.Array, spread: bool) -> Pages:
    """The segments of texts, a page for each run of equal keys: word i of line j stands at x = 72 plus the widths and gaps before it, y = 720 - 14 j; ``spread`` adds 40 points for each clause before it."""
    known = pc.is_valid(texts)
    keys, texts = keys.filter(known), texts.filter(known)
    split = pc.split_pattern(texts, "\n")
    row = pc.list_parent_indices(split).to_numpy()
    number = np.arange(len(row)) - split.offsets.to_numpy()[row]
    parts = pc.split_pattern(split.flatten(), " ")
    line, first = pc.list_parent_indices(parts).to_numpy(), parts.offsets.to_numpy()
    words = parts.flatten()
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    place = np.arange(len(words), dtype=np.int64) - first[line]
    before = lambda n: (sums := np.cumsum(n) - n) - sums[first[line]]
    x = LEFT + before(size) * SIGN + (place * SPACE).astype(float)
    if spread:
        x += CLAUSE * before(pc.or_(pc.ends_with(words, "."), pc.ends_with(words, ",")).to_numpy(zero_copy_only=False).astype(np.int64))
    shown = np.flatnonzero(size > 0)
    runs = [k for k in range(len(keys)) if not k or keys[k].as_py() != keys[k - 1].as_py()]
    page = np.searchsorted(np.array(runs), np.arange(len(keys)), "right") - 1 if len(keys) else np.empty(0, np.int64)
    line, place = line[shown], place[shown]
    of, number = page[row[line]], number[line]
    if len(runs) < len(keys):
        order = np.lexsort((place, number, of))
        shown, place, of, number = shown[order], place[order], of[order], number[order]
    size = size[shown]
    return Pages(keys.take(pa.array(runs, pa.int64())), of, words.take(pa.array(shown)), x[shown], (TOP - STEP * number).astype(float), np.full(len(shown), FONT), size * FONT * 0.45, place)


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) rows in chunks that end with a key's last row; keys are sorted, so that only the last one can go on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sizes = batch.column(0).to_pylist(), pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = size = 0
        for k, key in enumerate(keys):
            size += sizes[k]
            if k + 1 < len(keys) and key != keys[k + 1] and size >= CHUNK_BYTES or k + 1 == len(keys):
                if held and held[-1].column(0)[-1].as_py() != keys[start]:
                    yield _one(held)
                    held = []
                held.append(batch.slice(start, k + 1 - start))
                start, size = k + 1, 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def folded(documents: DataFrame, spread: bool, fold: Callable[[Pages], pa.RecordBatch], schema: str) -> DataFrame:
    """``fold`` over the pages of documents (doc_id, text): texts are dealt and sorted by their document, words are never shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            yield fold(derived(batch.column(0), batch.column(1), spread))

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartition(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema)


def _kept_lines(pages: Pages, chosen: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Lines of the chosen pages that aren't blank, by number, and their texts."""
    lines = pages.lines
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(lines, pa.int32()), pages.text), " ")
    which = np.flatnonzero(chosen[pages.of[lines[:-1]]]) if len(pages.of) else np.empty(0, np.int64)
    texts = [" ".join(v.split()) for v in joined.take(pa.array(which)).to_pylist()]
    kept = np.array([bool(v) for v in texts], bool)
    return which[kept], [v for v in texts if v]


def text_lines(pages: Pages) -> pa.RecordBatch:
    """``layout.text_lines`` of every page: doc_id, y, text, n_cells."""
    which, texts = _kept_lines(pages, pages.plain)
    starts = pages.lines[which]
    of, y, n = pages.of[starts].tolist(), pages.y[starts].tolist(), (pages.lines[which + 1] - starts).tolist()
    for page in np.flatnonzero(~pages.plain).tolist():
        for z in layout.text_lines(pages.segments(page)):
            of.append(page), y.append(z.y), texts.append(z.text), n.append(len(z.cells))
    return pa.RecordBatch.from_arrays([pages.keys.take(pa.array(of, pa.int64())), pa.array([round(v, 3) for v in y], pa.float64()), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["doc_id", "y", "text", "n_cells"])


def _cells(pages: Pages) -> np.ndarray:
    """Which segments of plain pages begin a cell of their line."""
    out = pages.heads.copy()
    wide = np.maximum(layout.LEAST_CELL_GAP, layout.CELL_GAP * np.maximum(8.0, pages.font[pages.lines[np.cumsum(out) - 1]]))
    out[1:] |= pages.x[1:] - (pages.x + pages.width)[:-1] >= wide[1:]
    return out


def _windows(pages: Pages, which: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """``layout.common_columns`` of every window of four lines: page, place of its first line, left edge."""
    cells = np.flatnonzero(_cells(pages))
    low, high = np.searchsorted(cells, pages.lines[which]), np.searchsorted(cells, pages.lines[which + 1])
    of = pages.of[pages.lines[which]]
    first = np.searchsorted(of, of)
    last = np.searchsorted(of, of, "right")
    at = np.arange(len(which))
    window, member, value = [], [], []
    for k in range(layout.TABLE_WINDOW):
        own = at[(at + k < last) & (at + 1 < last)]
        n = high[own + k] - low[own + k]
        window.append(np.repeat(own, n))
        member.append(np.full(n.sum(), 1 << k))
        value.append(pages.x[cells[np.repeat(low[own + k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]])
    window, member, value = map(np.concatenate, (window, member, value))
    order = np.lexsort((value, window))
    need = np.maximum(2, -(-np.minimum(layout.TABLE_WINDOW, last - at) // 2)).tolist()
    found, edges, now, start, seen = [], [], -1, 0.0, 0
    for w, x, bit in zip(window[order].tolist(), value[order].tolist(), member[order].tolist(), strict=True):
        if w == now and x - start <= layout.CLUSTER:
            seen |= bit
            continue
        if seen and seen.bit_count() >= need[now]:
            found.append(now), edges.append(start)
        now, start, seen = w, x, bit
    if seen and seen.bit_count() >= need[now]:
        found.append(now), edges.append(start)
    return of[found].tolist(), (at - first)[found].tolist(), edges


def shared_columns(pages: Pages) -> pa.RecordBatch:
    """Columns of every page: those that windows of four lines share, left edges that repeat, and runs of one visual line."""
    which, _ = _kept_lines(pages, pages.plain) if len(pages.of) else (np.empty(0, np.int64), [])
    of, at, x = _windows(pages, which) if len(which) else ([], [], [])
    kinds = ["window"] * len(of)
    for page in range(len(pages.keys)):
        if pages.plain[page]:
            rows = []
        else:
            made = pages.segments(page)
            lines = layout.text_lines(made)
            rows = [("window", i, v) for i in range(len(lines) - 1) for v in layout.common_columns(lines[i : i + layout.TABLE_WINDOW])]
            rows += [("run", i, g[0].x) for i, g in enumerate(layout.visual_groups(made))]
        rows += [("repeated", i, v) for i, v in enumerate(pages.anchors[page])]
        of += [page] * len(rows)
        kinds += [r[0] for r in rows]
        at += [r[1] for r in rows]
        x += [r[2] for r in rows]
    starts = pages.lines[:-1][pages.plain[pages.of[pages.lines[:-1]]]] if len(pages.of) else np.empty(0, np.int64)
    runs = pages.of[starts]
    columns = [pa.array(np.concatenate((np.array(of, np.int64), runs))), pa.array(kinds + ["run"] * len(runs), pa.string()), pa.array(np.concatenate((np.array(at, np.int64), np.arange(len(runs)) - np.searchsorted(runs, runs)))), pa.array(np.concatenate((np.array(x, float), pages.x[starts])))]
    return pa.RecordBatch.from_arrays([pages.keys.take(columns[0]), *columns[1:]], ["doc_id", "kind", "at", "x"])


class _Heights:
    """Heights at which a page's segments stand near an anchor, least first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, anchor: float, reach: float):
        self.ys, self.anchor, self.reach = np.unique(y[np.abs(x - anchor) <= reach]).tolist(), anchor, reach

    def around(self, y: float, least: float) -> bool:
        """Whether there are some both above and below, near enough."""
        most, ys = repairs.REACH * self.reach, self.ys
        k = bisect_right(ys, y)
        while k < len(ys) and ys[k] - y <= least:
            k += 1
        if k == len(ys) or ys[k] - y > most:
            return False
        k = bisect_left(ys, y) - 1
        while k >= 0 and y - ys[k] <= least:
            k -= 1
        return k >= 0 and y - ys[k] <= most

    def changed(self, y: float, line: list[float]) -> None:
        """A segment of the line at this height has moved."""
        k = bisect_left(self.ys, y)
        had, has = k < len(self.ys) and self.ys[k] == y, any(abs(x - self.anchor) <= self.reach for x in line)
        if had and not has:
            del self.ys[k]
        elif has and not had:
            self.ys.insert(k, y)


def _snap(pages: Pages, page: int, lines: list[int], anchors: list[float], page_width: float) -> None:
    """``columns.snapped`` of a plain page of one font without check boxes, in place; ``lines`` are where its lines begin, and its end."""
    anchors = [a for a in anchors if repairs.plausible(page_width, a)]
    if not anchors:
        return
    part = slice(*pages.edges[page : page + 2])
    x, y = pages.x[part], pages.y[part]
    given, heights, widths, size = x.tolist(), y.tolist(), pages.width[part].tolist(), float(pages.font[part.start])
    font, shift = max(size, 6.0), part.start
    near: dict[float, _Heights] = {}
    for lo, hi in zip(lines, lines[1:], strict=False):
        lo, hi = lo - shift, hi - shift
        first = given[lo]
        k = bisect_right(anchors, first + repairs.COLUMN_GAP * page_width)
        if hi - lo < 2 or k == len(anchors) or anchors[k] >= given[hi - 1] + widths[hi - 1]:
            continue
        anchor = anchors[k]
        if anchor not in near:
            near[anchor] = _Heights(x, y, anchor, font)
        if not near[anchor].around(heights[lo], size * 0.5):
            continue
        reach = 1.5 * font
        stand = [i for i in range(bisect_left(given, anchor - reach - 1, lo, hi), bisect_right(given, anchor + reach + 1, lo, hi)) if abs(given[i] - anchor) <= reach]
        if len(stand) > 1:
            continue
        for i in range(bisect_right(given, first + 4 * font, lo + 1, hi), hi):
            if given[i] >= anchor - reach:
                break
            if (not stand or stand == [i]) and repairs.starts_column(pages.text[shift + i].as_py()):
                x[i] = anchor
                line = x[lo:hi].tolist()
                for h in near.values():
                    h.changed(heights[lo], line)
                break


def repaired(pages: Pages, page_width: float, page_height: float) -> pa.RecordBatch:
    """``columns.repair`` of every page, its segments numbered: doc_id, seq, text, x, y, width."""
    pages.seq = np.arange(len(pages.of)) - pages.edges[pages.of]
    rare = ~pages.plain | pages.having(pc.match_substring_regex(pages.text, _SPECIAL).to_numpy(zero_copy_only=False) | (pages.font != pages.font[pages.edges[pages.of]]))
    heads = np.searchsorted(pages.lines, pages.edges).tolist()
    lines = pages.lines.tolist()
    made: list[tuple] = []
    for page in range(len(pages.keys)):
        if pages.edges[page] == pages.edges[page + 1]:
            continue
        if rare[page]:
            made += [(page, s.seq, s.text, s.x, s.y, s.width) for s in repairs.repair(page_width, page_height, pages.segments(page))]
        elif len(anchors := pages.anchors[page]) >= 2:
            _snap(pages, page, lines[heads[page] : heads[page + 1]] + [int(pages.edges[page + 1])], anchors, page_width)
    usual = np.flatnonzero(~rare[pages.of])
    names = ["doc_id", "seq", "text", "x", "y", "width"]
    take = lambda v: pa.array(v[usual])
    out = [pages.keys.take(take(pages.of)), take(pages.seq), pages.text.take(pa.array(usual)), take(pages.x), take(pages.y), take(pages.width)]
    if made:
        of, *values = zip(*made, strict=True)
        more = [pages.keys.take(pa.array(of, pa.int64())), *(pa.array(v, kind) for v, kind in zip(values, (pa.int64(), pa.string(), *[pa.float64()] * 3), strict=True))]
        out = [pa.concat_arrays([a, b]) for a, b in zip(out, more, strict=True)]
    return pa.RecordBatch.from_arrays(out, names)
