"""Positioned text to lines, lines to blocks: ordered folds over one page.

The folds are order-dependent, so segments carry ``seq`` and every sort ends in
it. A page's size bounds all of them.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import Counter
from dataclasses import dataclass, field

from docstrata.operators.model import Block, Inline, plain

#: Distances in points, or in parts of a font size.
SAME_LINE, SAME_TURN, DUPLICATE = 3.0, 15.0, 1.0
SPACE_GAP, CELL_GAP, LEAST_CELL_GAP, ROW_GAP = 0.25, 1.75, 18.0, 2.5
HEADING, PARAGRAPH_GAP, INDENT = 1.25, 1.8, 2.0
CLUSTER = 4.0
ANCHOR, ANCHOR_SEGMENTS = 3.0, 3
#: Left edges of which all means are asked, one after the other.
FEW = 32
#: Signs of check boxes.
CHECK_BOXES = ("□", "☐", "☑", "☒", "✓", "✔", "✕", "✗")
SAME_VISUAL_LINE = 0.35
TABLE_WINDOW, LEFT_OF_TABLE, CONTINUATION, COLUMN_STEP = 4, 6.0, 12.0, 24.0


@dataclass
class Segment:
    text: str
    x: float
    y: float
    font: float
    width: float
    turn: float = 0.0
    role: str | None = None
    seq: int = 0
    bold: bool = False


@dataclass
class Line:
    text: str
    x: float
    y: float
    font: float
    width: float
    turn: float
    role: str | None
    cells: list[Segment]
    #: Left edges of its cells, once asked.
    starts: list[float] | None = field(default=None, compare=False, repr=False)


def degrees(a: float, b: float) -> float:
    """Direction of (a, b) in (-180, 180]."""
    turn = math.degrees(math.atan2(b, a))
    return 180.0 if turn == -180.0 else turn


def deduplicate(segments: list[Segment]) -> list[Segment]:
    """Without segments that repeat a kept one's text within a point."""
    kept: list[Segment] = []
    near: dict[tuple[str, int, int], list[Segment]] = {}
    for s in segments:
        gx, gy = int(s.x // DUPLICATE), int(s.y // DUPLICATE)
        around = (k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in near.get((s.text, gx + i, gy + j), ()))
        if not any(abs(k.x - s.x) <= DUPLICATE and abs(k.y - s.y) <= DUPLICATE for k in around):
            kept.append(s)
            near.setdefault((s.text, gx, gy), []).append(s)
    return kept


def joined(cells: list[Segment]) -> str:
    out, end = "", None
    for s in cells:
        gap = s.x - end if end is not None else 0.0
        if out and gap >= max(2.0, SPACE_GAP * s.font) and not out.endswith(" ") and not s.text.startswith(" "):
            out += " "
        out += s.text
        end = s.x + s.width
    return " ".join(out.split())


def split_cells(cells: list[Segment]) -> list[list[Segment]]:
    """Runs of segments without a wide gap."""
    out: list[list[Segment]] = []
    for s in cells:
        gap = max(LEAST_CELL_GAP, CELL_GAP * max(8.0, cells[0].font))
        if out and s.x - end < gap:
            out[-1].append(s)
            end = max(end, s.x + s.width)
        else:
            out.append([s])
            end = s.x + s.width
    return out


def repeated_anchors(segments: list[Segment]) -> list[float]:
    """Left edges that three segments or more share: each joins the first mean within 3 points, in the segments' order."""
    return repeated_edges([s.x for s in segments if s.width > 0 and (bare := s.text.strip()) and bare not in CHECK_BOXES])


def repeated_edges(xs: list[float]) -> list[float]:
    """The same of left edges that count."""
    means: list[float] = []
    counts: list[int] = []
    if len(xs) <= FEW:
        for x in xs:
            for k, mean in enumerate(means):
                if -ANCHOR <= mean - x <= ANCHOR:
                    n = counts[k]
                    means[k] = (mean * n + x) / (n + 1)
                    counts[k] = n + 1
                    break
            else:
                means.append(x)
                counts.append(1)
        return sorted(m for m, n in zip(means, counts, strict=True) if n >= ANCHOR_SEGMENTS)
    # Each cell, wider than the distance, has the numbers of the means in it and beside it, in their order, so that the first that is near is the one.
    size, cells, cell_of = ANCHOR + 1, {}, []

    for x in xs:
        cell = x // size
        for k in cells.get(cell, ()):
            mean = means[k]
            if -ANCHOR <= mean - x <= ANCHOR:
                n = counts[k]
                means[k] = mean = (mean * n + x) / (n + 1)
                counts[k] = n + 1
                if mean // size != cell_of[k]:
                    for c in (cell_of[k] - 1, cell_of[k], cell_of[k] + 1):
                        cells[c].remove(k)
                    cell_of[k] = cell = mean // size
                    for c in (cell - 1, cell, cell + 1):
                        insort(cells.setdefault(c, []), k)
                break
        else:
            means.append(x)
            counts.append(1)
            cell_of.append(cell)
            for c in (cell - 1, cell, cell + 1):
                if c in cells:
                    cells[c].append(len(means) - 1)
                else:
                    cells[c] = [len(means) - 1]
    return sorted(m for m, n in zip(means, counts, strict=True) if n >= ANCHOR_SEGMENTS)


def visual_groups(segments: list[Segment]) -> list[list[Segment]]:
    """Runs of segments from the top that stand within 0.35 of the larger font of the run's first one, turned alike."""
    out: list[list[Segment]] = []
    for s in sorted(segments, key=lambda s: (-s.y, s.x, s.seq)):
        first = out[-1][0] if out else None
        if first is not None and abs(first.y - s.y) <= SAME_VISUAL_LINE * max(first.font, s.font) and abs(first.turn - s.turn) < 0.5:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def cell_starts(line: Line) -> list[float]:
    if line.starts is None:
        line.starts = [cell[0].x for cell in split_cells(line.cells)]
    return line.starts


def common_columns(lines: list[Line]) -> list[float]:
    """Left edges of cells that half of the lines, two at least, share within 4 points of the least."""
    clusters: list[tuple[float, set[int]]] = []
    for x, k in sorted((x, k) for k, line in enumerate(lines) for x in cell_starts(line)):
        if clusters and x - clusters[-1][0] <= CLUSTER:
            clusters[-1][1].add(k)
        else:
            clusters.append((x, {k}))
    return [x for x, seen in clusters if len(seen) >= max(2, -(-len(lines) // 2))]


def text_lines(segments: list[Segment]) -> list[Line]:
    """Lines from the top: a segment joins the first line within 3 points and about its direction."""
    groups: list[list[Segment]] = []
    for s in deduplicate(sorted(segments, key=lambda s: (-s.y, s.x, s.seq))):
        # Lines are met from the top, so only the last ones can be near; the first of them that fits is taken.
        fits, k = None, len(groups) - 1
        while k >= 0 and groups[k][0].y - s.y <= SAME_LINE:
            if abs((groups[k][0].turn - s.turn + 180) % 360 - 180) <= SAME_TURN:
                fits = groups[k]
            k -= 1
        if fits is None:
            groups.append([s])
        else:
            fits.append(s)
    out = []
    for g in groups:
        cells = sorted(g, key=lambda s: (s.x, s.seq))
        value = joined(cells)
        if value:
            left = min(c.x for c in cells)
            out.append(Line(value, left, g[0].y, max(c.font for c in cells), max(c.x + c.width for c in cells) - left, g[0].turn, next((c.role for c in cells if c.role), None), cells))
    return out


def anchors(xs: list[float], reach: float = CLUSTER) -> list[list[float]]:
    """Clusters of sorted values, each within ``reach`` of its first."""
    out: list[list[float]] = []
    for x in sorted(xs):
        if out and x - out[-1][0] <= reach:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def median_font(lines: list[Line]) -> float:
    sizes = sorted(x.font for x in lines)
    return max(1.0, sizes[(len(sizes) - 1) // 2]) if sizes else 12.0


MARKER = re.compile(r"^(?:([-*+•o]) |([0-9]{1,9})[.)] )(.*)$")


def is_heading(lines: list[Line], i: int, median: float) -> bool:
    line = lines[i]
    if len(line.text.encode()) > 120 or line.text.endswith(".") or "  " in line.text or line.font < HEADING * median:
        return False
    above = i == 0 or lines[i - 1].y - line.y >= 1.5 * line.font
    below = i + 1 == len(lines) or line.y - lines[i + 1].y >= 1.5 * lines[i + 1].font
    return above and below or not re.search(r"[,;:]$", line.text) and len(line.text.split()) <= 12


def heading_level(role: str | None, ratio: float) -> int:
    if role and re.fullmatch(r"H[1-6]", role):
        return int(role[1])
    return 1 if role in ("H", "Title") or ratio >= 1.6 else 2


def bullet_prose(value: str) -> bool:
    return bool(re.match(r"\s*[•o] ", value)) and sum(sum(c.isalpha() for c in w) >= 2 for w in value.split()) >= 4 and any(c.islower() for c in value)


def _nearest(columns: list[float], x: float) -> int:
    return min(range(len(columns)), key=lambda n: (abs(columns[n] - x), n))


def _continued(columns: list[float], row: list[str], line: Line) -> int | None:
    """The cell that a line without cells of its own goes on with: the nearest column at or left of it, else the last one if the line begins in mid-sentence."""
    near = [n for n, x in enumerate(columns) if line.x + CONTINUATION >= x]
    at = min(near, key=lambda n: (abs(columns[n] - line.x), n)) if near else 0
    if at > 0:
        return at
    start = line.text.lstrip()
    if not start or ":" in start or re.match("[0-9A-Z]", start) or len(row) < 2:
        return None
    return len(row) - 1


def _table(lines: list[Line], i: int) -> tuple[Block | None, int]:
    """A table that starts at line i: two or more lines that fill the columns which the next lines share, with wrapped cells."""
    columns = common_columns(lines[i : i + TABLE_WINDOW]) if len(lines) - i >= 2 else []
    if len(columns) < 2 or bullet_prose(lines[i].text):
        return None, i
    rows: list[list[str]] = []
    end = i
    while end < len(lines):
        line = lines[end]
        drop = lines[end - 1].y - line.y if end > i else 0.0
        limit = ROW_GAP * max(8.0, line.font, lines[end - 1].font if end > i else 0.0)
        if drop > limit or line.cells[0].x + LEFT_OF_TABLE < columns[0]:
            break
        values: list[list[str]] = [[] for _ in columns]
        for segment in line.cells:
            values[_nearest(columns, segment.x)].append(segment.text)
        texts = [" ".join(" ".join(v).split()) for v in values]
        if texts[0] and sum(bool(t) for t in texts) >= 2:
            rows.append(texts)
        elif rows and drop > 0 and not is_tabular(line) and not MARKER.match(line.text) and (at := _continued(columns, rows[-1], line)) is not None:
            rows[-1][at] = f"{rows[-1][at]} {line.text}".strip()
        else:
            break
        end += 1
    if len(rows) < 2:
        return None, i
    made = [[([("text", v, {})] if v else [], k == 0, "right" if k and re.fullmatch(r"[0-9.,%+\- ]+", v) else "", 1, 1) for v in row] for k, row in enumerate(rows)]
    return Block("table", rows=made), end


def is_tabular(line: Line) -> bool:
    """Two cells or more, each 24 points right of the one before."""
    cells = split_cells(line.cells)
    return not bullet_prose(line.text) and len(cells) >= 2 and all(b[0].x - a[0].x >= COLUMN_STEP for a, b in zip(cells, cells[1:], strict=False))


def page_blocks(segments: list[Segment]) -> list[Block]:
    """Blocks of a page in reading order: tables, headings, lists and paragraphs; artifacts are left out."""
    lines = text_lines([s for s in segments if s.role != "Artifact"])
    median, out, i = median_font(lines), [], 0
    while i < len(lines):
        line = lines[i]
        table, end = _table(lines, i)
        if table:
            out.append(table)
            i = end
        elif line.role and re.fullmatch(r"H[1-6]?|Title", line.role) or abs(line.turn) < 30 and is_heading(lines, i, median):
            out.append(Block("heading", [("text", line.text, {})], heading_level(line.role, line.font / median)))
            i += 1
        elif m := MARKER.match(line.text):
            ordered = m[1] is None
            made = Block("list", attributes={"ordered": str(ordered).lower()} | ({"start": m[2]} if ordered else {}))
            while i < len(lines) and (n := MARKER.match(lines[i].text)) and (n[1] is None) == ordered:
                made.children.append(Block("item", [("text", n[3], {})]))
                i += 1
            out.append(made)
        else:
            parts = [line]
            i += 1
            while i < len(lines):
                gap = parts[-1].y - lines[i].y
                fits = 0 < gap <= PARAGRAPH_GAP * parts[-1].font and abs(lines[i].x - parts[-1].x) <= INDENT * parts[-1].font and lines[i].role == line.role
                if not fits or MARKER.match(lines[i].text) or is_heading(lines, i, median) or _table(lines, i)[0]:
                    break
                parts.append(lines[i])
                i += 1
            value = " ".join(x.text for x in parts)
            inlines: list[Inline] = [("text", value, {})]
            if all(c.bold for x in parts for c in x.cells):
                inlines = [("strong", inlines, {})]
            out.append(Block("paragraph", inlines))
    return collapse_code(out)


def collapse_code(blocks: list[Block]) -> list[Block]:
    """Three or more paragraphs in a row that look like XML become one code block."""
    out: list[Block] = []
    run: list[Block] = []

    def flush() -> None:
        if len(run) >= 3:
            out.append(Block("code", [("text", "\n".join(plain(b.inlines) for b in run), {})], attributes={"language": "xml"}))
        else:
            out.extend(run)
        run.clear()

    for b in blocks:
        if b.kind == "paragraph" and re.match(r"\s*(?:<|xmlns|xsi:|schemaLocation|targetNamespace)", plain(b.inlines)):
            run.append(b)
        else:
            flush()
            out.append(b)
    flush()
    return out


def furniture_key(value: str) -> str | None:
    words = value.split()
    if not words or len(value.strip().encode()) > 100:
        return None

    def counter(w: str) -> bool:
        m = re.fullmatch(r"([0-9]{1,9})(?:/([0-9]{1,9}))?", w)
        return bool(m) and (m[2] is None or 1 <= int(m[1]) <= int(m[2])) or bool(re.fullmatch("[0-9]+", w))

    return " ".join("#" if counter(w) else w for w in words)


def without_furniture(pages: list[list[Block]]) -> list[list[Block]]:
    """Pages without short paragraphs that repeat, and without page numbers."""
    counts = Counter(k for blocks in pages for b in blocks if b.kind in ("paragraph", "heading") and (k := furniture_key(plain(b.inlines))))
    least = 2 if len(pages) <= 1 else max(2, len(pages) // 3)

    def furniture(b: Block) -> bool:
        if b.kind not in ("paragraph", "heading"):
            return False
        value = plain(b.inlines)
        key = furniture_key(value)
        if key is not None and counts[key] >= least and len(pages) > 1:
            return True
        last = re.search(r"(?:^|\s)([0-9]{1,9})/([0-9]{1,9})$", value)
        return bool(re.match(r"^\s*[0-9]*\s* P a g e\s*$", value) or re.match(r"^[–-]\s*[0-9]{1,4}\s*[–-]$", value.strip()) or key is not None and last and 1 <= int(last[1]) <= int(last[2]))

    return [[b for b in blocks if not furniture(b)] for blocks in pages]


def attach_links(blocks: list[Block], uris: list[str]) -> list[str]:
    """Each address, longest first, becomes a link in the first block that shows it; warnings for those that none shows."""
    warnings = []
    for uri in sorted(uris, key=lambda u: (-len(u), u)):
        shapes = sorted({uri, re.sub("^https?://", "", uri), re.sub("^https?://", "", uri).rstrip("/")} - {""}, key=lambda s: (-len(s), s))
        if not any(_attach(b, uri, shapes) for b in blocks):
            warnings.append(f"link {uri} has no visible text")
    return warnings


def _attach(block: Block, uri: str, shapes: list[str]) -> bool:
    for k, (kind, value, _) in enumerate(block.inlines):
        if kind == "text":
            for shape in shapes:
                at = value.find(shape)
                if at >= 0:
                    block.inlines[k : k + 1] = [x for x in (("text", value[:at], {}), ("link", [("text", shape, {})], {"href": uri}), ("text", value[at + len(shape) :], {})) if x[0] == "link" or x[1]]
                    return True
    return any(_attach(c, uri, shapes) for c in block.children)
