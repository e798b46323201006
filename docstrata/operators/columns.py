"""Columns of one page set right: cells snapped to shared left edges, texts that run over two columns cut, labels put below their headers.

Every function takes one page's segments, which bound it, and returns new ones; the given stay as they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import replace

from docstrata.operators.layout import CHECK_BOXES, Segment, repeated_anchors, visual_groups

#: Parts of the page's width in which a right column begins, least distance to it from the left, start of page numbers, right end of texts that may be cut.
BAND_FROM, BAND_TO, COLUMN_GAP, NUMBERS_FROM, CUT_TO = 0.35, 0.68, 0.22, 0.75, 0.4
#: Fixed values, in font sizes: reach of a column up and down, error of a cut, room before a column, distance of a header's centre.
REACH, CUT_ERROR, ROOM, CENTRE = 16.0, 12.0, 2.0, 1.5
#: Points between the tops of a header and its label; headers closer than this are one.
HEADER_FROM, HEADER_TO, HEADER_APART = 8.0, 25.0, 2.0
#: Parts of addresses, what may stand before a column's first word, shifted digits.
DOMAINS = ("www.", "://", ".com", ".org", ".net", ".ch", ".io")
START = re.compile(r"[-–—:;,(\[]*(?:[0-9A-Z]|www\.|http|.*://)", re.S)
SHIFTED = str.maketrans("MNOPQRSTUV", "0123456789")
LEADERS = re.compile(r"^(.*[^.\s])\s*?(\.[.\s]*?)\s+(\S+)\s*$", re.S)


def width_of(value: str, font: float) -> float:
    return len(value) * font * 0.45


def starts_column(value: str) -> bool:
    return bool(START.match(value))


def domain_like(value: str) -> bool:
    return any(d in value for d in DOMAINS)


def plausible(page_width: float, anchor: float) -> bool:
    return BAND_FROM * page_width <= anchor <= BAND_TO * page_width


class Edges:
    """A page's segments by bands of their left edges, each from its lowest, so that those near a place are found without looking at all."""

    BAND = 16.0

    def __init__(self, segments: list[Segment]):
        self.bands: dict[int, list[tuple[float, int, Segment]]] = {}
        for s in segments:
            self.bands.setdefault(int(s.x // self.BAND), []).append((s.y, id(s), s))
        for band in self.bands.values():
            band.sort(key=lambda row: row[:2])

    def near(self, anchor: float, reach: float, y: float = 0.0, rise: float = math.inf) -> Iterator[Segment]:
        """Those that may stand within reach of the anchor and within a rise of a height."""
        for band in range(int((anchor - reach) // self.BAND) - 1, int((anchor + reach) // self.BAND) + 2):
            rows = self.bands.get(band, ())
            for k in range(bisect_left(rows, (y - rise - 1,)), len(rows)):
                if rows[k][0] > y + rise + 1:
                    break
                yield rows[k][2]

    def move(self, s: Segment, x: float) -> None:
        row = (s.y, id(s))
        band = self.bands[int(s.x // self.BAND)]
        del band[bisect_left(band, row)]
        s.x = x
        insort(self.bands.setdefault(int(x // self.BAND), []), (*row, s), key=lambda r: r[:2])


def in_band(segments: list[Segment] | Edges, s: Segment, anchor: float) -> bool:
    """Whether segments start at the anchor both above and below s, near enough."""
    reach, least = max(s.font, 6.0), s.font * 0.5
    above = below = False
    for o in segments.near(anchor, reach, s.y, REACH * reach) if isinstance(segments, Edges) else segments:
        if abs(o.x - anchor) <= reach:
            above, below = above or least < o.y - s.y <= REACH * reach, below or least < s.y - o.y <= REACH * reach
            if above and below:
                return True
    return False


def occupied(line: list[Segment], anchor: float, moving: Segment) -> bool:
    """Whether another cell of the line stands at the anchor."""
    return any(o is not moving and abs(o.x - anchor) <= 1.5 * max(moving.font, 6.0) for o in line)


def snapped(page_width: float, segments: list[Segment], anchors: list[float]) -> list[Segment]:
    """On each line the first cell that begins like a column moves to the line's right column, if that column goes on above and below."""
    out = [replace(s) for s in segments]
    edges, anchors = Edges(out), [a for a in anchors if plausible(page_width, a)]
    for line in visual_groups(out):
        first = line[0]
        if len(line) < 2 or any(s.text.strip() in CHECK_BOXES for s in line[1:]):
            continue
        end = max(first.x, *(s.x + max(0.0, s.width) for s in line))
        anchor = next((a for a in anchors if plausible(page_width, a) and first.x + COLUMN_GAP * page_width < a < end), None)
        if anchor is None or not in_band(edges, first, anchor):
            continue
        font = max(first.font, 6.0)
        fits = (s for s in line[1:] if first.x + 4 * font < s.x < anchor - 1.5 * font and starts_column(s.text) and not occupied(line, anchor, s))
        moving = next(fits, None)
        if moving is not None:
            edges.move(moving, anchor)
    return out


def anchor_inside(page_width: float, anchors: list[float], s: Segment) -> float | None:
    """The least anchor of a right column that lies inside s."""
    return min((a for a in anchors if plausible(page_width, a) and s.x + COLUMN_GAP * page_width < a < s.x + s.width - ROOM * s.font), default=None)


def cut_at(s: Segment, anchor: float) -> tuple[str, str] | None:
    """The words of s in two: the right part begins like a column, the left part's width is nearest to the room before the anchor."""
    words = s.text.split()
    room = max(anchor - s.x - ROOM * s.font, s.font)
    cuts = ((abs(width_of(" ".join(words[:k]), s.font) - room), k) for k in range(1, len(words)) if starts_column(" ".join(words[k:])))
    best = min((c for c in cuts if c[0] <= CUT_ERROR * s.font), default=None)
    return None if best is None else (" ".join(words[: best[1]]), " ".join(words[best[1] :]))


def _anchor_of(page_width: float, anchors: list[float], segments: list[Segment] | Edges, s: Segment) -> float | None:
    inside = anchor_inside(page_width, anchors, s)
    if inside is not None or s.x > CUT_TO * page_width or len(s.text.split()) < 4:
        return inside
    right = (a for a in anchors if plausible(page_width, a) and a > s.x + COLUMN_GAP * page_width)
    return next((a for a in right if in_band(segments, s, a) and cut_at(s, a)), None)


def _spaced(value: str) -> str:
    """A capital word put apart from the acronym before it."""
    return re.sub(r"^([A-Z]{2,5})([A-Z][a-z])", r"\1 \2", value)


def cut_columns(page_width: float, segments: list[Segment], anchors: list[float]) -> list[Segment]:
    """Segments that run into the right column, cut there; an address goes up to the line of the left heading it belongs to."""
    out, added = [], []
    edges, anchors = Edges(segments), [a for a in anchors if plausible(page_width, a)]
    for s in segments:
        # A single word is not cut, wherever columns are.
        anchor = _anchor_of(page_width, anchors, edges, s) if len(s.text.split()) > 1 else None
        parts = cut_at(s, anchor) if anchor is not None and in_band(edges, s, anchor) else None
        if parts is None:
            out.append(s)
            continue
        left, right = map(_spaced, parts)
        y, line = s.y, max(s.font, 8.0)
        if domain_like(right) and not domain_like(parts[0]):
            y = min((o.y for o in segments if abs(o.x - s.x) <= line and 0 < o.y - s.y <= 2 * line and domain_like(o.text)), default=y)
        out.append(replace(s, text=left, width=min(width_of(left, s.font), max(anchor - s.x, s.font))))
        added.append(replace(s, text=right, x=anchor, y=y, width=width_of(right, s.font)))
    return out + added


def raised_domains(segments: list[Segment], anchors: list[float]) -> list[Segment]:
    """Addresses right of an anchor go up to the nearest line above, within two font sizes, whose left part alone holds an address; anchors come from the left, and the last one that a segment is right of decides."""
    out = [replace(s) for s in segments]
    # A line without an address neither moves nor takes one up. Its halves at an anchor are told by where its addresses and its first text stand.
    lines = [(line, [s.x for s in line if domain_like(s.text)]) for line in visual_groups(segments)]
    lines = [(line, xs) for line, xs in lines if xs]
    moved = {id(s): o for s, o in zip(segments, out, strict=True)}
    for k, (line, own) in enumerate(lines):
        y, font = line[0].y, max(line[0].font, 8.0)
        above = []
        for j in range(k - 1, -1, -1):
            other, xs = lines[j]
            if other[0].y - y > 2 * font:
                break
            if other[0].y > y:
                above.append((max(xs) + 1.5 * font, other[0].y))
        if not above:
            continue
        start, end = min((s.x + 1.5 * font for s in line if s.text.strip()), default=math.inf), min(own) + 1.5 * font
        raised = [(a, to) for a in anchors[1:] if start < a <= end and (to := next((h for last, h in above if last < a), None)) is not None]
        if raised:
            at = [a for a, _ in raised]
            for s in line:
                n = bisect_right(at, s.x + 1.5 * font)
                if n:
                    moved[id(s)].y = raised[n - 1][1]
    return out


def page_number(token: str) -> str | None:
    """The number of a table of contents' last word, its digits as they are or shifted to capitals."""
    bare = re.sub(r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "", token)
    return bare if re.fullmatch("[0-9]+", bare) else bare.translate(SHIFTED) if re.fullmatch("[M-V]+", bare) else None


def leader_parts(value: str) -> tuple[str, str, str] | None:
    """Label, leaders and page number of a line of a table of contents."""
    m = LEADERS.match(value) if "..." in value else None
    number = page_number(m[3]) if m else None
    return None if number is None else (m[1], m[2].strip(), number)


def _leader_segments(s: Segment, parts: tuple[str, str, str], anchor: float, most: float) -> list[Segment]:
    label, leaders, number = parts
    size = width_of(label, s.font)
    x = max(min(s.x + size + 0.5 * s.font, anchor - 6 * s.font), s.x + s.font)
    return [
        replace(s, text=label, width=min(size, max(x - s.x, s.font))),
        replace(s, text=leaders, x=x, width=min(max(anchor - x - s.font, s.font), most if most > 0 else s.font)),
        replace(s, text=number, x=anchor, width=width_of(number, s.font)),
    ]


def leader_numbers(page_width: float, segments: list[Segment], anchors: list[float]) -> list[Segment]:
    """Lines of a table of contents with their page numbers in the column of page numbers, if the page has one."""
    anchor = next((a for a in anchors if a > NUMBERS_FROM * page_width), None)
    if anchor is None:
        return segments
    alone: list[Segment] = []
    for s in segments:
        parts = leader_parts(s.text) if s.x < anchor - 4 * s.font else None
        alone += _leader_segments(s, parts, anchor, max(s.width, s.font)) if parts else [s]
    out = []
    for line in visual_groups(alone):
        font = max(8.0, *(s.font for s in line))
        parts = leader_parts(" ".join(s.text for s in line)) if len(line) >= 2 else None
        if parts is None or any(abs(s.x - anchor) <= 2 * font and page_number(s.text) for s in line):
            out += line
        else:
            out += _leader_segments(line[0], parts, anchor, page_width - line[0].x)
    return out


def sublabels(page_height: float, segments: list[Segment]) -> list[Segment]:
    """A label of two words below exactly two headers becomes a word centred below each."""
    out, added = [], []
    tops = [page_height - s.y - s.font for s in segments]
    for s, top in zip(segments, tops, strict=True):
        words = s.text.split()
        headers: list[Segment] = []
        if len(words) == 2:
            above = [o for o, t in zip(segments, tops, strict=True) if HEADER_FROM <= top - t <= HEADER_TO]
            for o in sorted(above, key=lambda o: o.x):
                reach, centre = CENTRE * max(s.font, o.font), o.x + max(0.0, o.width) / 2
                if s.x - reach <= centre <= s.x + s.width + reach and not (headers and abs(o.x - headers[-1].x) <= HEADER_APART):
                    headers.append(o)
        if len(headers) != 2:
            out.append(s)
            continue
        sizes = [width_of(w, s.font) for w in words]
        made = [replace(s, text=w, width=n, x=h.x + max(0.0, h.width) / 2 - n / 2) for w, n, h in zip(words, sizes, headers, strict=True)]
        out.append(made[0])
        added.append(made[1])
    return out + added


def repair(page_width: float, page_height: float, segments: list[Segment]) -> list[Segment]:
    """All rules in their order; without two repeated left edges only labels are set right."""
    anchors = repeated_anchors(segments)
    if len(anchors) >= 2:
        segments = snapped(page_width, segments, anchors)
        segments = leader_numbers(page_width, segments, anchors)
        segments = cut_columns(page_width, segments, anchors)
        segments = raised_domains(segments, anchors)
    return sublabels(page_height, segments)
