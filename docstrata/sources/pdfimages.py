"""Images of PDF pages: where they are drawn, their bytes as data URIs, and which of them belong to the text."""

from __future__ import annotations

import base64
from dataclasses import dataclass

from docstrata.operators import images, layout
from docstrata.operators.model import Block, block_text

#: Filters whose data are image files of their own.
NATIVE = {"DCTDecode": "image/jpeg", "DCT": "image/jpeg", "JPXDecode": "image/jp2", "JPX": "image/jp2"}
#: Colour spaces by their names, with the number of components.
SPACES = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}
DEVICE = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}
#: Least sides in points, least share of the page's area or width, height of the header, share that counts there too.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_AREA, LEAST_SPAN, HEADER, HEADER_AREA = 24.0, 18.0, 0.01, 0.22, 72.0, 0.04
#: Fixed value: an image shows if this much of each side, in points, is inside the clip.
VISIBLE = 0.5

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Placement:
    """An image object and the box (left, bottom, width, height) it is drawn in."""

    ref: object
    x: float
    y: float
    width: float
    height: float


def bounding(points: list[tuple[float, float]]) -> Box | None:
    """Left, bottom, right and top of points; None without any."""
    return (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)) if points else None


def intersect(a: Box | None, b: Box) -> Box:
    """What two boxes share; None is the whole plane, an empty box has its right side left of its left one."""
    return b if a is None else (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))


def placement(ref, ctm: tuple, clip: Box | None) -> Placement | None:
    """The unit square under a matrix, if enough of it is inside the clip."""
    a, b, c, d, e, f = ctm
    box = bounding([(x * a + y * c + e, x * b + y * d + f) for x in (0, 1) for y in (0, 1)])
    seen = intersect(clip, box)
    if seen[2] - seen[0] < VISIBLE or seen[3] - seen[1] < VISIBLE:
        return None
    return Placement(ref, box[0], box[1], box[2] - box[0], box[3] - box[1])


def _whole(objects, holder: dict, key: str, default: int | None = None) -> int:
    value = objects.get(holder.get(key, default))
    if type(value) is not int or value < 1:
        raise ValueError(f"{key} is {value}")
    return value


def _space(objects, value) -> tuple[int, bytes | None]:
    """Components of a colour space and its palette as RGB; an unknown one is an error, a missing one has 0."""
    value = objects.get(value)
    if value is None:
        return 0, None
    if isinstance(value, str) and value in SPACES:
        return SPACES[value], None
    kind = objects.get(value[0]) if isinstance(value, list) and value else value
    if kind == "ICCBased" and len(value) > 1 and objects.dict(value[1]).get("N") in DEVICE:
        return objects.dict(value[1])["N"], None
    if kind in SPACES:
        return SPACES[kind], None
    if kind in ("Indexed", "I") and len(value) == 4:
        n, nested = _space(objects, value[1])
        lookup = objects.get(value[3])
        lookup = lookup if isinstance(lookup, bytes) else objects.stream(value[3])
        if n and nested is None and lookup:
            table = images.samples(lookup, 8, len(lookup) // n, 1, n)
            return 1, (images.cmyk_to_rgb(table) if n == 4 else table if n == 3 else table.repeat(3, axis=2)).tobytes()
    raise ValueError(f"colour space {kind} is not read")


def _samples(objects, ref) -> tuple[dict, bytes, int, int, int]:
    holder, data = objects.dict(ref), objects.stream(ref)
    if data is None:
        raise ValueError("its stream has a filter that is not read")
    return holder, data, _whole(objects, holder, "Width"), _whole(objects, holder, "Height"), 1 if holder.get("ImageMask") is True else _whole(objects, holder, "BitsPerComponent", 8)


def _enough(data: bytes, width: int, height: int, bits: int, n: int) -> None:
    if bits not in (1, 2, 4, 8, 16):
        raise ValueError(f"{bits} bits a component")
    if len(data) < (width * n * bits + 7) // 8 * height:
        raise ValueError(f"{len(data)} bytes are too few")


def data_uri(objects, ref) -> str:
    """An image object as a data URI: JPEG and JPEG 2000 as they are (without their soft mask), others as PNG."""
    native = objects.native(ref)
    if native:
        kind, data = native
        return f"data:{NATIVE[kind]};base64,{base64.b64encode(data).decode()}"
    holder, data, width, height, bits = _samples(objects, ref)
    n, palette = _space(objects, holder.get("ColorSpace"))
    if not n:
        n = next((k for k in (1, 3) if holder.get("ImageMask") is not True and len(data) == width * height * k), 0)
        if not n:
            raise ValueError("no colour space is given")
    _enough(data, width, height, bits, n)
    mask = None
    if "SMask" in holder:
        own, cover, *size = _samples(objects, holder["SMask"])
        if _space(objects, own.get("ColorSpace"))[0] == 1:
            _enough(cover, *size, 1)
            mask = (cover, *size)
    made = images.raw_image(data, width, height, bits, DEVICE[n] if palette is None else "Indexed", palette or b"", mask)
    return f"data:image/png;base64,{base64.b64encode(made).decode()}"


def uris(objects, placements: list[Placement], page: int) -> tuple[dict[object, str], list[str]]:
    """Data URI of each image object once, however often it is drawn, and a warning for each that is not read."""
    found, warnings = {}, []
    for ref in dict.fromkeys(p.ref for p in placements):
        try:
            found[ref] = data_uri(objects, ref)
        except ValueError as e:
            warnings.append(f"page {page}: an image is left out: {e}")
    return found, warnings


def content_image(p: Placement, page_width: float, page_height: float) -> bool:
    """An image that is part of the text: neither small nor a mark in the header."""
    page, area = max(page_width, 1.0) * max(page_height, 1.0), p.width * p.height
    if p.width < LEAST_WIDTH or p.height < LEAST_HEIGHT or area < page * LEAST_AREA and p.width < page_width * LEAST_SPAN:
        return False
    return max(0.0, page_height - p.y - p.height) >= HEADER or area >= page * HEADER_AREA


def with_images(blocks: list[Block], lines: list[layout.Line], placed: list[Placement], found: dict[object, str], page: int, width: float, height: float) -> list[Block]:
    """Blocks with the page's content images from the top, each after the block that holds the last line that stands above it.

    Without such a line an image comes first, without such a block last; images of one place keep their order.
    """
    flat = [" ".join(block_text(b).split()) for b in blocks]
    after: list[list[Block]] = [[] for _ in range(len(blocks) + 1)]
    for p in sorted((p for p in placed if p.ref in found and content_image(p, width, height)), key=lambda p: max(0.0, height - p.y - p.height)):
        top = max(0.0, height - p.y - p.height)
        above = [(max(0.0, height - line.y - line.font), k) for k, line in enumerate(lines)]
        above = [(t, k) for t, k in above if t + lines[k].font * 0.5 <= top]
        line = " ".join(lines[max(above)[1]].text.split()) if above else None
        place = 0 if line is None else next((k + 1 for k, t in enumerate(flat) if line and line in t), len(blocks))
        shown = {"src": found[p.ref], "alt": f"PDF image on page {page}", "width": str(max(1, int(p.width + 0.5))), "height": str(max(1, int(p.height + 0.5)))}
        after[place].append(Block("image", [("image", "", shown)], attributes={"page": str(page)}))
    out = list(after[0])
    for b, following in zip(blocks, after[1:], strict=True):
        out += [b, *following]
    return out
