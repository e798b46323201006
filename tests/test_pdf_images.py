"""Images of PDF pages: placement, clips, nested forms, encodings and their place among the blocks."""

import base64
import re
import struct
import zlib

import numpy as np
import pytest

from docstrata.operators import layout
from docstrata.operators.model import Block, block_text, document_html
from docstrata.sources import pdf, pdfimages


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def made(content, *more):
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (4, stream(content)), *more]
    objects.append((3, b"<< /Type /Page /MediaBox [0 0 600 800] /Contents 4 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 >> >> /XObject << /A 10 0 R /B 11 0 R >> >> >>"))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects)


def image(number, data, head=b"/ColorSpace /DeviceRGB", width=2, height=1, bits=8):
    return number, stream(data, b"/Subtype /Image /Width %d /Height %d /BitsPerComponent %d %s" % (width, height, bits, head))


RGB = bytes([255, 0, 0, 0, 0, 255])


def boxes(data):
    return [(round(p.x, 2), round(p.y, 2), round(p.width, 2), round(p.height, 2)) for page in pdf.read_pages(data)[1] for p in page.images]


def pixels(uri):
    raw = base64.b64decode(uri.split(",")[1])
    width, height, _, kind = struct.unpack(">IIBB", raw[16:26])
    n = {0: 1, 2: 3, 6: 4}[kind]
    size = int.from_bytes(raw[33:37], "big")
    return np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(height, 1 + width * n)[:, 1:].reshape(height, width, n).tolist()


def only(data):
    objects, pages, _ = pdf.read_pages(data)
    found, warnings = pdfimages.uris(objects, pages[0].images, 1)
    return list(found.values()), warnings


def test_placements():
    assert boxes(made(b"q 100 0 0 50 20 30 cm /A Do Q q 0 40 -60 0 200 100 cm /A Do Q", image(10, RGB))) == [(20, 30, 100, 50), (140, 100, 60, 40)]
    # A form's matrix and the matrix at its call both hold, and a form inside itself is drawn once.
    form = (11, stream(b"10 0 0 10 1 2 cm /A Do /B Do", b"/Subtype /Form /Matrix [2 0 0 2 5 5] /Resources << /XObject << /A 10 0 R /B 11 0 R >> >>"))
    assert boxes(made(b"1 0 0 1 100 100 cm /B Do", image(10, RGB), form)) == [(107, 109, 20, 20)]


def test_clips():
    inside = b"0 0 50 50 re W n 100 0 0 100 %d 0 cm /A Do"
    assert boxes(made(inside % 40, image(10, RGB))) == [(40, 0, 100, 100)]
    assert boxes(made(inside % 60, image(10, RGB))) == []
    assert boxes(made(b"q " + inside % 60 + b" Q 5 0 0 5 0 0 cm /A Do", image(10, RGB))) == [(0, 0, 5, 5)]
    # Two clips leave what both hold; one of a path works by its bounds, into forms too.
    assert boxes(made(b"0 0 50 50 re W n 60 0 9 9 re W n 90 0 0 90 0 0 cm /A Do", image(10, RGB))) == []
    form = (11, stream(b"10 0 0 10 80 0 cm /A Do", b"/Subtype /Form /Resources << /XObject << /A 10 0 R >> >>"))
    assert boxes(made(b"0 0 m 70 0 l 70 70 l h W n /B Do", image(10, RGB), form)) == []
    assert boxes(made(b"0.4 0 0 90 0 0 cm /A Do", image(10, RGB))) == []


@pytest.mark.parametrize(
    ("data", "head", "bits", "want"),
    [
        (RGB, b"/ColorSpace /DeviceRGB", 8, [[[255, 0, 0], [0, 0, 255]]]),
        (b"\x80", b"/ColorSpace /DeviceGray", 1, [[[255], [0]]]),
        (b"\x05\x09", b"", 8, [[[5], [9]]]),
        (RGB, b"/ColorSpace [/ICCBased 12 0 R]", 8, [[[255, 0, 0], [0, 0, 255]]]),
        (b"\x10", b"/ColorSpace [/Indexed /DeviceRGB 1 <010203040506>]", 4, [[[4, 5, 6], [1, 2, 3]]]),
        (b"\x01\x00", b"/ColorSpace [/Indexed /DeviceGray 1 13 0 R]", 8, [[[9, 9, 9], [7, 7, 7]]]),
        (bytes([255, 0, 0, 0, 0, 0, 0, 255]), b"/ColorSpace /DeviceCMYK", 8, [[[0, 255, 255], [0, 0, 0]]]),
        (zlib.compress(b"\x01\x05\x01"), b"/ColorSpace /DeviceGray /Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 2 >>", 8, [[[5], [6]]]),
        (RGB, b"/ColorSpace /DeviceRGB /SMask 14 0 R", 8, [[[255, 0, 0, 8], [0, 0, 255, 16]]]),
    ],
)
def test_encodings(data, head, bits, want):
    more = (12, stream(b"", b"/N 3")), (13, stream(b"\x07\x09")), image(14, b"\x08\x10", b"/ColorSpace /DeviceGray")
    found, warnings = only(made(b"9 0 0 9 0 0 cm /A Do /A Do", image(10, data, head, bits=bits), *more))
    assert [pixels(u) for u in found] == [want] and not warnings


def test_native_and_broken():
    found, _ = only(made(b"9 0 0 9 0 0 cm /A Do", image(10, b"\xff\xd8jpeg", b"/Filter [/DCTDecode]")))
    assert found == ["data:image/jpeg;base64," + base64.b64encode(b"\xff\xd8jpeg").decode()]
    packed = zlib.compress(b"\xff\xd8jpeg")
    assert only(made(b"9 0 0 9 0 0 cm /A Do", image(10, packed, b"/Filter [/FlateDecode /DCTDecode]")))[0] == found
    for data, head in ((b"x", b"/ColorSpace /DeviceRGB"), (RGB, b"/ColorSpace /Lab"), (RGB, b"/Filter /JBIG2Decode"), (RGB[:5], b"")):
        found, warnings = only(made(b"9 0 0 9 0 0 cm /A Do /A Do", image(10, data, head)))
        assert not found and len(warnings) == 1
    assert not only(made(b"9 0 0 9 0 0 cm /A Do", image(10, RGB, width=10**9, height=10**9)))[0]


def test_place_among_blocks():
    text = b"BT /F1 12 Tf 60 700 Td (Above the picture) Tj 0 -300 Td (Below the picture) Tj ET "
    content = text + b"q 200 0 0 150 60 500 cm /A Do Q q 200 0 0 100 60 200 cm /B Do Q q 20 0 0 20 60 600 cm /A Do Q"
    doc = pdf.parse(made(content, image(10, RGB), image(11, b"\x01\x02", b"/ColorSpace /DeviceGray")))
    assert [b.kind if b.kind == "image" else block_text(b) for b in doc.blocks] == ["Above the picture", "image", "Below the picture", "image"]
    shown = re.findall(r'alt="([^"]*)" width="(\d+)" height="(\d+)"', document_html(doc))
    assert shown == [("PDF image on page 1", "200", "150"), ("PDF image on page 1", "200", "100")]
    assert all(b.kind != "image" for b in pdf.parse(made(content, image(10, RGB)), include_images=False).blocks)


def test_content_images():
    def kept(x, y, w, h):
        return pdfimages.content_image(pdfimages.Placement(1, x, y, w, h), 600.0, 800.0)

    assert kept(0, 300, 200, 150) and kept(0, 300, 140, 20) and kept(0, 728, 140, 0.1 + 18) is False
    # too small a side; too small an area and span; a mark in the header; a wide banner there
    assert not kept(0, 300, 23, 300) and not kept(0, 300, 300, 17) and not kept(0, 300, 60, 60) and not kept(0, 740, 150, 40) and kept(0, 740, 500, 50)
    lines = [layout.Line("kept", 0, 700, 10, 9, 0, None, []), layout.Line("gone", 0, 600, 10, 9, 0, None, [])]
    place = pdfimages.Placement(1, 0, 100, 300, 300)
    blocks = [Block("paragraph", [("text", "kept", {})]), Block("paragraph", [("text", "last", {})])]
    # The line above stands in no block: the image is last. No line above: it is first.
    assert [b.kind for b in pdfimages.with_images(blocks, lines, [place], {1: "u"}, 1, 600, 800)] == ["paragraph", "paragraph", "image"]
    assert [b.kind for b in pdfimages.with_images(blocks, [], [place], {1: "u"}, 1, 600, 800)] == ["image", "paragraph", "paragraph"]
    assert pdfimages.with_images([], [], [], {}, 1, 600, 800) == []
