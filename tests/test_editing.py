"""Editing transforms, image encoding and the positioned page layer."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from docstrata.operators import editor, images, model, visual
from docstrata.sources import markdown


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_editor(spark):
    c = editor.styled(F.lit("abcd"))
    assert one(spark, editor.plain(editor.insert(c, F.lit(2), editor.styled(F.lit("XY"))))) == "abXYcd"
    assert one(spark, editor.plain(editor.delete(c, F.lit(0)))) == "bcd" and one(spark, editor.plain(editor.delete(c, F.lit(9)))) == "abcd"
    bold = editor.toggle(c, F.lit(1), F.lit(3), editor.BOLD)
    assert one(spark, editor.runs_html(editor.runs(bold))) == "a<strong>bc</strong>d"
    assert one(spark, editor.runs_html(editor.runs(editor.toggle(bold, F.lit(1), F.lit(2), editor.BOLD)))) == "ab<strong>c</strong>d"
    assert one(spark, editor.runs(editor.styled(F.lit("")))) == []
    left, right = editor.split(c, F.lit(99))
    assert one(spark, F.struct(editor.plain(left), editor.plain(right))) == ("abcd", "")


def test_editor_tables(spark):
    t = one(spark, editor.add_column(editor.add_row(editor.new_table(F.lit(2), F.lit(99)), F.lit(1)), F.lit(0)))
    assert len(t) == 3 and {len(r) for r in t} == {13}


def test_saved_document():
    doc = markdown.parse("# T\n\n- [x] a *b*\n\n| a | b |\n|--|--|\n| 1 | 2 |")
    back = editor.load(editor.save(doc))
    assert model.document_html(back) == model.document_html(doc)
    assert editor.load(None) is None and editor.load("{}") is None and editor.load("[") is None


def unpack(png):
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(png):
        n, kind = struct.unpack(">I", png[at : at + 4])[0], png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + data)
        parts[kind] = data
        at += 12 + n
    w, h, _, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    n = {0: 1, 2: 3, 6: 4}[colour]
    return np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + w * n)[:, 1:].reshape(h, w, n)


def test_images():
    assert unpack(images.raw_image(bytes(range(12)), 2, 2, 8, "DeviceRGB")).tolist() == np.arange(12).reshape(2, 2, 3).tolist()
    assert unpack(images.raw_image(b"\xa0", 4, 1, 1, "DeviceGray"))[0, :, 0].tolist() == [255, 0, 255, 0]
    assert unpack(images.raw_image(b"\x01\x20", 3, 1, 4, "Indexed", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])))[0].tolist() == [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    assert unpack(images.raw_image(b"\0\0\0\xff", 1, 1, 8, "DeviceCMYK"))[0, 0].tolist() == [0, 0, 0]
    masked = unpack(images.raw_image(b"\x05\x06", 2, 1, 8, "DeviceGray", mask=(b"\x80", 1, 1, 8)))
    assert masked[0].tolist() == [[5, 5, 5, 128], [6, 6, 6, 128]]
    assert images.raw_image(b"", 2, 2, 8, "DeviceGray") and images.raw_image(b"", 1, 1, 8, "Lab") is None


def test_visual_page(spark):
    columns = "doc_id bigint, page int, seq bigint, kind string, x double, y double, width double, height double, text string, fill string, stroke string, turn double, href string, page_width double, page_height double"
    rows = [
        (1, 1, 1, "link", 20.0, 240.0, 30.0, 12.0, None, None, None, 0.0, "http://a?b&c", 200.0, 300.0),
        (1, 1, 2, "text", 20.0, 240.0, 30.0, 12.0, "a<b", "#000000", None, 90.0, None, 200.0, 300.0),
        (1, 1, 3, "shape", 0.0, 0.0, 200.0, 300.0, None, "#ffffff", "#000000", 0.0, None, 200.0, 300.0),
        (1, 1, 4, "text", 400.0, 240.0, 30.0, 12.0, "outside", None, None, 0.0, None, 200.0, 300.0),
    ]
    out = visual.render_pages(spark.createDataFrame(rows, columns)).first().html
    assert "outside" not in out and out.index("<div") < out.index("a&lt;b") < out.index("http://a?b&amp;c")
    assert "left:20.00pt;top:48.00pt;font-size:12.00pt;color:#000000;transform:rotate(-90.00deg)" in out


def test_runs_of_a_long_text(spark):
    """Runs are cut where styles change; a text of one run isn't copied for each of its characters."""
    rows = spark.createDataFrame([("ab" * 30000,), ("",), ("x",)], "t string")
    chars = editor.toggle(editor.styled(F.col("t")), F.lit(1), F.lit(3), editor.BOLD)
    found = [r[0] for r in rows.select(editor.runs(chars)).collect()]
    assert [[(len(x.text), x.style) for x in r] for r in found] == [[(1, 0), (2, editor.BOLD), (59997, 0)], [], [(1, 0)]]
    assert "aggregate" not in str(editor.runs(chars))
    back = editor.toggle(editor.styled(F.lit("abc")), F.lit(2), F.lit(1), editor.BOLD)
    assert [x.style for x in rows.limit(1).select(back).first()[0]] == [0, 0, 0]
    none = editor.toggle(editor.styled(F.lit("abc")), F.lit(None).cast("int"), F.lit(1), editor.BOLD)
    assert [x.style for x in rows.limit(1).select(none).first()[0]] == [0, 0, 0]
