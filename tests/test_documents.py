"""Readers, layout folds, rendering, comparison, conversion and streaming on small inputs."""

import io
import time
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docstrata.operators import compare, layout, model
from docstrata.plans.documents import make_docx, make_pdf
from docstrata.sources import docx, files, htmldoc, markdown, pdf
from docstrata.streaming import ingest


def body(doc):
    return "".join(map(model.block_html, doc.blocks))


# Markdown


def test_markdown_blocks():
    out = body(markdown.parse("# Title\n\n- [x] done\n- [ ] open\n\n| a | b |\n|---|--:|\n| 1 | ~~2~~ |\n\n**strong** and `code`\n"))
    for part in ("<h1>Title</h1>", 'disabled checked> done', 'disabled> open', "<table>", "<th>a</th>", '<td style="text-align: right"><del>2</del></td>', "<strong>strong</strong>", "<code>code</code>"):
        assert part in out


def test_markdown_odd_signs():
    assert body(markdown.parse("a * b snake_case [x] `y")) == "<p>a * b snake_case [x] `y</p>\n"
    assert body(markdown.parse("```py\na < b")) == '<pre><code class="language-py">a &lt; b</code></pre>\n'
    assert [b.attributes["ordered"] for b in markdown.parse("- a\n1. b").blocks] == ["false", "true"]
    assert markdown.parse("> a\n> > b").blocks[0].children[1].kind == "quote"
    assert '<a href="u" title="t">l</a>' in body(markdown.parse('[l](u "t")')) and '<img src="s" alt="i">' in body(markdown.parse("![i](s)"))


@settings(max_examples=150, deadline=2000)
@given(st.text(alphabet="*_`[]()!~|#->1. \\\nab", max_size=60))
def test_markdown_ends(source):
    body(markdown.parse(source))


# DOCX


def package(document, relations="", media=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if document is not None:
            z.writestr("word/document.xml", f'<w:document xmlns:w="w" xmlns:r="r" xmlns:a="a"><w:body>{document}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{relations}</Relationships>")
        for name in media:
            z.writestr(f"word/media/{name}", b"png")
    return out.getvalue()


def test_docx():
    doc = docx.parse(package(
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head &amp; more</w:t></w:r></w:p>'
        '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> plain</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>'
        '<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
        '<w:p><w:r><w:drawing><a:blip r:embed="x1"/></w:drawing></w:r></w:p>',
        '<Relationship Id="x1" Target="media/image1.png"/>', ("image1.png", "spare.png"),
    ))
    out = body(doc)
    for part in ("<h1>Head &amp; more</h1>", "<strong>bold</strong> plain", "<li>item</li>", "<th>cell</th>", 'src="word/media/image1.png"'):
        assert part in out
    assert doc.title == "Head & more" and doc.assets[0]["id"] == "docx-image-1" and doc.warnings == ["media part word/media/spare.png is not referenced"]
    assert not docx.parse(package("<w:p><w:r><w:t>x</w:t></w:r></w:p>"), include_images=False).assets


@pytest.mark.parametrize(("data", "kind"), [(b"no zip", "InvalidArchive"), (package(None), "MissingPart"), (package("<w:p>"), "InvalidXml"), (package("").replace(b"x", b"x"), None)])
def test_docx_errors(data, kind):
    if kind is None:
        assert docx.parse(data).blocks == []
    else:
        with pytest.raises(docx.DocumentError) as e:
            docx.parse(data)
        assert e.value.kind == kind


# PDF


def pdf_file(objects, extra=b""):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects) + extra


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def page(content, extra=b"", font=b"<< /Type /Font /Subtype /Type1 >>", more=()):
    return [(1, b"<< /Type /Catalog /Pages 2 0 R " + extra + b" >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /I 9 0 R >> >> >>"), (4, content), (5, font), *more]


def test_pdf_text_and_filters():
    text = b"BT /F1 12 Tf 72 720 Td (Hi \\(you\\) \\101) Tj ET"
    for content in (stream(text), stream(zlib.compress(text), b"/Filter /FlateDecode"), stream(text.hex().encode() + b">", b"/Filter /ASCIIHexDecode")):
        assert "<p>Hi (you) A</p>" in body(pdf.parse(pdf_file(page(content))))
    assert pdf.run_length(b"\x02abc\xfed\x80") == b"abcddd"
    assert pdf.lzw(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"
    assert pdf.unpredict(b"\x02\x01\x02\x02\x01\x01", {"Predictor": 12, "Columns": 2}) == b"\x01\x02\x02\x03"


def test_pdf_revision_and_object_stream():
    old = page(stream(b"BT /F1 12 Tf 0 0 Td (old) Tj ET"))
    assert "new" in body(pdf.parse(pdf_file(old + [(4, stream(b"BT /F1 12 Tf 0 0 Td (new) Tj ET"))])))
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <41> <4E2D> endbfchar 1 beginbfrange <42> <43> <0058> endbfrange"
    inner = b"5 0 << /Type /Font /Subtype /Type1 /ToUnicode 8 0 R >>"
    objects = [o for o in page(stream(b"BT /F1 12 Tf 0 0 Td (ABC) Tj ET")) if o[0] != 5] + [(8, stream(cmap)), (7, stream(zlib.compress(inner), b"/Type /ObjStm /N 1 /First 4 /Filter /FlateDecode"))]
    assert "中XY" in body(pdf.parse(pdf_file(objects)))


def test_pdf_roles_and_placeholder():
    actual = pdf.parse(pdf_file(page(stream(b"BT /F1 12 Tf 0 0 Td /H1 << /ActualText (Real) >> BDC (xx) Tj (yy) Tj EMC ET"))))
    assert "<h1>Real</h1>" in body(actual)
    tree = page(stream(b"BT /F1 12 Tf 0 0 Td /P << /MCID 0 >> BDC (Head) Tj EMC ET"), b"/StructTreeRoot 6 0 R", more=[(6, b"<< /K 7 0 R /RoleMap << /Big /H2 >> >>"), (7, b"<< /S /Big /Pg 3 0 R /K 0 >>")])
    assert "<h2>Head</h2>" in body(pdf.parse(pdf_file(tree)))
    image = pdf.parse(pdf_file(page(stream(b"/I Do"), more=[(9, stream(b"x", b"/Subtype /Image"))])))
    assert 'data-reason="non-extractable"' in body(image) and "page 1 has no selectable text" in image.warnings and any("images" in w for w in image.warnings)
    assert any("encrypted" in w for w in pdf.parse(pdf_file(page(stream(b"")), b"trailer << /Encrypt 5 0 R >>")).warnings)


@settings(max_examples=100, deadline=3000)
@given(st.binary(max_size=200))
def test_pdf_ends(data):
    pdf.parse(b"%PDF-1.4\n1 0 obj\n" + data)


def test_pdf_furniture():
    kids = b" ".join(b"%d 0 R" % (10 + k) for k in range(4))
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [" + kids + b"] >>")]
    for k in range(4):
        objects += [(10 + k, b"<< /Type /Page /Contents %d 0 R >>" % (20 + k)), (20 + k, stream(b"BT 12 TL 72 750 Td (Running header) Tj 0 -100 Td (Body %s stays) Tj ET" % b"abcd"[k : k + 1] + b" BT 72 20 Td (%d/4) Tj ET" % (k + 1)))]
    out = body(pdf.parse(pdf_file(objects)))
    assert "Running header" not in out and out.count("stays") == 4 and "/4" not in out.replace("</", "") and out.count("data-page-break") == 3


# layout


def seg(text, x, y, font=12.0, seq=0):
    return layout.Segment(text, x, y, font, len(text) * 6.0, seq=seq)


def test_layout():
    blocks = layout.page_blocks([seg(t, x, y, seq=i) for i, (t, x, y) in enumerate([("Fruit", 40, 300), ("Crates", 210, 300), ("plums", 41, 285), ("1,250", 212, 285)])])
    assert blocks[0].kind == "table" and [c[1] for c in blocks[0].rows[0]] == [True, True] and blocks[0].rows[1][1][2] == "right"
    assert [b.kind for b in layout.page_blocks([seg("Big", 10, 200, 20), seg("text of a line", 10, 150), seg("and more.", 10, 136), seg("- a", 10, 100), seg("- b", 10, 86)])] == ["heading", "paragraph", "list"]
    assert len(layout.deduplicate([seg("a", 1, 1), seg("a", 1.5, 1.5), seg("a", 3, 1)])) == 2
    assert [b.kind for b in layout.collapse_code([model.Block("paragraph", model.text(f"<a{i}>")) for i in range(3)])] == ["code"]
    assert layout.median_font([]) == 12.0 and layout.anchors([1, 2, 9]) == [[1, 2], [9]]


def test_links():
    block = model.Block("paragraph", model.text("see example.com/a now"))
    assert layout.attach_links([block], ["http://example.com/a", "http://none/"]) == ["link http://none/ has no visible text"]
    assert '<a href="http://example.com/a">example.com/a</a>' in model.block_html(block)


# HTML, rendering, comparison


def test_html_blocks():
    doc = htmldoc.parse("<html lang=en><title>T &amp; t</title><h2>A <b>b</b></h2><p>one<p>two <a href='u'>l</a><ul><li>x<li>y</ul><table><tr><th>h<td>d</table><script>no</script>")
    assert doc.title == "T & t" and doc.language == "en"
    assert body(doc) == '<h2>A <strong>b</strong></h2>\n<p>one</p>\n<p>two <a href="u">l</a></p>\n<ul>\n<li>x</li>\n<li>y</li>\n</ul>\n<table>\n<tr><th>h</th><td>d</td></tr>\n</table>\n'


def test_document_html():
    doc = model.Document([model.Block("paragraph", model.text("a < b"))], 'T "q"', language="de", warnings=["w & x"])
    out = model.document_html(doc)
    for part in ('<html lang="de">', '<title>T "q"</title>', "<p>a &lt; b</p>", "<li>w &amp; x</li>"):
        assert part in out


def test_compare(spark):
    assert compare.line_stats(["p", "q", "r", "s"], ["p", "x", "s", "t", "u"]) == {"matching": 2, "left_only": 0, "right_only": 2, "changed": 2}
    assert compare.line_stats(["p", "q", "r"], ["x"]) == {"matching": 0, "left_only": 0, "right_only": 0, "changed": 3}
    pairs = spark.createDataFrame([(1, "a b c", "a b c"), (2, "a", None)], "id bigint, left_text string, right_text string")
    assert {r.id: r.band for r in compare.compare(pairs).collect()} == {1: "Very close", 2: "Substantially different"}


# files and streams


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.md").write_text("# A\n\ntext")
    (folder / "deep" / "b.docx").write_bytes(make_docx("one\ntwo"))
    (folder / "c.PDF").write_bytes(make_pdf("hello"))
    (folder / "d.docx").write_bytes(b"broken")
    (folder / "e.txt").write_text("?")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read(spark, str(folder)).collect()}
    assert got["a.md"].title == "A" and "<p>one</p>" in got["b.docx"].html and "<p>hello</p>" in got["c.PDF"].html
    assert "InvalidArchive" in got["d.docx"].error and "unknown" in got["e.txt"].error
    assert files.blocks(files.read(spark, str(folder))).where("kind = 'paragraph'").count() == 4
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    ingest.run_available(spark, str(folder), out, at)
    assert spark.read.parquet(out).count() == 5
    (folder / "f.md").write_text("later")
    ingest.run_available(spark, str(folder), out, at)
    assert spark.read.parquet(out).count() == 6
    assert ingest.job_status(spark.read.parquet(out)).first().status == "partial"
    files.write_html(spark.read.parquet(out), str(tmp_path / "html"))
    assert spark.read.parquet(str(tmp_path / "html" / "html")).count() == 4


def test_plain_signs_are_passed_at_once():
    """Three million plain signs between marks; one step for each takes seconds."""
    text = "word, and more. " * 187_500
    began = time.process_time()
    found = markdown.inlines(f"{text}*{text}*! \\ `c`{text}")
    assert time.process_time() - began < 1
    assert found == [("text", text, {}), ("emphasis", [("text", text, {})], {}), ("text", "! \\ ", {}), ("code", "c", {}), ("text", text, {})]
