"""Queries of the readers, the layout folds, the comparison and the stream, on the driver's tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import scalars
from docstrata.functions.dialect import DUCK, SPARK
from docstrata.operators import compare, editor, flatpages, model, visual
from docstrata.plans import catalogue
from docstrata.session import shared_folder, table
from docstrata.sources import docx, htmldoc, markdown, pdf
from docstrata.streaming import ingest

_ROWS = "id bigint, path string, kind string, level int, text string, html string"
_NAMES = ["id", "path", "kind", "level", "text", "html"]


#: Characters of output that one batch holds, unless one document has more.
_BATCH = 4 << 20


def _blocks(parse: Callable[[str], model.Document]):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _NAMES]
            size = 0
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                for r in model.rows(parse(batch.column(1)[i].as_py() or "").blocks):
                    for values, value in zip(columns, (key, *(r[n] for n in _NAMES[1:])), strict=True):
                        values.append(value)
                    size += len(r["text"]) + len(r["html"])
                if columns[0] and (size >= _BATCH or i + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)
                    columns, size = [[] for _ in _NAMES], 0

    return run


def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_blocks(markdown.parse), _ROWS)


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(_blocks(htmldoc.parse), _ROWS)


def make_docx(value: str) -> bytes:
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in value.split("\n"))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def make_pdf(value: str) -> bytes:
    shown = [x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in value.split("\n")]
    content = b"BT /F1 12 Tf 14 TL 72 720 Td " + b" ".join(b"(" + x + b") Tj T*" for x in shown) + b" ET"
    parts = (b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, p) for n, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>"


def _texts(make: Callable[[str], bytes], parse: Callable[[bytes], model.Document]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(model.block_text(b) for b in parse(make(v or "")).blocks) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["item_id", "text"])

    return run


def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a DOCX of a paragraph a line, read back."""
    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInArrow(_texts(make_docx, docx.parse), "item_id bigint, text string")


def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a PDF of a shown string a line, read back."""
    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInArrow(_texts(make_pdf, pdf.parse), "item_id bigint, text string")


def make_picture_pdf(key: int) -> bytes:
    """A page of 600 x 800 with a line of text and an image of three pixels, clipped to the left half; its box follows from the key."""
    x, y, w, h = picture_box(key)
    content = b"BT /F1 12 Tf 60 700 Td (Line) Tj ET q 0 0 300 800 re W n %d 0 0 %d %d %d cm /I Do Q" % (w, h, x, y)
    pixels = bytes((key + k) % 256 for k in range(9))
    parts = (
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /MediaBox [0 0 600 800] /Contents 4 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 >> >> /XObject << /I 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content),
        b"<< /Subtype /Image /Width 3 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Length 9 >>\nstream\n%s\nendstream" % pixels,
    )
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, p) for n, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>"


def picture_box(key: int) -> tuple[int, int, int, int]:
    return key % 11 * 40, 20 + key % 13 * 55, 10 + key % 17 * 12, 10 + key % 19 * 10


def pdf_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's key as a PDF with an image, read back: images that show, where they are drawn, and their place among the blocks (-1: not part of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                data = make_picture_pdf(key)
                shown = pdf.read_pages(data)[1][0].images
                kinds = [b.kind for b in pdf.parse(data).blocks]
                rows += [(key, p.x, p.y, p.width, p.height, kinds.index("image") if "image" in kinds else -1) for p in shown]
            names = ["item_id", "x", "y", "width", "height", "place"]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({n: "float64" for n in names[1:5]} | {"item_id": "int64", "place": "int64"}), preserve_index=False)

    return table(spark, sf_dir, "benchmark").where("item_id IS NOT NULL").select("item_id").mapInArrow(run, "item_id bigint, x double, y double, width double, height double, place bigint")


def column_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each document's page after column repair."""
    return flatpages.folded(table(spark, sf_dir, "documents"), True, lambda pages: flatpages.repaired(pages, scalars.PAGE_WIDTH, scalars.PAGE_HEIGHT), "doc_id bigint, seq bigint, text string, x double, y double, width double")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a document grouped to lines by the fold: one group is one document's page."""
    return flatpages.folded(table(spark, sf_dir, "documents"), False, flatpages.text_lines, "doc_id bigint, y double, text string, n_cells bigint")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each document's page: those that a window of four lines shares (at: its first line), left edges that repeat, and runs of one visual line (at: their number)."""
    return flatpages.folded(table(spark, sf_dir, "documents"), True, flatpages.shared_columns, "doc_id bigint, kind string, at bigint, x double")


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    left = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("left_text"))
    right = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right_text"))
    return compare.compare(left.join(right, ["conv_id", "turn"]).select("conv_id", "turn", "left_text", "right_text"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream that reads what is there and stops."""
    schema = table(spark, sf_dir, "events").schema
    name = f"counts_{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = ingest.event_counts(source.withColumn("ts", F.col("ts").cast("timestamp")))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("string").alias("start"), "event_type", "n")


def editor_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with two ranges toggled and a word put in, as runs in HTML."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    chars = editor.insert(editor.styled(F.col("line")), F.lit(4), editor.styled(F.lit("<new>")))
    chars = editor.toggle(editor.toggle(chars, F.lit(0), F.lit(6), editor.BOLD), F.lit(3), F.lit(8), editor.ITALIC)
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), editor.runs_html(editor.runs(chars)).alias("html"))


def visual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived segments of each document as one positioned page."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("docstrata_documents")
    words = spark.sql(catalogue._words(SPARK).replace("@documents", "docstrata_documents"))
    nothing = F.lit(None).cast("string")
    rows = words.select("doc_id", F.lit(1).alias("page"), (F.col("line_no") * 100_000 + F.col("seq")).alias("seq"), F.lit("text").alias("kind"), "x", "y", "width", F.col("font").alias("height"), "text", nothing.alias("fill"), nothing.alias("stroke"), F.lit(0.0).alias("turn"), nothing.alias("href"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))
    return visual.render_pages(rows)


QUERIES = {
    "d01_d10_editor_html": editor_html,
    "k38_k43_visual_pages": visual_pages,
    "s44_html_blocks": html_blocks,
    "w05_md_blocks": md_blocks,
    "s05_docx_text": docx_text,
    "s11_pdf_text": pdf_text,
    "j29_w21_o02_pdf_pictures": pdf_pictures,
    "w14_j17_j20_j21_o09_column_repair": column_repair,
    "g06_page_lines": page_lines,
    "g04_g05_g09_columns": columns,
    "f74_g30_turn_similarity": turn_similarity,
    "r01_stream_counts": stream_counts,
}

_D = DUCK
_RUN = lambda a, b, open_, close: f"CASE WHEN length(c[{a}:{b}]) > 0 THEN '{open_}' || replace(replace(replace(c[{a}:{b}], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '{close}' ELSE '' END"
ORACLES = {
    "d01_d10_editor_html": f"SELECT doc_id, line_no, {_RUN(1, 3, '<strong>', '</strong>')} || {_RUN(4, 6, '<em><strong>', '</strong></em>')} || {_RUN(7, 8, '<em>', '</em>')} || {_RUN(9, '', '', '')} AS html FROM (SELECT doc_id, line_no, left(x, 4) || '<new>' || substr(x, 5) AS c FROM (SELECT doc_id, line_no, line AS x FROM ({catalogue._lines(_D).replace('@', '')}) b))",
    "k38_k43_visual_pages": f"WITH s AS ({catalogue._words(_D).replace('@', '')}), e AS (SELECT doc_id, line_no, seq, '<span style=\"position:absolute;left:' || printf('%.2f', x) || 'pt;top:' || printf('%.2f', 792 - y - 12) || 'pt;font-size:12.00pt\">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</span>' AS h FROM s WHERE x < 612 AND x + width > 0 AND 792 - y > 0 AND 792 - y - 12 < 792) SELECT doc_id, 1 AS page, '<section class=\"page\" style=\"position:relative;width:612.00pt;height:792.00pt\">' || string_agg(h, '' ORDER BY line_no, seq) || '</section>' AS html FROM e GROUP BY doc_id",
    "s05_docx_text": "SELECT item_id, text FROM benchmark",
    "s11_pdf_text": f"SELECT item_id, {scalars.squeeze(_D, 'text')} AS text FROM benchmark",
    "j29_w21_o02_pdf_pictures": """WITH b AS (SELECT item_id, item_id % 11 * 40 AS x, 20 + item_id % 13 * 55 AS y, 10 + item_id % 17 * 12 AS w, 10 + item_id % 19 * 10 AS h FROM benchmark),
      t AS (SELECT *, greatest(0, 800 - y - h) AS top FROM b WHERE least(300, x + w) - x >= 0.5)
      SELECT item_id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS width, h::DOUBLE AS height, (CASE WHEN w < 24 OR h < 18 OR (w * h < 4800 AND w < 132) OR (top < 72 AND w * h < 19200) THEN -1 WHEN top >= 94 THEN 1 ELSE 0 END)::BIGINT AS place FROM t""",
    "g06_page_lines": f"WITH s AS ({catalogue._words(_D).replace('@', '')}) SELECT doc_id, round(max(y), 3) AS y, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS n_cells FROM s GROUP BY doc_id, line_no",
    "r01_stream_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
