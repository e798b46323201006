"""Files of documents to blocks and HTML, one row a file; a broken file is a row with an error."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import model
from docstrata.sources import docx, markdown, pdf

DOCUMENTS = "path string, fmt string, title string, language string, html string, warnings array<string>, blocks array<struct<path:string,kind:string,level:int,text:string,html:string,attributes:map<string,string>>>, assets array<struct<id:string,path:string,alt:string>>, error string"
_BLOCK = pa.struct([("path", pa.string()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("html", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
_ARROW = pa.schema([("path", pa.string()), ("fmt", pa.string()), ("title", pa.string()), ("language", pa.string()), ("html", pa.string()), ("warnings", pa.list_(pa.string())), ("blocks", pa.list_(_BLOCK)), ("assets", pa.list_(pa.struct([("id", pa.string()), ("path", pa.string()), ("alt", pa.string())]))), ("error", pa.string())])


def format_of(path):
    """markdown, docx, pdf or unknown, by the extension."""
    ext = F.lower(F.regexp_extract(path, r"[.]([^./]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("docx", "pdf"), ext).otherwise("unknown")


def parse(fmt: str, content: bytes, include_images: bool = True) -> model.Document:
    if fmt == "markdown":
        return markdown.parse(content.decode("utf-8", "replace"))
    if fmt == "docx":
        return docx.parse(content, include_images)
    if fmt == "pdf":
        return pdf.parse(content, include_images)
    raise ValueError(f"unknown format {fmt}")


def _convert(include_images: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, fmt, content = (batch.column(k)[i].as_py() for k in range(3))
                row = dict.fromkeys(_ARROW.names) | {"path": path, "fmt": fmt}
                try:
                    doc = parse(fmt, content or b"", include_images)
                    row |= {"title": doc.title, "language": doc.language, "html": model.document_html(doc), "warnings": doc.warnings, "blocks": model.rows(doc.blocks), "assets": doc.assets}
                except (ValueError, RecursionError, KeyError, TypeError, IndexError, ArithmeticError, AttributeError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return run


def convert(files: DataFrame, include_images: bool = True) -> DataFrame:
    """files (path, fmt, content) to DOCUMENTS rows."""
    return files.select("path", "fmt", "content").mapInArrow(_convert(include_images), DOCUMENTS)


def read(spark: SparkSession, path: str, fmt: str | None = None, include_images: bool = True) -> DataFrame:
    """DOCUMENTS rows of all files under a path; ``fmt`` overrides the extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return convert(files.select("path", (F.lit(fmt) if fmt else format_of(F.col("path"))).alias("fmt"), "content"), include_images)


def blocks(documents: DataFrame) -> DataFrame:
    """One row a block: file, path, kind, level, text, html, attributes."""
    return documents.select(F.col("path").alias("file"), F.inline("blocks"))


def write_html(documents: DataFrame, path: str) -> None:
    """HTML of the documents without errors as Parquet by format, errors beside them."""
    documents.where("error is null").select("path", "fmt", "title", "html").write.mode("overwrite").partitionBy("fmt").parquet(f"{path}/html")
    documents.where("error is not null").select("path", "fmt", "error").write.mode("overwrite").parquet(f"{path}/errors")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io
    import zipfile

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content or b""))
            except (zipfile.BadZipFile, OSError):
                continue
            for name in archive.namelist():
                if name.startswith("word/media/") and not name.endswith("/"):
                    yield pa.RecordBatch.from_pydict({"path": [path], "member": [name], "name": [re.split(r"[/\\]", name)[-1]], "content": pa.array([archive.read(name)], pa.binary())})


def media(files: DataFrame) -> DataFrame:
    """Media members of DOCX files: path, member, name, content."""
    return files.where("fmt = 'docx'").select("path", "content").mapInArrow(_members, "path string, member string, name string, content binary")


def manifest(pairs: DataFrame) -> DataFrame:
    """One JSON line per pair of (name, input, output)."""
    return pairs.select(F.to_json(F.struct(*pairs.columns)).alias("value"))


def load_document(line: str) -> dict:
    return json.loads(line)
