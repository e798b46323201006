"""Byte-level tokens and bounded chunks for Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: a-z, 0-9 and all bytes above 0x7F belong to words, A-Z is lower-cased, the rest separates.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return text.translate(WORD_TABLE).split()


def chunks(batches: Iterable[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of (…, text) batches with the texts as bytes (null: empty), at most ``most`` bytes each unless one text is longer."""
    for batch in batches:
        at, size, texts = 0, 0, []
        column = batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            value = column[i].as_py()
            text = b"" if value is None else value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value
            if texts and size + len(text) > most:
                yield batch.slice(at, len(texts)), texts
                at, size, texts = i, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(at, len(texts)), texts


def integral(df: DataFrame, name: str) -> Column:
    """An id column as bigint; ids of another type than an integer are refused."""
    kind = df.schema[name].dataType
    if not isinstance(kind, IntegralType) and kind.typeName() != "void":
        raise TypeError(f"{name} has to be an integer, not {kind.simpleString()}")
    return F.col(name).cast("bigint")


def packed(df: DataFrame) -> DataFrame:
    """(row, text): the whole row in one struct, whatever its columns are called, beside the text."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row"), F.col("text").cast("string").alias("text"))


def unpacked(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    """The rows of a packed batch that are kept, as columns again."""
    rows = batch.column(0).filter(pa.array(keep))
    return pa.RecordBatch.from_arrays(rows.flatten(), [f.name for f in rows.type])


_LONG = re.compile(r"&#(?:0+(?=[0-9])([0-9]*)|([0-9]{9,}))")


def unescaped(text: str) -> str:
    """The text with every character reference decoded as HTML does; numbers of any length are too large or have leading zeros, and neither is a crash."""
    return html.unescape(_LONG.sub(lambda m: "&#" + ("1114112" if len(m[1] or m[2] or "") > 8 else m[1]), text))
