"""Language identification by string-kernel classification.

The kernel of two texts is the cosine of their blended-spectrum presence
vectors: which byte n-grams, 1 to 4 long, of the normalised text occur, hashed
to DIM places. Nystroem: LANDMARKS texts of the sample stand for all, a text
becomes its kernel values with them times the inverse square root of the
landmarks' own kernel matrix, and one ridge regression per language (+1 for it,
-1 for the rest) is solved there. A batch of texts is scored with two matrix
products. Normalised text: lower case, every run of characters that are no
letters is one space.

The model is learned from a bounded sample: the PER_LANG documents with the
smallest hash of doc_id of each non-null lang, SAMPLE in all, whole texts, as
presence bits; rows with an empty kernel vector teach nothing, and of several rows of
one doc_id the one with the smallest hash of its bits and lang teaches.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any learned language every text is ``und``; ties go to the smaller lang
by name; repeated rows are answered one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.llm.text import chunks
from docstrata.session import table

PER_LANG = 600
#: Most rows of the sample in all.
SAMPLE = 50_000
LANDMARKS = 192
BITS = 13
DIM = 1 << BITS
ORDERS = (1, 2, 3, 4)
RIDGE = 1e-3
BATCH = 1024

#: ASCII letters to lower case, other ASCII to spaces; bytes of longer code points stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: bytes) -> bytes:
    plain = text.translate(_LETTERS)
    if not plain.isascii():
        plain = "".join(c if c == " " or c.isalpha() else " " for c in plain.decode("utf-8", "replace").lower()).encode()
    return b" ".join(plain.split())


def presence(text: bytes) -> np.ndarray:
    """Presence of the hashed n-grams of a text, as 0 and 1; all 0 without letters."""
    out = np.zeros(DIM, np.uint8)
    plain = normalise(text)
    if plain:
        codes = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            gram = gram[: len(codes) - n + 1] * np.uint32(257) + codes[n - 1 :]
            if not len(gram):
                break
            if n in ORDERS:
                out[(gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS)] = 1
    return out


@dataclass
class Model:
    langs: list[str]
    #: Landmarks as packed bits, and the map from kernel values to the langs' margins.
    landmarks: np.ndarray
    weights: np.ndarray

    def unpacked(self) -> np.ndarray:
        z = np.unpackbits(self.landmarks, axis=1)[:, :DIM].astype(np.float32)
        return np.ascontiguousarray((z / np.sqrt(np.maximum(1, z.sum(axis=1)))[:, None]).T)

    def margins(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        kernel = (x.astype(np.float32) @ z) / np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64)))[:, None]
        return kernel @ self.weights


def fit(langs: list[str], x: np.ndarray, y: np.ndarray) -> Model:
    """x: presence rows; y: index into langs."""
    rng = np.random.default_rng(7)
    norm = x.astype(np.float32) / np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64)))[:, None]
    chosen = np.sort(rng.permutation(len(x))[:LANDMARKS])
    z = norm[chosen]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (norm @ z.T).astype(np.float64) @ root
    sign = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    # Every language weighs as much as every other one.
    weight = (1.0 / np.maximum(1, np.bincount(y, minlength=len(langs))))[y] * len(y) / len(langs)
    gram = (phi * weight[:, None]).T @ phi
    solved = np.linalg.solve(gram + RIDGE * len(y) * np.eye(len(gram)), (phi * weight[:, None]).T @ sign)
    return Model(langs, np.packbits(x[chosen], axis=1), (root @ solved).astype(np.float32))


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.packbits(presence(t)).tobytes() for t in texts], pa.binary())], ["doc_id", "lang", "bits"])


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    # The smallest hashes per lang without gathering a lang: the best of 64 parts first, then of all parts.
    ids = known.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(64)))
    first = Window.partitionBy("lang", "part").orderBy("h", "doc_id")
    then = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang).withColumn("r", F.row_number().over(then)).where(F.col("r") <= per_lang)
    # At most SAMPLE ids whatever the number of languages, every language's first ones first.
    chosen = chosen.orderBy("r", "h", "doc_id").limit(SAMPLE).select("doc_id").distinct()
    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(_presence_rows, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, lang string, bits binary")
    # Of several rows of one doc_id the one with the smallest hash teaches, wherever it stands.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("bits", "lang").alias("h"), "lang", "bits")).alias("r")).select("doc_id", "r.lang", "r.bits")
    got = sorted(((r[1], str(r[0]), bytes(r[2])) for r in rows.collect()))
    got = [g for g in got if any(g[2])]
    if not got:
        return None
    langs = sorted({g[0] for g in got})
    x = np.stack([np.unpackbits(np.frombuffer(g[2], np.uint8))[:DIM] for g in got])
    return fit(langs, x, np.array([langs.index(g[0]) for g in got]))


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = model.unpacked() if model else None
        for batch, texts in chunks(batches):
            langs: list[str] = ["und"] * len(texts)
            scores = [0.0] * len(texts)
            for at in range(0, len(texts) if model else 0, BATCH):
                x = np.stack([presence(t) for t in texts[at : at + BATCH]])
                margins = model.margins(x, z)
                best = margins.argmax(axis=1)
                # Share of the best margin under a softmax; a margin of 2 parts +1 from -1.
                share = 1 / np.exp(4 * (margins - margins.max(axis=1, keepdims=True))).sum(axis=1)
                for i in np.flatnonzero(x.any(axis=1)).tolist():
                    langs[at + i], scores[at + i] = model.langs[best[i]], float(min(1.0, max(0.0, share[i])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
