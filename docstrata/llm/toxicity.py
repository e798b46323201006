"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Learned from a bounded sample of labelled rows (TRAIN_ROWS, those with the
smallest hash of doc_id, and one of those that share the least hash of their shingles,
as copies do): from three quarters of it a lexicon of at most LEXICON
stems that tell label 1 from label 0 by smoothed log-odds of document counts, in units
of their standard error, and boosted trees on the features; isotonic regression of the label on the trees'
score over the last quarter, of which the lexicon knows nothing. Features: lexicon density and
weight, nearness of second-person words, capitals, punctuation, digits,
obfuscated lexicon words. Scoring is one pass over the whole texts with a model
of fixed size; nothing of the corpus is shuffled.

Defined cases: a null text is empty and gets a score like any other; labels that
are null, or of documents that are missing, teach nothing; without both labels
in the sample the score is the share of label 1 (0 without labels), by which
``keep_clean`` rejects nothing; a doc_id
that is labelled more than once counts as toxic if any of its labels is;
repeated rows are scored one by one; other columns are ignored by ``score`` and
kept by ``keep_clean``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.text import chunks, packed, unpacked, words
from docstrata.session import cut, table

TRAIN_ROWS = 12_000
LEXICON = 64
LEAST_DOCS = 5
#: Least log-odds of a stem, in standard errors.
LEAST_SURE = 3.3
#: Bytes of a stem: shorter words are whole entries, of longer ones the beginnings count.
STEM, LONGEST_STEM = 5, 12
#: Words whose stem a task remembers.
REMEMBERED = 1 << 18
REJECT = 0.3
#: One of so many parts of the sample is kept for the calibration.
PARTS = 4
NEAR = 5
SHINGLE = 3

#: Second-person words of the four languages.
SECOND = frozenset("you your yours yourself ur u tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros".encode().split())

#: Digits and signs read as the letters they stand for; other signs inside a word are dropped.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0134578@$!|", b"abcdefghijklmnopqrstuvwxyzoieastbasil")
_DROPPED = b".,-_*+~^'\"`#%&()[]{}<>:;?/\\="

FEATURES = ("hits", "density", "distinct", "weight", "second", "second_share", "capitals", "exclaims", "questions", "punctuation", "digits", "obfuscated", "obfuscated_share", "word_length", "log_words")


def beginnings(word: bytes) -> list[bytes]:
    """The word if it is short, else its beginnings of STEM to LONGEST_STEM bytes that end with a code point."""
    if len(word) <= STEM:
        return [word]
    return [word[:k] for k in range(STEM, min(len(word), LONGEST_STEM) + 1) if k == len(word) or word[k] & 0xC0 != 0x80]


class Stems(dict):
    """The lexicon's stem of each word, or nothing."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> bytes:
        found = next((b for b in beginnings(word) if b in self.lexicon), b"")
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def features(text: bytes, stems: Stems) -> list[float]:
    lexicon, ws = stems.lexicon, words(text)
    met = [stems[w] for w in ws]
    n = max(1, len(ws))
    at = [i for i, m in enumerate(met) if m]
    second = sum(1 for i in at if not SECOND.isdisjoint(ws[max(0, i - NEAR) : i + NEAR + 1]))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    digits = int(counts[48:58].sum())
    signs = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    plain = sum(1 for w in text.translate(_PLAIN, _DROPPED).split() if stems[w])
    hidden = max(0, plain - len(at))
    size = max(1, len(text))
    return [
        len(at), 1000.0 * len(at) / n, len({met[i] for i in at}), sum(lexicon[met[i]] for i in at),
        second, second / max(1, len(at)), capitals / max(1, capitals + small), 100.0 * int(counts[33]) / n, 100.0 * int(counts[63]) / n,
        signs / size, digits / size, hidden, 1000.0 * hidden / n, size / n, math.log1p(len(ws)),
    ]


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    base: float = 0.0
    #: Each tree: (features, thresholds, leaves) of a complete binary tree in breadth-first order.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Knots of the calibration.
    raw: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    share: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.share[0])
        raw = 1 / (1 + np.exp(-self.margin(x)))
        # A thousandth of the uncalibrated score keeps the order within a step.
        return np.clip(0.999 * np.interp(raw, self.raw, self.share) + 0.001 * raw, 0, 1)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> tuple[float, list]:
    """Second-order boosting of the logistic loss on quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    margin, trees = np.full(len(y), base), []
    inner = (1 << depth) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, edges in enumerate(cuts):
                if not len(edges) or len(rows) < 2:
                    continue
                lg = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges) + 1))[:-1]
                lh = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges) + 1))[:-1]
                gain = lg**2 / (lh + penalty) + (total_g - lg) ** 2 / (total_h - lh + penalty) - total_g**2 / (total_h + penalty)
                k = int(np.argmax(np.where((lh > 0.5) & (total_h - lh > 0.5), gain, -1)))
                if gain[k] > best and 0.5 < lh[k] < total_h - 0.5:
                    best, feature[at], threshold[at] = gain[k], f, edges[k]
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        leaf = np.zeros(inner + 1)
        sums_g = np.bincount(node - inner, g, inner + 1)
        sums_h = np.bincount(node - inner, h, inner + 1)
        leaf[:] = -rate * sums_g / (sums_h + penalty)
        margin += leaf[node - inner]
        trees.append((feature, threshold, leaf))
    return base, trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; the knots are the pools' ends. One prior row of each label keeps the ends off 0 and 1."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum, rows, lowest and highest raw score
    for value, label in zip([0.0, *raw[order], 1.0], [0.0, *y[order], 1.0], strict=True):
        pools.append([float(label), 1.0, float(value), float(value)])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], high]
    knots = [(x, s / n) for s, n, low, high in pools for x in ((low, high) if high > low else (low,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> beginning of a word, documents of label 1 and 0, summed per batch."""
    for batch, texts in chunks(batches):
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            by[int(label)].update({b for w in set(words(text)) for b in beginnings(w)})
        every = list({*by[0], *by[1]})
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([by[1][w] for w in every], pa.int64()), pa.array([by[0][w] for w in every], pa.int64())], ["word", "ones", "zeros"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of the text's SHINGLE-word shingles (all its words if they are fewer)."""
    for batch, texts in chunks(batches):
        least = []
        for text in texts:
            ws = words(text)
            least.append(str(min(xxhash.xxh64_intdigest(b" ".join(ws[i : i + SHINGLE])) for i in range(max(1, len(ws) - SHINGLE + 1)))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], ["doc_id", "toxic", "text", "least"])


def _vectors(lexicon: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems(lexicon)
        for batch, texts in chunks(batches):
            rows = [features(t, stems) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    return run


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    # Of several texts of one doc_id the one with the smallest hash teaches.
    sample = sample.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    # One document of those that share their least shingle, so that copies are no evidence and don't stand on both sides of a split.
    sample = sample.mapInArrow(_sketched, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, toxic int, text string, least string")
    sample = sample.groupBy("least").agg(F.min_by(F.struct("doc_id", "toxic", "text"), F.struct(F.xxhash64("doc_id"), "doc_id")).alias("r")).select("r.*")
    sample = cut(sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))))
    n = {(r[0], r[1] > 0): r[2] for r in sample.groupBy("toxic", F.least("part", F.lit(1)).alias("part")).count().collect()}
    ones, zeros = (n.get((k, True), 0) + n.get((k, False), 0) for k in (1, 0))
    if not ones or not zeros:
        return Model(share=np.array([1.0 if ones else 0.0]))
    # Without both labels, or without rows to calibrate on, the whole sample does for all.
    apart = n.get((1, True), 0) > 0 and n.get((0, True), 0) > 0 and n.get((1, False), 0) + n.get((0, False), 0) > 0
    teaching = sample.where("part > 0") if apart else sample
    if apart:
        ones, zeros = n[(1, True)], n[(0, True)]
    odds = F.log((F.col("ones") + 0.5) / (ones + 1.0)) - F.log((F.col("zeros") + 0.5) / (zeros + 1.0))
    counts = teaching.select("toxic", "text").mapInArrow(_word_counts, "word binary, ones bigint, zeros bigint").groupBy("word").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    error = F.sqrt(1 / (F.col("ones") + 0.5) + 1 / (F.col("zeros") + 0.5))
    sure = counts.where(F.col("ones") >= LEAST_DOCS).withColumn("odds", odds).withColumn("sure", F.col("odds") / error).where(F.col("sure") >= LEAST_SURE)
    # Beginnings of one word and its longer and shorter ones come together, of equal ones the longest first; LONGEST_STEM of them at most are of one kind.
    lexicon: dict[bytes, float] = {}
    for r in sure.orderBy(F.desc("sure"), F.desc(F.length("word")), "word").limit(LEXICON * LONGEST_STEM).collect():
        word = bytes(r["word"])
        if len(lexicon) < LEXICON and not any(word.startswith(x) or x.startswith(word) for x in lexicon):
            lexicon[word] = float(r["odds"])
    got = sample.select("doc_id", "toxic", "text").mapInArrow(_vectors(lexicon), "doc_id bigint, toxic int, x array<double>").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))).orderBy("doc_id").collect()
    x, y, part = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float), np.array([r["part"] for r in got])
    for_trees = part != 0 if apart else np.ones(len(y), bool)
    model = Model(lexicon)
    model.base, model.trees = boost(x[for_trees], y[for_trees])
    rest = ~for_trees if (~for_trees).any() else for_trees
    model.raw, model.share = isotonic(1 / (1 + np.exp(-model.margin(x[rest]))), y[rest])
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems(model.lexicon)
        for batch, texts in chunks(batches):
            x = np.array([features(t, stems) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The documents that score under ``reject``, with all columns, in one narrow pass; all of them if the model has learned from one label only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems(model.lexicon)
        for batch, texts in chunks(batches):
            x = np.array([features(t, stems) for t in texts])
            yield unpacked(batch, model.score(x) < reject)

    if not model.trees:
        # Nothing tells label 1 from label 0: nothing is rejected.
        return docs
    return packed(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
