"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, PASSAGE words each, of its whole text. A passage
becomes a vector: shares of its byte pairs, hashed to GRAMS places, and signs of its
make-up (capitals, digits, kinds of punctuation, lengths and repetition of words). The
model encodes each passage as h = tanh(W x + b), gives it the weight
softmax(v . (tanh(T h) * sigmoid(G h))) among the document's passages, and the logit is
a linear function of the weighted sum of h. All of it is learned from the documents'
labels together, by Adam.

Learned from a bounded sample: of the labelled documents with a text of at most
TRAIN_BYTES, the TRAIN_ROWS with the smallest hash of doc_id. Scoring is one pass over
the whole texts, BATCH passages at a time: the softmax is summed up as it goes, so a long
text takes its passages' vectors, about three times its size, and no more.

Defined cases: a null, empty or blank text is one passage without words and gets a
score like any other; a long run of bytes without white space is one word; labels that
are null, or of documents that are missing, teach nothing; a doc_id with several labels
counts as good only if all are, one with several texts teaches with the text of the
smallest hash; without both labels in the sample the score is the share of label 1 (0
without labels); repeated rows are answered one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.text import chunks
from docstrata.session import cut, table

TRAIN_ROWS = 4_000
#: Longer texts teach nothing; they are scored like all.
TRAIN_BYTES = 1 << 18
PASSAGE = 64
GRAMS = 256
HIDDEN = 24
GATE = 12
EPOCHS = 30
BAGS = 32
#: Passages that are encoded at once.
BATCH = 1 << 12
ACCEPT = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes: small and capital letters, digits, white space, line ends, other bytes of longer code points, and three kinds of signs.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", bytes(range(128, 256)), b".,;:'\"()-", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~"]
_KIND = np.zeros(256, np.int64)
for _k, _signs in enumerate(_KINDS):
    _KIND[list(_signs)] = _k
SIGNS = len(_KINDS) + 5
WIDTH = GRAMS + SIGNS
_POWERS = np.cumprod(np.full(1 << 10, 0x100000001B3, np.uint64), dtype=np.uint64)


def passages(text: bytes) -> np.ndarray:
    """Where the text's passages begin, the first at 0; white space after a word belongs to it."""
    if not text:
        return np.zeros(1, np.int64)
    blank = _SPACE[np.frombuffer(text, np.uint8)]
    begin = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))[::PASSAGE]
    return np.concatenate(([0], begin[1:]))


def vectors(text: bytes) -> np.ndarray:
    """A row for each passage of a whole text."""
    begin = passages(text)
    out = np.zeros((len(begin), WIDTH), np.float32)
    edges = np.append(begin, len(text))
    for lo in range(0, len(begin), BATCH):
        hi = min(lo + BATCH, len(begin))
        _fill(out[lo:hi], np.frombuffer(text, np.uint8)[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo])
    return out


def _fill(out: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> None:
    """The rows of the passages that begin and end at ``edges``."""
    n, blank = len(out), _SPACE[codes]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(codes) else np.empty(0, np.int64)
    if not len(starts):
        return
    size = np.diff(edges)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * len(_KINDS) + _KIND[codes], minlength=n * len(_KINDS)).reshape(n, -1) / size[:, None]
    # Pairs that reach into the next passage count for neither.
    inside = owner[:-1] == owner[1:]
    pair = codes[:-1][inside].astype(np.int64) * 31 + codes[1:][inside]
    grams = np.bincount(owner[:-1][inside] * GRAMS + (pair * 2654435761 >> 7) % GRAMS, minlength=n * GRAMS).reshape(n, GRAMS)
    out[:, :GRAMS] = np.sqrt(grams / np.maximum(1, grams.sum(axis=1, keepdims=True)))
    out[:, GRAMS : GRAMS + len(_KINDS)] = np.sqrt(kinds)
    # Words by a hash of their bytes; white space counts as 0.
    place = np.arange(starts[0], len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
    value = np.where(blank[starts[0] :], np.uint64(0), codes[starts[0] :].astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)]
    word = np.add.reduceat(value, starts - starts[0])
    solid = np.add.reduceat(~blank[starts[0] :], starts - starts[0], dtype=np.int64)
    group = np.arange(len(starts)) // PASSAGE
    count = np.bincount(group, minlength=n)
    order = np.lexsort((word, group))
    fresh = np.concatenate(([True], (np.diff(word[order]) != 0) | (np.diff(group[order]) != 0)))
    most = np.zeros(n)
    np.maximum.at(most, group[order][fresh], np.diff(np.flatnonzero(np.append(fresh, True))))
    rest = out[:, GRAMS + len(_KINDS) :]
    rest[:, 0] = np.bincount(group[order], fresh, n) / count
    rest[:, 1] = most / count
    rest[:, 2] = np.bincount(group[1:], (word[1:] == word[:-1]) & (group[1:] == group[:-1]), n) / count
    rest[:, 3] = np.log1p(np.bincount(group, solid, n) / count) / 3
    rest[:, 4] = np.log1p(count) / 4


@dataclass
class Model:
    share: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH, np.float32))
    #: encoder W, b; attention T, G, v; head c, c0.
    weights: list[np.ndarray] | None = None

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """h and attention logit of passages."""
        w, b, t, g, v, _, _ = self.weights
        h = np.tanh(((x - self.mean) * self.scale) @ w + b)
        return h, (np.tanh(h @ t) / (1 + np.exp(-(h @ g)))) @ v

    def score(self, bags: list[np.ndarray]) -> list[float]:
        """Of whole documents, each given as its passages' vectors."""
        if self.weights is None:
            return [self.share] * len(bags)
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        top, total, z = np.full(len(bags), -np.inf), np.zeros(len(bags)), np.zeros((len(bags), HIDDEN))
        every = np.concatenate(bags) if bags else np.empty((0, WIDTH))
        for lo in range(0, len(every), BATCH):
            h, a = self.encoded(every[lo : lo + BATCH])
            of = owner[lo : lo + BATCH]
            new = top.copy()
            np.maximum.at(new, of, a)
            # What was summed up under a smaller highest logit is scaled to the new one.
            old = np.where(np.isfinite(top), np.exp(top - np.where(np.isfinite(new), new, 0)), 0)
            weight = np.exp(a - new[of])
            total = total * old + np.bincount(of, weight, len(bags))
            z *= old[:, None]
            np.add.at(z, of, weight[:, None] * h)
            top = new
        logit = (z / total[:, None]) @ self.weights[5] + self.weights[6][0]
        return (1 / (1 + np.exp(-logit))).tolist()


def loss(weights: list[np.ndarray], x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Logistic loss of bags (``owner`` ascends over passages) and its gradient for every weight."""
    w, b, t, g, v, c, c0 = weights
    n = len(y)
    start = np.searchsorted(owner, np.arange(n))
    h = np.tanh(x @ w + b)
    left, right = np.tanh(h @ t), 1 / (1 + np.exp(-(h @ g)))
    gate = left * right
    a = gate @ v
    e = np.exp(a - np.maximum.reduceat(a, start)[owner])
    p = e / np.add.reduceat(e, start)[owner]
    z = np.add.reduceat(p[:, None] * h, start)
    logit = z @ c + c0[0]
    value = float(np.mean(np.logaddexp(0, logit) - y * logit))
    d = (1 / (1 + np.exp(-logit)) - y) / n
    dz = d[:, None] * c
    dp = (dz[owner] * h).sum(axis=1)
    da = p * (dp - np.add.reduceat(p * dp, start)[owner])
    dgate = da[:, None] * v
    dleft, dright = dgate * right * (1 - left**2), dgate * left * right * (1 - right)
    dh = p[:, None] * dz[owner] + dleft @ t.T + dright @ g.T
    du = dh * (1 - h**2)
    return value, [x.T @ du, du.sum(axis=0), h.T @ dleft, h.T @ dright, gate.T @ da, z.T @ d, np.array([d.sum()])]


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(11)
    model = Model(float(y.mean()) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return model
    count = np.array([len(b) for b in bags])
    every = np.concatenate(bags)
    model.mean = every.mean(axis=0)
    model.scale = 1 / (every.std(axis=0) + np.float32(0.02))
    shapes = ((WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,))
    weights = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or s[0] > 1 and k > 3 else np.zeros(s) for k, s in enumerate(shapes)]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        for batch in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BAGS)):
            batch = batch[np.argsort(count[batch], kind="stable")]
            x = (np.concatenate([bags[i] for i in batch]) - model.mean) * model.scale
            _, grad = loss(weights, x, np.repeat(np.arange(len(batch)), count[batch]), y[batch])
            step += 1
            for k, w in enumerate(weights):
                slope = grad[k] + (1e-4 * w if k in (0, 2, 3) else 0)
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                w -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.weights = [w.astype(np.float32) for w in weights]
    return model


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("quality"))
    # Twice as many as needed, since some have no text to learn from.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = cut(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    bags, y = [], []
    for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        bags.append(vectors(r["text"].encode()))
        y.append(r["quality"])
    return train(bags, np.array(y, float))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            scores = model.score([vectors(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
